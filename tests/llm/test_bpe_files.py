"""Tokenizer files with the pattern of the short path, but other normalisers."""

import json

from tests.llm.test_llm import queries
from tidewright.llm import bpe


def test_short_path_depends_on_the_normaliser_too():
    from tokenizers import Tokenizer

    source = bpe.tokenizer_source(queries.tokenizer_path())
    assert bpe.Codec(source).short
    spec = json.loads(source)
    spec["normalizer"] = None
    cased = json.dumps(spec)
    codec, library = bpe.Codec(cased), Tokenizer.from_str(cased)
    assert not codec.short
    for text in ("Hello World", "ÀÉ x", "don't SHOUT", "a b  c"):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
