"""BPE encoding and decoding by dynamic programming over prefixes.

The last token of the encoding of a prefix is unique, and an encoding is right
exactly when all neighbouring tokens are compatible, that is, when the pair
encodes to itself. For every prefix of a pretoken this encoder

* takes, from a suffix automaton of the vocabulary, all tokens that end there;
* keeps the one that is compatible with the stored last token of the prefix
  before it (or, at the start, encodes to itself);

and then follows the stored tokens back from the end. That takes one pass with
a few pair tests a symbol, whatever the length of a pretoken, where merging by
rank needs a pass for each merge.

Normalising, splitting on special tokens and pretokenising follow the tokenizer
file. Texts of plain ASCII and Latin letters, where these steps amount to
lower-casing and one pattern, take a short path; all others go through the
library's own normaliser and pretokeniser.

Defined results: a null or empty text encodes to no ids and decodes to the
empty string; texts and words of any length are encoded whole, in time linear in
the text (a word costs a few steps a symbol); there are no ties, as an encoding
is unique; repeated rows and rows with a null id are encoded each; an empty table
gives no rows; other columns are passed through by ``encode``/``round_trip`` only
where named, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.worker import Generations, kept

#: The tokenizer file goes to the executors in the task closure; a larger one is refused.
MAX_FILE_BYTES = 32 << 20
#: Entries of a worker's memo of pretokens.
MEMO = 300_000

# Letters of the short path: A-Z, a-z and U+00C0-U+017F without the signs U+00D7 and U+00F7;
# U+0130 is left to the library, as its lower case is two characters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_NOT_SHORT = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]")
# The pretokenizer pattern of the file whose texts take the short path.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normaliser and pretokeniser that amount to lower-casing and that pattern on such texts.
_LOWER = [("NFC", None), ("Replace", r"\s+", " "), ("Lowercase", None)]
_SPLIT = [("Split", _WORD_PATTERN, "Removed", True), ("ByteLevel", False, False)]
_SHORT = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTERS}]+")


def _shape(steps: dict | None) -> list[tuple]:
    """What a normaliser or pretokeniser of a tokenizer file does, step by step."""
    found = []
    for step in (steps or {}).get("normalizers") or (steps or {}).get("pretokenizers") or [steps or {}]:
        kind, pattern = step.get("type"), (step.get("pattern") or {}).get("Regex")
        more = {"Replace": (step.get("content"),), "Split": (step.get("behavior"), step.get("invert")), "ByteLevel": (step.get("use_regex"),)}
        found.append((kind, step.get("add_prefix_space") if kind == "ByteLevel" else pattern, *more.get(kind, ())))
    return found


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class SuffixAutomaton:
    """A generalised suffix automaton of symbol sequences, with the sequences that end in each state."""

    def __init__(self, width: int):
        self.width = width
        self.step: dict[int, int] = {}
        self.link, self.length, self.symbols = [-1], [0], [[]]
        self.own: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.symbols.append([])
        return len(self.length) - 1

    def _copy(self, state: int, length: int) -> int:
        new = self._state(length)
        for c in self.symbols[state]:
            self.step[new * self.width + c] = self.step[state * self.width + c]
        self.symbols[new] = list(self.symbols[state])
        self.link[new] = self.link[state]
        return new

    def _redirect(self, state: int, c: int, old: int, new: int) -> None:
        while state >= 0 and self.step.get(state * self.width + c) == old:
            self.step[state * self.width + c] = new
            state = self.link[state]

    def _extend(self, last: int, c: int) -> int:
        step, width = self.step, self.width
        there = step.get(last * width + c)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            copy = self._copy(there, self.length[last] + 1)
            self.link[there] = copy
            self._redirect(last, c, there, copy)
            return copy
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and at * width + c not in step:
            step[at * width + c] = new
            self.symbols[at].append(c)
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
            return new
        there = step[at * width + c]
        if self.length[there] == self.length[at] + 1:
            self.link[new] = there
            return new
        copy = self._copy(there, self.length[at] + 1)
        self.link[there] = self.link[new] = copy
        self._redirect(at, c, there, copy)
        return new

    def add(self, sequence: tuple[int, ...]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def mark(self, sequence: tuple[int, ...], name: int) -> None:
        """Name a sequence, once all are added."""
        state = 0
        for c in sequence:
            state = self.step[state * self.width + c]
        self.own.setdefault(state, []).append((len(sequence), name))

    def finish(self) -> None:
        """For each state, the nearest one up its links where named sequences end."""
        self.symbols = []
        self.up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if above in self.own else self.up[above]
        for found in self.own.values():
            found.sort(reverse=True)


class Codec:
    """Encoder and decoder of a BPE tokenizer file (the JSON of the tokenizers library)."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain byte-level BPE model is needed")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("files with a decoder or post-processor aren't supported")
        library = Tokenizer.from_str(source)
        self.normalize = library.normalizer.normalize_str if library.normalizer else lambda text: text
        self.pretokenize = library.pre_tokenizer.pre_tokenize_str
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be matched in the text as it is")
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.short = _shape(spec.get("normalizer")) == _LOWER and _shape(spec.get("pre_tokenizer")) == _SPLIT

        # Inner names: base symbols first, then one for each merge, in the order of the merges.
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = list(range(256))
        self.last = [256 + b for b in range(256)] if suffix else self.inner
        base = [vocab[c] for c in alphabet] + ([vocab[c + suffix] for c in alphabet] if suffix else [])
        self.bases = len(base)
        self.ids = list(base)
        name_of = {i: n for n, i in enumerate(base)}
        self.parts: list[tuple[int, int]] = [(n, n) for n in range(self.bases)]
        sequences: list[tuple[int, ...]] = [(n,) for n in range(self.bases)]
        self.merged: dict[int, int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            new = vocab[a + b]
            left, right = name_of[vocab[a]], name_of[vocab[b]]
            if new in name_of:
                raise ValueError("a token with two merges")
            name_of[new] = len(self.ids)
            self.merged[left << 20 | right] = len(self.ids)
            self.ids.append(new)
            self.parts.append((left, right))
            sequences.append(sequences[left] + sequences[right])
        # Tokens that their own text doesn't encode to can't occur.
        whole = [True] * len(self.ids)
        for n in range(self.bases, len(self.ids)):
            a, b = self.parts[n]
            whole[n] = whole[a] and whole[b] and self._compatible(a, b, n)
        self.automaton = SuffixAutomaton(self.bases)
        for n, sequence in enumerate(sequences):
            if whole[n]:
                self.automaton.add(sequence)
        for n, sequence in enumerate(sequences):
            if whole[n]:
                self.automaton.mark(sequence, n)
        self.automaton.finish()
        self.pairs: dict[int, bool] = {}
        self.memo = Generations(self._word, MEMO)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge made before ``limit`` crosses the border of ``a`` and ``b``.

        The border symbols are undone from the latest merge back. A crossing
        merge of two tokens happens only if it comes before both the merges
        that took its sides up.
        """
        merged, parts = self.merged, self.parts
        while True:
            made = merged.get(a << 20 | b)
            if made is not None and made < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one pretoken, given as ordinary text."""
        return self._bytes(word.encode())

    def _bytes(self, data: bytes) -> tuple[int, ...]:
        auto, width, pairs, never = self.automaton, self.automaton.width, self.pairs, len(self.ids)
        step, link, length, own, up = auto.step, auto.link, auto.length, auto.own, auto.up
        end = len(data)
        last_token = [0] * (end + 1)
        size_of = [0] * (end + 1)
        state = matched = 0
        for i, byte in enumerate(data, 1):
            c = self.inner[byte] if i < end else self.last[byte]
            while (there := step.get(state * width + c)) is None and state:
                state = link[state]
                matched = length[state]
            if there is None:
                raise ValueError("a byte without a base token")
            state, matched = there, matched + 1
            at, most = state, matched
            token = -1
            while token < 0:
                for size, name in own.get(at, ()):
                    if size > most:
                        continue
                    if size < i:
                        before = last_token[i - size]
                        if before < 0:
                            continue
                        key = before << 20 | name
                        fits = pairs.get(key)
                        if fits is None:
                            if len(pairs) > 1_000_000:
                                pairs.clear()
                            fits = pairs[key] = self._compatible(before, name, never)
                        if not fits:
                            continue
                    token = name
                    size_of[i] = size
                    break
                else:
                    if not at:
                        break
                    at = up[at]
                    most = length[at]
            last_token[i] = token
        found, i = [], end
        while i > 0:
            found.append(self.ids[last_token[i]])
            i -= size_of[i]
        return tuple(found[::-1])

    def _pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of a text's parts by the library's normaliser and pretokeniser."""
        at = 0
        spans = [m.span() for m in self.split_special.finditer(text)] if self.split_special else []
        for a, b in [*spans, (len(text), len(text))]:
            for piece, _ in self.pretokenize(self.normalize(text[at:a])) if a > at else ():
                yield self._bytes(bytes(map(self.byte_of.__getitem__, piece)))
            if b > a:
                yield (self.special[text[a:b]],)
            at = b

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.short and not _NOT_SHORT.search(text) and not (self.split_special and self.split_special.search(text)):
            return list(chain.from_iterable(map(self.memo.__getitem__, _SHORT.findall(text.lower()))))
        return list(chain.from_iterable(self._pieces(text)))

    def decode(self, ids) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        source = file.read()
    if len(source) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    return source


def _codec(source: str) -> Codec:
    return kept(("bpe", hash(source), len(source)), lambda: Codec(source))


def round_trip(docs: DataFrame, path: str, *, keep: list[str], text_col: str = "text", decode: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``ids array<int>`` and, if asked for, ``decoded``."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    columns = [f"_k{i}" for i in range(len(keep))]
    chosen = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, columns, strict=True)], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [codec.encode(text) for text in texts]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1])
                out = [*part.columns[:-1], pa.ListArray.from_arrays(ends, flat)]
                if decode:
                    out.append(pa.array(map(codec.decode, found), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = [*columns, "ids", *["decoded"] * decode]
    kinds = [f"`{x}` {chosen.schema[x].dataType.simpleString()}" for x in columns]
    found = chosen.mapInArrow(run, ", ".join([*kinds, "ids array<int>", *["decoded string"] * decode]))
    return found.withColumnsRenamed(dict(zip(columns, keep, strict=True)))


def encode(docs: DataFrame, path: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with the ids of each text."""
    return round_trip(docs, path, keep=keep, text_col=text_col, decode=False)


def decode(rows: DataFrame, path: str, *, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` with the text that each array of ids stands for (null: empty)."""
    source = rows.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    columns = [f"_k{i}" for i in range(len(keep))]
    chosen = rows.select(*[F.col(c).alias(x) for c, x in zip(keep, columns, strict=True)], F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source.value)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*columns, "decoded"])

    kinds = [f"`{x}` {chosen.schema[x].dataType.simpleString()}" for x in columns]
    return chosen.mapInArrow(run, ", ".join([*kinds, "decoded string"])).withColumnsRenamed(dict(zip(columns, keep, strict=True)))


def digests(coded: DataFrame) -> list:
    """The columns n_tokens, ids_sha256 and decoded_sha256 of a round trip."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
