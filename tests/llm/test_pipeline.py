"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import SF
from tests.llm.test_llm import brute_components, brute_cover, brute_edits, library, prose
from tidewright.llm.decontamination import normal_words
from tidewright.llm.scratch import Scratch
from tidewright.llm.tables import table


def test_stages(spark):
    scratch = Scratch(spark, "test")
    docs = table(spark, SF, "documents")
    made = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = made[name] = scratch.save(stage(spark, docs, SF), name)
    text = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, d in made.items() if n != "tokens"}
    assert all(d.columns == made["documents"].columns for n, d in made.items() if n != "tokens")
    assert text["language"] == text["documents"]  # all of these have a language
    kept = {d: "\n".join(x) for d, x in brute_cover(text["language"].items(), lambda t: t.split("\n"), 3).items()}
    gone = {d for d, t in brute_cover(text["language"].items(), lambda t: t.split("\n"), 3).items() if not t}
    assert text["lines"] == {d: t for d, t in kept.items() if d not in gone}
    groups = brute_components(text["lines"].items(), 5, 80)
    assert set(text["near_copies"]) == {d for d, (_, c) in groups.items() if c == d}
    plain = lambda t: b" " + b" ".join(normal_words([t])[0].split()) + b" "
    items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(text["benchmark"]) == {d for d, t in text["near_copies"].items() if not any(i in plain(t) for i in items)}
    lib = library()
    rows = made["tokens"].collect()
    assert {r.doc_id for r in rows} == set(text["benchmark"])
    for r in rows:
        ids = lib.encode(text["benchmark"][r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    once = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert {(r.doc_id, r.ids_sha256) for r in once} == {(r.doc_id, r.ids_sha256) for r in rows}


ODD = [
    (1, "the cat sat on the mat and the dog ran to the house by the river", "en"),
    (2, None, "en"),
    (3, "", "de"),
    (4, "der hund und die katze sind in dem haus an dem fluss mit der frau", "de"),
    (5, "²½ 12", "en"),
    (None, "the old man and the sea were in the house of the dog by the mat", None),
    (6, "the cat sat on the mat and the dog ran to the house by the river", "en"),
    (6, "the cat sat on the mat and the dog ran to the house by the river", "en"),
    (7, "l one of the cat\nl two of the dog\nl three of the mat\nthe end", "en"),
    (8, "l one of the cat\nl two of the dog\nl three of the mat", "en"),
    (9, "the cat " * 20_000, "en"),
]
CLASHES = ["lang_pred", "score", "id", "n_removed", "n_lines", "text_", "_text", "packed", "k0", "k3", "copy", "ids", "Found"]


def odd_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id")))
    return df.withColumn("n_chars", F.lit(0).cast("long"))


def test_stages_on_odd_rows_and_clashing_names(spark):
    docs = odd_table(spark, ODD)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    made = {n: f(spark, docs, SF) for n, f in corpus_pipeline.STAGES}
    for n, df in made.items():
        if n != "tokens":
            assert df.columns == docs.columns and df.dtypes == docs.dtypes, n
            for r in df.collect():
                assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASHES), n
    assert ids(made["language"]) == [0, 1, 4, 6, 6, 7, 8, 9]
    texts = {r.doc_id: (r.text, r.n_chars) for r in made["lines"].collect()}
    assert sorted(x or 0 for x in texts) == [0, 1, 2, 3, 4, 5, 6, 7, 9] and texts[2] == (None, None) and texts[7] == (ODD[8][1], len(ODD[8][1]))
    assert ids(made["near_copies"]) == [0, 1, 2, 3, 4, 5, 7, 9]  # 8 has 11 of the 13 shingles of 7
    assert ids(made["benchmark"]) == ids(docs)
    tokens = sorted((r.doc_id or 0, r.n_tokens) for r in made["tokens"].collect())
    assert [d for d, _ in tokens] == ids(docs) and [n for d, n in tokens if d in (2, 3)] == [0, 0]
    none = docs.limit(0)
    assert all(f(spark, none, SF).count() == 0 for f in stage.values())


def test_benchmark_stage_equals_brute_force_edits(spark, tmp_path):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(6, 25))) for i in range(8)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = []
    for i in range(60):
        w = items[i % 8][1].split()
        for _ in range(rng.randrange(0, 1 + len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zz"], [w[at], "yy"]])
            w = w or ["zz"]
        docs.append((i, f"{prose(rng, 12)} {' '.join(w)} {prose(rng, 12)}", "en"))
    stay = {r.doc_id for r in corpus_pipeline.benchmark(spark, odd_table(spark, docs), str(tmp_path)).collect()}
    plain = lambda t: normal_words([t])[0].split()
    held = {d for d, t, _ in docs for _, item in items if brute_edits(plain(item), plain(t)) <= len(plain(item)) // 5}
    assert stay >= {d for d, *_ in docs} - held and len(stay & held) <= 0.03 * len(held)
