import hashlib
import json
import random
import re
import unicodedata
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import SF
from tidewright.operators import aggregates, classification, filters, graph, joins, ledger, selection
from tidewright.plans import registry
from tidewright.streaming import dedupe


def test_budget_skips_misfits_and_lets_one_go_over(spark):
    df = spark.createDataFrame([("a", 1, 90, 1), ("a", 2, 20, 1), ("a", 3, 5, 1), ("b", 4, 200, 1), ("b", 5, 1, 1)], "k string, i int, w long, n long")
    found = selection.budget_skipping(df, "k", ["i"], {"w": 100, "n": 10}, 5).select("i").collect()
    assert sorted(r.i for r in found) == [1, 3, 4]
    firm = selection.budget_skipping(df, "k", ["i"], {"w": 100, "n": 10}, 5, firm="w").select("i").collect()
    assert sorted(r.i for r in firm) == [1, 3, 5]


def test_first_fit_jobs(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([500, 400, 300, 80, 500])], "k string, i int, s long")
    assert [r.bin for r in selection.first_fit_jobs(df, "k", ["i"], "s", 880, 10).orderBy("i").collect()] == [0, 1, 0, 0, 2]
    bins = selection.first_fit_jobs(df, "k", ["i"], "s", 880, 10).groupBy("bin").agg(F.sum("s").alias("s")).collect()
    assert all(r.s <= 880 for r in bins) and sum(r.s for r in bins) == 1780


def test_two_queues_stay_in_budget(spark):
    df = spark.createDataFrame([("a", i, 10.0, i % 2 == 0) for i in range(20)], "k string, i int, c double, e boolean")
    found = selection.two_queues(df, "k", ["i"], "c", "e", 80.0).collect()
    assert sum(r.c for r in found) == 80 and 1 <= sum(r.e for r in found) <= 4


def test_prefix_range_is_not_starts_with(spark):
    df = spark.createDataFrame([("ab",), ("ab😀",), ("abz",), ("ac",)], "t string")
    assert {r.t for r in df.filter(filters.prefix_range("t", "ab")).collect()} == {"ab", "abz"}
    assert filters.prefix_range("t", "ab") is not None
    joined = joins.prefix_join(spark.createDataFrame([("ab",), ("a",)], "a string"), df, "a", "t")
    assert {(r.a, r.t) for r in joined.collect()} == {("ab", "ab"), ("ab", "abz"), ("a", "ab"), ("a", "ab😀"), ("a", "abz"), ("a", "ac")}


def test_not_in_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "x string")
    assert {r.x for r in df.filter(filters.not_in("x", ["a"])).collect()} == {None, "b"}


def test_fold_counts_what_does_not_fit(spark):
    events = spark.createDataFrame([(1, 1, "queue"), (1, 2, "select"), (1, 3, "enrich"), (1, 4, "queue"), (1, 5, "enrich"), (2, 1, "select")], "k int, o int, e string")
    found = {r.k: (r.state, r.applied, r.refused) for r in ledger.folded_state(events, "k", "o", "e").collect()}
    assert found == {1: ("ENRICHED", 4, 1), 2: ("PENDING", 0, 1)}


def test_numbers_are_gapless_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    found = sorted(r.code for r in ledger.numbered(df, "id", "X", width=4).collect())
    assert found == [f"X{i:04d}" for i in range(1, 1001)]


def test_crawl_uses_budget_at_greatest_depth(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 4, 1.0)], "g int, source int, target int, gain double")
    s = spark.createDataFrame([(0, 1, 1000.0)], "g int, node int, score double")
    found = {r.node: (r.depth, r.expanded) for r in graph.best_first("g", e, s, pages=10, links=5, depth=2).collect()}
    assert found == {1: (0, True), 2: (1, True), 3: (2, True)}
    assert sum(r.expanded for r in graph.best_first("g", e, s, pages=2, links=5, depth=2).collect()) == 2


def test_stratified_takes_all_when_few(spark):
    df = spark.range(5)
    assert selection.stratified(df, [F.asc("id")], "id", 10).count() == 5


def test_receipts_over_micro_batches(spark, tmp_path):
    path = str(tmp_path / "receipts")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "job int, body string")
    two = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "job int, body string")
    for _ in range(2):  # a batch that is run again gives the same outcomes
        assert {r.outcome for r in dedupe.import_batch(one, path, "job", "body", 0).collect()} == {"NEW"}
    for _ in range(2):
        assert {r.job: r.outcome for r in dedupe.import_batch(two, path, "job", "body", 1).collect()} == {1: "ALREADY_IMPORTED", 2: "CONFLICT", 3: "NEW"}
    three = spark.createDataFrame([(7, "x"), (7, "y"), (7, "y")], "job int, body string")
    assert sorted(r.outcome for r in dedupe.import_batch(three, path, "job", "body", 2).collect()) == ["CONFLICT", "NEW"]
    assert spark.read.parquet(path).count() == 4


def test_streamed_fold(spark, tmp_path):
    pd.DataFrame({"k": [1, 1, 2], "o": [1, 2, 1], "e": ["queue", "select", "queue"]}).to_parquet(tmp_path / "a.parquet")
    stream = spark.readStream.schema("k long, o long, e string").parquet(str(tmp_path))
    query = dedupe.folded_stream(stream, "k", "o", "e").writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.k, r.state) for r in spark.table("folded").collect()} == {(1, "SELECTED"), (2, "QUEUED_SELECTION")}


def test_missing_role_is_an_error(spark):
    with pytest.raises(ValueError):
        joins.by_alias(spark.range(1), {"x": ["nope"]})


def test_scalar_queries_read_whole_texts_in_every_language(spark, tmp_path):
    rng = random.Random(4)
    some = ["The", "ÄPFEL", "déjà_vu", "que", "with", "und", "x", "naïve-1", "Don't", "日本語", "der", "that"]
    texts = {i: " ".join(rng.choice(some) for _ in range(200)) + f"\n\t Ende_{i} les" for i in range(6)}
    texts[6] = "Short"
    docs = [(i, s, ["en", "de", "fr"][i % 3]) for i, s in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda name, column: {r.doc_id: r[column] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    plain = lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    assert found("x2_squeezed", "s") == {i: " ".join(s.replace("_", " ").lower().split()) for i, s in texts.items()}
    assert found("x3_ascii_folded", "s") == {i: " ".join(re.findall("[a-z0-9]+", plain(s))) for i, s in texts.items()}
    assert found("x42_search_words", "words") == {i: sorted({w for w in re.findall(r"[\w-]+", s.lower()) if len(w) >= 3}) for i, s in texts.items()}
    name = lambda x: " ".join(re.split(r"[|#]", x)[0].replace("_", " ").split())
    links = {i: {n[0].upper() + n[1:] for n in ["first one", *map(name, s.split(" "))] if n} for i, s in texts.items()}
    assert {i: set(x) for i, x in found("x10_wiki_links", "links").items()} == links


def test_leads_and_passages(spark, tmp_path):
    spark.createDataFrame([(1, "the cat <b>sat</b> ''there'' le chat " + "z " * 200 + "the end"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in registry.QUERIES["x11_x12_lead_and_passages"](spark, str(tmp_path)).collect()}
    lead = "the cat sat there le chat " + "z " * 200 + "the end"
    assert rows[1].n == len(lead) and rows[2].n == 0 and not rows[2].passages
    assert rows[1].passages == [" ".join(lead[:123].split()), " ".join(lead[lead.rindex("the") - 120 :].split())]


def test_uuids_and_keys(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: r.uuid for r in registry.QUERIES["x41_deterministic_uuid"](spark, SF).collect()}
    assert found == {r.page_id: str(uuid.uuid5(uuid.NAMESPACE_URL, r.url)) for r in pages}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    keys = {(r.conv_id, r.turn): r.fact_key for r in registry.QUERIES["x20_canonical_keys"](spark, SF).collect()}
    assert keys == {(r.conv_id, r.turn): "PROP2_" + hashlib.sha256(json.dumps({"page_id": r.conv_id, "statement": r.text}, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:40] for r in turns}


def test_fingerprints_follow_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    first = aggregates.fingerprint(docs, ["doc_id", "text"]).collect()
    assert first == aggregates.fingerprint(docs.repartition(7), ["doc_id", "text"]).collect()
    other = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("x")).otherwise(F.col("text")))
    assert first != aggregates.fingerprint(other, ["doc_id", "text"]).collect()


@pytest.mark.parametrize("seed", range(3))
def test_packers_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(3)}", i, rng.randrange(1, 60), rng.randrange(1, 9), rng.random() < 0.3) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, i int, n int, w int, e boolean")
    by_key = {k: sorted(r for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    wanted = set()
    for own in by_key.values():
        taken, n, w = [], 0, 0
        for r in own:
            if len(taken) < 12 and r[2] <= 200 and (not taken or (n + r[2] <= 200 and w + r[3] <= 30)):
                taken.append(r)
                n, w = n + r[2], w + r[3]
        wanted |= set(taken)
    assert {tuple(r) for r in selection.budget_skipping(df, "k", ["i"], {"n": 200, "w": 30}, 12, firm="n").collect()} == wanted
    wanted = set()
    for own in by_key.values():
        queues, left, taken, explored = [[r for r in own if not r[4]], [r for r in own if r[4]]], 150.0, 0, 0
        while any(queues):
            for q in (0, 1) if explored >= 0.25 * (taken + 1) else (1, 0):
                if queues[q] and queues[q][0][2] <= left:
                    r = queues[q].pop(0)
                    left, taken, explored = left - r[2], taken + 1, explored + q
                    wanted.add(r)
                    break
            else:
                break
    assert {tuple(r) for r in selection.two_queues(df, "k", ["i"], "n", "e", 150.0).collect()} == wanted
    wanted = {}
    for own in by_key.values():
        for b in range(0, len(own), 20):
            bins = []
            for r in own[b : b + 20]:
                k = next((k for k, g in enumerate(bins) if sum(x[2] for x in g) + r[2] <= 80 and len(g) < 4), len(bins))
                bins[k : k + 1] = [[*(bins[k] if k < len(bins) else []), r]]
                wanted[r[1]] = k + b
    assert {r.i: r.bin for r in selection.first_fit_jobs(df, "k", ["i"], "n", 80, 4, block=20).collect()} == wanted


def test_crawl_equals_a_plain_loop(spark):
    rng = random.Random(8)
    edges = [(g, a, rng.randrange(60), float(rng.randrange(30))) for g in range(3) for a in range(60) for _ in range(rng.randrange(6))]
    edges = list({(g, a, b): (g, a, b, x) for g, a, b, x in edges}.values())
    seeds = [(g, 7 * g + s, 1000.0) for g in range(3) for s in range(3)]
    wanted = set()
    for g in range(3):
        score = {n: v for h, n, v in seeds if h == g}
        level, done = dict.fromkeys(score, 0), []
        pushed = [(-v, n) for n, v in score.items()]
        while pushed and len(done) < 15:
            pushed.sort()
            _, a = pushed.pop(0)
            if a in done:
                continue
            done.append(a)
            for _, _, b, gain in sorted(e for e in edges if e[:2] == (g, a))[:4] if level[a] < 2 else []:
                new = round(70 - 22 * (level[a] + 1) + gain, 3)
                if b not in score or (new > score[b] and level[b]):
                    score[b], level[b] = new, min(level.get(b, level[a] + 1), level[a] + 1)
                    pushed.append((-new, b))
        wanted |= {(g, n, level[n], score[n], n in done) for n in score}
    found = graph.best_first("g", spark.createDataFrame(edges, "g int, source int, target int, gain double"), spark.createDataFrame(seeds, "g int, node int, score double"), pages=15, links=4, depth=2)
    assert {tuple(r) for r in found.collect()} == wanted


def test_intervals_of_every_length(spark):
    rng = random.Random(2)
    spans = [(i, a := rng.randrange(-500, 2000), a + rng.choice([0, 1, 7, 60, 900, 100_000])) for i in range(120)] + [(999, 5, 4)]
    points = [(rng.randrange(-600, 3000),) for _ in range(300)]
    found = joins.interval_join(spark.createDataFrame(points, "x long"), spark.createDataFrame(spans, "i int, a long, b long"), "x", "a", "b")
    assert sorted((r.x, r.i) for r in found.collect()) == sorted((x, i) for (x,) in points for i, a, b in spans if a <= x <= b)


def test_lifecycle_has_retries(spark):
    events = [(1, i, e) for i, e in enumerate(["queue", "hold", "retry", "queue", "select", "queue", "partial", "retry"])] + [(2, 0, "retry")]
    found = {r.k: (r.state, r.applied, r.refused) for r in ledger.folded_state(spark.createDataFrame(events, "k int, o int, e string"), "k", "o", "e").collect()}
    assert found == {1: ("SELECTED", 8, 0), 2: ("PENDING", 0, 1)}


def test_append_only_refuses_changes(spark):
    stored = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert [r.k for r in ledger.append_only(stored, spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), "k").collect()] == [3]
    with pytest.raises(ValueError, match="append only"):
        ledger.append_only(stored, spark.createDataFrame([(2, "x")], "k int, v string"), "k")


def test_profiles_without_signs_cant_be_classified_again(spark):
    profiles = spark.createDataFrame([(1, "t", None, ["a"], "Q1", "old")], "i int, title string, categories array<string>, links array<string>, qid string, signature string")
    terms = spark.createDataFrame([("b", "c", "t")], "branch string, concept string, term string")
    with pytest.raises(ValueError):
        classification.reclassified(profiles, profiles, terms, "new", item="i", kinds={"PLACE": ("x",)})


def test_crawl_reaches_every_customer(spark):
    found = registry.QUERIES["g4_best_first_crawl"](spark, SF).filter("depth = 0 and expanded").select("node").collect()
    customers = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()
    assert sorted(r.node for r in found) == sorted(r.c_custkey for r in customers)
