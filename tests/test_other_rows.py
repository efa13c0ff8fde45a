"""Queries on other rows than the driver's: rare texts, more keys, several kinds in one row."""

import hashlib

from pyspark.sql import functions as F

from tests.compare import SF, oracle, rows
from tests.llm.test_llm import brute_spans
from tidewright.llm import pii, queries, substring_dedup
from tidewright.operators import joins
from tidewright.plans import registry


def same_as_sql(spark, name, folder):
    found, wanted = registry.QUERIES[name](spark, folder).toPandas(), oracle(registry.ORACLES[name], folder)
    assert len(wanted) and rows(found) == rows(wanted)


def written(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/parts-{name}")
    next((folder / f"parts-{name}").glob("*.parquet")).rename(folder / f"{name}.parquet")


def test_counts_of_personal_data_are_those_of_the_patterns(spark, tmp_path):
    texts = [None, "", "none", "a@b.co", "a@b.co c@d.org e@f.net", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "+1 (988) 555-2485 a@b.co 1.2.3.4 4111 1111 1111 1111 5.6.7.8"]
    written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tmp_path, "documents")
    found = {r.doc_id: r for r in queries.op9_skip_chain_crf(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        base = brute_spans(text or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        wanted = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert ([found[i].n_email, found[i].n_ip, found[i].n_card, found[i].n_phone], found[i].base_sha256) == (wanted, digest), text


def test_texts_with_one_symbol_or_none(spark):
    """Groups of texts in which there is nothing to tell apart: copies, short texts, a single window."""
    words = " ".join(f"w{i}" for i in range(20))
    for texts, removed in (([None, "", "few words"], [0, 0, 0]), ([words], [0]), (["few words"] * 3, [0, 0, 0]), ([words] * 3, [0, 20, 20]), ([words, "x " + words], [0, 20]), (["a " * 19], [0]), (["a " * 20], [0]), (["a " * 21], [20])):
        found = substring_dedup.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
        assert [r.n_removed for r in sorted(found, key=lambda r: r.id)] == removed, texts
    many = [(i, words if i % 2 else " ".join(f"v{i}x{j}" for j in range(20))) for i in range(64)]
    found = substring_dedup.cut_repeats(spark.createDataFrame(many, "doc_id long, text string").repartition(64)).collect()
    assert sum(r.n_removed for r in found) == 31 * 20


def test_branch_of_more_concepts_than_one_may_have(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    written(part.crossJoin(spark.range(301)).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("id")).drop("id"), tmp_path, "part")
    same_as_sql(spark, "s23_branch", str(tmp_path))


def test_facts_of_short_and_missing_texts(spark, tmp_path):
    texts = [None, "", "a", "ab  ", "abcd", "abcde", "words enough for a quote of any length, and some more"]
    written(spark.createDataFrame([(16 * n + k, text) for n, text in enumerate(texts) for k in range(16)], "doc_id long, text string"), tmp_path, "documents")
    same_as_sql(spark, "x35_fact_validation", str(tmp_path))


def test_claims_of_short_and_missing_texts(spark, tmp_path):
    texts = [None, "", "  ", "x" * 18, "x" * 19, "x" * 19 + " ", " " + "x" * 19, "x" * 20, "y" * 59 + "  z"]
    written(spark.createDataFrame([(13 * n, k, text) for n, text in enumerate(texts) for k in range(13)], "conv_id long, turn long, text string"), tmp_path, "conversations")
    same_as_sql(spark, "x36_claim_validation", str(tmp_path))


def test_links_meet_pages_of_several_names_once(spark):
    links = spark.createDataFrame([(s, t, n) for s in (1, 2, 3, None) for t in (1, 1, 2, 3) for n in (0, 1)], "source long, target_id long, ns long")
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (1, "a")], "target_id long, title string")
    pages = spark.createDataFrame([(0, "a", 1), (0, "a", 1), (1, "a", 7), (0, "b", 7), (1, "b", 8), (None, "b", 9), (0, None, 8), (0, "a", None)], "ns long, title string, page long")
    found = sorted(map(tuple, joins.resolved_links(links, targets, pages).collect()))
    assert found == [(1, 7), (1, 8), (2, 1), (2, 7), (2, 8), (3, 1), (3, 7), (3, 8)]


def test_resolved_links_of_pages_of_one_name_are_not_shuffled(spark):
    links = spark.range(20).select(F.col("id").alias("source"), F.lit(1).cast("long").alias("target_id"), F.lit(0).cast("long").alias("ns"))
    targets = spark.createDataFrame([(1, "a")], "target_id long, title string")
    pages = spark.range(1000, 2000).select(F.lit(0).cast("long").alias("ns"), F.lit("a").alias("title"), F.col("id").alias("page"))
    found = joins.resolved_links(links, targets, pages)
    assert len(found.collect()) == 20_000
    dealt = []

    def walk(node):
        if node.metrics().contains("shuffleRecordsWritten"):
            dealt.append(node.metrics().apply("shuffleRecordsWritten").value())
        below = [node.children().apply(i) for i in range(node.children().size())]
        for x in [*below, *([node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else []), *([node.plan()] if "QueryStage" in node.nodeName() else [])]:
            walk(x)

    walk(found._jdf.queryExecution().executedPlan())
    assert dealt and max(dealt) <= 1000


def test_resolved_links_of_one_name_follow_each_other(spark):
    pages = spark.range(60).select((F.col("id") % 2).alias("ns"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("title"), (F.col("id") + 10_000).alias("page"))
    targets = spark.range(300).select(F.col("id").alias("target_id"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("title"))
    links = spark.range(4000).select(F.col("id").alias("source"), F.explode(F.array(*[(F.col("id") + k) % 300 for k in (0, 0, 1, 2)])).alias("target_id"), (F.col("id") % 2).alias("ns"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1g")
    try:
        found = joins.resolved_links(links, targets, pages)
        tasks = found.rdd.mapPartitions(lambda rows: [[tuple(r) for r in rows]]).collect()
    finally:
        spark.conf.set(threshold, before)
    assert sorted(r for rows in tasks for r in rows) == [(s, 10_000 + p) for s in range(4000) for p in range(60) if p % 2 == s % 2]
    met = [[(page % 2, (page - 10_000) % 3) for _, page in rows] for rows in tasks]
    turns = sum(1 for names in met for a, b in zip(names, names[1:]) if a != b)
    assert turns < 6 * 32  # a name is met once in each share of its sources, not again and again
