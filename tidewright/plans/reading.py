"""Queries of readers and exports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import filters, joins
from tidewright.plans.base import Tables, query
from tidewright.sources import dumps, html, packs


@query("""
SELECT p_partkey AS page_id, p_size % 3 AS ns, p_name AS title, CAST(p_partkey % 2 AS INT) AS redirect, p_partkey + 1000 AS latest_revision, CAST(length(p_name) AS BIGINT) AS content_bytes FROM part
""")
def s4_dump_stage(t: Tables) -> DataFrame:
    s = lambda c, n: c.cast("string").alias(n)
    raw = t.part.select(s(F.col("p_partkey"), "page_id"), s(F.col("p_size") % 3, "page_namespace"), F.col("p_name").alias("page_title"), s(F.col("p_partkey") % 2, "page_is_redirect"), s(F.col("p_partkey") + 1000, "page_latest"), s(F.length("p_name"), "page_len"))
    return dumps.convert("page", raw)


@query("SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_quantity FROM lineitem GROUP BY 1, 2")
def s5_last_row_wins(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("line"))
    return dumps.last_per_key(rows, ["l_orderkey", "l_linenumber"], "line").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH w AS (SELECT DISTINCT doc_id FROM labels UNION SELECT -1), f AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN left(text, 100) END AS text, CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS text_sha256, 1 AS there FROM documents)
SELECT w.doc_id, text, text_sha256, CASE WHEN there IS NULL THEN 'NOT_FOUND' WHEN text_sha256 IS NULL THEN 'NO_TEXT' END AS reason FROM w LEFT JOIN f ON w.doc_id = f.doc_id
""")
def s8_s9_s10_wanted_pages(t: Tables) -> DataFrame:
    wanted = t.labels.select("doc_id").union(t.spark.createDataFrame([(-1,)], "doc_id long"))
    pages = t.documents.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    return dumps.wanted_pages(pages, wanted, "doc_id", 100)


@query("""
SELECT lang AS language_code, 'w' || doc_id AS lemma, 'w' || doc_id AS lemma_key, source AS pos, 2 AS senses, 1 AS forms, 0 AS translations, NULL AS external_id FROM documents
""")
def s15_jsonl_observations(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.concat(F.lit(" W"), "doc_id").alias("word"), F.upper("lang").alias("lang_code"), F.col("source").alias("pos"), F.array(F.lit("a"), F.lit("b")).alias("senses"), F.array(F.lit("c")).alias("forms")))
    found = dumps.observations(t.documents.select(line.alias("value")), "jsonl")
    return found.withColumn("lemma", F.lower("lemma"))


@query("SELECT 'en' AS language_code, p_name AS lemma, lower(p_name) AS lemma_key, 'N' AS pos FROM part")
def s15_tsv_observations(t: Tables) -> DataFrame:
    line = F.concat_ws("\t", "p_name", "p_type", F.lit("N;SG"))
    return dumps.observations(t.part.select(line.alias("value")), "tsv", language="en").select("language_code", "lemma", "lemma_key", "pos")


@query("SELECT 'w' || doc_id AS word, lang AS lang_code, 5 AS senses, true AS cut FROM documents")
def s16_trimmed_entries(t: Tables) -> DataFrame:
    line = F.to_json(F.struct(F.concat(F.lit("w"), "doc_id").alias("word"), F.col("lang").alias("lang_code"), F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string")).alias("senses")))
    return dumps.trimmed_entries(t.documents.select(line.alias("value")), "value", senses=5).select("word", "lang_code", F.size("senses").alias("senses"), "cut")


@query("SELECT page_id, problem FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'MISSING' WHEN page_id % 5 = 0 THEN 'CHANGED' WHEN page_id % 11 = 0 THEN 'UNEXPECTED' END AS problem FROM pages) WHERE problem IS NOT NULL")
def s18_s27_manifest_check(t: Tables) -> DataFrame:
    d = t.pages.select("page_id", F.sha2("html", 256).alias("digest"))
    found = d.filter("page_id % 7 <> 0").withColumn("digest", F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.col("digest")))
    expected = d.filter("page_id % 7 = 0 OR page_id % 5 = 0 OR page_id % 11 <> 0")
    return dumps.check_manifest(found, expected, "page_id", "digest")


@query("SELECT 'concept' || p_partkey AS concept_id, 'Q' || p_partkey AS qid FROM part WHERE p_partkey % 4 <> 0")
def s21_claims_csv(t: Tables) -> DataFrame:
    rows = t.part.select(F.concat(F.lit("http://v.org/concept"), "p_partkey").alias("Unesco_ID"), F.when(F.col("p_partkey") % 4 == 0, "bad").otherwise(F.concat(F.lit("http://w.org/Q"), "p_partkey")).alias("item"))
    return dumps.claims_csv(rows)[0]


@query("SELECT n_regionkey || '-' || n_nationkey AS concept_id, n_name AS label_en FROM nation")
def s22_branch_import(t: Tables) -> DataFrame:
    concept = F.struct(F.concat_ws("-", "n_regionkey", "n_nationkey").alias("unesco_id"), F.create_map(F.lit("en"), F.array("n_name")).alias("preferred_labels"), F.array().cast("array<string>").alias("broader"))
    branch = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("unesco_microthesaurus")).agg(F.collect_list(concept).alias("concepts"))
    return dumps.concepts_of(branch)["concepts"].select("concept_id", "label_en")


@query("""
WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
y AS (SELECT page_id, CASE WHEN regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'body' ELSE 'internal' END AS context FROM x
 UNION ALL SELECT page_id, 'citation' FROM pages UNION ALL SELECT page_id, 'internal' FROM pages UNION ALL SELECT page_id, 'navigation' FROM pages)
SELECT page_id, context, count(*) AS links FROM y GROUP BY 1, 2
""")
def s24_html_links(t: Tables) -> DataFrame:
    """Every page with a citation's list item and a navigation box after it, which hold links of each kind."""
    more = '<ol><li id="cite_note-1"><a href="https://c.org/x">c</a><a href="/own">o</a></li></ol><div class="x navbox"><a href="https://n.org/y">n</a></div>'
    found = html.page_links(t.pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit(more))), "page_id", "html")
    return found.groupBy("page_id", "context").agg(F.count(F.lit(1)).alias("links"))


@query("""
SELECT 'http://new.org/c/' || n_nationkey AS s, 'broader' AS p, CASE WHEN n_regionkey IN (SELECT n_nationkey FROM nation) THEN 'http://new.org/c/' || n_regionkey ELSE 'http://old.org/' || n_regionkey END AS o FROM nation
""")
def s28_linked_data_rewrite(t: Tables) -> DataFrame:
    iri = lambda c: F.concat(F.lit("http://old.org/"), c)
    triples = t.nation.select(iri("n_nationkey").alias("s"), F.lit("broader").alias("p"), iri("n_regionkey").alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("lang"))
    return dumps.rewritten(triples, "http://new.org/c").select("s", "p", "o")


@query("SELECT source, CAST(count(*) AS BIGINT) AS members, true AS whole FROM documents GROUP BY 1")
def k1_packs(t: Tables) -> DataFrame:
    """All documents in bounded ZIPs, and whether every ZIP is what its manifest says."""
    rows = t.documents.select("source", F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), "text")
    made = packs.packed(rows, "source", "name", "text")
    bad = packs.verified_packs(made, ["source", "part"]).select("source", "part", F.lit(True).alias("bad")).distinct()
    return made.join(bad, ["source", "part"], "left").groupBy("source").agg(F.sum("members").alias("members"), (F.count("bad") == 0).alias("whole"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS n_orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def k3_k11_nested_export(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    out = packs.nested(t.customer.select("c_custkey"), "c_custkey", {"orders": (orders, ["o_orderkey", "o_orderpriority"])})
    return out.select("c_custkey", F.size("orders").alias("n_orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"]).alias("total"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS assignments FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey > 20 ORDER BY 1 LIMIT 40) GROUP BY 1")
def k5_keyset_batch(t: Tables) -> DataFrame:
    return joins.keyset_batch(t.orders, "o_custkey", 20, 40, "o_orderkey", "assignments")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN ''' -x' ELSE p_name END AS cell FROM part")
def k8_formula_guard(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 4
    return t.part.select("p_partkey", T.guarded_cell(F.when(m == 0, F.concat(F.lit("="), "p_name")).when(m == 1, " -x").otherwise(F.col("p_name"))).alias("cell"))


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def k10_publishable_rows(t: Tables) -> DataFrame:
    return t.labels.filter(filters.export_gate(F.col("quality") == 1, F.col("toxic") == 0, F.lit(False))).select("doc_id")


@query("SELECT 'nation' AS source, NULL AS error, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'lost', 'no such island', NULL")
def k12_federated_view(t: Tables) -> DataFrame:
    return packs.fallible_union({"nation": t.nation, "lost": ValueError("no such island")}, "cast(n_nationkey as long) as id").select("source", "error", "id")
