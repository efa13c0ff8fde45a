"""Queries of aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import aggregates
from tidewright.plans.base import Tables, query


@query("""
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS seed_count, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS links, CAST(sum(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS shared FROM events GROUP BY 1, 2
""")
def a1_evidence_rollup(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", F.concat(F.lit("k"), F.col("event_id") % 3).alias("kind"))
    return aggregates.evidence_rollup(e, ["event_type", "day"], "user_id", "kind", {"links": "k0", "shared": "k1"})


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a2_state_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation
""")
def a3_counts_with_zeros(t: Tables) -> DataFrame:
    k = lambda df, c: df.select(F.col(c).alias("k"))
    return aggregates.counts_with_zeros(k(t.nation, "n_nationkey"), "k", {"customers": k(t.customer, "c_nationkey"), "suppliers": k(t.supplier, "s_nationkey")})


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def a4_zero_groups(t: Tables) -> DataFrame:
    return t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("""
SELECT o_custkey, max(o_totalprice) AS score, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS evidence, count(*) AS hits FROM orders GROUP BY 1
""")
def a5_argmax_upsert(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_totalprice", F.col("o_orderkey").alias("arrival"), "o_orderkey")
    return aggregates.best_evidence(rows, ["o_custkey"], "o_totalprice", "o_orderkey", "arrival")


@query("SELECT c_custkey, coalesce(max(o_totalprice), 0) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a7_best_score(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return t.customer.select("c_custkey").join(best, "c_custkey", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def a8_multi_valued(t: Tables) -> DataFrame:
    return aggregates.multi_valued(t.orders, ["o_custkey", "o_orderpriority"])


@query("SELECT lang, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS line_ends, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def a9_language_totals(t: Tables) -> DataFrame:
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.sum(ends).alias("line_ends"), F.countDistinct("source").alias("sources"))


@query("SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, event_id % 4 AS batch, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def a10_incremental_merge(t: Tables) -> DataFrame:
    batches = [t.events.filter(F.col("event_id") % 4 == i).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")) for i in range(4)]
    total = batches[0]
    for b in batches[1:]:
        total = total.unionByName(b).groupBy("event_type").agg(F.sum("n").alias("n"))
    return total


_BITS = "CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 4 ELSE 0 END"
_FORMS = "f AS (SELECT lang, source, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS form FROM documents)"


def _forms(t: Tables) -> DataFrame:
    """The word forms of each whole text: (lang, k, source, b, form), k in lower case."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))
    bit = aggregates.family_bits(F.col("source"), {"src0": 1, "src1": 2, "src2": 4})
    return t.documents.select("lang", "source", bit.alias("b"), F.explode(words).alias("form")).withColumn("k", F.lower("form"))


@query(f"""
WITH {_FORMS}, s AS (SELECT lang, lower(form) AS k, source, count(*) AS n, bit_or({_BITS}) AS m FROM f GROUP BY 1, 2, 3),
g AS (SELECT lang, k, sum(n) AS n, count(*) AS sources, max(n) AS most, bit_or(m) AS m FROM s GROUP BY 1, 2)
SELECT lang, CAST(sum(n) AS BIGINT) AS observation_rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) FILTER (most > 1) AS repeated_inside_one_source,
 count(*) FILTER (sources > 1) AS shared_across_sources, count(*) FILTER (bit_count(m) > 1) AS shared_across_families, count(*) FILTER (m & 3 = 3) AS families_1_2, count(*) FILTER (m & 5 = 5) AS families_1_4, count(*) FILTER (m & 6 = 6) AS families_2_4 FROM g GROUP BY 1
""")
def a11_overlap_audit(t: Tables) -> DataFrame:
    return aggregates.overlap_audit(_forms(t).select("lang", "k", "source", "b"), "lang", "k", "source", "b")


@query(f"""
WITH {_FORMS} SELECT lang, lower(form) AS k, count(*) AS observations, bit_or({_BITS}) AS mask, count(DISTINCT source) AS sources, list_slice(list_sort(list(DISTINCT form)), 1, 6) AS spellings
FROM f GROUP BY 1, 2 HAVING bit_count(bit_or({_BITS})) >= 2
""")
def a12_reconciliation(t: Tables) -> DataFrame:
    return aggregates.reconciled(_forms(t), ["lang", "k"], "source", "b", {"spellings": ("form", 6)})


@query("SELECT o_orderkey, list(l_linenumber || ':' || CAST(l_quantity AS INT) ORDER BY l_linenumber, l_quantity) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def a13_nested_collection(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"))))
    return rows.groupBy("o_orderkey").agg(F.transform(lines, lambda x: F.concat_ws(":", x["n"], x["q"])).alias("lines"))


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned, count(*) AS rows, l_linestatus FROM lineitem GROUP BY l_linestatus")
def a14_scoped_distinct_counts(t: Tables) -> DataFrame:
    d = F.countDistinct
    return t.lineitem.groupBy("l_linestatus").agg(d("l_orderkey").alias("orders"), d("l_partkey").alias("parts"), d("l_suppkey").alias("suppliers"), d(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"), F.count(F.lit(1)).alias("rows"))


@query("""
SELECT 'brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'size', CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END, count(*) FROM part GROUP BY 2
""")
def a15_facets(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return aggregates.facets(t.part, {"brand": F.col("p_brand"), "size": size})


@query("SELECT c_mktsegment, round(avg(c_acctbal), 1) AS mean FROM customer GROUP BY 1")
def a16_rounded_mean(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 1).alias("mean"))


@query("SELECT lang, count(DISTINCT d.doc_id) AS items, count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id END) AS done, round(100.0 * count(DISTINCT CASE WHEN quality = 1 THEN d.doc_id END) / count(DISTINCT d.doc_id), 1) AS percent FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def a17_coverage(t: Tables) -> DataFrame:
    return aggregates.coverage(t.documents.join(t.labels, "doc_id", "left"), "doc_id", F.col("quality") == 1, ["lang"])


@query("""
SELECT CASE WHEN event_id % 1000 <= 300 THEN 's' WHEN event_id % 1000 < 650 THEN 'm' ELSE 'l' END AS bucket, round_even(median(value), 1) AS median, count(*) AS n FROM events WHERE value BETWEEN 0 AND 1440 GROUP BY 1
""")
def a18_bucket_medians(t: Tables) -> DataFrame:
    m = F.col("event_id") % 1000
    return aggregates.median_by_bucket(t.events, "value", F.when(m <= 300, "s").when(m < 650, "m").otherwise("l"), 0, 1440)


@query("SELECT CASE WHEN p_size >= 50 THEN '>=50' WHEN p_size >= 20 THEN '>=20' ELSE '<20' END AS bin, count(*) AS n FROM part GROUP BY 1")
def a19_histogram(t: Tables) -> DataFrame:
    return aggregates.histogram(t.part, "p_size", [50, 20])


@query("SELECT o, n FROM (SELECT p_type AS o, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(DISTINCT p_partkey) FROM part GROUP BY 1)")
def a20_vocabulary_statistics(t: Tables) -> DataFrame:
    triples = t.part.select(F.col("p_partkey").alias("s"), F.lit("type").alias("p"), F.col("p_type").alias("o")).union(t.part.select("p_partkey", F.lit("brand"), "p_brand"))
    return triples.groupBy("p", "o").agg(F.countDistinct("s").alias("n")).select("o", "n")


@query("""
SELECT k AS property, CAST(sum(n) AS BIGINT) AS statements FROM (SELECT 'flag_' || l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'status_' || l_linestatus, count(*) FROM lineitem GROUP BY 1) GROUP BY 1
""")
def a21_property_tallies(t: Tables) -> DataFrame:
    props = F.create_map(F.concat(F.lit("flag_"), "l_returnflag"), F.lit(1), F.concat(F.lit("status_"), "l_linestatus"), F.lit(1))
    return t.lineitem.select(F.explode(props).alias("property", "n")).groupBy("property").agg(F.sum("n").alias("statements"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS \"first\" FROM documents GROUP BY 1 HAVING count(*) > 1")
def a22_content_duplicates(t: Tables) -> DataFrame:
    return aggregates.content_duplicates(t.documents, "doc_id", "text")


@query("SELECT lang, count(*) FILTER (n_chars < 200) AS rejected, count(*) FILTER (n_chars >= 200) AS accepted FROM documents GROUP BY 1 HAVING count(*) FILTER (n_chars < 200) >= 0.05 * count(*)")
def a23_rejection_rate(t: Tables) -> DataFrame:
    g = t.documents.groupBy("lang").agg(F.sum((F.col("n_chars") < 200).cast("int")).alias("rejected"), F.sum((F.col("n_chars") >= 200).cast("int")).alias("accepted"))
    return g.filter(F.col("rejected") >= 0.05 * (F.col("rejected") + F.col("accepted")))


@query("""
WITH r AS (SELECT sha256(to_json({'doc_id': doc_id, 'text': text})) AS h, (row_number() OVER (ORDER BY doc_id, text) - 1) // 1000 AS b, doc_id, text FROM documents),
b AS (SELECT b, sha256(string_agg(h, '' ORDER BY doc_id, text)) AS h FROM r GROUP BY 1), c AS (SELECT b // 1000 AS c, sha256(string_agg(h, '' ORDER BY b)) AS h FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS n, CASE WHEN (SELECT count(*) FROM b) = 1 THEN (SELECT h FROM b) ELSE (SELECT min(h) FROM c) END AS sha256
""")
def a24_catalogue_fingerprint(t: Tables) -> DataFrame:
    return aggregates.ordered_digest(t.documents, ["doc_id", "text"], ["doc_id", "text"])


@query("SELECT g AS grp, count(*) AS concepts FROM (SELECT unnest([p_brand, p_type]) AS g FROM part) GROUP BY 1")
def a26_group_partition(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.array("p_brand", "p_type")).alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("concepts"))


@query("""
WITH k AS (SELECT o_custkey, array_to_string(list_sort(list(o_orderpriority)), ' ') AS p FROM orders GROUP BY 1), b AS (SELECT c_custkey, left(trim(regexp_replace(concat_ws(' ', c_name, c_mktsegment, p), '\\s+', ' ', 'g')), 20000) AS body FROM customer LEFT JOIN k ON c_custkey = o_custkey)
SELECT c_custkey, body, sha256(body) AS digest FROM b
""")
def a27_search_documents(t: Tables) -> DataFrame:
    children = {"priorities": (t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "o_orderpriority")}
    return aggregates.search_documents(t.customer, "c_custkey", ["c_name", "c_mktsegment"], children)


@query("SELECT conv_id, arg_max(role, turn) AS role, count(*) AS n FROM conversations GROUP BY 1")
def a28_latest_review(t: Tables) -> DataFrame:
    return aggregates.latest(t.conversations, ["conv_id"], ["turn"], "role")
