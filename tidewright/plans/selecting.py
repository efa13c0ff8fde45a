"""Queries of windows, budgets, paging and filters on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import filters, selection
from tidewright.plans.base import Tables, query

_DAY = "CAST(o_orderdate AS DATE)"


@query("""
WITH pool AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1500),
r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS concept_turn FROM pool)
SELECT * FROM r ORDER BY concept_turn, o_totalprice DESC, o_orderkey LIMIT 150
""")
def w1_concept_turns(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return selection.concept_turns(rows, "o_custkey", "o_totalprice", "o_orderkey", 150)


@query("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5
""")
def w2_top_k_per_group(t: Tables) -> DataFrame:
    return selection.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 18
""")
def w3_first_n_per_group(t: Tables) -> DataFrame:
    return selection.top_k(t.events.select("user_id", "event_id"), ["user_id"], [F.asc("event_id")], 18).drop("rank")


@query("""
WITH s AS (SELECT lang, source, doc_id, length(text) % 3 AS family, row_number() OVER (PARTITION BY lang, length(text) % 3, source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, family ORDER BY doc_id, source) AS j FROM s WHERE k = 1)
SELECT lang, family, source, doc_id FROM f WHERE j <= 4
""")
def w4_varied_sample(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", (F.length("text") % 3).cast("long").alias("family"), "source", "doc_id")
    return selection.varied_sample(rows, ["lang"], "family", "source", [F.asc("doc_id")])


@query("""
WITH g AS (SELECT event_type, user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY ALL)
SELECT event_type, user_id, n, days, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, days DESC, user_id) AS rank FROM g) WHERE rank <= 8
""")
def w5_bounded_top(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    return selection.top_k(g, ["event_type"], [F.desc("n"), F.desc("days"), F.asc("user_id")], 8)


@query("""
SELECT p_partkey, 'P' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) + 41 AS VARCHAR), 6, '0') AS code FROM part
""")
def w6_gapless_numbers(t: Tables) -> DataFrame:
    from tidewright.operators import ledger

    return ledger.numbered(t.part.select("p_partkey"), "p_partkey", "P", start=42, width=6).select("p_partkey", "code")


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN len(a) <= 5 THEN a ELSE list_transform([0,1,2,3,4], lambda i: a[CAST(floor(i * (len(a) - 1) / 4.0) AS INT) + 1]) END AS picked FROM l
""")
def w8_even_sample(t: Tables) -> DataFrame:
    lists = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return lists.select("o_custkey", selection.spread(F.col("a"), 5).alias("picked"))


@query("""
WITH n AS (SELECT count(*) AS total FROM part), r AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part),
x AS (SELECT r.*, total - 75 AS rest, i - 75 AS j FROM r, n),
t AS (SELECT *, CASE WHEN j < rest // 3 THEN 0 WHEN j < rest * 2 // 3 THEN 1 ELSE 2 END AS g FROM x WHERE j >= 0),
h AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sha256(CAST(p_partkey AS VARCHAR)), CAST(p_partkey AS VARCHAR)) AS k FROM t)
SELECT p_partkey, p_retailprice FROM x WHERE j < 0 UNION ALL
SELECT p_partkey, p_retailprice FROM h WHERE k <= 8 + CASE WHEN g < 1 THEN 1 ELSE 0 END
""")
def w9_stratified_selection(t: Tables) -> DataFrame:
    return selection.stratified(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], "p_partkey", 100)


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 200
""")
def o1_keyset_page(t: Tables) -> DataFrame:
    return selection.after_cursor(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], (400000.0, 10), 200)


@query("SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 250")
def o2_single_keyset(t: Tables) -> DataFrame:
    return selection.after_cursor(t.events.select("event_id", "user_id"), [("event_id", False)], (500,), 250)


@query("""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, user_id, event_type DESC LIMIT 100
""")
def o3_heap_top_k(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), F.asc("user_id"), F.desc("event_type")).limit(100)


@query()
def o4_pack_skipping(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", F.col("n_chars"), F.size(F.split("text", r"\s+")).cast("long").alias("n_words"))
    return selection.budget_skipping(rows, "source", ["doc_id"], {"n_chars": 60_000, "n_words": 8_000}, 60, firm="n_chars")


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS k, sum(n_chars) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (SELECT *, max(CASE WHEN k > 40 OR s > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS broken FROM r)
SELECT source, doc_id, n_chars FROM b WHERE broken = 0
""")
def o5_pack_until_misfit(t: Tables) -> DataFrame:
    return selection.budget_until(t.documents.select("source", "doc_id", "n_chars"), [F.asc("doc_id")], {"n_chars": 60_000}, 40, ["source"])


@query("""
WITH r AS (SELECT o_orderpriority, o_orderkey, CAST(1 + least(3, CAST(o_totalprice AS BIGINT) % 40 // 8) AS INT) AS cost FROM orders),
w AS (SELECT *, row_number() OVER q AS k, sum(cost) OVER q AS running_cost FROM r WINDOW q AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)),
b AS (SELECT *, max(CASE WHEN (k > 20 AND running_cost > 120) OR k > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS x FROM w)
SELECT o_orderpriority, o_orderkey, cost, CAST(running_cost AS BIGINT) AS running_cost FROM b WHERE x = 0
""")
def o6_complexity_pack(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", "o_orderkey", (F.bround("o_totalprice").cast("long") % 40).alias("evidence"))
    return selection.complexity_pack(rows, [F.asc("o_orderkey")], F.col("evidence"), 120, 20, 100, ["o_orderpriority"]).drop("evidence")


@query()
def o7_two_queue_pack(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", "n_chars", (F.col("doc_id") % 4 == 0).alias("exploring"))
    return selection.two_queues(rows, "source", ["doc_id"], "n_chars", "exploring", 50_000.0)


@query("""
WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
x AS (SELECT p_partkey, r, r > n - CAST(floor(n * 0.25) AS BIGINT) AS exploring FROM r, n)
SELECT p_partkey, exploring, row_number() OVER (PARTITION BY exploring ORDER BY CASE WHEN exploring THEN sha256(CAST(p_partkey AS VARCHAR)) END, r) AS turn FROM x
""")
def o8_exploration_split(t: Tables) -> DataFrame:
    return selection.exploration_order(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], "p_partkey").drop("p_retailprice")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, least(n, 8) AS c FROM g),
b AS (SELECT *, coalesce(sum(c) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT o_custkey, n, CAST(greatest(0, least(c, 300 - before)) AS BIGINT) AS granted FROM b WHERE greatest(0, least(c, 300 - before)) > 0
""")
def o9_scan_budget(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return selection.scan_budget(g, "o_custkey", [F.asc("o_custkey")], "n", 8, 300)


@query("""
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) <= 28)
""")
def o10_all_or_nothing(t: Tables) -> DataFrame:
    return selection.small_groups(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", 28)


@query()
def o11_first_fit_jobs(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return selection.first_fit_jobs(rows, "o_orderpriority", ["day"], "n", 880, 10)


@query("""
SELECT lane, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) JOIN
 (SELECT lane, row_number() OVER (ORDER BY lane) AS k FROM (SELECT unnest([1, 3, 4, 5, 6, 8, 9, 10]) AS lane)) USING (k)
""")
def o12_free_lanes(t: Tables) -> DataFrame:
    dealt = [(lane, row["o_orderkey"]) for lane, row in selection.free_lanes(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], {2, 7}, 10)]
    return t.spark.createDataFrame(dealt, "lane int, o_orderkey long")


@query("""
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE WHEN o_orderstatus IN ('O', 'P') THEN 0 ELSE 1 END, o_orderkey LIMIT 300
""")
def o13_active_first(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderstatus").orderBy(F.when(F.col("o_orderstatus").isin("O", "P"), 0).otherwise(1), "o_orderkey").limit(300)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 100")
def o14_case_insensitive_order(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").limit(100)


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
 CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def o15_precedence_first(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return selection.top_k(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [rank.asc(), F.asc("o_orderkey")], 1).drop("rank")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 10 = 0 AND n_chars % 2 = 0")
def f1_main_articles(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", "source", (F.col("doc_id") % 10).alias("ns"), (F.col("n_chars") % 2).alias("redirect"))
    return pages.filter(filters.main_articles()).select("doc_id", "source")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))
""")
def f2_safe_filter(t: Tables) -> DataFrame:
    asked = {"p_size": list(range(1, 11)), "text": "A", "unknown": 1, "p_brand": ""}
    return t.part.filter(filters.safe_filter(asked, ["p_size", "p_brand"], {"text": ["p_name", "p_type"]})).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 25")
def f3_sorted_page(t: Tables) -> DataFrame:
    return filters.page(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey", "c_acctbal"], descending=True, limit=50, offset=25, tie="c_custkey")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
""")
def f4_media_search(t: Tables) -> DataFrame:
    bridges = [(t.lineitem.filter("l_returnflag = 'R'"), "o_orderkey", "l_orderkey"), (t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), "o_custkey", "c_custkey")]
    return filters.searched(t.orders, {"o_orderstatus": ["F", "O"], "o_orderpriority": []}, bridges).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '1-URGENT') IS NULL OR nullif(o_orderpriority, '1-URGENT') NOT IN ('2-HIGH', '5-LOW')")
def f5_null_tolerant_not_in(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return rows.filter(filters.not_in("p", ["2-HIGH", "5-LOW"])).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src3')")
def f6_access_predicate(t: Tables) -> DataFrame:
    test = filters.visible("source", {"staff": False, "reader": True}, {"src1": "staff", "src2": "reader", "src3": "owner"})
    return t.documents.filter(test).select("doc_id")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND (nullif(toxic, 2) IS NULL OR toxic = 0)")
def f7_public_rows(t: Tables) -> DataFrame:
    return t.labels.filter(filters.public_row({"quality": 1}, ["toxic"])).select("doc_id")


@query("""
SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
""")
def f8_scope_with_bridges(t: Tables) -> DataFrame:
    bridges = [(t.orders.filter("o_totalprice > 400000"), "c_custkey", "o_custkey"), (t.nation.filter("n_regionkey = 1"), "c_nationkey", "n_nationkey")]
    return filters.in_scope(t.customer, "c_custkey", F.col("c_mktsegment") == "BUILDING", bridges).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name >= 're' AND p_name < 're' || chr(65535) AND p_name > 'red bolt'")
def f9_prefix_probe(t: Tables) -> DataFrame:
    return t.part.filter(filters.prefix_range("p_name", "re", "red bolt")).select("p_partkey", "p_name")


@query("""
WITH x AS (SELECT p_partkey, trim(regexp_replace(lower(replace(p_type || ' ' || p_name, '_', ' ')), '\\s+', ' ', 'g')) AS s FROM part)
SELECT p_partkey FROM x WHERE length(s) > 0 AND length(s) < 256 AND NOT regexp_matches(s,
 '^(wikipedia |articles |all wikipedia|use |cs1 |webarchive |pages |short description|good articles|featured articles|template |maintenance |tracking |births |deaths |villages |cities |towns |populated places )')
 AND NOT contains(' ' || s || ' ', ' wikidata ') AND NOT contains(' ' || s || ' ', ' wikipedia ')
""")
def f10_topic_categories(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("title"))
    return rows.filter(filters.topic_category("title")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND NOT (o_orderpriority = '5-LOW')")
def f11_export_gate(t: Tables) -> DataFrame:
    gate = filters.export_gate(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000, F.col("o_orderpriority") == "5-LOW")
    return t.orders.filter(gate).select("o_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') <= '1995-01-01') THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def f12_due_retries(t: Tables) -> DataFrame:
    retries = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("due"))
    return filters.reopen_due(t.orders.select("o_orderkey", "o_orderstatus"), retries, "o_orderkey", "1995-01-01", "o_orderstatus", "due")


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'eau')")
def f13_accent_insensitive(t: Tables) -> DataFrame:
    from tidewright.functions import text as T

    return t.documents.filter(T.contains_plain("text", "EAU")).select("doc_id")


@query("""
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'bonjour' WHEN lang = 'en' THEN 'hello' END AS text,
 CASE WHEN lang = 'fr' THEN 'base' WHEN lang = 'en' THEN 'fallback' ELSE 'missing' END AS status FROM documents
""")
def f14_locale_fallback(t: Tables) -> DataFrame:
    from tidewright.functions import text as T

    words = F.when(F.col("lang") == "fr", F.create_map(F.lit("fr"), F.lit("bonjour"), F.lit("en"), F.lit("hello"))).when(F.col("lang") == "en", F.create_map(F.lit("en"), F.lit("hello")))
    words = F.coalesce(words, F.create_map().cast("map<string,string>"))
    return t.documents.select("doc_id", T.in_locale(words, "fr-CA").alias("x")).select("doc_id", "x.*")


@query("""
SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'o_orderpriority' END], lambda x: x IS NOT NULL) AS errors FROM orders
""")
def f15_value_errors(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", filters.value_errors({"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).alias("errors"))


@query("""
WITH x AS (SELECT page_id, 'Q' || CAST(page_id AS VARCHAR) AS q, 'concept' || CAST(page_id % 7 AS VARCHAR) AS c FROM pages)
SELECT page_id, regexp_full_match(q, 'Q[1-9][0-9]*') AS is_entity, regexp_full_match(c, 'concept[1-9][0-9]*') AS is_concept FROM x
""")
def f16_id_guards(t: Tables) -> DataFrame:
    q, c = F.concat(F.lit("Q"), F.col("page_id")), F.concat(F.lit("concept"), F.col("page_id") % 7)
    return t.pages.select("page_id", q.rlike("^Q[1-9][0-9]*$").alias("is_entity"), c.rlike("^concept[1-9][0-9]*$").alias("is_concept"))


@query("""
WITH f AS (SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))
SELECT c_custkey, c_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_custkey LIMIT 40
""")
def f17_search_with_count(t: Tables) -> DataFrame:
    found = t.customer.filter(filters.safe_filter({"q": "1"}, [], {"q": ["c_name"]})).join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    total = found.count()
    page = filters.page(found.select("c_custkey", "c_name"), "c_custkey", ["c_custkey"], limit=40)
    return page.withColumn("total", F.lit(total).cast("long"))


@query("""
WITH m AS (SELECT doc_id, quality, CASE WHEN quality = 1 OR toxic = 0 THEN 'NONE' WHEN doc_id % 5 = 0 THEN 'HIDE' WHEN doc_id % 2 = 0 THEN 'LABEL_ONLY' ELSE 'PLACEHOLDER' END AS mode FROM labels)
SELECT doc_id, mode, CASE WHEN mode = 'PLACEHOLDER' THEN NULL ELSE quality END AS quality FROM m WHERE mode <> 'HIDE'
""")
def f18_redaction(t: Tables) -> DataFrame:
    mode = filters.redaction(F.col("toxic") == 1, F.col("quality") == 1, F.col("doc_id") % 2 == 0, F.col("doc_id") % 5 == 0)
    return filters.masked(t.labels.select("doc_id", "quality", mode.alias("mode")), "mode", {"PLACEHOLDER": ["quality"]})
