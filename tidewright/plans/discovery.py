"""Queries of joins and expansion on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import graph, joins
from tidewright.plans.base import Tables, query


@query("""
WITH j AS (SELECT c_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT c_custkey, o_orderkey, o_orderstatus FROM j WHERE k <= 25 AND o_orderstatus <> 'P'
""")
def j1_entity_pages(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.pages_of_entities(t.customer.select("c_custkey"), pages, "c_custkey", "o_orderkey", F.col("o_orderstatus") != "P")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2_page_entity(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("""
SELECT a.s_suppkey AS anchor, l_linenumber AS relation, 'in' AS direction, l_orderkey AS other FROM supplier a JOIN lineitem ON l_partkey = a.s_suppkey WHERE l_linenumber IN (1, 2)
UNION ALL SELECT a.s_suppkey, l_linenumber, 'out', l_partkey FROM supplier a JOIN lineitem ON l_orderkey = a.s_suppkey WHERE l_linenumber IN (3)
""")
def j3_graph_neighbours(t: Tables) -> DataFrame:
    return joins.neighbours(t.supplier, t.lineitem, "s_suppkey", "l_orderkey", "l_linenumber", "l_partkey", [1, 2], [3])


@query("""
WITH d AS (SELECT s_suppkey AS concept, l_orderkey AS page, 100 AS priority, 'QID' AS route FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
g AS (SELECT s_suppkey, l_orderkey, 75, 'GRAPH' FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber = 2)
SELECT concept, page, max(priority) AS priority, list_sort(list(DISTINCT route)) AS routes FROM (SELECT * FROM d UNION ALL SELECT * FROM g) GROUP BY 1, 2
""")
def j4_a6_discovery_routes(t: Tables) -> DataFrame:
    line = t.supplier.select(F.col("s_suppkey").alias("l_suppkey")).join(t.lineitem, "l_suppkey")
    route = lambda n, p, name: line.filter(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("concept"), F.col("l_orderkey").alias("page"), F.lit(p).alias("priority"), F.lit(name).alias("route"))
    both = route(1, 100, "QID").unionByName(route(2, 75, "GRAPH"))
    return both.groupBy("concept", "page").agg(F.max("priority").alias("priority"), F.sort_array(F.collect_set("route")).alias("routes"))


@query("""
WITH a AS (SELECT DISTINCT left(p_name, 8) AS alias FROM part UNION SELECT 'P'), j AS (SELECT alias, p_name, row_number() OVER (PARTITION BY alias ORDER BY p_name) AS k FROM a JOIN part ON p_name >= alias AND p_name < alias || chr(65535))
SELECT alias, p_name FROM j WHERE k <= 20
""")
def j5_prefix_range_join(t: Tables) -> DataFrame:
    aliases = t.part.select(F.substring("p_name", 1, 8).alias("alias")).union(t.spark.createDataFrame([("P",)], "alias string")).distinct()
    return joins.prefix_join(aliases, t.part.select("p_name"), "alias", "p_name", most_per_alias=20)


@query("""
SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 300
""")
def j6_category_members(t: Tables) -> DataFrame:
    """A page of 300 by key, with what is known of its members; the page is the operator's limit."""
    first = t.orders.select("o_orderkey", "o_custkey").filter("o_orderkey > 100").orderBy("o_orderkey").limit(300)
    return joins.looked_up(first, [(t.customer, "o_custkey", "c_custkey", ["c_name", "c_nationkey"], "left"), (t.nation, "c_nationkey", "n_nationkey", ["n_name"], "left")]).drop("c_nationkey")


@query("SELECT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey")
def j7_category_labels(t: Tables) -> DataFrame:
    return joins.looked_up(t.lineitem.select("l_orderkey", "l_partkey"), [(t.part, "l_partkey", "p_partkey", ["p_brand"], "inner"), (t.orders, "l_orderkey", "o_orderkey", ["o_custkey"], "inner")]).select("o_custkey", "p_brand")


@query("""
SELECT DISTINCT l_orderkey AS source, s_suppkey AS page FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_nationkey = p_size % 25 AND s_suppkey % 3 = l_linenumber % 3 WHERE l_orderkey <> s_suppkey
""")
def j8_resolved_links(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target_id"), (F.col("l_linenumber") % 3).cast("long").alias("ns"))
    targets = t.part.select(F.col("p_partkey").alias("target_id"), (F.col("p_size") % 25).alias("title"))
    pages = t.supplier.select((F.col("s_suppkey") % 3).alias("ns"), F.col("s_nationkey").alias("title"), F.col("s_suppkey").alias("page"))
    return joins.resolved_links(links, targets, pages)


@query("SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def j9_link_profile(t: Tables) -> DataFrame:
    return joins.looked_up(t.lineitem.select("l_orderkey", "l_partkey"), [(t.part, "l_partkey", "p_partkey", ["p_name"], "inner")]).select("l_orderkey", "p_name")


@query("""
SELECT o_orderkey AS source, o_orderpriority AS category, o_orderstatus AS kind FROM orders UNION ALL
SELECT l_orderkey, CASE WHEN p_size = 14 THEN p_type END, l_returnflag FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 2 = 0
""")
def j10_unified_categories(t: Tables) -> DataFrame:
    legacy = t.orders.select(F.col("o_orderkey").alias("source"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("kind"))
    by_id = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind"))
    targets = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("target_id"), F.col("p_size").alias("ns"), F.col("p_type").alias("title"))
    return joins.unified_links(legacy, by_id, targets)


@query("SELECT a.user_id, a.event_type, count(*) AS n FROM events a JOIN (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events) b ON a.user_id = b.user_id AND a.event_type = b.event_type AND CAST(a.ts AS DATE) = b.d GROUP BY 1, 2")
def j11_candidate_evidence(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.to_date("ts").alias("d"))
    return e.join(e.distinct(), ["user_id", "event_type", "d"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE k <= 5
""")
def j12_evidence_titles(t: Tables) -> DataFrame:
    both = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")
    return joins.first_per_key(both, ["c_custkey"], [F.asc_nulls_last("o_orderkey")], 5)


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j13_semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0")
def j15_semi_chain(t: Tables) -> DataFrame:
    steps = [(t.lineitem, "l_orderkey", "l_suppkey"), (t.supplier.filter("s_acctbal < 0"), "s_suppkey", None)]
    return joins.semi_chain(t.orders, "o_orderkey", steps).select("o_custkey").distinct()


@query("""
WITH p AS (SELECT p_partkey, l_suppkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey),
b AS (SELECT l_suppkey, count(*) AS n FROM p WHERE l_suppkey IS NOT NULL GROUP BY 1), g AS (SELECT p_partkey, count(p.l_suppkey) AS n_right, coalesce(max(n), 0) AS n_left_of_right FROM p LEFT JOIN b ON p.l_suppkey = b.l_suppkey GROUP BY 1)
SELECT *, CASE WHEN n_right = 0 THEN 'NO' WHEN n_right > 1 OR n_left_of_right > 1 THEN 'AMBIGUOUS' ELSE 'SINGLE' END AS class FROM g
""")
def j16_cardinality_classes(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    return joins.cardinality_classes(t.part.select("p_partkey").join(links, "p_partkey", "left"), "p_partkey", "l_suppkey")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def j17_unmatched(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part.filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_partkey").distinct()


@query("""
WITH e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation WHERE n_regionkey <> n_nationkey UNION SELECT DISTINCT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 3) % 25),
p AS (SELECT a AS s, b AS t, 1 AS h FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b)
SELECT s AS "start", t AS "end", min(h) AS hops FROM p GROUP BY 1, 2
""")
def j18_two_hop_paths(t: Tables) -> DataFrame:
    e = t.nation.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b")).union(t.nation.select("n_nationkey", ((F.col("n_nationkey") * 7 + 3) % 25)))
    return joins.paths(e, "a", "b")


@query("""
WITH e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation WHERE n_regionkey <> n_nationkey)
SELECT a AS concept, s_suppkey AS page FROM (SELECT a, s_suppkey, row_number() OVER (PARTITION BY a ORDER BY s_suppkey) AS k FROM e JOIN supplier ON s_nationkey = b) WHERE k <= 12
""")
def j19_path_pages(t: Tables) -> DataFrame:
    e = t.nation.filter("n_regionkey <> n_nationkey").select(F.col("n_regionkey").alias("concept"), F.col("n_nationkey").alias("s_nationkey")).distinct()
    return joins.first_per_key(e.join(t.supplier, "s_nationkey").select("concept", F.col("s_suppkey").alias("page")), ["concept"], [F.asc("page")], 12)


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '?' ELSE p_name END AS n, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 3 <> 0)
SELECT part.p_partkey, p_name, p_size, list_filter([CASE WHEN p_name <> n THEN 'p_name' END, CASE WHEN p_size <> s THEN 'p_size' END], lambda x: x IS NOT NULL) AS mismatch FROM part JOIN r ON part.p_partkey = r.p_partkey
""")
def j20_identity_check(t: Tables) -> DataFrame:
    left = t.part.select("p_partkey", "p_name", "p_size")
    right = left.filter("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("p_name"), (F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(0)).alias("p_size"))
    return joins.identity_check(left, right, "p_partkey", ["p_name", "p_size"])


@query("SELECT l_orderkey, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def j21_link_inventory(t: Tables) -> DataFrame:
    steps = [(t.part, "l_partkey", "p_partkey", ["p_brand"], "inner"), (t.supplier, "l_suppkey", "s_suppkey", ["s_name"], "inner")]
    return joins.looked_up(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), steps).select("l_orderkey", "p_brand", "s_name")


@query("""
SELECT s_suppkey, count(DISTINCT l_orderkey) AS children, count(*) AS rows, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def j22_fan_out_inventory(t: Tables) -> DataFrame:
    lines = joins.looked_up(t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey"), [(t.orders, "l_orderkey", "o_orderkey", ["o_orderstatus"], "left")])
    return joins.fan_out(t.supplier, lines, "s_suppkey", "l_orderkey", "o_orderstatus", {"finished": "F", "open": "O"})


@query("SELECT a.conv_id, a.turn, a.role, length(b.text) AS reply_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def j23_line_anchors(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("reply_chars"))
    return t.conversations.select("conv_id", "turn", "role").join(lines, ["conv_id", "turn"])


@query("""
WITH m AS (SELECT p_partkey AS member, p_partkey * 40 AS a, p_partkey * 40 + p_size AS b FROM part) SELECT event_id, member FROM events JOIN m ON event_id BETWEEN a AND b
""")
def j24_interval_join(t: Tables) -> DataFrame:
    m = t.part.select(F.col("p_partkey").alias("member"), (F.col("p_partkey") * 40).alias("a"), (F.col("p_partkey") * 40 + F.col("p_size")).alias("b"))
    return joins.interval_join(t.events.select("event_id"), m, "event_id", "a", "b").select("event_id", "member")


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality, CASE WHEN d.doc_id IS NULL THEN 'left' WHEN l.doc_id IS NULL THEN 'right' END AS missing FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def j25_checked_zip(t: Tables) -> DataFrame:
    return joins.checked_zip(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"])


@query("SELECT c_custkey, count(o_orderkey) AS artifacts, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j26_versions(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("artifacts"), F.max("o_orderdate").alias("last_seen"))


_ACTIONS = """
WITH s AS (SELECT p_partkey AS k, p_name, p_size FROM part WHERE p_partkey % 4 <> 0), i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 3 <> 0),
c AS (SELECT coalesce(i.k, s.k) AS k, i.k AS ik, s.k AS sk, CASE WHEN i.k IS NOT NULL AND s.k IS NOT NULL THEN list_filter([CASE WHEN i.p_name <> s.p_name THEN 'p_name' END, CASE WHEN i.p_size <> s.p_size THEN 'p_size' END], lambda x: x IS NOT NULL) ELSE [] END AS changed FROM i FULL JOIN s ON i.k = s.k)
SELECT k, CASE WHEN sk IS NULL THEN 'NEW' WHEN ik IS NULL THEN 'MISSING' WHEN len(changed) > 0 THEN 'UPDATE' ELSE 'IGNORE' END AS action, changed, list_filter(changed, lambda x: x = 'p_size') AS protected_changed FROM c
"""


@query(_ACTIONS)
def j28_j32_row_actions(t: Tables) -> DataFrame:
    base = t.part.select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    incoming = base.filter("k % 3 <> 0").select("k", F.when(F.col("k") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("p_name"), (F.col("p_size") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("p_size"))
    return joins.row_actions(incoming, base.filter("k % 4 <> 0"), "k", ["p_name", "p_size"], ["p_size"])


@query("SELECT c_custkey AS page_id, c_name AS title, o_orderkey AS entity FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey) WHERE k <= 5")
def j29_adaptive_columns(t: Tables) -> DataFrame:
    pages = joins.by_alias(t.customer, {"page_id": ["id", "page", "C_CUSTKEY"], "title": ["name", "c_name"]})
    ids = joins.by_alias(t.orders, {"page_id": ["page", "o_custkey"], "entity": ["qid", "o_orderkey"]})
    return joins.first_per_key(pages.join(ids, "page_id"), ["page_id"], [F.asc("entity")], 5)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 OR p_partkey IS NULL THEN 'unknown entity' WHEN l_partkey % 7 = 0 THEN 'another id' END AS error FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def j30_description_lookup(t: Tables) -> DataFrame:
    """Lookup by number, checked by the text id: some lines carry another one, some parts aren't there."""
    text_id = F.concat(F.when(F.col("l_partkey") % 7 == 0, "P").otherwise("Q"), "l_partkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("number"), text_id.alias("qid"))
    parts = t.part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("number"), F.concat(F.lit("Q"), "p_partkey").alias("own"), "p_name")
    return joins.described(lines, parts, "number", "qid", "own", ["p_name"]).drop("number", "qid")


@query("""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS n, doc_id % 9 = 0 AS redirect FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, n_chars, coalesce(x.doc_id IS NOT NULL AND n_chars = n AND NOT redirect, false) AS usable FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id
""")
def j31_usable_flags(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    x = d.filter("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0)).alias("n_chars"), (F.col("doc_id") % 9 == 0).cast("int").alias("redirect"))
    return joins.usable_flags(d, x, "doc_id", ["n_chars"], "redirect")


@query("""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(replace(text, '_', ' ')), '[a-z0-9]+'), lambda w: length(w) >= 2) AS w FROM documents)
SELECT doc_id FROM d WHERE list_has_all(w, ['that', 'of']) OR contains(' ' || array_to_string(w, ' ') || ' ', ' that of ')
""")
def g1_title_search(t: Tables) -> DataFrame:
    return graph.title_search(graph.token_index(t.documents, "doc_id", "text"), "doc_id", ["that", "of"])


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 3 + o_orderkey) % 150 AS b FROM orders), s AS (SELECT a FROM e GROUP BY 1 HAVING count(*) <= 12), f AS (SELECT e.* FROM e JOIN s USING (a)),
d0 AS (SELECT n_nationkey AS root, CAST(n_nationkey AS BIGINT) AS node FROM nation), d1 AS (SELECT DISTINCT root, b AS node FROM d0 JOIN f ON node = a), n1 AS (SELECT * FROM d1 EXCEPT SELECT * FROM d0),
d2 AS (SELECT DISTINCT root, b AS node FROM n1 JOIN f ON node = a), n2 AS (SELECT * FROM d2 EXCEPT (SELECT * FROM d0 UNION SELECT * FROM n1))
SELECT root, node, 0 AS depth FROM d0 UNION ALL SELECT root, node, 1 FROM n1 UNION ALL SELECT root, node, 2 FROM n2
""")
def g2_category_expansion(t: Tables) -> DataFrame:
    e = t.orders.select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 150).alias("b"))
    return graph.breadth_first(t.nation.select(F.col("n_nationkey").cast("long").alias("n")), e, "n", "a", "b", depth=2, most_children=12)


@query("""
WITH s AS (SELECT s_suppkey AS seed FROM supplier), l AS (SELECT o_custkey AS source, o_orderkey AS page FROM orders), c AS (SELECT DISTINCT p_partkey AS page, p_brand || p_size AS category FROM part)
SELECT DISTINCT * FROM (SELECT seed, page, 'WIKILINK' AS kind FROM s JOIN l ON seed = source UNION ALL SELECT seed, b.page, 'SHARED_CATEGORY' FROM s JOIN c a ON a.page = seed JOIN c b ON a.category = b.category) WHERE seed <> page
""")
def g3_seed_expansion(t: Tables) -> DataFrame:
    links = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("page"))
    cats = t.part.select(F.col("p_partkey").alias("page"), F.concat("p_brand", "p_size").alias("category")).distinct()
    return graph.seed_expansion(t.supplier, links, cats, "s_suppkey")


@query()
def g4_best_first_crawl(t: Tables) -> DataFrame:
    """One crawl for each ten customers, so that its page budget reaches all of its seeds."""
    e = t.orders.select(F.col("o_custkey").alias("source"), ((F.col("o_orderkey") * 7) % 1500).alias("target"), (F.col("o_totalprice") % 35).alias("gain")).distinct()
    crawl = lambda c: F.floor((F.col(c) - 1) / 10).alias("g")
    seeds = t.customer.select(crawl("c_custkey"), F.col("c_custkey").alias("node"), F.lit(1000.0).alias("score"))
    near = e.select(crawl("source"), "source", "target", "gain")
    further = near.select("g", F.col("target").alias("source")).distinct().join(e, "source").select("g", "source", "target", "gain")
    e = near.unionByName(further).distinct()
    return graph.best_first("g", e, seeds, pages=60, links=20, depth=2)


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT c_custkey FROM customer LEFT JOIN n ON c_custkey = o_custkey WHERE coalesce(n, 0) < 12)
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN w ON o_custkey = c_custkey) WHERE k <= 3
""")
def g5_g6_weak_concept_recall(t: Tables) -> DataFrame:
    found = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    concepts = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return graph.weak_first(concepts, found, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], enough=12, per_concept=3).drop("o_totalprice")


@query("SELECT CAST(n_nationkey AS INT) AS child, CASE WHEN n_regionkey <> n_nationkey THEN n_regionkey END AS parent FROM nation")
def g7_hierarchy(t: Tables) -> DataFrame:
    return graph.tree_parents(t.nation.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("broader")), "child", "broader", t.nation, "n_nationkey")


@query("""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(replace(text, '_', ' ')), '[a-z0-9]+'), lambda w: length(w) >= 2) AS w FROM documents),
f AS (SELECT doc_id, 'de' AS term FROM d WHERE list_contains(w, 'der') UNION ALL SELECT doc_id, 'en' FROM d WHERE list_has_all(w, ['that', 'the']) OR contains(' ' || array_to_string(w, ' ') || ' ', ' that the ') UNION ALL SELECT doc_id, 'EXPLICIT' FROM labels WHERE toxic = 1)
SELECT doc_id, list_sort(list(DISTINCT term)) AS terms FROM f GROUP BY 1
""")
def g11_category_probe(t: Tables) -> DataFrame:
    return graph.category_probe(graph.token_index(t.documents, "doc_id", "text"), "doc_id", {"de": ["der"], "en": ["that", "the"]}, t.labels.filter("toxic = 1"))
