"""Queries of ledgers and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import ledger
from tidewright.plans.base import Tables, query


EVENTS = ("queue", "select", "queue", "partial", "retry", "hold", "reject", "cancel", "enrich")


def _events(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, EVENTS)), (F.col("event_id") % len(EVENTS) + 1).cast("int"))
    return t.events.select("user_id", "event_id", name.alias("event"))


def _lifecycle() -> str:
    """The fold as a recursive query: one event of every key a step."""
    moves = " ".join(f"WHEN state = '{a}' AND event = '{e}' THEN '{b}'" for (a, e), b in ledger.TRANSITIONS.items())
    return f"""
    WITH RECURSIVE e AS (SELECT user_id, {list(EVENTS)}[event_id % {len(EVENTS)} + 1] AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), n AS (SELECT user_id, max(k) AS n FROM e GROUP BY 1),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 'PENDING' AS state, 0 AS applied, 0 AS refused FROM n UNION ALL
     SELECT f.user_id, e.k, coalesce(CASE {moves} END, state), applied + CASE WHEN CASE {moves} END IS NULL THEN 0 ELSE 1 END, refused + CASE WHEN CASE {moves} END IS NULL THEN 1 ELSE 0 END FROM f JOIN e ON f.user_id = e.user_id AND e.k = f.k + 1)
    SELECT f.user_id, state, applied, refused FROM f JOIN n ON f.user_id = n.user_id AND f.k = n.n
    """


@query(_lifecycle())
def t1_candidate_lifecycle(t: Tables) -> DataFrame:
    return ledger.folded_state(_events(t), "user_id", "event_id", "event")


@query("""
WITH c AS (SELECT conv_id || '-' || turn AS job, conv_id, text FROM conversations), old AS (SELECT job, sha256(text) AS digest FROM c WHERE conv_id % 2 = 0),
new AS (SELECT job, sha256(CASE WHEN conv_id % 3 = 0 THEN text || '!' ELSE text END) AS digest FROM c)
SELECT new.job, new.digest, CASE WHEN old.job IS NULL THEN 'NEW' WHEN old.digest = new.digest THEN 'ALREADY_IMPORTED' ELSE 'CONFLICT' END AS outcome
FROM new LEFT JOIN old USING (job)
""")
def t2_receipts(t: Tables) -> DataFrame:
    replies = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("job"), "conv_id", "text")
    old = replies.filter("conv_id % 2 = 0").select("job", F.sha2("text", 256).alias("digest"))
    new = replies.select("job", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return ledger.receipts(new, old, "job", "text").drop("text")


@query("""
WITH f AS (SELECT l_orderkey AS k, l_quantity > 45 AS bad FROM lineitem), p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 7 = 0 THEN 'PARTIAL' ELSE 'DONE' END AS c FROM orders),
g AS (SELECT p.k, c, count(*) FILTER (NOT bad) AS facts, count(*) FILTER (bad) AS errors FROM p LEFT JOIN f ON p.k = f.k GROUP BY ALL)
SELECT k AS page, facts, errors, CASE WHEN c = 'FAILED' THEN 'FAILED' WHEN errors > 0 OR c = 'PARTIAL' THEN 'PARTIAL' WHEN facts > 0 THEN 'ENRICHED' ELSE 'NO_FACT' END AS outcome FROM g
""")
def t3_t4_quarantine_and_outcome(t: Tables) -> DataFrame:
    valid, invalid = ledger.quarantined(t.lineitem.select(F.col("l_orderkey").alias("page"), "l_quantity"), F.when(F.col("l_quantity") > 45, "quantity"))
    state = F.when(F.col("o_orderkey") % 11 == 0, "FAILED").when(F.col("o_orderkey") % 7 == 0, "PARTIAL").otherwise("DONE")
    pages = t.orders.select(F.col("o_orderkey").alias("page"), state.alias("coverage"))
    return ledger.page_outcomes(pages, valid, invalid, "page", "coverage")


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 10 = 0 AND event_id > 0 THEN event_id - 5 END AS replaces FROM events)
SELECT event_id, CASE WHEN event_id IN (SELECT replaces FROM r WHERE replaces IS NOT NULL) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM r
""")
def t5_supersession(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when((F.col("event_id") % 10 == 0) & (F.col("event_id") > 0), F.col("event_id") - 5).alias("replaces"))
    return ledger.superseded(rows, "event_id", "replaces").drop("replaces")


@query("""
WITH done AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS c FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
asked AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS w FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT o_custkey FROM asked JOIN done USING (o_custkey) WHERE list_has_all(c, w)
""")
def t6_coverage_reuse(t: Tables) -> DataFrame:
    lists = lambda test, name: t.orders.filter(test).groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias(name))
    return ledger.reusable(lists("o_orderkey % 2 = 1", "wanted"), lists("o_orderkey % 2 = 0", "covered"), ["o_custkey"], "wanted", "covered").select("o_custkey")


@query("""
SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 3 = 0 GROUP BY 1 UNION ALL
SELECT p_brand, min(p_partkey) FROM part WHERE p_partkey % 3 <> 0 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 3 = 0) GROUP BY 1
""")
def t7_claim_accumulation(t: Tables) -> DataFrame:
    stored = t.part.filter("p_partkey % 3 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    return ledger.accumulated(stored, t.part.filter("p_partkey % 3 <> 0").select("p_brand", "p_partkey"), "p_brand")


@query("""
WITH d AS (SELECT c_custkey, 'APPROVE' AS decision, CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 0)
SELECT c.c_custkey, c.c_mktsegment, coalesce(decision, 'HOLD') AS decision, CASE WHEN d.c_custkey IS NOT NULL AND seg <> c.c_mktsegment THEN ['c_mktsegment'] ELSE [] END AS violations
FROM customer c LEFT JOIN d ON c.c_custkey = d.c_custkey
""")
def t8_review_merge(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_mktsegment")
    seg = F.when(F.col("c_custkey") % 4 == 0, "X").otherwise(F.col("c_mktsegment"))
    decisions = base.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("APPROVE").alias("decision"), seg.alias("c_mktsegment"))
    return ledger.overlaid(base, decisions, "c_custkey", "decision", ["c_mktsegment"])


@query("""
WITH o AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'APPROVE' ELSE 'REJECT' END AS d FROM labels WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'HOLD' WHEN toxic = 0 THEN 'APPROVE' ELSE 'REJECT' END AS decision FROM labels)
SELECT n.doc_id, decision, CASE WHEN decision = 'HOLD' THEN 'NOT_STORED' WHEN d IS NULL THEN 'STORED' WHEN d = decision THEN 'UNCHANGED' ELSE 'CONFLICT' END AS outcome FROM n LEFT JOIN o USING (doc_id)
""")
def t9_decision_apply(t: Tables) -> DataFrame:
    old = t.labels.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("quality") == 1, "APPROVE").otherwise("REJECT").alias("decision"))
    new = t.labels.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "HOLD").when(F.col("toxic") == 0, "APPROVE").otherwise("REJECT").alias("decision"))
    return ledger.applied_decisions(old, new, "doc_id", "decision")


@query("""
WITH i AS (SELECT p_partkey AS k, p_size AS priority, p_size % 4 AS links, ['PENDING', 'DEFERRED', 'STALE', 'QUEUED'][p_partkey % 4 + 1] AS state, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS task FROM part WHERE p_partkey % 5 <> 0),
s AS (SELECT p_partkey AS k, 50 - p_size AS p, p_size % 2 AS l FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT coalesce(i.k, s.k) AS k, i.k IS NULL AS is_new, s.k IS NOT NULL AND (state IN ('PENDING', 'DEFERRED') OR (state = 'STALE' AND task IS NULL)) AS movable, * EXCLUDE (k) FROM i FULL JOIN s ON i.k = s.k)
SELECT k, CASE WHEN is_new OR movable THEN p ELSE priority END AS priority, CASE WHEN is_new OR movable THEN l ELSE links END AS links,
CASE WHEN is_new THEN 'PENDING' WHEN movable THEN CASE WHEN p < 15 AND l = 0 THEN 'DEFERRED' ELSE 'PENDING' END ELSE state END AS state, task FROM b
""")
def t10_index_refresh(t: Tables) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ("PENDING", "DEFERRED", "STALE", "QUEUED"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    index = t.part.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("priority"), (F.col("p_size") % 4).alias("links"), states.alias("state"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).alias("task"))
    seen = t.part.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), (50 - F.col("p_size")).alias("priority"), (F.col("p_size") % 2).alias("links"))
    return ledger.refreshed_index(index, seen, "k")


@query("""
WITH f AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), a AS (SELECT c_custkey AS k, c_custkey % 3 AS attempts, '2020-01-01T00:00:00' AS next_retry_utc FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.k, f.k) AS k, coalesce(attempts, 0) + coalesce(n, 0) AS attempts, CASE WHEN n IS NOT NULL THEN '2024-01-01T01:00:00' ELSE next_retry_utc END AS next_retry_utc FROM a FULL JOIN f ON a.k = f.k
""")
def t12_retry_rows(t: Tables) -> DataFrame:
    failures = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    attempts = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("attempts"), F.lit("2020-01-01T00:00:00").alias("next_retry_utc"))
    return ledger.retried(failures, attempts, "k", "2024-01-01T00:00:00", 3600)


@query("""
WITH e AS (SELECT conv_id, turn, sha256(text) AS own FROM conversations), c AS (SELECT *, CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN 'broken' ELSE coalesce(lag(own) OVER w, repeat('0', 64)) END AS previous FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT *, lag(own) OVER w AS b, lag(turn) OVER w AS s FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, previous, own FROM v WHERE previous <> coalesce(b, repeat('0', 64)) OR (s IS NOT NULL AND turn <> s + 1)
""")
def w7_t13_chain_breaks(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    own = t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("own"))
    link = F.coalesce(F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("0" * 64))
    chained = own.withColumn("previous", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 1), "broken").otherwise(link))
    return ledger.chain_breaks(chained, "conv_id", "turn", "previous", "own").select("conv_id", "turn", "previous", "own")


@query("""
SELECT 'customer_without_order' AS problem, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order_without_line', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def t15_recovery_report(t: Tables) -> DataFrame:
    k = lambda df, c: df.select(F.col(c).alias("k"))
    return ledger.orphans({"customer_without_order": (k(t.customer, "c_custkey"), k(t.orders, "o_custkey"), "k"), "order_without_line": (k(t.orders, "o_orderkey"), k(t.lineitem, "l_orderkey"), "k")})


@query("""
WITH s AS (SELECT p_partkey, p_type AS c FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN upper(p_type) || '*' ELSE p_type END AS content FROM part)
SELECT i.p_partkey, content, CASE WHEN c IS NULL THEN 'NEW' WHEN c = content THEN 'SAME' ELSE 'CHANGED' END AS status FROM i LEFT JOIN s USING (p_partkey)
""")
def t16_reviewed_definitions(t: Tables) -> DataFrame:
    stored = t.part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("content"))
    content = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.upper("p_type"), F.lit("*"))).otherwise(F.col("p_type"))
    return ledger.definitions(stored, t.part.select("p_partkey", content.alias("content")), "p_partkey", "content")


@query("""
WITH q AS (SELECT c_custkey AS k, c_acctbal AS score, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey END AS qid FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT o_custkey AS k, max(o_totalprice) AS s, max('O' || o_orderkey) AS o FROM orders GROUP BY 1)
SELECT coalesce(q.k, n.k) AS k, coalesce(greatest(score, s), 0) AS score, coalesce(qid, o) AS qid FROM q FULL JOIN n ON q.k = n.k
""")
def t20_queue_sync(t: Tables) -> DataFrame:
    queue = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Q"), "c_custkey")).alias("qid"))
    catalogue = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("score"), F.concat(F.lit("O"), "o_orderkey").alias("qid"))
    return ledger.synced(queue, catalogue, "k", "score", "qid")


@query("""
WITH p AS (SELECT n_regionkey AS island, count(*) FILTER (n_nationkey % 5 = 0) AS n, min(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) AS one, min(n_name) AS a FROM nation GROUP BY 1)
SELECT island, CASE WHEN island = 2 THEN 'CHOSEN' WHEN n = 1 THEN one WHEN n = 0 THEN a END AS holder, CASE WHEN island = 2 THEN 'OVERRIDE' WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'LIVE' ELSE 'SNAPSHOT' END AS status FROM p
""")
def g10_island_authority(t: Tables) -> DataFrame:
    claims = t.nation.select(F.col("n_regionkey").alias("island"), F.col("n_name").alias("holder"), (F.col("n_nationkey") % 5 == 0).alias("live"))
    return ledger.authorities(claims, "island", "holder", "live", t.spark.createDataFrame([(2, "CHOSEN")], "island int, holder string"))


@query("""
WITH s AS (SELECT doc_id AS k, n_chars AS r FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS k, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS r FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(s.k, n.k) AS k, coalesce(n.r, s.r) AS revision, CASE WHEN s.k IS NULL THEN 'NEW' WHEN n.k IS NULL THEN 'GONE' WHEN s.r = n.r THEN 'KEPT' ELSE 'RESET' END AS action FROM s FULL JOIN n ON s.k = n.k
""")
def g9_seed_sync(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("k"), F.col("n_chars").alias("revision"))
    now = d.filter("k % 4 <> 0").withColumn("revision", F.col("revision") + F.when(F.col("k") % 10 == 1, 1).otherwise(0))
    return ledger.resynced_seeds(d.filter("k % 3 <> 0"), now, "k", "revision")


@query("SELECT lang AS k, 'documents' AS origin FROM documents UNION ALL SELECT role, 'conversations' FROM conversations")
def u1_union_all(t: Tables) -> DataFrame:
    return t.documents.select(F.col("lang").alias("k"), F.lit("documents").alias("origin")).unionByName(t.conversations.select(F.col("role").alias("k"), F.lit("conversations").alias("origin")))


@query("SELECT o_orderpriority AS v FROM orders UNION SELECT p_brand FROM part")
def u2_set_union(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("v")).unionByName(t.part.select(F.col("p_brand").alias("v"))).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def u3_insert_or_ignore(t: Tables) -> DataFrame:
    stored = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k")).distinct()
    return ledger.accumulated(stored, t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u4_j14_difference(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u5_unanswered(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id").distinct()


@query("""
SELECT p_partkey, 'removed' AS side FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'added' FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 = 0
""")
def u6_j27_version_difference(t: Tables) -> DataFrame:
    a, b = t.part.filter("p_partkey % 2 = 0").select("p_partkey"), t.part.filter("p_partkey % 3 = 0").select("p_partkey")
    return a.join(b, "p_partkey", "left_anti").withColumn("side", F.lit("removed")).unionByName(b.join(a, "p_partkey", "left_anti").withColumn("side", F.lit("added")))


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS outside, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) = 0 AS is_subset")
def u7_subset_assertion(t: Tables) -> DataFrame:
    outside = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    return outside.agg(F.count(F.lit(1)).alias("outside"), (F.count(F.lit(1)) == 0).alias("is_subset"))


@query("""
WITH p AS (SELECT lang, count(*) AS target, count(l.doc_id) AS audited FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1) SELECT lang, target, audited, target - audited AS pending FROM p
""")
def u8_pending_with_counts(t: Tables) -> DataFrame:
    marked = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("a")), "doc_id", "left")
    return marked.groupBy("lang").agg(F.count(F.lit(1)).alias("target"), F.count("a").alias("audited"), F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("pending"))
