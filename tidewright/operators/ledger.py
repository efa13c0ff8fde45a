"""Ledgers as append-only tables: state folds, receipts, merges and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ranking import ranked

# Which state an event leads to, from which states.
TRANSITIONS = {
    ("PENDING", "queue"): "QUEUED_SELECTION",
    ("QUEUED_SELECTION", "select"): "SELECTED",
    ("QUEUED_SELECTION", "reject"): "REJECTED",
    ("QUEUED_SELECTION", "hold"): "HOLD",
    ("QUEUED_SELECTION", "cancel"): "PENDING",
    ("SELECTED", "queue"): "QUEUED_ENRICHMENT",
    ("QUEUED_ENRICHMENT", "enrich"): "ENRICHED",
    ("QUEUED_ENRICHMENT", "partial"): "PARTIAL",
    ("QUEUED_ENRICHMENT", "no_facts"): "NO_FACTS_REVIEW",
    ("QUEUED_ENRICHMENT", "no_claim"): "NO_RELEVANT_CLAIM",
    ("QUEUED_ENRICHMENT", "cancel"): "SELECTED",
    ("SELECTED", "block"): "SOURCE_BLOCKED",
    ("SELECTED", "oversize"): "OVERSIZE",
    ("HOLD", "retry"): "PENDING",
    ("REJECTED", "retry"): "PENDING",
    ("SOURCE_BLOCKED", "retry"): "SELECTED",
    ("OVERSIZE", "retry"): "SELECTED",
    ("PARTIAL", "retry"): "SELECTED",
    ("NO_FACTS_REVIEW", "retry"): "SELECTED",
    ("NO_RELEVANT_CLAIM", "retry"): "SELECTED",
}


def numbered(df: DataFrame, order: str, prefix: str, *, start: int = 1, width: int = 6, key: str = "code") -> DataFrame:
    """Gapless prefixed numbers in an order."""
    rows = ranked(df, [F.asc(order)], "_n")
    return rows.withColumn(key, F.concat(F.lit(prefix), F.lpad((F.col("_n") + start - 1).cast("string"), width, "0"))).drop("_n")


def folded_state(events: DataFrame, key: str, order: str, event: str, *, initial: str = "PENDING", transitions: dict | None = None) -> DataFrame:
    """(key, state, applied, refused): a key's events folded in order; events that don't fit are counted."""
    table = transitions or TRANSITIONS
    steps = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e"))))
    begin = F.struct(F.lit(initial).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def move(acc: Column, x: Column) -> Column:
        new = F.coalesce(*[F.when((acc["state"] == s) & (x["e"] == e), to) for (s, e), to in table.items()])
        return F.struct(F.coalesce(new, acc["state"]).alias("state"), (acc["applied"] + F.when(new.isNull(), 0).otherwise(1)).alias("applied"), (acc["refused"] + F.when(new.isNull(), 1).otherwise(0)).alias("refused"))

    return events.groupBy(key).agg(F.aggregate(steps, begin, move).alias("f")).select(key, "f.*")


def receipts(replies: DataFrame, stored: DataFrame, job: str, payload: str) -> DataFrame:
    """Replies with digest and outcome: NEW, ALREADY_IMPORTED (same content) or CONFLICT (another)."""
    old = stored.select(F.col(job).alias("_job"), F.col("digest").alias("_digest"))
    out = replies.withColumn("digest", F.sha2(F.col(payload).cast("binary"), 256)).join(old, F.col(job) == F.col("_job"), "left")
    return out.withColumn("outcome", F.when(F.col("_job").isNull(), "NEW").when(F.col("digest") == F.col("_digest"), "ALREADY_IMPORTED").otherwise("CONFLICT")).drop("_job", "_digest")


def quarantined(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid ones with the error."""
    marked = rows.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def page_outcomes(pages: DataFrame, valid: DataFrame, invalid: DataFrame, key: str, coverage: str) -> DataFrame:
    """(key, facts, errors, outcome): FAILED coverage, PARTIAL with errors, then by facts."""
    out = pages.join(valid.groupBy(key).agg(F.count(F.lit(1)).alias("facts")), key, "left").join(invalid.groupBy(key).agg(F.count(F.lit(1)).alias("errors")), key, "left")
    facts, errors = F.coalesce("facts", F.lit(0)), F.coalesce("errors", F.lit(0))
    outcome = F.when(F.col(coverage) == "FAILED", "FAILED").when((errors > 0) | (F.col(coverage) == "PARTIAL"), "PARTIAL").when(facts > 0, "ENRICHED").otherwise("NO_FACT")
    return out.select(key, facts.alias("facts"), errors.alias("errors"), outcome.alias("outcome"))


def superseded(rows: DataFrame, key: str, replaces: str) -> DataFrame:
    """Rows with ``status``: SUPERSEDED where another row replaces them, ACTIVE otherwise."""
    gone = rows.filter(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key)).distinct().withColumn("_g", F.lit(True))
    return rows.join(gone, key, "left").withColumn("status", F.when(F.coalesce("_g", F.lit(False)), "SUPERSEDED").otherwise("ACTIVE")).drop("_g")


def reusable(asked: DataFrame, results: DataFrame, keys: list[str], wanted: str, covered: str) -> DataFrame:
    """Asked rows whose concepts an earlier result of the same keys covers."""
    done = results.select(*keys, F.col(covered).alias("_c"))
    hit = asked.join(done, keys).filter(F.size(F.array_except(wanted, "_c")) == 0).select(*asked.columns).distinct()
    return hit


def accumulated(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows, and incoming ones of new keys (the first by all columns)."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    order = [F.asc_nulls_first(c) for c in fresh.columns]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return stored.unionByName(fresh.withColumn("_n", first).filter("_n = 1").drop("_n"))


def overlaid(baseline: DataFrame, decisions: DataFrame, key: str, value: str, frozen: list[str], default: str = "HOLD") -> DataFrame:
    """Baseline with decisions laid over; ``violations`` names frozen columns that a decision changes."""
    d = decisions.select(key, F.col(value).alias("_v"), *[F.col(c).alias(f"_{c}") for c in frozen], F.lit(True).alias("_there"))
    bad = F.array_compact(F.array(*[F.when(F.col("_there") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in frozen]))
    return baseline.join(d, key, "left").withColumn(value, F.coalesce("_v", F.lit(default))).withColumn("violations", F.when(F.col("_there"), bad).otherwise(F.array().cast("array<string>"))).drop("_v", "_there", *[f"_{c}" for c in frozen])


def applied_decisions(ledger: DataFrame, incoming: DataFrame, key: str, decision: str, stored: tuple[str, ...] = ("APPROVE", "REJECT")) -> DataFrame:
    """Incoming decisions with outcome: STORED, UNCHANGED, CONFLICT (a changed one) or NOT_STORED."""
    old = ledger.select(key, F.col(decision).alias("_d"))
    out = F.when(~F.col(decision).isin(*stored), "NOT_STORED").when(F.col("_d").isNull(), "STORED").when(F.col("_d") == F.col(decision), "UNCHANGED").otherwise("CONFLICT")
    return incoming.join(old, key, "left").withColumn("outcome", out).drop("_d")


def refreshed_index(index: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Review index after a new scan: new rows come in; PENDING, DEFERRED and unscheduled STALE ones are ranked anew.

    Both have key, priority and links; the index also state and task. DEFERRED is what scores under 15 without links.
    """
    s = seen.select(F.col(key).alias("_key"), F.col("priority").alias("_p"), F.col("links").alias("_l"))
    both = index.join(s, F.col(key) == F.col("_key"), "full")
    is_new = F.col(key).isNull()
    movable = F.col("_key").isNotNull() & (F.col("state").isin("PENDING", "DEFERRED") | ((F.col("state") == "STALE") & F.col("task").isNull()))
    ranked = F.when((F.col("_p") < 15) & (F.col("_l") == 0), "DEFERRED").otherwise("PENDING")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        F.when(is_new | movable, F.col("_p")).otherwise(F.col("priority")).alias("priority"),
        F.when(is_new | movable, F.col("_l")).otherwise(F.col("links")).alias("links"),
        F.when(is_new, "PENDING").when(movable, ranked).otherwise(F.col("state")).alias("state"),
        "task",
    )


def retried(failures: DataFrame, attempts: DataFrame, key: str, now: str, seconds: int) -> DataFrame:
    """Attempts with failures counted in and a deadline for what failed."""
    n = failures.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    due = F.date_format((F.to_timestamp(F.lit(now)).cast("long") + seconds).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return attempts.join(n, key, "full").select(key, (F.coalesce("attempts", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("attempts"), F.when(F.col("_n").isNotNull(), due).otherwise(F.col("next_retry_utc")).alias("next_retry_utc"))


def chain_breaks(events: DataFrame, chain: str, seq: str, previous: str, own: str) -> DataFrame:
    """Events whose previous hash isn't the hash of the event before, or whose numbers have a gap."""
    w = Window.partitionBy(chain).orderBy(seq)
    before, number = F.lag(own).over(w), F.lag(seq).over(w)
    return events.withColumn("_b", before).withColumn("_s", number).filter((~F.col(previous).eqNullSafe(F.coalesce("_b", F.lit("0" * 64)))) | (F.col("_s").isNotNull() & (F.col(seq) != F.col("_s") + 1))).drop("_b", "_s")


def orphans(parts: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """(problem, id): rows of each first table that the second lacks."""
    out = None
    for name, (left, right, key) in parts.items():
        found = left.join(right.select(key), key, "left_anti").select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("id"))
        out = found if out is None else out.unionByName(found)
    return out


def definitions(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming definitions with status NEW, SAME or CHANGED against the stored ones."""
    old = stored.select(key, F.col(content).alias("_c"))
    return incoming.join(old, key, "left").withColumn("status", F.when(F.col("_c").isNull(), "NEW").when(F.col("_c") == F.col(content), "SAME").otherwise("CHANGED")).drop("_c")


def synced(queue: DataFrame, catalogue: DataFrame, key: str, score: str, optional: str) -> DataFrame:
    """Queue after a copy from the catalogue: greatest score, and an optional value where there was none."""
    new = catalogue.groupBy(key).agg(F.max(score).alias("_s"), F.max(optional).alias("_o"))
    return queue.join(new, key, "full").select(key, F.coalesce(F.greatest(score, "_s"), F.lit(0)).alias(score), F.coalesce(optional, "_o").alias(optional))


def authorities(claims: DataFrame, island: str, holder: str, live: str, override: DataFrame | None = None) -> DataFrame:
    """(island, holder, status): the live holder; CONFLICT with several; an explicit choice goes first."""
    per = claims.groupBy(island).agg(F.sum(F.col(live).cast("int")).alias("n"), F.min(F.when(F.col(live), F.col(holder))).alias("one"), F.min(holder).alias("any"))
    out = per.select(island, F.when(F.col("n") == 1, F.col("one")).when(F.col("n") == 0, F.col("any")).alias(holder), F.when(F.col("n") > 1, "CONFLICT").when(F.col("n") == 1, "LIVE").otherwise("SNAPSHOT").alias("status"))
    if override is None:
        return out
    o = override.select(island, F.col(holder).alias("_h"))
    return out.join(o, island, "left").select(island, F.coalesce("_h", holder).alias(holder), F.when(F.col("_h").isNotNull(), "OVERRIDE").otherwise(F.col("status")).alias("status"))


def resynced_seeds(seeds: DataFrame, source: DataFrame, key: str, revision: str) -> DataFrame:
    """Seeds after a look at the source: NEW, RESET where the revision changed, KEPT otherwise; gone ones stay."""
    s = source.select(F.col(key).alias("_k"), F.col(revision).alias("_r"))
    both = seeds.join(s, F.col(key) == F.col("_k"), "full")
    action = F.when(F.col(key).isNull(), "NEW").when(F.col("_k").isNull(), "GONE").when(F.col(revision).eqNullSafe(F.col("_r")), "KEPT").otherwise("RESET")
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("_r", revision).alias(revision), action.alias("action"))


def append_only(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append: new keys only; a stored key with other values is an error, one with equal values is left out."""
    others = [c for c in stored.columns if c != key]
    both = incoming.join(stored.select(key, F.struct(*others).alias("_old")), key, "left")
    changed = both.filter(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.struct(*others))).select(key).limit(5).collect()
    if changed:
        raise ValueError(f"append only: {[r[0] for r in changed]} would change")
    return both.filter("_old is null").select(stored.columns).dropDuplicates([key])


def touched(stored: DataFrame, incoming: DataFrame, key: str, now: str, updated: str = "updated_at") -> DataFrame:
    """Rows after an update: changed and new ones carry ``now`` as their time, others keep theirs."""
    values = [c for c in stored.columns if c not in (key, updated)]
    old = stored.select(key, F.struct(*values).alias("_old"), F.col(updated).alias("_at"))
    new = incoming.select(key, F.struct(*values).alias("_new"))
    both = old.join(new, key, "full")
    take = F.coalesce("_new", "_old")
    same = F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("_old"))
    return both.select(key, *[take[c].alias(c) for c in values], F.when(same, F.col("_at")).otherwise(F.lit(now).cast(stored.schema[updated].dataType)).alias(updated))


# What a review's decisions make of a proposal.
DECISIONS = {"INCLUDE": "active", "HOLD": "proposed", "EXCLUDE": None}


def converted_decisions(decisions: DataFrame, proposals: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """(key, status, error): included proposals become active, held ones proposed, excluded ones have no status.

    A decision must name a proposal and repeat its identity columns; otherwise it has an error.
    """
    known = proposals.select(key, F.struct(*identity).alias("_is"))
    both = decisions.join(known, key, "left")
    status = F.coalesce(*[F.when(F.col("decision") == d, F.lit(s).cast("string")) for d, s in DECISIONS.items()])
    error = F.when(F.col("_is").isNull(), "unknown proposal").when(~F.col("_is").eqNullSafe(F.struct(*identity)), "another identity").when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
    return both.select(key, F.when(error.isNull(), status).alias("status"), error.alias("error"))


def handed_off(incoming: DataFrame, stored: DataFrame, contents: DataFrame, receipt: str, payload: str) -> DataFrame:
    """(receipt, digest, outcome, content): NEW hand-offs, a REPLAY (the same result again) or a CONFLICT.

    ``stored`` is (receipt, digest); ``contents`` (digest, content) are known contents. Equal contents are
    stored once: the content of a new digest is the least receipt that brings it.
    """
    rows = incoming.select(receipt, F.sha2(F.col(payload).cast("binary"), 256).alias("digest")).distinct()
    # Several payloads under one receipt: the least digest counts, the others are conflicts.
    first = rows.groupBy(receipt).agg(F.min("digest").alias("_first"))
    known = stored.select(receipt, F.col("digest").alias("_stored"))
    both = rows.join(first, receipt).join(known, receipt, "left").withColumn("_mine", F.coalesce("_stored", "_first"))
    outcome = F.when(F.col("digest") != F.col("_mine"), "CONFLICT").when(F.col("_stored").isNotNull(), "REPLAY").otherwise("NEW")
    judged = both.select(receipt, "digest", outcome.alias("outcome"))
    fresh = judged.filter("outcome = 'NEW'").groupBy("digest").agg(F.min(F.col(receipt).cast("string")).alias("_new"))
    out = judged.join(contents.select("digest", F.col("content").cast("string").alias("_known")), "digest", "left").join(fresh, "digest", "left")
    return out.select(receipt, "digest", "outcome", F.when(F.col("outcome") != "CONFLICT", F.coalesce("_known", "_new")).alias("content"))


def recovered_packs(found: DataFrame, registered: DataFrame, members: DataFrame, queue: DataFrame, source: str) -> DataFrame:
    """(pack_id, action, reason) for verified packs that no register knows: REGISTER, or REFUSE with the reason.

    Found: pack_id, source; members: pack_id, page_id; queue: page_id, state, pack_id. A pack is
    refused if it is of another source, or holds a page that the queue lacks, has in another state
    than PENDING or PACKED, or has in another pack.
    """
    lost = found.join(registered.select("pack_id"), "pack_id", "left_anti")
    held = members.join(lost.select("pack_id"), "pack_id", "left_semi").join(queue.select("page_id", "state", F.col("pack_id").alias("_in")), "page_id", "left")
    fits = F.coalesce((F.col("state") == "PENDING") | (F.col("state") == "PACKED") & (F.col("_in") == F.col("pack_id")), F.lit(False))
    bad = held.groupBy("pack_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(~fits, F.col("page_id"))).alias("_page"))
    reason = F.when(F.col("source") != source, "another source").when(F.col("_n").isNull(), "no members").when(F.col("_page").isNotNull(), F.concat(F.lit("page "), F.col("_page"), F.lit(" doesn't fit the queue")))
    return lost.join(bad, "pack_id", "left").select("pack_id", F.when(reason.isNull(), "REGISTER").otherwise("REFUSE").alias("action"), reason.alias("reason"))


def reviewed_import(incoming: DataFrame, files: DataFrame, stored: DataFrame, key: str, definition: str, file: str, cost: str, budget: int) -> DataFrame:
    """(key, file, outcome) of definitions from reviewed files: ALREADY_IMPORTED where the file's hash is known,
    SAME or CONFLICT against the stored definition, OVER_BUDGET where the new ones of a file cost more than the
    budget together, and NEW otherwise. Several definitions of one new key are a CONFLICT but the least.
    """
    known = files.select(F.col(file)).distinct().withColumn("_seen", F.lit(True))
    old = stored.select(key, F.col(definition).alias("_old"))
    least = incoming.groupBy(key).agg(F.min(definition).alias("_least"))
    rows = incoming.join(known, file, "left").join(old, key, "left").join(least, key)
    outcome = (
        F.when(F.col("_seen"), "ALREADY_IMPORTED")
        .when(F.col("_old").isNotNull(), F.when(F.col("_old") == F.col(definition), "SAME").otherwise("CONFLICT"))
        .when(F.col(definition) != F.col("_least"), "CONFLICT")
        .otherwise("NEW")
    )
    judged = rows.select(key, file, cost, outcome.alias("outcome"))
    spent = judged.filter("outcome = 'NEW'").groupBy(file).agg(F.sum(cost).alias("_spent"))
    out = judged.join(spent, file, "left")
    return out.select(key, file, F.when((F.col("outcome") == "NEW") & (F.col("_spent") > budget), "OVER_BUDGET").otherwise(F.col("outcome")).alias("outcome"))
