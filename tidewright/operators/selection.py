"""Diversity, top-k, paging and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ranking import ranked

#: How many rows a sequential packer looks at for one pack.
SCAN = 5_000


def concept_turns(df: DataFrame, concept: str, priority: str, item: str, n: int, pool: int = 10) -> DataFrame:
    """n rows that take turns among concepts, from the top pool x n by priority."""
    top = df.orderBy(F.desc(priority), F.asc(item)).limit(pool * n)
    turn = F.row_number().over(Window.partitionBy(concept).orderBy(F.desc(priority), F.asc(item)))
    return top.withColumn("concept_turn", turn).orderBy("concept_turn", F.desc(priority), F.asc(item)).limit(n)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def varied_sample(df: DataFrame, keys: list[str], family: str, source: str, order: list[Column], per_family: int = 4) -> DataFrame:
    """One row for each source, and at most some sources for each family."""
    first = F.row_number().over(Window.partitionBy(*keys, family, source).orderBy(*order))
    once = df.withColumn("_s", first).filter("_s = 1").drop("_s")
    return once.withColumn("_f", F.row_number().over(Window.partitionBy(*keys, family).orderBy(*order, F.asc(source)))).filter(F.col("_f") <= per_family).drop("_f")


def spread(items: Column, most: int) -> Column:
    """At most ``most`` items of an array, evenly spaced, with the first and the last."""
    n = F.size(items)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int")))
    return F.when(n <= most, items).otherwise(F.transform(at, lambda i: F.element_at(items, i + 1)))


def stratified(df: DataFrame, order: list[Column], item: str, n: int, explore: float = 0.25, tranches: int = 3) -> DataFrame:
    """The top share of n, and the rest of n from tranches of the remainder by hash, equally many from
    each; what a short tranche lacks comes from the others in order."""
    rows = ranked(df, order, "_k").withColumn("_r", F.col("_k") - 1).drop("_k")
    total = df.count()
    take = min(n, total)
    top = int(round(take * (1 - explore)))
    rest, want = total - top, take - top
    cut = [rest * i // tranches for i in range(tranches + 1)]
    tranche = F.coalesce(*[F.when(F.col("_r") - top < cut[i + 1], i) for i in range(tranches)])
    by_hash = F.row_number().over(Window.partitionBy("_t").orderBy(F.sha2(F.col(item).cast("string"), 256), F.col(item).cast("string")))
    others = rows.filter(F.col("_r") >= top).withColumn("_t", tranche).withColumn("_h", by_hash)
    quota = F.lit(want // tranches) + F.when(F.col("_t") < want % tranches, 1).otherwise(0)
    picked = others.filter(F.col("_h") <= quota).drop("_t", "_h")
    short = want - sum(min(want // tranches + (i < want % tranches), cut[i + 1] - cut[i]) for i in range(tranches))
    if short:
        picked = picked.unionByName(others.filter(F.col("_h") > quota).drop("_t", "_h").orderBy("_r").limit(short))
    return rows.filter(F.col("_r") < top).unionByName(picked).drop("_r")


def after_cursor(df: DataFrame, order: list[tuple[str, bool]], cursor: tuple | None, n: int) -> DataFrame:
    """The next n rows beyond a cursor of several columns; (name, descending) each."""
    test = F.lit(True)
    if cursor is not None:
        test = F.lit(False)
        equal = F.lit(True)
        for (name, down), value in zip(order, cursor, strict=True):
            beyond = F.col(name) < value if down else F.col(name) > value
            test = test | (equal & beyond)
            equal = equal & (F.col(name) == value)
    return df.filter(test).orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(n)


def budget_until(df: DataFrame, order: list[Column], costs: dict[str, float], n: int, keys: list[str] | None = None) -> DataFrame:
    """Rows in order up to the first that breaks a budget or the count; per key where keys are given.

    Only the first n rows of a key can be taken: the others go before the running sums, in the tasks that
    hold them, so that a key's window is n rows.
    """
    first = top_k(df, keys, order, n).drop("rank") if keys else df.orderBy(*order).limit(n)
    w = Window.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.lit(False)
    for c, most in costs.items():
        breaks = breaks | (F.sum(c).over(w) > most)
    return first.withColumn("_b", breaks.cast("int")).withColumn("_broken", F.max("_b").over(w)).filter("_broken = 0").drop("_b", "_broken")


def complexity_pack(df: DataFrame, order: list[Column], evidence: Column, budget: int, least: int, most: int, keys: list[str]) -> DataFrame:
    """Rows in order while a cost of 1 to 4 each fits the budget; ``least`` rows are taken anyhow, ``most`` at most.

    As in ``budget_until``, a key's window is ``most`` rows.
    """
    cost = 1 + F.least(F.lit(3), F.floor(evidence / 8))
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = top_k(df.withColumn("cost", cost.cast("int")), keys, order, most).withColumnRenamed("rank", "_n").withColumn("running_cost", F.sum("cost").over(upto))
    breaks = (F.col("_n") > least) & (F.col("running_cost") > budget)
    return rows.withColumn("_x", F.max(breaks.cast("int")).over(upto)).filter("_x = 0").drop("_n", "_x")


def _columns(df: DataFrame, more: str = "") -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + more


def budget_skipping(df: DataFrame, key: str, order: list[str], costs: dict[str, float], n: int, firm: str | None = None, scan: int = SCAN) -> DataFrame:
    """Per key, rows in order that fit the budgets; those that don't are skipped and the search goes on.

    A first row may go over all budgets but ``firm``. A pack looks at the first ``scan`` rows of its key,
    which is what a task holds.
    """
    names = list(costs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        cost = pdf[names].to_numpy(float)
        left = np.array([costs[c] for c in names], float)
        barred = cost[:, names.index(firm)] > costs[firm] if firm is not None else np.zeros(len(cost), bool)
        taken: list[int] = []
        for i in np.flatnonzero(~barred).tolist():
            if len(taken) == n:
                break
            if not taken or (cost[i] <= left).all():
                left = left - cost[i]
                taken.append(i)
        return pdf.iloc[taken]

    first = top_k(df, [key], [F.asc(c) for c in order], scan).drop("rank")
    return first.groupBy(key).applyInPandas(run, df.schema)


def first_fit_jobs(df: DataFrame, key: str, order: list[str], size: str, most_rows: int, most_jobs: int, block: int = SCAN) -> DataFrame:
    """Per key, jobs in order dealt to groups by first fit; column ``bin``.

    A key's jobs are dealt in blocks of ``block`` in their order, each with groups of its own, numbered on
    from block to block. So a task holds a block, and no job is left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rows, jobs, place = np.zeros(len(pdf)), np.zeros(len(pdf), int), []
        for value in pdf[size].to_numpy(float):
            # A group that is there and has room, or else the first empty one, whatever the job's size.
            fits = (jobs == 0) | (rows + value <= most_rows) & (jobs < most_jobs)
            k = int(fits.argmax())
            rows[k] += value
            jobs[k] += 1
            place.append(k)
        return pdf.assign(bin=np.array(place, np.int32) + pdf["_block"].to_numpy(np.int32) * np.int32(block)).drop(columns="_block")

    placed = ranked(df, [F.asc(key), *[F.asc(c) for c in order]], "_k")
    first = placed.groupBy(key).agg(F.min("_k").alias("_k0"))
    blocks = placed.join(first, key).withColumn("_block", F.floor((F.col("_k") - F.col("_k0")) / block).cast("int")).drop("_k", "_k0")
    return blocks.groupBy(key, "_block").applyInPandas(run, _columns(df, ", bin int"))


def two_queues(df: DataFrame, key: str, order: list[str], cost: str, exploring: str, budget: float, share: float = 0.25, scan: int = SCAN) -> DataFrame:
    """Per key, rows from a priority and an exploration queue by turns of the share, while the budget lasts.

    A row that doesn't fit lets the other queue have its turn; when neither fits, the pack is done. A
    queue is the first ``scan`` rows of its kind, which is what a task holds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        price, kind = pdf[cost].to_numpy(float), pdf[exploring].to_numpy(bool)
        queues = [np.flatnonzero(~kind).tolist(), np.flatnonzero(kind).tolist()]
        at, left, taken, explored = [0, 0], budget, [], 0
        while at[0] < len(queues[0]) or at[1] < len(queues[1]):
            turn = int(explored < share * (len(taken) + 1))
            for q in (turn, 1 - turn):
                if at[q] < len(queues[q]) and price[queues[q][at[q]]] <= left:
                    i = queues[q][at[q]]
                    at[q] += 1
                    left -= price[i]
                    explored += q
                    taken.append(i)
                    break
            else:
                break
        return pdf.iloc[taken]

    first = top_k(df, [key, exploring], [F.asc(c) for c in order], scan).drop("rank")
    return first.groupBy(key).applyInPandas(run, df.schema)


def exploration_order(df: DataFrame, order: list[Column], item: str, share: float = 0.25) -> DataFrame:
    """Rows with ``exploring``: the bottom share, re-ordered by hash; column ``turn`` gives the order."""
    n = df.count()
    cut = n - int(n * share)
    out = ranked(df, order, "_r").withColumn("exploring", F.col("_r") > cut)
    first = out.filter(~F.col("exploring")).withColumn("turn", F.col("_r"))
    rest = ranked(out.filter("exploring"), [F.sha2(F.col(item).cast("string"), 256), F.col("_r")], "turn")
    return first.unionByName(rest).drop("_r")


def scan_budget(df: DataFrame, anchor: str, order: list[Column], n_rows: str, per_anchor: int, budget: int) -> DataFrame:
    """Anchors in order with the rows each may read of a common budget, capped per anchor."""
    capped = F.least(F.col(n_rows), F.lit(per_anchor))
    granted = F.greatest(F.lit(0), F.least(F.col("_c"), budget - F.col("_before")))
    rows = ranked(df.withColumn("_c", capped), order, "_k", {"_before": F.col("_c")})
    return rows.withColumn("granted", granted.cast("long")).filter("granted > 0").drop("_c", "_before", "_k")


def small_groups(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of the groups of at most ``most`` rows; larger groups are left out whole."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select(key)
    return df.join(sizes, key, "left_semi")


def free_lanes(jobs: DataFrame, order: list[Column], busy: set[int], lanes: int) -> Iterator[tuple]:
    """(lane, job) for the first jobs in order, one for each free lane."""
    free = [i for i in range(1, lanes + 1) if i not in busy]
    yield from zip(free, jobs.orderBy(*order).limit(len(free)).collect(), strict=False)
