"""Predicates, paging and projections of the catalogue."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import text as T


def main_articles(ns: str = "ns", redirect: str = "redirect") -> Column:
    """Main namespace, no redirect."""
    return (F.col(ns) == 0) & (F.col(redirect) == 0)


def safe_filter(asked: Mapping[str, object], equal: Iterable[str] = (), search: Mapping[str, Iterable[str]] | None = None) -> Column:
    """A conjunction from allow-listed keys: equality, any of a list, or text in any of several columns.

    Unknown keys and blank values are ignored.
    """
    tests = []
    for key, value in asked.items():
        if value is None or value == "" or value == []:
            continue
        if key in set(equal):
            tests.append(F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
        elif search and key in search:
            tests.append(reduce(Column.__or__, [F.contains(F.lower(F.col(c)), F.lit(str(value).lower())) for c in search[key]]))
    return reduce(Column.__and__, tests, F.lit(True))


def page(df: DataFrame, order: str, allowed: Iterable[str], *, descending: bool = False, limit: int = 100, offset: int = 0, tie: str | None = None) -> DataFrame:
    """An allow-listed sort order with limit (1 to 10000) and offset."""
    key = order if order in set(allowed) else next(iter(allowed))
    keys = [F.desc(key) if descending else F.asc(key)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*keys).offset(max(0, offset)).limit(min(10_000, max(1, limit)))


def not_in(c: str, values: Iterable) -> Column:
    """NOT IN that keeps nulls."""
    return F.col(c).isNull() | ~F.col(c).isin(list(values))


def visible(column: str, rights: Mapping[str, bool], needs: Mapping[str, str]) -> Column:
    """Rows whose visibility isn't blocked for lack of a right; ``needs`` maps visibilities to rights."""
    blocked = [value for value, right in needs.items() if not rights.get(right, False)]
    return not_in(column, blocked) if blocked else F.lit(True)


def public_row(flags: Mapping[str, object], zero_or_null: Iterable[str] = ()) -> Column:
    """All flags have their values, and all named columns are null or 0."""
    tests = [F.col(c) == v for c, v in flags.items()] + [F.col(c).isNull() | (F.col(c) == 0) for c in zero_or_null]
    return reduce(Column.__and__, tests, F.lit(True))


def in_scope(df: DataFrame, key: str, own: Column, bridges: Iterable[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of an own scope, or reached by any of several bridge tables (table, column here, column there)."""
    marked = df.withColumn("_own", F.coalesce(own, F.lit(False)))
    ids = [marked.join(b.select(F.col(there).alias(here)).distinct(), here, "left_semi").select(key) for b, here, there in bridges]
    if not ids:
        return marked.filter("_own").drop("_own")
    reached = reduce(DataFrame.unionByName, ids).distinct().withColumn("_in", F.lit(True))
    return marked.join(reached, key, "left").filter(F.col("_own") | F.coalesce("_in", F.lit(False))).drop("_own", "_in")


def prefix_range(c: str, prefix: str, after: str | None = None) -> Column:
    """Titles from a prefix to the prefix with U+FFFF, beyond a cursor; not the same as starts-with."""
    test = (F.col(c) >= prefix) & (F.col(c) < prefix + "￿")
    return test if after is None else test & (F.col(c) > after)


def topic_category(c: str) -> Column:
    """Category titles that name a topic: not maintenance, births or places, 1 to 255 characters."""
    s = T.squeezed(c)
    noise = F.lit(False)
    for start in T.NOISE_PREFIXES:
        noise = noise | s.startswith(start)
    for word in T.NOISE_WORDS:
        noise = noise | F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(f" {word} "))
    return (F.length(s) > 0) & (F.length(s) < 256) & ~noise


def export_gate(requested: Column, safe: Column, blocked: Column) -> Column:
    """What may be exported: requested, safe and not blocked (the stricter of two readings)."""
    return F.coalesce(requested & safe & ~blocked, F.lit(False))


def reopen_due(df: DataFrame, retries: DataFrame, key: str, now: str, state: str = "state", due: str = "next_retry_utc") -> DataFrame:
    """Rows with a retry due by ``now`` become PENDING again."""
    ready = retries.filter(F.col(due) <= now).select(key).distinct().withColumn("_due", F.lit(True))
    return df.join(ready, key, "left").withColumn(state, F.when(F.coalesce("_due", F.lit(False)), "PENDING").otherwise(F.col(state))).drop("_due")


def value_errors(allowed: Mapping[str, Iterable]) -> Column:
    """Names of columns whose values aren't allowed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c).isin(list(v)), F.lit(False)), c) for c, v in allowed.items()]))


def redaction(sensitive: Column, may_see: Column, label_only: Column, hide: Column) -> Column:
    """HIDE, LABEL_ONLY, PLACEHOLDER or NONE, in this order of precedence."""
    return F.when(may_see | ~sensitive, "NONE").when(hide, "HIDE").when(label_only, "LABEL_ONLY").otherwise("PLACEHOLDER")


def masked(df: DataFrame, mode: str, blank: Mapping[str, Iterable[str]]) -> DataFrame:
    """Rows that aren't hidden, with the columns that each mode blanks set to null."""
    columns = {c for cs in blank.values() for c in cs}
    return df.filter(F.col(mode) != "HIDE").withColumns({c: F.when(F.col(mode).isin([m for m, cs in blank.items() if c in cs]), None).otherwise(F.col(c)) for c in columns})


def searched(df: DataFrame, wanted: dict[str, list], bridges: list[tuple[DataFrame, str, str]], allowed: Column | None = None) -> DataFrame:
    """Rows with one of the wanted values in each column (an empty list wants all), allowed ones, that every bridge knows.

    A bridge is (table, own key, its key); they are semi joins, so a row comes once however many rows match.
    """
    out = df if allowed is None else df.filter(allowed)
    for column, values in wanted.items():
        if values:
            out = out.filter(F.col(column).isin(*values))
    for i, (table, own, key) in enumerate(bridges):
        out = out.join(table.select(F.col(key).alias(f"_b{i}")), F.col(own) == F.col(f"_b{i}"), "left_semi")
    return out
