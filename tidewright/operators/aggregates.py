"""Rollups, audits and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_rollup(df: DataFrame, keys: list[str], seed: str, kind: str, kinds: dict[str, str]) -> DataFrame:
    """Distinct seeds and a count for each kind of evidence."""
    counts = [F.sum(F.when(F.col(kind) == value, 1).otherwise(0)).alias(name) for name, value in kinds.items()]
    return df.groupBy(*keys).agg(F.countDistinct(seed).alias("seed_count"), *counts)


def counts_with_zeros(dimension: DataFrame, key: str, facts: dict[str, DataFrame]) -> DataFrame:
    """A count of each fact table for every key, zeros kept."""
    out = dimension.select(key).distinct()
    for name, fact in facts.items():
        out = out.join(fact.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def best_evidence(df: DataFrame, keys: list[str], score: str, evidence: str, arrival: str) -> DataFrame:
    """Greatest score, evidence of the first row that has it, and number of hits."""
    pick = F.struct(F.col(score), -F.col(arrival))
    return df.groupBy(*keys).agg(F.max(score).alias("score"), F.max_by(evidence, pick).alias("evidence"), F.count(F.lit(1)).alias("hits"))


def multi_valued(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def family_bits(family: Column, bits: dict[str, int]) -> Column:
    """The bit of a source family."""
    return F.coalesce(*[F.when(family == name, bit) for name, bit in bits.items()], F.lit(0))


def overlap_audit(df: DataFrame, language: str, key: str, source: str, bit: str) -> DataFrame:
    """Per language: rows, keys, repeats within and across sources, and overlaps of the families 1, 2 and 4.

    Two aggregations with map-side combination: per (language, key, source), then per
    (language, key), then per language; no group is collected.
    """
    per_source = df.groupBy(language, key, source).agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("m"))
    per_key = per_source.groupBy(language, key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"), F.bit_or("m").alias("m"))
    many = F.bit_count("m") > 1
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    both = lambda mask: one(many & (F.col("m").bitwiseAND(mask) == mask))
    return per_key.groupBy(language).agg(
        F.sum("n").alias("observation_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        one(F.col("n") > 1).alias("repeated_keys"),
        F.sum(F.col("n") - 1).alias("extra_rows"),
        one(F.col("most") > 1).alias("repeated_inside_one_source"),
        one(F.col("sources") > 1).alias("shared_across_sources"),
        one(many).alias("shared_across_families"),
        both(3).alias("families_1_2"),
        both(5).alias("families_1_4"),
        both(6).alias("families_2_4"),
    )


def reconciled(df: DataFrame, keys: list[str], source: str, bit: str, samples: dict[str, tuple[str, int]]) -> DataFrame:
    """Keys seen in two families or more, with bounded sorted samples of some columns."""
    picks = [F.slice(F.sort_array(F.collect_set(c)), 1, n).alias(name) for name, (c, n) in samples.items()]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.bit_or(bit).alias("mask"), F.countDistinct(source).alias("sources"), *picks)
    return grouped.filter(F.bit_count("mask") >= 2)


def facets(base: DataFrame, columns: dict[str, Column], item: str | None = None) -> DataFrame:
    """(facet, value, n) for several facets in one pass; nulls are left out."""
    rows = F.array(*[F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value")) for name, c in columns.items()])
    count = F.countDistinct(item) if item else F.count(F.lit(1))
    exploded = base.select(*([item] if item else []), F.inline(rows))
    return exploded.filter("value is not null").groupBy("facet", "value").agg(count.alias("n"))


def median_by_bucket(df: DataFrame, value: str, bucket: Column, low: float, high: float) -> DataFrame:
    """(bucket, median, n): exact medians to one decimal of values in a range."""
    kept = df.filter(F.col(value).between(low, high)).select(bucket.alias("bucket"), F.col(value).alias("v"))
    return kept.groupBy("bucket").agg(F.bround(F.median("v"), 1).alias("median"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): bins from each edge up, and one below the last."""
    chain = F.lit(f"<{edges[-1]:g}")
    for edge in sorted(edges):
        chain = F.when(F.col(value) >= edge, f">={edge:g}").otherwise(chain)
    return df.groupBy(chain.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def content_duplicates(df: DataFrame, item: str, content: str) -> DataFrame:
    """(digest, n, first): contents that several rows have."""
    rows = df.select(item, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).filter("n > 1")


def coverage(df: DataFrame, item: str, done: Column, keys: list[str] | None = None) -> DataFrame:
    """Distinct items, distinct done ones, and their share in percent."""
    total, ready = F.countDistinct(item), F.countDistinct(F.when(done, F.col(item)))
    return df.groupBy(*(keys or [])).agg(total.alias("items"), ready.alias("done"), F.round(100.0 * ready / total, 1).alias("percent"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that tells two tables apart whatever the order of their rows: count, sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed"))


def search_documents(base: DataFrame, key: str, own: list[str], children: dict[str, tuple[DataFrame, str]], chars: int = 20_000) -> DataFrame:
    """(key, body, digest): own fields and all child values of each row as one searchable text."""
    out = base.select(key, F.concat_ws(" ", *own).alias("body"))
    for name, (table, column) in children.items():
        texts = table.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(column)), " ").alias(f"_{name}"))
        out = out.join(texts, key, "left").withColumn("body", F.concat_ws(" ", "body", f"_{name}")).drop(f"_{name}")
    body = F.substring(F.trim(F.regexp_replace("body", r"\s+", " ")), 1, chars)
    return out.select(key, body.alias("body"), F.sha2(body, 256).alias("digest"))


def latest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n"))


def ordered_digest(df: DataFrame, order: list[str], columns: list[str], block: int = 1_000) -> DataFrame:
    """One row (n, sha256): a digest that follows every row and their order, whatever the partitions.

    Rows are ranked and taken in blocks of ``block``; a block's digest is that of its rows' digests in order.
    Blocks of digests are taken together in the same way until one is left, so that no task sees more than a
    block. Rows are written as JSON with their columns in the given order.
    """
    from tidewright.operators.ranking import ranked

    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = ranked(df, [F.asc(c) for c in order], "_k").select((F.col("_k") - 1).alias("k"), F.sha2(line, 256).alias("h"))
    n = df.count()
    level = n
    while True:
        numbered = rows.groupBy(F.floor(F.col("k") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("x"))
        rows = numbered.select(F.col("b").alias("k"), F.sha2(F.array_join(F.transform("x", lambda s: s["h"]), ""), 256).alias("h"))
        level = -(-level // block)
        if level <= 1:
            break
    return rows.agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.min("h"), F.sha2(F.lit(""), 256)).alias("sha256"))
