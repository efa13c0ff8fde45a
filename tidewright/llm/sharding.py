"""Sharding by Karmarkar-Karp differencing (law ``bytes``).

Rows with equal texts form one indivisible group; every group goes to one
shard and shard sizes come out as near equal as the groups allow.

Largest differencing keeps *partial partitions*: k subsets with their sums.
The two partial partitions with the largest spread are combined in opposite
order, the largest subset of one with the smallest of the other, until one is
left. Here this runs at two levels:

* groups above ``1 / (HEAVY * shards)`` of all bytes or rows (so at most
  ``2 * HEAVY * shards`` of them, whatever the input) are differenced on the
  driver into a labelled partition;
* the other groups are dealt by hash into slices of about ``slice_groups``
  groups, one task each. A slice starts from the labelled partition scaled by
  its share of the light bytes, so that its own groups fill what the heavy ones
  leave open, and differences its groups into it.

Only group keys and sizes are shuffled, never texts; rows of heavy groups are
placed by a broadcast of that bounded table, all others by a join on the group.
Slots are numbered by (shard, hash bucket of the id) with offsets from a prefix
sum of the bucket counts, so no task sees a whole shard.

Defined results: ties between partial partitions go to the one formed first, those
between subsets to the lower number, and slots to the hash of the row, so a shard
holds the same rows in every run; texts of any length count with all their bytes;
a null text has size 1, crc 0 and forms a group of its own;
an empty text has size 1, crc 0; repeated rows are all placed (same group, one
slot each); null ids are placed like any other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.scratch import Scratch

HEAVY = 64
SLICE_GROUPS = 20_000


def differencing(sizes: list[int], shards: int, start: list[float] | None = None) -> list[int]:
    """The subset of each item, by largest differencing into ``shards`` subsets.

    ``start`` is a partial partition to fill up: subset k of the result is the
    one that holds ``start[k]``. Subsets are kept as linked items (a parent for
    each), so a combination costs O(shards log shards).
    """
    parent: list[int] = list(range(len(sizes) + shards))
    fixed = len(sizes)

    def join(a: int, b: int) -> int:
        if a < 0:
            return b
        if b >= 0:
            parent[b] = a
        return a

    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, -1)] * (shards - 1) + [(size, i)]))
    base = start or [0] * shards
    opening = sorted((load, fixed + k) for k, load in enumerate(base))
    heap.append((opening[0][0] - opening[-1][0], fixed, opening))
    heapq.heapify(heap)
    order = len(parent)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted(((x[0] + y[0], join(x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: s[0])
        least = both[0][0]
        both = [(load - least, root) for load, root in both]
        heapq.heappush(heap, (-both[-1][0], order, both))
        order += 1
    shard_of_root = {}

    def root(i: int) -> int:
        top = i
        while parent[top] != top:
            top = parent[top]
        while parent[i] != top:
            parent[i], i = top, parent[i]
        return top

    for k in range(shards):
        shard_of_root[root(fixed + k)] = k
    return [shard_of_root[root(i)] for i in range(len(sizes))]


def assign_shards(rows: DataFrame, group: str, size: str, shards: int, *, slice_groups: int = SLICE_GROUPS) -> DataFrame:
    """``rows`` (narrow: id, group key, size, ...) with a column ``shard``.

    ``group`` holds non-null keys; rows with equal keys share a shard.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "shards")
    groups = scratch.save(rows.groupBy(F.col(group).alias("g")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    total = groups.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    is_heavy = (F.col("bytes") * (HEAVY * shards) > total["b"]) | (F.col("n") * (HEAVY * shards) > total["n"])
    heavy = sorted(groups.filter(is_heavy).select("g", "bytes").collect(), key=lambda r: (-r["bytes"], r["g"]))
    placed = differencing([r["bytes"] for r in heavy], shards)
    loads = [0] * shards
    for r, k in zip(heavy, placed, strict=True):
        loads[k] += r["bytes"]
    light_bytes = max(1, total["b"] - sum(loads))
    slices = max(1, -(-total["g"] // slice_groups))

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        tab = pa.Table.from_batches(found)
        names, bytes_, number = (tab.column(c).to_pylist() for c in ("g", "bytes", "s"))
        of_slice: dict[int, list[int]] = {}
        for i, s in enumerate(number):
            of_slice.setdefault(s, []).append(i)
        for items in of_slice.values():
            items.sort(key=lambda i: (-bytes_[i], names[i]))
            mine = [bytes_[i] for i in items]
            share = sum(mine) / light_bytes
            shard = differencing(mine, shards, [load * share for load in loads])
            yield pa.RecordBatch.from_pydict({"g": pa.array([names[i] for i in items], tab.schema.field("g").type), "shard": pa.array(shard, pa.int32())})

    kind = groups.schema["g"].dataType.simpleString()
    light = (
        groups.filter(~is_heavy)
        .select("g", "bytes", F.pmod(F.xxhash64("g"), F.lit(slices)).cast("int").alias("s"))
        .repartition(slices, "s")
        .mapInArrow(difference, f"g {kind}, shard int")
    )
    table = spark.createDataFrame([(r["g"], k) for r, k in zip(heavy, placed, strict=True)], f"g {kind}, heavy_shard int")
    marked = rows.join(F.broadcast(table), F.col(group) == F.col("g"), "left").drop("g")
    first = marked.filter("heavy_shard is not null").withColumnRenamed("heavy_shard", "shard")
    rest = marked.filter("heavy_shard is null").drop("heavy_shard").join(light, F.col(group) == F.col("g")).drop("g")
    return first.unionByName(rest)


def number_slots(rows: DataFrame, shard: str, key: Column, bucket_rows: int = 50_000) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard, in tasks of about ``bucket_rows`` rows."""
    scratch = Scratch(rows.sparkSession, "slots")
    order = [c for c in rows.columns if c != shard]
    kept = scratch.save(rows.withColumn("_h", F.xxhash64(key, *order)), "rows")
    buckets = max(1, -(-kept.count() // bucket_rows))
    kept = kept.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = kept.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(shard, "_b").orderBy("_h", *order)
    numbered = kept.withColumn("_r", F.row_number().over(inside)).join(offsets, [shard, "_b"])
    return numbered.withColumn("slot", (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_h", "_b", "_r", "_before")


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", slice_groups: int = SLICE_GROUPS) -> DataFrame:
    """Id, size, text_crc32, shard and slot of every row of ``docs``."""
    text = F.col(text_col)
    utf8 = text.cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(utf8), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(utf8), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(utf8, 256)), F.lit("null").cast("binary")).alias("text_key"),
    )
    rows = Scratch(docs.sparkSession, "sizes").save(rows, "rows")
    placed = assign_shards(rows, "text_key", "size", shards, slice_groups=slice_groups).drop("text_key")
    return number_slots(placed, "shard", F.col("doc_id"))
