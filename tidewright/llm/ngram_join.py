"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles. If two sets reach the threshold, then, with
the shingles of every set in one global order, their l-prefixes (the first
``n - ceil(t * n) + l`` shingles of a set of n) share at least l shingles, for
any l. A longer prefix costs more index look-ups but asks for more shared
shingles before a pair has to be verified. Each document takes the l of least
estimated cost: look-ups plus candidates, both from the estimated frequencies of
its prefix shingles, and posts the prefix of that l. A pair is judged by the
lesser l of its two documents, for which both have posted enough.

How it scales:

* Equal sets are one class; only the document of least id of each class is joined.
* The order is by estimated frequency (rarest first), then by hash. Frequencies
  are counts over all documents in a table of ``SKETCH`` counters, which has a
  fixed size and is broadcast; the order affects cost only, never results.
* Shingles in one prefix only are dropped by a counted, map-side combined
  semi-join before any pairing.
* A large group of near copies shares its postings. Before pairs are formed,
  each document is verified against three leaders (the documents of least id,
  of least hash and with the fewest rare shingles, which is the text that the
  others were made from, that share most prefix shingles with it): a linear
  number of pairs. Groups linked so far are one part; after that only
  pairs of documents in different parts are candidates, and on each shingle the
  rows outside its commonest part meet all rows. So no pairs inside a found
  group are made, and no link between parts is lost.
* Two shingles that meet count only where both stand in the prefixes that this
  pair has to share l shingles of: sizes x and y need ``ceil(t / (1 + t) * (x + y))``
  in common, so near copies of one size meet in half as many shingles as the
  longest prefix has. A crowd of copies that stay below the threshold of each
  other then meets in the shingles of their edits, not in those all have.
* Pairs are verified on the whole texts, which travel compressed.

The result gives each document its component under the links. Component labels
and link counts need no list of pairs, and none is collected anywhere.

``MOST_MATCHES`` bounds l, and sets of fewer than ``LONG_SET`` shingles take l = 1:
that changes what a search costs, never which pairs it finds.

Defined results: texts of any length count with all their shingles; null texts and texts without words have no shingles, link with
nothing and are their own component; equal texts link; rows that repeat an id
count as one document with the shingles of the row whose text sorts first; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.components import components
from tidewright.llm.scratch import Scratch
from tidewright.llm.skew import join_groups
from tidewright.llm.worker import drop, slices

#: Counters of the frequency table (a power of two): 4 MB, whatever the input.
SKETCH = 1 << 20
SLICES = 64
MOST_MATCHES = 8
#: Smaller sets ask for one shared shingle: a longer prefix would be most of the set.
LONG_SET = 20
#: Look-ups that any prefix shingle is expected to cost, as texts share some by chance.
CHANCE = 1.0
#: A leader must share this part of a document's prefix shingles.
LEADER_SHARE = 0.25
#: Cost of verifying a candidate, in index look-ups.
VERIFY_COST = 50.0


def _texts(column: pa.Array) -> list[bytes]:
    return [(text or "").encode("utf-8", "surrogatepass").lower() for text in column.to_pylist()]


def _sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    for a, b in words.groups(texts):
        names, counts = words.word_hashes(texts[a:b])
        at = 0
        for n in counts.tolist():
            yield words.shingles(names[at : at + n], width)
            at += n


def least_overlap(n, percent: int):
    """ceil(percent * n / 100): what a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def pair_overlap(x, y, percent: int):
    """What sets of x and y share at least to reach the threshold: ceil(t / (1 + t) * (x + y))."""
    return -(-percent * (x + y) // (100 + percent))


def most_matches(n: int, percent: int) -> int:
    """The greatest l that a set of n may ask for: never more than it shares with any partner."""
    return min(MOST_MATCHES, least_overlap(n, percent)) if n >= LONG_SET else 1


def _summaries(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, n, key) for documents, and (slice, counts) for the frequency table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        table = np.zeros(SKETCH, np.int64)
        for batch in slices(batches):
            sizes, keys = [], []
            for found in _sets(_texts(batch.column(1)), width):
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                np.add.at(table, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        each = SKETCH // SLICES
        parts = [_counts(table[i * each : (i + 1) * each]) for i in range(SLICES)] if table.any() else []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, batch.column(0).type), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["id", "n", "key", "slice", "counts"]
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, key binary, slice int, counts binary")


def _counts(table: np.ndarray) -> bytes:
    """Counters as 32 bits each; greater ones stay at the greatest, which is as common as a shingle can be told to be."""
    return np.minimum(table, np.iinfo(np.uint32).max).astype("<u4").tobytes()


def _frequencies(summaries: DataFrame) -> np.ndarray:
    """Sums of the counters of all tasks: one row a slice and group of tasks, then one a slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(data, "<u4").astype(np.int64)
                sums[number] = sums[number] + found if number in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([*map(_counts, sums.values())], pa.binary())], ["slice", "counts"])

    rows = summaries.filter("slice is not null").select("slice", "counts")
    total = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for row in rows.mapInArrow(add, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        total[row["slice"]] += np.frombuffer(row["counts"], "<u4")
    return np.minimum(total.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


def _prefixes(docs: DataFrame, frequencies: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, matches, central, tokens): each document's prefix, its chosen l and how common its shingles are."""
    table = docs.sparkSession.sparkContext.broadcast(frequencies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        mean = float(counts.mean())
        floor = mean + 3 * mean**0.5
        for batch in slices(batches):
            ids, sizes, chosen, central, flat = [], [], [], [], []
            for number, found in zip(batch.column(0).to_pylist(), _sets(_texts(batch.column(1)), width), strict=True):
                n = len(found)
                if not n:
                    continue
                often = counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)]
                first = n - least_overlap(n, percent)
                order = np.lexsort((found, often))[: first + most_matches(n, percent)]
                weight = CHANCE + np.maximum(often[order] - floor, 0.0)
                # Costs are those of meeting a partner of the same size.
                same = n - pair_overlap(n, n, percent)
                look_ups = np.cumsum(weight)[same : same + most_matches(n, percent)]
                cost = look_ups + VERIFY_COST * look_ups / np.arange(1, len(look_ups) + 1)
                ids.append(number)
                sizes.append(n)
                chosen.append(int(cost.argmin()) + 1)
                order = order[: first + chosen[-1]]
                central.append(float(np.log2(weight / CHANCE).mean()))
                flat.append(found[order].view(np.int64))
            ends = np.zeros(len(flat) + 1, np.int32)
            np.cumsum([len(x) for x in flat], out=ends[1:])
            tokens = pa.ListArray.from_arrays(ends, np.concatenate(flat) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(sizes, pa.int64()), pa.array(chosen, pa.int32()), pa.array(central, pa.float64()), tokens], ["id", "n", "matches", "central", "tokens"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, matches int, central double, tokens array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, packed, tag): the texts, each compressed, for shuffles that carry texts, and 32 bits of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
            tags = [int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "little") for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(packer.compress, texts)), pa.binary()), pa.array(tags, pa.int64())], ["id", "packed", "tag"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, packed binary, tag long")


def _verified(pairs: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    left = packed.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = packed.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        memo: dict = {}

        def found(key, data: bytes) -> np.ndarray:
            if key not in memo:
                if len(memo) >= 64:
                    memo.clear()
                memo[key] = next(_sets([unpacker.decompress(data).lower()], width))
            return memo[key]

        for batch in slices(batches):
            a, b = [], []
            for x, y, px, py in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "pa", "pb")), strict=True):
                s, t = found(x, px), found(y, py)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("a").type), pa.array(b, batch.column("b").type)], ["a", "b"])

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _commonest_parts(placed: DataFrame) -> DataFrame:
    """(token, common): the part with most rows of each token of several parts.

    Ties go to the greatest part, as each side of the join works this out by itself.
    """
    by_part = placed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("c"))
    return by_part.groupBy("token").agg(F.max(F.struct("c", "part"))["part"].alias("common"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", "common")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    summaries = scratch.save(_summaries(rows, width), "summaries")
    frequencies = _frequencies(summaries)
    per_id = summaries.filter("slice is null").groupBy("id").agg(F.min(F.struct("n", "key")).alias("s")).select("id", "s.n", "s.key")
    # Only sets that several documents have need a class; any other is its own.
    classes = per_id.filter("n > 0").groupBy("key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = scratch.save(join_groups(per_id, classes, ["key"], ["id"], "left").select("id", "n", F.coalesce("class", "id").alias("class")), "members")
    heads = members.filter("n > 0 and id = class").select("id")

    prefixes = scratch.save(_prefixes(rows, frequencies, width, percent).join(heads, "id", "left_semi").dropDuplicates(["id"]), "prefixes")
    exploded = prefixes.select("id", "n", "matches", "central", F.size("tokens").alias("long"), F.posexplode("tokens").alias("at", "token"))
    shared = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    posts = scratch.save(exploded.join(shared, "token"), "posts")

    # Leaders: a linear number of pairs that finds most of the large groups.
    heads_of = posts.groupBy("token").agg(F.min("id").alias("l0"), F.max(F.struct("central", "id"))["id"].alias("l1"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("l2"))
    led = posts.select("token", "id", "long").join(heads_of, "token").select("id", "long", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("leader")) for k in range(3)])).alias("x")).select("id", "long", "x.k", "x.leader")
    best = led.filter("leader <> id").groupBy("id", "k", "leader").agg(F.count(F.lit(1)).alias("c"), F.first("long").alias("long")).filter(F.col("c") >= LEADER_SHARE * F.col("long")).groupBy("id", "k").agg(F.max(F.struct(F.col("c"), F.col("leader"))).alias("m"))
    pairs = best.select(F.greatest("id", "m.leader").alias("a"), F.least("id", "m.leader").alias("b")).distinct()
    packed = packed_texts(rows)
    known = scratch.save(_verified(pairs, packed, width, percent), "led")
    parts = components(known).select("id", F.col("component").alias("part"))

    # All other links: pairs of different parts only.
    placed = scratch.save(posts.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "placed")
    mixed = placed.join(_commonest_parts(placed), "token")
    x = mixed.filter("part <> common").select("token", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "matches", "at", "part")])
    y = mixed.select("token", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "matches", "at", "part")], (F.col("part") != F.col("common")).alias("minor"))
    asked = F.least("x_matches", "y_matches")
    near = (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & (F.col("x_part") != F.col("y_part"))
    once = ~F.col("minor") | (F.col("x_id") < F.col("y_id"))  # two minor rows meet twice
    # The prefixes that this pair has to share `asked` shingles of: size less overlap plus `asked`.
    spare = asked + F.expr(f"-(({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent})")
    met = x.join(y, "token").filter(near & once & (F.col("x_at") < F.col("x_n") + spare) & (F.col("y_at") < F.col("y_n") + spare))
    met = met.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b"), asked.alias("asked"))
    candidates = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("asked").alias("asked")).filter("c >= asked").select("a", "b")
    links = scratch.save(_verified(candidates, packed, width, percent), "links")

    found = components(known.unionByName(links)).withColumnRenamed("id", "class")
    return members.join(found, "class", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
