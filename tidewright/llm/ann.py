"""Nearest neighbours by inner product from balanced posting lists.

* Vectors are lifted to one more dimension so that all have the greatest norm;
  nearness by inner product is then nearness by distance.
* Centroids come from a bounded sample (``SAMPLE_ROWS`` rows of at most
  ``SAMPLE_BYTES``, by hash): spherical k-means, and clusters of more than twice
  the mean are split until none is (or its vectors are all equal). There are at
  most ``MOST_LISTS``; they and a neighbour graph over them are broadcast, a few
  MB at any size of the table. Every row of the table is indexed.
* A vector goes to its nearest list, and as a boundary vector to further lists
  whose centroid is at most ``1 + REPLICATE`` times as far, unless a chosen
  centroid is nearer to that centroid than the vector is.
* A query walks the graph from fixed entries (best first, a beam) and reads the
  lists whose centroid is at most ``1 + ratio`` times as far as the nearest one.
  ``ratio`` is the least that reaches ``recall`` on the sample, against brute
  force, at fitting time. So how many lists are read depends on the vectors: few
  where they form clusters, and about half of them where they point evenly in
  all of many directions, as no partition tells such neighbours apart.
* Only the rows of chosen lists are scored against a query. Lists that are
  neighbours are stored side by side, on a shelf of about ``BLOCK_BYTES``, so
  that a query hands on k rows a shelf, not k rows a list. Shelves that have grown
  are dealt into blocks of about ``BLOCK_BYTES`` and their queries into blocks of
  about ``BLOCK_QUERIES``; a task scores a block of rows against a block of
  queries. A vector that a third of all rows hold fills many blocks, not one
  task, and a list is never cut.
* Queries whose lists hold fewer than k other ids read all lists.

Scores are inner products of the original components in double precision,
summed in the same way for equal vectors, so equal vectors tie exactly.

Defined results: null vectors, zero vectors and vectors with null or non-finite
components take no part; vectors of another length are searched by themselves,
length by length; ties go to the smaller id; rows that repeat an id count once,
with the greater score, and never as a neighbour of their own id; a query id
that is repeated gets the best scores of any of its vectors; an empty table
gives no rows; null ids take no part; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.scratch import Scratch
from tidewright.llm.worker import drop

SAMPLE_ROWS = 20_000
#: The part of the sample that centroids are fitted on; the ratio is fitted on the rest, which they haven't seen.
FIT_SHARE = 0.6
SAMPLE_BYTES = 32 << 20
LIST_ROWS = 256
MOST_LISTS = 4096
REPLICATE = 0.005
MOST_COPIES = 4
DEGREE = 24
BLOCK_BYTES = 8 << 20
BLOCK_QUERIES = 1024


def block_rows(dim: int) -> int:
    """How many vectors of ``dim`` components make a block of ``BLOCK_BYTES``."""
    return max(256, BLOCK_BYTES // (8 * dim))


def usable(vector: str) -> Column:
    """Whether a vector can be searched for and found."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & plain & F.exists(vector, lambda x: x != 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _outward(centres: np.ndarray, top: float) -> np.ndarray:
    """Centres as far out as the lifted vectors are."""
    size = np.sqrt((centres**2).sum(-1, keepdims=True))
    return np.where(size > 0, centres * (top / np.maximum(size, 1e-300)), centres)


class Centroids:
    """Balanced centroids of a sample, with a graph to find the nearest of them."""

    def __init__(self, sample: np.ndarray, lists: int, top: float, recall: float, k: int, total: int):
        rng = np.random.default_rng(11)
        self.top = top
        x = self.lift(sample)
        mixed = rng.permutation(len(x))
        cut = int(FIT_SHARE * len(x)) if len(x) >= 4 * LIST_ROWS else len(x)
        fitted, other = x[mixed[:cut]], mixed[cut:] if cut < len(x) else mixed
        self.centres = _outward(self._balanced(fitted, max(1, min(lists, cut)), rng), top)
        n = len(self.centres)
        near = np.argsort(_squared(self.centres, self.centres), 1)[:, 1 : DEGREE + 1]
        links: list[set] = [set(row.tolist()) for row in near]
        for a, row in enumerate(near.tolist()):
            for b in row[: DEGREE // 2]:
                links[b].add(a)
        for a in range(n):  # a ring keeps the graph in one piece
            links[a].add((a + 1) % n)
        width = max(map(len, links))
        self.graph = np.array([sorted(s) + [a] * (width - len(s)) for a, s in enumerate(links)])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        shelves = min(n, max(1, round(total / block_rows(sample.shape[1]))))
        self.shelf = _squared(self.centres, _means(self.centres, shelves, rng)).argmin(1)
        self.ratio = self._fit_ratio(sample[other], recall, max(1, -(-k * len(other) // max(total, len(other)))), rng)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))[:, None]], 1)

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries as points as far out as the vectors; scaling one changes no order."""
        q = q.astype(float)
        return np.concatenate([q * (self.top / np.sqrt((q**2).sum(1)))[:, None], np.zeros((len(q), 1))], 1)

    def _balanced(self, x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        done, todo, most = [], [], max(8.0, 2 * len(x) / k)
        centres = _means(x, k, rng)
        own = np.concatenate([_squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        todo = [x[own == c] for c in range(k)]
        while todo:
            part = todo.pop()
            if not len(part):
                continue
            if len(part) <= most or (part == part[0]).all():
                done.append(part.mean(0))
                continue
            two = _means(part, 2, rng, 4)
            side = _squared(part, two).argmin(1).astype(bool)
            if side.all() or not side.any():
                done.append(part.mean(0))
            else:
                todo += [part[side], part[~side]]
        return np.array(done)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search over the graph for all points at once: ids and distances, nearest first."""
        b, n = len(x), len(self.centres)
        beam = min(beam, n)
        seen = np.zeros((b, n), bool)
        seen[:, self.entries] = True
        ids = np.full((b, beam + len(self.entries)), -1)
        far = np.full(ids.shape, np.inf)
        ids[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = np.sqrt(_squared(x, self.centres[self.entries]))
        open_ = far < np.inf
        norm = (x**2).sum(1)
        size = (self.centres**2).sum(1)
        rows = np.arange(b)
        while len(rows):
            reach = np.where(open_[rows], far[rows], np.inf)
            best = reach.argmin(1)
            rows = rows[reach[np.arange(len(rows)), best] < np.inf]
            if not len(rows):
                break
            best = np.where(open_[rows], far[rows], np.inf).argmin(1)
            open_[rows, best] = False
            new = self.graph[ids[rows, best]]
            fresh = ~seen[rows[:, None], new]
            # A padded link repeats its own node, which has been seen.
            seen[rows[:, None], new] = True
            d = norm[rows][:, None] + size[new] - 2 * np.einsum("bd,bkd->bk", x[rows], self.centres[new])
            d = np.where(fresh, np.sqrt(np.maximum(d, 0)), np.inf)
            all_far = np.concatenate([far[rows], d], 1)
            keep = np.argpartition(all_far, beam - 1, 1)[:, :beam] if all_far.shape[1] > beam else np.arange(all_far.shape[1])[None].repeat(len(rows), 0)
            take = np.arange(len(rows))[:, None]
            width = keep.shape[1]
            ids[rows, :width] = np.concatenate([ids[rows], new], 1)[take, keep]
            open_[rows, :width] = np.concatenate([open_[rows], fresh], 1)[take, keep]
            far[rows, :width] = all_far[take, keep]
            ids[rows, width:], far[rows, width:], open_[rows, width:] = -1, np.inf, False
        order = np.argsort(far, 1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector: the nearest list and those it borders on."""
        ids, far = self.nearest(self.lift(vectors), 16)
        ids, far = ids[:, :MOST_COPIES], far[:, :MOST_COPIES]
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = (ids[:, j] >= 0) & (far[:, j] <= (1 + REPLICATE) * far[:, 0])
            for i in range(j):
                apart = np.sqrt(((self.centres[ids[:, j]] - self.centres[ids[:, i]]) ** 2).sum(1))
                ok &= ~chosen[:, i] | (apart > far[:, j])
            chosen[:, j] = ok
        row, place = np.nonzero(chosen)
        return row, ids[row, place]

    def lists_for(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each query: the lists to read. The beam widens until it reaches past ``ratio``."""
        aims, n, beam = self.aim(queries), len(self.centres), 64
        while True:
            ids, far = self.nearest(aims, beam)
            take = (ids >= 0) & (far <= (1 + self.ratio) * far[:, :1])
            if beam >= n or not take[:, -1].any():
                row, place = np.nonzero(take)
                return row, ids[row, place]
            beam *= 4

    def _fit_ratio(self, sample: np.ndarray, recall: float, k: int, rng) -> float:
        """The least ratio that finds ``recall`` of the sample's own neighbours.

        Of the k nearest in the whole table a sample holds its share, so so many are looked for.
        """
        probe = rng.choice(len(sample), min(1000, len(sample)), replace=False)
        best = []
        for q in probe.tolist():
            score = sample @ sample[q]
            score[q] = -np.inf
            best.append(np.argpartition(-score, min(k, len(sample) - 1) - 1)[:k])
        best = np.array(best)
        row, own = self.lists_of(sample)
        homes: list[list[int]] = [[] for _ in sample]
        for r, c in zip(row.tolist(), own.tolist(), strict=True):
            homes[r].append(c)
        far = np.sqrt(_squared(self.aim(sample[probe]), self.centres))
        reach = far / far.min(1, keepdims=True) - 1
        needed = np.sort([min(reach[q, c] for c in homes[v]) for q in range(len(probe)) for v in best[q].tolist()])
        return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1e-9


def search(table: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` holds."""
    spark = table.sparkSession
    rows = table.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    top = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks"), top).filter("asks").orderBy(F.desc("n"), "d").collect()
    parts = [_search(rows.filter(F.size("v") == r["d"]), r["d"], r["n"], float(r["top"]) ** 0.5, k, recall) for r in lengths]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:  # an id may have vectors of several lengths
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(rows: DataFrame, dim: int, total: int) -> np.ndarray:
    want = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    cut = min(1.0, 1.2 * want / total)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30)) < int(cut * (1 << 30)) + 1).select("id", "v").orderBy(F.xxhash64(F.lit("ann"), "id"), "id").limit(want).collect()
    if not picked:
        picked = rows.select("id", "v").limit(want).collect()
    return np.array([r["v"] for r in sorted(picked, key=lambda r: (r["id"], r["v"]))], float).reshape(-1, dim)


def _scores(own: pa.Table, asking: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best ids of each query in the lists that it reads."""
    x_id, q_id = np.asarray(own["id"]), np.asarray(asking["id"])
    out: list[list] = [[], [], []]
    if len(x_id) and len(q_id):
        x = np.asarray(own["v"].combine_chunks().flatten()).reshape(-1, dim)
        q = np.asarray(asking["v"].combine_chunks().flatten()).reshape(-1, dim)
        # A vector that stands in several lists is one entry; entries are in the order of their ids.
        order = np.lexsort((*x.T, x_id))
        new = np.ones(len(order), bool)
        new[1:] = (x_id[order][1:] != x_id[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        lists, list_of = np.unique(np.asarray(own["list"]), return_inverse=True)
        x, x_id = x[order[new]], x_id[order[new]]
        first = np.flatnonzero(np.concatenate([[True], x_id[1:] != x_id[:-1]]))
        after = np.append(first[1:], len(x_id))
        places = [np.unique(entry[list_of == c]) for c in range(len(lists))]
        asked = asking["lists"].combine_chunks()
        reads = np.zeros((len(q), len(lists)), bool)
        flat, row = np.asarray(asked.flatten()), np.repeat(np.arange(len(q)), np.asarray(pc.list_value_length(asked)))
        at = np.minimum(np.searchsorted(lists, flat), len(lists) - 1)
        reads[row[lists[at] == flat], at[lists[at] == flat]] = True
        slack = 1e-9 * np.sqrt((x**2).sum(1).max()) * np.sqrt((q**2).sum(1))
        for a in range(0, len(q), 256):
            about = np.full((len(q[a : a + 256]), len(x)), -np.inf)
            for c, place in enumerate(places):
                asks = np.flatnonzero(reads[a : a + 256, c])
                if len(asks):
                    about[asks[:, None], place] = q[a + asks] @ x[place].T
            about[q_id[a : a + 256, None] == x_id[None]] = -np.inf
            best = np.maximum.reduceat(about, first, 1)
            most = min(k, best.shape[1])
            kth = np.partition(best, -most, 1)[:, -most] - slack[a : a + 256]
            row, col = np.nonzero((best >= kth[:, None]) & (best > -np.inf))
            # Exact scores of all entries of the ids that are near enough; the greatest counts.
            size = (after - first)[col]
            row, item = np.repeat(row, size), np.repeat(first[col] - np.cumsum(size) + size, size) + np.arange(size.sum())
            read = about[row, item] > -np.inf
            row, item = row[read], item[read]
            exact = (q[a + row] * x[item]).sum(1)
            order = np.lexsort((-exact, x_id[item], row))
            row, item, exact = row[order], item[order], exact[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (x_id[item][1:] != x_id[item][:-1])
            row, item, exact = row[once], item[once], exact[once]
            order = np.lexsort((x_id[item], -exact, row))
            row, item, exact = row[order], item[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
            for o, y in zip(out, (q_id[a + row[keep]], x_id[item[keep]], exact[keep]), strict=True):
                o.append(y)
    columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
    return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))})


def _meet(members: DataFrame, asks: DataFrame, sizes: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best in each shelf; ``sizes`` has one row a shelf, fewer than MOST_LISTS."""
    sizes = sizes.join(asks.groupBy("shelf").agg(F.count(F.lit(1)).alias("q")), "shelf")
    sizes = F.broadcast(sizes.select("shelf", F.ceil(F.col("m") / block_rows(dim)).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("qb")))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = members.join(sizes, "shelf").withColumn("mi", F.pmod(F.xxhash64("id", "v"), F.col("mb")).cast("int")).withColumn("qi", F.explode(every("qb"))).select("shelf", "mi", "qi", "id", "list", "v")
    right = asks.join(sizes, "shelf").withColumn("qi", F.pmod(F.xxhash64("id", "v"), F.col("qb")).cast("int")).withColumn("mi", F.explode(every("mb"))).select("shelf", "mi", "qi", "id", "lists", "v")
    keys = ["shelf", "mi", "qi"]

    def score(own: pa.Table, asking: pa.Table) -> pa.Table:
        return _scores(own, asking, dim, k)

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id long, vec_id long, score double")
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _search(rows: DataFrame, dim: int, total: int, top: float, k: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score) with at least the k nearest found, of vectors of one length."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    sample = _sample(rows, dim, total)
    lists = max(1, min(MOST_LISTS, total // LIST_ROWS, max(1, len(sample) // 16)))
    index = Centroids(sample, lists, top, recall, k, total)
    shared = spark.sparkContext.broadcast(vars(index))

    def deal(asking: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop()
            index = Centroids.__new__(Centroids)
            vars(index).update(shared.value)
            for batch in batches:
                for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                    v = np.asarray(part.column(1).flatten()).reshape(-1, dim)
                    row, own = index.lists_for(v) if asking else index.lists_of(v)
                    shelf = index.shelf[own]
                    if not asking:
                        take = pa.array(row)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(shelf.astype(np.int32)), pa.array(own.astype(np.int32))], ["id", "v", "shelf", "list"])
                        continue
                    order = np.lexsort((own, shelf, row))
                    row, own, shelf = row[order], own[order], shelf[order]
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])]))
                    take = pa.array(row[first])
                    chosen = pa.ListArray.from_arrays(np.append(first, len(own)).astype(np.int32), pa.array(own.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(shelf[first].astype(np.int32)), chosen], ["id", "v", "shelf", "lists"])

        return run

    members = scratch.save(rows.select("id", "v").mapInArrow(deal(False), "id long, v array<double>, shelf int, list int"), "members")
    asks = scratch.save(rows.filter("asks").select("id", "v").mapInArrow(deal(True), "id long, v array<double>, shelf int, lists array<int>"), "asks")
    sizes = members.groupBy("shelf").agg(F.count(F.lit(1)).alias("m"))
    near = scratch.save(_meet(members, asks, sizes, dim, k), "near")
    # Queries that found fewer than k, though there are others, read every list.
    found = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    short = scratch.save(asks.select("id").distinct().join(found, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("c", F.lit(0)) < k).select("id"), "short")
    if short.isEmpty() or rows.select("id").distinct().limit(k + 1).count() <= 1:
        return near

    def all_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = shared.value["shelf"]
        shelves = np.unique(shelf)
        chosen = [np.flatnonzero(shelf == c).tolist() for c in shelves]
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                take = pa.array(np.repeat(np.arange(part.num_rows), len(shelves)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.tile(shelves, part.num_rows).astype(np.int32)), pa.array(chosen * part.num_rows, pa.list_(pa.int32()))], ["id", "v", "shelf", "lists"])

    everywhere = asks.join(short, "id").select("id", "v").distinct().mapInArrow(all_lists, "id long, v array<double>, shelf int, lists array<int>")
    return near.unionByName(_meet(members, everywhere, sizes, dim, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
