"""Benchmark decontamination under word edits.

A document holds a benchmark item of m words if some stretch of its words is
within ``percent_edits`` of m word edits (insert, delete, replace) of the item.
Words are compared in lower case and without punctuation.

* The CGK random walk reads a word sequence with a pointer that moves on or
  stays, step by step, as a random bit of (step, word) says, and writes down the
  word it points at. Sequences at a small edit distance give strings at a small
  Hamming distance, as walks that have gone apart meet again.
* Bit sampling: each table looks at a few random steps of one walk. For items of
  about the same number of allowed edits, tables are added until ``recall`` of
  edited copies at the greatest distance meet their item in one of them. The
  embedding stretches k edits to as many as k * k, so with very many edits no
  reasonable number of tables does: where ``MOST_TABLES`` don't reach the recall,
  every window that shares a run of words with the item is verified, which loses
  nothing.
* A window of an item's size is embedded where the text shares one run of words
  with the item, at the start which that run gives it. The run has q <= 3 words,
  the most of which any text within e edits keeps one: ``m - q + 1 - q * e >= 1``.
  So no place that holds an item is passed over, and text that has nothing of any
  item isn't embedded; which windows are candidates, for which items, only the
  tables decide.
* Pairs that meet in a table are verified by the exact edit distance. Windows of
  one document and item that lie within e words of each other are verified
  together, in a band of diagonals that an alignment of at most e edits can reach:
  an item of 10,000 words takes 10,000 vector operations, once.

Items are a stated query set: they are dealt by their texts into blocks of at
most ``BLOCK_BYTES`` (one item at least); each block is broadcast and meets all
documents in one scan without a shuffle. A benchmark of any size is read block
by block.

Defined results: null and empty texts hold nothing; texts of any length are
searched whole; items without words, and those with null id or text, are held by
nothing; items of fewer than 100 / percent_edits words must be met exactly;
items that repeat an id count as one item of several texts, the nearest wins
(ties: the first place); ids of documents and items may be of any type that
Spark orders; rows that repeat an id are one document in ``find_items`` (null ids
too) and are judged each in ``drop_holders``; an empty table on either side
gives no rows, or drops none; other columns are ignored, or passed through.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewright.llm import words
from tidewright.llm.worker import kept, slices

BLOCK_BYTES = 8 << 20
PERCENT_EDITS = 20
RECALL = 0.99
WALKS = 8
STEPS_IN_TABLE = 2
CALIBRATION_ITEMS = 16
CALIBRATION_COPIES = 24
MOST_TABLES = 96
_WIDE_PUNCTUATION = re.compile("[ «»‐-‧‰-⁞、。]")
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal_words(texts: list[str | None]) -> list[bytes]:
    """Texts in lower case with punctuation as spaces."""
    found = []
    for text in texts:
        text = (text or "").lower()
        if not text.isascii():
            text = _WIDE_PUNCTUATION.sub(" ", text)
        found.append(text.encode("utf-8", "surrogatepass").translate(_PLAIN))
    return found


def embed(flat: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The words (walks x sequences x ``wanted`` steps, sorted) of all walks over each ``flat[start:end]``; 0 past the end."""
    at = np.repeat(start.astype(np.int64)[None], WALKS, 0)
    out = np.zeros((WALKS, len(start), len(wanted)), np.uint64)
    flat = flat if len(flat) else np.zeros(1, np.uint64)
    walk = (np.arange(WALKS, dtype=np.uint64) << np.uint64(32))[:, None]
    k = 0
    for j in range(int(wanted[-1]) + 1 if len(wanted) else 0):
        word = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.uint64(0))
        if wanted[k] == j:
            out[:, :, k] = word
            k += 1
        at += (words.mix(word ^ (walk | np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)).astype(np.int64)
    return out


def least_edits(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least word edits from ``item`` to any stretch of ``text``, and where the first such stretch starts.

    More than ``most`` edits come as ``most + 1``.
    """
    # A cell holds edits << 32 | start; row i has the cells of text places i - most ... i + wide + most,
    # where ``wide`` is how much longer the text is: no alignment of at most ``most`` edits leaves them.
    one, never = np.int64(1) << 32, (np.int64(most) + 1) << 32
    wide = max(0, len(text) - len(item))
    width = wide + 2 * most + 1
    step = np.arange(width, dtype=np.int64) * one
    padded = np.concatenate([np.full(most + 1, -1, np.int64), text.view(np.int64), np.full(len(item) + wide + 2 * most + 1, -1, np.int64)])
    inside = np.arange(len(padded)) - most - 1 < len(text)
    place = np.arange(-most, wide + most + 1)
    before = np.where((place >= 0) & (place <= len(text)), np.maximum(place, 0), never)
    own = item.view(np.int64)
    for i in range(1, len(item) + 1):
        # The cell of text place j compares the text's word j - 1.
        other, real = padded[i : i + width], inside[i : i + width] & (place + i >= 1)
        now = np.where(real, before + (other != own[i - 1]) * one, never)
        now[:-1] = np.minimum(now[:-1], before[1:] + one)
        if i <= most:
            now[most - i] = i * one
        now = np.minimum(np.minimum.accumulate(now - step) + step, never)
        now[(place + i < 0) | (place + i > len(text))] = never
        if now.min() >= never:
            return most + 1, 0
        before = now
    best = int(before.min())
    return best >> 32, best & 0xFFFFFFFF


class Items:
    """The search structures of a block of items."""

    def __init__(self, block: list[tuple], percent: int, recall: float):
        self.ids = [i for i, _ in block]
        hashes, counts = words.word_hashes(normal_words([text for _, text in block]))
        ends = np.cumsum(counts)
        self.words = [hashes[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        self.size = counts.astype(np.int64)
        self.edits, self.percent = self.size * percent // 100, percent
        self.gram = np.zeros(len(block), np.int64)
        for q in (1, 2, 3):
            self.gram[(self.size - q + 1 - q * self.edits >= 1) & (self.size >= q)] = q
        self.indexes = []
        for q in sorted(set(self.gram.tolist()) - {0}):
            grams, item, offset = [], [], []
            for k in np.flatnonzero(self.gram == q).tolist():
                g = words.sequence_hashes(self.words[k], q)
                grams.append(g)
                item.append(np.full(len(g), k))
                offset.append(np.arange(len(g)))
            grams, item, offset = np.concatenate(grams), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.indexes.append((q, seen, grams[order], item[order], offset[order]))
        self._plan(np.random.default_rng(7), recall)
        self.keys: dict[int, list] = {}

    def _plan(self, rng, recall: float) -> None:
        """The tables (a walk, and fractions of 3 m steps to look at), and how many of them items of some edits need."""
        # A walk over m words is inside them for m steps at least, and for about 2 m; the first tables look at the former.
        self.tables = [(t % WALKS, np.sort(rng.random(STEPS_IN_TABLE)) / 3 * (1 if t < WALKS else 2)) for t in range(MOST_TABLES)]
        #: By the bits of the number of edits; None: the tables don't reach the recall.
        self.enough: dict[int, int | None] = {0: WALKS}
        for bits in sorted({int(e).bit_length() for e in self.edits.tolist()} - {0}):
            alike = [k for k, e in enumerate(self.edits.tolist()) if e.bit_length() == bits]
            some = alike if len(alike) <= CALIBRATION_ITEMS else rng.choice(alike, CALIBRATION_ITEMS, replace=False).tolist()
            met = np.concatenate([self._copies_met(rng, k) for k in some])
            share = np.logical_or.accumulate(met, 1).mean(0)
            self.enough[bits] = int((share >= recall).argmax()) + 1 if (share >= recall).any() else None

    def _copies_met(self, rng, k: int) -> np.ndarray:
        """(copies x tables): in which tables copies with the most edits meet item k."""
        own, copies = self.words[k], []
        for _ in range(CALIBRATION_COPIES):
            edited = own.tolist()
            for _ in range(int(self.edits[k])):
                place, kind = int(rng.integers(max(1, len(edited)))), rng.integers(3)
                edited[place : place + (kind != 1)] = [int(rng.integers(1 << 62))] if kind != 2 else []
            copies.append(np.array((edited + [0] * len(own))[: len(own)], np.uint64))
        laid = np.concatenate([own, *copies])
        at = np.arange(len(copies) + 1) * len(own)
        met = np.zeros((len(copies), len(self.tables)), bool)
        for t, (inside, key) in enumerate(self._table_keys(len(own), laid, at, at + len(own), len(self.tables))):
            if len(inside) and inside[0] == 0:
                met[inside[1:] - 1, t] = key[1:] == key[0]
        return met

    def _table_keys(self, m: int, flat: np.ndarray, start: np.ndarray, end: np.ndarray, tables: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table the sequences that are inside at its steps, and their keys; past its end a walk meets nothing."""
        steps = [(walk, np.minimum((places * 3 * m).astype(int), 3 * m - 1)) for walk, places in self.tables[:tables]]
        wanted = np.unique(np.concatenate([at for _, at in steps]))
        walks = embed(flat, start, end, wanted)
        for walk, at in steps:
            seen = walks[walk][:, np.searchsorted(wanted, at)]
            inside = np.flatnonzero((seen != 0).all(1))
            yield inside, words.join_hashes(seen[inside, 0], seen[inside, 1])

    def _meet(self, m: int, tables: int, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of those that meet in some table, for windows and items of m words."""
        if m not in self.keys:
            own = np.flatnonzero(self.size == m)
            at = np.arange(len(own)) * m
            self.keys[m] = []
            for inside, key in self._table_keys(m, np.concatenate([self.words[k] for k in own]), at, at + m, tables):
                order = np.argsort(key, kind="stable")
                self.keys[m].append((key[order], own[inside[order]]))
        found = [np.zeros(0, np.int64)]
        for (inside, key), (sorted_, own) in zip(self._table_keys(m, flat, start, end, tables), self.keys[m], strict=True):
            a, b = np.searchsorted(sorted_, key, "left"), np.searchsorted(sorted_, key, "right")
            hit = np.flatnonzero(b > a)
            n = (b - a)[hit]
            item = own[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)]
            found.append(np.repeat(inside[hit], n) << 32 | item)
        both = np.unique(np.concatenate(found))
        return both >> 32, both & 0xFFFFFFFF

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, first word) of the nearest stretch for each text and item it holds."""
        found: dict[tuple, tuple[int, int]] = {}
        plain = normal_words(texts)
        verified: dict[tuple, tuple[int, int]] = {}
        for a, b in words.groups(plain):
            flat, counts = words.word_hashes(plain[a:b])
            last = np.cumsum(counts)
            first = last - counts
            windows: dict[int, list] = defaultdict(list)
            for q, seen, grams, item_of, offset_of in self.indexes:
                own = words.sequence_hashes(flat, q)
                place = np.flatnonzero(seen[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
                low = np.searchsorted(grams, own[place], "left")
                n = np.searchsorted(grams, own[place], "right") - low
                place, low, n = place[n > 0], low[n > 0], n[n > 0]
                doc = np.searchsorted(last, place, "right")
                inside = place + q <= last[doc]
                place, low, n, doc = place[inside], low[inside], n[inside], doc[inside]
                if not len(place):
                    continue
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                item, offset, place, doc = item_of[entry], offset_of[entry], np.repeat(place, n), np.repeat(doc, n)
                start = np.maximum(place - offset, first[doc])
                for m in np.unique(self.size[item]).tolist():
                    own = self.size[item] == m
                    windows[m].append((doc[own], start[own], item[own]))
            for m, parts in windows.items():
                doc, start, item = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((item, start, doc))
                doc, start, item = doc[order], start[order], item[order]
                tables = self.enough[int(m * self.percent // 100).bit_length()]
                if tables is not None:
                    once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
                    doc, start = doc[once], start[once]
                    window, item = self._meet(m, tables, flat, start, np.minimum(start + m, last[doc]))
                    doc, start = doc[window], start[window]
                e = int(m * self.percent // 100)
                # Windows of a document and item, near ones together.
                order = np.lexsort((start, item, doc))
                doc, start, item = doc[order], start[order], item[order]
                begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > e)])) if len(doc) else doc
                for x, y in zip(begins.tolist(), np.append(begins[1:], len(doc)).tolist(), strict=True) if len(doc) else ():
                    d, k = int(doc[x]), int(item[x])
                    low, high = max(int(first[d]), int(start[x]) - e), min(int(last[d]), int(start[y - 1]) + m + e)
                    near = flat[low:high]
                    key = (k, near.tobytes())
                    if key not in verified:
                        if len(verified) >= 1 << 14:
                            verified.clear()
                        # Each word of the item that the stretch lacks takes an edit.
                        lacks = int((~np.isin(self.words[k], near)).sum())
                        verified[key] = least_edits(self.words[k], near, e) if lacks <= e else (lacks, 0)
                    edits, at = verified[key]
                    at += low
                    if edits <= e:
                        here = (a + d, self.ids[k])
                        found[here] = min(found.get(here, (edits, at - int(first[d]))), (edits, at - int(first[d])))
        return [(text, item, edits, at) for (text, item), (edits, at) in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def find_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent_edits: int = PERCENT_EDITS, recall: float = RECALL) -> DataFrame:
    """(id, item, n_edits, start_word) for each row of ``docs`` and item that it holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = benchmark.schema[item_col].dataType
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, item {kind.simpleString()}, n_edits int, start_word long"
    found = [_search_block(rows, block, kinds, to_arrow_type(kind), percent_edits, recall) for block in _blocks(benchmark, item_col, item_text_col)]
    if not found:
        return docs.sparkSession.createDataFrame([], kinds)
    # An item may have texts in several blocks, and a document several rows.
    nearest = reduce(DataFrame.unionByName, found).groupBy("id", "item").agg(F.min(F.struct("n_edits", "start_word")).alias("m"))
    return nearest.select("id", "item", "m.n_edits", "m.start_word")


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple]]:
    """The items, in blocks of about BLOCK_BYTES, dealt by id and text."""
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-int(total) // BLOCK_BYTES)
    for number in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number).collect()
        if part:
            yield sorted((r["item"], r["text"]) for r in part)


def _search_block(rows: DataFrame, block: list[tuple], kinds: str, items_kind: pa.DataType, percent: int, recall: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(("decontamination", hash(tuple(shared.value)), percent, recall), lambda: Items(shared.value, percent, recall))
        for batch in slices(batches, 2000):
            found = index.search(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([x[1] for x in found], items_kind), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int64())], ["id", "item", "n_edits", "start_word"])

    return rows.mapInArrow(run, kinds)


def drop_holders(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent_edits: int = PERCENT_EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; a pass over ``docs`` for each block of items."""
    for block in _blocks(benchmark, item_col, item_text_col):
        docs = _without(docs, block, text_col, percent_edits, recall)
    return docs


def _without(docs: DataFrame, block: list[tuple], text_col: str, percent: int, recall: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept(("decontamination", hash(tuple(shared.value)), percent, recall), lambda: Items(shared.value, percent, recall))
        for batch in slices(batches, 2000):
            stay = np.ones(batch.num_rows, bool)
            stay[[x[0] for x in index.search(batch.column(place).to_pylist())]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
