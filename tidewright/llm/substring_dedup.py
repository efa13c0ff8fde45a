"""Removal of repeated passages: every word in a window that also starts earlier.

A window is ``width`` consecutive words of one document. Spark rounds:

0. A document whose text another document of smaller id has is a copy: it loses all
   words, and the steps below leave it out. Copies come from narrow rows (digest
   and id), counted with map-side combination.
1. Every document is recompressed (see ``recompression``); symbols are dealt by
   name, sorted, and those met once are dropped as the sorted rows stream by.
2. Documents meet the codes of their repeated symbols. A window can only be
   repeated if all symbols it is known by are; only those windows get a row
   (digest, document, start). In text without repeats that is none. Symbols only
   choose windows; the digest is 96 bits of BLAKE2b over the window's own words.
3. Window rows are dealt and sorted by digest, document and start; all but the
   first of a digest are repeats. Each task hands them on grouped by document.
4. Documents meet the starts of their repeated windows and lose the words below.

Of rows of one name that a task makes from one group of texts, only the first is
dealt by name; the others, which are repeats for certain, are dealt evenly. So a
window that a third of all documents have comes as one row from each group of
texts. Rows stream in sorted order. Texts are shuffled once, compressed, and
used by steps 2 and 4 (the exchange is reused).

Defined results: null and empty texts have no words; a document shorter than a
window loses nothing; texts of any length are cut whole; rows that repeat an id
count as places of one document (equal rows lose and keep the same words; texts
that differ under one id are told apart by 32 bits of their digest); rows with a
null id are one document that comes first; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.ngram_join import packed_texts
from tidewright.llm.recompression import Windows
from tidewright.llm.skew import join_groups
from tidewright.llm.worker import drop, slices

#: What a row's place says: nothing; repeated for certain, and to be counted with others; the same, and not to be counted.
OPEN, SURE, APART = 0, 1, 2
#: Symbol names are dealt with so many bits; a clash makes a candidate, never a result.
NAME_BITS = 48


def places_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's list of places (null: none)."""
    flat, ends = np.asarray(column.values), np.asarray(column.offsets)
    return (flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), np.asarray(column.is_valid()).tolist(), strict=True))


def _utf8(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def copies(rows: DataFrame) -> DataFrame:
    """(of, digests, mixed): ids with texts that an earlier id has too, as digests, and ids of several texts."""
    own = rows.select("id", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("digest"))
    first = own.groupBy("digest").agg(F.min(F.struct("id")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = join_groups(own, first, ["digest"], ["id"]).filter(~F.col("id").eqNullSafe(F.col("least.id"))).select("id", "digest", F.lit(False).alias("mixed"))
    mixed = own.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("id", F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("mixed"))
    return later.unionByName(mixed).groupBy(F.col("id").alias("of")).agg(F.collect_set("digest").alias("digests"), F.max("mixed").alias("mixed"))


def _told_apart(keys: np.ndarray, order: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of one group of texts are first of their key, in ``order``; and names to deal the others by."""
    last = np.ones(len(order), bool)
    same = keys[order][1:] == keys[order][:-1]
    last[1:] = ~(same if same.ndim == 1 else same.all(1))
    first = np.empty(len(order), bool)
    first[order] = last
    return first, words.mix(spread.astype(np.uint64) + np.arange(len(order), dtype=np.uint64)).view(np.int64)


def _symbols(base: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for ids, texts, _, _ in _unpacked(batches, False):
            for a, b in words.groups(texts):
                doc, code, name = Windows(*words.word_hashes(texts[a:b]), width).symbols()
                own = ids.slice(a, b - a).take(pa.array(doc))
                name = (name >> np.uint64(64 - NAME_BITS)).astype(np.int64)
                order = np.argsort(name, kind="stable")
                first, elsewhere = _told_apart(name, order, code)
                again = ~first
                seen = np.zeros(len(name), bool)
                seen[order[:-1]] = again[order[1:]]
                flag = np.where(again, APART, np.where(seen, SURE, OPEN))
                name = np.where(again, elsewhere >> (64 - NAME_BITS) & (1 << NAME_BITS) - 1, name)
                yield pa.RecordBatch.from_arrays([pa.array(name), own, pa.array(code.astype(np.int64) << 2 | flag)], ["name", "id", "place"])

    return base.select("id", "packed", "tag", "digests").mapInArrow(run, f"name long, id {base.schema['id'].dataType.simpleString()}, place long")


def _unpacked(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray, list[np.ndarray]]]:
    """Ids, texts, tags and places of rows; the texts of copies are empty and ``None`` stands for their places."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    for batch in slices(batches, 1024):
        texts = [unpacker.decompress(x) for x in batch.column(1).to_pylist()]
        copies = [bool(d) and hashlib.sha256(t).digest()[:16] in d for t, d in zip(texts, batch.column(3).to_pylist(), strict=True)]
        lists = list(places_of(batch.column(4))) if places else [np.zeros(0, np.int64)] * len(texts)
        yield batch.column(0), [b"" if c else t for t, c in zip(texts, copies, strict=True)] if not places else texts, np.asarray(batch.column(2)).astype(np.int64), [None if c else x for x, c in zip(lists, copies, strict=True)]


class Group:
    """The windows of some texts, with their words one space apart."""

    def __init__(self, texts: list[bytes], width: int, rounds: int | None = None):
        data = b" ".join(texts)
        at, to = words.word_spans(data)
        hashes, counts = words.word_hashes(texts)
        self.data, self.at, self.to = words.spaced(data, at, to)
        self.windows = Windows(hashes, counts, width) if rounds is None else Windows(hashes, counts, width, rounds)
        self.counts, self.width = counts, width
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def spans(self, which: np.ndarray) -> tuple[list[int], list[int]]:
        """Where the words of windows start and end in ``data``."""
        doc = np.searchsorted(self.windows.first, which, "right") - 1
        word = self.before[doc] + which - self.windows.first[doc]
        return self.at[word].tolist(), self.to[word + self.width - 1].tolist()

    def like_the_last(self) -> np.ndarray:
        """Windows of one word only that the window before equals."""
        which = np.flatnonzero(self.windows.inside_run())
        now, last = zip(*self.spans(which), strict=True), zip(*self.spans(which - 1), strict=True)
        return which[[self.data[a:b] == self.data[c:d] for (a, b), (c, d) in zip(now, last, strict=True)]] if len(which) else which


def _placed(parts: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for ids, places in parts:
        yield pa.RecordBatch.from_arrays([ids, pa.array(places.astype(np.int64))], ["id", "place"])


def _met_twice(symbols: DataFrame) -> DataFrame:
    """(id, place): the codes of a document's symbols whose names occur again."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        last = None  # name, id and place of the last row, and whether it was handed on
        for batch in batches:
            flag = np.asarray(batch.column(2)) & 3
            apart = flag == APART
            yield batch.column(1).filter(pa.array(apart)), np.asarray(batch.column(2))[apart] >> 2
            batch = batch.filter(pa.array(~apart))
            if not batch.num_rows:
                continue
            name, place, ids = np.asarray(batch.column(0)), np.asarray(batch.column(2)) >> 2, batch.column(1)
            same = name[1:] == name[:-1]
            take = flag[~apart] == SURE
            take[1:] |= same
            take[:-1] |= same
            if last is not None and last[0] == name[0]:
                take[0] = True
                if not last[3]:
                    yield last[1], last[2]
            yield ids.filter(pa.array(take)), place[take]
            last = (name[-1], ids.slice(len(name) - 1), place[-1:], bool(take[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(repeated(batches))

    kind = symbols.schema["id"].dataType.simpleString()
    return symbols.repartition("name").sortWithinPartitions("name").mapInArrow(run, f"id {kind}, place long")


def _windows(joined: DataFrame, width: int) -> DataFrame:
    """(name, more, id, place) of all windows that are known by repeated symbols only.

    ``name`` and ``more`` are the window's digest; ``place``: start, the text's tag and a flag.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for ids, texts, tags, codes in _unpacked(batches, True):
            texts = [b"" if x is None else t for t, x in zip(texts, codes, strict=True)]
            for a, b in words.groups(texts):
                known = np.concatenate([np.zeros(0, np.int64), *[x + (i << 35) for i, x in enumerate(codes[a:b]) if x is not None and len(x)]])
                found = Group(texts[a:b], width)
                which = found.windows.candidates(known)
                which = np.union1d(which, np.setdiff1d(np.flatnonzero(found.windows.inside_run()), found.like_the_last(), assume_unique=True))
                if not len(which):
                    continue
                doc = np.searchsorted(found.windows.first, which, "right") - 1
                digest = np.frombuffer(words.digests(found.data, *found.spans(which)), "<i8").reshape(-1, 2).copy()
                digest[:, 1] &= 0xFFFFFFFF
                start = which - found.windows.first[doc]
                # Rows come in the order of the texts; where ids don't ascend, the least place isn't the first row.
                own = ids.slice(a, b - a)
                rank = _ordered(own)[doc]
                order = np.lexsort((start, rank, digest[:, 1], digest[:, 0]))
                first, elsewhere = _told_apart(digest, order, start + (tags[a:b][doc] << 20))
                # Another row that repeats the first place isn't later than it: leave that to the sorted rows.
                head = order[np.maximum.accumulate(np.where(first[order], np.arange(len(order)), 0))]
                tied = np.zeros(len(order), bool)
                tied[order] = (rank[order] == rank[head]) & (start[order] == start[head])
                flag = np.where(first | tied, OPEN, APART)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(flag == APART, elsewhere, digest[:, 0])), pa.array(digest[:, 1]), own.take(pa.array(doc)), pa.array((start << 32 | tags[a:b][doc]) << 1 | (flag == APART))], ["name", "more", "id", "place"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.select("id", "packed", "tag", "digests", "found").mapInArrow(run, f"name long, more long, id {kind}, place long")


def _ordered(ids: pa.Array) -> np.ndarray:
    """Numbers that order ids as Spark does: null first, equal ids equal."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return np.asarray(ids)
    values = ids.to_pylist()
    some = sorted({x for x in values if x is not None}, key=(lambda x: x.encode("utf-8", "surrogatepass")) if pa.types.is_string(ids.type) else None)
    number = {x: i + 1 for i, x in enumerate(some)}
    return np.array([0 if x is None else number[x] for x in values], np.int64)


def later_places(windows: DataFrame) -> DataFrame:
    """(id, place): each window that also starts earlier, as its start and the tag of its text."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        last = None  # digest, id and start of the first place of the last digest
        for batch in batches:
            apart = (np.asarray(batch.column(3)) & 1).astype(bool)
            yield batch.column(2).filter(pa.array(apart)), np.asarray(batch.column(3))[apart] >> 1
            batch = batch.filter(pa.array(~apart))
            if not batch.num_rows:
                continue
            name, more, place, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(3)) >> 1, batch.column(2)
            start = place >> 32
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (more[1:] != more[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
            later = ~new
            # Rows that repeat the first place aren't later than it.
            i = np.flatnonzero(later & (start == start[first]))
            if len(i):
                equal = [x == y for x, y in zip(ids.take(pa.array(i)).to_pylist(), ids.take(pa.array(first[i])).to_pylist(), strict=True)]
                later[i[equal]] = False
            if last is not None and last[0] == (name[0], more[0]):
                for i in np.flatnonzero(first == 0).tolist():
                    later[i] = not (start[i] == last[2] and ids[i].as_py() == last[1])
            if last is None or (name[-1], more[-1]) != last[0]:
                j = int(first[-1])
                last = ((name[j], more[j]), ids[j].as_py(), start[j])
            yield ids.filter(pa.array(later)), place[later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(repeats(batches))

    kind = windows.schema["id"].dataType.simpleString()
    return windows.repartition("name").sortWithinPartitions("name", "more", "id", "place").mapInArrow(run, f"id {kind}, place long")


def _cut(joined: DataFrame, width: int) -> DataFrame:
    """(id, n_words, n_removed, kept) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tags, marks in _unpacked(batches, True):
            for a, b in words.groups(texts):
                group = Group(texts[a:b], width, rounds=0)
                found, counts, data, starts, ends = group.windows, group.counts, group.data, group.at, group.to
                own = [np.zeros(0, np.int64) if x is None else x for x in marks[a:b]]
                doc = np.repeat(np.arange(b - a), [len(x) for x in own])
                mark = np.concatenate([np.zeros(0, np.int64), *own])
                mine = mark & 0xFFFFFFFF == tags[a:b][doc]
                which = (found.first[doc] + (mark >> 32))[mine]
                which = np.concatenate([which, group.like_the_last()])
                cover = np.zeros(len(found.names) + width + 1, np.int64)
                np.add.at(cover, found.starts[which], 1)
                np.add.at(cover, found.starts[which] + width, -1)
                gone = np.cumsum(cover) > 0
                removed, kept, at = [], [], 0
                for i, n in enumerate(counts.tolist()):
                    out = gone[found.begin[i] : found.begin[i] + n]
                    removed.append(n if marks[a + i] is None and n >= width else int(out.sum()))
                    if removed[-1] == n:
                        kept.append(b"")
                    elif removed[-1]:
                        stay = np.flatnonzero(~out) + at
                        kept.append(b" ".join(data[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)))
                    else:
                        kept.append(data[starts[at] : ends[at + n - 1]] if n else b"")
                    at += n
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.select("id", "packed", "tag", "digests", "found").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept binary")


def meet_places(packed: DataFrame, found: DataFrame) -> DataFrame:
    lists = found.groupBy(F.col("id").alias("at")).agg(F.collect_list("place").alias("found"))
    return packed.join(lists, F.col("id").eqNullSafe(F.col("at")), "left").drop("at")


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept) for each row; ``kept`` is UTF-8, words joined by one space."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = packed_texts(rows).join(copies(rows), F.col("id").eqNullSafe(F.col("of")), "left").withColumn("tag", F.when(F.col("mixed"), F.col("tag")).otherwise(0)).drop("of", "mixed")
    places = _met_twice(_symbols(base, width))
    later = later_places(_windows(meet_places(base, places), width))
    return _cut(meet_places(base, later), width)
