"""Deletion of repeated runs of lines, over a suffix array of line sequences.

Every place of a document starts a suffix, the sequence of its lines from there
on. Suffixes are ranked by distributed prefix doubling:

0. A line is named by 128 bits of BLAKE2b over its bytes. Names that occur once
   are dropped; the others are sorted and numbered, which ranks suffixes by
   their first line.
1. In each round the rank of a suffix by its first h lines and the rank h places
   on, in the same document, make a pair. Pairs are counted with map-side
   combination, those met once are dropped, the others are sorted and numbered:
   ranks by 2h lines. A suffix whose pair is unique, or whose document ends
   within 2h lines, is settled and takes no part in later rounds. Rounds end
   when every suffix is settled.

The suffixes of one rank by h lines are the interval of the suffix array whose
longest common prefixes reach h lines. Intervals for L lines, h < L < 2h, are
those of equal ranks at a place and L - h places on: two overlapping runs of h
lines make up the L lines. In the interval of ``min_lines`` lines every suffix
but the first (of least document, then least place) is a later copy. Copies that
overlap make up a document's maximal repeated runs, and these are deleted.

So a line goes if and only if it lies in ``min_lines`` consecutive lines of its
document that also stand earlier (in a document of smaller id, or further up).
With ``min_words``, so does a shorter run of at least so many words: each place
is judged in the intervals of all numbers of lines, up to ``min_lines``, that hold
``min_words`` words.

Lines end at ``\\n``. A line that a third of all documents have is one row of
each partial count; the join that hands ranks back has it as a skewed key, which
adaptive execution splits. A text that a document of smaller id has too is left
out of the rounds, as all its places are later copies.

Defined results: a null text has no lines and stays null; an empty text has one
empty line; a text that loses all lines becomes empty; documents of fewer lines
lose nothing; texts of any number of lines are taken whole, a text twice as long
costs at most one round more; rows that repeat an id count as places of one
document (equal rows keep the same lines; texts that differ under one id are
told apart by 32 bits of their digest); rows with a null id are one document
that comes first; an empty table gives no rows; other columns are passed through
if ``keep`` names them, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words
from tidewright.llm.scratch import Scratch
from tidewright.llm.skew import join_groups
from tidewright.llm.substring_dedup import meet_places, places_of
from tidewright.llm.worker import drop, slices

MIN_LINES = 3


def _needs(lines: list[bytes], min_lines: int, min_words: int | None) -> np.ndarray:
    """For each place the fewest lines from which a run that starts there goes; 0 where the text ends before."""
    n = len(lines)
    need = np.where(np.arange(n) + min_lines <= n, min_lines, 0)
    if min_words is not None:
        before = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
        for size in range(min(min_lines - 1, n), 0, -1):
            need[: n - size + 1][before[size:] - before[: n - size + 1] >= min_words] = size
    return need


def _utf8(column: pa.Array) -> list[bytes | None]:
    return [None if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _tag(text: bytes | None) -> int:
    """32 bits that tell the texts of one id apart."""
    return int.from_bytes(hashlib.blake2b(text or b"", digest_size=4).digest(), "little")


def _lines(rows: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(id, tag, at, need, a, b) for each line; a and b are its name. Place -1 stands for the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        for batch in slices(batches):
            texts = _utf8(batch.column(1))
            lines = [[] if x is None else x.split(b"\n") for x in texts]
            size = [len(x) + 1 for x in lines]
            names = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for text, own in zip(texts, lines, strict=True) for x in (text or b"", *own)), "<i8").reshape(-1, 2)
            row = np.repeat(np.arange(len(lines)), size)
            at = np.concatenate([np.zeros(0, np.int64), *[np.arange(-1, n - 1) for n in size]])
            need = np.concatenate([np.zeros(0, np.int64), *[x for own in lines for x in ([0], _needs(own, min_lines, min_words))]])
            tags = np.array([_tag(x) for x in texts], np.int64)[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(tags), pa.array(at.astype(np.int32)), pa.array(need.astype(np.int32)), pa.array(names[:, 0]), pa.array(names[:, 1])], ["id", "tag", "at", "need", "a", "b"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, at int, need int, a long, b long")


def _copies(texts: DataFrame) -> DataFrame:
    """(id, tag) of texts that a document of smaller id has too."""
    first = texts.groupBy("a", "b").agg(F.min(F.struct("id")).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return join_groups(texts, first, ["a", "b"], ["id", "tag"]).filter(~F.col("id").eqNullSafe(F.col("least.id"))).select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct()


def _intervals(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, first) of pairs that occur more than once; ``first`` is the least document and place."""
    return rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "at")).alias("first")).filter("c > 1").drop("c")


def _later() -> Column:
    return ~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.at") == F.col("at")))


def _places(size: int, min_lines: int) -> list[Column]:
    """id and place: the line and the number of lines from it as one number, and the text's tag."""
    return [F.col("id"), (F.shiftleft(F.col("at").cast("long") * min_lines + size - 1, 32) + F.col("tag")).alias("place")]


def _long_enough(size: int) -> Column:
    return F.col("need").between(1, size)


def _rank(scratch: Scratch, rows: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Rows of repeated pairs with the pair's number in sorted order, and its first place."""
    numbered = scratch.save(_intervals(rows, x, y).orderBy(x, y).withColumn("number", F.monotonically_increasing_id()), f"{label}-ranks")
    numbered = numbered.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("number").alias("rank"), "first")
    joined = rows.select("id", "tag", "at", "need", F.col(x).alias("_x"), F.col(y).alias("_y")).join(numbered, ["_x", "_y"])
    return joined.select("id", "tag", "at", "need", "rank", "first")


def _ahead(rows: DataFrame, step: int) -> DataFrame:
    """Rows with the rank ``step`` places on as ``next``; those without one are settled."""
    there = rows.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), (F.col("at") - step).alias("_at"), F.col("rank").alias("next"))
    return rows.drop("first").join(there, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")) & (F.col("at") == F.col("_at"))).drop("_id", "_tag", "_at")


def later_copies(lines: DataFrame, scratch: Scratch, min_lines: int) -> tuple[DataFrame, int]:
    """(id, place) of each place from which a run goes, and the number of doubling rounds.

    A place is the line times ``min_lines`` plus the run's lines less one and, in the lower 32 bits, the text's
    tag; -1 - tag stands for a whole text that is a copy.
    """
    every = scratch.save(lines, "lines")
    copies = scratch.save(_copies(every.filter("at < 0")), "texts")
    saved = every.filter("at >= 0").join(copies, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_anti")
    # Rows that repeat an id and a text are one; only lines that occur again are left here.
    now = scratch.save(_rank(scratch, saved, "a", "b", "one").dropDuplicates(["id", "tag", "at"]), "one")
    marks = [copies.select(F.col("_id").alias("id"), (-1 - F.col("_tag")).alias("place")), now.filter(_long_enough(1) & _later()).select(*_places(1, min_lines))]
    h, rounds = 1, 0
    while not now.isEmpty():
        for size in range(h + 1, min(2 * h, min_lines + 1)):
            here = _ahead(now, size - h).filter(_long_enough(size))
            groups = _intervals(here, "rank", "next").withColumnsRenamed({"rank": "_x", "next": "_y"})
            met = here.withColumnsRenamed({"rank": "_x", "next": "_y"}).join(groups, ["_x", "_y"])
            marks.append(scratch.save(met.filter(_later()).select(*_places(size, min_lines)), f"copies{size}"))
        rounds += 1
        now = scratch.save(_rank(scratch, _ahead(now, h), "rank", "next", f"round{rounds}"), f"round{rounds}")
        h *= 2
        if h <= min_lines:
            marks.append(now.filter(_long_enough(h) & _later()).select(*_places(h, min_lines)))
    found = marks[0]
    for more in marks[1:]:
        found = found.unionByName(more)
    return found, rounds


def _delete(joined: DataFrame, min_lines: int, min_words: int | None, others: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            texts = [None if x is None else unpacker.decompress(x) for x in batch.column(1).to_pylist()]
            kept, removed, runs, sizes = [], [], [], []
            for text, marks in zip(texts, places_of(batch.column(2)), strict=True):
                lines = [] if text is None else text.split(b"\n")
                tag = _tag(text)
                if (marks == -1 - tag).any():
                    at = np.flatnonzero(_needs(lines, min_lines, min_words))
                    size = np.minimum(min_lines, len(lines) - at)
                else:
                    at, size = np.divmod((marks >> 32)[(marks >= 0) & (marks & 0xFFFFFFFF == tag)], min_lines)
                    size = size + 1
                cover = np.zeros(len(lines) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                gone = np.cumsum(cover)[:-1] > 0
                sizes.append(len(lines))
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(text if not removed[-1] else b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), *batch.columns[3:]], ["id", "text", "n_lines", "n_removed", "n_runs", *others])

    kinds = [f"`{x}` {joined.schema[x].dataType.simpleString()}" for x in others]
    return joined.select("id", "packed", "found", *others).mapInArrow(run, ", ".join([f"id {joined.schema['id'].dataType.simpleString()}, text string, n_lines long, n_removed long, n_runs long", *kinds]))


def delete_repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """id, text without later copies, n_lines, n_removed, n_runs and the columns ``keep`` of each row.

    Kept columns are named ``_c0``, ``_c1``, ... where their own names would clash with these.
    """
    keep = keep or []
    others = [f"_c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in zip(keep, others, strict=True)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            texts = pa.array([None if x is None else packer.compress(x) for x in _utf8(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[2:]], ["id", "packed", *others])

    kinds = [f"`{x}` {rows.schema[x].dataType.simpleString()}" for x in others]
    packed = rows.mapInArrow(pack, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}, packed binary", *kinds]))
    later, _ = later_copies(_lines(rows.select("id", "text"), min_lines, min_words), Scratch(docs.sparkSession, "lines"), min_lines)
    found = _delete(meet_places(packed, later), min_lines, min_words, others)
    taken = {"id", "text", "n_lines", "n_removed", "n_runs"}
    return found.withColumnsRenamed({x: c for x, c in zip(others, keep, strict=True) if c not in taken})
