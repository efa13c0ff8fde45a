"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the
result is written as Parquet and is the next stage's docs. The last stage
returns token ids.

All stages but the last return the columns of ``docs`` in their order and with
their names, whatever these are: inside a stage columns go by number. Documents
need columns ``doc_id`` and ``text``; ``language`` also ``lang``, and ``lines``
sets ``n_chars`` where there is one. Texts of any length are taken whole, and an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontamination, langid, line_dedup, ngram_join
from tidewright.llm.queries import tokenizer_path
from tidewright.llm.scratch import Scratch
from tidewright.llm.tables import table

#: A text of so many letters must be nearer to its language than to the next by so much.
SURE_LETTERS = 200
SURE_SCORE = 0.001


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns k0, k1, ..., and where each of its names went."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: others have no letters, or are as far from all languages.

    All rows with a label may be in the sample that is learned from, held-out ones
    too: the stage measures no accuracy. Null and empty texts have no letters and
    go; ties between languages are no reason to go unless the text is long; rows
    that repeat an id or a text are judged each; null ids stay. Where no row has a
    label, no language is known and every document goes.
    """
    rows, at = _numbered(docs)
    sample = langid.fit(rows, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    found = langid.classify(rows, sample, keep=[F.col(c) for c in rows.columns], text_col=at["text"])
    letters = F.length(F.regexp_replace(at["text"], r"[^\p{L}]", ""))
    unsure = (F.col("score") < SURE_SCORE) & (letters >= SURE_LETTERS)
    if len(sample) < 2:
        unsure = F.lit(False)
    return found.filter((F.col("lang_pred") != "und") & ~unsure).select(*rows.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those that lose every line go.

    Null texts stay null, empty texts stay empty; of rows that repeat an id, and of
    null ids (one document that comes first), each keeps what no earlier place has.
    """
    rows, at = _numbered(docs)
    others = [c for c in rows.columns if c not in (at["doc_id"], at["text"], at.get("n_chars"))]
    found = line_dedup.delete_repeated_runs(rows, id_col=at["doc_id"], text_col=at["text"], keep=others)
    stay = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    made = {at["doc_id"]: F.col("id"), at["text"]: F.col("text"), at.get("n_chars"): F.length("text").cast("long")}
    return stay.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle Jaccard of 0.8 or more: that of least id.

    Texts without words (null, empty) link with nothing and stay. Rows that repeat
    an id are one document, with the fewest shingles of its rows, and stay or go
    together; rows with a null id have no name to be dropped by and stay.
    """
    rows, at = _numbered(docs)
    found = ngram_join.jaccard_components(rows, id_col=at["doc_id"], text_col=at["text"], width=5, percent=80)
    copies = found.filter("component_id < id").select(F.col("id").alias("copy"))
    return rows.join(copies, F.col(at["doc_id"]) == F.col("copy"), "left_anti").toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within one edit in five words.

    Null and empty texts hold nothing and stay; every row is judged by itself; with
    an empty benchmark all documents stay.
    """
    rows, at = _numbered(docs)
    return decontamination.drop_holders(rows, table(spark, sf_dir, "benchmark"), text_col=at["text"]).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of ids and decoded text.

    A row for each row of ``docs``, null ids and repeated rows too; null and empty
    texts have no tokens.
    """
    rows, at = _numbered(docs)
    coded = bpe.round_trip(rows, tokenizer_path(), keep=[at["doc_id"]], text_col=at["text"]).withColumnRenamed(at["doc_id"], "doc_id")
    return coded.select("doc_id", *bpe.digests(coded), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: Language ID, edit distance over words and BPE have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
