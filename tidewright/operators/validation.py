"""Checking what came back: facts, deltas and packs, rule by rule, as rows with an error or none.

Rules are column expressions in a fixed order; the first that fails names the
row's error. What a rule needs of the sources (revisions, subjects, concepts,
texts) comes by an equi join on the page, so that a check of any number of facts
is one join and one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scores import first_error

# Forms of identifiers, dates and coverage lines.
ENTITY = r"^(?:wd:Q[1-9][0-9]*|Q[1-9][0-9]*|local:[\w.:-]+|enwiki:[1-9][0-9]*)$"
DATE = r"^-?\d{4,}(?:-\d{2}(?:-\d{2})?)?$"
COVERAGE = r"(?m)^\s*enwiki:([1-9][0-9]*)\s*\|\s*[^|\n]+\|\s*[^|\n]+\|\s*.+$"
REFERENCE = r"^(enwiki:[1-9]\d*|unesco:concept[1-9]\d*|wikidata:Q[1-9]\d*)$"
PROPERTY = r"^[a-z][a-z0-9_]{1,79}$"
CONCEPT = r"^concept[1-9]\d*$"
UNFILLED = r"(?i)^\s*(?:REMPLACER|REPLACE_|TODO)"


def _between(c: Column, least: int, most: int) -> Column:
    return c.isNotNull() & F.length(c).between(least, most)


def right_value(kind: Column, value: Column) -> Column:
    """Whether a value (as text) is of its declared type."""
    day = F.when(F.length(value) == 10, F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull()).when(F.length(value) == 7, F.substring(value, 6, 2).cast("int").between(1, 12)).otherwise(True)
    number = value.try_cast("double")
    return (
        F.when(kind == "number", number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")))
        .when(kind == "boolean", value.isin("true", "false"))
        .when(kind == "entity", value.rlike(ENTITY))
        .when(kind == "date", value.rlike(DATE) & day)
        .when(kind == "text", F.length(F.trim(value)) > 0)
        .otherwise(False)
    )


def checked_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """``facts`` with ``error``: the first rule that a fact breaks, or null.

    Facts: page_id, revision_id, subject_key, statement, predicate, source_locator, source_quote,
    object struct<type, value>, concept_ids array, qualifiers and context (JSON text), supersedes.
    Sources: page_id, revision_id, subjects, concept_ids (arrays), text.
    """
    known = sources.select("page_id", F.col("revision_id").alias("_revision"), F.col("subjects").alias("_subjects"), F.col("concept_ids").alias("_concepts"), F.col("text").alias("_text"))
    f = F.col
    is_object = lambda c: f(c).isNull() | F.try_parse_json(f(c)).isNotNull() & f(c).rlike(r"^\s*\{")
    error = first_error(
        ("unknown page", f("_revision").isNotNull()),
        ("wrong revision", f("revision_id") == f("_revision")),
        ("subject outside the pack", F.array_contains("_subjects", f("subject_key"))),
        ("malformed object", f("object").isNotNull() & f("object.value").isNotNull()),
        ("value of another type", right_value(f("object.type"), f("object.value"))),
        ("statement or predicate", (F.length(F.trim("statement")) >= 15) & (F.length(F.trim("predicate")) > 0)),
        ("quote length", _between(f("source_quote"), 5, 500)),
        ("quote not in the revision", F.contains("_text", "source_quote")),
        ("locator", F.length(F.trim("source_locator")) > 0),
        ("concept outside the pack", f("concept_ids").isNull() | (F.size(F.array_except("concept_ids", "_concepts")) == 0)),
        ("qualifiers", is_object("qualifiers")),
        ("context", is_object("context")),
    )
    return facts.join(known, "page_id", "left").withColumn("error", error).drop("_revision", "_subjects", "_concepts", "_text")


def checked_claims(claims: DataFrame, articles: DataFrame, *, reference: str = REFERENCE, predicate: str = PROPERTY, concept: str = CONCEPT, least_quote: int = 20) -> DataFrame:
    """``claims`` of a delta with ``error``: the first rule that a claim breaks, or null.

    Claims: source_page_id, source_revision_id, subject_ref, predicate, object struct<type, value>,
    statement_en, confidence, source_locator, source_quote, concepts array.
    Articles: page_id, revision_id, text of the pack that the delta answers.
    """
    known = articles.select(F.col("page_id").alias("source_page_id"), F.col("revision_id").alias("_revision"), F.col("text").alias("_text"))
    f = F.col
    error = first_error(
        ("article or revision not in the pack", f("source_revision_id") == f("_revision")),
        ("subject_ref", f("subject_ref").rlike(reference)),
        ("predicate", f("predicate").rlike(predicate)),
        ("object", f("object.type").isin("text", "entity", "number", "date", "boolean") & _between(F.trim("object.value"), 1, 2000)),
        ("unfilled template", ~f("object.value").rlike(UNFILLED) & ~F.coalesce("statement_en", F.lit("")).rlike(UNFILLED)),
        ("entity without an identifier", (f("object.type") != "entity") | f("object.value").rlike(reference)),
        ("statement", _between(F.trim("statement_en"), 15, 5000)),
        ("confidence", f("confidence").isin("high", "medium", "low")),
        ("locator", _between(F.trim("source_locator"), 1, 300)),
        ("quote length", _between(f("source_quote"), 0, 500) & (F.length(F.trim("source_quote")) >= least_quote)),
        ("quote not in the text", F.contains("_text", "source_quote")),
        ("concepts", f("concepts").isNull() | (F.size("concepts") <= 40) & F.forall("concepts", lambda c: c.rlike(concept))),
    )
    return claims.join(known, "source_page_id", "left").withColumn("error", error).drop("_revision", "_text")


def uncovered(deltas: DataFrame, articles: DataFrame, delta: str = "delta_id") -> DataFrame:
    """(delta, page_id) of articles that a delta's coverage note has no line of its own for.

    Deltas: delta, pack_id, coverage_note; articles: pack_id, page_id. A line reads
    ``enwiki:ID | ... | ... | ...``.
    """
    ids = F.regexp_extract_all(F.coalesce("coverage_note", F.lit("")), F.lit(COVERAGE), F.lit(1))
    noted = deltas.select(delta, F.explode(F.array_distinct(ids)).alias("page_id")).withColumn("page_id", F.col("page_id").cast("long"))
    return deltas.select(delta, "pack_id").join(articles.select("pack_id", "page_id"), "pack_id").select(delta, "page_id").join(noted, [delta, "page_id"], "left_anti")


def unanchored(excerpts: DataFrame, texts: DataFrame, key: str, excerpt: str = "excerpt", text: str = "text") -> DataFrame:
    """(key, excerpt) of excerpts that aren't an exact part of their text, or have none."""
    both = excerpts.join(texts.select(key, F.col(text).alias("_text")), key, "left")
    return both.filter(~F.coalesce(F.contains("_text", excerpt), F.lit(False))).select(key, excerpt)


def with_reason(selected: DataFrame, texts: DataFrame, key: str, most_bytes: int, text: str = "text") -> DataFrame:
    """(key, text, reason): selected pages with their text, or why it isn't there: NOT_FOUND, EMPTY, TOO_LARGE."""
    both = selected.join(texts.select(key, F.col(text).alias("text"), F.lit(True).alias("_there")), key, "left")
    reason = F.when(F.col("_there").isNull(), "NOT_FOUND").when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, "EMPTY").when(F.octet_length("text") > most_bytes, "TOO_LARGE")
    return both.select(key, F.when(reason.isNull(), F.col("text")).alias("text"), reason.alias("reason"))
