"""Readers of SQL dumps, XML dumps and lexical sources."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T

# What a letter after a backslash stands for in MySQL strings; other characters stand for themselves.
MYSQL_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_FIELD = re.compile(r"'((?:[^'\\]|\\.)*)'|([^,()'\s;][^,()']*)", re.DOTALL)
_INSERT = re.compile(r"^INSERT\s+INTO\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*VALUES\s*", re.IGNORECASE)
_TUPLE = re.compile(r"\(((?:'(?:[^'\\]|\\.)*'|[^'()])*)\)", re.DOTALL)
#: A tuple that isn't whole after so many characters is refused.
MOST_TUPLE = 16 << 20
_END = re.compile(r"'(?:[^'\\]|\\.)*'|('.*)|(;)[ \t]*\r?\n", re.DOTALL)


def unescape(value: str) -> str:
    """A MySQL string literal's text."""
    return re.sub(r"\\(.)", lambda m: MYSQL_ESCAPES.get(m[1], m[1]), value, flags=re.DOTALL)


def parse_tuples(values: str) -> Iterator[list[str | None]]:
    """The tuples of a VALUES list as text fields; NULL is None. A broken tuple raises ValueError."""
    at = 0
    for m in _TUPLE.finditer(values):
        if values[at : m.start()].strip(" \t\r\n,;"):
            raise ValueError(f"unexpected text between tuples: {values[at : m.start()][:40]!r}")
        at = m.end()
        row: list[str | None] = []
        for f in _FIELD.finditer(m[1]):
            row.append(unescape(f[1]) if f[1] is not None else None if f[2].strip().upper() == "NULL" else f[2].strip())
        yield row
    if values[at:].strip(" \t\r\n,;"):
        raise ValueError(f"a truncated tuple: {values[at : at + 40]!r}")


def statements(pieces: Iterator[str]) -> Iterator[str]:
    """Statements of a dump that comes in pieces: they end at a ``;`` and a line's end outside quotes.

    An INSERT is handed on in parts of whole tuples, each with the statement's head, so that what is
    kept of an incomplete tail is bounded.
    """
    head, rest = "", ""
    for piece in pieces:
        rest += piece
        at = 0
        for m in _END.finditer(rest):
            if m[2]:  # m[1]: a quote that the next piece closes
                yield head + rest[at : m.start(2)]
                head, at = "", m.end()
        rest = rest[at:]
        own = "" if head else next(iter([x[0] for x in [_INSERT.match(rest.lstrip())] if x]), "")
        if head or own:
            body = rest if head else rest.lstrip()[len(own) :]
            last = 0
            for m in _TUPLE.finditer(body):
                last = m.end()
            if last:
                yield (head or own) + body[:last]
                head, rest = head or own, body[last:].lstrip(", \r\n\t")
        if len(rest) > MOST_TUPLE:
            raise ValueError(f"no whole tuple or statement in {MOST_TUPLE} characters")
    if rest.strip(" \t\r\n,;"):
        raise ValueError(f"the dump is cut off in {rest[:40]!r}")


def read_sql_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """Rows of the INSERT statements of one table in mysqldump files (plain, .gz or .bz2), all columns as text.

    A task reads one file in pieces, as only the quotes before a place tell what a ``;`` there means; large
    dumps come in many files. Raw line ends in values are kept. A cut-off file or row is an error.
    """
    names = [f"`{c}` string" for c in columns]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def pieces(at: str) -> Iterator[str]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri("file://" + at.removeprefix("file:") if at.startswith("file:/") and not at.startswith("file://") else at)
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        with store.open_input_stream(name, compression="detect") as stream:
            while data := stream.read(1 << 20):
                yield decoder.decode(data)
            yield decoder.decode(b"", True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["path"]:
                for statement in statements(pieces(at)):
                    m = _INSERT.match(statement.lstrip())
                    if not m or m[1] != table:
                        continue
                    own = [c.strip(" `") for c in m[2].split(",")] if m[2] else columns
                    rows = []
                    for row in parse_tuples(statement.lstrip()[m.end() :]):
                        if len(row) != len(own):
                            raise ValueError(f"{len(row)} fields for {len(own)} columns")
                        found = dict(zip(own, row, strict=True))
                        rows.append([found.get(c) for c in columns])
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.mapInPandas(run, ", ".join(names))


def convert(stage: str, df: DataFrame) -> DataFrame:
    """The typed rows of a dump stage, as the catalogue stores them."""
    n = lambda c: F.col(c).cast("long")
    has = set(df.columns)
    if stage == "page":
        return df.select(n("page_id"), n("page_namespace").cast("int").alias("ns"), F.col("page_title").alias("title"), n("page_is_redirect").cast("int").alias("redirect"), n("page_latest").alias("latest_revision"), n("page_len").alias("content_bytes"))
    if stage == "page_props":
        return df.filter((F.col("pp_propname") == "wikibase_item") & F.col("pp_value").rlike("^Q[1-9][0-9]*$")).select(n("pp_page").alias("page_id"), F.col("pp_value").alias("qid"))
    if stage == "linktarget":
        return df.select(n("lt_id").alias("target_id"), n("lt_namespace").cast("int").alias("ns"), F.col("lt_title").alias("title"))
    if stage == "externallinks":
        url = T.external_url("el_to_domain_index", "el_to_path") if "el_to_domain_index" in has else F.col("el_to")
        raw = F.col("el_to_domain_index") if "el_to_domain_index" in has else F.lit("")
        return df.select(n("el_id").alias("link_id"), n("el_from").alias("source_page_id"), url.alias("target_url"), raw.alias("raw_domain_index")).filter(F.col("target_url").rlike("^https?://"))
    if stage == "pagelinks":
        return df.select(n("pl_from").alias("source_page_id"), n("pl_target_id").alias("target_id"))
    if stage == "categorylinks":
        other = F.col("cl_to").alias("category") if "cl_to" in has else n("cl_target_id").alias("target_id")
        return df.select(n("cl_from").alias("source_page_id"), other, F.coalesce("cl_type", F.lit("")).alias("type"))
    raise ValueError(f"unknown stage {stage!r}")


def last_per_key(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """The last row of each key by line: what replacing loads leave."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), line).alias("_v")).select(*keys, "_v.*")


def read_pages_xml(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump: id, ns, title, revision_id, redirect flag and text."""
    schema = "id long, ns int, title string, redirect struct<_title: string>, revision struct<id: long, text: string>"
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    return raw.select(F.col("id").alias("page_id"), "ns", "title", F.col("revision.id").alias("revision_id"), F.col("redirect").isNotNull().alias("is_redirect"), F.col("revision.text").alias("text"))


def wanted_pages(pages: DataFrame, wanted: DataFrame, key: str, chars: int | None = None) -> DataFrame:
    """Pages of a wanted set, with first characters and hash of the whole text; those without have a reason:
    NOT_FOUND, or NO_TEXT for a page that is there."""
    found = pages.join(wanted.select(key), key, "left_semi")
    text = F.substring("text", 1, chars) if chars else F.col("text")
    out = found.select(key, text.alias("text"), F.sha2("text", 256).alias("text_sha256"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "NOT_FOUND").when(F.col("text_sha256").isNull(), "NO_TEXT")
    return wanted.select(key).distinct().join(out, key, "left").withColumn("reason", reason).drop("_there")


def observations(df: DataFrame, kind: str, line: str = "value", language: str = "und", aliases: dict[str, str] | None = None) -> DataFrame:
    """(language_code, lemma, lemma_key, pos, senses, forms, translations, external_id) of source lines.

    ``kind`` is jsonl (entries with word, lang_code, pos and lists), lexeme (lexeme JSON) or tsv
    (lemma, form, features). Lines that are none of it are left out.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    none = F.lit(None).cast("string")
    if kind == "jsonl":
        j = F.from_json(line, "word string, lang_code string, pos string, senses array<string>, forms array<string>, translations array<string>")
        rows = df.select(j.alias("j")).select(T.language_code("j.lang_code", aliases).alias("language_code"), T.normalized_lemma("j.word").alias("l"), F.substring(F.coalesce("j.pos", F.lit("")), 1, 80).alias("pos"), size(F.col("j.senses")).alias("senses"), size(F.col("j.forms")).alias("forms"), size(F.col("j.translations")).alias("translations"), none.alias("external_id"))
    elif kind == "lexeme":
        clean = F.regexp_replace(F.trim(line), ",$", "")
        j = F.from_json(clean, "id string, lexicalCategory string, lemmas map<string, struct<value: string>>, forms array<string>, senses array<string>")
        entries = F.filter(F.array_sort(F.map_entries("j.lemmas")), lambda e: F.trim(e["value"]["value"]) != "")
        rows = df.select(j.alias("j")).filter(F.col("j.id").rlike("^L[1-9][0-9]*$")).withColumn("e", F.get(entries, F.lit(0)))
        rows = rows.select(T.language_code("e.key", aliases).alias("language_code"), T.normalized_lemma("e.value.value").alias("l"), F.substring(F.coalesce("j.lexicalCategory", F.lit("")), 1, 80).alias("pos"), size(F.col("j.senses")).alias("senses"), size(F.col("j.forms")).alias("forms"), F.lit(0).alias("translations"), F.col("j.id").alias("external_id"))
    else:
        p = F.split(F.col(line), "\t")
        ok = F.size(p).between(3, 6) & (F.trim(p[0]) != "") & (F.trim(p[1]) != "") & (F.trim(p[2]) != "")
        rows = df.filter(ok).select(T.language_code(F.lit(language), aliases).alias("language_code"), T.normalized_lemma(p[0]).alias("l"), F.substring(F.substring_index(p[2], ";", 1), 1, 80).alias("pos"), F.lit(0).alias("senses"), F.lit(1).alias("forms"), F.lit(0).alias("translations"), none.alias("external_id"))
    return rows.filter(F.coalesce("l.key", F.lit("")) != "").select("language_code", F.col("l.lemma").alias("lemma"), F.col("l.key").alias("lemma_key"), "pos", "senses", "forms", "translations", "external_id")


def record_jar(spark: SparkSession, path: str) -> DataFrame:
    """(fields): records between %% lines as maps; repeated names are joined by '; '."""
    records = spark.read.option("lineSep", "%%\n").text(path)
    pairs = F.filter(F.split(F.regexp_replace("value", r"\n[ \t]+", " "), "\n"), lambda x: F.contains(x, F.lit(":")))
    rows = records.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.posexplode(pairs).alias("at", "x"))
    rows = rows.select("_id", "at", F.trim(F.substring_index("x", ":", 1)).alias("k"), F.trim(F.expr("substring(x, instr(x, ':') + 1)")).alias("v"))
    joined = rows.groupBy("_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]), "; ").alias("v"))
    return joined.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields")).drop("_id")


def trimmed_entries(df: DataFrame, column: str, senses: int = 250, forms: int = 1000) -> DataFrame:
    """Entries with at most some senses and forms, and whether any were cut."""
    j = F.from_json(column, "word string, lang_code string, pos string, senses array<string>, forms array<string>")
    rows = df.select(j.alias("j")).filter("j.word is not null")
    return rows.select("j.word", "j.lang_code", "j.pos", F.slice("j.senses", 1, senses).alias("senses"), F.slice("j.forms", 1, forms).alias("forms"), (F.coalesce(F.size("j.senses") > senses, F.lit(False)) | F.coalesce(F.size("j.forms") > forms, F.lit(False))).alias("cut"))


def claims_csv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) claims of a table with alternative headers; rejected rows carry their line."""
    pick = lambda *names: F.coalesce(*[F.col(c) for n in names for c in df.columns if c.lower() == n.lower()], F.lit(None).cast("string"))
    rows = df.select(T.concept_id(pick("concept", "unesco_id", "concept_id")).alias("concept_id"), T.entity_id(pick("item", "qid", "entity")).alias("qid"), *([F.col("_line")] if "_line" in df.columns else []))
    ok = F.col("concept_id").isNotNull() & F.col("qid").isNotNull()
    return rows.filter(ok), rows.filter(~ok)


_TURTLE = re.compile(r'\s*(?:(<[^>]*>|[A-Za-z_][\w.-]*:[\w.-]*|:[\w.-]+|a(?=\s))|("(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^\S+)?)|([;,.]))', re.DOTALL)


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """(s, p, o, kind, lang) of plain Turtle: prefixes, ; and , lists, literals with languages."""
    prefixes: dict[str, str] = {}
    text = re.sub(r"(?m)^\s*#.*$", "", text)
    for m in re.finditer(r"(?mi)^\s*@?prefix\s+([\w.-]*):\s*<([^>]*)>\s*\.?\s*$", text):
        prefixes[m[1]] = m[2]
    text = re.sub(r"(?mi)^\s*@?prefix\s+.*$", "", text)

    def iri(token: str) -> str:
        if token == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        if token[0] == "<":
            return token[1:-1]
        name, _, local = token.partition(":")
        return prefixes.get(name, name + ":") + local

    triples, s, p, at = [], None, None, 0
    while m := _TURTLE.match(text, at):
        at = m.end()
        if m[3]:
            s, p = (s, None) if m[3] == ";" else (s, p) if m[3] == "," else (None, None)
        elif m[2]:
            value = re.match(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+))?', m[2], re.DOTALL)
            triples.append((s, p, re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), value[1]), "literal", value[2]))
        elif s is None:
            s = iri(m[1])
        elif p is None:
            p = iri(m[1])
        else:
            triples.append((s, p, iri(m[1]), "iri", None))
    return triples


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples (s, p, o, kind, lang, file) of Turtle files, a task for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(*t, name) for t in parse_turtle(bytes(content).decode())], columns=["s", "p", "o", "kind", "lang", "file"])

    return files.mapInPandas(run, "s string, p string, o string, kind string, lang string, file string")


def labels_by_language(triples: DataFrame, predicate: str) -> DataFrame:
    """(s, labels): a map from language to sorted literals; literals without one are under ''."""
    rows = triples.filter((F.col("p") == predicate) & (F.col("kind") == "literal")).groupBy("s", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sort_array(F.collect_set("o")).alias("v"))
    return rows.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "v")))).alias("labels"))


def rewritten(triples: DataFrame, base: str) -> DataFrame:
    """Triples with subjects and objects moved below a base by their last path part, where they are subjects."""
    name = lambda c: F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_extract(c, r"([^/#]+)/?$", 1))
    own = triples.select(F.col("s").alias("o")).distinct().withColumn("_own", F.lit(True))
    out = triples.join(own, "o", "left")
    return out.select(name("s").alias("s"), "p", F.when((F.col("kind") == "iri") & F.coalesce("_own", F.lit(False)), name("o")).otherwise(F.col("o")).alias("o"), "kind", "lang")


def check_manifest(found: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): files that are missing, unexpected or of another digest."""
    both = expected.select(key, F.col(digest).alias("_e")).join(found.select(key, F.col(digest).alias("_f")), key, "full")
    problem = F.when(F.col("_f").isNull(), "MISSING").when(F.col("_e").isNull(), "UNEXPECTED").when(F.col("_e") != F.col("_f"), "CHANGED")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def concepts_of(branch: DataFrame) -> dict[str, DataFrame]:
    """Branches, concepts, aliases and relations of a branch JSON table."""
    c = branch.select("unesco_microthesaurus", F.explode("concepts").alias("c"))
    labels = lambda lang: F.get(F.try_element_at("c.preferred_labels", F.lit(lang)), F.lit(0))
    return {
        "branches": branch.select(F.col("unesco_microthesaurus").alias("branch_id"), F.size("concepts").alias("n_concepts")),
        "concepts": c.select(F.col("unesco_microthesaurus").alias("branch_id"), F.col("c.unesco_id").alias("concept_id"), labels("en").alias("label_en"), labels("fr").alias("label_fr")),
        "aliases": c.select(F.col("c.unesco_id").alias("concept_id"), F.explode("c.preferred_labels").alias("lang", "names")).select("concept_id", "lang", F.explode("names").alias("alias")),
        "broader": c.select(F.col("c.unesco_id").alias("concept_id"), F.explode("c.broader").alias("broader_id")),
    }


def valid_column(c: Column, pattern: str) -> Column:
    """A value where it matches a pattern as a whole, else null."""
    return F.when(c.rlike(f"^(?:{pattern})$"), c)
