"""Loading sources once: discovery, members, entities, branches, and resumable loads.

A source is a set of files below a folder that Spark lists. A load's unit is the
file: what a file gave is appended together with a receipt (size, time and
SHA-256), so that a load that broke off goes on with the files that have no
receipt, and a file that changed since is refused. Nothing half-read counts, as
Spark's commit protocol keeps the rows of failed attempts out.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import json
import lzma
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that are handed on at a time, and bytes that a member may unpack to.
CHUNK_LINES = 10_000
MOST_MEMBER_BYTES = 16 << 30
#: Bytes that are read at a time for a digest.
PIECE = 4 << 20


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all files below a folder, empty ones too; contents aren't read.

    The store lists them to the driver, a row a file, as Spark's own readers do.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, rows = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith((".", "_")):
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "path string, length long, t long").select("path", "length", F.timestamp_millis("t").alias("modified"))


def discovered(files: DataFrame, root: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, edition, path, relative, length, modified): source files by rules, each file once.

    A rule is (kind, pattern of the path below the root, edition): the edition is a replacement
    of the pattern, such as ``$1``. The first rule that fits a file counts.
    """
    relative = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    rows = files.dropDuplicates(["path"]).withColumn("relative", relative)
    fits = [F.when(F.col("relative").rlike(f"^(?:{p})$"), F.struct(F.lit(k).alias("kind"), F.regexp_replace("relative", f"^(?:{p})$", e).alias("edition"))) for k, p, e in rules]
    return rows.withColumn("_r", F.coalesce(*fits)).filter("_r is not null").select("_r.kind", "_r.edition", "path", "relative", "length", "modified")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def chosen_members(members: DataFrame, *, archive: str = "archive", member: str = "member", language: str = "language", size: str = "size", fallbacks: list[tuple[Column, str]] | None = None) -> DataFrame:
    """Rows of ``members`` that hold an archive's data, with ``format``.

    The member named like the language (or with .tsv), the shortest path first, is taken alone;
    without one, all members that a fallback (test on ``name`` and ``language``, format) accepts. Members
    outside the archive's folder are never taken; one that is too large is an error.
    """
    path = F.replace(F.col(member), F.lit("\\"), F.lit("/"))
    rows = members.withColumn("name", F.lower(F.substring_index(path, "/", -1))).withColumn("_lang", F.lower(language))
    rows = rows.filter(~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.endswith("/"))
    own = F.when(F.col("name") == F.col("_lang"), 0).when(F.col("name") == F.concat("_lang", F.lit(".tsv")), 1)
    ranked = rows.withColumn("_rank", F.when(own.isNotNull(), F.struct(own.alias("o"), F.length(member).alias("n"), F.col(member).alias("m"))))
    first = ranked.groupBy(archive).agg(F.min("_rank").alias("_first"))
    test = [F.when(condition, fmt) for condition, fmt in fallbacks or []]
    fmt = F.when(F.col("_first").isNotNull(), F.when(F.col("_first.m") == F.col(member), "tsv")).otherwise(F.coalesce(*test) if test else F.lit(None).cast("string"))
    taken = ranked.join(first, archive).withColumn("format", fmt).filter("format is not null")
    return taken.withColumn(size, F.when(F.col(size) <= MOST_MEMBER_BYTES, F.col(size)).otherwise(F.raise_error(F.lit("a member is too large")).cast("long"))).drop("name", "_lang", "_rank", "_first")


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, member, size) of ZIP files read as binaryFile (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    found = [m for m in z.infolist() if not m.is_dir()]
                yield pa.RecordBatch.from_pydict({"archive": [path] * len(found), "member": [m.filename for m in found], "size": pa.array([m.file_size for m in found], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "archive string, member string, size long")


def member_lines(files: DataFrame, members: DataFrame) -> DataFrame:
    """(archive, member, format, line_no, line) of chosen members, streamed in pieces.

    ``members``: archive, member, format (tsv, csv, xz). A member that isn't what it says, or is
    cut off, is an error.
    """
    lists = members.groupBy(F.col("archive").alias("path")).agg(F.sort_array(F.collect_list(F.struct("member", "format"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for entry in wanted:
                        with z.open(entry["member"]) as raw:
                            yield from _pieces(path, entry["member"], entry["format"], lzma.LZMAFile(raw) if entry["format"] == "xz" else raw)

    return files.select("path", "content").join(lists, "path").mapInArrow(run, "archive string, member string, format string, line_no long, line string")


def _pieces(path: str, member: str, fmt: str, stream) -> Iterator[pa.RecordBatch]:
    lines, first, size = [], 1, 0

    def piece() -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_pydict({"archive": [path] * n, "member": [member] * n, "format": [fmt] * n, "line_no": pa.array(range(first, first + n), pa.int64()), "line": lines})

    for raw in stream:
        size += len(raw)
        if size > MOST_MEMBER_BYTES:
            raise ValueError(f"{path}: {member} unpacks to too much")
        lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
        if len(lines) == CHUNK_LINES:
            yield piece()
            lines, first = [], first + CHUNK_LINES
    if lines:
        yield piece()


def text_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(archive, member, format, line) of plain, gzip or bzip2 files of JSON lines; Spark unpacks by the name's end."""
    paths = [r["path"] for r in files.select("path").collect()]
    schema = "archive string, member string, format string, line string"
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("archive"), F.lit("").alias("member"), F.lit("jsonl").alias("format"), F.col("value").alias("line"))


def entities(lines: DataFrame, wanted: DataFrame | None = None, column: str = "line") -> DataFrame:
    """(qid, entity) of entity JSON, one a line (with or without the commas and brackets of an array).

    Lines that are no entity are left out; with ``wanted`` (qid) only those.
    """
    body = F.regexp_replace(F.trim(F.regexp_replace(column, "^﻿", "")), ",$", "")
    rows = lines.select(F.get_json_object(body, "$.id").alias("qid"), body.alias("entity")).filter(F.col("qid").rlike("^Q[1-9][0-9]*$") & F.col("entity").startswith("{"))
    return rows if wanted is None else rows.join(wanted.select("qid").distinct(), "qid", "left_semi")


def entity_files(spark: SparkSession, source: str) -> list[str]:
    """The files of an entity source: a file of JSON lines, or the parts that a folder's snapshot-manifest.json names."""
    if source.endswith((".jsonl", ".jsonl.gz", ".json.gz", ".json.bz2")):
        return [source]
    manifest = spark.read.text(f"{source}/snapshot-manifest.json", wholetext=True).first()[0]
    parts = spark.createDataFrame([(manifest,)], "m string").select(F.from_json("m", "parts array<struct<file: string>>").alias("j")).first()["j"]
    if parts is None or parts["parts"] is None:
        raise ValueError("a manifest without parts")
    names = [p["file"] or "" for p in parts["parts"]]
    bad = [n for n in names if not re.fullmatch(r"part-\d+\.jsonl\.gz", n)]
    if bad:
        raise ValueError(f"names that aren't parts: {bad[:3]}")
    return [f"{source}/{n}" for n in names]


def fingerprint(files: DataFrame) -> str:
    """A digest of names, sizes and times of files: what changes when a source does."""
    rows = files.select(F.sha2(F.concat_ws("|", "path", "length", F.col("modified").cast("string")), 256).alias("h"))
    # A sum of digests as numbers is free of order and combined before the shuffle.
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    return hashlib.sha256("|".join(map(str, found)).encode()).hexdigest()


def new_epoch(epoch: str, stored: str | None, jobs: DataFrame, status: str = "status", open_: tuple[str, ...] = ("READY", "SENT")) -> bool:
    """Whether a source has changed, so that cursors start again; refused while jobs are open."""
    if stored == epoch:
        return False
    if not jobs.filter(F.col(status).isin(*open_)).isEmpty():
        raise ValueError("the source has changed while jobs are open: end or cancel them first")
    return True


def digests(files: DataFrame) -> DataFrame:
    """``files`` with ``sha256`` of their bytes, read in pieces by any store that pyarrow opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
                own = hashlib.sha256()
                with store.open_input_stream(at, compression=None) as stream:
                    while piece := stream.read(PIECE):
                        own.update(piece)
                found.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "sha256"])

    return files.join(files.select("path").mapInArrow(run, "path string, sha256 string"), "path")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def load_stage(spark: SparkSession, files: DataFrame, stage: str, store: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """Load what has no receipt yet; returns the receipts (stage, path, length, modified, sha256, rows).

    ``read`` gives the rows of one file and raises on a broken one; rows go to ``store/rows`` in a
    folder of the file's digest, which is written anew if an earlier run broke off before the
    receipt. An empty file, and one whose size, time or digest isn't that of its receipt, are
    refused before anything is written. A stage that is complete changes nothing.
    """
    schema = "stage string, path string, length long, modified timestamp, sha256 string, rows long"
    receipts = _table(spark, f"{store}/receipts", schema).filter(F.col("stage") == stage)
    known = receipts.select("path", F.col("length").alias("_l"), F.col("modified").alias("_m"), F.col("sha256").alias("_s"))
    now = files.select("path", "length", "modified").join(known, "path", "full")
    changed = now.filter(F.col("length").isNull() | F.col("_l").isNotNull() & ((F.col("length") != F.col("_l")) | (F.col("modified") != F.col("_m")))).select("path").limit(5).collect()
    if changed:
        raise ValueError(f"changed or gone since they were loaded: {[r[0] for r in changed]}; load into a fresh store")
    empty = now.filter("length = 0").select("path").limit(5).collect()
    if empty:
        raise ValueError(f"empty files: {[r[0] for r in empty]}")
    for r in digests(now.filter("_l is null").select("path", "length", "modified")).orderBy("path").collect():
        target = f"{store}/rows/stage={stage}/source={r['sha256'][:32]}"
        read(r["path"]).write.mode("overwrite").parquet(target)
        count = spark.read.parquet(target).count()
        spark.createDataFrame([(stage, r["path"], r["length"], r["modified"], r["sha256"], count)], schema).write.mode("append").parquet(f"{store}/receipts")
    return _table(spark, f"{store}/receipts", schema).filter(F.col("stage") == stage)


def loaded(spark: SparkSession, stage: str, store: str) -> DataFrame:
    """The rows of a stage from files with receipts, with ``source``, the file's digest."""
    done = _table(spark, f"{store}/receipts", "stage string, path string, length long, modified timestamp, sha256 string, rows long").filter(F.col("stage") == stage)
    rows = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows/stage={stage}").drop("stage")
    return rows.withColumn("source", F.col("source").cast("string")).join(done.select(F.substring("sha256", 1, 32).alias("source")).distinct(), "source", "left_semi")


def member_offsets(index: DataFrame, length: int, column: str = "value") -> DataFrame:
    """(page_id, title, start, size) from lines ``offset:id:title`` of a multistream index.

    Members end where the next begins; the ends come from the different offsets, dealt by range.
    """
    parts = F.split(column, ":", 3)
    rows = index.select(F.get(parts, F.lit(0)).cast("long").alias("start"), F.get(parts, F.lit(1)).cast("long").alias("page_id"), F.get(parts, F.lit(2)).alias("title")).filter("start is not null and page_id is not null")
    from tidewright.operators.ranking import ranked

    starts = ranked(rows.select("start").distinct(), [F.asc("start")], "k")
    ends = starts.select((F.col("k") - 1).alias("k"), F.col("start").alias("end"))
    sized = starts.join(ends, "k", "left").select("start", (F.coalesce("end", F.lit(length)) - F.col("start")).alias("size"))
    return rows.join(sized, "start").select("page_id", "title", "start", "size")


def read_members(members: DataFrame, path: str) -> DataFrame:
    """(start, text) of bzip2 members (start, size) of a dump: each is read and unpacked alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as file:
            for batch in batches:
                for start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    file.seek(start)
                    unpacker = bz2.BZ2Decompressor()
                    text = unpacker.decompress(file.read(size))
                    if not unpacker.eof:
                        raise ValueError(f"the member at {start} is cut off")
                    yield pa.RecordBatch.from_pydict({"start": [start], "text": [text.decode("utf-8", "replace")]})

    return members.select("start", "size").distinct().mapInArrow(run, "start long, text string")


# States of bridges, the schema's bounds, and the columns that bridges have.
BRIDGE_STATES = ("ACTIVE_REVIEWED_AI", "PROPOSED_NOT_ACTIVE")
BRIDGE_COLUMNS = ("concept_id", "category_title", "status", "justification", "depth_limit")
BOUNDS = {"auto_root_depth": (0, 2), "max_reviewed_root_depth": (0, 5), "max_category_tasks": (1, 2_000_000), "max_members_per_category": (20, 5_000_000)}
MOST_CONCEPTS = 50_000


def _refuse(rows: DataFrame, what: str, column: str) -> None:
    found = [r[0] for r in rows.select(column).limit(5).collect()]
    if found:
        raise ValueError(f"{what}: {found}")


def checked_branch(spec: dict, concepts: DataFrame, mappings: DataFrame | None = None, bridges: DataFrame | None = None, *, part: str | None = None) -> dict[str, DataFrame]:
    """A branch's tables after strict checks: concepts, qids (concept_id, qid) and active bridges.

    ``spec`` is the manifest (branch_id, vocabulary, discovery); concepts have ``concept_id``; mappings
    mapping_id, status, system and id; bridges the columns of ``BRIDGE_COLUMNS``. Whatever breaks a rule
    is an error that names up to five offenders; mappings that are no candidates are left out.

    A branch has at most ``MOST_CONCEPTS`` concepts. ``part`` names a column of all tables that deals them
    over branches of one manifest: these are checked together, each by all rules, and keep the column.
    """
    safe = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,119}$"
    for name in ("branch_id", "vocabulary"):
        if not re.fullmatch(safe, str(spec.get(name) or "")):
            raise ValueError(f"no valid {name}")
    limits = spec.get("discovery") or {}
    if not isinstance(limits.get("auto_exact_category_roots"), bool) or any(not low <= int(limits.get(k, -1)) <= high for k, (low, high) in BOUNDS.items()):
        raise ValueError(f"bounds of discovery: {limits}")
    parts = [part] if part else []
    key = [*parts, "concept_id"]
    if concepts.isEmpty() or not concepts.groupBy(*parts).count().filter(F.col("count") > MOST_CONCEPTS).isEmpty():
        raise ValueError("no concepts, or too many")
    _refuse(concepts.filter(~F.coalesce(F.col("concept_id").rlike(safe), F.lit(False))), "concepts without a valid id", "concept_id")
    _refuse(concepts.groupBy(*key).count().filter("count > 1"), "repeated concepts", "concept_id")
    spark = concepts.sparkSession
    ids = concepts.select(*key)
    own_part = [f"{part} {ids.schema[part].dataType.simpleString()}"] if part else []
    qids = spark.createDataFrame([], ", ".join([*own_part, "concept_id string, qid string"]))
    if mappings is not None:
        own = mappings.select(*parts, F.regexp_extract("mapping_id", r"^wd-p3916-(concept\d+)$", 1).alias("concept_id"), F.col("id").alias("qid"), "status", "system")
        qids = own.filter("status = 'candidate' and system = 'wikidata'").filter(F.col("qid").rlike("^Q[1-9][0-9]*$")).join(ids, key, "left_semi").select(*key, "qid").distinct()
    active = spark.createDataFrame([], ", ".join([*own_part, "concept_id string, category_title string, justification string, depth int"]))
    if bridges is not None:
        missing = [c for c in BRIDGE_COLUMNS if c not in bridges.columns]
        if missing:
            raise ValueError(f"bridges lack the columns {missing}")
        rows = bridges.select(*parts, *[F.trim(c).alias(c) for c in BRIDGE_COLUMNS])
        from tidewright.operators.filters import topic_category

        _refuse(rows.join(ids, key, "left_anti"), "bridges of unknown concepts", "concept_id")
        _refuse(rows.filter(~F.coalesce(topic_category("category_title"), F.lit(False))), "bridges to no topic", "category_title")
        _refuse(rows.groupBy(*key, "category_title").count().filter("count > 1"), "repeated bridges", "category_title")
        _refuse(rows.filter(~F.coalesce(F.col("status").isin(*BRIDGE_STATES), F.lit(False))), "unknown states of bridges", "status")
        live = rows.filter(F.col("status") == BRIDGE_STATES[0]).withColumn("depth", F.col("depth_limit").try_cast("int"))
        good = (F.length("justification") >= 15) & F.col("depth").between(0, int(limits["max_reviewed_root_depth"]))
        _refuse(live.filter(~F.coalesce(good, F.lit(False))), "bridges that aren't qualified", "category_title")
        active = live.select(*key, "category_title", "justification", "depth")
    return {"concepts": concepts, "qids": qids, "bridges": active}


def read_branch(spark: SparkSession, folder: str, manifest: str = "branch.json") -> dict[str, DataFrame]:
    """``checked_branch`` of a manifest and the files that it names, which must lie below its folder."""


    spec = json.loads(spark.read.text(f"{folder}/{manifest}", wholetext=True).first()[0].lstrip("﻿"))
    names = {k: spec.get(k) for k in ("concepts_file", "crosswalk_file", "bridges_file")}
    for name in filter(None, names.values()):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"a file outside the folder: {name}")
    if not names["concepts_file"]:
        raise ValueError("no concepts_file")
    whole = lambda schema, name: spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(f"{folder}/{name}")
    concepts = whole("concepts array<struct<unesco_id: string, preferred_labels: map<string, array<string>>, broader: array<string>>>", names["concepts_file"]).select(F.explode("concepts").alias("c")).select(F.col("c.unesco_id").alias("concept_id"), "c.preferred_labels", "c.broader")
    mappings = bridges = None
    if names["crosswalk_file"]:
        mappings = whole("mappings array<struct<mapping_id: string, status: string, external_ref: struct<system: string, id: string>>>", names["crosswalk_file"]).select(F.explode("mappings").alias("m")).select("m.mapping_id", "m.status", "m.external_ref.system", "m.external_ref.id")
    if names["bridges_file"]:
        bridges = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{folder}/{names['bridges_file']}")
    return checked_branch(spec, concepts, mappings, bridges)
