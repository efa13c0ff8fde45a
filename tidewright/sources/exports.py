"""Exports that appear whole or not at all: sorted JSON lines, a manifest of digests, then one rename.

Every table is written in its order, dealt by range over files of bounded rows.
The manifest holds each file's rows, bytes and SHA-256. All is written to a folder
beside the final one, which is renamed last; where the final folder is there
already, it is verified and returned unchanged.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000
MANIFEST = "manifest.json"


def _store(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed, so that no one reads half of it."""
    store, final = _store(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = store.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if store.exists(final):
        store.delete(final, False)
    if not store.rename(part, final):
        raise OSError(f"{path} could not be put in place")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the data files below a folder, by names below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    name = F.substring_index("path", "/", -2)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_export(spark: SparkSession, folder: str) -> dict:
    """The manifest of an export whose files all are what it says; others are an error."""
    info = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    there = {r["file"]: [r["bytes"], r["sha256"]] for r in file_digests(spark, folder).collect()}
    if there != info["files"]:
        wrong = sorted(k for k in there.keys() | info["files"].keys() if there.get(k) != info["files"].get(k))
        raise ValueError(f"files that aren't what the manifest says: {wrong[:5]}")
    return info


def export_store(tables: dict[str, tuple[DataFrame, list[str]]], folder: str, **facts) -> dict:
    """Write tables (with the columns they are sorted by) as JSON lines below ``folder``; returns the manifest.

    ``facts`` come into the manifest. Nulls are written, keys are in the order of the columns' names.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    store, final = _store(spark, folder)
    if store.exists(final):
        return verify_export(spark, folder)
    part = f"{folder}.{uuid.uuid4().hex}.part"
    counts = {}
    for name, (df, order) in tables.items():
        line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        sorted_ = df.orderBy(*order).select(line.alias("value"))
        sorted_.write.option("maxRecordsPerFile", MOST_ROWS).text(f"{part}/{name}")
        counts[name] = spark.read.text(f"{part}/{name}").count()
    info = {"facts": facts, "rows": counts, "files": {r["file"]: [r["bytes"], r["sha256"]] for r in file_digests(spark, part).collect()}}
    write_whole(spark, f"{part}/{MANIFEST}", json.dumps(info, sort_keys=True))
    if not store.rename(_store(spark, part)[1], final):
        raise OSError(f"{folder} could not be put in place")
    return verify_export(spark, folder)


def snapshot(tables: dict[str, tuple[DataFrame, list[str]]], root: str, version: int) -> dict:
    """Export number ``version`` below ``root``, and ``latest.json`` that names it once it is verified."""
    spark = next(iter(tables.values()))[0].sparkSession
    name = f"{version:010d}"
    info = export_store(tables, f"{root}/{name}", version=version)
    write_whole(spark, f"{root}/latest.json", json.dumps({"version": version, "folder": name}))
    return info


def read_latest(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A table of the latest snapshot."""
    name = json.loads(spark.read.text(f"{root}/latest.json", wholetext=True).first()[0])["folder"]
    return spark.read.schema(schema).json(f"{root}/{name}/{table}")
