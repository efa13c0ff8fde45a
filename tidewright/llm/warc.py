"""WARC archives, compressed by record with a shared Zstandard dictionary.

An archive is a sequence of Zstandard frames, one for each record, after a
leading skippable frame (magic 0x184D2A5D) that holds the dictionary. So each
record can be read alone by its offset and still profits from what records
have in common, which compressing records one by one otherwise loses.

* The dictionary is trained on at most ``DICT_SAMPLES`` records of at most
  ``DICT_RECORD_BYTES`` bytes each (the record of smallest hash in each of as
  many hash buckets): bounded, the same at every size and order of the input.
* Records with equal payloads of at least ``min_revisit_bytes`` bytes: the one
  with the largest id is a response, the others are revisits that refer to it
  and hold no payload. Payload digests are counted with map-side combination;
  digests met twice are joined back on a salted key, so that a payload that
  every third page has is dealt over all tasks. Records are compressed before
  that join, so only compressed records are shuffled, once.
* Archives are files, each closed at ``archive_bytes`` of compressed records and
  written by the task that made it, below ``uri``: any store that pyarrow opens,
  by default the session's shared folder. Names carry the task attempt, and the
  returned table lists the files of the attempts that Spark accepted; so a lost
  executor leaves a file that nothing reads, and no record twice.
* ``read_archives`` reads listed files with Spark's ``binaryFile`` source, parses
  every record, and checks its lengths and its payload's digest.

Defined results: a null payload is empty; payloads of any length up to Spark's
2 GB a row are one record; ids are unique where revisits are to refer to one
record (rows that repeat the largest id of a group are all responses); a null id
is written as such and read back as null, and is never referred to where another
id has the payload; an empty table gives no archives; other columns are ignored,
whatever their names. A null url is left out of the record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.scratch import Scratch
from tidewright.llm.worker import drop, slices

SKIPPABLE_MAGIC = 0x184D2A5D
DICT_SAMPLES = 256
DICT_RECORD_BYTES = 64 << 10
DICT_BYTES = 110 << 10
ARCHIVE_BYTES = 8 << 20
SALTS = 32
#: Bytes that are decompressed at a time.
PIECE = 32 << 10
#: A list of so many names (a few MB) is broadcast, a longer one is joined.
MOST_BROADCAST = 50_000
#: Every record carries this date, so that equal inputs give equal archives.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, digest: bytes, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), payload and the HTTP length of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    found = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = rest[: int(found["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length"))
    return found | {"payload": payload, "http_length": length}


def train_dictionary(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str) -> bytes:
    """A dictionary from a bounded sample of records; empty if there are too few."""
    import zstandard

    if not DICT_SAMPLES:
        return b""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    small = pages.filter(F.octet_length(payload) <= DICT_RECORD_BYTES)
    hashed = small.select(F.xxhash64(F.lit("dictionary"), id_col).alias("h"), F.col(id_col).alias("id"))
    picked = hashed.groupBy(F.pmod("h", F.lit(DICT_SAMPLES))).agg(F.min(F.struct("h", "id")).alias("m")).select("m.id").collect()
    ids = [r["id"] for r in picked if r["id"] is not None]
    rows = small.filter(F.col(id_col).isin(ids)).select(id_col, url_col, payload.alias("p")).groupBy(id_col).agg(F.min(F.struct(url_col, "p")).alias("m")).select(id_col, "m.*").orderBy(id_col).collect() if ids else []
    samples = [record(r[0], r[1], hashlib.sha1(r[2]).digest(), len(r[2]), bytes(r[2]), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _qualified(spark, folder: str) -> str:
    """``folder`` as a URI that names its store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def write_archives(pages: DataFrame, uri: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write the archives below ``uri``; returns archive string (its URI), records long, bytes long."""
    scratch = Scratch(pages.sparkSession, "warc")
    uri = _qualified(pages.sparkSession, uri or f"{scratch.folder}/archives")
    dictionary = train_dictionary(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = rows.select("id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("size") >= min_revisit_bytes)
    twice = digests.groupBy("digest").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def packer():
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop()
        compress = packer().compress
        for batch in slices(batches, 256):
            own, frames = [], []
            for at, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.append(hashlib.sha1(payload).digest())
                frames.append(compress(record(at, url, own[-1], len(payload), payload, None)))
            size = pc.binary_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary()), size, pa.array(frames, pa.binary())], ["id", "url", "digest", "size", "frame"])

    packed = rows.mapInArrow(pack, "id long, url string, digest binary, size long, frame binary")
    spread = F.xxhash64("id", "url", "digest")
    salted = packed.withColumn("salt", F.when(F.col("size") >= min_revisit_bytes, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(-1 - F.pmod(spread, F.lit(1 << 20)).cast("int")))
    marked = salted.join(twice, ["digest", "salt"], "left").select("id", "url", "digest", "size", "frame", F.when(~F.col("target").eqNullSafe(F.col("id")), F.col("target")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        compress = packer().compress
        lead = struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary
        frames, size, number = [], 0, 0

        def closed() -> pa.RecordBatch:
            name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(lead)
                for frame in frames:
                    out.write(frame)
            return pa.RecordBatch.from_pydict({"archive": [f"{uri}/{name}"], "records": pa.array([len(frames)], pa.int64()), "bytes": pa.array([len(lead) + size], pa.int64())})

        for batch in slices(batches):
            for at, url, digest, length, frame, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(frame if target is None else compress(record(at, url, digest, length, None, target)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield closed()
                    frames, size, number = [], 0, number + 1
        if frames:
            yield closed()

    return scratch.save(marked.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of the listed archives; digests are taken from the payload and checked."""
    spark = archives.sparkSession
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    folders = [r[0] for r in archives.select(F.regexp_extract("archive", "^(.*)/[^/]*$", 1)).distinct().collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    listed = archives.select(F.regexp_extract("archive", "([^/]*)$", 1).alias("name"))
    files = spark.read.format("binaryFile").load(folders).select(name.alias("name"), "content").join(F.broadcast(listed) if archives.count() <= MOST_BROADCAST else listed, "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found: list[tuple] = []
                for text in frames_of(memoryview(content.as_buffer())):
                    found.append(_row(parse_record(text)))
                    if len(found) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], _NAMES)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], _NAMES)

    return files.select("content").mapInArrow(read, schema)


def frames_of(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, one after another; the file is fed in pieces, so that a record costs its own length."""
    import zstandard

    magic, length = struct.unpack_from("<II", data)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    shared = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + length])) if length else None
    unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    at = 8 + length
    while at < len(data):
        stream, parts = unpacker.decompressobj(), []
        while not stream.eof:
            if at >= len(data):
                raise ValueError("a record that is cut off")
            parts.append(stream.decompress(data[at : at + PIECE]))
            at += len(data[at : at + PIECE]) - len(stream.unused_data)
        yield b"".join(parts)


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _row(found: dict) -> tuple:
    digest = base64.b32decode(found["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = found["warc-type"] == "revisit"
    if not revisit and (hashlib.sha1(found["payload"]).hexdigest() != digest or len(found["payload"]) != found["http_length"]):
        raise ValueError(f"page {found.get('x-page-id')}: its payload isn't what was archived")
    target = int(found["x-refers-to-page-id"]) if revisit else None
    return int(found["x-page-id"]) if "x-page-id" in found else None, found.get("warc-target-uri"), found["http_length"], digest, found["warc-type"], target, None if revisit else found["payload"]
