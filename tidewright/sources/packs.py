"""Packs: ZIP files of a bounded selection, and exports of nested records."""

from __future__ import annotations

import hashlib
import io
import json
import re
import stat
import zipfile
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FILES = 20
MOST_BYTES = 64 << 20


def _number(value: float) -> str:
    """A number as ECMAScript writes it, which RFC 8785 asks for."""
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError("numbers must be finite")
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(value))).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if len(digits) <= point <= 21:
        text = text + "0" * (point - len(digits))
    elif 0 < point <= 21:
        text = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        text = f"0.{'0' * -point}{text}"
    else:
        text = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{point - 1:+d}"
    return "-" + text if sign else text


def canonical(value: object) -> str:
    """Canonical JSON (RFC 8785): keys by UTF-16 code units, no spaces, numbers as ECMAScript writes them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(value[k])}" for k in sorted(value, key=lambda k: str(k).encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value) if isinstance(value, int) and abs(value) < 1 << 53 else _number(value)
    return json.dumps(value, ensure_ascii=False)


def commitment(value: object, domain: str) -> str:
    """SHA-256 of canonical JSON, kept apart by a domain."""
    return hashlib.sha256(domain.encode() + b"\0" + canonical(value).encode()).hexdigest()


def fact_key(fact: dict, without: tuple[str, ...] = ("source_quote", "source_locator", "concept_ids", "supersedes"), prefix: str = "PROP2_") -> str:
    """The key of a fact: what it says, not where it was found."""
    return prefix + hashlib.sha256(canonical({k: v for k, v in fact.items() if k not in without}).encode()).hexdigest()[:40]


def claim_key(subject: Column, predicate: Column, kind: Column, value: Column, prefix: str = "CAND-KA-") -> Column:
    """The key of a claim: 32 digits of the SHA-256 of its sorted, indented JSON; white space of the object counts once.

    The JSON is put together from columns, so the key needs no Python on the executors.
    """
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    squeezed = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    fields = {"object_type": kind, "object_value": squeezed, "predicate": predicate, "subject_ref": subject}
    lines = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{name}": '), text(c)) for name, c in sorted(fields.items())])
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("{\n"), lines, F.lit("\n}\n")), 256), 1, 32))


def zip_pack(items: dict[str, bytes]) -> bytes:
    """A ZIP with a manifest of sizes and digests; the same bytes for the same items."""
    manifest = {n: {"bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()} for n, d in sorted(items.items())}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [("manifest.json", json.dumps(manifest, sort_keys=True).encode()), *sorted(items.items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def read_reply(data: bytes, allowed: str = r"[A-Za-z0-9][A-Za-z0-9._-]*", most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> dict[str, bytes]:
    """Members of a reply ZIP by name. Names must fit ``allowed`` whole, which leaves out folders, links to
    elsewhere and hidden files; the reader itself stops at the caps, whatever sizes the ZIP declares."""
    found: dict[str, bytes] = {}
    left = most_bytes
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for member in z.infolist():
            if len(found) == most_files:
                raise ValueError(f"more than {most_files} members")
            if not re.fullmatch(allowed, member.filename) or stat.S_ISLNK(member.external_attr >> 16):
                raise ValueError(f"a member that isn't allowed: {member.filename!r}")
            if member.filename in found:
                raise ValueError(f"a member twice: {member.filename!r}")
            with z.open(member) as stream:
                content = stream.read(left + 1)
            left -= len(content)
            if left < 0:
                raise ValueError(f"more than {most_bytes} bytes")
            found[member.filename] = content
    return found


def replaced(data: bytes, name: str, content: bytes) -> bytes:
    """The pack with another member of that name, under the old manifest."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for member in old.infolist():
            new.writestr(member, content if member.filename == name else old.read(member))
    return out.getvalue()


def verify_pack(data: bytes) -> list[str]:
    """What is wrong with a pack: members against its manifest."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        manifest = json.loads(z.read("manifest.json"))
        there = {n: z.read(n) for n in z.namelist() if n != "manifest.json"}
    bad = [f"missing {n}" for n in manifest if n not in there] + [f"unexpected {n}" for n in there if n not in manifest]
    return bad + [f"changed {n}" for n, m in manifest.items() if n in there and hashlib.sha256(there[n]).hexdigest() != m["sha256"]]


def planned_packs(df: DataFrame, pack: str, name: str, content: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``part``: files of a pack in the order of their names, dealt to parts that stay within the caps.

    A pack's files are cut by running count and bytes: part k holds those whose sums, in steps of half a
    cap, fall into step k. So the parts of a pack of any size are bounded, but for a single larger file.
    Running sums come by range partitions, not from one task a pack.
    """
    from tidewright.operators.ranking import ranked

    size = F.octet_length(content)
    rows = ranked(df.withColumn("_bytes", size), [F.asc(pack), F.asc(name)], "_k", {"_before": F.col("_bytes")})
    first = rows.groupBy(pack).agg(F.min("_k").alias("_k0"), F.min("_before").alias("_b0"))
    step = lambda value, cap: F.floor(value / max(1, cap // 2))
    placed = rows.join(first, pack).withColumn("_at", F.struct(step(F.col("_k") - F.col("_k0"), most_files).alias("n"), step(F.col("_before") - F.col("_b0"), most_bytes).alias("b")))
    # Steps of both kinds, numbered together: their sum grows with either.
    return placed.withColumn("part", (F.col("_at.n") + F.col("_at.b")).cast("int")).drop("_bytes", "_k", "_before", "_k0", "_b0", "_at")


def packed(df: DataFrame, pack: str, name: str, content: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(pack, part, members, bytes, zip): the files of each pack as ZIPs that stay within the caps."""
    kind = df.schema[pack].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = zip_pack({n: c.encode() for n, c in zip(pdf[name], pdf[content], strict=True)})
        return pd.DataFrame({pack: [pdf[pack].iloc[0]], "part": [pdf["part"].iloc[0]], "members": [len(pdf)], "bytes": [len(data)], "zip": [data]})

    planned = planned_packs(df.select(pack, name, content), pack, name, content, most_files, most_bytes)
    return planned.groupBy(pack, "part").applyInPandas(run, f"{pack} {kind}, part int, members int, bytes long, zip binary")


def article_packs(df: DataFrame, pack: str, priority: str, reference: str, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(pack, part, articles, zip): packs of page_id, revision_id, title and text, with all that an answer needs.

    A pack holds the whole texts, a reading guide (a line an article), an empty delta that names the pack, and
    the manifest of all their digests.
    """
    from tidewright.sources.html import guide

    kind = df.schema[pack].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id")
        name = f"{key[0]}-{key[1]:06d}"
        texts = {f"{r.page_id}.txt": (r.text or "").encode() for r in pdf.itertuples()}
        lines = [{"page_id": int(r.page_id), "revision_id": str(r.revision_id), "title": r.title, "text_sha256": hashlib.sha256((r.text or "").encode()).hexdigest(), **guide(r.text or "", priority, reference)} for r in pdf.itertuples()]
        delta = {"pack_id": name, "claims": [], "coverage_note": "", "canonical_admissions": 0, "publication_authorized": False}
        data = zip_pack(texts | {"guide.jsonl": "".join(json.dumps(x, ensure_ascii=False, sort_keys=True) + "\n" for x in lines).encode(), "delta.json": json.dumps(delta, sort_keys=True).encode()})
        return pd.DataFrame({pack: [key[0]], "part": [key[1]], "articles": [len(pdf)], "zip": [data]})

    rows = df.select(pack, "page_id", "revision_id", "title", "text").withColumn("_name", F.lpad(F.col("page_id").cast("string"), 20, "0"))
    planned = planned_packs(rows.withColumn("_text", F.coalesce("text", F.lit(""))), pack, "_name", "_text", most_files, most_bytes).drop("_name", "_text")
    return planned.groupBy(pack, "part").applyInPandas(run, f"{pack} {kind}, part int, articles int, zip binary")


def verified_packs(df: DataFrame, pack: list[str], data: str = "zip") -> DataFrame:
    """(pack, problem): what is wrong with each pack; none for good ones."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in pack)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, content in batch.itertuples(index=False, name=None):
                try:
                    rows += [(*key, problem) for problem in verify_pack(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ValueError) as broken:
                    rows.append((*key, f"unreadable: {type(broken).__name__}"))
            yield pd.DataFrame(rows, columns=[*pack, "problem"])

    return df.select(*pack, data).mapInPandas(run, f"{kinds}, problem string")


def nested(base: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Base rows with each child table's rows as a sorted array of structs (empty where there are none)."""
    out = base
    for name, (table, columns) in children.items():
        lists = table.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        kind = lists.schema[name].dataType
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def export_jsonl(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write JSON lines (a folder for each value of ``by``); returns (file, lines, sha256). Lines lost on the way are an error."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)
    spark = df.sparkSession
    lines = spark.read.text(path, recursiveFileLookup=True).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    found = files.join(lines, F.substring_index(files["path"], "/", -2) == F.substring_index(lines["path"], "/", -2)).select(files["path"].alias("file"), "lines", "sha256")
    written = found.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    if written != df.count():
        raise ValueError(f"{written} lines were written")
    return found


def fallible_union(parts: dict[str, DataFrame | Exception], columns: str) -> DataFrame:
    """Rows of several sources with their name; a source that failed is a row with its error."""
    spark = next(p.sparkSession for p in parts.values() if isinstance(p, DataFrame))
    out = spark.createDataFrame([(n, str(p)) for n, p in parts.items() if isinstance(p, Exception)], "source string, error string")
    for name, p in parts.items():
        if isinstance(p, DataFrame):
            out = out.unionByName(p.selectExpr(columns).withColumns({"source": F.lit(name), "error": F.lit(None).cast("string")}), allowMissingColumns=True)
    return out
