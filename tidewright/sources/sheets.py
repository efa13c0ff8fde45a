"""Spreadsheets (XLSX) as tables: a sheet with a header row, and columns that may not be changed.

Workbooks are small files at the edge: each is made or read by one task as a
whole, with a bound on its rows. What an import changes is decided by the row
actions of ``operators.joins`` (new, changed, missing, protected columns).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a workbook, and bytes that its parts may unpack to.
MOST_ROWS = 100_000
MOST_BYTES = 256 << 20
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(name: str) -> int:
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def write_workbook(header: list[str], rows: list[tuple], protected: tuple[str, ...] = (), sheet: str = "rows") -> bytes:
    """A workbook with one sheet: text cells, and numbers for numbers; protected columns and the header are locked."""

    def cell(r: int, c: int, value: object, locked: bool) -> str:
        at = f'r="{column_name(c)}{r}" s="{0 if locked else 1}"'
        if value is None:
            return f"<c {at}/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 1 << 53 and value == value:
            return f"<c {at}><v>{value!r}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'

    lines = ["".join(cell(1, c, name, True) for c, name in enumerate(header))]
    lines += ["".join(cell(r, c, value, header[c] in protected) for c, value in enumerate(row)) for r, row in enumerate(rows, 2)]
    body = "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf applyProtection="1"><protection locked="0"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData><sheetProtection sheet="1"/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_workbook(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as texts, the header first; formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(m.file_size for m in z.infolist()) > MOST_BYTES:
            raise ValueError("a workbook that is too large")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(first) as stream:
            for n, (_, row) in enumerate((e for e in ElementTree.iterparse(stream) if e[1].tag == f"{{{_MAIN}}}row")):
                if n > MOST_ROWS:
                    raise ValueError(f"more than {MOST_ROWS} rows")
                cells: dict[int, str | None] = {}
                for i, c in enumerate(row.iter(f"{{{_MAIN}}}c")):
                    value = c.find(f"{{{_MAIN}}}v")
                    text = None if value is None else value.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
                    cells[column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else i] = text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def workbooks(df: DataFrame, by: str, columns: list[str], protected: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, workbook): a workbook for each value of ``by``, rows sorted by the columns.

    A value with more than ``MOST_ROWS`` rows is an error, found before any workbook is made.
    """
    large = df.groupBy(by).count().filter(F.col("count") > MOST_ROWS).limit(3).collect()
    if large:
        raise ValueError(f"more than {MOST_ROWS} rows: {[r[0] for r in large]}")
    kind = df.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[columns].astype(object).where(pdf[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str))
        data = write_workbook(columns, [tuple(r) for r in rows.itertuples(index=False)], protected)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "rows": [len(pdf)], "workbook": [data]})

    return df.select(by, *[c for c in columns if c != by]).groupBy(by).applyInPandas(run, f"`{by}` {kind}, rows long, workbook binary")


def sheet_rows(df: DataFrame, key: str, workbook: str, columns: list[str]) -> DataFrame:
    """(key, row_no, columns as text) of workbooks; a header that lacks a column is an error."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch[key], batch[workbook], strict=True):
                rows = read_workbook(bytes(data))
                header = [(x or "").strip() for x in next(rows, [])]
                missing = [c for c in columns if c not in header]
                if missing:
                    raise ValueError(f"{k}: the sheet lacks {missing}")
                at = [header.index(c) for c in columns]
                found = [(k, n, *[row[i] if i < len(row) else None for i in at]) for n, row in enumerate(rows, 2) if any(x is not None for x in row)]
                yield pd.DataFrame(found, columns=[key, "row_no", *columns], dtype=object)

    return df.select(key, workbook).mapInPandas(run, f"`{key}` {kind}, row_no int, " + ", ".join(f"`{c}` string" for c in columns))
