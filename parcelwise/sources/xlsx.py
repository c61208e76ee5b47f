"""Spreadsheets (XLSX) as a Python data source and as files, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ORDER_TYPES = {"business_code": T.StringType(), "latitude": T.DoubleType(), "longitude": T.DoubleType()}


def opened(path: str) -> bytes:
    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    with system.open_input_file(name) as f:
        return f.read()


def column_number(cell: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(i: int) -> str:
    name, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def sheet_rows(data: bytes) -> Iterator[list]:
    """The cells of the first sheet by row: str, float, bool or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = book.find(f"{MAIN}sheets/{MAIN}sheet").get(RELATION)
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == first)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list = []
                for c in row.iter(f"{MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text == "1" if kind == "b" else value.text if kind == "str" else None if kind == "e" else float(value.text)
                yield cells
                row.clear()


def as_type(value, kind: T.DataType):
    if value is None or value == "" and not isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.StringType):
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(value)
    return value


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        rows = sheet_rows(opened(self.path))
        header = next(rows, [])
        at = {str(h): i for i, h in enumerate(header) if h is not None}
        for cells in rows:
            if any(c is not None for c in cells):
                yield tuple(as_type(cells[at[f.name]] if f.name in at and at[f.name] < len(cells) else None, f.dataType) for f in self.schema)


class OrdersXlsx(DataSource):
    """The first sheet of a workbook; its first row names the columns.

    business_code is text, latitude and longitude are doubles; any other column is a
    double if all its cells are numbers, a boolean if all are, else text. A sheet has
    1,048,576 rows at most, so one task reads it; larger inputs come as CSV or Parquet.
    """

    @classmethod
    def name(cls) -> str:
        return "orders_xlsx"

    def schema(self) -> T.StructType:
        rows = sheet_rows(opened(self.options["path"]))
        header = [str(h) if h is not None else None for h in next(rows, [])]
        kinds: list[set] = [set() for _ in header]
        for cells in rows:
            for i, c in enumerate(cells[: len(header)]):
                if c is not None:
                    kinds[i].add(type(c))
        guess = lambda k: T.DoubleType() if k == {float} else T.BooleanType() if k == {bool} else T.StringType()
        return T.StructType([T.StructField(h, ORDER_TYPES.get(h) or guess(k)) for h, k in zip(header, kinds, strict=True) if h is not None])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], schema)


def workbook(header: list[str], rows: Iterable[Iterable]) -> bytes:
    """A workbook of one sheet."""

    def cell(i: int, r: int, v) -> str:
        at = f"{column_name(i)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1))
    main, office = MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()
