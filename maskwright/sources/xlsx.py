"""Spreadsheet files as a Spark data source.
`spark.read.format("xlsx").load(path)` gives one row per sheet row: sheet, sheet_idx, row_idx and cells, an array of tagged values
(t is s, n, b, d or null).  Only values are read: no formulas, styles or comments.  A sheet is a stream inside its file's zip archive and is parsed as one: there is one partition per
(file, sheet), which holds one row at a time, and reading stops at the last row that is asked for (maxRows, or filters on sheet and row_idx, which are pushed down).  Of the shared texts only those
up to the largest one in use are read, and they are kept as bytes.  The source opens files itself, so they must be on a file system that all executors mount; read_xlsx() takes them through
Spark's own binary reader and so from any store.
"""
from __future__ import annotations
import csv
import glob
import io
import os
import re
import warnings
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import lru_cache
from itertools import islice
from typing import IO
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from ..operators.header_row import CELL
from ..session import ship
SCHEMA = T.StructType([T.StructField("sheet", T.StringType()), T.StructField("sheet_idx", T.IntegerType()), T.StructField("row_idx", T.IntegerType()), T.StructField("cells", T.ArrayType(CELL))])
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_M = "{%s}" % _NS["m"]
ACCEPTED = (".xlsx", ".xlsm")
SIZE_WARNING = 50 * 1024 * 1024
#: Number formats that the file format itself defines as dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
NO_CELL = {"t": None, "s": None, "n": None, "b": None, "d": None}

def accepts(name: str) -> bool:
    return name.lower().endswith(ACCEPTED)

def warn_of_size(name: str, size: int) -> None:
    """A file is one zip archive that is read from its start: from SIZE_WARNING bytes on that takes a while."""
    if size > SIZE_WARNING:
        warnings.warn(f"{name} has {size >> 20} MB; each of its sheets is read by one task", stacklevel=3)

def column_index(reference: str) -> int:
    """0 for A, from a cell reference such as AB12."""
    return _column_number(reference.rstrip("0123456789"))


@lru_cache(1 << 14)
def _column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1

def _is_date_format(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.lower())
    return bool(re.search(r"[ymdhs]", bare)) and "general" not in bare

def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))

def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    ids = [int(x.get("numFmtId", 0)) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return {n for n, i in enumerate(ids) if i in _DATE_FORMATS or (i in own and _is_date_format(own[i]))}

def serial_date(serial: float, from_1904: bool = False) -> datetime:
    """The date of a spreadsheet's day count; the calendar from 1900 counts a 29 February 1900 that never was."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    return start + timedelta(milliseconds=round(serial * 86_400_000))

class SharedTexts:
    """The shared texts of a workbook by number: the stream is parsed as far as the numbers asked for, and texts are kept as bytes in one buffer."""
    def __init__(self, z: zipfile.ZipFile):
        self._stream = z.open("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else None
        self._nodes = _closed(self._stream, f"{_M}si") if self._stream else iter(())
        self._bytes, self._ends = bytearray(), array("Q", [0])
    def __getitem__(self, n: int) -> str:
        while len(self._ends) <= n + 1:
            self._bytes += _text(next(self._nodes)).encode("utf-8", "surrogatepass")
            self._ends.append(len(self._bytes))
        return self._bytes[self._ends[n] : self._ends[n + 1]].decode("utf-8", "surrogatepass")

def _closed(stream: IO[bytes], tag: str) -> Iterator[ET.Element]:
    """The elements of a tag as they end; each is taken out of its parent once the next one is asked for."""
    above: list[ET.Element] = []
    for event, node in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(node)
            continue
        above.pop()
        if node.tag == tag:
            yield node
            if above:
                above[-1].remove(node)


def _cell(c: ET.Element, shared: SharedTexts, dates: set[int], from_1904: bool) -> dict:
    kind, value = c.get("t", "n"), c.findtext(f"{_M}v")
    if kind == "inlineStr":
        return NO_CELL | {"t": "s", "s": _text(c)}
    if value is None:
        return NO_CELL
    if kind == "s":
        return NO_CELL | {"t": "s", "s": shared[int(value)]}
    if kind in ("str", "e"):
        return NO_CELL | {"t": "s", "s": value}
    if kind == "b":
        return NO_CELL | {"t": "b", "b": value not in ("0", "false")}
    if kind == "d":
        return NO_CELL | {"t": "d", "d": datetime.fromisoformat(value.replace("Z", ""))}
    if int(c.get("s", 0)) in dates:
        return NO_CELL | {"t": "d", "d": serial_date(float(value), from_1904)}
    return NO_CELL | {"t": "n", "n": float(value)}

@dataclass
class Sheet:
    name: str
    number: int
    target: str

class Book:
    """An open workbook; rows() streams one sheet."""
    def __init__(self, file: str | IO[bytes]):
        self.z = zipfile.ZipFile(file)
        book = ET.fromstring(self.z.read("xl/workbook.xml"))
        pr = book.find("m:workbookPr", _NS)
        self.from_1904 = pr is not None and pr.get("date1904") in ("1", "true")
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.z.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: list[Sheet] = []
        for n, sheet in enumerate(book.iterfind("m:sheets/m:sheet", _NS)):
            target = links[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            self.sheets.append(Sheet(sheet.get("name"), n, target if target.startswith("xl/") else f"xl/{target}"))
        self.shared = SharedTexts(self.z)
        self.dates = _date_styles(self.z)
    def __enter__(self) -> Book:
        return self
    def __exit__(self, *_) -> None:
        self.z.close()
    def _columns(self, sheet: Sheet) -> tuple[int, int] | None:
        """The first and last column that a sheet says it uses, in its head; None if it says nothing or names one cell, as writers do that don't know."""
        with self.z.open(sheet.target) as f:
            for _, node in ET.iterparse(f, ("start",)):
                if node.tag == f"{_M}dimension" and ":" in node.get("ref", ""):
                    first, last = node.get("ref").replace("$", "").split(":")
                    return column_index(first), column_index(last)
                if node.tag == f"{_M}sheetData":
                    return None
        return None
    def _parsed(self, sheet: Sheet, values: bool) -> Iterator[tuple[int, dict[int, dict]]]:
        with self.z.open(sheet.target) as f:
            at = -1
            for row in _closed(f, f"{_M}row"):
                at = int(row.get("r", at + 2)) - 1
                cells = enumerate(row.iterfind("m:c", _NS))
                yield at, {(column_index(c.get("r")) if c.get("r") else k): (_cell(c, self.shared, self.dates, self.from_1904) if values else NO_CELL) for k, c in cells}
    def rows(self, sheet: Sheet, limit: int | None = None) -> Iterator[tuple[int, list[dict]]]:
        """(row_idx, cells) from a sheet's first used row to its last, blank ones between them too, at most `limit` of them.
        Rows are as wide as the sheet says it is (wider if they have more); a sheet that says nothing is gone through twice, with a limit once for these rows alone."""
        known = self._columns(sheet)
        if known is None:
            used = [(min(c), max(c)) for at, c in self._upto(sheet, limit) if c]
            if not used:
                return
            known = min(a for a, _ in used), max(b for _, b in used)
        left, right = known
        top, done = None, 0
        for at, cells in self._parsed(sheet, True):
            if not cells:
                continue  # blank rows come with the next one that is not
            top = at if top is None else top
            if min(cells) < left:
                raise ValueError(f"sheet {sheet.name!r} has cells left of the columns that it says it uses")
            for n in range(done, at - top + 1):
                if limit is not None and n >= limit:
                    return
                own = cells if n == at - top else {}
                yield n, [own.get(c, NO_CELL) for c in range(left, max(right, max(own, default=0)) + 1)]
            done = at - top + 1
            if limit is not None and done >= limit:
                return
    def _upto(self, sheet: Sheet, limit: int | None) -> Iterator[tuple[int, dict[int, dict]]]:
        top = None
        for at, cells in self._parsed(sheet, False):
            top = at if top is None and cells else top
            if limit is not None and top is not None and at - top >= limit:
                return
            yield at, cells

def read_workbook(data: bytes, only: str | None = None, limit: int = 0) -> Iterator[tuple[str, int, int, list[dict]]]:
    """(sheet, sheet_idx, row_idx, cells) of all rows (limit: of each sheet) of a workbook in memory."""
    with Book(io.BytesIO(data)) as book:
        for sheet in book.sheets:
            if only is None or sheet.name == only:
                for at, cells in book.rows(sheet, limit or None):
                    yield sheet.name, sheet.number, at, cells

@dataclass
class _Part(InputPartition):
    path: str
    sheet: Sheet

class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet = options.get("path"), options.get("sheet")
        self.limit = int(options.get("maxrows", 0)) or None
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes sheet = name and upper bounds of row_idx; Spark keeps the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and column == ("sheet",) and self.sheet in (None, f.value):
                self.sheet = f.value
            elif isinstance(f, IsNotNull) and column in (("sheet",), ("sheet_idx",), ("row_idx",)):
                continue  # they never are null
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == ("row_idx",):
                most = max(0, f.value + isinstance(f, LessThanOrEqual))
                self.limit = most if self.limit is None else min(self.limit, most)
            else:
                if isinstance(f, EqualTo) and column == ("row_idx",):
                    self.limit = max(0, f.value + 1) if self.limit is None else min(self.limit, max(0, f.value + 1))
                yield f
    def partitions(self) -> list[InputPartition]:
        """A partition for every sheet of every workbook; of the files only their lists of sheets are read here."""
        if not self.path:
            raise ValueError("give the path of a workbook")
        here = self.path.removeprefix("file://")
        found = sorted(glob.glob(f"{here}/*") if os.path.isdir(here) else glob.glob(here))
        files = [f for f in found if accepts(f) and not os.path.basename(f).startswith(("_", "."))]
        if not files:
            raise FileNotFoundError(f"no workbook at {self.path}")
        out = []
        for f in files:
            warn_of_size(f, os.path.getsize(f))
            with Book(f) as book:
                out += [_Part(f, s) for s in book.sheets if self.sheet in (None, s.name)]
        return out
    def read(self, partition: _Part):
        if self.limit == 0 or not isinstance(partition, _Part):  # a source without partitions is read once all the same
            return
        with Book(partition.path) as book:
            for at, cells in book.rows(partition.sheet, self.limit):
                yield partition.sheet.name, partition.sheet.number, at, [tuple(c.values()) for c in cells]

class XlsxSource(DataSource):
    """Options for reading: path, sheet (one sheet alone; an unknown one gives no rows), maxRows (of each sheet); for writing see xlsx_sink.PartWriter."""
    @classmethod
    def name(cls) -> str:
        return "xlsx"
    def schema(self) -> T.StructType:
        return SCHEMA
    def reader(self, schema: T.StructType) -> DataSourceReader:
        return XlsxReader({k.lower(): v for k, v in dict(self.options).items()})
    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        from .xlsx_sink import PartWriter
        return PartWriter(schema, {k.lower(): v for k, v in dict(self.options).items()}, "xlsx", overwrite)

class BomCsvSink(DataSource):
    """A sink alone: `df.write.format("csv_bom")`, a CSV file with a byte order mark from each task."""
    @classmethod
    def name(cls) -> str:
        return "csv_bom"
    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        from .xlsx_sink import PartWriter
        return PartWriter(schema, {k.lower(): v for k, v in dict(self.options).items()}, "csv", overwrite)

def register(spark: SparkSession) -> None:
    """Makes the formats xlsx (source and sink) and csv_bom (sink) known to the session, with filters pushed down to the source."""
    ship(spark).dataSource.register(XlsxSource)
    spark.dataSource.register(BomCsvSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

#: Rows that read_xlsx hands over at once.
ROWS_AT_ONCE = 1000

def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int = 0) -> DataFrame:
    """All rows (max_rows: the first of each sheet) of the workbooks under a path, parsed on the executors as streams."""
    def parse(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = read_workbook(bytes(data), sheet, max_rows)
                while part := list(islice(rows, ROWS_AT_ONCE)):
                    yield pd.DataFrame(part, columns=SCHEMA.names)
    import pandas as pd
    return ship(spark).read.format("binaryFile").load(path).select("content").mapInPandas(parse, SCHEMA)

def summarise(rows: DataFrame) -> DataFrame:
    """(name, row_count, col_count) of each sheet that has cells, in workbook order."""
    return rows.groupBy("sheet_idx", "sheet").agg((F.max("row_idx") - F.min("row_idx") + 1).alias("row_count"), F.max(F.size("cells")).alias("col_count")).orderBy("sheet_idx").select(F.col("sheet").alias("name"), "row_count", "col_count")

def sheet_rows(rows: DataFrame, sheet: str) -> DataFrame:
    return rows.where(F.col("sheet") == sheet).select("row_idx", "cells")

def safe_sheet_names(names: list[str]) -> list[str]:
    """At most 31 characters, none of : \\ / ? * [ ], never empty; a name that is taken gets ~2, ~3, ..."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[:\\/?*\[\]]", "_", name)[:31] or "Sheet1"
        safe, n = base, 1
        while safe.lower() in (x.lower() for x in out):
            n += 1
            safe = f"{base[: 31 - len(str(n)) - 1]}~{n}"
        out.append(safe)
    return out

def _escape(text: str) -> str:
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

def _label(n: int) -> str:
    from ..plans.lexicon import column_label
    return column_label(n)

def _xml_cell(value, at: str) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    if isinstance(value, (datetime, date)):
        value = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        serial = (value.replace(tzinfo=None) - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c r="{at}" s="1"><v>{serial!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_escape(str(value))}</t></is></c>'

#: The format's own limits.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

class WorkbookFile:
    """A new workbook of values alone, written as a stream: add() starts the next sheet, row() writes a row of it, close() the lists of sheets."""
    def __init__(self, out: str | IO[bytes]):
        self.z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self._sheet: IO[bytes] | None = None
        self.rows = 0  # of the present sheet
    def add(self, name: str) -> None:
        self._end()
        self.names.append(name)
        self._sheet = self.z.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self._sheet.write(f'{_HEAD}<worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
        self.rows = 0
    def row(self, values: list) -> None:
        self.rows += 1
        if self.rows > MOST_ROWS or any(isinstance(v, str) and len(v) > MOST_CHARS for v in values):
            raise ValueError(f"a sheet holds {MOST_ROWS} rows and a cell {MOST_CHARS} characters at most; write such tables with write_redacted")
        self._sheet.write(f'<row r="{self.rows}">{"".join(_xml_cell(v, f"{_label(c)}{self.rows}") for c, v in enumerate(values))}</row>'.encode())
    def _end(self) -> None:
        if self._sheet:
            self._sheet.write(b"</sheetData></worksheet>")
            self._sheet.close()
            self._sheet = None
    def close(self) -> None:
        self._end()
        z, main, rel, names = self.z, _NS["m"], _NS["r"], safe_sheet_names(self.names)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tags = "".join(f'<sheet name="{_escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tags}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>')
        z.close()

def build_workbook(sheets: list[tuple[str, Iterator[list]]]) -> bytes:
    """A small workbook in memory, from (name, rows); tables are written by executors, see xlsx_sink."""
    out = io.BytesIO()
    book = WorkbookFile(out)
    for name, rows in sheets:
        book.add(name)
        for row in rows:
            book.row(row)
    book.close()
    return out.getvalue()

def csv_line(row: list) -> list:
    """The fields of a CSV row: dates as days, whole numbers without a point."""
    return ["" if v is None else v.strftime("%Y-%m-%d") if isinstance(v, (datetime, date)) else ("TRUE" if v else "FALSE") if isinstance(v, bool) else int(v) if isinstance(v, float) and v.is_integer() else v for v in row]

BOM = b"\xef\xbb\xbf"

def csv_bytes(rows: Iterator[list]) -> bytes:
    """A small CSV file in memory with a UTF-8 byte order mark, so that spreadsheet programs read accents right."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(map(csv_line, rows))
    return BOM + out.getvalue().encode()

def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

def output_names(source: str, fmt: str) -> tuple[str, str]:
    """Names of the redacted file and of its audit."""
    base = re.sub(r"\.[^.]+$", "", source.rsplit("/", 1)[-1])
    return f"{base}-redacted.{fmt}", f"{base}-redacted-audit.json"
