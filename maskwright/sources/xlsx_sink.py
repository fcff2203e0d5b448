"""Workbooks and CSV files with a byte order mark, written by the executors.

`df.write.format("xlsx")` or `format("csv_bom")`: every task streams its rows into part files of its own, below a hidden folder of the write; its commit message names them with their rows and hashes.
The commit, on the driver, moves the files of successful tasks to their place and writes the list of parts beside them; an abort removes the hidden folder.  A task that is killed leaves nothing
but a file in that folder, which no reader looks at and the commit or abort of the write removes.  No row goes through the driver.

A DataFrame of the reader's own schema (sheet, sheet_idx, row_idx, cells) is written as the sheets that it names, in the order of its rows; any other one as a table, its column names first.  A
part file that is full (1,048,576 rows) is followed by another one.  The folder must be on a file system that all executors and the driver mount.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage

from ..functions.cells import is_date_type, is_number
from ..operators.header_row import CELL
from . import xlsx
from .xlsx import register

PARTS = "_parts.json"


@dataclass
class Parts(WriterCommitMessage):
    """Part files of a task: (name, rows, sha256)."""

    files: list[tuple[str, int, str]] = field(default_factory=list)


def _hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _value(cell) -> object:
    return None if cell is None else cell["d"] if cell["t"] == "d" else cell["n"] if cell["t"] == "n" else cell["b"] if cell["t"] == "b" else cell["s"]


class PartWriter(DataSourceWriter):
    """Options: path; sheet (name of a table's sheet), file (its name, for a write of one part: the part files of others get numbers), header (false: no column names), maxRows (of a part file)."""

    def __init__(self, schema: T.StructType, options: dict, fmt: str, overwrite: bool):
        if not options.get("path"):
            raise ValueError("give the path of a folder")
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.fmt, self.overwrite, self.names = fmt, overwrite, schema.names
        self.raw = schema.names == xlsx.SCHEMA.names
        bad = [] if self.raw else [f.name for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
        if bad:
            raise ValueError(f"a cell holds no nested or binary values: {', '.join(bad)}")
        self.sheet, self.file = options.get("sheet") or "Sheet1", options.get("file")
        self.header = options.get("header", "true").lower() != "false" and not self.raw
        self.most = max(2, min(int(options.get("maxrows", xlsx.MOST_ROWS)), xlsx.MOST_ROWS)) if fmt == "xlsx" else int(options.get("maxrows", 0)) or None
        self.id = uuid.uuid4().hex
        self.hidden = f"{self.folder}/_writing-{self.id}"
        os.makedirs(self.hidden)  # here and not by tasks: one that still runs when the write is aborted must not bring it back

    def write(self, iterator: Iterator) -> Parts:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        out = Parts()
        rows = iter(iterator)
        first = next(rows, None)
        while first is not None or (not out.files and context.partitionId() == 0):  # a table without rows has its header in one file
            path = f"{self.hidden}/{name}-{len(out.files)}.{self.fmt}"
            first, count = (self._workbook if self.fmt == "xlsx" else self._csv)(path, first, rows)
            out.files.append((os.path.basename(path), count, _hash(path)))
        return out

    def _workbook(self, path: str, first, rows: Iterator) -> tuple[object, int]:
        """Writes rows until the sheet is full; gives the row that is left, and how many were written."""
        book, sheet, count, row = xlsx.WorkbookFile(path), None, 0, first
        if not self.raw:
            book.add(self.sheet)
            if self.header:
                book.row(self.names)
        while row is not None:
            if self.raw and row["sheet_idx"] != sheet:
                sheet = row["sheet_idx"]
                book.add(row["sheet"])
            if book.rows >= self.most:
                break
            book.row([_value(c) for c in row["cells"]] if self.raw else list(row))
            count, row = count + 1, next(rows, None)
        if not book.names:
            book.add(self.sheet)  # a workbook has a sheet at least
        book.close()
        return row, count

    def _csv(self, path: str, first, rows: Iterator) -> tuple[object, int]:
        row, count = first, 0
        with open(path, "w", encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            if self.header:
                out.writerow(self.names)
            while row is not None and not (self.most and count >= self.most):
                out.writerow(xlsx.csv_line([_value(c) for c in row["cells"]] if self.raw else list(row)))
                count, row = count + 1, next(rows, None)
        return row, count

    def commit(self, messages: list[Parts | None]) -> None:
        done = sorted(f for m in messages if m for f in m.files)
        done = [f for f in done if f[1]] or done[:1]  # files without rows go, unless there are no others
        if self.file and len(done) != 1:
            self.abort(messages)
            raise ValueError(f"{self.file} is one file, but {len(done)} were written: give one partition")
        listed, earlier = [], json.load(open(f"{self.folder}/{PARTS}")) if os.path.exists(f"{self.folder}/{PARTS}") else []
        for n, (name, rows, sha256) in enumerate(done):
            final = self.file or f"part-{n:05d}-{self.id}.{self.fmt}"
            os.replace(f"{self.hidden}/{name}", f"{self.folder}/{final}")
            listed.append({"name": final, "rows": rows, "sha256": sha256})
        names = {f["name"] for f in listed}
        earlier = [f for f in earlier if f["name"] not in names]
        with open(f"{self.hidden}/{PARTS}", "w") as f:
            json.dump(listed if self.overwrite else earlier + listed, f)
        os.replace(f"{self.hidden}/{PARTS}", f"{self.folder}/{PARTS}")
        for old in earlier if self.overwrite else ():
            if os.path.exists(f"{self.folder}/{old['name']}"):
                os.remove(f"{self.folder}/{old['name']}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Parts | None]) -> None:
        for _ in range(3):  # a task that still runs can put a file into it meanwhile
            shutil.rmtree(self.hidden, ignore_errors=True)


def parts_of(path: str) -> list[dict]:
    """name, rows and sha256 of the part files in a folder that was written here."""
    with open(f"{path.removeprefix('file://').rstrip('/')}/{PARTS}") as f:
        return json.load(f)


def cell_of(col: Column, dtype: T.DataType) -> Column:
    """A typed value as a tagged cell; null and empty texts are no cell."""
    empty = lambda kind: F.lit(None).cast(kind)
    kind = "d" if is_date_type(dtype) else "b" if isinstance(dtype, T.BooleanType) else "n" if is_number(dtype) else "s"
    text = col.cast("string") if kind == "s" else empty("string")
    live = col.isNotNull() & ((text != "") if kind == "s" else F.lit(True))
    return F.struct(
        F.when(live, F.lit(kind)).alias("t"), F.when(live, text).alias("s"), (col.cast("double") if kind == "n" else empty("double")).alias("n"), (col if kind == "b" else empty("boolean")).alias("b"),
        (col.cast("timestamp_ntz") if kind == "d" else empty("timestamp_ntz")).alias("d"),
    ).cast(CELL)


def as_sheet(df: DataFrame, name: str, number: int, order_col: str, columns: list[str]) -> DataFrame:
    """A table as rows of the reader's schema, its order in row_idx."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[cell_of(F.col(f"`{c}`"), types[c]) for c in columns]) if columns else F.array().cast(T.ArrayType(CELL))
    return df.select(F.lit(name).alias("sheet"), F.lit(number).cast("int").alias("sheet_idx"), F.col(f"`{order_col}`").cast("int").alias("row_idx"), cells.alias("cells"))


def header_sheet(spark: SparkSession, name: str, number: int, headers: list[str]) -> DataFrame:
    """A sheet's row of column names, before all rows of a table."""
    return as_sheet(spark.range(1).select((F.col("id") - 1).alias("row"), *[F.lit(h).alias(f"c{n}") for n, h in enumerate(headers)]), name, number, "row", [f"c{n}" for n in range(len(headers))])


def write_book(sheets: DataFrame, folder: str, file: str) -> None:
    """Writes rows of the reader's schema as one workbook (or CSV file, by its name), streamed by one task; rows go by sheet_idx and row_idx."""
    register(sheets.sparkSession)
    sheets.repartition(1).sortWithinPartitions("sheet_idx", "row_idx").write.format("csv_bom" if file.endswith(".csv") else "xlsx").mode("append").option("file", file).save(folder)
