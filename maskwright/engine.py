"""Workbook sessions: load, analyze, preview and export, as one object per file."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.header_row import cell_text, detect_header_row, headers_of
from .operators.profile import profile
from .operators.pseudonym import random_salt
from .operators.redact import SheetResult, audit_report, preview, write_redacted
from .plans.plan import RedactionPlan, SheetJob, opening_step
from .session import discard, run_path
from .sources.xlsx import SCHEMA, accepts, file_hashes, output_names, read_xlsx, safe_sheet_names, sheet_rows, summarise
from .sources.xlsx_sink import as_sheet, parts_of, write_book

HEADER_ROWS_READ = 12


class WorkbookSession:
    """One workbook and one salt: equal values get equal replacements in all its sheets and in previews."""

    def __init__(self, spark: SparkSession, path: str, salt: str | None = None):
        if not accepts(path):
            raise ValueError("only .xlsx and .xlsm files are read")
        self.spark, self.path, self.salt = spark, path, salt or random_salt()
        self.rows = read_xlsx(spark, path).persist()
        self._profiles: dict[tuple[str, int], list] = {}

    def close(self) -> None:
        self.rows.unpersist()

    def sheets(self) -> list:
        return [r.asDict() for r in summarise(self.rows).collect()]

    def header_guess(self, sheet: str) -> dict:
        """The guess for a sheet's header row, from its first rows alone: no others are parsed."""
        return detect_header_row(sheet_rows(read_xlsx(self.spark, self.path, sheet, HEADER_ROWS_READ), sheet)).first().asDict(recursive=True)

    def header_row(self, sheet: str) -> int:
        """The guessed header row, the first row if there is no guess."""
        return self.header_guess(sheet)["header_index"] or 0

    def opening_step(self, auto: bool = True) -> tuple[str, str]:
        """The step and the sheet to begin with, see plans.plan.opening_step."""
        summary = self.sheets()
        return opening_step(summary, {s["name"]: self.header_guess(s["name"])["header_index"] for s in summary} if auto and len(summary) == 1 else {}, auto)

    def headers(self, sheet: str, header_row: int) -> list[str]:
        return headers_of(sheet_rows(self.rows, sheet), header_row)

    def table(self, sheet: str, header_row: int) -> DataFrame:
        """The rows below the header: row_idx and columns c0, c1, ..., typed where all filled cells of a column have one type, else as texts."""
        data = sheet_rows(self.rows, sheet).where(F.col("row_idx") > header_row)
        width = len(self.headers(sheet, header_row))
        at = lambda i: F.get("cells", F.lit(i))
        kinds = data.agg(*[F.collect_set(at(i)["t"]).alias(f"k{i}") for i in range(width)]).first() if width else []
        typed = {("n",): lambda c: c["n"], ("d",): lambda c: c["d"], ("b",): lambda c: c["b"]}
        return data.select("row_idx", *[typed.get(tuple(kinds[i]), cell_text)(at(i)).alias(f"c{i}") for i in range(width)])

    def analyze(self, sheet: str, header_row: int, force: bool = False) -> list[dict]:
        """The profiles of a sheet's columns; kept until forced."""
        key = (sheet, header_row)
        if force or key not in self._profiles:
            table, headers = self.table(sheet, header_row), self.headers(sheet, header_row)
            rows = profile(table, "row_idx", [f"c{i}" for i in range(len(headers))], headers).orderBy("index").collect() if headers else []
            self._profiles[key] = [r.asDict() for r in rows]
        return self._profiles[key]

    def plan(self, sheet: str, header_row: int) -> RedactionPlan:
        return RedactionPlan.from_profile(self.analyze(sheet, header_row))

    @staticmethod
    def _shifted(plan: RedactionPlan) -> RedactionPlan:
        return RedactionPlan(replace(p, index=p.index + 1) for p in plan)  # row_idx comes first

    def preview(self, job: SheetJob, rows: int = 60) -> list[dict]:
        found = preview(self.table(job.sheet, job.header_row), self._shifted(job.plans), "row_idx", rows, self.salt)
        return [{"before": r["before"][1:], "after": r["after"][1:]} for r in found.collect()]

    def export(self, jobs: list[SheetJob], out_dir: str, scope: str = "selected-only", fmt: str = "xlsx") -> dict:
        """Writes the redacted file and its audit into out_dir, a folder that executors mount too, and returns the audit.

        A workbook is one zip archive of at most 1,048,576 rows a sheet, so one task streams it to its file and no row comes through the driver; larger tables are written in parts, by redact.write_redacted or
        write_parts.  Sheets keep their order.  With scope whole-workbook the other sheets are copied as they are; CSV holds the first job's sheet alone, and the audit says so."""
        by_sheet = {j.sheet: j for j in jobs}
        order = [s["name"] for s in self.sheets()]
        safe = dict(zip(order, safe_sheet_names(order), strict=True))
        written: list[DataFrame] = []
        results: list[SheetResult] = []
        kept: list[DataFrame] = []
        for n, name in enumerate(order):
            job, rows = by_sheet.get(name), sheet_rows(self.rows, name)
            as_is = lambda df, n=n, name=name: df.select(F.lit(safe[name]).alias("sheet"), F.lit(n).alias("sheet_idx"), "row_idx", "cells")
            if fmt == "csv" and (not jobs or name != jobs[0].sheet):
                results.append(SheetResult(name, "dropped", 0, []))
            elif job:
                table, plan = self.table(name, job.header_row), self._shifted(job.plans)
                path = run_path(self.spark, "export")
                results.append(write_redacted(table, plan, path, name, "parquet", self.salt, "row_idx"))  # one pass: rows, counts and the cells
                results[-1].action = "redacted"
                kept.append(self.spark.read.parquet(path))
                written += [as_is(rows.where(F.col("row_idx") == job.header_row)), as_sheet(kept[-1], safe[name], n, "row_idx", [c for c in kept[-1].columns if c != "row_idx"])]
            elif scope == "whole-workbook":
                results.append(SheetResult(name, "passed-through", rows.count(), []))
                written.append(as_is(rows))
            else:
                results.append(SheetResult(name, "dropped", 0, []))
        out_name, audit_name = output_names(self.path, fmt)
        Path(out_dir).mkdir(parents=True, exist_ok=True)
        book = reduce(DataFrame.union, written) if written else self.spark.createDataFrame([], SCHEMA)
        write_book(book, str(out_dir), out_name)
        discard(*kept)
        source = file_hashes(self.spark, self.path).first().sha256
        output = next(p["sha256"] for p in parts_of(str(out_dir)) if p["name"] == out_name)
        audit = audit_report(Path(self.path).name, source, output, scope, fmt, results)
        (Path(out_dir) / audit_name).write_text(json.dumps(audit, indent=2))
        return audit


__all__ = ["HEADER_ROWS_READ", "WorkbookSession"]
