"""Running a plan: one projection for everything but aliases, with the cells that changed counted in the same pass."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import discard, free_name, stash

from ..functions.cells import display_of, is_empty, is_number, text_of
from ..functions.fake import break_luhn
from ..functions.masks import apply_partial
from ..plans.plan import PREVIEW_ROWS, ColumnPlan, RedactionPlan
from ..plans.registry import OWN_MODES
from .alias_dictionary import AliasDictionary
from .pseudonym import alias_table, consistent_fake, digest, fresh_fake, random_salt

#: Rows for each distinct value from which values are drawn once each, and bytes of such a table at most: it is broadcast.
REPEATS, DRAWN_BYTES = 20, 64 << 20


def redact_column(col: Column, dtype: T.DataType, plan: ColumnPlan, salt: str) -> Column:
    """The redacted cell; null and empty cells pass through.  Sequential aliases are not cell-wise, see redact()."""
    text, o = text_of(col, dtype), plan.options
    salt = o.salt or salt
    locale = o.locale or "id"
    amount = col if plan.semantic == "currency" and is_number(dtype) else None
    if plan.mode == "blank":
        out = F.lit("" if o.blank_with is None else o.blank_with)
    elif plan.mode == "partial":
        out = apply_partial(col, text, dtype, plan.semantic, o.mark, 1 if o.keep_start is None else o.keep_start, 0 if o.keep_end is None else o.keep_end)
    elif plan.mode == "hash":
        out = digest(text, salt, o.digest_length)
    elif plan.mode == "fake":
        out = consistent_fake(text, plan.semantic, locale, salt, o.digest_length, amount if o.keep_magnitude else None) if o.consistent else text_of(fresh_fake(plan.semantic, locale, amount), T.DoubleType() if plan.semantic == "currency" else T.StringType())
        out = break_luhn(out) if plan.semantic == "card" and o.force_invalid_luhn else out
    elif plan.mode in OWN_MODES:
        out = OWN_MODES[plan.mode](text, plan, salt)
    else:
        return col
    return F.when(is_empty(col, dtype), col.cast("string")).otherwise(out)


def changed(before: Column, after: Column, dtype: T.DataType) -> Column:
    """Whether a cell counts as changed: cells that become texts always do, texts only if they differ; empty ones never do."""
    differs = ~before.eqNullSafe(after) if isinstance(dtype, T.StringType) else F.lit(True)
    return ~is_empty(before, dtype) & differs


def redact(
    df: DataFrame, plan: RedactionPlan, salt: str | None = None, order_col: str | None = None, counts: Observation | None = None,
    dictionaries: dict[str, AliasDictionary] | None = None, draw_once: bool = False,
) -> DataFrame:
    """df with the plan's columns redacted and the others as they are.

    plan[i].index is the column's position in df.  One salt serves the whole run, so equal values get equal hashes in all columns;
    order_col gives the row order that sequential aliases need.  counts, if given, observes the changed cells by column position
    (`c0`, `c1`, ...) while the result is being written.  Columns may have any names.

    dictionaries names columns whose sequential aliases are those of a kept dictionary, which this call extends.  draw_once looks at df once more, for how often values repeat: consistent
    synthetic values of columns that repeat theirs 20 times and more are then drawn for distinct values and joined by a broadcast, if the table of them has 64 MB at most."""
    after, joined = _redacted(df, plan, salt or random_salt(), order_col, dictionaries or {}, draw_once)
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    if counts is not None and after:
        joined = joined.observe(counts, *[F.count_if(changed(F.col(f"`{names[i]}`"), F.col(r), types[i])).alias(f"c{i}") for i, r in after.items()])
    return joined.select(*[(F.col(after[i]) if i in after else F.col(f"`{n}`")).alias(n) for i, n in enumerate(names)])


def _redacted(df: DataFrame, plan: RedactionPlan, salt: str, order_col: str | None, dictionaries: dict[str, AliasDictionary] | None = None, draw_once: bool = False) -> tuple[dict[int, str], DataFrame]:
    """Column positions -> names of their redacted columns, which stand beside the ones of df under names that are free there."""
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    active = {p.index: p for p in plan if p.mode}
    after: dict[int, str] = {}
    for i in active:
        after[i] = free_name([*names, *after.values()], f"r{i}")
    drawn = drawn_tables(df, plan, salt) if draw_once else {}
    out = df.select("*", *[redact_column(df[f"`{names[i]}`"], types[i], p, salt).alias(after[i]) for i, p in active.items() if not _is_alias(p) and i not in drawn])
    for i, p in active.items():
        here, text = F.col(f"`{names[i]}`"), text_of(F.col(f"`{names[i]}`"), types[i])
        if i in drawn:
            found, missing = F.broadcast(drawn[i]), F.lit(None)
        elif _is_alias(p):
            if order_col is None:
                raise ValueError("sequential aliases go by first appearance: name the column that orders the rows")
            kept = (dictionaries or {}).get(names[i])
            found = kept.extend(df, text, order_col) if kept else alias_table(df, text, order_col, p.options.alias_prefix or "ID")
            missing = F.lit("")
        else:
            continue
        of = free_name([*out.columns, *after.values()], "key")
        out = out.join(found.toDF(of, after[i]), text == F.col(of), "left").drop(of)
        out = out.withColumn(after[i], F.when(is_empty(here, types[i]), here.cast("string")).otherwise(F.coalesce(after[i], missing)))
    return after, out


def drawn_tables(df: DataFrame, plan: RedactionPlan, salt: str) -> dict[int, DataFrame]:
    """Column positions -> (text, synthetic value) for the columns where one draw for each distinct value is cheaper than one for each cell.

    One pass sketches how many values and bytes they are; the tables that are then written are measured again before they count as small enough to broadcast.  Amounts that keep their
    magnitude and fresh values are always drawn cell by cell.  They stay until clear_stashes(), as the lazy result reads them."""
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    plans = {p.index: p for p in plan if p.mode == "fake" and p.options.consistent and not p.options.keep_magnitude}
    if not plans:
        return {}
    texts = {i: text_of(F.col(f"`{names[i]}`"), types[i]) for i in plans}
    sketched = [x for i, t in texts.items() for x in (F.count(t).alias(f"n{i}"), F.approx_count_distinct(t).alias(f"d{i}"), F.avg(F.octet_length(t)).alias(f"b{i}"))]
    seen = df.agg(*sketched).first()
    tables = {}
    for i, p in plans.items():
        if not seen[f"n{i}"] or seen[f"d{i}"] * REPEATS > seen[f"n{i}"] or seen[f"d{i}"] * (seen[f"b{i}"] + 64) > DRAWN_BYTES:
            continue
        keys = df.select(texts[i].alias("key")).where("key is not null").distinct()
        table = stash(keys.select("key", redact_column(F.col("key"), T.StringType(), p, salt).alias("drawn")), "drawn")
        if table.agg(F.sum(F.octet_length("key") + F.octet_length("drawn") + 32)).first()[0] <= DRAWN_BYTES:
            tables[i] = table
        else:
            discard(table)
    return tables


def _is_alias(p: ColumnPlan) -> bool:
    return p.mode == "hash" and p.options.hash_style == "sequential"


def change_counts(df: DataFrame, plan: RedactionPlan, salt: str, order_col: str | None = None) -> DataFrame:
    """(header, mode, semantic, cells_changed) for each active column, by one aggregate over df."""
    names, types = df.columns, [f.dataType for f in df.schema.fields]
    cellwise = [p for p in plan if p.mode and not _is_alias(p)]
    sums = [F.count_if(changed(df[names[p.index]], redact_column(df[names[p.index]], types[p.index], p, salt), types[p.index])).alias(f"c{p.index}") for p in cellwise]
    sums += [F.count_if(~is_empty(df[names[p.index]], types[p.index])).alias(f"c{p.index}") for p in plan if p.mode and _is_alias(p)]
    rows = [F.struct(F.lit(p.header).alias("header"), F.lit(p.mode).alias("mode"), F.lit(p.semantic).alias("semantic"), F.col(f"c{p.index}").alias("cells_changed")) for p in plan.active]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def preview(df: DataFrame, plan: RedactionPlan, order_col: str, rows: int = PREVIEW_ROWS, salt: str | None = None) -> DataFrame:
    """(row, before, after): display texts of the first rows, one row for each, rows of one place too; aliases are those of the slice alone.

    The slice is written down once, so that ties at its end fall the same way for aliases and rows; before and after come from one projection."""
    part = stash(df.orderBy(order_col).limit(rows), "preview")
    after, both = _redacted(part, plan, salt or random_salt(), order_col)
    types = {n: f.dataType for n, f in zip(part.columns, part.schema.fields, strict=True)}
    before = [display_of(F.col(f"`{n}`"), types[n]) for n in part.columns]
    shown = [display_of(F.col(after[i]), T.StringType()) if i in after else before[i] for i in range(len(before))]
    return both.select(F.col(f"`{order_col}`").alias("row"), F.array(*before).alias("before"), F.array(*shown).alias("after")).orderBy("row")


@dataclass
class SheetResult:
    name: str
    action: str  # redacted, passed-through or dropped
    row_count: int
    columns: list[dict]


def write_redacted(df: DataFrame, plan: RedactionPlan, path: str, name: str, fmt: str = "parquet", salt: str | None = None, order_col: str | None = None, dictionaries: dict[str, AliasDictionary] | None = None, draw_once: bool = False) -> SheetResult:
    """Writes df, redacted, as Parquet or CSV (with a header) into the folder `path`, by the executors, and counts its rows and changed cells in the same pass."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("tables are written as parquet or csv")
    seen, rows = Observation(), Observation()
    out = (redact(df, plan, salt, order_col, seen, dictionaries, draw_once) if plan.active else df).observe(rows, F.count("*").alias("n"))
    out.write.mode("errorifexists").options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    columns = [{"header": p.header, "mode": p.mode, "semantic": p.semantic, "cellsChanged": seen.get[f"c{p.index}"]} for p in plan.active]
    return SheetResult(name, "redacted" if plan.active else "passed-through", rows.get["n"], columns)


def write_parts(df: DataFrame, plan: RedactionPlan, path: str, name: str, fmt: str = "xlsx", salt: str | None = None, order_col: str | None = None) -> tuple[SheetResult, list[dict]]:
    """Writes df, redacted, as part workbooks or CSV files with a byte order mark ("csv_bom") into the folder `path`, one or more from each task, and counts as write_redacted does.

    The second result is the list of parts: name, rows and sha256 of each file.  The folder must be mounted by all executors."""
    from ..sources.xlsx import register
    from ..sources.xlsx_sink import parts_of

    if fmt not in ("xlsx", "csv_bom"):
        raise ValueError("parts are written as xlsx or csv_bom")
    register(df.sparkSession)
    seen, rows = Observation(), Observation()
    out = (redact(df, plan, salt, order_col, seen) if plan.active else df).observe(rows, F.count("*").alias("n"))
    out.write.mode("overwrite").option("sheet", name).format(fmt).save(path)
    columns = [{"header": p.header, "mode": p.mode, "semantic": p.semantic, "cellsChanged": seen.get[f"c{p.index}"]} for p in plan.active]
    return SheetResult(name, "redacted" if plan.active else "passed-through", rows.get["n"], columns), parts_of(path)


def audit_report(file_name: str, source_hash: str, output_hash: str, scope: str, fmt: str, sheets: list[SheetResult], parts: list[dict] | None = None) -> dict:
    """What was done to which sheet and column; only sheets that were written count as redacted or passed through.  parts, if given, are the output's files with their hashes."""
    done = [{"name": s.name, "action": s.action, "rowCount": 0 if s.action == "dropped" else s.row_count, "columns": s.columns} for s in sheets]
    return {
        "fileName": file_name,
        "generatedAt": datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"),
        "sourceHash": source_hash,
        "outputHash": output_hash,
        "scope": scope,
        "format": fmt,
        "sheets": done,
        "totalCellsChanged": sum(c["cellsChanged"] for s in done if s["action"] == "redacted" for c in s["columns"]),
        **({"parts": parts} if parts is not None else {}),
    }


def audit_summary(report: dict) -> dict:
    """Sheets per action, changed cells, and the names of sheets that passed through."""
    actions = [s["action"] for s in report["sheets"]]
    return {"redacted": actions.count("redacted"), "passed_through": actions.count("passed-through"), "dropped": actions.count("dropped"), "cells_changed": report["totalCellsChanged"], "untouched": [s["name"] for s in report["sheets"] if s["action"] == "passed-through"]}


def file_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
