"""Plans, pseudonyms, redaction, profiles, header rows, workbooks and streams."""

import hashlib
import io
import json
import os
import re
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from maskwright.engine import WorkbookSession
from maskwright.operators.alias_dictionary import AliasDictionary
from maskwright.operators.header_row import SHEET, detect_header_row, header_scores, headers_of, to_table
from maskwright.operators.profile import merge, profile, profile_of, sketch
from maskwright.operators.pseudonym import alias_table, digest, random_salt
from maskwright.functions.sql import register_sql, sql_predicate
from maskwright.operators.redact import audit_report, audit_summary, change_counts, drawn_tables, preview, redact, write_parts, write_redacted
from maskwright.plans import registry
from maskwright.plans.lexicon import column_label, normalise_header, score_header
from maskwright.plans.plan import ColumnPlan, RedactionPlan, RedactOptions, SheetJob, build_jobs, confidence_band, default_sheets, is_low_cardinality, opening_step
from maskwright.sources.xlsx import Book, accepts, build_workbook, csv_bytes, file_hashes, output_names, read_workbook, read_xlsx, register, safe_sheet_names, serial_date, sheet_rows
from maskwright.sources.xlsx_sink import parts_of
from maskwright.streaming.redact_stream import alias_writer, change_counts_by_window, redact_stream


def plan_of(df, **modes):
    return RedactionPlan(ColumnPlan(df.columns.index(c), c, semantic, mode, RedactOptions(**options)) for c, (mode, semantic, options) in modes.items())


def test_header_scores():
    assert normalise_header("No. HP  (Aktif)") == "no hp aktif"
    assert score_header("nik") == ("nik", 1.0) and score_header("nama_lengkap") == ("name", 1.0) and score_header("Email Address") == ("email", 0.85)
    assert score_header("dinamakan") == ("name", 0.6) and score_header("qty") == ("unknown", 0.0) and score_header(" - ") == ("unknown", 0.0)
    assert score_header("no_ktp") == ("nik", 0.85)  # the keyword with a sign in it cannot match
    assert [column_label(i) for i in (0, 25, 26, 52, 701, 702)] == ["A", "Z", "AA", "BA", "ZZ", "AAA"]


def test_plan_edits():
    rows = [{"index": 0, "header": "a", "semantic": "name", "score": 0.9, "suggested_mode": "fake", "low_cardinality": False}, {"index": 1, "header": "b", "semantic": "unknown", "score": 0.2, "suggested_mode": "hash", "low_cardinality": True}]
    plan = RedactionPlan.from_profile(rows)
    assert [p.mode for p in plan] == ["fake", None] and [p.mode for p in plan.select_all()] == ["fake", "hash"] and not plan.clear().active
    assert plan.with_mode(1, "hash").warnings(["Other"]) == ["b: fewer than 20 distinct values, so frequencies give hashes away", "Other: passes through unredacted"]
    jobs = build_jobs({"S": (2, plan)}, "en")
    assert jobs[0].header_row == 2 and {p.options.locale for p in jobs[0].plans} == {"en"}
    assert (is_low_cardinality(2, 10000), is_low_cardinality(9000, 10000), is_low_cardinality(2, 10)) == (True, False, False)
    assert [confidence_band(x) for x in (0.8, 0.5, 0.49)] == ["high", "medium", "low"]
    assert default_sheets([{"name": "x", "row_count": 1}, {"name": "y", "row_count": 2}]) == ["y"]
    one, two = [{"name": "y", "row_count": 2}], [{"name": "x", "row_count": 1}, {"name": "y", "row_count": 2}]
    assert [opening_step(one, {"y": 0}), opening_step(one, {"y": None}), opening_step(one, {"y": 0}, auto=False)] == [("columns", "y"), ("header", "y"), ("sheets", "y")]
    assert opening_step(two, {"x": 0, "y": 0}) == ("sheets", "y") and opening_step([], {}) == ("sheets", "") and opening_step(two[:1], {})[1] == "x"
    with pytest.raises(ValueError):
        ColumnPlan(0, "a", mode="erase")


def test_hashes(spark):
    df = spark.range(4500).select(F.concat(F.lit("user"), "id").alias("v"))
    assert df.select(digest(F.col("v"), "s", 64)).distinct().count() == 4500
    one = lambda n: df.limit(1).select(digest(F.lit("x"), "s", n)).first()[0]
    assert [len(one(n)) for n in (1, 8, 12, 99)] == [4, 8, 12, 64] and len({random_salt() for _ in range(5)}) == 5


def test_aliases_go_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c")], "row int, v string")
    assert {r.key: r.alias for r in alias_table(df, F.col("v"), "row", "USER").collect()} == {"b": "USER_0001", "a": "USER_0002", "c": "USER_0003"}
    out = redact(df, plan_of(df, v=("hash", "unknown", {"hash_style": "sequential", "alias_prefix": ""})), order_col="row").orderBy("row")
    assert [r.v for r in out.collect()] == ["ID_0001", "ID_0002", "ID_0001", None, "", "ID_0003"]
    many = spark.range(12000).select("id", F.col("id").cast("string").alias("v"))
    wide = alias_table(many, F.col("v"), "id")
    assert wide.where("key = '0'").first().alias == "ID_00001" and wide.where("key = '11999'").first().alias == "ID_12000"
    with pytest.raises(ValueError):
        redact(df, plan_of(df, v=("hash", "unknown", {"hash_style": "sequential"})))


def test_redaction_of_all_modes(spark):
    df = spark.createDataFrame([("Budi Santoso", 1500000.0, datetime(1990, 1, 25), "x"), (None, None, None, ""), ("Siti", 2.5, datetime(2001, 2, 3), "y")], "n string, a double, d timestamp_ntz, `odd name` string")
    counts = Observation()
    plan = plan_of(df, n=("partial", "name", {"mask_char": "#"}), a=("partial", "currency", {}), d=("partial", "date", {}), **{"odd name": ("blank", "text", {})})
    rows = redact(df, plan, "s", counts=counts).collect()
    assert [tuple(r) for r in rows] == [("B### S######", "*******", "1990-**-**", ""), (None, None, None, ""), ("S###", "***", "2001-**-**", "")]
    assert counts.get == {"c0": 2, "c1": 2, "c2": 2, "c3": 2}
    assert {r.header: r.cells_changed for r in change_counts(df, plan, "s").collect()} == {"n": 2, "a": 2, "d": 2, "odd name": 2}
    same = redact(df, plan_of(df, n=("hash", "name", {})), "s").collect()
    assert re.fullmatch("[0-9a-f]{12}", same[0].n) and same[0].a == 1500000.0 and same[1].n is None


def test_one_salt_per_run_keeps_joins(spark):
    df = spark.createDataFrame([("k1", "k1"), ("k2", "k1")], "a string, b string")
    rows = redact(df, plan_of(df, a=("hash", "unknown", {}), b=("hash", "unknown", {}))).collect()
    assert rows[0].a == rows[0].b == rows[1].b != rows[1].a
    fixed = redact(df, plan_of(df, a=("hash", "unknown", {"salt": "x"})), "y").first().a
    assert fixed == redact(df, plan_of(df, a=("hash", "unknown", {"salt": "x"})), "z").first().a


def test_fakes_are_consistent_unless_told_otherwise(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "v string")
    out = [r.v for r in redact(df, plan_of(df, v=("fake", "name", {})), "s").collect()]
    assert out[0] == out[1] and out[2:] == ["", None]
    many = spark.range(60).select(F.lit("same").alias("v"))
    assert redact(many, plan_of(many, v=("fake", "phone", {"consistent": False})), "s").distinct().count() > 30
    money = spark.createDataFrame([(5e6,)], "v double")
    assert len(redact(money, plan_of(money, v=("fake", "currency", {"keep_magnitude": True})), "s").first().v) == 7


def test_preview(spark):
    df = spark.createDataFrame([(n, f"v{n % 3}", datetime(2020, 1, 1 + n)) for n in range(9, -1, -1)], "row int, v string, d timestamp_ntz")
    rows = preview(df, plan_of(df, v=("hash", "unknown", {"hash_style": "sequential"})), "row", 4).collect()
    assert [r.before for r in rows][:2] == [["0", "v0", "2020-01-01"], ["1", "v1", "2020-01-02"]]
    assert [r.after[1] for r in rows] == ["ID_0001", "ID_0002", "ID_0003", "ID_0001"]


PROFILES = [
    ("email", ["a@b.com", "c@d.org", "e@f.net"] * 60, "email", 0.9, 1.0, "both"),
    ("col_7", ["a@b.com", "c@d.org"], "email", 0.7, 1.0, "100% of sampled values match email"),
    ("nama_lengkap", ["x1", "y2"], "name", 0.8, 0.8, "Header"),
    ("nomor", ["3175012501900001", "3175016501900001"], "nik", 0.7, 1.0, ""),
    ("notes", ["This sentence is far too long to be a code or any identifier"] * 30, "text", 0.3, 0.3, "Long free text"),
    ("quantity", ["1", "2", "3", "4"], "unknown", 0.0, 0.0, "No signal"),
    ("Catatan", ["Approved by Budi Santoso i"] * 30, "text", 0.75, 0.75, "name"),
    ("memo", ["nik is 3175012501900001 there"] * 10, "nik", 1.0, 1.0, "nik"),
    ("status", ["all fine here today"] * 30, "unknown", 0.0, 0.0, ""),
    ("code", ["OK 123"] * 5, "unknown", 0.0, 0.0, ""),
    ("gaji", ["1500000", "2000"], "currency", 1.0, 1.0, "both"),
]


@pytest.mark.parametrize(("header", "values", "semantic", "low", "high", "reason"), PROFILES, ids=[p[0] for p in PROFILES])
def test_profiles(spark, header, values, semantic, low, high, reason):
    df = spark.createDataFrame(list(enumerate(values)), "row int, v string")
    r = profile(df, "row", ["v"], [header]).first()
    assert r.semantic == semantic and low <= r.score <= high and reason in r.reason
    assert r.filled_count == len(values) and r.distinct_count == len(set(values)) and all(len(s) <= 18 for s in r.samples)


def test_profile_counts_samples_and_types(spark):
    df = spark.createDataFrame([(n, v, datetime(2020, 1, 1), 1.0, None) for n, v in enumerate(["a", "b", "a", None, "", " "] + ["z" * 50])], "row int, x string, d timestamp_ntz, n double, e string")
    rows = {r.header: r for r in profile(df, "row").collect()}
    assert (rows["x"].filled_count, rows["x"].distinct_count, rows["x"].samples) == (4, 3, ["a", "b", "a"])
    assert rows["d"].semantic == "date" and rows["d"].samples[0] == "2020-01-01" and rows["d"].suggested_mode == "partial"
    assert (rows["e"].filled_count, rows["e"].distinct_count, rows["e"].samples, rows["e"].semantic) == (0, 0, [], "unknown")
    big = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "L").otherwise("P").alias("gender"))
    assert profile(big, "id").first().low_cardinality
    assert profile(df.limit(0), "row").count() == 4


def sheet(spark, rows):
    def cell(v):
        if v is None:
            return (None,) * 5
        if isinstance(v, str):
            return ("s", v, None, None, None)
        return ("n", None, float(v), None, None)

    return spark.createDataFrame([(i, [cell(v) for v in r]) for i, r in enumerate(rows)], SHEET)


HEADER_CASES = [
    ([["Nama", "Email", "Gaji"], ["Budi", "b@a.com", 1], ["Siti", "s@a.com", 2]], 0),
    ([["Laporan", None, None], [None, None, None], ["Nama", "Email", "Gaji"], ["Budi", "b@a.com", 1], ["Siti", "s@a.com", 2]], 2),
    ([[1, 2, 3], [4, 5, 6], [7, 8, 9]], None),
    ([], None),
]


@pytest.mark.parametrize(("rows", "want"), HEADER_CASES)
def test_header_rows(spark, rows, want):
    got = detect_header_row(sheet(spark, rows)).first()
    assert got.header_index == want and len(got.candidates) == min(10, len(rows)) and 0 <= got.confidence <= 1


def test_header_labels_and_tables(spark):
    s = sheet(spark, [["Nama", None, "Gaji"], ["Budi", "x", 5]])
    assert headers_of(s, 0) == ["Nama", "Column B", "Gaji"]
    assert headers_of(sheet(spark, [["A"], ["1", "2", "3"]]), 0) == ["A", "Column B", "Column C"]
    wide = sheet(spark, [["A"], *[["1"]] * 60, ["1", "2"]])
    assert headers_of(wide, 0) == ["A", "Column B"]  # the widest row counts wherever it is
    assert header_scores(sheet(spark, [["Title"], ["Nama", "Email"], ["Budi", "b@a.com"]])).count() == 3
    assert [tuple(r) for r in to_table(sheet(spark, [["A", "A"], ["x", 5]]), 0).collect()] == [(1, "x", "5")]


ROWS = [["Nama", "Email", "Tgl", "Gaji", "Ya"], ["Budi & <Co>", "b@a.com", datetime(1990, 1, 25, 12), 1500000.5, True], ["Siti", None, None, -3.0, False]]


def test_workbook_round_trip(spark, tmp_path):
    data = build_workbook([("Employees", iter(ROWS)), ("Bad/Name:Here", iter([["x"]])), ("x" * 50, iter([["y"]]))])
    rows = list(read_workbook(data))
    assert [r[0] for r in rows] == ["Employees"] * 3 + ["Bad_Name_Here", "x" * 31]
    cells = [c for c in rows[1][3]]
    assert [c["t"] for c in cells] == ["s", "s", "d", "n", "b"] and cells[0]["s"] == "Budi & <Co>" and cells[2]["d"] == datetime(1990, 1, 25, 12) and cells[3]["n"] == 1500000.5
    assert [c["t"] for c in rows[2][3]] == ["s", None, None, "n", "b"]
    path = tmp_path / "book.xlsx"
    path.write_bytes(data)
    register(spark)
    df = spark.read.format("xlsx").option("sheet", "Employees").load(str(path))
    assert df.count() == 3 and spark.read.format("xlsx").option("sheet", "None").load(str(path)).count() == 0
    assert len(file_hashes(spark, str(path)).first().sha256) == 64


def test_sheet_and_file_names():
    assert safe_sheet_names(["a/b", "a:b", "", "x" * 40, "x" * 33]) == ["a_b", "a_b~2", "Sheet1", "x" * 31, "x" * 29 + "~2"]
    assert output_names("/tmp/staff.2024.xlsx", "csv") == ("staff.2024-redacted.csv", "staff.2024-redacted-audit.json")
    assert accepts("A.XLSX") and accepts("b.xlsm") and not accepts("c.xls")
    assert serial_date(44000).date().isoformat() == "2020-06-18" and serial_date(1).date().isoformat() == "1900-01-01"
    assert csv_bytes(iter([["é", 1.0, None, True]])) == b"\xef\xbb\xbf" + "é,1,,TRUE\n".encode()


def test_export(spark, tmp_path):
    path = tmp_path / "hr.xlsx"
    people = [["Report"], ["Nama", "Email", "Qty"], *[[f"Budi Santoso{'x' * (n % 3)}", f"u{n}@a.com", float(n)] for n in range(45)]]
    path.write_bytes(build_workbook([("People", iter(people)), ("Other", iter([["a", "b"], ["c", "d"]]))]))
    session = WorkbookSession(spark, str(path), salt="s")
    assert [s["name"] for s in session.sheets()] == ["People", "Other"]
    head = session.header_row("People")
    plan = session.plan("People", head)
    assert head == 1 and [p.semantic for p in plan][:2] == ["name", "email"] and [p.mode for p in plan] == ["fake", "partial", None]
    job = SheetJob("People", head, plan)
    before = session.preview(job, 5)
    assert len(before) == 5 and before[0]["before"][1] == "u0@a.com" and before[0]["after"][1] == "u*@a.com"
    audit = session.export([job], str(tmp_path / "out"), "whole-workbook")
    assert audit_summary(audit) == {"redacted": 1, "passed_through": 1, "dropped": 0, "cells_changed": 90, "untouched": ["Other"]}
    written = list(read_workbook((tmp_path / "out" / "hr-redacted.xlsx").read_bytes()))
    assert [c["s"] or c["n"] for c in written[0][3]] == ["Nama", "Email", "Qty"] and written[1][3][1]["s"] == before[0]["after"][1] and written[1][3][2]["n"] == 0.0
    assert [r[0] for r in written].count("Other") == 2 and "Report" not in str(written)
    assert json.loads((tmp_path / "out" / "hr-redacted-audit.json").read_text()) == audit
    flat = session.export([job], str(tmp_path / "csv"), "whole-workbook", "csv")
    assert (tmp_path / "csv" / "hr-redacted.csv").read_bytes().startswith(b"\xef\xbb\xbfNama,Email,Qty") and audit_summary(flat)["dropped"] == 1
    session.close()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"user{n}", datetime(2024, 1, 1, n % 3)) for n in range(30)], "id int, v string, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    plan = plan_of(rows, v=("hash", "unknown", {}))
    query = redact_stream(stream, plan, "s").writeStream.format("memory").queryName("redacted").start()
    query.processAllAvailable()
    query.stop()
    batch = {tuple(r) for r in redact(rows, plan, "s").select("id", "v").collect()}
    assert {tuple(r) for r in spark.table("redacted").select("id", "v").collect()} == batch
    counts = change_counts_by_window(stream, plan, "s", "ts").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    counts.processAllAvailable()
    counts.stop()
    assert sorted(r.c1 for r in spark.table("counts").collect()) == [10, 10, 10]
    with pytest.raises(ValueError):
        redact_stream(stream, plan_of(rows, v=("hash", "unknown", {"hash_style": "sequential"})), "s")


def test_columns_of_any_name_and_ties_in_previews(spark):
    rows = [(1, "Ann", "x", "k", 5), (1, "Bob", "y", "l", 6), (1, "Cid", "z", "m", 7), (2, "Ann", "w", "n", 8)]
    df = spark.createDataFrame(rows, "_r0 long, r1 string, _k1 string, key string, alias int")
    plan = RedactionPlan([ColumnPlan(0, "_r0", "text", "hash", RedactOptions()), ColumnPlan(1, "r1", "name", "hash", RedactOptions(hash_style="sequential")), ColumnPlan(3, "key", "text", "blank", RedactOptions())])
    out = redact(df, plan, "s", "_r0")
    assert out.columns == df.columns and sorted((r["r1"], r["_k1"], r["key"], r["alias"]) for r in out.collect()) == [("ID_0001", "w", "", 8), ("ID_0001", "x", "", 5), ("ID_0002", "y", "", 6), ("ID_0003", "z", "", 7)]
    seen = preview(df, plan, "_r0", 3, "s").collect()
    assert sorted((r.before[1], r.before[2], r.after[1], r.after[3]) for r in seen) == [("Ann", "x", "ID_0001", ""), ("Bob", "y", "ID_0002", ""), ("Cid", "z", "ID_0003", "")]


def test_tables_are_written_and_counted_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(n, None if n % 3 else f"name {n}", "z") for n in range(30)], "id long, name string, other string")
    plan = RedactionPlan([ColumnPlan(1, "name", "name", "hash", RedactOptions()), ColumnPlan(2, "other", "text", "blank", RedactOptions(blank_with="z"))])
    for fmt in ("parquet", "csv"):
        got = write_redacted(df, plan, f"{tmp_path}/{fmt}", "people", fmt, "s")
        assert (got.action, got.row_count, [c["cellsChanged"] for c in got.columns]) == ("redacted", 30, [10, 0])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/parquet").collect())) == sorted(map(tuple, redact(df, plan, "s").collect()))
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == df.columns
    assert write_redacted(df, RedactionPlan(), f"{tmp_path}/plain", "people").action == "passed-through"
    with pytest.raises(ValueError):
        write_redacted(df, plan, f"{tmp_path}/x", "people", "xlsx")
    with pytest.raises(ValueError):
        build_workbook([("a", iter([["x" * 40_000]]))])


def _big_book(path, rows):
    """A workbook of shared texts with a dimension, as other programs write it, of one sheet and a small second one."""
    import zipfile

    from maskwright.sources.xlsx import WorkbookFile

    book = WorkbookFile(str(path))
    book.add("Data")
    for n in range(3):
        book.row([n])
    book.add("Small")
    book.row(["x", 1.0])
    book.close()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = "".join(f"<si><t>text {n}</t></si>" for n in range(rows))
    data = "".join(f'<row r="{n + 1}"><c r="B{n + 1}" t="s"><v>{n}</v></c><c r="C{n + 1}"><v>{n}</v></c></row>' for n in range(rows))
    with zipfile.ZipFile(path) as old:
        parts = {i.filename: old.read(i.filename) for i in old.infolist()}
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet {main}><dimension ref="B1:D{rows}"/><sheetData>{data}</sheetData></worksheet>'.encode()
    parts["xl/sharedStrings.xml"] = f"<sst {main}>{shared}</sst>".encode()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)


class _Counting(io.FileIO):
    """A file that counts what is read of it."""

    def __init__(self, path):
        super().__init__(path)
        self.total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def test_reading_stops_at_the_last_row_asked_for(spark, tmp_path):
    path = tmp_path / "big.xlsx"
    _big_book(path, 500_000)
    size = path.stat().st_size
    with _Counting(path) as f, Book(f) as book:
        rows = list(book.rows(book.sheets[0], 12))
        assert len(rows) == 12 and [c["s"] or c["n"] for c in rows[11][1]] == ["text 11", 11.0, None]
        assert size > 4_000_000 and f.total < 400_000
    register(spark)
    df = spark.read.format("xlsx").load(str(path))
    assert df.rdd.getNumPartitions() == 2
    first = df.where("sheet = 'Data' and row_idx < 12")
    assert first.rdd.getNumPartitions() == 1 and first.count() == 12
    assert "Filter (" not in first._jdf.queryExecution().executedPlan().toString()
    assert [r.row_idx for r in df.where("sheet = 'Data' and row_idx = 3 and cells[0].s = 'text 3'").collect()] == [3]
    assert df.where("sheet = 'No'").count() == 0 and df.where("row_idx < 0").count() == 0
    assert read_xlsx(spark, str(path), "Data", 5).count() == 5 and read_xlsx(spark, str(path), "Small").count() == 1


def test_sheets_that_say_nothing_of_their_size(tmp_path):
    data = build_workbook([("a", iter([[None, "x"], [None, None], [None, "y", 3], [None, "z"]])), ("b", iter([]))])
    rows = [(at, [c["s"] or c["n"] for c in cells]) for _, _, at, cells in read_workbook(data)]
    assert rows == [(0, ["x", None]), (1, [None, None]), (2, ["y", 3.0]), (3, ["z", None])]
    assert [len(c) for _, _, _, c in read_workbook(data, limit=2)] == [1, 1]  # as wide as the rows that are read


def test_part_workbooks_by_the_executors(spark, tmp_path):
    register(spark)
    df = spark.range(1000).select("id", F.concat(F.lit("é "), "id").alias("name"), (F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("even"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("at")).repartition(3)
    df.write.format("xlsx").mode("append").option("sheet", "T/1").option("maxRows", 200).save(f"{tmp_path}/x")
    parts = parts_of(f"{tmp_path}/x")
    assert len(parts) >= 6 and sum(p["rows"] for p in parts) == 1000 and all(hashlib.sha256((tmp_path / "x" / p["name"]).read_bytes()).hexdigest() == p["sha256"] for p in parts)
    assert sorted(os.listdir(f"{tmp_path}/x")) == sorted(["_parts.json", *[p["name"] for p in parts]])
    back = to_table(sheet_rows(read_xlsx(spark, f"{tmp_path}/x/*.xlsx"), "T_1"), 0, df.columns)
    want = {(str(r.id), r.name, str(r.x).removesuffix(".0"), str(r.even).lower(), r["at"].strftime("%Y-%m-%dT%H:%M:%S.000Z")) for r in df.collect()}
    assert {tuple(r)[1:] for r in back.collect()} == want
    df.limit(10).coalesce(1).write.format("xlsx").mode("overwrite").save(f"{tmp_path}/x")
    assert [p["rows"] for p in parts_of(f"{tmp_path}/x")] == [10] and len(os.listdir(f"{tmp_path}/x")) == 2
    df.where("id < 0").write.format("csv_bom").mode("append").save(f"{tmp_path}/none")
    assert [open(f"{tmp_path}/none/{p['name']}", "rb").read() for p in parts_of(f"{tmp_path}/none")] == [b"\xef\xbb\xbfid,name,x,even,at\n"]
    df.write.format("csv_bom").mode("append").save(f"{tmp_path}/c")
    files = [open(f"{tmp_path}/c/{p['name']}", "rb").read() for p in parts_of(f"{tmp_path}/c")]
    assert len(files) == 3 and all(f.startswith(b"\xef\xbb\xbfid,name") for f in files) and sorted(int(x.split(",")[0]) for f in files for x in f.decode("utf-8-sig").splitlines()[1:]) == list(range(1000))


def test_a_failed_write_leaves_no_half_file(spark, tmp_path):
    register(spark)
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.repeat(F.lit("x"), 40_000)).otherwise("y").alias("v")).repartition(4)
    with pytest.raises(Exception, match="32767 characters"):
        bad.write.format("xlsx").mode("append").save(f"{tmp_path}/x")
    assert os.listdir(f"{tmp_path}/x") == []
    spark.range(5).write.format("xlsx").mode("append").save(f"{tmp_path}/x")
    with pytest.raises(Exception, match="32767 characters"):
        bad.write.format("xlsx").mode("overwrite").save(f"{tmp_path}/x")
    assert sum(p["rows"] for p in parts_of(f"{tmp_path}/x")) == 5 and len(os.listdir(f"{tmp_path}/x")) == 1 + len(parts_of(f"{tmp_path}/x"))  # what was there stays
    # a task that was killed leaves its file in a hidden folder, which readers pass over
    os.makedirs(f"{tmp_path}/x/_writing-1")
    open(f"{tmp_path}/x/_writing-1/part.xlsx", "wb").write(b"half")
    assert spark.read.format("xlsx").load(f"{tmp_path}/x").where("row_idx > 0").count() == 5
    with pytest.raises(Exception, match="nested"):
        spark.range(1).select(F.array("id").alias("a")).write.format("xlsx").mode("append").save(f"{tmp_path}/y")


def test_redacted_parts_and_their_audit(spark, tmp_path):
    df = spark.createDataFrame([(n, None if n % 3 else f"name {n}", "z") for n in range(30)], "id long, name string, other string").repartition(2)
    plan = RedactionPlan([ColumnPlan(1, "name", "name", "hash", RedactOptions())])
    for fmt in ("xlsx", "csv_bom"):
        done, parts = write_parts(df, plan, f"{tmp_path}/{fmt}", "people", fmt, "s")
        assert (done.action, done.row_count, done.columns[0]["cellsChanged"], sum(p["rows"] for p in parts)) == ("redacted", 30, 10, 30)
        assert audit_report("t", "a", "b", "selected-only", fmt, [done], parts)["parts"] == parts
    got = to_table(sheet_rows(read_xlsx(spark, f"{tmp_path}/xlsx/*.xlsx"), "people"), 0, df.columns).select("id", "name", "other")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((str(r.id), r.name, r.other) for r in redact(df, plan, "s").collect()), key=str)


def test_registered_detectors_and_modes(spark):
    rows = [(n, f"B {1000 + n} XY", f"n{n}") for n in range(50)]
    df = spark.createDataFrame(rows, "id long, plat string, note string")
    before = [r.semantic for r in profile(df, "id").orderBy("index").collect()]
    registry.register_mode("tail", lambda text, plan, salt: F.concat(F.lit("."), F.right(text, F.lit(plan.options.keep_end or 2))))
    try:
        test = sql_predicate(spark, "plate", r"rlike(mw_trim(t), r'^[A-Z]{1,2} [0-9]{1,4} [A-Z]{1,3}\z')") if register_sql(spark) else None
        with registry.registered("plate", test, before="name", headers=["plat"], mode="tail"):
            assert registry.detectors().index("plate") == registry.detectors().index("name") - 1
            found = [r.asDict() for r in profile(df, "id").orderBy("index").collect()]
            with pytest.raises(ValueError):
                registry.register_detector("plate", test)
        plan = RedactionPlan.from_profile([p | {"index": p["index"] + 1} for p in found])
        assert found[0]["semantic"] == "plate" and found[0]["reason"] == "Header and values both look like plate" and plan[0].mode == "tail" and plan[1].mode is None
        assert [tuple(r) for r in redact(df, plan, "s").orderBy("id").limit(2).collect()] == [(0, ".XY", "n0"), (1, ".XY", "n1")]
        with registry.registered("strict", lambda t: t.isNotNull(), requires_header=True):
            assert [r.semantic for r in profile(df, "id").orderBy("index").collect()] == before
    finally:
        registry.unregister("tail")
    assert [r.semantic for r in profile(df, "id").orderBy("index").collect()] == before and "tail" not in registry.MODES
    with pytest.raises(ValueError):
        ColumnPlan(0, "x", "text", "tail")
    with pytest.raises(ValueError):
        registry.register_detector("email", test)


def test_sketches_are_one_scan_and_merge(spark, tmp_path):
    rows = [(n, f"u{n % 300}@a.com" if n % 7 else None, float(n % 5), "" if n % 2 else "long text " * 10, None) for n in range(3000)]
    df = spark.createDataFrame(rows, "id long, email string, qty double, note string, nothing string")
    df.repartition(4).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    made = sketch(t, "id")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan and "Python" not in plan and plan.count("Exchange") == 1
    parts = []
    for n in range(3):
        sketch(t.where(f"id % 3 = {n}"), "id").write.parquet(f"{tmp_path}/s{n}")
        parts.append(spark.read.parquet(f"{tmp_path}/s{n}"))
    merge(*parts).write.parquet(f"{tmp_path}/all")
    kept = spark.read.parquet(f"{tmp_path}/all")
    whole = profile(t, "id").orderBy("index").collect()
    got = profile_of(kept, t.columns[1:]).orderBy("index").collect()
    assert [r.asDict() | {"distinct_count": 0} for r in got] == [r.asDict() | {"distinct_count": 0} for r in whole]
    assert all(abs(a.distinct_count - b.distinct_count) <= 0.02 * b.distinct_count for a, b in zip(got, whole, strict=True))
    assert [r.distinct_count for r in whole] == [300, 5, 1, 0] and [r.filled_count for r in whole] == [2571, 3000, 1500, 0]
    assert [r.asDict() for r in profile(t.where("id < 0"), "id").orderBy("index").collect()][0]["filled_count"] == 0

def aliased(df):
    return plan_of(df, v=("hash", "unknown", {"hash_style": "sequential"}))


def test_kept_aliases_never_change(spark, tmp_path):
    known = AliasDictionary(str(tmp_path / "aliases"), "USER")
    assert known.aliases(spark).count() == 0
    frame = lambda *rows: spark.createDataFrame(rows, "row int, v string")
    first = frame((3, "b"), (1, "a"), (2, "b"), (4, None), (5, ""))
    assert {r.key: r.alias for r in known.extend(first, F.col("v"), "row").collect()} == {"a": "USER_0001", "b": "USER_0002"}
    files = sorted(os.listdir(tmp_path / "aliases"))
    known.extend(first, F.col("v"), "row")
    assert sorted(os.listdir(tmp_path / "aliases")) == files  # nothing new, nothing written
    # d and c come at one place, before the known ones
    later = frame((0, "d"), (0, "c"), (1, "b"), (9, "a"), (10, "e"))
    out = redact(later, aliased(later), "s", "row", dictionaries={"v": known})
    assert {(r.row, r.v) for r in out.collect()} == {(0, "USER_0003"), (0, "USER_0004"), (1, "USER_0002"), (9, "USER_0001"), (10, "USER_0005")}
    assert {r.key: r.alias for r in known.aliases(spark).collect()} == {"a": "USER_0001", "b": "USER_0002", "c": "USER_0003", "d": "USER_0004", "e": "USER_0005"}
    # numbers beyond the digits get longer, the others stay
    short = AliasDictionary(str(tmp_path / "short"), "N", digits=1)
    got = {r.key: r.alias for r in short.extend(spark.range(12).select("id", F.col("id").cast("string").alias("v")), F.col("v"), "id").collect()}
    assert got["0"] == "N_1" and got["11"] == "N_12" and len(set(got.values())) == 12
    # a run that died while it added keys: what is there stays, the rest follows the largest number
    torn = AliasDictionary(str(tmp_path / "torn"))
    spark.createDataFrame([("a", 1), ("c", 3)], "key string, number long").write.parquet(torn.path)
    abc = frame((1, "a"), (2, "b"), (3, "c"))
    assert {r.key: r.alias for r in torn.extend(abc, F.col("v"), "row").collect()} == {"a": "ID_0001", "b": "ID_0004", "c": "ID_0003"}


def test_write_with_kept_aliases(spark, tmp_path):
    known = {"v": AliasDictionary(str(tmp_path / "aliases"))}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "")], "row int, v string")
    for run in ("one", "two"):
        done = write_redacted(rows, aliased(rows), str(tmp_path / run), "t", order_col="row", dictionaries=known)
        assert done.columns[0]["cellsChanged"] == 3
        assert [r.v for r in spark.read.parquet(str(tmp_path / run)).orderBy("row").collect()] == ["ID_0001", "ID_0002", "ID_0001", ""]


def test_stream_aliases_are_the_same_on_replay(spark, tmp_path):
    base, known = str(tmp_path), AliasDictionary(str(tmp_path / "aliases"))
    arrive = lambda *rows: spark.createDataFrame(rows, "row int, v string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    arrive((5, "b"), (6, "a"), (7, "b"), (8, None))
    stream = spark.readStream.schema("row int, v string").parquet(f"{base}/in")
    plan = aliased(stream)
    with pytest.raises(ValueError, match="need a dictionary for v"):
        alias_writer(stream, plan, "s", f"{base}/out", "row", {})

    def run():
        writer = alias_writer(stream, plan, "s", f"{base}/out", "row", {"v": known})
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch, r.row, r.v or "") for r in spark.read.parquet(f"{base}/out").collect())

    first = [(0, 5, "ID_0001"), (0, 6, "ID_0002"), (0, 7, "ID_0001"), (0, 8, "")]
    assert run() == first
    arrive((1, "a"), (2, "c"))  # late rows: a known key, and a new one
    both = [*first, (1, 1, "ID_0002"), (1, 2, "ID_0003")]
    assert run() == both
    # the last batch was not yet committed when the stream died: it is run again
    for name in ("1", ".1.crc"):
        os.remove(f"{base}/state/commits/{name}")
    assert run() == both and known.aliases(spark).count() == 3


def test_values_that_repeat_are_drawn_once(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("n"), F.col("id") % 30).alias("name"), F.concat(F.lit("m"), "id").alias("mail"), F.when(F.col("id") % 3 > 0, F.col("id") % 5 * 1.5).alias("pay"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, "").otherwise("4").alias("card"))
    plan = plan_of(
        df, name=("fake", "name", {}), mail=("fake", "email", {}), pay=("fake", "currency", {}), none=("fake", "name", {}), card=("fake", "card", {"force_invalid_luhn": True})
    )
    assert set(drawn_tables(df, plan, "s")) == {1, 3, 5}
    seen = Observation()
    once, each = redact(df, plan, "s", counts=seen, draw_once=True), redact(df, plan, "s")
    assert once.columns == df.columns and sorted(map(str, once.collect())) == sorted(map(str, each.collect()))
    assert seen.get == {"c1": 3000, "c2": 3000, "c3": 2000, "c4": 0, "c5": 1500}
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (once, each)]
    assert plans[0].count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plans[0] and "Join" not in plans[1]
    kept = plan_of(df, pay=("fake", "currency", {"keep_magnitude": True}), name=("fake", "name", {"consistent": False}))
    assert drawn_tables(df, kept, "s") == {} and drawn_tables(df.limit(0), plan, "s") == {}


def test_large_tables_of_draws_are_not_broadcast(spark, monkeypatch):
    import maskwright.operators.redact as m

    df = spark.range(2000).select(F.concat(F.lit("n"), F.col("id") % 50).alias("name"))
    plan = plan_of(df, name=("fake", "name", {}))
    assert set(drawn_tables(df, plan, "s")) == {0}
    monkeypatch.setattr(m, "DRAWN_BYTES", 1000)
    assert drawn_tables(df, plan, "s") == {}
    assert sorted(map(str, redact(df, plan, "s", draw_once=True).collect())) == sorted(map(str, redact(df, plan, "s").collect()))
