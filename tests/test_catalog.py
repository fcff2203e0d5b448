"""Every query of the catalogue against its SQL over the smallest tables, and what the pipeline folder's absence leaves."""

import glob
import numbers
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from maskwright import catalog

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if pd.isna(v) else f"{v:.6f}" if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted(tuple("" if (x := plain(v)) is None else "=" + x for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, DATA)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.toPandas()) == rows(theirs.df())


def test_header_query(spark):
    got = {r.header: r.semantic for r in catalog.QUERIES["header_scores"](spark, DATA).collect()}
    assert got["Nama Lengkap"] == "name" and got["order ref"] == "unknown" and got["Gaji"] == "currency"


def test_hot_paths_stay_in_the_jvm(spark):
    for name in ("redact_orders_flagship", "profile_customer", "fake_nik_id", "valid_card"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_scans_read_only_what_is_needed(spark):
    plan = catalog.QUERIES["hash_sha256"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_entry_works_without_the_pipeline_folder(tmp_path):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['maskwright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
