"""The engine's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sqltwins as q
from .functions import cells, masks, validators
from .functions.fake import draws, fake, fake_currency, fnv_seed
from .functions.sql import register_sql, sql_predicate
from .operators.alias_dictionary import AliasDictionary
from .operators.header_row import SHEET, detect_header_row, header_scores, headers_of, to_table
from .operators.profile import merge, profile, profile_of, sketch
from .operators.pseudonym import alias_table, consistent_fake, digest
from .operators.redact import SheetResult, audit_report, audit_summary, change_counts, preview, redact, write_parts, write_redacted
from .plans import registry
from .plans.lexicon import HEADER_LEXICON, MODE_FOR_TYPE, column_label, score_header
from .plans.plan import ColumnPlan, RedactionPlan, RedactOptions, confidence_band
from .session import run_path, stash
from .sources.xlsx import read_xlsx, sheet_rows, summarise
from .sources.xlsx_sink import as_sheet, header_sheet, write_book
from .streaming.redact_stream import alias_writer, change_counts_by_window, redact_stream

SALT = "fixed-salt"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
S, D, TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def cellwise(name: str, source: str, key: str, value: str, spark_value, sql_value: str, out: str = "out") -> None:
    """One value per row; `value` is SQL that both engines read alike."""
    add(name, lambda s, d: table(s, d, source).select(F.col(key), F.expr(value).alias("v")).select(key, "v", spark_value(F.col("v")).alias(out)), f"SELECT {key}, v, {sql_value} AS {out} FROM (SELECT {key}, {value} AS v FROM {source})")


# --- masks
cellwise("blank_default", "customer", "c_custkey", "c_name", lambda v: F.when(cells.is_empty(v, S), v).otherwise(F.lit("")), "''")
cellwise("blank_marker", "customer", "c_custkey", "c_name", lambda v: F.when(cells.is_empty(v, S), v).otherwise(F.lit("[removed]")), "'[removed]'")
cellwise("partial_generic", "part", "p_partkey", "p_name", lambda v: masks.mask_generic(v), q.generic("v"))
cellwise("partial_generic_wide", "orders", "o_orderkey", "o_orderpriority", lambda v: masks.mask_generic(v, 6, 6), q.generic("v", 6, 6))
cellwise("partial_generic_lengths", "customer", "c_custkey", "substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(c_custkey % 26 AS INT))", lambda v: F.when(v == "", v).otherwise(masks.mask_generic(v, 4, 3, "#")), f"CASE WHEN v = '' THEN v ELSE {q.generic('v', 4, 3, '#')} END")
EMAILS = "concat(substr('user', 1, CAST(1 + c_custkey % 4 AS INT)), CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '@' END, 'mail', c_nationkey, '.example')"
cellwise("partial_email", "customer", "c_custkey", EMAILS, lambda v: masks.mask_email(v), q.email_mask("v"))
PHONES = "concat(CASE WHEN c_custkey % 3 = 0 THEN '+62' ELSE '0' END, substr(concat('8', lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR(20)), 10, '0')), 1, CAST(4 + c_custkey % 8 AS INT)))"
cellwise("partial_phone", "customer", "c_custkey", PHONES, lambda v: masks.mask_phone(v), q.phone_mask("v"))
DIGITS = "lpad(CAST(c_custkey * 104729 % 10000000000 AS VARCHAR(20)), CAST(8 + c_custkey % 9 AS INT), '4')"
cellwise("partial_card", "customer", "c_custkey", DIGITS, lambda v: masks.mask_card(v), q.card_mask("v"))
NIKS = "concat('3175', lpad(CAST(c_custkey % 31 AS VARCHAR(20)), 2, '0'), lpad(CAST(c_custkey % 73 AS VARCHAR(20)), 2, '0'), lpad(CAST(c_custkey % 14 AS VARCHAR(20)), 2, '0'), '90', substr('0001', 1, CAST(4 - c_custkey % 5 % 2 AS INT)))"
cellwise("partial_nik", "customer", "c_custkey", NIKS, lambda v: masks.mask_nik(v), q.nik_mask("v"))
cellwise("partial_npwp", "customer", "c_custkey", DIGITS, lambda v: masks.mask_npwp(v), q.npwp_mask("v"))
add("partial_date", lambda s, d: table(s, d, "orders").select("o_orderkey", masks.mask_date(F.col("o_orderdate"), F.col("o_orderpriority"), TS).alias("out")), "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-**-**' AS out FROM orders")
DATES = "CASE WHEN o_orderkey % 4 = 0 THEN 'no year here' WHEN o_orderkey % 4 = 1 THEN concat(lpad(CAST(1 + o_orderkey % 28 AS VARCHAR(20)), 2, '0'), '/', lpad(CAST(1 + o_orderkey % 13 AS VARCHAR(20)), 2, '0'), '/', 1900 + o_orderkey % 120) ELSE concat(1890 + o_orderkey % 150, '-', 1 + o_orderkey % 14, '-', 1 + o_orderkey % 33) END"
cellwise("partial_date_text", "orders", "o_orderkey", DATES, lambda v: masks.mask_date(v, v, S), q.date_mask("v"))
cellwise("partial_name", "nation", "n_nationkey", "concat(n_name, '  ', lower(n_name), ' x')", lambda v: masks.mask_name(v), q.name_mask("v"))
ADDRESSES = "concat('Jl. ', s_name, ' No. ', s_suppkey)"
cellwise("partial_address", "supplier", "s_suppkey", ADDRESSES, lambda v: masks.mask_address(v), q.address_mask("v"))
add("partial_currency", lambda s, d: table(s, d, "customer").select("c_custkey", masks.mask_whole(cells.text_of(F.col("c_acctbal"), D)).alias("out")), f"SELECT c_custkey, repeat('*', length({q.number_text('c_acctbal')})) AS out FROM customer")
add("number_text", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", cells.text_of(F.col("l_extendedprice"), D).alias("price"), cells.text_of(F.col("l_quantity"), D).alias("quantity")), f"SELECT l_orderkey, l_linenumber, {q.number_text('l_extendedprice')} AS price, {q.number_text('l_quantity')} AS quantity FROM lineitem")


def _plan(**modes: tuple) -> Callable[[DataFrame], RedactionPlan]:
    return lambda df: RedactionPlan(ColumnPlan(df.columns.index(c), c, semantic, mode, RedactOptions(**options)) for c, (mode, semantic, options) in modes.items())


def _nulls(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("m"))
    t = t.select("c_custkey", F.col("m").alias("a"), F.col("m").alias("b"), F.col("m").alias("c"), F.col("m").alias("e"))
    return redact(t, _plan(a=("blank", "text", {}), b=("partial", "text", {}), c=("hash", "text", {}), e=("fake", "name", {}))(t), SALT)


def _fake_sql(source: str, key: str, kind: str, locale: str, value: str, salt: str = SALT) -> str:
    n, expr = q.fake(kind, locale)
    return f"SELECT {key}, {expr} AS out FROM {q.with_draws(f'SELECT {key}, {q.fnv(q.digest(value, salt))} AS seed FROM {source}', n)}"


_n, _e = q.fake("name", "id")
add(
    "null_preservation", _nulls,
    f"SELECT c_custkey, CASE WHEN m IS NOT NULL THEN '' END AS a, {q.generic('m')} AS b, {q.digest('m', SALT)} AS c, CASE WHEN m IS NOT NULL THEN {_e} END AS e FROM {q.with_draws(f"SELECT *, {q.fnv(q.digest('m', SALT))} AS seed FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS m FROM customer)", _n)}",
)

# --- hashes and aliases
cellwise("hash_sha256", "customer", "c_custkey", "c_name", lambda v: digest(v, SALT), q.digest("v", SALT))
for _len, _used in ((1, 4), (4, 4), (20, 20), (64, 64), (99, 64)):
    cellwise(f"hash_len_{_len}", "supplier", "s_suppkey", "s_name", lambda v, n=_len: digest(v, SALT, n), q.digest("v", SALT, _used))


def _hash_join(s: SparkSession, d: str) -> DataFrame:
    key = lambda c: digest(cells.text_of(F.col(c), T.LongType()), SALT, 64)
    o = table(s, d, "orders").select(key("o_custkey").alias("h"), "o_totalprice")
    c = table(s, d, "customer").select(key("c_custkey").alias("h"), "c_mktsegment")
    return o.join(c, "h").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


add("hash_join_preserved", _hash_join, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
add("hash_groupby_preserved", lambda s, d: table(s, d, "lineitem").groupBy(digest(F.col("l_suppkey").cast("string"), SALT, 64).alias("h")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")), f"SELECT sha256('{SALT}' || l_suppkey) AS h, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey")
add("hash_semi_join", lambda s, d: table(s, d, "customer").select("c_custkey", digest(F.col("c_custkey").cast("string"), SALT, 64).alias("h")).join(table(s, d, "orders").select(digest(F.col("o_custkey").cast("string"), SALT, 64).alias("h")), "h", "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")


def _alias(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return redact(t, _plan(o_custkey=("hash", "unknown", {"hash_style": "sequential", "alias_prefix": "CUST"}))(t), SALT, "o_orderkey")


_ALIAS = "SELECT o_custkey, 'CUST_' || lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), CAST(greatest(4, length(CAST(count(*) OVER () AS VARCHAR))) AS INTEGER), '0') AS alias FROM (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1)"
add("alias_sequential", _alias, f"SELECT o_orderkey, alias AS o_custkey FROM orders JOIN ({_ALIAS}) USING (o_custkey)")
add("alias_table", lambda s, d: alias_table(table(s, d, "orders"), F.col("o_custkey").cast("string"), "o_orderkey", "CUST"), f"SELECT CAST(o_custkey AS VARCHAR) AS key, alias FROM ({_ALIAS})")


#: Orders of the first run, and the aliases after a second run over all orders: customers of the first run keep theirs.
EARLIER = "o_orderdate < TIMESTAMP '1995-07-01 00:00:00'"
_RUNS = f"SELECT o_custkey, min(CASE WHEN {EARLIER} THEN o_orderkey END) AS f1, min(o_orderkey) AS f2 FROM orders GROUP BY 1"
_NUMBERED = f"SELECT o_custkey, f1, row_number() OVER (ORDER BY CASE WHEN f1 IS NULL THEN 1 ELSE 0 END, coalesce(f1, f2)) AS n FROM ({_RUNS})"
_KEPT = f"SELECT o_custkey, f1, 'CUST_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS alias FROM ({_NUMBERED})"


def _kept_aliases(s: SparkSession, d: str) -> DataFrame:
    """Every customer's alias after a run over the earlier orders (null if they were not among them) and after one over all orders."""
    known, key = AliasDictionary(run_path(s, "aliases"), "CUST"), F.col("o_custkey").cast("string")
    t = table(s, d, "orders")
    before = known.extend(t.where(EARLIER), key, "o_orderkey").withColumnRenamed("alias", "before")
    return known.extend(t, key, "o_orderkey").join(before, "key", "left")


add("alias_dictionary", _kept_aliases, f"SELECT CAST(o_custkey AS VARCHAR) AS key, alias, CASE WHEN f1 IS NOT NULL THEN alias END AS before FROM ({_KEPT})")
add(
    "hash_collisions",
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("v")).distinct().groupBy(digest(F.col("v"), SALT, 4).alias("h")).agg(F.count("*").alias("n")).where("n > 1"),
    f"SELECT {q.digest('CAST(c_custkey AS VARCHAR)', SALT, 4)} AS h, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
)

# --- fakes
cellwise("fnv_seed", "customer", "c_custkey", "c_name", lambda v: fnv_seed(digest(v, SALT)), q.fnv(q.digest("v", SALT)))
add(
    "xorshift_draws",
    lambda s, d: table(s, d, "customer").select("c_custkey", draws(fnv_seed(digest(F.col("c_name"), SALT)), 4).alias("o")).select("c_custkey", *[F.col("o")[n].alias(f"d{n + 1}") for n in range(4)]),
    f"SELECT c_custkey, {', '.join(f'x{n} AS d{n}' for n in range(1, 5))} FROM {q.with_draws(f"SELECT c_custkey, {q.fnv(q.digest('c_name', SALT))} AS seed FROM customer", 4)}",
)
for _kind, _locale in [("name", "id"), ("name", "en"), ("address", "id"), ("address", "en"), ("phone", "id"), ("phone", "en"), ("email", "id"), ("email", "en"), ("nik", "id"), ("npwp", "id"), ("card", "id"), ("date", "id")]:
    add(f"fake_{_kind}_{_locale}", lambda s, d, k=_kind, loc=_locale: table(s, d, "customer").select("c_custkey", consistent_fake(F.col("c_name"), k, loc, SALT).alias("out")), _fake_sql("customer", "c_custkey", _kind, _locale, "c_name"))



def _drawn_once(s: SparkSession, d: str) -> DataFrame:
    """Names for the suppliers of all line items, drawn once for each supplier."""
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Supplier "), "l_suppkey").alias("out"))
    return redact(t, _plan(out=("fake", "name", {}))(t), SALT, draw_once=True)


add("fake_name_drawn_once", _drawn_once, _fake_sql("lineitem", "l_orderkey, l_linenumber", "name", "id", "'Supplier ' || CAST(l_suppkey AS VARCHAR)"))
add(
    "fake_currency_magnitude",
    lambda s, d: table(s, d, "customer").select("c_custkey", fake_currency(fnv_seed(digest(F.col("c_name"), SALT)), F.col("c_acctbal")).alias("out"), fake("currency", "id", fnv_seed(digest(F.col("c_name"), SALT))).alias("plain")),
    f"SELECT c_custkey, CAST(({q.below(1, 9)} + 1) * power(10, CASE WHEN abs(c_acctbal) < 1 THEN 1 ELSE greatest(1, length(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)) - 1) END) AS DOUBLE) AS out, CAST(({q.below(1, 9)} + 1) * 1000000 AS VARCHAR) AS plain FROM {q.with_draws(f"SELECT c_custkey, c_acctbal, {q.fnv(q.digest('c_name', SALT))} AS seed FROM customer", 1)}",
)
add("fake_nik_valid", lambda s, d: table(s, d, "orders").select(consistent_fake(F.col("o_orderkey").cast("string"), "nik", "id", SALT).alias("v")).select(validators.is_nik(F.col("v")).alias("ok")).groupBy("ok").agg(F.count("*").alias("n")), f"SELECT {q.is_nik('out')} AS ok, count(*) AS n FROM ({_fake_sql('orders', 'o_orderkey', 'nik', 'id', 'CAST(o_orderkey AS VARCHAR)')}) GROUP BY 1")

# --- validators
cellwise("valid_email", "customer", "c_custkey", f"CASE WHEN c_custkey % 5 = 0 THEN concat(' ', {EMAILS}, chr(9)) WHEN c_custkey % 5 = 1 THEN concat({EMAILS}, ' x') ELSE {EMAILS} END", validators.is_email, q.is_email("v"))
cellwise("valid_phone", "customer", "c_custkey", f"CASE WHEN c_custkey % 4 = 0 THEN concat({PHONES}, '-12') ELSE {PHONES} END", validators.is_phone, q.is_phone("v"))
cellwise("valid_nik", "customer", "c_custkey", NIKS, validators.is_nik, q.is_nik("v"))
cellwise("valid_npwp", "customer", "c_custkey", DIGITS, validators.is_npwp, q.is_npwp("v"))
cellwise("valid_card", "customer", "c_custkey", DIGITS, validators.is_card, q.is_card("v"))
cellwise("valid_date", "orders", "o_orderkey", f"CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderkey % 40, ' January 19', 10 + o_orderkey % 90) ELSE {DATES} END", validators.is_date_text, q.is_date_text("v"))
cellwise("valid_currency", "customer", "c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN concat('Rp ', c_custkey, '.000') WHEN c_custkey % 4 = 1 THEN concat('$', c_custkey, ',5') WHEN c_custkey % 4 = 2 THEN c_name ELSE concat(c_custkey, ' usd') END", lambda v: validators.is_currency(v, v, S), q.is_currency_text("v"))
cellwise("valid_name", "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'Budi Santoso' WHEN c_custkey % 3 = 1 THEN c_name ELSE concat('Ágnes ', substr('abcdefgh', 1, CAST(c_custkey % 8 AS INT)), ' Ödön') END", validators.looks_like_name, q.looks_like_name("v"))
cellwise("valid_address", "supplier", "s_suppkey", f"CASE WHEN s_suppkey % 3 = 0 THEN concat('Jakartast ', s_suppkey) ELSE {ADDRESSES} END", validators.looks_like_address, q.looks_like_address("v"))
add(
    "luhn_count",
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.expr(r"regexp_extract_all(text, '[0-9]{16}', 0)")).alias("t")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(validators.is_card(F.col("t"))).alias("cards")),
    f"SELECT doc_id, count(*) AS n, count(*) FILTER ({q.is_card('t')}) AS cards FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{16}}')) AS t FROM documents) GROUP BY doc_id",
)
_KINDS = ("email", "phone", "nik", "name")


def _embedded(s: SparkSession, d: str, source: str, *by: str) -> DataFrame:
    found = table(s, d, source).select(*by, validators.find_embedded(F.col("text")).alias("found"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("found", k)).alias(f"n_{k}") for k in _KINDS])


_EMB = ", ".join(f"count(*) FILTER ({q.embedded(k, 'text')}) AS n_{k}" for k in _KINDS)
add("embedded_pii_counts", lambda s, d: _embedded(s, d, "documents"), f"SELECT count(*) AS n, {_EMB} FROM documents")
add("embedded_conversations", lambda s, d: _embedded(s, d, "conversations", "role"), f"SELECT role, count(*) AS n, {_EMB} FROM conversations GROUP BY role")
add("embedded_by_lang", lambda s, d: _embedded(s, d, "documents", "lang"), f"SELECT lang, count(*) AS n, {_EMB} FROM documents GROUP BY lang")
add(
    "embedded_strict_names",
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_contains(validators.find_embedded(F.col("text"), strict_names=True), "name").alias("strict"), F.array_contains(validators.find_embedded(F.col("text")), "name").alias("loose")).where("strict or loose"),
    f"SELECT * FROM (SELECT doc_id, {q.embedded('strict', 'text')} AS strict, {q.embedded('name', 'text')} AS loose FROM documents) WHERE strict OR loose",
)
add(
    "fake_card_invalid_luhn",
    lambda s, d: redact(t := table(s, d, "customer").select("c_custkey", F.col("c_name").alias("out")), _plan(out=("fake", "card", {"force_invalid_luhn": True}))(t), SALT),
    f"SELECT c_custkey, CASE WHEN {q.luhn('out')} THEN left(out, 15) || CAST((CAST(right(out, 1) AS INTEGER) + 1) % 10 AS VARCHAR) ELSE out END AS out FROM ({_fake_sql('customer', 'c_custkey', 'card', 'id', 'c_name')})",
)

# --- headers, profiles, plans
HEADERS = ["Nama Lengkap", "email_address", "No. HP (Aktif)", "NIK", "tgl_lahir", "Tanggal Lahir", "dinamakan", "Gaji", "c_name", "order ref", "Customer", "kode pos", "", "no_ktp", "e-mail", "pan", "expand", "ADDRESS", "npwp pribadi", "contact"]


def _headers(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, column_label(i), h, *score_header(h), confidence_band(score_header(h)[1])) for i, h in enumerate(HEADERS)], "idx int, label string, header string, semantic string, score double, band string")


_LEXICON = ", ".join(f"({n}, {q.quoted(kind)}, {q.quoted(word)})" for n, (kind, word) in enumerate((k, w) for k, ws in HEADER_LEXICON for w in ws))
_HEADS = ", ".join(f"({i}, {q.quoted(h)})" for i, h in enumerate(HEADERS))
add(
    "header_scores", _headers,
    rf"""
WITH lex(o, kind, word) AS (VALUES {_LEXICON}), h(idx, header) AS (VALUES {_HEADS}),
n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(header), '[_\-.]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM h),
s AS (SELECT idx, header, kind, o, CASE WHEN name = '' THEN 0.0 WHEN name = word THEN 1.0 WHEN regexp_matches(name, '\b' || word || '\b') THEN 0.85 WHEN length(word) >= 4 AND contains(name, word) THEN 0.6 ELSE 0.0 END AS score FROM n, lex),
b AS (SELECT idx, header, CAST(max(score) AS DOUBLE) AS score, arg_min(kind, (-score, o)) AS kind FROM s GROUP BY idx, header)
SELECT CAST(idx AS INTEGER) AS idx, chr(65 + idx) AS label, header, CASE WHEN score > 0 THEN kind ELSE 'unknown' END AS semantic, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM b
""",
)
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _table_headers(s: SparkSession, d: str) -> DataFrame:
    """The header scores of all columns of all tables."""
    rows = [(t, c, *score_header(c), confidence_band(score_header(c)[1])) for t in TABLES for c in table(s, d, t).columns]
    return s.createDataFrame(rows, "source string, header string, semantic string, score double, band string")


add(
    "header_scores_tables", _table_headers,
    rf"""
WITH lex(o, kind, word) AS (VALUES {_LEXICON}), h AS (SELECT table_name AS source, column_name AS header FROM information_schema.columns WHERE table_name IN ({", ".join(map(q.quoted, TABLES))})),
n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(header), '[_\-.]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM h),
s AS (SELECT source, header, kind, o, CASE WHEN name = '' THEN 0.0 WHEN name = word THEN 1.0 WHEN regexp_matches(name, '\b' || word || '\b') THEN 0.85 WHEN length(word) >= 4 AND contains(name, word) THEN 0.6 ELSE 0.0 END AS score FROM n, lex),
b AS (SELECT source, header, CAST(max(score) AS DOUBLE) AS score, arg_min(kind, (-score, o)) AS kind FROM s GROUP BY source, header)
SELECT source, header, CASE WHEN score > 0 THEN kind ELSE 'unknown' END AS semantic, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM b
""",
)
_PROFILED = {
    "customer": ("c_custkey", {"c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}),
    "orders": ("o_orderkey", {"o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "s"}),
    "events": ("event_id", {"ts": "d", "user_id": "n", "event_type": "s", "value": "n", "props": "s"}),
    "documents": ("doc_id", {"text": "s", "lang": "s", "source": "s", "n_chars": "n"}),
    "supplier": ("s_suppkey", {"s_name": "s", "s_nationkey": "n", "s_acctbal": "n"}),
}
for _t, (_key, _cols) in _PROFILED.items():
    add(f"profile_{_t}", lambda s, d, t=_t, k=_key, c=_cols: profile(table(s, d, t), k, list(c)).withColumn("samples", F.array_join("samples", "|")), q.profile(_t, _key, _cols))
for _t in ("customer", "orders"):
    _key, _cols = _PROFILED[_t]
    add(f"precheck_plan_{_t}", lambda s, d, t=_t, k=_key, c=_cols: profile(table(s, d, t), k, list(c)).select("header", "semantic", F.when(F.col("score") >= 0.5, F.col("suggested_mode")).alias("mode")), f"SELECT header, semantic, CASE WHEN score >= 0.5 THEN suggested_mode END AS mode FROM ({q.profile(_t, _key, _cols)})")
    add(f"low_cardinality_{_t}", lambda s, d, t=_t, k=_key, c=_cols: profile(table(s, d, t), k, list(c)).select("header", "distinct_count", "low_cardinality"), f"SELECT header, distinct_count, low_cardinality FROM ({q.profile(_t, _key, _cols)})")



def _merged_profile(s: SparkSession, d: str) -> DataFrame:
    """orders profiled in two halves, each by one pass, whose saved sketches are merged; distinct counts are estimates, so only whether they are within 2 % is told."""
    t, (key, cols) = table(s, d, "orders"), _PROFILED["orders"]
    halves = [stash(sketch(t.where(F.col(key) % 2 == n), key, list(cols)), "sketch") for n in (0, 1)]
    found = profile_of(stash(merge(*halves), "sketch"), list(cols))
    exact = t.agg(*[F.count_distinct(c).alias(c) for c in cols]).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*cols))).alias("header", "exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * 0.02
    return found.join(exact, "header").select("index", "header", "semantic", "score", "reason", "filled_count", F.array_join("samples", "|").alias("samples"), near.alias("near"))


add("profile_merged_orders", _merged_profile, f"SELECT index, header, semantic, score, reason, filled_count, samples, true AS near FROM ({q.profile('orders', *_PROFILED['orders'])})")

# --- redaction, audit, preview
FLAGSHIP = {"c_name": ("hash", "name", {}), "n_name": ("partial", "name", {}), "o_orderpriority": ("partial", "text", {"keep_start": 2}), "o_orderdate": ("partial", "date", {}), "o_totalprice": ("partial", "currency", {})}


def _flagship_input(s: SparkSession, d: str) -> DataFrame:
    c, n, o = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "orders")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_orderpriority", "o_orderdate", "o_totalprice", "c_mktsegment")


def redact_orders_flagship(s: SparkSession, d: str) -> DataFrame:
    t = _flagship_input(s, d)
    return redact(t, _plan(**FLAGSHIP)(t), SALT)


_FLAG = "SELECT o_orderkey, c_name, n_name, o_orderpriority, o_orderdate, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_FLAG_OUT = f"SELECT o_orderkey, {q.digest('c_name', SALT)} AS c_name, {q.name_mask('n_name')} AS n_name, {q.generic('o_orderpriority', 2)} AS o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) || '-**-**' AS o_orderdate, repeat('*', length({q.number_text('o_totalprice')})) AS o_totalprice, c_mktsegment FROM ({_FLAG})"
add("redact_orders_flagship", redact_orders_flagship, _FLAG_OUT)


def _audit(s: SparkSession, d: str) -> DataFrame:
    t = _flagship_input(s, d)
    return change_counts(t, _plan(**FLAGSHIP)(t), SALT)


_AUDIT = " UNION ALL ".join(f"SELECT '{c}' AS header, '{m}' AS mode, '{k}' AS semantic, count(*) AS cells_changed FROM orders" for c, (m, k, _) in FLAGSHIP.items())
add("audit_counts", _audit, _AUDIT)
add("audit_rollup", lambda s, d: _audit(s, d).rollup("mode", "header").agg(F.sum("cells_changed").cast("bigint").alias("cells_changed")), f"SELECT mode, header, CAST(sum(cells_changed) AS BIGINT) AS cells_changed FROM ({_AUDIT}) GROUP BY ROLLUP (mode, header)")


def _audit_rows(s: SparkSession, d: str) -> DataFrame:
    """The audit of a redacted table that is written by the executors, as rows: one for each column, with its sheet's action, rows and the report's total."""
    t = table(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("s_acctbal"))
    plan = _plan(s_name=("hash", "name", {}), s_acctbal=("partial", "currency", {}))(t)
    done = write_redacted(t, plan, run_path(s, "redacted"), "supplier", "parquet", SALT)
    report = audit_report("supplier.parquet", "", "", "whole-workbook", "parquet", [done, SheetResult("region", "passed-through", table(s, d, "region").count(), []), SheetResult("nation", "dropped", 25, [])])
    brief = audit_summary(report)
    rows = [(x["name"], x["action"], x["rowCount"], c["header"], c["cellsChanged"], brief["cells_changed"], ",".join(brief["untouched"])) for x in report["sheets"] for c in x["columns"] or [{"header": "", "cellsChanged": 0}]]
    return s.createDataFrame(rows, "sheet string, action string, row_count long, header string, cells_changed long, total long, untouched string")


_AUDITED = "(SELECT count(*) AS n, count(*) FILTER (s_suppkey % 3 > 0) AS filled FROM supplier)"
add(
    "audit_report", _audit_rows,
    f"""
SELECT 'supplier' AS sheet, 'redacted' AS action, n AS row_count, 's_name' AS header, n AS cells_changed, n + filled AS total, 'region' AS untouched FROM {_AUDITED}
UNION ALL SELECT 'supplier', 'redacted', n, 's_acctbal', filled, n + filled, 'region' FROM {_AUDITED}
UNION ALL SELECT 'region', 'passed-through', (SELECT count(*) FROM region), '', 0, n + filled, 'region' FROM {_AUDITED}
UNION ALL SELECT 'nation', 'dropped', 0, '', 0, n + filled, 'region' FROM {_AUDITED}
""",
)


def _audit_texts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").select("s_suppkey", F.expr(f"CASE WHEN s_suppkey % 2 = 0 THEN 'Jalan Merdeka' WHEN s_suppkey % 5 = 0 THEN NULL ELSE {ADDRESSES} END").alias("address"), F.lit("").alias("note"))
    return change_counts(t, _plan(address=("partial", "address", {}), note=("blank", "text", {"blank_with": "x"}))(t), SALT)


add("audit_unchanged_texts", _audit_texts, "SELECT 'address' AS header, 'partial' AS mode, 'address' AS semantic, count(*) FILTER (s_suppkey % 2 = 1 AND s_suppkey % 5 <> 0) AS cells_changed FROM supplier UNION ALL SELECT 'note', 'blank', 'text', 0")


def _preview(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    plan = _plan(o_custkey=("hash", "unknown", {"hash_style": "sequential"}), o_orderdate=("partial", "date", {}), o_orderstatus=("blank", "text", {}))(t)
    return preview(t, plan, "o_orderkey", 60, SALT).select("row", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


_FIRST = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 60"
add(
    "preview_60", _preview,
    f"WITH p AS ({_FIRST}), a AS (SELECT o_custkey, 'ID_' || lpad(CAST(row_number() OVER (ORDER BY f) AS VARCHAR), 4, '0') AS alias FROM (SELECT o_custkey, min(o_orderkey) AS f FROM p GROUP BY 1)) "
    f"SELECT o_orderkey AS row, concat_ws('|', o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d'), {q.number_text('o_totalprice')}, o_orderstatus) AS before, "
    f"concat_ws('|', o_orderkey, alias, CAST(year(o_orderdate) AS VARCHAR) || '-**-**', {q.number_text('o_totalprice')}, '') AS after FROM p JOIN a USING (o_custkey)",
)


def _survivors(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select("c_custkey", "c_name", F.expr(EMAILS).alias("email"))
    out = redact(t, _plan(c_name=("fake", "name", {}), email=("hash", "email", {}))(t), SALT)
    originals = t.select(F.col("c_name").alias("v")).union(t.select("email")).distinct()
    return out.select(F.col("c_name").alias("v")).union(out.select("email")).join(originals, "v", "left_semi").agg(F.count("*").alias("survivors"))


add(
    "no_original_survives", _survivors,
    f"WITH t AS (SELECT c_custkey, c_name, {EMAILS} AS email FROM customer), o AS (SELECT c_name AS v FROM t UNION SELECT email FROM t), "
    f"r AS (SELECT out AS v FROM ({_fake_sql('customer', 'c_custkey', 'name', 'id', 'c_name')}) UNION ALL SELECT {q.digest('email', SALT)} FROM t) SELECT count(*) AS survivors FROM r WHERE v IN (SELECT v FROM o)",
)

# --- sheets, files and streams
SHEETS: list[list[list]] = [
    [["Nama", "Email", "Gaji"], ["Budi", "b@a.com", 1], ["Siti", "s@a.com", 2]],
    [["Laporan 2024", None, None], [None, None, None], ["Nama", "Email", "Gaji"], ["Budi", "b@a.com", 1], ["Siti", "s@a.com", 2]],
    [[1, 2, 3], [4, 5, 6], [7, 8, 9]],
    [["Title"], ["Nama", "Email"], ["Budi", "b@a.com"]],
    [["id", "id", "qty"], ["1,5", "2.25", 7], [" ", "x", None]],
    [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h"], ["i", "j"], ["k", "l"], ["m", "n"], ["o", "p"], ["q", "r"], ["s", "t"], [1, 2], [3, 4]],
]


def _sheet(s: SparkSession, rows: list[list]) -> DataFrame:
    cell = lambda v: (None,) * 5 if v is None else ("s", v, None, None, None) if isinstance(v, str) else ("n", None, float(v), None, None)
    return s.createDataFrame([(i, [cell(v) for v in r]) for i, r in enumerate(rows)], SHEET)


def _header_rows(s: SparkSession, d: str) -> DataFrame:
    found = [detect_header_row(_sheet(s, rows)).select(F.lit(n).alias("sheet"), "header_index", F.round("confidence", 6).alias("confidence"), F.size("candidates").alias("candidates")) for n, rows in enumerate(SHEETS)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _sheet_values() -> str:
    text = lambda v: "NULL" if v is None else q.quoted(f"s{v}" if isinstance(v, str) else f"n{v}")
    return ", ".join(f"({n}, {i}, [{', '.join(map(text, r))}]::VARCHAR[])" for n, rows in enumerate(SHEETS) for i, r in enumerate(rows))


_LABEL = "(c IS NOT NULL AND c[1] = 's' AND trim(c[2:]) <> '' AND NOT regexp_matches(trim(c[2:]), '^[0-9]+([.,][0-9]+)?$'))"
_FULL = "(c IS NOT NULL AND trim(c[2:]) <> '')"
_B_LABEL, _B_FULL = (x.replace("c[", "b[").replace("c IS", "b IS") for x in (_LABEL, _FULL))

def _detected(values: str) -> str:
    """The header row of each sheet among rows (sheet, i, cells); a cell is its type's letter and its text."""
    return f"""
WITH v(sheet, i, cells) AS ({values}),
n AS (SELECT *, lead(cells) OVER (PARTITION BY sheet ORDER BY i) AS below FROM v),
e AS (SELECT sheet, i, len(cells) AS width, unnest(cells) AS c, unnest(list_resize(coalesce(below, []), len(cells))) AS b FROM n),
r AS (SELECT sheet, i, any_value(width) AS width, CAST(count(*) FILTER ({_FULL}) AS DOUBLE) AS filled, count(*) FILTER ({_LABEL}) AS labels, count(DISTINCT lower(trim(c[2:]))) FILTER ({_FULL}) AS names,
  count(*) FILTER ({_FULL} AND {_B_FULL}) AS pairs, count(*) FILTER ({_FULL} AND {_B_FULL} AND {_LABEL} <> {_B_LABEL}) AS differ FROM e GROUP BY sheet, i),
s AS (SELECT sheet, i, CASE WHEN filled < 2 THEN 0.0 ELSE filled / width * 0.2 + labels / filled * 0.3 + names / filled * 0.2 + CASE WHEN pairs = 0 THEN 0.0 ELSE differ / CAST(pairs AS DOUBLE) END * 0.3 END AS score FROM r WHERE i < 10),
k AS (SELECT sheet, max(score) AS best, list(score ORDER BY score DESC, i)[2] AS second, arg_min(i, (-score, i)) AS top, count(*) AS candidates FROM s GROUP BY sheet)
SELECT sheet, CASE WHEN best >= 0.55 AND least(1.0, best * CASE WHEN best - coalesce(second, 0) > 0.1 THEN 1 ELSE 0.75 END) >= 0.55 THEN top END AS header_index,
  round(CASE WHEN best < 0.55 THEN best ELSE least(1.0, best * CASE WHEN best - coalesce(second, 0) > 0.1 THEN 1 ELSE 0.75 END) END, 6) AS confidence, CAST(candidates AS INTEGER) AS candidates FROM k
"""


add("header_row_detect", _header_rows, _detected(f"VALUES {_sheet_values()}"))


def _workbook(s: SparkSession, d: str) -> DataFrame:
    """Two dimension tables written by executors as the sheets of one workbook, in the shared folder, and read back."""
    sheets = []
    for n, name in enumerate(("nation", "region")):
        t = table(s, d, name)
        sheets += [header_sheet(s, name, n, t.columns), as_sheet(t, name, n, t.columns[0], t.columns)]
    folder = run_path(s, "book")
    write_book(reduce(DataFrame.union, sheets), folder, "tables.xlsx")
    return read_xlsx(s, f"{folder}/tables.xlsx")


def _xlsx_round_trip(s: SparkSession, d: str) -> DataFrame:
    rows = to_table(sheet_rows(_workbook(s, d), "nation"), 0, ["n_nationkey", "n_name", "n_regionkey"])
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


add("xlsx_round_trip", _xlsx_round_trip, "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
add("xlsx_summary", lambda s, d: summarise(_workbook(s, d)), "SELECT 'nation' AS name, CAST(count(*) + 1 AS INTEGER) AS row_count, 3 AS col_count FROM nation UNION ALL SELECT 'region', CAST(count(*) + 1 AS INTEGER), 2 FROM region")


def _workbook_headers(s: SparkSession, d: str) -> DataFrame:
    """The header rows of sheets that were written from tables."""
    book = _workbook(s, d)
    one = lambda name: detect_header_row(sheet_rows(book, name)).select(F.lit(name).alias("sheet"), "header_index", F.round("confidence", 6).alias("confidence"), F.size("candidates").alias("candidates"))
    return one("nation").union(one("region"))


add(
    "header_row_tables", _workbook_headers,
    _detected(
        "SELECT 'nation', 0, ['sn_nationkey', 'sn_name', 'sn_regionkey'] UNION ALL SELECT 'region', 0, ['sr_regionkey', 'sr_name'] "
        "UNION ALL SELECT 'nation', row_number() OVER (ORDER BY n_nationkey), ['n' || n_nationkey, 's' || n_name, 'n' || n_regionkey] FROM nation "
        "UNION ALL SELECT 'region', row_number() OVER (ORDER BY r_regionkey), ['n' || r_regionkey, 's' || r_name] FROM region"
    ),
)


def _parts(s: SparkSession, d: str) -> DataFrame:
    """supplier, redacted, as part workbooks by the executors, read back by a streaming reader whose filters stop it."""
    t = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").repartition(4)
    folder = run_path(s, "parts")
    write_parts(t, _plan(s_name=("hash", "name", {}))(t), folder, "supplier", "xlsx", SALT)
    rows = s.read.format("xlsx").load(folder).where("sheet = 'supplier' and row_idx > 0")
    at = lambda i: F.get("cells", F.lit(i))
    return rows.select(at(0)["n"].cast("bigint").alias("s_suppkey"), at(1)["s"].alias("s_name"), at(2)["n"].alias("s_acctbal"))


add("xlsx_parts", _parts, f"SELECT s_suppkey, {q.digest('s_name', SALT)} AS s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier")


def _sheet_previews(s: SparkSession, d: str) -> DataFrame:
    """The candidates for a header row of a sheet that was written from a table: its first ten rows with their previews, and the labels under each."""
    sheet = sheet_rows(_workbook(s, d), "nation")
    labels = F.array_join(F.lit(headers_of(sheet, 0)), "|")
    return header_scores(sheet).select("row_idx", F.array_join("preview", "|").alias("preview"), labels.alias("labels"))


add(
    "sheet_previews", _sheet_previews,
    "SELECT CAST(0 AS INTEGER) AS row_idx, 'n_nationkey|n_name|n_regionkey' AS preview, 'n_nationkey|n_name|n_regionkey' AS labels UNION ALL SELECT CAST(n AS INTEGER), concat_ws('|', n_nationkey, n_name, n_regionkey), 'n_nationkey|n_name|n_regionkey' FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) WHERE n < 10",
)


# --- SQL text and the registry
def _sql_text(s: SparkSession, d: str) -> DataFrame:
    """The library's functions called by name from SQL text."""
    register_sql(s)
    return s.sql(
        f"""
        SELECT c_custkey, mw_digest(c_name, '{SALT}') AS digest, mw_mask_generic(c_mktsegment, 6, 6) AS segment, mw_mask_phone(phone) AS phone, mw_is_phone(phone) AS is_phone, mw_fake_name(c_name, '{SALT}', 'en') AS fake,
               mw_mask_email(email) AS email, mw_is_email(email) AS is_email
        FROM (SELECT *, {PHONES} AS phone, {EMAILS} AS email FROM {{customer}})""",
        customer=table(s, d, "customer"),
    )


_sql_n, _sql_fake = q.fake("name", "en")
add(
    "sql_functions", _sql_text,
    f"SELECT c_custkey, {q.digest('c_name', SALT)} AS digest, {q.generic('c_mktsegment', 6, 6)} AS segment, {q.phone_mask('phone')} AS phone, {q.is_phone('phone')} AS is_phone, {_sql_fake} AS fake, {q.email_mask('email')} AS email, {q.is_email('email')} AS is_email FROM {q.with_draws(f"SELECT *, {PHONES} AS phone, {EMAILS} AS email, {q.fnv(q.digest('c_name', SALT))} AS seed FROM customer", _sql_n)}",
)


def _own_type(s: SparkSession, d: str) -> DataFrame:
    """A type of value and a mode that are registered at run time: seen by the profile, planned and redacted."""
    t = table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    register_sql(s)
    registry.register_mode("tail", lambda text, plan, salt: F.concat(F.lit("#"), F.right(text, F.lit(3))))
    try:
        with registry.registered("supplier_code", sql_predicate(s, "supplier_code", r"rlike(mw_trim(t), r'^Supplier#[0-9]{9}\z')"), before="name", mode="tail"):
            found = profile(t, "s_suppkey", ["s_name", "s_acctbal"]).orderBy("index").collect()
        plan = RedactionPlan.from_profile([r.asDict() | {"index": r["index"] + 1} for r in found])
        return redact(t, plan, SALT).select("s_suppkey", "s_name", F.lit(found[0]["semantic"]).alias("semantic"), F.lit(found[0]["reason"]).alias("reason"))
    finally:
        registry.unregister("tail")


add("registered_type", _own_type, "SELECT s_suppkey, '#' || right(s_name, 3) AS s_name, 'supplier_code' AS semantic, '100% of sampled values match supplier_code' AS reason FROM supplier")


def _planned(s: SparkSession, d: str) -> DataFrame:
    """The flagship's tables under the plan that their profile proposes."""
    t = _flagship_input(s, d)
    names = [c for c in t.columns if c != "o_orderkey"]
    found = profile(t, "o_orderkey", names).orderBy("index").collect()
    return redact(t, RedactionPlan.from_profile([r.asDict() | {"index": r["index"] + 1} for r in found]), SALT)


_both_n, _both_e = q.fake("name", "id")
_PLANNED = f"SELECT o_orderkey, {_both_e} AS c_name, n_name, o_orderpriority, o_orderdate, o_totalprice, c_mktsegment FROM {q.with_draws(f"SELECT *, {q.fnv(q.digest('c_name', SALT))} AS seed FROM ({_FLAG})", _both_n)}"
add(
    "redact_orders_planned", _planned,
    f"SELECT o_orderkey, c_name, {_both_e} AS n_name, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) || '-**-**' AS o_orderdate, {q.digest(q.number_text('o_totalprice'), SALT)} AS o_totalprice, c_mktsegment FROM {q.with_draws(f"SELECT *, {q.fnv(q.digest('n_name', SALT))} AS seed FROM ({_PLANNED})", _both_n)}",
)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """customer as a stream, redacted into a table until all of it has been seen."""
    t = table(s, d, "customer")
    stream = s.readStream.schema(t.schema).option("pathGlobFilter", "customer.parquet").parquet(d)
    base = run_path(s, "stream")
    out = redact_stream(stream, _plan(c_name=("hash", "name", {}), c_mktsegment=("partial", "text", {}))(t), SALT)
    out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return s.read.schema(out.schema).parquet(f"{base}/rows")


add("stream_redact", _stream, f"SELECT c_custkey, {q.digest('c_name', SALT)} AS c_name, c_nationkey, c_acctbal, {q.generic('c_mktsegment')} AS c_mktsegment FROM customer")


def _alias_stream(s: SparkSession, d: str) -> DataFrame:
    """orders as a stream that stops after the earlier orders and is started again from its checkpoint for the later ones."""
    t, base = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), run_path(s, "stream")
    plan = _plan(o_custkey=("hash", "unknown", {"hash_style": "sequential"}))(t)
    known = {"o_custkey": AliasDictionary(f"{base}/aliases", "CUST")}
    for arrived in (EARLIER, f"NOT ({EARLIER})"):
        t.where(arrived).write.mode("append").parquet(f"{base}/in")
        writer = alias_writer(s.readStream.schema(t.schema).parquet(f"{base}/in"), plan, SALT, f"{base}/out", "o_orderkey", known)
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").select("o_orderkey", "o_custkey")


add("stream_aliases", _alias_stream, f"SELECT o_orderkey, alias AS o_custkey FROM orders JOIN ({_KEPT}) USING (o_custkey)")


def _counts_stream(s: SparkSession, d: str) -> DataFrame:
    """Changed cells of orders as a stream, by weeks of their dates."""
    t, base = table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"), run_path(s, "stream")
    plan = _plan(o_orderkey=("hash", "unknown", {}), o_orderpriority=("partial", "text", {}), o_orderstatus=("partial", "text", {"keep_start": 2}))(t)
    stream = s.readStream.schema(t.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    counts = change_counts_by_window(stream, plan, SALT, "o_orderdate", "7 days").select(F.date_format("start", "yyyy-MM-dd").alias("week"), "c0", "c1", "c2")
    latest = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(latest).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/counts")


_WEEKLY = {"c0": "true", "c1": f"o_orderpriority <> {q.generic('o_orderpriority')}", "c2": f"o_orderstatus <> {q.generic('o_orderstatus', 2)}"}
add(
    "stream_change_counts", _counts_stream,
    f"SELECT strftime(time_bucket(INTERVAL '7 days', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, {', '.join(f'count(*) FILTER ({v}) AS {n}' for n, v in _WEEKLY.items())} FROM orders GROUP BY 1",
)


def _selected_all(s: SparkSession, d: str, name: str) -> DataFrame:
    """The plan that a table's profile proposes, with every column selected, and with all but the first deselected again."""
    key, columns = _PROFILED[name]
    plan = RedactionPlan.from_profile(profile(table(s, d, name), key, list(columns)).orderBy("index").collect())
    every, first = plan.select_all(), plan.select_all().clear().with_mode(0, "blank")
    return s.createDataFrame([(p.header, p.mode, f.mode) for p, f in zip(every, first, strict=True)], "header string, every string, first string")


_MODES = " ".join(f"WHEN {q.quoted(k)} THEN {q.quoted(m)}" for k, m in MODE_FOR_TYPE.items())
for _t in ("customer", "orders"):
    add(f"plan_select_all_{_t}", lambda s, d, t=_t: _selected_all(s, d, t), f"SELECT header, CASE semantic {_MODES} ELSE 'hash' END AS every, CASE WHEN index = 0 THEN 'blank' END AS first FROM ({q.profile(_t, *_PROFILED[_t])})")
