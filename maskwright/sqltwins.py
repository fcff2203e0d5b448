"""DuckDB SQL for the functions of this library, written apart from their Spark forms, to check results against."""

from __future__ import annotations

from .functions.cells import WS
from .functions.validators import ADDRESS_WORDS, MONTHS, NAME_LEADS
from .functions.wordlists import CARRIERS, CITIES, FIRST_NAMES, LAST_NAMES, REGION_CODES, STREETS
from .plans.lexicon import MODE_FOR_TYPE, score_header

MASK = 4294967295


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def number_text(v: str) -> str:
    """A double as text, without .0, zeros at the end or an exponent."""
    return f"(CASE WHEN {v} = floor({v}) AND abs({v}) < 1e18 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(CAST(CAST(CAST({v} AS VARCHAR) AS DECIMAL(38,12)) AS VARCHAR), '0'), '.') END)"


def trim(v: str) -> str:
    return f"regexp_replace({v}, '^{WS}+|{WS}+$', '', 'g')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def times(n: str, mark: str = "*") -> str:
    return f"repeat({quoted(mark)}, CAST(greatest({n}, 0) AS BIGINT))"


def generic(v: str, s: int = 1, e: int = 0, mark: str = "*") -> str:
    m = f"(length({v}) // 2)"
    a = f"(CASE WHEN {s + e} <= {m} THEN {s} ELSE least({s}, greatest({m} - {e}, ({m} + 1) // 2)) END)"
    b = f"(CASE WHEN {s + e} <= {m} THEN {e} ELSE least({e}, greatest({m} - {s}, {m} // 2)) END)"
    return f"(CASE WHEN length({v}) < 4 THEN {times(f'length({v})', mark)} ELSE left({v}, {a}) || {times(f'length({v}) - {a} - {b}', mark)} || right({v}, {b}) END)"


def email_mask(v: str, mark: str = "*") -> str:
    local, host = f"regexp_extract({v}, '(?s)^(.+)(@[^@]*)$', 1)", f"regexp_extract({v}, '(?s)^(.+)(@[^@]*)$', 2)"
    return f"(CASE WHEN {host} = '' THEN {generic(v, 1, 0, mark)} WHEN length({local}) > 1 THEN left({local}, 1) || {times(f'length({local}) - 1', mark)} || {host} ELSE {quoted(mark)} || {host} END)"


def phone_mask(v: str) -> str:
    d = digits(v)
    plus = f"(CASE WHEN starts_with(ltrim({v}), '+') THEN '+' ELSE '' END)"
    return f"(CASE WHEN length({d}) < 6 THEN {times(f'length({v})')} WHEN length({d}) <= 9 THEN {plus} || {generic(d, 0, 2)} ELSE {plus} || left({d}, 4) || {times(f'length({d}) - 8')} || right({d}, 4) END)"


def card_mask(v: str) -> str:
    d = digits(v)
    return f"(CASE WHEN length({d}) < 12 THEN {generic(d, 0, 4)} ELSE left({d}, 6) || {times(f'length({d}) - 10')} || right({d}, 4) END)"


def nik_mask(v: str) -> str:
    d = digits(v)
    return f"(CASE WHEN length({d}) <> 16 THEN {generic(d, 4, 2)} ELSE left({d}, 4) || '**********' || right({d}, 2) END)"


def npwp_mask(v: str) -> str:
    d = digits(v)
    return f"(left({d}, 2) || {times(f'length({d}) - 2')})"


def date_mask(v: str) -> str:
    y = f"regexp_extract({v}, '\\b((?:19|20)[0-9]{{2}})\\b', 1)"
    return f"(CASE WHEN {y} <> '' THEN {y} || '-**-**' ELSE {times(f'length({v})')} END)"


def name_mask(v: str) -> str:
    return f"array_to_string(list_transform(string_split({v}, ' '), lambda w: CASE WHEN w = '' THEN '' ELSE left(w, 1) || repeat('*', length(w) - 1) END), ' ')"


def address_mask(v: str) -> str:
    return f"regexp_replace({v}, '[0-9]', '*', 'g')"


def digest(v: str, salt: str, length: int = 12) -> str:
    return f"left(sha256({quoted(salt)} || {v}), {length})"


def fnv(h: str) -> str:
    return f"list_reduce(list_transform(string_split({h}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (xor(a, c) * 16777619) & {MASK}, CAST(2166136261 AS BIGINT))"


def with_draws(source: str, k: int) -> str:
    """source, a query with a column seed, and columns x1 ... xk: each draw from the one before, in layers so that no expression grows."""
    out = f"(SELECT *, CASE WHEN seed = 0 THEN 1 ELSE seed END AS x0 FROM ({source}))"
    for n in range(1, k + 1):
        out = f"(SELECT *, xor(x{n - 1}, x{n - 1} << 13) & {MASK} AS a{n} FROM {out})"
        out = f"(SELECT *, xor(a{n}, a{n} >> 17) AS b{n} FROM {out})"
        out = f"(SELECT *, xor(b{n}, b{n} << 5) & {MASK} AS x{n} FROM {out})"
    return out


def below(n: int, of: int) -> str:
    return f"((x{n} * {of}) >> 32)"


def pick(n: int, items: list[str]) -> str:
    return f"{words(items)}[{below(n, len(items))} + 1]"


def _pad(v: str, width: int) -> str:
    return f"lpad(CAST({v} AS VARCHAR), {width}, '0')"


def _digits(first: int, count: int) -> str:
    return " || ".join(f"CAST({below(n, 10)} AS VARCHAR)" for n in range(first, first + count))


def fake(kind: str, locale: str) -> tuple[int, str]:
    """(draws, expression over x1, x2, ...)."""
    name = f"{pick(1, FIRST_NAMES[locale])} || ' ' || {pick(2, LAST_NAMES[locale])}"
    if kind == "name":
        return 2, name
    if kind == "email":
        return 2, f"replace(lower({name}), ' ', '.') || '@example.com'"
    if kind == "address":
        no, street, city = f"CAST({below(1, 200)} + 1 AS VARCHAR)", pick(2, STREETS[locale]), pick(3, CITIES[locale])
        return 3, f"{street} || ' No. ' || {no} || ', ' || {city}" if locale == "id" else f"{no} || ' ' || {street} || ', ' || {city}"
    if kind == "phone":
        return 9, f"'+62 ' || {pick(1, CARRIERS)} || '-' || {_digits(2, 4)} || '-' || {_digits(6, 4)}" if locale == "id" else f"'+1 555-' || {_digits(1, 4)}"
    if kind == "nik":
        day = f"(CASE WHEN x3 < 2147483648 THEN {below(4, 28)} + 41 ELSE {below(4, 28)} + 1 END)"
        return 7, " || ".join([pick(1, REGION_CODES), _pad(f"{below(2, 30)} + 1", 2), _pad(day, 2), _pad(f"{below(5, 12)} + 1", 2), _pad(f"({below(6, 45)} + 60) % 100", 2), _pad(f"{below(7, 9999)} + 1", 4)])
    if kind == "npwp":
        return 16, _digits(1, 16)
    if kind == "card":
        return 15, f"'4' || {_digits(1, 15)}"
    return 3, f"CAST({below(1, 50)} + 1960 AS VARCHAR) || '-' || {_pad(f'{below(2, 12)} + 1', 2)} || '-' || {_pad(f'{below(3, 28)} + 1', 2)}"


def is_email(v: str) -> str:
    return f"regexp_matches({trim(v)}, '^[^{WS[1:-1]}@]+@[^{WS[1:-1]}@.]+\\.[^{WS[1:-1]}@]{{2,}}$')"


def is_phone(v: str) -> str:
    s = trim(v)
    bare = f"regexp_replace({s}, '[{WS[1:-1]}().-]', '', 'g')"
    n = f"length({digits(s)})"
    return f"(regexp_matches({s}, '^\\+?[0-9{WS[1:-1]}().-]{{8,20}}$') AND {n} BETWEEN 8 AND 15 AND (regexp_matches({bare}, '^(0|62|\\+62)8') OR (starts_with({s}, '+') AND {n} >= 10)))"


def is_nik(v: str) -> str:
    d = digits(v)
    part = lambda a: f"TRY_CAST(substr({d}, {a}, 2) AS INTEGER)"
    day = f"(CASE WHEN {part(7)} > 40 THEN {part(7)} - 40 ELSE {part(7)} END)"
    return f"coalesce(length({d}) = 16 AND NOT starts_with({d}, '0') AND {day} BETWEEN 1 AND 31 AND {part(9)} BETWEEN 1 AND 12 AND {part(1)} BETWEEN 11 AND 96, false)"


def is_npwp(v: str) -> str:
    return f"(length({digits(v)}) IN (15, 16))"


def luhn(d: str) -> str:
    return f"(list_sum(list_transform(string_split(reverse({d}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN (ascii(c) - 48) * 2 > 9 THEN (ascii(c) - 48) * 2 - 9 ELSE (ascii(c) - 48) * 2 END ELSE ascii(c) - 48 END)) % 10 = 0)"


def is_card(v: str) -> str:
    d = f"regexp_replace({v}, '[{WS[1:-1]}-]', '', 'g')"
    return f"(CASE WHEN regexp_matches({d}, '^[0-9]{{13,19}}$') THEN {luhn(d)} ELSE false END)"


def is_date_text(v: str) -> str:
    s = trim(v)
    iso, short = "^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
    part = lambda p, n: f"TRY_CAST(regexp_extract({s}, '{p}', {n}) AS INTEGER)"
    a, b = part(short, 1), part(short, 2)
    return (
        f"(CASE WHEN regexp_matches({s}, '{iso}') THEN {part(iso, 2)} BETWEEN 1 AND 12 AND {part(iso, 3)} BETWEEN 1 AND 31 "
        f"WHEN regexp_matches({s}, '{short}') THEN ({a} BETWEEN 1 AND 31 AND {b} BETWEEN 1 AND 12) OR ({b} BETWEEN 1 AND 31 AND {a} BETWEEN 1 AND 12) "
        f"ELSE regexp_matches({s}, '(?i)^(0?[1-9]|[12][0-9]|3[01]){WS}+({MONTHS})[a-z]{{0,6}}{WS}+[0-9]{{4}}$') END)"
    )


def is_currency_text(v: str) -> str:
    s = trim(v)
    return f"(regexp_matches({s}, '(?i)^(Rp|IDR|USD|\\$|€|£)?{WS}?-?[0-9.,]+({WS}?(Rp|IDR|USD))?$') AND regexp_matches({s}, '[0-9]'))"


def looks_like_name(v: str) -> str:
    return f"regexp_matches({trim(v)}, '^[A-ZÀ-ɏ][a-zÀ-ɏ.''-]*({WS}+[A-ZÀ-ɏ][a-zÀ-ɏ.''-]*){{1,3}}$')"


def looks_like_address(v: str) -> str:
    return f"(length({trim(v)}) >= 10 AND regexp_matches({trim(v)}, '(?i)\\b({ADDRESS_WORDS})\\b'))"


EMBEDDED = {
    "email": f"(?i)[^{WS[1:-1]}@]+@[^{WS[1:-1]}@.]+\\.[a-z]{{2,}}",
    "phone": f"(?:\\+?62|0)8[0-9]{{2}}[{WS[1:-1]}.-]?[0-9]{{3,4}}[{WS[1:-1]}.-]?[0-9]{{3,5}}",
    "nik": "\\b[0-9]{16}\\b",
    "name": f"(?i)\\b(?:{NAME_LEADS})\\b[:{WS[1:-1]}]+[A-Z][a-z]+{WS}+[A-Z][a-z]+",
}

EMBEDDED["strict"] = EMBEDDED["name"].replace("(?i)", "").replace(f"(?:{NAME_LEADS})", f"(?i:{NAME_LEADS})")


def embedded(kind: str, v: str) -> str:
    return f"(length({v}) >= 12 AND regexp_matches({v}, '{EMBEDDED[kind]}'))"


def profile(table: str, order: str, columns: dict[str, str]) -> str:
    """The whole profile of a table; columns are name -> s (text), n (number) or d (timestamp)."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        text = {"s": f"CAST({c} AS VARCHAR)", "n": number_text(f"CAST({c} AS DOUBLE)"), "d": f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"}[kind]
        day = f"strftime({c}, '%Y-%m-%d')" if kind == "d" else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {i} AS idx, {order} AS rw, {text} AS v, '{kind}' AS kind, {f'CAST({c} AS DOUBLE)' if kind == 'n' else 'CAST(NULL AS DOUBLE)'} AS num, {day} AS day FROM {table}")
    tests = {"email": is_email("v"), "nik": is_nik("v"), "card": is_card("v"), "npwp": is_npwp("v"), "phone": is_phone("v"), "date": is_date_text("v"), "address": looks_like_address("v"), "name": looks_like_name("v"), "currency": is_currency_text("v")}
    hit = {k: f"(kind <> 'd' AND {t})" for k, t in tests.items()}
    hit["date"] = f"(CASE kind WHEN 'd' THEN true WHEN 'n' THEN num >= 10000 AND num < 60000 AND num = floor(num) ELSE {tests['date']} END)"
    hit["currency"] = f"(CASE kind WHEN 'd' THEN false WHEN 'n' THEN true ELSE {tests['currency']} END)"
    heads = ", ".join(f"({i}, {quoted(c)}, {quoted(score_header(c)[0])}, CAST({score_header(c)[1]} AS DOUBLE))" for i, c in enumerate(columns))
    shares = ", ".join(f"CASE WHEN hits_{k} >= 0.7 * sampled AND hits_{k} / sampled >= 0.7 {'AND h_type = ' + quoted(k) if k == 'currency' else ''} THEN hits_{k} / sampled ELSE 0.0 END" for k in tests)
    kinds = list(tests)
    order_k = ("email", "phone", "nik", "name")
    modes = " ".join(f"WHEN {quoted(k)} THEN {quoted(m)}" for k, m in MODE_FOR_TYPE.items())
    percent = lambda r: f"CAST(CAST(floor({r} * 100 + 0.5) AS INTEGER) AS VARCHAR)"
    return f"""
WITH tall AS ({' UNION ALL '.join(parts)}),
filled AS (SELECT * FROM tall WHERE v IS NOT NULL AND {trim('v')} <> ''),
counts AS (SELECT idx, count(*) AS filled, count(DISTINCT v) AS dist FROM filled GROUP BY idx),
sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY rw, v) AS rn FROM filled) WHERE rn <= 200),
votes AS (SELECT idx, CAST(count(*) AS DOUBLE) AS sampled, {', '.join(f"count(*) FILTER ({h}) AS hits_{k}" for k, h in hit.items())},
  {', '.join(f"count(*) FILTER ({embedded(k, 'v')}) AS in_{k}, coalesce(min(rn * 8 + {n}) FILTER ({embedded(k, 'v')}), 1000000000) AS at_{k}" for n, k in enumerate(order_k))},
  bool_or(length(v) > 40) AS any_long,
  list(CASE WHEN length(coalesce(day, v)) > 18 THEN left(coalesce(day, v), 15) || '…' ELSE coalesce(day, v) END ORDER BY rn) FILTER (rn <= 3) AS samples FROM sample GROUP BY idx),
heads(idx, header, h_type, h_score) AS (VALUES {heads}),
j AS (SELECT *, [{shares}] AS shares FROM heads LEFT JOIN counts USING (idx) LEFT JOIN votes USING (idx)),
k AS (SELECT *, list_max(shares) AS v_score, CASE WHEN list_max(shares) > 0 THEN {words(kinds)}[list_position(shares, list_max(shares))] ELSE 'unknown' END AS v_type,
  CASE WHEN in_email >= greatest(in_phone, in_nik, in_name) AND (in_email > greatest(in_phone, in_nik, in_name) OR at_email <= least(CASE WHEN in_phone = in_email THEN at_phone ELSE 1000000000 END, CASE WHEN in_nik = in_email THEN at_nik ELSE 1000000000 END, CASE WHEN in_name = in_email THEN at_name ELSE 1000000000 END)) THEN 'email'
       WHEN in_phone >= greatest(in_email, in_nik, in_name) AND (in_phone > greatest(in_nik, in_name) OR at_phone <= least(CASE WHEN in_nik = in_phone THEN at_nik ELSE 1000000000 END, CASE WHEN in_name = in_phone THEN at_name ELSE 1000000000 END)) THEN 'phone'
       WHEN in_nik >= greatest(in_email, in_phone, in_name) AND (in_nik > in_name OR at_nik <= at_name) THEN 'nik' ELSE 'name' END AS top_kind,
  greatest(in_email, in_phone, in_nik, in_name) / sampled AS share FROM j),
b AS (SELECT *, CASE WHEN h_score >= 0.6 AND v_score >= 0.7 AND h_type = v_type THEN v_type WHEN v_score >= 0.7 THEN v_type WHEN h_score > 0 THEN h_type ELSE 'unknown' END AS t,
  CASE WHEN h_score >= 0.6 AND v_score >= 0.7 AND h_type = v_type THEN least(1.0, (h_score + v_score) / 2 + 0.25) WHEN v_score >= 0.7 THEN v_score WHEN h_score >= 0.6 THEN h_score * 0.8 WHEN h_score > 0 THEN h_score * 0.5 ELSE 0.0 END AS s,
  CASE WHEN h_score >= 0.6 AND v_score >= 0.7 AND h_type = v_type THEN 'Header and values both look like ' || v_type WHEN v_score >= 0.7 THEN {percent('v_score')} || '% of sampled values match ' || v_type
       WHEN h_score >= 0.6 THEN 'Header name suggests ' || h_type WHEN h_score > 0 THEN 'Weak header match for ' || h_type ELSE 'No signal' END AS w FROM k),
e AS (SELECT *, (t = 'unknown' OR s < 0.5) AND share >= 0.33 AS inside, t = 'unknown' AND any_long AS long FROM b),
f AS (SELECT *, CASE WHEN inside OR long THEN 'text' ELSE t END AS semantic, CASE WHEN inside THEN greatest(s, least(0.75, share * 0.4 + 0.4)) WHEN long THEN greatest(s, 0.3) ELSE s END AS score0 FROM e)
SELECT CAST(idx AS INTEGER) AS index, header, semantic, floor(score0 * 100 + 0.5) / 100 AS score,
  CASE WHEN inside THEN 'Contains ' || top_kind || ' inside free text (' || {percent('share')} || '% of sampled rows)' WHEN long THEN 'Long free text — may contain personal data' ELSE w END AS reason,
  dist AS distinct_count, filled AS filled_count, array_to_string(samples, '|') AS samples, CASE semantic {modes} END AS suggested_mode,
  (SELECT count(*) FROM {table}) >= 40 AND dist < 20 AS low_cardinality FROM f
"""
