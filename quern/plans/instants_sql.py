"""SQL that reads the notations of time in the tables, a pattern a family."""

from __future__ import annotations

from quern.operators.timestamps import ABBREVIATIONS

_WIDE, _PLAIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_AHEAD = "CASE " + " ".join(f"WHEN z = '{a}' THEN {m}" for a, m in ABBREVIATIONS.items()) + " END"
_MONTH = "(strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring({0}, 1, 3))) + 2) // 3"
_NUMERIC = r"^(民國|中華民國)?(\d{3,4})(?:[-/.]|年)(\d{1,2})(?:[-/.]|月)(\d{1,2})日?(?:[T ]?\s*(上午|下午)?\s*(\d{1,2})[:時](\d{1,2})(?::(\d{2})(?:\.(\d+))?|分)?)?\s*(Z|[A-Z]{2,4}(?:[+-]\d{1,2})?|[+-]\d{2}:?\d{2}(?:\[[A-Za-z_/]+\])?|[A-Z][A-Za-z]+/[A-Za-z_]+)?$"
_DAY_FIRST = r"^(?:[A-Z][a-z]+, )?(\d{1,2}) ([A-Z][a-z]+) (\d{4}) (\d{2}):(\d{2})(?::(\d{2}))? (.+)$"
_MONTH_FIRST = r"^([A-Z][a-z]+) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2}) (AM|PM)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2}))?(Z)?$"


def _either(name: str, sides: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({s}.{name}, '')" for s in sides) + ")"


#: CTEs that end in ``instants`` (table_name, rec_no, key, raw, instant).
INSTANTS = f"""
    v AS (SELECT 'clean_latest_news' AS table_name, rec_no, url AS key, published_at AS raw FROM clean_latest_news UNION ALL SELECT 'course_table_row', rec_no, checksum_clean, fetched_at FROM course_table_row),
    t AS (SELECT *, trim(regexp_replace(translate(coalesce(raw, ''), '{_WIDE}', '{_PLAIN}'), '[\\s\\x{{3000}}]+', ' ', 'g')) AS t FROM v),
    m AS (SELECT *, regexp_extract(t, '{_NUMERIC}', ['era', 'y', 'mo', 'd', 'half', 'h', 'mi', 's', 'f', 'z']) AS a, regexp_extract(t, '{_DAY_FIRST}', ['d', 'mo', 'y', 'h', 'mi', 's', 'z']) AS b,
        regexp_extract(t, '{_MONTH_FIRST}', ['mo', 'd', 'y', 'h', 'mi', 'half']) AS c, regexp_extract(t, '{_COMPACT}', ['y', 'mo', 'd', 'h', 'mi', 's', 'z']) AS e FROM t),
    p AS (SELECT table_name, rec_no, key, raw, t,
        CASE WHEN a.era <> '' OR length(a.y) = 3 THEN try_cast(a.y AS INT) + 1911 ELSE {_either("y", "abce")}::INT END AS y,
        CASE WHEN b.y <> '' THEN {_MONTH.format("b.mo")} WHEN c.y <> '' THEN {_MONTH.format("c.mo")} ELSE {_either("mo", "ae")}::INT END AS mo,
        {_either("d", "abce")}::INT AS d, coalesce({_either("half", "ac")}, '') AS half, coalesce({_either("h", "abce")}, '0')::INT AS h0, coalesce({_either("mi", "abce")}, '0') AS mi,
        coalesce({_either("s", "abe")}, '0') AS s, rpad(left(a.f, 6), 6, '0') AS f, coalesce({_either("z", "abe")}, '') AS z FROM m),
    l AS (SELECT *, try_cast(y || '-' || mo || '-' || d || ' ' || lpad((CASE WHEN half IN ('下午', 'PM') AND h0 < 12 THEN h0 + 12 WHEN half IN ('上午', 'AM') AND h0 = 12 THEN 0 ELSE h0 END)::VARCHAR, 2, '0') || ':' || lpad(mi, 2, '0') || ':' || lpad(s, 2, '0') || '.' || f AS TIMESTAMP) AS local FROM p),
    instants AS (SELECT table_name, rec_no, key, raw, CASE
        WHEN regexp_full_match(t, '\\d{{10}}') THEN make_timestamp(try_cast(t AS BIGINT) * 1000000) WHEN regexp_full_match(t, '\\d{{13}}') THEN make_timestamp(try_cast(t AS BIGINT) * 1000)
        WHEN z = '' THEN local - INTERVAL 8 HOUR
        WHEN regexp_matches(z, '^(GMT|UTC)[+-]\\d') THEN local - to_hours(try_cast(substring(z, 4) AS INT))
        WHEN regexp_matches(z, '^[+-]\\d{{2}}') THEN local - to_minutes((CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (try_cast(substring(z, 2, 2) AS INT) * 60 + try_cast(regexp_extract(z, '^.\\d{{2}}:?(\\d{{2}})', 1) AS INT)))::BIGINT)
        WHEN contains(z, '/') THEN timezone('UTC', timezone(z, local)) ELSE local - to_minutes(({_AHEAD})::BIGINT) END AS instant FROM l)"""

PAIRS = f"WITH {INSTANTS} SELECT a.table_name, a.rec_no AS rec_no_a, b.rec_no AS rec_no_b FROM instants a JOIN instants b ON a.table_name = b.table_name AND a.key = b.key AND date_trunc('second', a.instant) = date_trunc('second', b.instant) AND a.rec_no < b.rec_no"
ROWS = f"WITH {INSTANTS} SELECT table_name, rec_no, raw, instant FROM instants"
