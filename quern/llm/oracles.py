"""SQL for queries whose definition is plain but whose text forms SQL lacks: the forms are tables made by rule."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from quern.llm.canonical import CYRILLIC, GREEK, GREEK_WEAK, _IGNORABLE
from quern.llm.codes import comparison_form
from quern.llm.graph import NUMERALS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _letters() -> list[str]:
    return [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]


@cache
def _forms() -> str:
    """VALUES of the characters whose comparison form is neither empty nor their lower case."""
    return ", ".join(f"({_quoted(c)}, {_quoted(f)})" for c in _letters() if (f := comparison_form(c)) not in ("", c.lower()))


@cache
def _class(kind: str) -> str:
    """A class of RE2 of all characters of a kind, made of ranges."""
    test = {"compat": lambda c: (p := unicodedata.normalize("NFKC", c)) != c and any(x.isalnum() for x in p) and unicodedata.category(c) not in ("Cf", "Zs", "Zl", "Zp"), "hidden": lambda c: unicodedata.category(c) == "Cf" or bool(_IGNORABLE.match(c))}[kind]
    points, out = [ord(c) for c in _letters() if test(c)], []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def formed(strings: str) -> str:
    """CTEs ``forms`` (s, form) of the comparison forms of the distinct strings ``s`` that ``strings`` selects."""
    return f"""
    forms_map AS (SELECT * FROM (VALUES {_forms()}) AS m(c, f)),
    strings AS (SELECT DISTINCT s, nfc_normalize(regexp_replace(s, '\\p{{Cf}}+', '', 'g')) AS t FROM ({strings}) WHERE s IS NOT NULL),
    pieces AS (SELECT s, i, substring(t, i, 1) AS c FROM (SELECT s, t, unnest(generate_series(1, length(t))) AS i FROM strings)),
    forms AS (SELECT s, coalesce(form, '') AS form FROM (SELECT DISTINCT s FROM strings) LEFT JOIN (
        SELECT s, string_agg(coalesce(f, CASE WHEN regexp_matches(c, '[\\p{{L}}\\p{{N}}]') THEN lower(c) ELSE '' END), '' ORDER BY i) AS form FROM pieces LEFT JOIN forms_map USING (c) GROUP BY s) USING (s))"""


def p1_found() -> str:
    strong, twins = "".join(CYRILLIC) + "".join(GREEK), "".join(CYRILLIC) + "".join(GREEK) + "".join(GREEK_WEAK)
    odd = f"""regexp_matches(s, '{_class("compat")}') OR regexp_matches(s, '\\pL\\p{{Mn}}') OR regexp_matches(s, '{_class("hidden")}') OR regexp_matches(s, '[^ \\P{{Z}}]')
        OR regexp_matches(s, '\\p{{Latin}}[{twins}]|[{twins}]\\p{{Latin}}') OR regexp_matches(s, '(^|[^\\p{{Cyrillic}}\\p{{Greek}}])[{strong}]+([^\\p{{Cyrillic}}\\p{{Greek}}]|$)')"""
    return f"""
    SELECT table_name, rec_no FROM (SELECT 'course_table_row' AS table_name, rec_no, course_name AS s FROM course_table_row UNION ALL SELECT 'clean_latest_news', rec_no, text FROM clean_latest_news)
    WHERE {odd}"""


def p2_found() -> str:
    tables = (("course_table_row", ["semester", "category", "sub_category", "credit"], "course_name"), ("department_member_row", ["person_name", "phone", "email", "office"], "metadata"))
    strings = " UNION ALL ".join(f"SELECT {c}::VARCHAR AS s FROM {t}" for t, exact, fuzzy in tables for c in ("text", *exact, fuzzy))
    rows = []
    for t, exact, fuzzy in tables:
        joins = " ".join(f"LEFT JOIN forms f{i} ON f{i}.s = r.{c}::VARCHAR" for i, c in enumerate(("text", fuzzy, *exact)))
        base = ", ".join(f"coalesce(f{i + 2}.form, chr(7))" for i in range(len(exact)))
        rows.append(f"SELECT '{t}' AS tab, r.rec_no, r.batch_no, f0.form AS txt, f1.form AS name, concat_ws(chr(31), {base}) AS base FROM {t} r {joins}")
    kept = f"[\\p{{Nd}}\\p{{Latin}}{''.join(sorted(NUMERALS))}]"
    # Lengths of the common beginning and end of two names tell one edit, and the characters between are the edited ones.
    common = lambda cut: f"list_max(list_filter(range(0, least(length(a.name), length(b.name)) + 1), lambda n: {cut}(a.name, n) = {cut}(b.name, n)))"
    edited = lambda x: f"substring({x}.name, (head + 1)::BIGINT, greatest(length({x}.name) - head - least(tail, least(length(a.name), length(b.name)) - head), 0))"
    near = f"""SELECT a.tab, a.batch_no, a.rec_no, b.rec_no FROM (SELECT a, b, {common("left")} AS head, {common("right")} AS tail FROM near_rows)
        WHERE a.name = b.name OR head + tail >= greatest(length(a.name), length(b.name)) - 1 AND NOT regexp_matches({edited("a")} || {edited("b")}, '{kept}')"""
    later = "(a.batch_no, a.rec_no) < (b.batch_no, b.rec_no) AND b.batch_no > 0"
    return f"""
    WITH RECURSIVE {formed(strings)},
    r AS ({" UNION ALL ".join(rows)}),
    near_rows AS (SELECT a, b FROM r a JOIN r b ON a.tab = b.tab AND a.base = b.base WHERE {later} AND abs(length(a.name) - length(b.name)) < 2),
    pairs AS (SELECT a.tab, a.batch_no AS first_batch, a.rec_no AS first, b.rec_no AS later FROM r a JOIN r b ON a.tab = b.tab AND a.txt = b.txt WHERE {later}
        UNION {near}),
    members AS (SELECT tab, rec_no, row_number() OVER (ORDER BY batch_no, rec_no) AS i FROM r WHERE batch_no > 0 AND (rec_no IN (SELECT later FROM pairs) OR rec_no IN (SELECT first FROM pairs))),
    steps AS (SELECT m.i, bool_or(coalesce(p.first_batch <= 0, false)) AS known, list(e.i) FILTER (e.i IS NOT NULL) AS earlier FROM members m LEFT JOIN pairs p ON p.later = m.rec_no LEFT JOIN members e ON e.rec_no = p.first GROUP BY m.i),
    walk(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT walk.i + 1, CASE WHEN s.known OR list_has_any(coalesce(s.earlier, []::BIGINT[]), walk.taken) THEN walk.taken ELSE list_append(walk.taken, walk.i + 1) END FROM walk JOIN steps s ON s.i = walk.i + 1)
    SELECT tab AS table_name, rec_no FROM members WHERE i NOT IN (SELECT unnest(taken) FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1))"""


def p8_found() -> str:
    return f"""
    WITH {formed("SELECT text AS s FROM documents UNION ALL SELECT text FROM eval_items")},
    d AS (SELECT doc_id, form FROM documents JOIN forms ON s = text WHERE length(form) >= 30),
    e AS (SELECT item_id, form FROM eval_items JOIN forms ON s = text WHERE length(form) >= 30),
    dw AS (SELECT doc_id, substring(form, i, 30) AS w FROM (SELECT doc_id, form, unnest(generate_series(1, length(form) - 29)) AS i FROM d)),
    ew AS (SELECT DISTINCT item_id, substring(form, i, 30) AS w FROM (SELECT item_id, form, unnest(generate_series(1, length(form) - 29)) AS i FROM e))
    SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (w)"""
