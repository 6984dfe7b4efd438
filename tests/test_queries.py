"""Every query over the whole small tables, held against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import queries as core

NAMES = sorted(core.queries())


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = core.queries()[name](spark, small)
    rows = df.collect()
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in rows)
    assert got == want


def test_every_hundredth_document_is_asked(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(core.oracle_sql()["document_search"]).fetchall()
    got = core.queries()["document_search"](spark, sf).select("query_id", "doc_id", "score").collect()
    assert sorted((q, d, round(s, 6)) for q, d, s in got) == sorted((q, d, round(s, 6)) for q, d, s in want)
    ids = {i for (i,) in con.execute("SELECT doc_id FROM documents WHERE doc_id % 100 = 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')").fetchall()}
    assert {q for q, *_ in want} == ids
    assert {r.query_id for r in core.queries()["text_contexts"](spark, sf).collect()} == ids


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_import_the_subpackage():
    root = Path(core.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quern.llm" not in path.read_text(), path
