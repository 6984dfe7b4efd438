"""The queries over the whole small tables, held against brute force or SQL."""

from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from quern.llm import queries as llm
from quern.llm.codes import comparison_form
from quern.llm.graph import one_edit
from quern.session import table


def rows(spark, small, name):
    return {tuple(r) for r in llm.queries()[name](spark, small).collect()}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, small, name):
    # No vector of the smallest table has an id divisible by 100.
    assert llm.queries()[name](spark, small).count() > 0 or name == "p4_most_similar"


def test_p2(spark, small):
    want = set()
    for name, exact, fuzzy in (("course_table_row", ["semester", "category", "sub_category", "credit"], "course_name"), ("department_member_row", ["person_name", "phone", "email", "office"], "metadata")):
        texts, bases = set(), defaultdict(set)
        for r in table(spark, small, name).orderBy("batch_no", "rec_no").collect():
            text, base = comparison_form(r.text), tuple(None if r[c] is None else comparison_form(str(r[c])) for c in exact)
            kind = None if r[fuzzy] is None else comparison_form(r[fuzzy])
            if r.batch_no > 0 and (text in texts or (kind is not None and any(one_edit(kind, x) for x in bases[base]))):
                want.add((name, r.rec_no))
            else:
                texts.add(text)
                if kind is not None:
                    bases[base].add(kind)
    assert rows(spark, small, "p2_found") == want


def test_p4(spark, small):
    held = [(r.vec_id, r.embedding) for r in table(spark, small, "chunk_vectors").collect() if r.embedding and any(r.embedding)]
    x = np.array([v for _, v in held])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in held]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert rows(spark, small, "p4_found") == want


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert {tuple(r) for r in llm.queries()[name](spark, small).select(*names).collect()} == set(want.fetchall())


def test_p8(spark, small):
    grams = defaultdict(set)
    for r in table(spark, small, "eval_items").collect():
        t = comparison_form(r.text)
        for j in range(len(t) - 29):
            grams[t[j : j + 30]].add(r.item_id)
    want = set()
    for r in table(spark, small, "documents").collect():
        t = comparison_form(r.text or "")
        want |= {(r.doc_id, i) for j in range(len(t) - 29) for i in grams.get(t[j : j + 30], ())}
    assert rows(spark, small, "p8_found") == want


def test_p10(spark, small):
    windows = defaultdict(set)
    for r in table(spark, small, "documents").collect():
        for j in range(len(r.text or "") - 119):
            windows[r.text[j : j + 120]].add(r.doc_id)
    assert rows(spark, small, "p10_found") == {(d,) for ds in windows.values() if len(ds) > 1 for d in ds}
