"""Nulls in every column, empty tables, rows that repeat, and extra columns named like those the operators use inside."""

import pytest
from pyspark.sql import functions as F

from quern.llm.canonical import with_canonical
from quern.llm.history import keyed, repeated_rows
from quern.llm.leaks import leaked_items
from quern.llm.markup import with_clean_text
from quern.llm.mixture import mixture
from quern.llm.ranking import ideal_point_ranking
from quern.llm.spans import shared_spans, sharing_documents
from quern.llm.vptree import most_similar, similar_pairs

CLASHES = ["doc", "item", "row", "q", "k", "first", "v", "own", "raw", "h", "at", "state", "name", "base", "shard", "part", "source_", "record", "tokens", "slot", "query", "n", "step", "canonical", "odd", "clean_text", "markup", "page", "words"]

LONG = "很長的文字，" * 30_000


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


CASES = {
    "canonical": ("id long, t string", [(1, "Ａ"), (2, None), (2, "Ａ"), (None, LONG)], lambda d: with_canonical(d, "t").select("id", "canonical", "odd")),
    "markup": ("id long, t string", [(1, "<b>a</b>"), (2, None), (2, ""), (None, LONG)], lambda d: with_clean_text(d, "t").select("id", "clean_text", "markup")),
    "ranking": ("query_id long, hit_id long, id string, a double, b double", [(1, 1, "x", 1.0, None), (1, 2, None, None, 2.0), (None, None, None, None, None), (1, 1, "x", 1.0, None)], lambda d: ideal_point_ranking(d, {"a": 1.0, "b": 1.0})),
    "spans": ("doc_id long, text string", [(1, LONG), (2, LONG), (3, None), (None, LONG), (4, "")], lambda d: shared_spans(d).select("doc_id", "n_chars", "shared_chars")),
    "sharing": ("doc_id long, text string", [(1, "x" * 130), (2, "x" * 130), (3, None)], sharing_documents),
    "leaks": ("doc_id long, text string", [(1, "甲乙丙丁戊己庚辛" * 5), (2, None), (2, LONG)], lambda d: leaked_items(d, d.sparkSession.createDataFrame([(7, "甲乙丙丁戊己庚辛" * 4), (8, None)], "item_id long, text string"))),
    "mixture": ("doc_id long, source string, text string", [(1, "a", "字 " * 900), (2, None, "b"), (None, "a", None), (3, "b", LONG)], lambda d: mixture(d, d.sparkSession.createDataFrame([("a", 0.5, 2), ("b", 0.5, None)], "source string, target_share double, max_repeats int"))),
    "pairs": ("id long, v2 array<double>", [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (2, [1.0, 0.0])], lambda d: similar_pairs(d, "id", "v2")),
    "nearest": ("id long, v2 array<double>", [(100, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], lambda d: most_similar(d, "id", "v2", k=1)),
    "history": ("rec_no long, batch_no int, t string, b string, f string", [(1, 0, "甲", None, None), (2, 1, "甲", "x", "y"), (3, 1, None, None, None), (4, 1, None, None, None), (5, 2, LONG, "x", LONG), (6, 2, LONG + "乙", "x", LONG + "乙")], lambda d: repeated_rows(keyed(d, F.lit("s"), "rec_no", "t", ["b"], "f", ("batch_no",)))),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_clashing_names_change_nothing(spark, case):
    schema, rows, run = CASES[case]
    df = spark.createDataFrame(rows, schema)
    plain = run(df)
    plain_rows = sorted(map(repr, plain.collect()))
    other = run(clashing(df))
    assert other.columns == plain.columns
    assert sorted(map(repr, other.collect())) == plain_rows
    assert run(df.limit(0)).columns == plain.columns and run(df.limit(0)).count() == 0


def test_defined_results(spark):
    run = lambda case: CASES[case][2](spark.createDataFrame(CASES[case][1], CASES[case][0])).collect()
    assert {r.row for r in run("history")} == {2, 6}
    assert [(r.id_a, r.id_b) for r in run("pairs")] == [(1, 2)]
    assert [(r.id, r.other) for r in run("nearest")] == [(100, 2)]
    assert [(r.doc_id, r.item_id) for r in run("leaks")] == [(1, 7)]
    assert {r.doc_id for r in run("sharing")} == {1, 2}
