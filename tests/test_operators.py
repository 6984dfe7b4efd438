import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunk, prompts, retrieval
from quern.operators.bm25 import FullTextIndex, similarity
from quern.operators.dedup import best_of_group, keep_first, unseen, upsert, upsert_table
from quern.operators.members import first_link, member_records
from quern.operators.timestamps import parse_instant, same_instant_pairs, with_instant
from quern.operators.timetable import blocks, course_name, courses_of, crawl_records, credit_tokens, lines, notes_of, sub_category, timetable
from quern.operators.units import OTHER_COST, Levels, off_reference, quantities, remark_unit, with_common_units
from quern.operators.vectors import vector_top_k
from quern.session import stored


# ---- chunks


def plain_chunks(text, target, overlap):
    import re

    said = [s.strip() for s in re.split(r"(?<=[。！？!?；;])|\n+", text.replace("\r\n", "\n").replace("\r", "\n"))]
    out, held = [], ""
    for s in [s for s in said if s]:
        if len(s) > target:
            if held.strip():
                out.append(held.strip())
            step = target - overlap if overlap < target else target
            at = 0
            while True:
                out.append(s[at : at + target].strip())
                if at + target >= len(s):
                    break
                at += step
            held = ""
        elif not held:
            held = s
        elif len(held) + 1 + len(s) <= target:
            held += "\n" + s
        else:
            out.append(held.strip())
            held = (held.strip()[-overlap:] if overlap else "") + "\n" + s
    return [*out, held.strip()] if held.strip() else out


@pytest.mark.parametrize(("target", "overlap"), [(40, 10), (10, 10), (25, 0)])
def test_chunks_against_a_plain_fold(spark, target, overlap):
    rng = random.Random(3)
    texts = ["".join(rng.choice("甲乙ab 。！;\n\r") for _ in range(rng.randrange(0, 200))) for _ in range(60)] + ["", "x" * 2500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", chunk.chunks(F.col("t"), target, overlap).alias("c")).collect():
        assert r.c == plain_chunks(r.t or "", target, overlap)


def test_slices_and_sentences(spark):
    row = spark.createDataFrame([("x" * 2500, "甲。乙！c?d.e\n\nf；")], "x string, s string").select(F.transform(chunk.hard_slices(F.col("x"), 1000, 150), F.length).alias("n"), chunk.sentences(F.col("s")).alias("s")).first()
    assert row.n == [1000, 1000, 800]
    assert row.s == ["甲。", "乙！", "c?", "d.e", "f；"]


def test_blank_document_is_one_empty_chunk(spark):
    rows = chunk.chunk_documents(spark.createDataFrame([("d", "")], "doc_id string, text string")).collect()
    assert [(r.chunk_index, r.chunk_text) for r in rows] == [(0, "")]


def test_recursive_split():
    text = "aa bb cc\n\n" + "d" * 25 + "\n\nee"
    parts = chunk.split_recursively(text, 10, 3)
    assert all(len(p) <= 10 for p in parts) and parts[0] == "aa bb cc" and parts[-1].endswith("ee")
    assert chunk.split_recursively("", 10, 3) == []


# ---- dedup


def test_keep_first_and_unseen(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "n int, k string")
    assert sorted(r.n for r in keep_first(df, ["k"], ["n"]).collect()) == [1, 2, 5]
    assert sorted(r.n for r in unseen(df.where("k IS NOT NULL"), df.where("k = 'b'"), "k", ["n"]).collect()) == [1]


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, upsert(old, new, "k", ["v"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    path = str(tmp_path / "t")
    for rows in (old, new, new):
        out = upsert_table(spark, path, rows, "k", ["v"])
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_best_of_group_keeps_first_on_a_tie(spark):
    df = spark.createDataFrame([(1, "g", 0.5, "x"), (2, "g", 0.5, "y"), (3, "h", None, "z")], "place int, g string, s double, id string")
    rows = {r.g: (r.id, r.first_place.place) for r in best_of_group(df, ["g"], F.col("s"), ["place"]).collect()}
    assert rows == {"g": ("x", 1), "h": ("z", 3)}


# ---- retrieval


def test_bm25_equals_sqlite(spark):
    import sqlite3

    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), rng.choice(words)) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, text, chunk_id)")
    con.executemany("INSERT INTO t(chunk_id, text, title) VALUES (?, ?, ?)", rows)
    index = FullTextIndex.build(spark.createDataFrame(rows, "chunk_id string, text string, title string"), fields=("title", "text", "chunk_id"))
    queries = ["alpha", "alpha beta", "nothing", "gamma? delta", "alpha alpha"]
    found = index.search(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), 100).collect()
    for i, q in enumerate(queries):
        want = dict(con.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH ?", (q.replace("?", " "),)).fetchall())
        got = {r.id: r.score for r in found if r.query_id == i}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_of_many_queries_that_share_a_hot_term(spark):
    texts = [f"the w{i % 7} v{i % 31}" for i in range(300)]
    index = FullTextIndex.build(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string"), fields=("text",))
    queries = [(i, t) for i, t in enumerate(texts)] + [(300, "the the"), (301, "the absent"), (302, ""), (303, None)]
    got = {}
    for r in index.search(spark.createDataFrame(queries, "query_id int, query string"), 400).collect():
        got.setdefault(r.query_id, {})[r.id] = r["rank"]
    assert got.keys() == set(range(301))
    for q, t in queries[:301]:
        assert list(sorted(got[q], key=got[q].get)) == [i for i, x in enumerate(texts) if set(t.split()) <= set(x.split())]


def test_similarity_modes(spark):
    row = spark.range(1).select(similarity(F.lit(-3.0)).alias("a"), similarity(F.lit(-0.5), True).alias("b"), similarity(F.lit(-3.0), True).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.75, 2.0, -0.5)


def test_vector_top_k_against_numpy(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(300, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = vector_top_k(df.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS vector"), df, 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        want = np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    l2 = vector_top_k(df.where("vec_id = 0").selectExpr("vec_id AS query_id", "embedding AS vector"), df, 1, metric="l2sq").first()
    assert l2.vec_id == 0 and abs(l2.sim - 1) < 1e-9


def test_merge_recency_and_gate(spark):
    v = spark.createDataFrame([(1, "a", "da", {"x": "v"}, 0.9, 1), (1, "a", "da", {"x": "v"}, 0.2, 2), (1, "b", "db", {}, -0.5, 3)], "query_id int, id string, doc string, meta map<string,string>, vec_sim double, place int")
    b = spark.createDataFrame([(1, "a", "other", {"x": "b"}, 0.3, 1), (1, "c", "dc", {}, -2.0, 2)], "query_id int, id string, doc string, meta map<string,string>, bm25_sim double, place int")
    rows = {r.id: r for r in retrieval.merge_hits(v, b).collect()}
    assert (rows["a"].vec_sim, rows["a"].bm25_sim, rows["a"].doc) == (0.9, 0.3, "da")
    assert (rows["b"].vec_sim, rows["c"].bm25_sim) == (0.0, 0.0)
    assert [r.id for r in sorted(rows.values(), key=lambda r: r.place)] == ["a", "b", "c"]
    times = spark.createDataFrame([("",), ("bogus",), ("2000-01-01",), ("2000-01-01T00:00:00+08:00",), (None,)], "t string")
    assert [r.k for r in times.select(retrieval.recent(F.col("t"), 30, dt.datetime(2020, 1, 1, tzinfo=dt.UTC)).alias("k")).collect()] == [True, True, True, False, True]
    asks = spark.createDataFrame([("",), ("Hello",), ("你好",), ("anything else",)], "q string").select(retrieval.asks_for_information(F.col("q")).alias("a"))
    assert [r.a for r in asks.collect()] == [False, False, False, True]


def test_ranking_uses_group_limit(spark):
    df = spark.range(100).selectExpr("id % 3 AS query_id", "id AS place", "rand(1) AS rr_score")
    plan = retrieval.top_hits(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 2, {"title": "T"}, " b "), (1, 1, {}, "a")], "query_id int, rank int, meta map<string,string>, doc string")
    assert prompts.contexts(hits).first().context == "[1] (無標題) | \n\na\n\n[2] T | \n\nb\n"
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "system", "a"), (1, 3, "user", "c")], "conv_id int, turn int, role string, text string")
    assert prompts.histories(turns).first().history == "system: a\nuser: b\nuser: c"
    assert prompts.histories(turns, last=2).first().history == "user: b\nuser: c"


# ---- timetable and cards


def word(text, x, top, width=10):
    return (text, float(x), float(x + width), float(top), float(top + 10))


def test_timetable_reads_columns_blocks_and_notes(spark):
    words = [word("一上", 0, 0), word("一下", 100, 0), word("英文一", 2, 30), word("(3)", 20, 31), word("普通", 1, 90), word("物理", 22, 91), word("2", 1, 105), word("學分", 12, 105), word("體育", 101, 30), word("（0）", 120, 30), word("備註", 0, 200), word("1.", 10, 200), word("專題必須達60分", 20, 200)]
    df = spark.createDataFrame([("u", 1, words), ("u", 2, words), ("u", 3, None)], "source string, page int, words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>")
    courses, notes = timetable(df)
    got = {(r.semester, r.course_name, r.credit, r.category, r.sub_category, r.page) for r in courses.collect()}
    assert ("一上", "英文一", 3, "基礎共同必修", "語文能力", 1) in got and ("一下", "體育", 0, "基礎共同必修", "體育", 1) in got
    assert [r.note for r in notes.collect()] == ["1. 專題必須達60分。"]
    records = crawl_records(courses, notes, "list", "必修", "2024-01-01")
    texts = {r.text: r for r in records.collect()}
    assert texts["一上｜基礎共同必修｜語文能力｜英文一｜3 學分"].pdf_url == "u" and texts["1. 專題必須達60分。"].title == "必修（備註）"
    assert len({r.doc_id for r in texts.values()}) == 1 and crawl_records(courses, notes, "list", "必修", "x", records).count() == 0


def test_timetable_parts(spark):
    schema = "array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>"
    df = spark.createDataFrame([([word("b", 20, 1), word("a", 0, 0), word("c", 0, 40), word("d", 0, 52), word("e", 0, 64)],), ([],), (None,)], f"words {schema}")
    got = df.select(lines(F.col("words")).alias("l")).select("l", blocks(F.col("l")).alias("b")).collect()
    assert [(x.y, x.text) for x in got[0].l] == [(0.5, "a b"), (40.0, "c"), (52.0, "d"), (64.0, "e")] and got[0].b == [["a b"], ["c", "d", "e"]]
    assert got[1].b == [] and got[2].b in ([], None)
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    texts = lambda *xs: F.array(*map(F.lit, xs))
    for raw, name in (("基礎 共同 語文 英文二 能力", "英文二"), ("系訂專業必修 微積分", "微積分"), ("必修 體育 一", "體育"), ("體育 大一 體育", "體育"), ("體育一", "體育一"), ("勞作教育 Ａ班", "勞作教育 A班"), ("勞作教育 x", "勞作教育 班"), ("公民 社會設計 素養", "社會設計"), ("系訂邏輯", "邏輯"), ("學分", "")):
        assert one(course_name(F.lit(raw))) == name, raw
    assert [c.credit for c in one(courses_of(texts("微積分(3)物理（2）", "化學 4學分"), F.lit("一上")))] == [3, 2, 4]
    assert [(c.raw, c.credit) for c in one(credit_tokens(texts("甲 乙(3)", "丙", "丁 （12） 戊")))] == [("甲 乙", 3), ("丙 丁", 12)]
    assert one(notes_of(F.lit("備註 1.先修微積分 2.無關 3.限修一次。"))) == ["1.先修微積分。", "3.限修一次。"]
    assert one(notes_of(F.lit("先修甲；無關。限修乙；先修甲 備註 無"))) == ["先修甲。", "限修乙。", "先修甲 備註 無。"] and one(notes_of(F.lit("先修甲"))) == ["先修甲。"] and one(notes_of(F.lit("無關"))) == []
    assert [one(sub_category(F.lit(x))) for x in ("勞作教育", "體育一", "日文", "語文與表達能力", "物理")] == ["公民素養", "體育", "語文能力", "語文能力", ""]


def test_member_cards(spark):
    html = """<div class="mdetail x"><span style="color:#0000cd;">王一</span><p>02-1</p><p>Mail: a@b.org</p><p>301室<p>301室</p><p>專長</p><p>更多</p></div>
    <div class="mdetail"><p>陳二 兼任講師</p><p>x1</p><p>x2</p><p>x3</p><p>c@d.org</p></div><div class="mdetail"></div><a href="/f.pdf">必修<b>科目表</b></a>"""
    df = spark.createDataFrame([(1, html), (2, None)], "page int, html string")
    rows = member_records(df).orderBy("card").collect()
    assert [(r.person_name, r.phone, r.email, r.office, r.metadata) for r in rows] == [("王一", "02-1", "a@b.org", "301室", "專長更多"), ("陳二 兼任講師", "", "c@d.org", "", "x1。x2。x3")]
    assert rows[0].text == "王一｜02-1｜a@b.org｜301室｜專長更多"
    assert [r.l for r in df.select(first_link(F.col("html"), "科目表").alias("l")).collect()] == ["/f.pdf", None]


# ---- timestamps


@pytest.mark.parametrize(
    ("raw", "utc"),
    [
        ("2023-08-06 22:35:00 PDT", "2023-08-07 05:35:00"),
        ("民國109年01月27日 00:00:00", "2020-01-26 16:00:00"),
        ("109年6月2日18時34分", "2020-06-02 10:34:00"),
        ("2018/3/1 上午 12:28", "2018-02-28 16:28:00"),
        ("2023/9/6 下午 6:19", "2023-09-06 10:19:00"),
        ("Thu, 04 Jul 2024 09:46:00 +0900", "2024-07-04 00:46:00"),
        ("2022-05-21 17:46:14 GMT+8", "2022-05-21 09:46:14"),
        ("2021-04-20T08:29:51+02:00[Europe/Berlin]", "2021-04-20 06:29:51"),
        ("2024-11-03 01:30:00 America/New_York", "2024-11-03 05:30:00"),
        ("2024-03-10 02:30:00 America/New_York", "2024-03-10 07:30:00"),
        ("August 7, 2020 10:23 PM", "2020-08-07 14:23:00"),
        ("1579974689", "2020-01-25 17:51:29"),
        ("1579974689920", "2020-01-25 17:51:29.920"),
        ("20190521112300", "2019-05-21 03:23:00"),
        ("20180218T001040Z", "2018-02-18 00:10:40"),
        ("113.03.27", "2024-03-26 16:00:00"),
        ("２０２４-03-27", "2024-03-26 16:00:00"),
        ("2018-05-30T18:48:00.7773982+08:00", "2018-05-30 10:48:00.777398"),
        *((x, None) for x in ("", None, "25:61", "2023-02-30", "昨天", "N/A", "2024-01-01 00:00 Mars/Base", "0000-00-00 00:00:00", "99/01/01", "x" * 10_000)),
    ],
)
def test_instants(raw, utc):
    want = None if utc is None else dt.datetime.fromisoformat(utc + "+00:00")
    got = parse_instant(raw)
    assert (got is None) == (want is None) and (want is None or dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=got) == want)


def test_instants_of_rows(spark, tmp_path):
    rows = [(1, "u", "2024-01-01T08:00:00+08:00"), (2, "u", "2024-01-01T00:00:00.5Z"), (3, "u", None), (4, "u", "bad"), (5, "v", "2024-01-01T00:00:00Z"), (6, None, "2024-01-01T00:00:00Z"), (7, None, "2024-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "raw_id int, source string, raw string")
    path = str(tmp_path / "dictionary")
    out = with_instant(df, "raw", "s", path=path)
    assert out.count() == 7 and out.columns == ["raw_id", "source", "raw", "instant"]
    assert [tuple(r) for r in same_instant_pairs(out, ["source"], "raw_id").select("raw_id_a", "raw_id_b").collect()] == [(1, 2)]
    before = spark.read.parquet(path).count()
    assert with_instant(df, "raw", "s", path=path).count() == 7 and spark.read.parquet(path).count() == before
    assert with_instant(df.limit(0), "raw", "s").count() == 0


# ---- units


@pytest.mark.parametrize(
    ("text", "kind", "unit", "values"),
    [
        ("12 GB GDDR6X", "memory", None, [12288]), ("４ GB GDDR７", "memory", None, [4096]), ("2 x 12 GB", "memory", None, [24576]), ("192 Gb GDDR6X", "memory", None, [24576]), ("48G", "memory", None, [49152]),
        ("20971520 KB", "memory", None, [20480]), ("4,096 MiB", "memory", None, [4096]), ("8 GB / 24 GB", "memory", None, [8192, 24576]), ("10 吉位元組", "memory", None, [10240]), ("24576", "memory", "MB", [24576]),
        ("1,86 GHz", "frequency", None, [1860]), ("2,070 MHz", "frequency", None, [2070]), ("約 1.32 Ghz", "frequency", None, [1320]), ("0.002850 THz", "frequency", None, [2850]), ("2.28e9 Hz", "frequency", None, [2280]),
        ("2.33 吉赫", "frequency", None, [2330]), ("1840 百萬赫茲", "frequency", None, [1840]), ("1.78", "frequency", "GHz", [1780]), ("N/A", "frequency", None, []), ("", "memory", None, []), ("0 GB", "memory", None, []), ("即將推出", "frequency", None, []),
    ],
)
def test_quantities(text, kind, unit, values):
    assert [v for v, _ in quantities(text, kind, unit)] == pytest.approx(values)


def test_remark_units():
    assert remark_unit("加速時脈單位為 GHz；記憶體容量以 MB 計", "記憶體容量", "memory") == "MB"
    assert remark_unit("加速時脈 in MHz", "加速時脈", "frequency") == "MHz"
    assert remark_unit("含三年保固", "加速時脈", "frequency") is None


def test_changepoints_are_exact():
    rng = np.random.RandomState(2)
    for n in (1, 2, 4, 5):
        levels = Levels("frequency", 0.01, 0.005, 9.0)
        x = rng.choice([0.0, math.log(1000), -math.log(1e6), 1.1], n) + rng.randn(n) * 0.02
        cost = ((x[:, None] - levels.level) / levels.scale) ** 2
        cost[:, 1] = OTHER_COST
        price = lambda way, cost=cost: sum(cost[t, k] for t, k in enumerate(way)) + 9.0 * sum(a != b for a, b in zip(way, way[1:]))
        best = min(price(way) for way in itertools.product(range(levels.states), repeat=n))
        assert levels.piece(x).min() == pytest.approx(best)
        assert price(levels.states_of(x, -1, int(levels.piece(x).min(0).argmin()))) == pytest.approx(best)


def test_pieces_of_a_history_do_not_change_its_segments(spark):
    rng = np.random.RandomState(4)
    rows = [(i, s, f"{v * 2000 * math.exp(e):.4f} MHz") for s in ("a", "b", None) for i, (v, e) in enumerate(zip(np.repeat(rng.choice([1.0, 1.0, 1e-3, 1e3, 1.9], 40), rng.randint(1, 9, 40)), rng.randn(400) * 0.002, strict=False))]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, product string, clock string")
    results = [{r.id: (r.factor, r.shifted) for r in with_common_units(df.repartition(k), {"clock": "frequency"}, "id", "product", piece=n).collect()} for n, k in ((1 << 20, 1), (7, 3), (64, 5))]
    assert results[0] == results[1] == results[2] and {round(math.log10(f)) for f, _ in results[0].values()} >= {0, -3, 3}


def test_candidates_come_from_the_segments(spark, monkeypatch):
    rows = [(i, "p", "2.0 GHz") for i in range(20)] + [(20 + i, "p", "2.0 MHz") for i in range(3)] + [(30 + i, "q", "3 GHz") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, product string, clock string")
    reference = spark.createDataFrame([("p", 2000), ("q", 2500)], "product string, mhz int")
    out = stored(with_common_units(df, {"clock": "frequency"}, "id", "product"), "units")
    found = lambda d: sorted(r.id for r in off_reference(d, reference, "product", {"clock": "mhz"}).collect())
    assert found(out) == [20, 21, 22, 30, 31, 32]
    # Without the segments only sources whose usual level is off are looked at.
    assert found(out.withColumn("shifted", F.lit(False))) == [30, 31, 32]


def test_unit_changes_are_reversed(spark):
    rows = [(i, "p", "2.0 GHz", None) for i in range(20)] + [(20 + i, "p", "2.0 MHz", None) for i in range(3)] + [(30, "p", "2.1 GHz", None), (31, "p", None, None), (32, None, "5", None), (33, "q", "-", None)]
    df = spark.createDataFrame(rows, "id long, product string, clock string, remark string")
    out = with_common_units(df, {"clock": "frequency"}, "id", "product", "remark")
    got = {r.id: (r.value, r.factor, r.common_value) for r in out.collect()}
    assert len(got) == len(rows) and got[21] == pytest.approx((2.0, 0.001, 2000.0)) and got[30] == pytest.approx((2100.0, 1.0, 2100.0)) and got[31] == (None, None, None)
    reference = spark.createDataFrame([("p", 2000)], "product string, mhz int")
    assert sorted(r.id for r in off_reference(out, reference, "product", {"clock": "mhz"}).collect()) == [20, 21, 22, 30]
    assert with_common_units(df.limit(0), {"clock": "frequency"}, "id", "product").count() == 0
