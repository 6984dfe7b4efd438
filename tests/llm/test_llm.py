import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import codes, leaks, markup, vptree
from quern.llm import mixture as mixture_module
from quern.llm.canonical import COMPAT, INVISIBLE, LOOKALIKE, MARK, SPACE, canonical, with_canonical
from quern.llm.graph import Graph, one_edit
from quern.llm.history import HistoryIndex, keyed, repeated_rows, subkeys
from quern.llm.leaks import leaked_items
from quern.llm.markup import BoostedTrees, clean, examples, formula, labelled, model, with_clean_text
from quern.llm.mixture import mixture, mixture_report
from quern.llm.ranking import ideal_point_ranking
from quern.llm.spans import shared_spans, sharing_documents
from quern.llm.vptree import Tree, VantageIndex, most_similar, similar_pairs

# ---- canonical forms


@pytest.mark.parametrize(
    ("given_", "form", "mask"),
    [
        ("ＡＢ１ 中", "AB1 中", COMPAT),
        ("⽤⼈ 樓", "用人 樓", COMPAT),
        ("Re\u0301sume\u0301", "Résumé", MARK),
        ("a\u200bb\u00ad", "ab", INVISIBLE),
        ("a\u3000b\u00a0", "a b ", SPACE),
        ("GРU", "GPU", LOOKALIKE),
        ("АІ 市場", "AI 市場", LOOKALIKE),
        ("會用 С# 與", "會用 C# 與", LOOKALIKE),
        ("na\u00efνе", "na\u00efve", LOOKALIKE),
        ("量測 Δ、σ 與 Ω，（一）．", "量測 Δ、σ 與 Ω，（一）．", 0),
        ("Café façade\n", "Café façade\n", 0),
        ("Москва и С", "Москва и С", 0),
        ("Η ΝΙΚΗ ΚΑΙ Η ΑΝΝΑ ΣΤΗΝ ΑΘΗΝΑ", "Η ΝΙΚΗ ΚΑΙ Η ΑΝΝΑ ΣΤΗΝ ΑΘΗΝΑ", 0),
        ("ΝΙΚΗ 量測 Δ", "NIKH 量測 Δ", LOOKALIKE),
        ("Ꭺpple 與 օbject", "Apple 與 object", LOOKALIKE),
        ("ꓮꓲ 課程", "AI 課程", LOOKALIKE),
        ("ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᎪ", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᎪ", 0),
        ("հայերեն օս", "հայերեն օս", 0),
        ("/kɑt/ ɡ", "/kɑt/ ɡ", 0),
        ("5 m² 與 x₁₀、(a+b)³", "5 m^2 與 x_10、(a+b)^3", COMPAT),
        ("½ 與 3½", "1/2 與 3 1/2", COMPAT),
        ("Pусский", "Русский", 0),
        ("", "", 0),
    ],
)
def test_canonical(given_, form, mask):
    assert canonical(given_) == (form, mask)
    assert canonical(form)[1] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_canonical_is_stable(text):
    once = canonical(text)[0]
    assert canonical(once)[0] == canonical(canonical(once)[0])[0]


def test_canonical_rows(spark):
    df = spark.createDataFrame([(1, "Ａ", 5), (2, None, 6), (3, "", 7), (4, "plain", 8), (5, "Ａ" * 100_000, 9)], "id int, t string, odd int")
    rows = {r.id: r for r in with_canonical(df, "t").collect()}
    assert [(rows[i].canonical, rows[i].odd) for i in (1, 2, 3, 4)] == [("A", COMPAT), (None, 0), ("", 0), ("plain", 0)]
    assert len(rows[5].canonical) == 100_000 and with_canonical(df.limit(0), "t").count() == 0


# ---- arrays of code points


def test_comparison_form():
    assert codes.comparison_form("Ｇ\u0420U、Ré\u200bsume\u0301（一）1") == "gpurésumé一1"
    for t in ("Ｇ\u0420U、R", "e\u0301x", "㎏ﬁ", "İ", "", "甲\n乙"):
        assert "".join(map(chr, codes.comparison_codes(codes.code_points(t), t))) == codes.comparison_form(t) == codes.form(t)


def test_rolling_and_winnowing():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 10, 60, 200)]
    rolling = codes.Rolling([codes.code_points(t) for t in texts])
    hashes, inside = rolling.windows(5)
    whole = "".join(texts)
    same = defaultdict(set)
    for i in np.flatnonzero(inside).tolist():
        same[whole[i : i + 5]].add(int(hashes[i]))
    assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)
    assert sum(inside) == sum(max(0, len(t) - 4) for t in texts)
    chosen = set(codes.winnow(hashes, inside, 4).tolist())
    for n, t in enumerate(texts):
        for i in range(len(t) - 8 + 1):
            assert chosen & set(range(rolling.starts[n] + i, rolling.starts[n] + i + 4))


# ---- history


FIXED = "0a一"


def plain_repeats(rows):
    texts, bases, out = set(), defaultdict(list), set()
    for source, row, batch, text, base, name in sorted(rows, key=lambda r: (r[2], r[1])):
        key, b, n = codes.comparison_form(text) if text is not None else None, (source, base), codes.comparison_form(name) if name is not None else None
        if batch > 0 and ((source, key) in texts or (n is not None and any(one_edit(n, x) for x in bases[b]))):
            out.add(row)
        else:
            if key is not None:
                texts.add((source, key))
            if n is not None:
                bases[b].append(n)
    return out


def test_one_edit():
    assert one_edit("甲乙丙", "甲丁丙") and one_edit("甲乙", "甲乙丙") and one_edit("甲", "甲")
    assert not any(one_edit(a, b) for a, b in (("甲一", "甲二"), ("甲1", "甲"), ("甲a", "甲b"), ("甲乙", "丙丁"), ("甲一", "甲丙"), ("甲", "甲乙丙")))


def test_walks_of_a_large_base_meet_what_exhaustive_search_meets():
    rng = random.Random(1)
    heads, tails = ["".join(rng.choices("甲乙丙丁戊己庚辛壬癸子丑", k=4)) for _ in range(60)], ["".join(rng.choices("天地玄黃宇宙洪荒日月", k=4)) for _ in range(40)]
    names = sorted({a + b for a in heads for b in tails})
    graph = Graph([b"x"] * len(names), names, list(range(len(names))))
    asked = [n[:2] + "金" + n[3:] for n in names[::3]] + names[::5]
    exact = lambda pairs: {(q, n) for q, n in pairs if one_edit(asked[q], graph.names[n])}
    found, want = exact(zip(*(x.tolist() for x in graph.search([b"x"] * len(asked), asked)), strict=True)), exact(graph.exhaustive([b"x"] * len(asked), asked))
    assert found <= want and len(found) >= 0.999 * len(want)
    again = Graph.unpack(graph.pack())
    assert again.beam == graph.beam and again.living() == graph.living()
    assert all((a == b).all() for a, b in zip(graph.search([b"x"], names[:1]), again.search([b"x"], names[:1]), strict=True))


def test_siblings_that_differ_in_a_numeral_do_not_fill_a_beam():
    # Of 3,000 siblings each has one true neighbour: the numerals keep them apart, so a small beam is enough.
    numerals = ["".join(p) for n in (2, 3, 4) for p in itertools.product("一二三四五六七八九十", repeat=n)][:3000]
    names = [f"專題研究{n}組" for n in numerals]
    graph = Graph([b"x"] * len(names), names, list(range(len(names))))
    asked = [n.replace("組", "班") for n in names]
    met = {(q, n) for q, n in zip(*(x.tolist() for x in graph.search([b"x"] * len(asked), asked)), strict=True) if one_edit(asked[q], graph.names[n])}
    assert len(met) >= 0.999 * len(names)


def test_dead_nodes_are_not_found():
    graph = Graph([b"x"] * 3, ["甲乙", "甲丙", "丁"], [5, 6, 7])
    graph.dead[:] = graph.rows == 5
    assert {int(graph.rows[n]) for n in graph.search([b"x"], ["甲乙"])[1]} == {6}
    assert {r for _, _, r in graph.living()} == {6, 7}


def test_one_edit_keeps_a_subkey():
    rng = random.Random(5)
    for _ in range(2000):
        a = "".join(rng.choices("甲乙丙一2", k=rng.randrange(0, 7)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + "丁" + a[i:], a[:i] + a[i + 1 :], a[:i] + "丁" + a[i + 1 :]])
        if one_edit(a, b):
            assert set(subkeys(b"k", a)) & set(subkeys(b"k", b)), (a, b)


def plain_rows(seed, count, repeated_texts):
    rng = random.Random(seed)
    names = ["".join(rng.choices("甲乙丙丁一2", k=rng.randrange(1, 6))) for _ in range(40)] + ["Ａ甲乙", "A甲乙"]
    rows = []
    for i in range(count):
        base, name = rng.choice(["p", "q", None]), rng.choice([*names, None])
        # Some texts stand with different fields.
        text = f"同文{rng.randrange(30)}" if rng.random() < repeated_texts else f"{base}，{name or ''} {rng.randrange(2)}"
        rows.append((rng.choice("st"), i, min(3, i // (count // 4)), rng.choice([text, text, text, None]), base, name))
    return rows


@pytest.mark.parametrize(("part", "repeated_texts"), [(16_384, 0.0), (5, 0.4)])
def test_batches_against_a_plain_loop(spark, part, repeated_texts):
    rows = plain_rows(8, 240, repeated_texts)
    df = spark.createDataFrame(rows, "source string, rec_no long, batch_no int, text string, base string, name string").repartition(3)
    k = keyed(df, F.col("source"), "rec_no", "text", ["base"], "name", ("batch_no",))
    index = HistoryIndex(spark, rows_per_shard=16, fan=2, part=part)
    assert {r.row for r in repeated_rows(k, index=index).collect()} == plain_repeats(rows)
    assert index.state["depth"] > 2


def test_index_is_kept_between_sessions_and_compacts(spark, tmp_path):
    path = str(tmp_path / "index")
    make = lambda ids: keyed(spark.createDataFrame([("s", i, f"t{i}", "b", f"名{i}") for i in ids], "source string, id long, text string, base string, name string"), F.col("source"), "id", "text", ["base"], "name")
    HistoryIndex(spark, path, rows_per_shard=8, fan=3).accept(make(range(10)))
    for n in range(1, 6):
        index = HistoryIndex(spark, path, rows_per_shard=8, fan=3)
        again = index.judge(make([*range(10), *range(10 * n, 10 * n + 5)]))
        assert {r.row for r in again.collect()} == set(range(10))
    assert len(index.state["segments"]) < 4 and index.state["depth"] >= 1
    # Segments that were merged are gone.
    assert {p.name for p in (tmp_path / "index").glob("segment=*")} == {f"segment={s['id']}" for s in index.state["segments"]}
    assert HistoryIndex(spark, path).judge(make([])).count() == 0


def test_an_index_begun_by_a_batch_grows(spark):
    make = lambda ids: keyed(spark.createDataFrame([(i, f"t{i}", f"b{i % 7}", f"名{i}") for i in ids], "id long, text string, base string, name string"), F.lit("s"), "id", "text", ["base"], "name")
    index = HistoryIndex(spark, rows_per_shard=8)
    assert index.judge(make(range(4))).count() == 0 and index.state["depth"] == 0
    assert index.judge(make(range(4, 200))).count() == 0 and index.state["depth"] >= 3
    assert index.judge(make(range(100, 300))).count() == 100


# ---- vectors


def unit(n, d=16, seed=0):
    x = np.random.RandomState(seed).randn(n, d) + 2 * np.eye(d)[np.random.RandomState(seed).randint(0, 4, n)]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_tree_is_exact_with_factor_one():
    x = unit(1500)
    tree = Tree(x, leaf=64)
    want = {(i, j) for i, j in zip(*np.nonzero(x[:200] @ x.T >= 0.8), strict=True)}
    assert {(int(a), int(b)) for q, p, _ in tree.within(x[:200], 0.8, 1.0) for a, b in zip(q, p, strict=True)} == want
    best, _ = tree.nearest(x[:200], np.full(200, math.pi), 5, 1.0)
    assert np.allclose(best, -np.sort(-(x[:200] @ x.T), 1)[:, :5])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pairs_and_neighbours_of_rows(spark, kind):
    x = unit(400) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[0].tolist()), (1001, None), (1002, [0.0] * 16), (1003, [1.0]), (1004, [float("nan")] * 16), (1005, [None] * 16), (1000, x[0].tolist())]
    df = spark.createDataFrame(rows, f"id long, v array<{kind}>")
    u = np.concatenate([x, x[:1]]) / 3
    ids = [*range(400), 1000]
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.8, 1)), strict=True)}
    assert {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "v", 0.8).collect()} == want
    got = defaultdict(list)
    for r in most_similar(df, "id", "v", every=50, k=5, factor=1.0).collect():
        got[r.id].append(r.similarity)
    assert set(got) == {*range(0, 400, 50), 1000}
    for q, sims in got.items():
        i = ids.index(q)
        assert np.allclose(sorted(sims)[::-1], -np.sort(-np.delete(u @ u[i], i))[:5], atol=1e-6)
    assert similar_pairs(df.limit(0), "id", "v").count() == 0 == most_similar(df.where("id = 1001"), "id", "v").count()


def test_parted_shards_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(vptree, "FIRST", 3)
    x = unit(600, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = int(np.triu(x @ x.T >= 0.8, 1).sum())
    for rows, second in ((30, True), (80, True), (10_000, False)):
        index = VantageIndex(df, "id", "v", shard_rows=rows, least_shards=3)
        assert any(c is not None for c, _, _ in index.reach.cells) == second
        assert index.pairs(0.8).count() == want
        near = index.nearest(index.rows.where("vid % 50 = 0"), 5, 1.0).collect()
        sims = {q: sorted((r.similarity for r in near if r.a == q), reverse=True) for q in range(0, 600, 50)}
        assert all(np.allclose(sims[q], -np.sort(-np.delete(x @ x[q], q))[:5]) for q in sims)


def test_copies_of_one_vector_are_parted(spark, monkeypatch):
    monkeypatch.setattr(vptree, "FIRST", 2)
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.5]) for i in range(200)] + [(900, [0.0, 1.0, 0.0])], "id long, v array<double>")
    index = VantageIndex(df, "id", "v", shard_rows=20, least_shards=2)
    assert index.reach.width() > 4 and index.pairs(0.9).count() == 200 * 199 // 2


def test_trees_prune(spark):
    x = unit(3000, seed=5)
    tree, seen = Tree(x), []
    for factor in (1.0, 0.3):
        leaves = [0]
        stack = [(tree.root, np.arange(200))]
        while stack:
            node, rows = stack.pop()
            if len(node) == 2:
                leaves[0] += len(rows)
                continue
            c, (a, b, d, e), inner, outer = node
            far, margin = np.arccos(np.clip(x[rows] @ c, -1, 1)), factor * math.acos(0.9)
            stack += [(inner, rows[(far >= a - margin) & (far <= b + margin)]), (outer, rows[(far >= d - margin) & (far <= e + margin)])]
        seen.append(leaves[0])
    assert seen[1] < 0.6 * seen[0]


# ---- markup


def test_model_on_unseen_examples():
    x, y = labelled(examples(400, seed=101))
    p = model().log_probabilities(x).argmax(1)
    assert (p == y).mean() > 0.99 and ((p > 0) == (y > 0)).mean() > 0.99


def test_boosting_learns_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.rand(600, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    p = BoostedTrees(rounds=20, depth=3).fit(x, y, 2).log_probabilities(x).argmax(1)
    assert (p == y).mean() > 0.95


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("<p>甲<b>乙</b></p><!-- x -->", "甲乙"),
        ("a &lt; b &amp;&nbsp;c", "a < b & c"),
        ("## 標題\n內文 **重點** 與 [連結](https://a.example/1)", "§§ 標題\n內文 重點 與 連結"),
        ("== 標題 ==\n內文 '''重點''' 與 [[頁|名]]", "§§ 標題 \n內文 重點 與 名"),
        ("{| class=wikitable\n|-\n| 甲 || 3\n|}", "甲｜3"),
        ("| 甲 | 3 |\n|---|---:|\n| 乙 | 4 |", "甲｜3\n\n乙｜4"),
        ("\\begin{itemize}\\item 甲\\item 乙\\end{itemize}", "- 甲\n- 乙"),
        ("複雜度為 $O(n^{3}\\log n)$。", "複雜度為 O(n^3log n)。"),
        ("<script>var k=1;</script>甲", "甲"),
        ("\\section{標題}內文", "§ 標題 內文"),
        ("<h3>標題</h3><p>內文</p>", "§§§ 標題 內文"),
        ("水是 H<sub>2</sub>O，面積 m<sup>2</sup>。", "水是 H_2O，面積 m^2。"),
        ("前 {{資訊框\n| 名稱 = 甲 {{小|乙}}\n| 值 = 3\n}} 後", "前 後"),
        ("複雜度為 $" + "a_{1}+" * 300 + "b^{2}$。", "複雜度為 " + "a_1+" * 300 + "b^2。"),
        ('<a data-id2="1" xlink:href="https://a.example/very/long/path/that/goes/on/and/on">甲</a>', "甲"),
    ],
)
def test_markup_goes(text, plain):
    got, found = clean(text, model())
    assert found > 0
    assert "".join(got.split()) == "".join(plain.split())
    assert clean(got, model())[1] == 0


@pytest.mark.parametrize("text", ["若使用率 < 89% 且 > 29% 則不列管。", "費用為 $ 669 元，押金 $343。", "#校園快訊 #第11期", "詳見附件[6]與[18]。", "檔案放在 D:\\share\\114\\docs 內。", "檔名為 report_final_v9_ok.pdf。", "信箱格式為 <學號>@mail.campus.example。", "主旨請寫 {系級}{姓名}。", "A -> B -> C 共 8 站，時間 1~8 週。", "判斷式 x == 1 時為真，a != b 時為假。", "計分方式為 2*9*2 分。", "需熟悉 C# 與 F# 其中一種。", "R&D 組與 Q&A 時段另行安排。", "- 名額 3 位\n5) 攜帶證件 3) 填寫表單", ""])
def test_what_only_looks_like_markup_stays(text):
    assert clean(text, model()) == (text, 0)


def test_code_keeps_its_marks_and_lines():
    text = "說明：\n```\nif a < b:\n    x = '<b>' + \"&amp;\"\n```\n再用 `a**b**` 與 <code>&lt;i&gt;</code>。"
    got, found = clean(text, model())
    assert found and "    if a < b:\n        x = '<b>' + \"&amp;\"" in got and "a**b**" in got and "<i>" in got and "```" not in got


def test_scanning_stays_linear():
    import time

    for text in ("{{" * 20_000, "$" + "a" * 200_000, "<" * 50_000, "<a " + "b " * 50_000, "[" * 50_000, "{{" + "{a}" * 50_000, "\\x" + "{a}" * 50_000):
        began = time.perf_counter()
        markup.parse(text)
        assert time.perf_counter() - began < 20


def test_the_model_is_kept(spark):
    first = markup.stored_model(spark, 60)
    markup._models.clear()
    x, _ = labelled(examples(20, seed=3))
    assert np.array_equal(first.log_probabilities(x), markup.stored_model(spark, 60).log_probabilities(x))


def test_labels_do_not_contradict():
    for text, _ in examples(200, seed=5):
        nodes = markup.parse(text)
        if nodes:
            markup.decode(nodes, model().log_probabilities(markup.features(text, nodes)))
        for n in nodes:
            if n.parent is not None and n.parent.label == markup.WASTE and not (n.partner is not None and n.partner.start < n.start):
                assert n.label == markup.WASTE


def test_clean_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>"), (2, None), (3, ""), (4, "plain"), (5, "<b>y</b>" * 2000), (6, "＜b＞z</b>")], "id int, t string")
    rows = {r.id: (r.clean_text, r.markup) for r in with_clean_text(df, "t").collect()}
    assert rows[1] == ("x", 2) and rows[2] == (None, 0) and rows[3] == ("", 0) and rows[4] == ("plain", 0) and rows[5][0] == "y" * 2000
    assert formula("\\(\\frac{a}{b_{12}}\\)") == "(a)/(b_(12))"


# ---- ranking


def plain_ranking(rows, q=(0.1, 0.9)):
    items = {}
    for hit, item, *scores in rows:
        first, best = items.get(item, (hit, [None] * len(scores)))
        ok = [s if s is not None and math.isfinite(s) and s != 0 else None for s in scores]
        items[item] = (min(first, hit), [max((x for x in p if x is not None), default=None) for p in zip(best, ok, strict=True)])
    columns = []
    for j in range(len(rows[0]) - 2):
        held = sorted(v[1][j] for v in items.values() if v[1][j] is not None)
        if not held:
            columns.append({})
            continue
        lo, hi = (held[max(0, math.ceil(p * len(held)) - 1)] for p in q)
        clipped = {i: min(max(v[1][j], lo), hi) - lo for i, v in items.items() if v[1][j] is not None}
        norm = math.sqrt(sum(x * x for x in clipped.values())) or 1
        columns.append({i: x / norm / (len(rows[0]) - 2) for i, x in clipped.items()})
    close = {}
    for i in items:
        has = [c for c in columns if i in c]
        up = math.sqrt(sum((max(c.values()) - c[i]) ** 2 for c in has) / len(has)) if has else 0
        down = math.sqrt(sum((c[i] - min(c.values())) ** 2 for c in has) / len(has)) if has else 0
        close[i] = 0 if not has else 0.5 if up + down == 0 else round(down / (up + down), 9)
    return {i: n for n, i in enumerate(sorted(items, key=lambda i: (-close[i], items[i][0])), 1)}


@pytest.mark.parametrize("hot", [50_000, 5])
def test_ranking_against_a_plain_one(spark, hot):
    rng = random.Random(2)
    score = lambda: rng.choice([None, 0.0, float("nan"), rng.gauss(0, 1), rng.lognormvariate(2, 3), 1.0])
    rows = [(n, f"i{rng.randrange(30)}", score(), score(), score()) for n in range(60)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 100, "x", None, None, None), (2, 101, None, 1.0, None, None), (2, 102, None, 1.0, None, None), (None, 200, "y", 1.0, 2.0, 3.0)], "query_id int, hit_id int, id string, a double, b double, c double")
    got = ideal_point_ranking(df, {"a": 1.0, "b": 1.0, "c": 1.0}, hot_rows=hot).collect()
    want = plain_ranking(rows)
    assert len(got) == df.count()
    assert {r.hit_id: r["rank"] for r in got if r.query_id == 1} == {h: want[i] for h, i, *_ in rows}
    assert {r.hit_id: r["rank"] for r in got if r.query_id == 2} == {101: 1, 102: 2, 100: 3}
    assert ideal_point_ranking(df.limit(0), {"a": 1.0}).count() == 0


def test_bounds_of_a_hot_query_are_exact(spark):
    hits = lambda q, n: spark.range(0, n, 1, 7).selectExpr(f"{q} AS query_id", "id AS hit_id", "concat('i', id) AS id", "double(id * 7919 % 300007 + 1) AS a")
    df = hits(1, 300_000).unionByName(hits(2, 10))
    got = ideal_point_ranking(df, {"a": 1.0}).groupBy("query_id").agg(F.count_if(F.col("closeness") == 0).alias("low"), F.count_if(F.col("closeness") == 1).alias("high")).collect()
    assert {tuple(r) for r in got} == {(1, 30_000, 30_001), (2, 1, 2)}


def test_no_score_rules_by_its_range(spark):
    rows = [(1, i, f"i{i}", float(i), 10_000.0 * ((i * 7) % 20)) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "query_id int, hit_id int, id string, a double, b double")
    scaled = df.withColumn("b", F.col("b") / 1e6 + 3)
    rank = lambda d: {r.hit_id: r["rank"] for r in ideal_point_ranking(d, {"a": 1.0, "b": 1.0}, zero_is_missing=False).collect()}
    assert rank(df) == rank(scaled)


# ---- leaks


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_leaks_against_brute_force(spark, most):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("甲乙丙丁戊己庚ABCdef12", k=n))
    items = [(i, word(rng.randrange(20, 60))) for i in range(12)] + [(12, None), (13, "")]
    docs = [(i, word(80)) for i in range(20)] + [(90, None), (91, ""), (92, items[0][1] * 3000)]
    for n in range(40):
        t = items[rng.randrange(12)][1]
        a, length = rng.randrange(5), rng.randrange(25, 40)
        docs.append((100 + n, word(20) + "，".join(t[a : a + length]).upper().replace("A", "Ａ").replace("E", "\u0415") + word(20)))
    docs.append(docs[-1])
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = codes.comparison_form(t or ""), codes.comparison_form(x or "")
            if any(b[j : j + 30] in a for j in range(len(b) - 29)):
                want.add((d, i))
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_text", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), most_item_chars=most).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    assert leaked_items(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), most_item_chars=most).count() == 0


def test_longest_run():
    a, b = codes.code_points("xxabcdefyy"), codes.code_points("zabcdefw")
    assert leaks.longest_run(a, 4, b, 3) == 6


# ---- spans


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("甲乙丙a ", k=n))
    shared = [word(n) for n in (19, 20, 21, 45, 90)]
    docs = [(i, word(rng.randrange(10, 80)) + rng.choice(shared) + word(30) + rng.choice(["", *shared])) for i in range(40)] + [(100, None), (101, ""), (102, word(15)), (103, "x" * 500), (104, "x" * 30), (105, shared[0] * 2)]
    windows = defaultdict(set)
    for i, t in docs:
        for j in range(len(t or "") - 19):
            windows[t[j : j + 20]].add(i)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in shared_spans(df, min_chars=20).collect()}
    for i, t in docs:
        marks = [False] * len(t or "")
        for j in range(len(t or "") - 19):
            if len(windows[t[j : j + 20]]) > 1:
                marks[j : j + 20] = [True] * 20
        edges = [(s.start, s.end) for s in got[i].spans]
        assert got[i].shared_chars == sum(marks) and all(all(marks[a:b]) for a, b in edges) and edges == sorted(edges)
    assert {r.doc_id for r in sharing_documents(df, min_chars=20).collect()} == {i for i, r in got.items() if r.shared_chars}
    assert shared_spans(df.limit(0)).count() == 0
    # A row that stands twice is one document.
    assert sharing_documents(spark.createDataFrame([(1, "y" * 200), (1, "y" * 200)], "doc_id long, text string")).count() == 0


def test_a_passage_of_all_documents_sends_one_witness_a_block():
    from quern.llm.spans import _counted

    out = _counted(np.array([7] * 1000, np.uint64), np.arange(1000), np.zeros(1000, np.int64))
    states = np.bincount(out.column(4).to_numpy(), minlength=3)
    assert states.tolist() == [0, 1000, 1]


# ---- mixture


def test_mixture_meets_its_targets(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda: "課程 text " * rng.randrange(5, 60)
    docs = [(i, rng.choices("abc", weights=[70, 25, 5])[0], text()) for i in range(1500)] + [(9000, "a", None), (9001, "a", " \n"), (9002, None, "x"), (9003, "other", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, None), ("c", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    sample = mixture(df, targets)
    report = {r.source: r for r in mixture_report(sample, targets).collect()}
    for s, share in (("a", 0.5 / 1.0), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s].actual_share - share) < 0.02, report
    assert report["absent"].tokens == 0
    most = {"a": 1, "b": 1, "c": 3}
    assert all(r["count"] <= most[r.source] for r in sample.groupBy("source", "doc_id").count().collect())
    assert report["c"].repeats > 1
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, mixture(df.repartition(7), targets).collect()))
    # However many slots are ranked in one task, the schedule is the same.
    monkeypatch.setattr(mixture_module, "RANKED", 7)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, mixture(df, targets).collect()))
    capped = mixture(df, targets, total_tokens=20_000).agg(F.sum("tokens")).first()[0]
    assert 15_000 < capped < 25_000
    assert mixture(df.limit(0), targets).count() == 0


def test_a_source_smaller_than_a_block_counts_by_its_size(spark):
    rows = [(i, "big", "課程 text " * 40) for i in range(400)] + [(1000, "small", "課程 text " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.99, 1), ("small", 0.01, 1000)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixture_report(mixture(df, targets), targets).collect()}
    assert abs(report["small"].actual_share - 0.01) < 0.003 and report["small"].repeats > 10
