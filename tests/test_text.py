import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.records import flattened, rendered


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (tx.minguo_dates, "自113年8月8日至 114 年 12 月 1 日", "自2024-08-08至 2025-12-01"),
        (tx.minguo_dates, "2113年1月1日", "22024-01-01"),
        (tx.minguo_dates, "99年1月1日", "99年1月1日"),
        (tx.minguo_dates, "1１３年８月８日", "2024-08-08"),
        (tx.minguo_dates, None, None),
        (tx.normalize_bullet, "1. foo", "- foo"),
        (tx.normalize_bullet, "3、x", "- x"),
        (tx.normalize_bullet, "(1) a", "- a"),
        (tx.normalize_bullet, "a) b", "- b"),
        (tx.normalize_bullet, "  • 項目", "- 項目"),
        (tx.normalize_bullet, "1.5 GHz", "- 5 GHz"),
        (tx.normalize_bullet, "甲、乙", "- 乙"),
        (tx.normalize_bullet, "ABC", "ABC"),
        (tx.normalize_bullet, "2025-01-01", "2025-01-01"),
        (tx.normalize_space, "a\xa0\t b\n\n\n\nc ", "a b\n\nc"),
        (tx.normalize_space, None, ""),
        (tx.semester_name, "一上", "大一上學期"),
        (tx.semester_name, "五上", "五上"),
        (tx.email_of, "Mail: x.y@z.org (office)", "x.y@z.org"),
        (tx.email_of, "none", "none"),
        (tx.collapse, " a　\xa0b\n", "a b"),
        (tx.strip_html, "a<br>b<!-- c --><script>x</script><p>d &amp; e</p>", "a\nb\nd & e"),
        (tx.strip_html, None, ""),
        (tx.nfkc, "ＡＢ①", "AB1"),
        (tx.fix_lines, "１. Ｘ\n\n  y  z", "- X\n\ny z"),
        (tx.iso8601_taipei, "113.03.27", "2024-03-27T00:00:00+08:00"),
        (tx.iso8601_taipei, "2024-03-27T00:00:00Z", "2024-03-27T08:00:00+08:00"),
        (tx.iso8601_taipei, "nothing", None),
        (tx.score_text, "x", "NA"),
        (tx.score_text, "0.12345", "0.123"),
        (tx.base_name, "/a/b/c.d.jsonl", "c.d"),
    ],
)
def test_golden(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_checksum_has_no_separator(spark):
    row = spark.sql("SELECT 'a' a, CAST(NULL AS STRING) n, 'b' b").select(tx.checksum(F.col("a"), F.col("n"), F.col("b")).alias("c")).first()
    assert row.c == "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"


def test_joined(spark):
    df = spark.sql("SELECT 'A' a, '' b, 'c@d.ef' c, ' ' d, 'm' e")
    assert df.select(tx.joined([F.col(x) for x in "abcde"]).alias("j")).first().j == "A｜c@d.ef｜m"


def test_sentence_and_its_check(spark):
    df = spark.sql("SELECT 'course_table_row' k, 'T' t, '一上' s, '必修' c, CAST(NULL AS STRING) u, '物理' n, 3 r")
    cols = [F.col(x) for x in "scunr"]
    made = df.select(tx.record_sentence(F.col("k"), F.col("t"), *cols).alias("x"), "*")
    row = made.select("x", tx.sentence_keeps_fields(F.col("x"), *cols).alias("ok"), tx.sentence_keeps_fields(F.lit("物理"), *cols).alias("bad")).first()
    assert row.x == "T，在大一上學期，屬於必修，課程名稱為「物理」，學分數為 3 學分。"
    assert row.ok and not row.bad


def test_flatten_keeps_order_and_drops_empty():
    assert flattened({"a": {"b": [1, {"c": None}]}, "e": []}) == [("a.b[0]", 1), ("a.b[1].c", None)]
    assert rendered('{"b": 1}\n\nx\n{"a": 2}') == '{"b": 1}\n\nx\n{"a": 2}'
    assert rendered('{"b": 1}\n{"a": [2]}\nbroken\n{"c": 3}') == '{"b": 1}\n{"a": [2]}\nbroken\n{"c": 3}'
    lines = "\n".join('{"a": %d}' % i for i in range(6))
    assert rendered(lines + "\nbroken\n" + '{"z": 1}').endswith("--- RECORD 8 ---\nz: 1")
    assert rendered('[{"a": 1}, 2]') == "--- ITEM 1 ---\na: 1\n\n--- ITEM 2 ---\n: 2"
    assert rendered("plain") == "plain"
