"""The queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.timestamps import same_instant_pairs, with_instant
from quern.operators.units import FREQUENCY, MEMORY, off_reference, with_common_units
from quern.plans import catalogue, corpus_queries, instants_sql  # noqa: F401 - importing the catalogue registers its queries
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "clean_latest_news").select(F.lit("clean_latest_news").alias("table_name"), "rec_no", F.col("url").alias("key"), F.col("published_at").alias("raw"))
    courses = table(spark, sf_dir, "course_table_row").select(F.lit("course_table_row").alias("table_name"), "rec_no", F.col("checksum_clean").alias("key"), F.col("fetched_at").alias("raw"))
    return with_instant(news.unionByName(courses), "raw", F.col("table_name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_instant_pairs(_instants(spark, sf_dir), ["table_name", "key"], "rec_no").select("table_name", "rec_no_a", "rec_no_b")


def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).select("table_name", "rec_no", "raw", "instant")


#: The quantities of the product table and their kinds, and the reference's columns.
QUANTITIES = {"記憶體容量": "memory", "加速時脈": "frequency", "基礎時脈": "frequency"}
ACCEPTED = {"記憶體容量": "memory_mb", "加速時脈": "boost_mhz", "基礎時脈": "base_mhz"}


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_common_units(table(spark, sf_dir, "products_20250808_193341"), QUANTITIES, "id", "product_name", "remark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return off_reference(_quantities(spark, sf_dir), table(spark, sf_dir, "product_reference"), "product_name", ACCEPTED).select("id", "field_name")


def p5_common_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantities(spark, sf_dir).select("id", "product_name", "field_name", "raw", "value", "factor", "common_value")


def _p5_sql() -> str:
    """Units and notations of the product table, field by field; NFKC matters to digits and Latin letters alone there."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    clean = lambda c: f"trim(translate(coalesce({c}, ''), '{wide}', '{plain}'))"
    sizes = {"memory": {k: v / 2**20 for k, v in MEMORY.items()}, "frequency": {k: v / 1e6 for k, v in FREQUENCY.items()}}
    parts = []
    for field, kind in QUANTITIES.items():
        units = "|".join(sorted(sizes[kind], key=len, reverse=True))
        size = lambda u, kind=kind: "CASE " + " ".join(f"WHEN {u} = '{name}' THEN {v!r}" for name, v in sizes[kind].items()) + " END"
        fold = (lambda u: u) if kind == "memory" else (lambda u: f"replace(lower({u}), '茲', '')")
        flag = "" if kind == "memory" else "(?i)"
        parts.append(rf"""
        SELECT id, '{field}' AS field_name, accepted, min(CASE WHEN n IS NULL THEN NULL WHEN abs(v / accepted - 1) > 0.005 THEN 1 ELSE 0 END) AS off FROM (
            SELECT id, accepted, n, CASE WHEN regexp_full_match(n, '[1-9]\d{{0,2}}([, ]\d{{3}})+(\.\d+)?') THEN replace(replace(n, ',', ''), ' ', '') ELSE replace(n, ',', '.') END::DOUBLE
                * coalesce(nullif(k, '')::INT, 1) * {size(fold("coalesce(nullif(u, ''), last_unit, remark_unit)"))} AS v
            FROM (SELECT id, accepted, remark_unit, last_unit, nullif(regexp_extract(p, '{flag}^(?:(\d+)\s*[x×*]\s*)?(\d{{1,3}}(?:[, ]\d{{3}})+(?:\.\d+)?|\d+(?:[.,]\d+)?(?:e[+-]?\d+)?)\s*({units})?茲?$', 2), '') AS n,
                    regexp_extract(p, '{flag}^(\d+)\s*[x×*]', 1) AS k, regexp_extract(p, '{flag}({units})茲?$', 1) AS u
                FROM (SELECT id, accepted, remark_unit, nullif(regexp_extract(whole, '{flag}({units})茲?$', 1), '') AS last_unit, trim(unnest(string_split(whole, '/'))) AS p
                    FROM (SELECT id, {ACCEPTED[field]} AS accepted, trim(regexp_replace(regexp_replace({clean('"' + field + '"')}, '^(大?約|~|≈)\s*', ''), '\s*(L?P?G?DDR\d?\w*|HBM\w*)', '', 'g')) AS whole,
                        nullif(regexp_extract({clean("remark")}, '{flag}{field}\s*(?:的?單位)?\s*(?:為|是|以|用|採|in|:|=|\()?\s*({units})', 1), '') AS remark_unit
                        FROM products_20250808_193341 JOIN product_reference USING (product_name)))))
        WHERE v IS NOT NULL AND v > 0 GROUP BY id, accepted""")
    return "SELECT id, field_name FROM (" + " UNION ALL ".join(parts) + ") WHERE off = 1"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p3_found, p3_instants, p5_found, p5_common_units)} | corpus_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p3_found": instants_sql.PAIRS, "p3_instants": instants_sql.ROWS, "p5_found": _p5_sql()} | corpus_queries.SQL
