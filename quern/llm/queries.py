"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracles
from quern.llm.canonical import with_canonical
from quern.llm.history import keyed, repeated_rows
from quern.llm.leaks import leaked_items
from quern.llm.markup import with_clean_text
from quern.llm.mixture import mixture, mixture_report
from quern.llm.ranking import ideal_point_ranking
from quern.llm.spans import shared_spans, sharing_documents
from quern.llm.vptree import most_similar, similar_pairs
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: The weights of the three scores of a hit, chosen by the grades of one table and confirmed on another.
SCORE_WEIGHTS = {"vec_sim": 1.0, "bm25_sim": 0.5, "rr_score": 1.0}


def _canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "course_table_row").select(F.lit("course_table_row").alias("table_name"), "rec_no", F.col("course_name").alias("value"))
    news = table(spark, sf_dir, "clean_latest_news").select(F.lit("clean_latest_news").alias("table_name"), "rec_no", F.col("text").alias("value"))
    return with_canonical(courses.unionByName(news), "value")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_rows(spark, sf_dir).where(F.col("odd") != 0).select("table_name", "rec_no")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical_rows(spark, sf_dir).select("table_name", "rec_no", "canonical", "odd")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, exact, fuzzy in (("course_table_row", ["semester", "category", "sub_category", "credit"], "course_name"), ("department_member_row", ["person_name", "phone", "email", "office"], "metadata")):
        parts.append(keyed(table(spark, sf_dir, name), F.lit(name), "rec_no", "text", exact, fuzzy, ("batch_no",)))
    found = repeated_rows(parts[0].unionByName(parts[1]))
    return found.select(F.col("source").alias("table_name"), F.col("row").alias("rec_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding").select("vec_id_a", "vec_id_b")


def p4_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding")


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact neighbours that the relaxed search finds, over the same queries."""
    vectors = table(spark, sf_dir, "chunk_vectors")
    exact = most_similar(vectors, "vec_id", "embedding", factor=1.0).select("vec_id", "other")
    found = most_similar(vectors, "vec_id", "embedding").select("vec_id", "other", F.lit(1).alias("hit"))
    return exact.join(found, ["vec_id", "other"], "left").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clean_text(table(spark, sf_dir, "clean_latest_news").select("rec_no", "text"), "text").where(F.col("markup") > 0).select("rec_no")


def p6_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_clean_text(table(spark, sf_dir, "clean_latest_news").select("rec_no", "text"), "text").select("rec_no", "clean_text", "markup")


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideal_point_ranking(table(spark, sf_dir, "search_hits"), SCORE_WEIGHTS).select("query_id", "hit_id", "rank")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixture_report(mixture(table(spark, sf_dir, "documents"), targets), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_documents(table(spark, sf_dir, "documents"))


def p10_shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


_P4 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM chunk_vectors
  WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b
FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
"""

_P10 = """
WITH w AS (
  SELECT doc_id, substring(text, i, 120) AS span
  FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 119)) AS i FROM documents WHERE length(text) >= 120)
)
SELECT DISTINCT doc_id FROM w WHERE span IN (SELECT span FROM w GROUP BY span HAVING count(DISTINCT doc_id) > 1)
"""

_P7 = """
WITH rows AS (
  SELECT query_id, hit_id, id, {usable} FROM search_hits
), items AS (
  SELECT query_id, id, min(hit_id) AS first, {best} FROM rows GROUP BY query_id, id
), bounds AS (
  SELECT query_id AS bq, {bounds} FROM items GROUP BY query_id
), clipped AS (
  SELECT query_id, id, first, {clipped} FROM items JOIN bounds ON query_id = bq
), norms AS (
  SELECT query_id AS nq, {norms} FROM clipped GROUP BY query_id
), far AS (
  SELECT query_id, id, first, {has} AS has, {to_best} AS best, {to_worst} AS worst FROM clipped JOIN norms ON query_id = nq
), closed AS (
  SELECT query_id, id, first,
         CASE WHEN has = 0 THEN 0 WHEN best + worst = 0 THEN 0.5
              ELSE round(sqrt(worst / has) / (sqrt(best / has) + sqrt(worst / has)), 9) END AS closeness
  FROM far
), ranked AS (
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, first) AS rank FROM closed
)
SELECT query_id, hit_id, rank FROM rows JOIN ranked USING (query_id, id)
""".format(
    **{
        k: sep.join(f.format(n, w / sum(SCORE_WEIGHTS.values())) for n, w in SCORE_WEIGHTS.items())
        for k, sep, f in (
            ("usable", ", ", "nullif(CASE WHEN isfinite({0}) THEN {0} END, 0) AS {0}"),
            ("best", ", ", "max({0}) AS {0}"),
            ("bounds", ", ", "quantile_disc({0}, 0.1) AS {0}_l, quantile_disc({0}, 0.9) AS {0}_h"),
            ("clipped", ", ", "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, {0}_l), {0}_h) - {0}_l END AS {0}"),
            ("norms", ", ", "nullif(sqrt(sum({0} * {0})), 0) AS {0}_n, max({0}) AS {0}_max, min({0}) AS {0}_min"),
            ("has", " + ", "({0} IS NOT NULL)::INT"),
            ("to_best", " + ", "coalesce(power(({0}_max - {0}) * ({1} / coalesce({0}_n, 1)), 2), 0)"),
            ("to_worst", " + ", "coalesce(power(({0} - {0}_min) * ({1} / coalesce({0}_n, 1)), 2), 0)"),
        )
    }
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p4_found, p4_most_similar, p4_recall, p6_found, p6_clean_text, p7_ranking, p8_found, p9_mixture, p9_shares, p10_found, p10_shared_spans)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": oracles.p1_found(), "p2_found": oracles.p2_found(), "p4_found": _P4, "p7_ranking": _P7, "p8_found": oracles.p8_found(), "p10_found": _P10}
