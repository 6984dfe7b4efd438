"""Hybrid retrieval for a whole table of queries at once: merge, recency, best chunk per document, rerank, cut, gate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.dedup import best_of_group
from quern.providers import Reranker, with_scores

# Words that are small talk and no question.
SMALL_TALK = ("你好", "嗨", "哈囉", "在嗎", "謝謝", "掰掰", "晚安", "早安", "hi", "hello", "bye", "thanks")
VECTOR_WEIGHT, TEXT_WEIGHT = 0.6, 0.4
LEAST_SCORE = 0.2


def asks_for_information(query: Column) -> Column:
    """Whether a text is to be answered from the corpus: all but blank and small talk."""
    q = strip(F.coalesce(query, F.lit("")))
    return (q != "") & ~F.lower(q).isin(*SMALL_TALK)


def merge_hits(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """(query_id, id, doc, meta, vec_sim, bm25_sim, place): one row a query and id.

    Both sides: query_id, id, doc, meta, their score (vec_sim, bm25_sim) and place, their order from 1. A missing score is
    0 and so is a negative one, repeats count with their best; the vector side's doc and meta stand; vector hits come
    first. One aggregate over the union, so a hit on one side needs no partner.
    """
    sides = vector_hits.select("query_id", "id", "doc", "meta", "vec_sim", F.lit(None).cast("double").alias("bm25_sim"), F.struct(F.lit(0).alias("side"), F.col("place").cast("long").alias("at")).alias("place"))
    sides = sides.unionByName(text_hits.select("query_id", "id", "doc", "meta", F.lit(None).cast("double").alias("vec_sim"), "bm25_sim", F.struct(F.lit(1).alias("side"), F.col("place").cast("long").alias("at")).alias("place")))
    best = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0)).alias(c)
    return sides.groupBy("query_id", "id").agg(F.min_by("doc", "place").alias("doc"), F.min_by("meta", "place").alias("meta"), best("vec_sim"), best("bm25_sim"), F.min("place").alias("place"))


def recent(published_at: Column, days: int | None, now: datetime | Column) -> Column:
    """Whether a time lies within the last ``days``; texts that are no time, or have no zone, always do."""
    if not days:
        return F.lit(True)
    now = now if isinstance(now, Column) else F.lit(now)
    zoned = F.coalesce(published_at, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(F.when(zoned, F.try_to_timestamp(published_at) >= now - F.make_interval(days=F.lit(days))), F.lit(True))


def document_key(meta: Column, id: Column) -> Column:
    """What makes two hits the same document: doc_id, else checksum, else url, else the hit's own id."""
    filled = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    return F.coalesce(filled("doc_id"), filled("checksum"), filled("url"), id)


def best_per_document(merged: DataFrame) -> DataFrame:
    """The best chunk of each document of a query by 0.6 vec_sim + 0.4 bm25_sim; ``place`` is where the document came first."""
    heuristic = VECTOR_WEIGHT * F.col("vec_sim") + TEXT_WEIGHT * F.col("bm25_sim")
    keyed = merged.withColumn("document", document_key(F.col("meta"), F.col("id")))
    return best_of_group(keyed, ["query_id", "document"], heuristic, ["place"]).withColumn("place", F.col("first_place.place")).drop("first_place")


def top_hits(hits: DataFrame, k: int, score: str = "rr_score") -> DataFrame:
    """The k best hits of each query, numbered from 1; ties keep their order of ``place``."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "place")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gated(top: DataFrame, least: float = LEAST_SCORE, score: str = "rr_score") -> DataFrame:
    """The hits of queries whose best score reaches ``least``."""
    return top.withColumn("__best", F.max(score).over(Window.partitionBy("query_id"))).where(F.col("__best") >= least).drop("__best")


def hybrid_search(queries: DataFrame, vector_hits: DataFrame, text_hits: DataFrame | None, reranker: Reranker, top_k: int = 5, recent_days: int | None = None, now: datetime | None = None) -> DataFrame:
    """The reranked hits of every query: merge, recency (after the pools are cut), best per document, rerank, cut.

    queries: query_id, query. The scorer stands above the pools, so it sees their rows only.
    """
    text_hits = vector_hits.select("query_id", "id", "doc", "meta", F.col("vec_sim").alias("bm25_sim"), "place").limit(0) if text_hits is None else text_hits
    merged = merge_hits(vector_hits.where(strip(F.coalesce("doc", F.lit(""))) != ""), text_hits)
    kept = merged.where(recent(F.try_element_at("meta", F.lit("published_at")), recent_days, now or F.current_timestamp()))
    pairs = best_per_document(kept).join(queries.select("query_id", "query"), "query_id")
    return top_hits(with_scores(pairs, reranker, "query", "doc", "rr_score"), top_k)
