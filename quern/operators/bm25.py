"""A full-text index as tables, and BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import stored

K1, B = 1.2, 0.75
#: Folders of a stored index, by the hash of a term; a search reads those of its terms.
TERM_FOLDERS = 64
#: A term of a third and more of all rows has no positive weight; it gets this one.
LEAST_IDF = 1e-6
FIELDS = ("title", "text", "url", "published_at", "doc_id", "chunk_id", "type", "site_slug")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case. A run of Han characters is one token."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sanitized(query: Column) -> Column:
    """A query without the signs that full-text engines read as operators."""
    return F.regexp_replace(query, r"[\"'?*():]", " ")


@dataclass
class FullTextIndex:
    """postings (term, id, tf), lengths (id, length) and one row of statistics (n, mean)."""

    postings: DataFrame
    lengths: DataFrame
    statistics: DataFrame
    parted: bool = False

    @classmethod
    def build(cls, rows: DataFrame, id: str = "chunk_id", fields: tuple[str, ...] = FIELDS) -> FullTextIndex:
        """Over the fields that ``rows`` has; null is empty, blank rows count with length 0. One row an id (upsert first)."""
        held = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields if f in rows.columns]
        words = rows.select(F.col(f"`{id}`").alias("id"), tokens(F.concat_ws(" ", *held)).alias("tokens"))
        lengths = words.select("id", F.size("tokens").alias("length"))
        postings = words.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
        return cls(postings, lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")))

    @staticmethod
    def _folder(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(TERM_FOLDERS)).cast("int")

    def write(self, path: str) -> None:
        """Postings with their rows' lengths, parted by the hash of their terms and sorted by term; lengths; statistics."""
        whole = self.postings.join(self.lengths, "id").withColumn("folder", self._folder(F.col("term")))
        whole.repartition("folder", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(8))).sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FullTextIndex:
        """An index that ``write`` stored; searching it reads no text."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "statistics")), parted=True)

    def search(self, queries: DataFrame, k: int = 50, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(``query_id``, id, score, rank): the k best rows of each query that hold all its terms; smaller scores are better.

        Only the postings of the queries' terms take part. A query meets the rows of its rarest term first and looks its
        other terms up in those alone, so a hot term that many queries share costs no more than their rarest ones do. A
        query without terms, or with a term that no row holds, has no rows. Scores are ranked by 9 digits, ties by id.
        """
        asked = queries.select(F.col(query_id).alias("q"), F.explode(tokens(sanitized(F.col(query)))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
        terms = asked.groupBy("q").agg(F.count(F.lit(1)).alias("terms"))
        postings = self.postings
        if self.parted:
            asked = stored(asked, "terms")
            folders = [r[0] for r in asked.select(self._folder(F.col("term"))).distinct().collect()]
            postings = postings.where(F.col("folder").isin(folders)).drop("folder")
        held = stored(postings.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
        spread = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        priced = stored(asked.join(spread, "term"), "asked")
        rarest = priced.groupBy("q").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("known")).join(terms, "q").where("known = terms")
        open_ = held.join(rarest, "term").select("q", "id", "terms")
        hits = open_.join(priced, "q").join(held, ["term", "id"])
        # A stored index keeps a row's length beside each of its postings.
        hits = hits if "length" in held.columns else hits.join(self.lengths, "id")
        whole = self.statistics.first()
        raw = F.log((F.lit(whole["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        idf = F.when(raw > 0, raw).otherwise(LEAST_IDF)
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(whole["mean"] or 1.0)))
        scored = hits.groupBy("q", "id", "terms").agg((-F.sum(weight * F.col("times"))).alias("score"), F.count(F.lit(1)).alias("met")).where("met = terms")
        w = Window.partitionBy("q").orderBy(F.round("score", 9), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), "id", "score", "rank")


def similarity(score: Column, compat: bool = False) -> Column:
    """A BM25 score, smaller is better, as a similarity: s / (1 + s) of its size, or 1 / (1 + score) with ``compat``."""
    return F.lit(1.0) / (1 + score) if compat else -score / (1 - score)
