"""Identity, keep-first distinct, upserts and seen-sets. Every keep-first names the order that makes a row the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import checksum, sha1_of


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. One aggregate with partial results in the map tasks, so a hot key is no hot task."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = df.groupBy(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def imported_identity(df: DataFrame) -> DataFrame:
    """doc_id and checksum of imported rows: what they bring, or else the checksum of title, url, time and text."""
    has = lambda c: F.nullif(F.col(c), F.lit(""))
    doc, own = F.coalesce(has("doc_id"), has("checksum")), F.coalesce(has("checksum"), has("checksum_clean"))
    made = checksum(F.col("title"), F.col("url"), F.col("published_at"), F.col("text"))
    known = F.when(doc.isNotNull() & own.isNotNull(), own).otherwise(made)
    return df.withColumns({"checksum": known, "doc_id": F.coalesce(doc, known)})


def existing_checksums(df: DataFrame, hash_missing_text: bool = True) -> DataFrame:
    """The checksums of stored rows; rows of old that have none get that of their text.

    hash_missing_text: whether a row without text counts as one of the empty text or not at all.
    """
    text = F.col("text") if not hash_missing_text else F.coalesce("text", F.lit(""))
    return df.select(F.coalesce(F.nullif("checksum_clean", F.lit("")), F.when(text.isNotNull(), sha1_of(text))).alias("checksum_clean")).where("checksum_clean IS NOT NULL").distinct()


def unseen(batch: DataFrame, seen: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first rows of ``batch`` of keys that ``seen`` lacks."""
    return keep_first(batch.join(seen.select(key).distinct(), key, "left_anti").select(*batch.columns), [key], order)


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; the last of ``new`` by ``order`` wins."""
    last = keep_last(new, [key], order)
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """``upsert`` into the Parquet table at ``path``: a new version beside it, then one rename.

    A job that dies leaves the old version readable.
    """
    fs, at = _file_system(spark, path)
    target, fresh, old = at(path), at(f"{path}.new"), at(f"{path}.old")
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
    merged = upsert(spark.read.parquet(path), new, key, order) if fs.exists(target) else keep_last(new, [key], order)
    merged.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
    return spark.read.parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at(path), True)


def _file_system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def best_of_group(df: DataFrame, group: list[str], score: Column, order: list[str]) -> DataFrame:
    """The row of the highest score in each group, the first by ``order`` on a tie, and ``first_place``: where the group began."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    best = F.min_by(row, F.struct((-score).alias("__score"), *order)).alias("__row")
    return df.groupBy(*(F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group))).agg(best, F.min(F.struct(*order)).alias("first_place")).select("__row.*", "first_place")
