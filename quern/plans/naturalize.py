"""A sentence for each record: a kept one, else a model's if it loses nothing, else one made by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import checksum, record_sentence, sentence_keeps_fields, strip
from quern.operators.dedup import keep_last
from quern.providers import Generator, SilentGenerator, generated

TYPES = ("course_table_row", "table_row", "department_member_row")
RULES = "把欄位寫成一句正式的繁體中文。只用給定的資訊，數字與名稱照抄，缺少的欄位略過，只輸出一句。"
_FIELDS = ("semester", "category", "sub_category", "course_name", "credit")


def load_cache(lines: DataFrame) -> DataFrame:
    """(key, text) of a table (key, text, seq); the last entry of a key counts."""
    return keep_last(lines.where("key IS NOT NULL AND text IS NOT NULL"), ["key"], ["seq"]).select("key", "text")


def cache_key(df: DataFrame):
    own = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("checksum", "checksum_clean") if c in df.columns), F.lit(None).cast("string"))
    return F.coalesce(own, checksum(F.col("title"), F.col("url"), F.col("published_at"), F.to_json(F.struct("*"))))


def with_sentence(records: DataFrame, cache: DataFrame | None = None, generator: Generator | None = None) -> tuple[DataFrame, DataFrame]:
    """``records`` with ``sentence``, and the new cache entries (key, text). Only records the cache lacks reach the model."""
    keyed = records.withColumn("__key", F.when(F.col("type").isin(*TYPES), cache_key(records)))
    known = (cache if cache is not None else records.sparkSession.createDataFrame([], "key string, text string")).select(F.col("key").alias("__key"), F.col("text").alias("__kept"))
    met = keyed.join(known, "__key", "left")
    ask = F.when(F.col("__key").isNotNull() & F.col("__kept").isNull(), F.array(F.struct(F.lit("system").alias("role"), F.lit(RULES).alias("content")), F.struct(F.lit("user").alias("role"), F.to_json(F.struct(*(c for c in records.columns))).alias("content"))))
    said = generated(met.withColumn("__ask", ask), generator or SilentGenerator(), "__ask", "__said")
    line = strip(F.regexp_replace(F.get(F.split(F.coalesce("__said", F.lit("")), "\n"), F.lit(0)), "^[「」\"' ]+|[「」\"' ]+$", ""))
    line = F.when((line != "") & ~F.endswith(line, F.lit("。")), F.concat(line, F.lit("。"))).otherwise(line)
    fields = [F.col(c) for c in _FIELDS]
    rule = record_sentence(F.col("type"), F.col("title"), *fields)
    made = F.when(sentence_keeps_fields(line, *fields), line).otherwise(rule)
    out = said.withColumn("sentence", F.when(F.col("__key").isNull(), "").otherwise(F.coalesce("__kept", made)))
    entries = out.where("__key IS NOT NULL AND __kept IS NULL AND sentence <> ''").select(F.col("__key").alias("key"), F.col("sentence").alias("text"))
    return out.select(*records.columns, "sentence"), entries
