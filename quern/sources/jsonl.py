"""JSON-lines records with keys of several spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import first_filled, joined, strip
from quern.operators.dedup import imported_identity, keep_first

# The spellings of each field, in the order in which a filled one counts.
ALIASES = {
    "title": ("title", "標題"),
    "url": ("url", "連結", "pdf_url"),
    "published_at": ("published_at", "發布時間"),
    "html_text": ("html_text", "source_html_text", "內文"),
    "pdf_text": ("pdf_text", "source_pdf_text", "pdf內容"),
}
OTHERS = ("text", "row_text", "type", "doc_id", "checksum", "checksum_clean", "semester", "category", "sub_category", "course_name", "site_slug")
SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in dict.fromkeys([*(a for names in ALIASES.values() for a in names), *OTHERS])), T.StructField("credit", T.StringType()), T.StructField("_broken", T.StringType())])
TABLE_TYPES = ("course_table_row", "table_row")


def read_json_lines(spark: SparkSession, paths: list[str], schema: T.StructType = SCHEMA) -> DataFrame:
    """The records with ``file`` and ``line``, their order; blank and broken lines are skipped. No schema is inferred."""
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").json(paths)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"))
    return rows.where(F.col("_broken").isNull()).drop("_broken")


def normalized(records: DataFrame, prefix: str | None = None) -> DataFrame:
    """Records as documents: doc_id, title, url, published_at, html_text, pdf_text, text, checksum; the first of a checksum stays.

    The text is what the record brings; else, for table rows, row_text or the fields joined; else the HTML and PDF texts.
    prefix: a column with a sentence to stand before the text.
    """
    has = lambda c: c in records.columns
    column = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    fields = {name: first_filled(*(column(a) for a in spellings)) for name, spellings in ALIASES.items()}
    credit = F.when(column("credit").isNotNull(), F.concat(column("credit"), F.lit(" 學分")))
    from_fields = joined([*(column(c) for c in ("semester", "category", "sub_category", "course_name")), credit])
    rows = records.withColumns({k: v for k, v in fields.items()} | {"__table": F.when(column("type").isin(*TABLE_TYPES), F.coalesce(F.nullif(column("row_text"), F.lit("")), from_fields))})
    both = strip(F.concat(strip(F.col("html_text")), F.lit("\n\n"), strip(F.col("pdf_text"))))
    rows = rows.withColumn("text", F.coalesce(F.nullif(column("text"), F.lit("")), F.nullif("__table", F.lit("")), both))
    if prefix:
        before = F.nullif(F.col(prefix), F.lit(""))
        rows = rows.withColumn("text", F.when(before.isNull(), F.col("text")).otherwise(F.concat_ws("\n", before, F.nullif("text", F.lit("")))))
    rows = rows.withColumns({c: column(c) for c in ("doc_id", "checksum", "checksum_clean")})
    order = [c for c in ("file", "line") if has(c)] or ["doc_id"]
    return keep_first(imported_identity(rows), ["checksum"], order).select("doc_id", *fields, "text", "checksum")
