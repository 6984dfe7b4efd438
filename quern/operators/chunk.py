"""Documents into overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import chunk_id, strip


def sentences(text: Column) -> Column:
    """Sentences: after 。！？!?；; and at line ends; trimmed, blanks dropped. A full stop of ASCII ends none."""
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.filter(F.transform(F.split(lines, r"(?<=[。！？!?；;])|\n+|<S>"), strip), lambda s: s != "")


def hard_slices(text: Column, target: int, overlap: int) -> Column:
    """Slices of ``target`` characters, each beginning ``overlap`` before the end of the last."""
    step = target - overlap if 0 <= overlap < target else target
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - target) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(target)))


def chunks(text: Column, target: int = 1000, overlap: int = 150, zero_overlap_repeats: bool = False) -> Column:
    """Sentences packed greedily to ``target`` characters; a new chunk begins with the last ``overlap`` of the one before.

    A sentence longer than ``target`` is sliced and carries nothing over. The carried tail does not count against the
    target, so a chunk has at most target + overlap + 1 characters. ``zero_overlap_repeats``: with overlap 0 carry the
    whole chunk, as engines do that slice from minus zero.
    """
    state = T.StructType([T.StructField("open", T.StringType()), T.StructField("done", T.ArrayType(T.StringType()))])
    as_state = lambda o, d: F.struct(o.alias("open"), d.alias("done")).cast(state)
    flush = lambda done, o: F.when(strip(o) == "", done).otherwise(F.concat(done, F.array(strip(o))))

    def tail(o: Column) -> Column:
        if overlap <= 0:
            return strip(o) if zero_overlap_repeats else F.lit("")
        return F.right(strip(o), F.lit(overlap))

    def step(a: Column, s: Column) -> Column:
        o, done = a["open"], a["done"]
        long = as_state(F.lit(""), F.concat(flush(done, o), F.transform(hard_slices(s, target, overlap), strip)))
        first = as_state(s, done)
        fits = as_state(F.concat(o, F.lit("\n"), s), done)
        full = as_state(F.concat(tail(o), F.lit("\n"), s), F.concat(done, F.array(strip(o))))
        return F.when(F.length(s) > target, long).when(o == "", first).when(F.length(o) + 1 + F.length(s) <= target, fits).otherwise(full)

    return F.aggregate(sentences(text), as_state(F.lit(""), F.array().cast("array<string>")), step, lambda a: flush(a["done"], a["open"]))


def chunk_documents(docs: DataFrame, target: int = 1000, overlap: int = 150, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with chunk_index, chunk_text and chunk_id, a row a chunk; a blank document is one empty chunk."""
    parts = docs.select("*", F.posexplode_outer(chunks(F.col(text), target, overlap)).alias("chunk_index", "chunk_text"))
    parts = parts.withColumns({"chunk_index": F.coalesce("chunk_index", F.lit(0)), "chunk_text": F.coalesce("chunk_text", F.lit(""))})
    return parts.withColumn("chunk_id", chunk_id(F.col(doc_id), F.col("chunk_text")))


def chunk_records(docs: DataFrame, target: int = 1000, overlap: int = 150) -> DataFrame:
    """Clean documents as nested chunk records: doc_id, chunk_id, type, text and meta."""
    meta = F.struct("title", "url", "published_at", "checksum", F.col("chunk_index").cast("int").alias("chunk_index"))
    return chunk_documents(docs, target, overlap).select("doc_id", "chunk_id", F.lit("text").alias("type"), F.col("chunk_text").alias("text"), meta.alias("meta"))


def split_recursively(text: str, size: int = 1000, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Cut at the coarsest separator that occurs, pieces keeping it in front; short ones are merged, long ones cut again."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        head, *rest = text.split(mark)
        pieces = [p for p in (head, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += split_recursively(piece, size, overlap, finer) if finer else [piece]
    return out + _merged(short, size, overlap)


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            if joined := "".join(window).strip():
                out.append(joined)
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    joined = "".join(window).strip()
    return [*out, joined] if joined else out


def recursive_chunks(size: int = 1000, overlap: int = 100):
    """A column function: the pieces of ``split_recursively``; null gives none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return run
