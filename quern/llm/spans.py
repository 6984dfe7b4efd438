"""Spans of at least a given length that stand verbatim in more than one record.

Two passes of Rabin-Karp hashes, counted in Spark. The first hashes every window of ``min_chars`` / 2 characters and
counts the winnowed ones; every span of ``min_chars`` holds a winnowed window, so a span that is shared has one that
repeats. The second counts every window of ``min_chars`` characters around the repeated ones; repeated windows merge
into maximal intervals. Counting all windows at once gives the same intervals and would shuffle ten times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.codes import Rolling, blocks, code_points, mix, winnow
from quern.session import stored

_ASK, _KNOWN, _WITNESS = 0, 1, 2
_COUNTED = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("state", T.ByteType())])
#: Bits of the filter of documents worth reading again; its size is fixed, so at most 1 MB is broadcast.
_BITS = 1 << 22


def _counted(hashes: np.ndarray, docs: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Windows of one block, counted within it first.

    A window held by two documents of the block is known to repeat: it goes on as a run that asks nothing, and one witness
    per hash stands for it in the count. So a passage of very many records sends one row a block, not one a record.
    """
    order = np.argsort(hashes, kind="stable")
    h, d, a = hashes[order], docs[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(h) else np.empty(0, bool)
    known = np.repeat(many, np.diff(np.append(first, len(h))))
    kd, ka = d[known], a[known]
    order = np.lexsort((ka, kd))
    kd, ka = kd[order], ka[order]
    begins = np.flatnonzero(np.concatenate([[True], (kd[1:] != kd[:-1]) | (ka[1:] != ka[:-1] + 1)])) if len(kd) else np.empty(0, np.int64)
    runs = np.diff(np.append(begins, len(kd)))
    rd, ra, seen = kd[begins], ka[begins], first[many]
    scattered = mix(rd.view(np.uint64) ^ mix(ra.astype(np.uint64)))
    ask = ~known
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[ask], scattered, h[seen]]).view(np.int64)),
            pa.array(np.concatenate([d[ask], rd, d[seen]])),
            pa.array(np.concatenate([a[ask], ra, a[seen]]).astype(np.int32)),
            pa.array(np.concatenate([np.ones(ask.sum()), runs, np.zeros(len(seen))]).astype(np.int32)),
            pa.array(np.repeat(np.array([_ASK, _KNOWN, _WITNESS], np.int8), [ask.sum(), len(rd), len(seen)])),
        ],
        names=_COUNTED.names,
    )


def _anchors(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks((i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t):
                rolling = Rolling([code_points(t) for t in texts])
                hashes, inside = rolling.windows(k)
                at = winnow(hashes, inside, w)
                owner = rolling.text_of(at)
                yield _counted(hashes[at], np.array(ids, np.int64)[owner], at - rolling.starts[owner])

    return run


def _around(k: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = iter(batch.column(2).to_pylist())
            for ids, texts in blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                rolling = Rolling([code_points(t) for t in texts])
                marks = np.zeros(len(rolling.codes) + 1, np.int32)
                for start, n in zip(rolling.starts[:-1].tolist(), rolling.lengths.tolist(), strict=True):
                    at = np.array(next(places), np.int64)
                    np.add.at(marks, start + np.clip(at + k - length, 0, n - length + 1), 1)
                    np.add.at(marks, start + np.clip(at + 1, 0, n - length + 1), -1)
                at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                owner = rolling.text_of(at)
                yield _counted(rolling.at(at, length), np.array(ids, np.int64)[owner], at - rolling.starts[owner])

    return run


def _repeated(counted: DataFrame) -> DataFrame:
    same = Window.partitionBy("h")
    doc = F.when(F.col("state") != _KNOWN, F.col("doc"))
    many = (F.min(doc).over(same) != F.max(doc).over(same)) | (F.max(F.col("state") == _WITNESS).over(same))
    return counted.withColumn("many", many).where((F.col("state") == _KNOWN) | (F.col("state") == _ASK) & F.col("many")).select("doc", "at", "run")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _merge(places: pd.Series, runs: pd.Series, length: pd.Series) -> pd.Series:
    out = []
    for at, run, n in zip(places, runs, length, strict=True):
        order = np.argsort(at, kind="stable")
        start, end = np.asarray(at, np.int64)[order], (np.asarray(at, np.int64) + np.asarray(run, np.int64) - 1 + n)[order]
        end = np.maximum.accumulate(end)
        new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(start[new], end[np.append(new[1:], len(end)) - 1], strict=True)])
    return pd.Series(out)


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 120) -> DataFrame:
    """(doc, at, run): ``run`` windows of ``min_chars`` characters from place ``at`` on that also stand in another document.

    Rows without an id are no document.
    """
    k = max(1, min_chars // 2)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
    anchors = _repeated(rows.mapInArrow(_anchors(k, min_chars - k + 1), _COUNTED))
    places = stored(anchors.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("run") - 1)).alias("at")).groupBy("doc").agg(F.collect_list("at").alias("places")), "anchors")
    spot = F.pmod(F.xxhash64("doc"), F.lit(_BITS))
    page, word, bit = F.shiftright(spot, 15), F.shiftright(spot, 6) % 512, (spot % 64).cast("int")
    pages = places.groupBy(page.alias("page"), word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    # Most documents share nothing; the filter of fixed size spares them the shuffle. It never drops one that does.
    again = rows.withColumn("page", page).join(F.broadcast(pages), "page").where(F.call_function("shiftright", F.element_at("words", word), bit).bitwiseAND(F.lit(1)) == 1).select("doc", "text")
    return _repeated(again.join(places, "doc").select("doc", "text", "places").mapInArrow(_around(k, min_chars), _COUNTED))


def sharing_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 120) -> DataFrame:
    """The ids of documents that share at least ``min_chars`` consecutive characters, exactly as stored, with another."""
    return repeated_windows(docs, doc_id, text, min_chars).select(F.col("doc").alias(doc_id)).distinct()


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 120) -> DataFrame:
    """(``doc_id``, n_chars, spans, shared_chars, shared_share) for every document.

    spans are the maximal intervals [start, end) of characters whose windows of ``min_chars`` also stand elsewhere. Null,
    blank and shorter texts have none and a share of 0; rows of one id are one document, of which the longest text counts.
    """
    spans = repeated_windows(docs, doc_id, text, min_chars).groupBy("doc").agg(F.collect_list("at").alias("places"), F.collect_list("run").alias("runs")).select("doc", _merge("places", "runs", F.lit(min_chars)).alias("spans"))
    sizes = docs.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc")).agg(F.coalesce(F.max(F.length(f"`{text}`")), F.lit(0)).alias("n_chars"))
    shared = F.aggregate("spans", F.lit(0), lambda total, x: total + x["end"] - x["start"])
    return sizes.join(spans, "doc", "left").select(F.col("doc").alias(doc_id), "n_chars", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"), F.coalesce(shared, F.lit(0)).alias("shared_chars")).withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
