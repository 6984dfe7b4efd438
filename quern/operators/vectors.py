"""Dense vectors: norms, similarities and exact top-k of a stated set of queries against a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that go to every task at once; more of them go in further rounds.
BLOCK = 4096
EPSILON = 1e-12


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """The vector by its length, to which a small number is added so that the zero vector stays itself."""
    return F.transform(v, lambda x: x.cast("double") / (l2_norm(v) + EPSILON))


def _stack(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of a column, and their places."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = [i for i, x in enumerate(lists) if x.is_valid and len(x) == width and all(y.is_valid for y in x)] if lists.null_count or lists.flatten().null_count or len(lists.flatten()) != len(lists) * width else range(len(lists))
    at = np.fromiter(ok, np.int64)
    if not len(at):
        return np.empty((0, width)), at
    return np.asarray(lists.take(pa.array(at)).flatten(), np.float64).reshape(len(at), width), at


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", vector_id: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(``query_id``, ``vector_id``, sim, rank): the k most similar vectors of each query, ties by id.

    metric: 'cosine' gives the cosine, 'l2sq' 1 minus the squared distance, 'dot' the product. Exact. Each task keeps the
    best k of its batches, so k rows a query and batch are shuffled. Queries are sent in blocks of ``BLOCK``; null and
    odd-length vectors are in no result, zero vectors have cosine 0.
    """
    if metric not in ("cosine", "l2sq", "dot"):
        raise ValueError(f"unknown metric: {metric}")
    wanted = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).where(F.col(query_vector).isNotNull())
    rows = vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("v")).where(F.col(vector).isNotNull())
    out = T.StructType([wanted.schema["q"], rows.schema["id"], T.StructField("sim", T.DoubleType())])
    found, block = None, []

    def search(held: list) -> DataFrame:
        width = len(held[0].v)
        q = np.array([r.v for r in held if len(r.v) == width], np.float64)
        if metric == "cosine":
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), EPSILON)
        shared = rows.sparkSession.sparkContext.broadcast(([r.q for r in held if len(r.v) == width], q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in batches:
                x, at = _stack(batch.column(1), q.shape[1])
                if not len(at):
                    continue
                if metric == "cosine":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPSILON)
                ids = batch.column(0).take(pa.array(at))
                for s in range(0, len(q), 512):
                    part = q[s : s + 512]
                    sim = part @ x.T
                    if metric == "l2sq":
                        sim = 1 - ((part**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * sim)
                    # All ties with the k-th stay, so that the ids decide among them later.
                    least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(part), -np.inf)
                    i, j = np.nonzero(sim >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array([names[s + n] for n in i], batch_type), ids.take(pa.array(j)), pa.array(sim[i, j])], ["q", "id", "sim"])

        batch_type = _arrow(wanted.schema["q"].dataType)
        return rows.mapInArrow(run, out)

    for r in wanted.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            found, block = (search(block) if found is None else found.unionByName(search(block))), []
    if block or found is None:
        last = search(block) if block else wanted.sparkSession.createDataFrame([], out)
        found = last if found is None else found.unionByName(last)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(vector_id), "sim", "rank")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
