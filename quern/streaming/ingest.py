"""Incremental loads and conversation memory as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions.text import base_name
from quern.operators.dedup import unseen, upsert_table
from quern.sources.jsonl import SCHEMA


def stream_json_lines(spark: SparkSession, folder: str, schema: T.StructType = SCHEMA, files_per_batch: int = 1) -> DataFrame:
    """The records of files as they arrive, ``files_per_batch`` at a time, with ``file`` and its base name ``slug``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("columnNameOfCorruptRecord", "_broken").json(folder)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), base_name(F.col("_metadata.file_path")).alias("slug"))


def _once(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_unseen(rows: DataFrame, table: str, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """Append the first rows of keys that ``table`` lacks, batch by batch, until no file is left.

    The table itself is the memory of what was seen, so state does not grow with it. A batch writes to a place of its own
    number and replaces it, so a repeated batch changes nothing.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().split("=")[-1] != str(n)] if fs.exists(path) else []
        fresh = unseen(batch, spark.read.parquet(*earlier), key, order) if earlier else unseen(batch, batch.select(key).limit(0), key, order)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return _once(rows, each, checkpoint)


def upsert_stream(rows: DataFrame, table: str, key: str, order: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Replace or add the rows of each batch in ``table`` by ``key``."""
    return _once(rows, lambda batch, n: upsert_table(batch.sparkSession, table, prepare(batch), key, order) and None, checkpoint)


_TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("history", T.StringType())])
_MEMORY = T.StructType([T.StructField("lines", T.ArrayType(T.StringType()))])


def conversation_memory(turns: DataFrame, last: int | None = None) -> DataFrame:
    """For each turn of a stream (conv_id, turn, role, text) the history up to it, at most its ``last`` lines."""

    def remember(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values("turn")
        out = []
        for r in new.itertuples(index=False):
            kept.append(f"{r.role}: {r.text}")
            kept = kept[-last:] if last else kept
            out.append((key[0], r.turn, "\n".join(kept)))
        state.update((kept,))
        yield pd.DataFrame(out, columns=_TURN.names)

    return turns.groupBy("conv_id").applyInPandasWithState(remember, _TURN, _MEMORY, "append", GroupStateTimeout.NoTimeout)
