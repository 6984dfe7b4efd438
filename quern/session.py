"""Session helpers: where intermediate tables live and how a lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset (tests on one machine)
    a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later uses neither recompute it nor depend on an executor.

    by: a column whose values part the table into folders, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Stored tables that nothing needs once their block is over; they are deleted then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, new_path(spark, name), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return stored(df, name, f"{self.path}/{self.count}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
