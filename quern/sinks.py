"""Writers: JSON lines, JSON arrays for people, and appended tables. Non-ASCII text stays as it is and nulls are kept."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    write_json_lines(df, path, "append")


def write_json_lines_pretty(df: DataFrame, path: str) -> None:
    """A copy to read: the records indented, parted by line ends."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, folder: str, name: str, now: datetime) -> str:
    """One file ``name``_date_time.json with all rows in an array. The rows pass the driver one at a time; for small tables."""
    path = f"{folder}/{name}_{now:%Y%m%d_%H%M%S}.json"
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for n, r in enumerate(rows.toLocalIterator()):
            out.write((",\n" if n else "\n") + r.j)
        out.write("\n]\n")
    return path


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` and the count of its rows, taken while it is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen
