"""Timestamps of many notations, precisions and zones brought to one instant.

The distinct raw strings of a source (with the zone that holds where a string names none) form a dictionary. Each
string is parsed once; the dictionary is a table that later loads extend by the strings they bring anew; rows get
their instant by a join on the string.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import stored

# Abbreviations of zones and their minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "CST": 480, "TST": 480, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_ZONE = r"(?:\s*(?P<abbr>[A-Z]{1,4})?(?P<off>[+\-−]\d{1,2}(?::?\d{2})?(?::?\d{2})?)?)(?:\s*\[?(?P<name>[A-Z][A-Za-z]+(?:/[A-Za-z_+\-]+)+)\]?)?(?:\s*\([A-Za-z ]+\))?"
_CLOCK = r"(?:(?P<half>上午|下午|早上|凌晨|中午|晚上|晚間)\s*)?(?P<h>\d{1,2})(?:(?::(?P<m>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?)|(?:[時点點](?:(?P<m2>\d{1,2})分(?:(?P<s2>\d{1,2})秒)?)?))(?:\s*(?P<ampm>[AaPp]\.?[Mm]\.?))?"
_NUMERIC = re.compile(rf"(?P<era>民國|中華民國)?\s*(?P<Y>\d{{2,4}})(?:\s*(?P<sep>[-/.])\s*(?P<M>\d{{1,2}})\s*(?P=sep)\s*(?P<D>\d{{1,2}})|\s*年\s*(?P<M2>\d{{1,2}})\s*月\s*(?P<D2>\d{{1,2}})\s*日?)(?:\s*[T ]?\s*{_CLOCK}{_ZONE})?")
_COMPACT = re.compile(rf"(?P<Y>\d{{4}})(?P<M>\d{{2}})(?P<D>\d{{2}})[T ](?P<h>\d{{2}})(?P<m>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}")
_DAY_FIRST = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<D>\d{{1,2}})[ -](?P<mon>[A-Za-z]{{3,9}})\.?[ -](?P<Y>\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?")
_MONTH_FIRST = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<D>\d{{1,2}}),?\s+(?P<Y>\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_NO_SIGN = re.compile("[​-‏⁠-⁤­﻿᠎]")


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _build(g: dict, default: str) -> int | None:
    year = int(g["Y"])
    if g.get("era") or len(g["Y"]) == 3:
        year += 1911
    elif len(g["Y"]) != 4:
        return None
    month = MONTHS.get(g["mon"][:3].lower(), 0) if g.get("mon") else int(g.get("M") or g.get("M2"))
    day = int(g.get("D") or g.get("D2"))
    hour, minute, second = int(g.get("h") or 0), int(g.get("m") or g.get("m2") or 0), int(g.get("s") or g.get("s2") or 0)
    half = g.get("half") or (g.get("ampm") or "")[:1].lower()
    if half:
        if half in ("下午", "晚上", "晚間", "p"):
            hour += 12 * (hour < 12)
        elif half != "中午" and hour == 12:
            hour = 0
    ahead = timedelta(0)
    if hour == 24 and minute == second == 0:
        hour, ahead = 0, timedelta(days=1)
    if second == 60:
        second, ahead = 59, ahead + timedelta(seconds=1)
    try:
        local = datetime(year, month, day, hour, minute, second, int((g.get("f") or "0")[:6].ljust(6, "0")))
        if offset := g.get("off"):
            digits = re.sub(r"\D", "", offset)
            hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:])) if len(digits) <= 4 else (int(digits[:2]), int(digits[2:4]))
            if hours > 18 or minutes > 59:
                return None
            zone = timezone((timedelta(hours=hours, minutes=minutes)) * (1 if offset[0] == "+" else -1))
        elif abbr := g.get("abbr"):
            if abbr not in ABBREVIATIONS:
                return None
            zone = timezone(timedelta(minutes=ABBREVIATIONS[abbr]))
        else:
            zone = _zone(g.get("name") or default)
            if zone is None:
                return None
        delta = local.replace(tzinfo=zone) + ahead - _EPOCH
    except (ValueError, OverflowError):
        return None
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def parse_instant(raw: str | None, zone: str = "Asia/Taipei") -> int | None:
    """Microseconds since 1970 in UTC, or None where the string denotes no instant.

    A written offset wins over a zone name, either over ``zone``. A local time that a clock change repeats is its first
    occurrence; one that it skips is read with the offset before the change. A date alone is its midnight in ``zone``.
    Three-digit years and years after 民國 count from 1911. Bare digits: 10 seconds, 13 milliseconds, 16 microseconds or
    19 nanoseconds since 1970; 8, 12 or 14 a date from year to day, minute or second; 7 the same with a Minguo year.
    """
    if not raw:
        return None
    text = raw if raw.isascii() else _NO_SIGN.sub("", unicodedata.normalize("NFKC", raw))
    text = " ".join(text.split())
    if text.isascii() and text.isdigit():
        n = len(text)
        if n in (10, 13, 16, 19):
            return int(text) * 10**6 // 10 ** (n - 10)
        if n in (8, 12, 14):
            return _build({"Y": text[:4], "M": text[4:6], "D": text[6:8], "h": text[8:10], "m": text[10:12], "s": text[12:]}, zone)
        return _build({"Y": text[:3], "M": text[3:5], "D": text[5:]}, zone) if n == 7 else None
    for pattern in (_NUMERIC, _COMPACT, _DAY_FIRST, _MONTH_FIRST):
        if m := pattern.fullmatch(text):
            return _build(m.groupdict(), zone)
    return None


@F.pandas_udf(T.LongType())
def _parse(raw: pd.Series, zone: pd.Series) -> pd.Series:
    return pd.Series([parse_instant(r, z) for r, z in zip(raw, zone, strict=True)], dtype="Int64")


def extend_dictionary(strings: DataFrame, path: str | None = None, name: str = "instants") -> DataFrame:
    """The dictionary (source, zone, raw, instant) after adding the strings that it lacks.

    strings: source, zone, raw in any number and order. With ``path`` the dictionary lives there between loads: only
    strings that it lacks are parsed and appended. Without, a new one is written to the shared folder.
    """
    spark = strings.sparkSession
    keys = ["source", "zone", "raw"]
    # A write follows, so the parse runs once per string however often the dictionary is read.
    fresh = strings.select(*keys).where(F.col("raw").isNotNull()).distinct()
    parsed = lambda df: df.withColumn("instant", F.timestamp_micros(_parse("raw", "zone")))
    if path is None:
        return stored(parsed(fresh), name)
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("instant", T.TimestampType())])
    jvm = spark.sparkContext._jvm
    if jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(path)):
        fresh = fresh.join(spark.read.schema(schema).parquet(path).select(*keys), keys, "left_anti")
    parsed(fresh).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_instant(df: DataFrame, column: str, source: str | Column, zone: str | Column = "Asia/Taipei", out: str = "instant", path: str | None = None) -> DataFrame:
    """``df`` with ``out``: the instant that ``column`` denotes, or null.

    source and zone: a name, or a column. Null, blank and meaningless strings give null; no row is lost or repeated. A
    column named like ``out`` is replaced. Strings held by very many rows are one entry of the dictionary; the join back
    is split by the engine where such a string makes a partition too large.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = df.drop(out).withColumns({"__source": as_column(source), "__zone": as_column(zone)})
    strings = rows.select(F.col("__source").alias("source"), F.col("__zone").alias("zone"), F.col(f"`{column}`").alias("raw"))
    # Nulls are in no dictionary; spread over many keys they do not meet in one task.
    rows = rows.withColumn("__raw", F.coalesce(F.col(f"`{column}`"), F.concat(F.lit("\0"), (F.monotonically_increasing_id() % 4096).cast("string"))))
    known = extend_dictionary(strings, path).select(F.col("source").alias("__s"), F.col("zone").alias("__z"), F.col("raw").alias("__r"), F.col("instant").alias(out))
    on = (F.col("__source") == F.col("__s")) & (F.col("__zone") == F.col("__z")) & (F.col("__raw") == F.col("__r"))
    return rows.join(known, on, "left").drop("__source", "__zone", "__raw", "__s", "__z", "__r")


def same_instant_pairs(df: DataFrame, keys: list[str], row: str, instant: str = "instant") -> DataFrame:
    """Pairs ``row``_a < ``row``_b of rows with equal keys and an equal instant, cut to whole seconds; nulls pair with nothing."""
    cut = df.where(F.col(instant).isNotNull()).select(*keys, F.date_trunc("second", instant).alias("__at"), F.col(row).alias("__row"))
    a, b = cut.withColumnRenamed("__row", f"{row}_a"), cut.withColumnRenamed("__row", f"{row}_b")
    return a.join(b, [*keys, "__at"]).where(F.col(f"{row}_a") < F.col(f"{row}_b")).drop("__at")
