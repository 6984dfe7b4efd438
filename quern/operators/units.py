"""One quantity recorded in different units, brought to a common unit.

A field's text, or the remark beside it, states number and unit; that gives the value as stated. Each source (a product,
say) has a history of such values in the order of its rows. Its log values are segmented by an exact penalised
changepoint search; a segment whose level differs from the source's usual level by a known factor between units was
recorded in another unit than it says, and the factor is reversed.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import stored

# Units in bytes and in hertz. The longer spelling comes first where one begins another.
MEMORY = {
    "Tbit": 2**37, "Gbit": 2**27, "Mbit": 2**17, "Kbit": 2**7, "太位元組": 2**40, "吉位元組": 2**30, "十億位元組": 2**30, "兆位元組": 2**20, "百萬位元組": 2**20, "千位元組": 2**10, "位元組": 1,
    "TiB": 2**40, "GiB": 2**30, "MiB": 2**20, "KiB": 2**10, "TB": 2**40, "GB": 2**30, "MB": 2**20, "KB": 2**10, "kB": 2**10, "Tb": 2**37, "Gb": 2**27, "Mb": 2**17, "Kb": 2**7, "T": 2**40, "G": 2**30, "M": 2**20, "K": 2**10, "B": 1,
}
FREQUENCY = {"太赫": 1e12, "吉赫": 1e9, "十億赫": 1e9, "兆赫": 1e6, "百萬赫": 1e6, "千赫": 1e3, "thz": 1e12, "ghz": 1e9, "mhz": 1e6, "khz": 1e3, "hz": 1.0, "赫": 1.0}
#: kind -> size of the common unit: MB and MHz.
COMMON = {"memory": 2**20, "frequency": 1e6}
#: Factors that a wrong unit makes: powers of 1000 and 1024, and bits for bytes.
FACTORS = {"memory": [s * f for s in (1, 8, 1 / 8) for f in (2.0**-20, 2.0**-10, 1.0, 2.0**10, 2.0**20) if (s, f) != (1, 1.0)], "frequency": [1e-9, 1e-6, 1e-3, 1e3, 1e6, 1e9]}

_NUMBER = r"(?P<n>\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?)"
_TIMES = r"(?:(?P<k>\d+)\s*[x×*X]\s*)?"
_UNIT = {"memory": "|".join(MEMORY), "frequency": "|".join(f"(?i:{u})茲?" if u[-1] == "赫" else f"(?i:{u})" for u in FREQUENCY)}
_QUANTITY = {kind: re.compile(rf"{_TIMES}{_NUMBER}\s*(?P<u>{unit})?(?![A-Za-z])") for kind, unit in _UNIT.items()}
_MEMORY_TYPE = re.compile(r"(?:L?P?G?DDR\d?\w*|HBM\w*)")
_ABOUT = re.compile(r"^(?:大?約|約|~|≈|ca\.?|approx\.?)\s*", re.I)
_INVISIBLE = re.compile("[​-‏⁠-⁤­﻿᠎]")


def _clean(text: str) -> str:
    return " ".join(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).split())


def _size(kind: str, unit: str) -> float:
    return MEMORY[unit] if kind == "memory" else FREQUENCY[unit.lower().removesuffix("茲")]


@lru_cache(1 << 14)
def remark_unit(remark: str | None, field: str, kind: str) -> str | None:
    """The unit that a remark gives for a field, or for all of a kind where it names no field."""
    if not remark:
        return None
    text = _clean(remark)
    unit = rf"(?P<u>{_UNIT[kind]})(?![A-Za-z])"
    if m := re.search(rf"{re.escape(_clean(field))}\s*(?:的?單位)?\s*(?:為|是|以|用|採|in|:|=|\()?\s*{unit}", text):
        return m["u"]
    m = re.search(rf"(?:^|[;；,，。\s])單位\s*(?:為|是|以|:|=)?\s*{unit}", text)
    return m["u"] if m else None


@lru_cache(1 << 16)
def quantities(text: str | None, kind: str, unit: str | None = None) -> tuple[tuple[float, bool], ...]:
    """(value in the common unit, whether its unit is stated) for each alternative that ``text`` gives.

    unit: the unit of numbers that have none beside them; without it they are taken in the common unit and marked.
    """
    if not text:
        return ()
    out, parts = [], [_ABOUT.sub("", p.strip()) for p in _MEMORY_TYPE.sub(" ", _clean(text)).split("/")]
    last = None
    for part in reversed(parts):
        m = _QUANTITY[kind].fullmatch(part.strip())
        if not m:
            continue
        n = m["n"]
        # A comma before three digits parts thousands, any other is a decimal comma.
        n = re.sub("[, ]", "", n) if re.fullmatch(r"[1-9]\d{0,2}(?:[, ]\d{3})+(?:\.\d+)?", n) else n.replace(",", ".").replace(" ", "")
        last = m["u"] or last
        size = last or unit
        value = float(n) * int(m["k"] or 1) * (_size(kind, size) / COMMON[kind] if size else 1.0)
        if value > 0 and math.isfinite(value):
            out.append((value, bool(size)))
    return tuple(reversed(out))


#: States of a value: at its source's usual level, at none that is known, and then one for each known factor.
USUAL, OTHER = 0, 1
#: What a value at no known level costs, in squared deviations; with the spread of a level it says how near is near.
OTHER_COST = 16.0


class Levels:
    """Exact penalised changepoint search where the levels are the usual one, its known multiples, and none of them.

    It minimises the squared deviations of the log values from their segments' levels, in spreads of the level, plus
    ``penalty`` a changepoint. Costs of pieces of a history are matrices that combine in any order, so a history of any
    length is searched in pieces and the result is that of the whole.
    """

    def __init__(self, kind: str, spread: float, usual_spread: float, penalty: float):
        self.log = np.log(sorted(FACTORS[kind]))
        self.level = np.concatenate([[0.0, 0.0], self.log])
        self.scale = np.concatenate([[usual_spread, np.inf], np.full(len(self.log), spread)])
        self.penalty, self.states = penalty, len(self.level)

    def _runs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and costs by state of the runs of equal values; no changepoint need lie within one."""
        start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        cost = ((x[start, None] - self.level[None]) / self.scale[None]) ** 2
        cost[:, OTHER] = OTHER_COST
        return start, cost * np.diff(np.append(start, len(x)))[:, None]

    def piece(self, x: np.ndarray) -> np.ndarray:
        """[i, j]: the least cost of ``x`` where the value before it was in state i and its last one is in state j."""
        m = np.where(np.eye(self.states, dtype=bool), 0.0, self.penalty)
        _, costs = self._runs(x)
        for n, c in enumerate(costs):
            m = (np.minimum(m, m.min(1, keepdims=True) + self.penalty) if n else m) + c[None]
        return m

    def states_of(self, x: np.ndarray, before: int, last: int) -> np.ndarray:
        """The states of ``x`` on the best way from state ``before`` to state ``last``; before -1: free."""
        start, costs = self._runs(x)
        m = np.zeros(self.states) if before < 0 else np.where(np.arange(self.states) == before, 0.0, self.penalty)
        back = np.empty(costs.shape, np.int64)
        for n, c in enumerate(costs):
            best = int(m.argmin())
            moved = (m[best] + self.penalty < m) if n else np.zeros(self.states, bool)
            back[n] = np.where(moved, best, np.arange(self.states))
            m = np.where(moved, m[best] + self.penalty, m) + c
        out, state = np.empty(len(x), np.int64), last
        for n in range(len(start) - 1, -1, -1):
            out[start[n] : start[n + 1] if n + 1 < len(start) else len(x)] = state
            state = int(back[n][state])
        return out

    def factor(self, state: np.ndarray) -> np.ndarray:
        return np.exp(np.concatenate([[0.0, 0.0], self.log]))[state]


def _chained(groups: Iterator[tuple[tuple, list[tuple[int, np.ndarray]]]]) -> Iterator[tuple[tuple, list[tuple[int, int, int]]]]:
    """Per history the states before and at the end of each of its pieces (number, matrix) on the best way through all."""
    for key, pieces in groups:
        f, back = None, []
        for _, m in pieces:
            # The first value of a history comes from nowhere, so no state costs it a changepoint.
            way = np.where(np.eye(len(m), dtype=bool), m, np.inf) if f is None else f[:, None] + m
            if f is None:
                way = np.broadcast_to(m.min(0), m.shape)
                back.append(np.full(len(m), -1))
            else:
                back.append(way.argmin(0))
            f = way.min(0)
        last, out = int(f.argmin()), []
        for (n, _), b in zip(reversed(pieces), reversed(back), strict=True):
            out.append((n, int(b[last]), last))
            last = int(b[last])
        yield key, out


_PARSED = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("stated", T.BooleanType())]))


def _parser(fields: dict[str, str]):
    @F.pandas_udf(_PARSED)
    def parse(field: pd.Series, raw: pd.Series, remark: pd.Series) -> pd.Series:
        return pd.Series([[{"value": v, "stated": s} for v, s in quantities(r, fields[f], remark_unit(m, f, fields[f]))] for f, r, m in zip(field, raw, remark, strict=True)])

    return parse


def with_common_units(df: DataFrame, fields: dict[str, str], row: str, source: str, remark: str | None = None, spread: float = 0.005, usual_spread: float = 0.0004, piece: int = 4096) -> DataFrame:
    """One record a row and field: (row, source, field_name, raw, alternatives, value, factor, common_value, usual_value, shifted).

    fields: column -> 'memory' (MB) or 'frequency' (MHz). alternatives are the values as stated, in the common unit, with
    whether the unit is stated; value is the one nearest to the source's usual level (of those with a stated unit, where
    there are any), null where the field gives no quantity. factor is what the recorded unit was wrong by (1 where it was
    right), common_value = value / factor. usual_value is the source's commonest value, counted over all rows; shifted
    tells the values of segments at another level than that.

    A source's history, in the order of ``row``, is segmented as a whole (``Levels``): it is read in pieces of at most
    ``piece`` values, whose costs are chained exactly, so neither pieces nor partitions change a result, and a source of
    very many rows is spread over tasks. spread and usual_spread: how far values scatter, in logarithms, about a level
    that a wrong unit makes and about the usual one. A null source is a source of its own. Repeated rows are kept.
    Columns beside those named are not read.
    """
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("raw")) for f in fields))).alias("f")
    rows = df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{source}`").alias("source"), (F.col(f"`{remark}`") if remark else F.lit(None).cast("string")).alias("remark"), texts)
    # Levels, histories and the result all read the parsed values, so they are parsed once and kept.
    parsed = stored(rows.select("row", "source", F.col("f.field_name").alias("field_name"), F.col("f.raw").alias("raw"), _parser(fields)("f.field_name", "f.raw", "remark").alias("alternatives")), "quantities")
    one = F.when(F.size("alternatives") == 1, F.element_at("alternatives", 1)["value"])
    levels = (
        parsed.where(F.size("alternatives") > 0).groupBy("source", "field_name", F.round(F.log(one), 5).alias("level")).count()
        .groupBy("source", "field_name").agg(F.max_by("level", F.when(F.col("level").isNotNull(), F.struct("count", "level"))).alias("usual"), F.sum("count").alias("length"))
        .select(F.col("source").alias("s"), F.col("field_name").alias("f"), "usual", "length")
    )
    near = parsed.join(levels, parsed["source"].eqNullSafe(F.col("s")) & (F.col("field_name") == F.col("f")), "left").drop("s", "f")
    stated = F.filter("alternatives", lambda x: x["stated"])
    usable = F.when(F.size(stated) > 0, stated).otherwise(F.col("alternatives"))
    near = near.withColumn("usable", usable)
    far = lambda x: F.abs(F.log(x["value"]) - F.coalesce("usual", F.log(x["value"])))
    value = F.reduce(F.slice("usable", 2, 1 << 20), F.get("usable", F.lit(0)), lambda a, x: F.when(far(x) < far(a), x).otherwise(a))["value"]
    near = near.withColumn("value", value).drop("usable")
    history = near.where(F.col("value").isNotNull() & F.col("usual").isNotNull()).select("source", "field_name", "row", "length", F.round(F.log("value") - F.col("usual"), 5).alias("x"))
    search = lambda field, length: Levels(fields[field], spread, usual_spread, 2 * math.log(max(length, 2)))
    kept = T.StructType([T.StructField("source", near.schema["source"].dataType), T.StructField("field_name", T.StringType()), T.StructField("length", T.LongType()), T.StructField("rows", T.ArrayType(near.schema["row"].dataType)), T.StructField("x", T.BinaryType()), T.StructField("costs", T.BinaryType())])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            group = (frame["source"].isna().astype(str) + frame["source"].astype(str) + "\0" + frame["field_name"]).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
            out = []
            for b, e in zip(begins, [*begins[1:], len(group)], strict=True):
                for s in range(b, e, piece):
                    part = frame.iloc[s : min(e, s + piece)]
                    x, head = part["x"].to_numpy(float), part.iloc[0]
                    out.append((head["source"], head["field_name"], head["length"], part["row"].tolist(), x.tobytes(), search(head["field_name"], head["length"]).piece(x).tobytes()))
            yield pd.DataFrame(out, columns=kept.names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = history.repartitionByRange(tasks, "source", "field_name", "row").sortWithinPartitions("source", "field_name", "row")
    # Partitions hold ranges in order, so the numbers of the pieces are in order too.
    pieces = stored(ordered.mapInPandas(cut, kept).withColumn("piece", F.monotonically_increasing_id()), "pieces")

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def histories() -> Iterator[tuple[tuple, list]]:
            key, held = None, []
            for frame in frames:
                for s, f, n, c in frame[["source", "field_name", "piece", "costs"]].itertuples(index=False):
                    if (s, f) != key and held:
                        yield key, held
                        held = []
                    key = (s, f)
                    m = np.frombuffer(c, float)
                    held.append((n, m.reshape(math.isqrt(len(m)), -1)))
            if held:
                yield key, held

        # Batches of a bounded number of rows, however many histories they come from.
        held: list[tuple[int, int, int]] = []
        for _, states in _chained(histories()):
            held += states
            if len(held) > 10_000:
                yield pd.DataFrame(held, columns=["piece", "before", "last"])
                held = []
        yield pd.DataFrame(held, columns=["piece", "before", "last"])

    # Only a matrix a piece meets in one task, not the values.
    ends = pieces.select("source", "field_name", "piece", "costs").repartition("source", "field_name").sortWithinPartitions("source", "field_name", "piece").mapInPandas(chain, "piece long, before int, last int")
    found = T.StructType([T.StructField("row", near.schema["row"].dataType), T.StructField("field_name", T.StringType()), T.StructField("factor", T.DoubleType())])

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False):
                levels_of = search(r.field_name, r.length)
                state = levels_of.states_of(np.frombuffer(r.x, float), r.before, r.last)
                at = np.flatnonzero(state != USUAL).tolist()
                out += zip([r.rows[i] for i in at], [r.field_name] * len(at), levels_of.factor(state[at]).tolist(), strict=True)
            yield pd.DataFrame(out, columns=found.names)

    # Values off the usual level are few, so the way back is a small join; repeated rows are one of it.
    shifts = pieces.join(ends, "piece").repartition(tasks, "piece").select("field_name", "length", "rows", "x", "before", "last").mapInPandas(settle, found).groupBy("row", "field_name").agg(F.first("factor").alias("factor"), F.lit(True).alias("shifted"))
    done = near.join(shifts, ["row", "field_name"], "left")
    right = F.when(F.col("value").isNotNull(), F.coalesce("factor", F.lit(1.0)))
    return done.select(F.col("row").alias(row), F.col("source").alias(source), "field_name", "raw", "alternatives", "value", right.alias("factor"), (F.col("value") / right).alias("common_value"), F.exp("usual").alias("usual_value"), F.coalesce("shifted", F.lit(False)).alias("shifted"))


def off_reference(common: DataFrame, reference: DataFrame, source: str, columns: dict[str, str], tolerance: float = 0.005) -> DataFrame:
    """The records of ``with_common_units`` of which every stated alternative is more than ``tolerance`` off the reference.

    The segmentation gives the candidates: values of segments that are not at their source's usual level, and all values
    of the few sources whose usual level is not the accepted value itself. They are then compared with the reference.
    columns: field -> column of ``reference`` with its value in the common unit. Fields without a stated quantity, and
    sources that the reference lacks or leaves null, are no cases.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(c).cast("double").alias("accepted")) for f, c in columns.items()))).alias("r")
    accepted = reference.select(F.col(source), pairs).select(source, "r.*").where(F.col("accepted") > 0)
    stated = F.filter("alternatives", lambda x: x["stated"])
    candidate = F.col("shifted") | F.coalesce(F.abs(F.col("usual_value") / F.col("accepted") - 1) > tolerance / 5, F.lit(True))
    return common.join(accepted, [source, "field_name"]).where(candidate & (F.size(stated) > 0) & F.forall(stated, lambda x: F.abs(x["value"] / F.col("accepted") - 1) > tolerance))
