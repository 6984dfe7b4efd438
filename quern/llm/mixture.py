"""A sample of several sources whose sizes in tokens meet target shares.

Each source's records are put into a fixed random order and cut into blocks of equal tokens. A low-discrepancy schedule
names the source of every slot: the golden-ratio points of the unit interval are mapped through the cumulative weights
(a source's share over the size of its blocks), so every prefix of the schedule meets the shares within a few slots. The
n-th slot of a source takes its n-th block; a source that runs out starts again, at most its allowed number of times.
Blocks keep their size whatever the input holds: schedule, ranks and join are tables, spread over tasks.
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import stored

#: Fixed value: how byte-level vocabularies of this family part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Tokens of a block at most; slots of the schedule that are ranked in one task; cells by which a slot finds its source.
BLOCK, RANKED, CELLS = 512, 1 << 16, 1024

_encodings: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    """The tokenizer of a public rank file, loaded once a process."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def token_counter(path: str = DEFAULT_TOKENIZER, pattern: str = PATTERN):
    """A column function: tokens of a text; 0 for null and blank."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path, pattern).encode_ordinary
        return pd.Series([len(encode(t)) if t and not t.isspace() else 0 for t in texts], dtype="int64")

    return count


def _before(counts: DataFrame, amount: str) -> DataFrame:
    """(source, bucket, before): what the earlier buckets of a source hold; a row a bucket, not a record, meets in a task."""
    return counts.select("source", "bucket", (F.sum(amount).over(Window.partitionBy("source").orderBy("bucket")) - F.col(amount)).alias("before"))


def _sized(docs: DataFrame, record: str, source: str, text: str, tokenizer: str) -> DataFrame:
    rows = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{record}`").alias("record"), token_counter(tokenizer)(f"`{text}`").alias("tokens"))
    return stored(rows.where(F.col("source").isNotNull() & (F.col("tokens") > 0)), "tokens")


def _placed(sized: DataFrame, most: int, seed: int) -> DataFrame:
    """(source, record, tokens, start): each record's place in its source's random order, in tokens. most: records of a source at most."""
    # Running sums bucket by bucket, so that a source of any size is spread over tasks.
    bits = max(2, math.ceil(math.log2(max(1, most / 20_000))) + 1)
    order = F.xxhash64("record", F.lit(seed))
    ordered = sized.withColumns({"order": order, "bucket": F.shiftrightunsigned(order, 64 - bits)})
    before = _before(ordered.groupBy("source", "bucket").agg(F.sum("tokens").alias("size")), "size")
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    return ordered.withColumn("within", within).join(before, ["source", "bucket"]).select("source", "record", "tokens", (F.col("within") + F.col("before")).alias("start"))


def _schedule(facts: DataFrame, slots: int) -> DataFrame:
    """(slot, source, repeat_no, block) of a schedule of ``slots`` slots over sources (source, lo, hi, blocks, most)."""
    golden = (math.sqrt(5) - 1) / 2
    point = F.col("id") * golden + golden / 2
    points = facts.sparkSession.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.withColumns({"cell": F.floor(F.col("point") * CELLS).cast("int"), "bucket": F.floor(F.col("slot") / RANKED)})
    # Sources meet the points by the cells that both lie in: at most one row a cell more than there are sources.
    cells = facts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)).cast("int"))))
    named = points.join(cells, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "bucket", "source", "blocks", "most")
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("slot")) - 1
    ranked = named.withColumn("rank", rank).join(_before(named.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")), "n"), ["source", "bucket"])
    turn = F.col("rank") + F.col("before")
    # A source can come a few slots early; a slot that would be one repeat too many stays empty.
    return ranked.withColumns({"round": F.floor(turn / F.col("blocks")), "block": turn % F.col("blocks")}).where(F.col("round") < F.col("most")).select("slot", "source", (F.col("round") + 1).cast("int").alias("repeat_no"), "block")


def mixture(docs: DataFrame, targets: DataFrame, record: str = "doc_id", source: str = "source", text: str = "text", share: str = "target_share", max_repeats: str = "max_repeats", total_tokens: int | None = None, tokenizer: str = DEFAULT_TOKENIZER, seed: int = 0) -> DataFrame:
    """(slot, source, ``record``, repeat_no, tokens): the records of the sample, in the order of the schedule.

    targets: one row a source (of more the largest share and repeats count). The sample is as large as the repeats allow,
    or ``total_tokens`` if that is less. A record stands in it at most ``max_repeats`` times (null: once); repeat_no counts
    from 1. Null and blank texts hold no tokens and are left out, as are sources without a target. A source with a target
    but without tokens cannot take part: the other shares are scaled up, and the report shows it with 0. A record belongs
    to the block in which it begins. The same input and seed give the same sample.
    """
    sized = _sized(docs, record, source, text, tokenizer)
    held = sized.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    wanted = targets.select(F.col(f"`{source}`").alias("source"), F.col(f"`{share}`").cast("double").alias("share"), F.greatest(F.coalesce(F.col(f"`{max_repeats}`").cast("int"), F.lit(1)), F.lit(1)).alias("most")).groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    facts = stored(wanted.where("share > 0").join(held, "source"), "sources")
    whole = facts.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("weight"), F.min(F.col("size") * F.col("most") / F.col("share")).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    total = min([whole.weight * (whole.least or 0)] + ([total_tokens] if total_tokens else []))
    # Blocks of a source are equally long, at most BLOCK tokens; a source's slots follow from its share and its blocks' length.
    facts = facts.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("want", total * F.col("share") / (whole.weight or 1) * F.col("blocks") / F.col("size"))
    slots = facts.agg(F.coalesce(F.sum("want"), F.lit(0.0))).first()[0]
    # A row a source, so the cumulative weights are one small window.
    hi = F.sum("want").over(Window.orderBy("source")) / (slots or 1)
    edges = facts.withColumn("hi", hi).withColumns({"lo": F.col("hi") - F.col("want") / (slots or 1), "last": F.row_number().over(Window.orderBy(F.desc("source"))) == 1})
    edges = stored(edges.select("source", "lo", F.when(F.col("last"), 2.0).otherwise(F.col("hi")).alias("hi"), "blocks", "most", "size"), "edges")
    schedule = _schedule(edges, max(1, int(slots)) if slots else 0)
    placed = _placed(sized, whole.n, seed).join(edges.select("source", "size", "blocks"), "source")
    records = placed.withColumn("block", F.least(F.floor(F.col("start") * F.col("blocks") / F.col("size")), F.col("blocks") - 1))
    return records.select("source", "record", "tokens", "block").join(schedule, ["source", "block"]).select("slot", "source", F.col("record").alias(record), "repeat_no", "tokens")


def mixture_report(sample: DataFrame, targets: DataFrame, record: str = "doc_id", source: str = "source", share: str = "target_share") -> DataFrame:
    """Per target: its share, the sample's records, distinct records, tokens and actual share, and the most repeats used."""
    got = sample.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.countDistinct(record).alias("distinct_records"), F.sum("tokens").alias("tokens"), F.max("repeat_no").alias("repeats"))
    wanted = targets.select(F.col(f"`{source}`").alias("source"), F.col(f"`{share}`").alias("target_share"))
    total = F.sum("tokens").over(Window.partitionBy())
    return wanted.join(got, "source", "left").na.fill(0, ["records", "distinct_records", "tokens", "repeats"]).withColumn("actual_share", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(0.0))
