"""New batches judged against everything accepted before, without reprocessing the history.

Accepted rows live in an index of segments, one a batch. A segment holds, shard by shard, the keys of its texts and a
small-world graph over the fuzzy field of its rows, each packed into one record. A batch is asked of the shards that its
rows fall into: small batches are sent to the shards where they lie, so the history is neither shuffled nor unpacked row
by row. What no shard knows is built into graphs of its own; their walks find what is alike within the batch, and they
become the batch's segment. Segments of a like size are merged, and all are parted anew when the index has doubled.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.codes import form
from quern.llm.graph import Graph, fixed, one_edit
from quern.session import Scratch, new_path, stored

#: Names of one key in one graph; rows of a batch that may be sent to all tasks; folders of a segment.
PART, BROADCAST_ROWS, MOST_FOLDERS = 16_384, 100_000, 1024
#: An index of at most 2^DEEP shards has one folder a segment.
DEEP = 7
#: Bytes of a key's digest; keys of parted bases are one byte longer.
DIGEST = 16
# Kinds of records in a segment.
KEYS, GRAPH, REJECTED, OPEN, EDGE, HOT = range(6)
_RECORD = "kind int, shard long, payload binary, row long, other long"
_KEYED = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("base", T.BinaryType()), T.StructField("name", T.StringType())])
_KNOWN = "text binary, row long"


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=DIGEST).digest()


@F.pandas_udf(_KEYED)
def _keyed(source: pd.Series, text: pd.Series, exact: pd.Series, fuzzy: pd.Series) -> pd.DataFrame:
    known: dict[str, str] = {}

    def cached(x: str) -> str:
        if (y := known.get(x)) is None:
            y = known[x] = form(x)
        return y

    bases = [_digest("\x1f".join([s or "", *("\0" if x is None else cached(x) for x in xs)])) for s, xs in zip(source, exact, strict=True)]
    texts = [_digest(f"{s or ''}\x1f{form(t)}") if t is not None else None for s, t in zip(source, text, strict=True)]
    return pd.DataFrame({"text": texts, "base": bases, "name": [cached(x) if x is not None else None for x in fuzzy]})


def keyed(df: DataFrame, source: Column, row: str, text: str, exact: list[str], fuzzy: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, row, text, base, name) and ``keep``: digests of a row's text and equal fields in comparison form, and its fuzzy field."""
    fields = F.array(*(F.col(f"`{c}`").cast("string") for c in exact))
    k = _keyed(source, F.col(f"`{text}`"), fields, F.col(f"`{fuzzy}`"))
    return df.select(source.alias("source"), F.col(f"`{row}`").cast("long").alias("row"), *(F.col(f"`{c}`") for c in keep), k.alias("k")).select("source", "row", *keep, "k.*")


def subkeys(base: bytes, name: str) -> list[bytes]:
    """Keys of which two names of one base that are one edit apart share at least one.

    The characters that may not differ are equal in order, and with m the length of the shorter name the first or the
    last m // 2 characters are equal. So a base of very many names is parted without sending a name to all parts.
    """
    bones, out = "".join(c for c in name if fixed(c)), []
    for m in {len(name), max(0, len(name) - 1)}:
        h = m // 2
        out += [b"\x01" + _digest(f"{base.hex()}\x1f{bones}\x1f{m}\x1f{side}") for side in ("<" + name[:h], ">" + name[len(name) - h :])]
    return sorted(set(out))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _subkeys(base: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([subkeys(bytes(b), n) for b, n in zip(base, name, strict=True)])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of each shard; they come in the order of shards."""
    shard, held = None, {}
    for batch in batches:
        where = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])).tolist() if len(where) else []
        for s, e in zip(cuts, [*cuts[1:], len(where)], strict=True):
            if where[s] != shard:
                if held:
                    yield shard, held
                shard, held = int(where[s]), {c: [] for c in batch.schema.names}
            for c in held:
                held[c] += batch.column(c).slice(s, e - s).to_pylist()
    if held:
        yield shard, held


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["kind", "shard", "payload", "row", "other"])


def _build(judged: bool):
    """Graphs of the rows of each shard; judged: also which of its rows repeat an earlier one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _by_shard(batches):
            keys, names, rows = held["key"], held["name"], held["row"]
            if not judged:
                first: dict[tuple[bytes, str], int] = {}
                for k, n, r in zip(keys, names, rows, strict=True):
                    first[k, n] = min(r, first.get((k, n), r))
                keys, names, rows = [k for k, _ in first], [n for _, n in first], list(first.values())
            g = Graph(keys, names, rows)
            out: list[tuple] = []
            if judged:
                earlier: dict[int, set[int]] = defaultdict(set)
                for i, n in zip(*(x.tolist() for x in g.search(keys, names)), strict=True):
                    if g.rows[n] < rows[i] and one_edit(names[i], g.names[n]):
                        earlier[rows[i]].add(int(g.rows[n]))
                unsure, state = {r for r, f in zip(rows, held["unsure"], strict=True) if f}, {}
                for row in sorted(set(rows)):
                    states = {state[o] for o in earlier[row]}
                    state[row] = REJECTED if None in states else OPEN if row in unsure or OPEN in states else None
                out += [(k, shard, None, row, None) for row, k in state.items() if k is not None]
                out += [(EDGE, shard, None, row, o) for row, k in state.items() if k == OPEN for o in earlier[row] if state[o] == OPEN]
                g.dead |= np.isin(g.rows, [row for row, k in state.items() if k == REJECTED])
            yield _records([(GRAPH, shard, g.pack(), None, None), *out])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which texts and rows a shard of accepted rows knows: equal keys, and names one edit from what the walks meet."""
    for batch in batches:
        texts, rows = [], []
        for i in range(batch.num_rows):
            kind, payload, asked = (batch.column(c)[i].as_py() for c in ("kind", "payload", "asked"))
            if kind == KEYS:
                held = {payload[j : j + DIGEST] for j in range(0, len(payload), DIGEST)}
                texts += [q["key"] for q in asked if q["key"] in held]
            else:
                g = Graph.unpack(payload)
                names = [q["name"] for q in asked]
                hits = zip(*(x.tolist() for x in g.search([q["key"] for q in asked], names)), strict=True)
                rows += {asked[q]["row"] for q, n in hits if one_edit(names[q], g.names[n])}
        yield pa.RecordBatch.from_arrays([pa.array(texts + [None] * len(rows), pa.binary()), pa.array([None] * len(texts) + rows, pa.int64())], ["text", "row"])


def _living(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            nodes = Graph.unpack(payload).living()
            yield pa.RecordBatch.from_arrays([pa.array([n[j] for n in nodes], t) for j, t in enumerate((pa.binary(), pa.string(), pa.int64()))], ["key", "name", "row"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([payload[i : i + DIGEST] for i in range(0, len(payload), DIGEST)], pa.binary())], ["text"])


def _bury(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, payload, rows in zip(*(batch.column(c).to_pylist() for c in ("shard", "payload", "rows")), strict=True):
            g = Graph.unpack(payload)
            g.dead |= np.isin(g.rows, rows or [])
            yield _records([(GRAPH, shard, g.pack(), None, None)])


class HistoryIndex:
    """The index of accepted rows under ``path``; rows are named by a number unique over all sources.

    The number of shards doubles with the index. Folders part a segment's shards, and a batch reads only the folders that
    its rows fall into.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows_per_shard: int = 4096, fan: int = 4, part: int = PART):
        self.spark, self.path, self.rows_per_shard, self.fan, self.part = spark, path or new_path(spark, "history"), rows_per_shard, fan, part
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self.state = {"depth": 0, "next": 0, "segments": []}
        if self._fs.exists(self._at("manifest.json")):
            self.state = json.loads(self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0])

    # -- storage

    def _commit(self, segments: list[dict], depth: int | None = None) -> None:
        """The manifest alone says which segments count, so a lost write leaves the index as it was; then old ones go."""
        old = [s["id"] for s in self.state["segments"] if s not in segments]
        self.state |= {"segments": segments, "depth": self.state["depth"] if depth is None else depth}
        out = self._fs.create(self._at("manifest.json"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        for n in old:
            self._fs.delete(self._at(f"segment={n}"), True)

    def _new(self) -> int:
        self.state["next"] += 1
        return self.state["next"] - 1

    def _read(self, kind: int, segments: list[int]) -> DataFrame:
        paths = [f"{self.path}/segment={n}" for n in segments]
        found = self.spark.read.option("basePath", self.path).schema("shard long, payload binary, row long, other long, segment int, kind int, folder int").parquet(*paths)
        return found.where(F.col("kind") == kind)

    def _write(self, records: DataFrame, n: int, mode: str = "overwrite") -> None:
        records.withColumn("folder", self._folder()).write.mode(mode).partitionBy("kind", "folder").parquet(f"{self.path}/segment={n}")

    def _folder(self) -> Column:
        return F.pmod("shard", F.lit(min(MOST_FOLDERS, 1 << max(0, self.state["depth"] - DEEP)))).cast("int")

    def _shard(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << self.state["depth"]))

    def _tasks(self) -> int:
        return max(1, min(1 << self.state["depth"], max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), (1 << self.state["depth"]) // 8)))

    # -- routing

    def _routes(self, nodes: DataFrame, hot: DataFrame | None, both: bool) -> DataFrame:
        """(shard, block, key, name, row, unsure): names by the key of their base; those of hot bases by subkeys (``both``: too)."""
        named = nodes.where(F.col("name").isNotNull()).select("base", "name", "row", F.coalesce("shared", F.lit(False)).alias("unsure"))
        if hot is None:
            routed = named.select(F.lit(0).alias("block"), F.col("base").alias("key"), "name", "row", "unsure")
        else:
            named = named.join(hot, "base", "left")
            block = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int").alias("block")
            plain = (named if both else named.where(F.col("parts").isNull())).select(block, F.col("base").alias("key"), "name", "row", "unsure")
            parted = named.where(F.col("parts").isNotNull()).select(F.lit(0).alias("block"), F.explode(_subkeys("base", "name")).alias("key"), "name", "row", F.lit(True).alias("unsure"))
            routed = plain.unionByName(parted)
        return routed.withColumn("shard", self._shard("key"))

    def _hot(self, nodes: DataFrame, n: int, key: str = "base") -> DataFrame | None:
        """(base, parts) of bases with more names than one graph may hold."""
        if n <= self.part:
            return None
        counts = nodes.where(F.octet_length(key) == DIGEST).groupBy(F.col(key).alias("base")).count()
        hot = stored(counts.where(F.col("count") > self.part).select("base", F.ceil(F.col("count") / self.part).alias("parts")), "hot")
        return None if hot.isEmpty() else hot

    # -- segments

    def _graphs(self, routed: DataFrame, n: int, judged: bool) -> None:
        columns = ["shard", "key", "name", "row", *(["unsure"] if judged else [])]
        self._write(routed.select(*columns).repartition(self._tasks(), "shard").sortWithinPartitions("shard", "row").mapInArrow(_build(judged), _RECORD), n)

    def _keys(self, texts: DataFrame, n: int) -> None:
        packed = texts.withColumn("shard", self._shard("text")).groupBy("shard").agg(F.listagg("text").alias("payload"))
        self._write(packed.select(F.lit(KEYS).alias("kind"), "shard", "payload", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("other")), n, "append")

    def _note_hot(self, hot: DataFrame | None, n: int) -> int:
        if hot is None:
            return 0
        self._write(hot.select(F.lit(HOT).alias("kind"), F.col("parts").alias("shard"), F.col("base").alias("payload"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("other")), n, "append")
        return 1

    def _merge(self, old: list[dict], depth: int) -> None:
        """One segment of several, parted by ``depth``; dead nodes do not go over."""
        ids, self.state["depth"], n = [s["id"] for s in old], depth, self._new()
        nodes = self._read(GRAPH, ids).select("payload").mapInArrow(_living, "key binary, name string, row long")
        total = sum(s["rows"] for s in old)
        hot = self._hot(nodes, total, "key")
        self._graphs(self._routes(nodes.select(F.col("key").alias("base"), "name", "row", F.lit(False).alias("shared")), hot, False), n, False)
        self._keys(self._read(KEYS, ids).select("payload").mapInArrow(_texts, "text binary"), n)
        known = self._note_hot(hot, n)
        for s in old:
            if s["hot"]:
                self._write(self._read(HOT, [s["id"]]).select("kind", "shard", "payload", "row", "other"), n, "append")
        self._commit([s for s in self.state["segments"] if s not in old] + [{"id": n, "rows": total, "hot": known + sum(s["hot"] for s in old)}], depth)

    def _compact(self) -> None:
        """``fan`` segments of one order of size become one, until no order has so many."""
        while True:
            orders = defaultdict(list)
            for s in self.state["segments"]:
                orders[int(math.log(max(s["rows"], 1), self.fan))].append(s)
            full = next((orders[k] for k in sorted(orders) if len(orders[k]) >= self.fan), None)
            if full is None:
                return
            self._merge(full, self.state["depth"])

    def _grow(self, n: int) -> None:
        """Shards for ``n`` rows more; where they would be too large, all segments are parted anew by twice as many or more."""
        total, depth = sum(s["rows"] for s in self.state["segments"]) + n, self.state["depth"]
        while total > 2 * self.rows_per_shard << depth:
            depth += 1
        if depth > self.state["depth"]:
            if self.state["segments"]:
                self._merge(list(self.state["segments"]), depth)
            self.state["depth"] = depth

    # -- batches

    @staticmethod
    def _nodes(rows: DataFrame, keep: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
        """(text, base, name, row, shared): the first row of each kind; shared: its text stands with other fields too."""
        alone = F.when(F.col("text").isNull() & F.col("name").isNull(), F.col("row"))
        # Kept, as it is read twice and its keys are made in Python.
        first = keep.stored(rows.groupBy(*by, "text", "base", "name", alone.alias("alone")).agg(F.min("row").alias("row")).drop("alone"), "first")
        many = first.where(F.col("text").isNotNull()).groupBy(*by, "text").count().where(F.col("count") > 1).select(*by, "text", F.lit(True).alias("shared"))
        return first.join(many, [*by, "text"], "left")

    def _sizes(self, nodes: DataFrame) -> tuple[int, bool]:
        """How many ``nodes`` there are, and whether any shares its text with other fields."""
        r = nodes.agg(F.count(F.lit(1)).alias("n"), F.count("shared").alias("shared")).first()
        return r.n, r.shared > 0

    def _asked(self, nodes: DataFrame, hot: DataFrame | None) -> DataFrame:
        """(kind, shard, asked, folder): what each shard is asked, in blocks that a task can hold."""
        texts = nodes.where(F.col("text").isNotNull()).select("text").distinct().select(F.lit(KEYS).alias("kind"), self._shard("text").alias("shard"), F.lit(0).alias("block"), F.struct(F.col("text").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("row")).alias("q"))
        held = [s["id"] for s in self.state["segments"] if s["hot"]]
        if held:
            known = self._read(HOT, held).select(F.col("payload").alias("base"), F.col("shard").alias("parts"))
            hot = (known.unionByName(hot) if hot is not None else known).groupBy("base").agg(F.max("parts").alias("parts"))
        near = self._routes(nodes, hot, True).select(F.lit(GRAPH).alias("kind"), "shard", "block", F.struct("key", "name", "row").alias("q"))
        return texts.unionByName(near).groupBy("kind", "shard", "block").agg(F.collect_list("q").alias("asked")).withColumn("folder", self._folder())

    def _known(self, nodes: DataFrame, hot: DataFrame | None, n: int) -> DataFrame:
        """(text, row) of ``nodes`` that the history knows."""
        asked = self._asked(nodes, hot)
        held = self.spark.read.option("basePath", self.path).schema("shard long, payload binary, kind int, folder int").parquet(*(f"{self.path}/segment={s['id']}" for s in self.state["segments"]))
        held = held.where(F.col("kind").isin(KEYS, GRAPH))
        if n <= BROADCAST_ROWS:
            # A small batch goes to the shards, and of many folders only those that it falls into are read.
            if self.state["depth"] > DEEP:
                held = held.where(F.col("folder").isin([r[0] for r in asked.select("folder").distinct().collect()]))
            asked = F.broadcast(asked)
        return held.join(asked.drop("folder"), ["kind", "shard"]).select("kind", "payload", "asked").mapInArrow(_answer, _KNOWN)

    def _take(self, nodes: DataFrame, n: int, hot: DataFrame | None, judged: bool, shared: bool, keep: Scratch) -> DataFrame:
        """``nodes`` as a segment of their own; (row, text) of those accepted."""
        at = self._new()
        self._graphs(self._routes(nodes, hot, False), at, judged)
        taken = nodes
        if judged:
            rejected = self._read(REJECTED, [at]).select("row")
            # Only texts that stand with several fields and parted bases leave a row open in its shard.
            if shared or hot is not None:
                open_ = self._read(OPEN, [at]).select("row").distinct().join(nodes, "row").select("row", "text")
                lone = nodes.where(F.col("shared") & F.col("name").isNull()).select("row", "text")
                late = self._settle(open_.unionByName(lone), self._read(EDGE, [at]).select("row", F.col("other").alias("id")).distinct(), keep)
                if late is not None:
                    rejected = keep.stored(rejected.unionByName(late), "rejected")
                    buried = self._routes(nodes.join(late, "row", "left_semi"), hot, False).groupBy("shard").agg(F.collect_list("row").alias("rows"))
                    graphs = self._read(GRAPH, [at]).select("shard", "payload").join(buried, "shard", "left").select("shard", "payload", "rows").mapInArrow(_bury, _RECORD)
                    at, old = self._new(), at
                    self._write(graphs, at)
                    self._fs.delete(self._at(f"segment={old}"), True)
            taken = nodes.join(rejected.distinct(), "row", "left_anti")
        counted = Observation()
        accepted = stored(taken.select("row", "text").observe(counted, F.count(F.lit(1)).alias("n")), "accepted")
        self._keys(accepted.where(F.col("text").isNotNull()).select("text").distinct(), at)
        self._commit([*self.state["segments"], {"id": at, "rows": counted.get["n"], "hot": self._note_hot(hot, at)}])
        self._compact()
        return accepted

    @staticmethod
    def _settle(open_: DataFrame, edges: DataFrame, keep: Scratch) -> DataFrame | None:
        """(row) of the open rows that repeat one accepted before them: by their text, or by an edge to an earlier one.

        Each round accepts the rows that are the first open ones of their text and have no edge to an earlier open row,
        and rejects what repeats them; the first open row of all is always among them.
        """
        group = F.coalesce("text", F.encode(F.concat(F.lit("#"), F.col("row").cast("string")), "utf-8"))
        open_, out = keep.stored(open_.select("row", group.alias("text")), "open"), []
        while not open_.isEmpty():
            sure = keep.stored(open_.groupBy("text").agg(F.min("row").alias("row")).join(edges.select("row").distinct(), "row", "left_anti"), "sure")
            same = open_.join(sure.select("text", F.col("row").alias("first")), "text").where("row <> first").select("row")
            out.append(keep.stored(same.unionByName(edges.join(sure.select(F.col("row").alias("id")), "id").select("row")).distinct(), "late"))
            gone = sure.select("row").unionByName(out[-1])
            open_ = keep.stored(open_.join(gone, "row", "left_anti"), "open")
            edges = keep.stored(edges.join(gone, "row", "left_anti").join(gone.select(F.col("row").alias("id")), "id", "left_anti"), "edges")
        return reduce(DataFrame.unionByName, out) if out else None

    def _accept(self, nodes: DataFrame, keep: Scratch) -> None:
        n, shared = self._sizes(nodes)
        if n:
            self._grow(n)
            self._take(nodes, n, self._hot(nodes.where(F.col("name").isNotNull()), n), False, shared, keep)

    def _accepted(self, nodes: DataFrame, keep: Scratch) -> DataFrame:
        n, shared = self._sizes(nodes)
        if not n:
            return nodes.select("row", "text")
        self._grow(n)
        hot = self._hot(nodes.where(F.col("name").isNotNull()), n)
        if self.state["segments"]:
            known = keep.stored(self._known(nodes, hot, n), "known")
            texts, near = known.select("text").where(F.col("text").isNotNull()).distinct(), known.select("row").where(F.col("row").isNotNull()).distinct()
            nodes = nodes.join(texts, "text", "left_anti").join(near, "row", "left_anti")
        return self._take(nodes, n, hot, True, shared, keep)

    def accept(self, rows: DataFrame) -> None:
        """Take ``rows`` (of ``keyed``) as accepted history without judging them."""
        with Scratch(self.spark, "accept") as keep:
            self._accept(keep.stored(self._nodes(rows, keep), "nodes"), keep)

    def judge(self, rows: DataFrame) -> DataFrame:
        """(source, row) of the rows that repeat an accepted row or an earlier new one; the others are accepted.

        Rows repeat if their texts are equal in comparison form, or if their bases are equal and their names one edit
        apart. Rows are taken in the order of ``row``. A null name is like no other; a null text is like none either.
        """
        with Scratch(self.spark, "batch") as keep:
            held = keep.stored(rows.select("source", "row", "text", "base", "name"), "rows")
            accepted = self._accepted(keep.stored(self._nodes(held, keep), "nodes"), keep).select("row")
            return stored(held.select("source", "row").join(accepted, "row", "left_anti").select("source", "row"), "repeats")


def repeated_rows(rows: DataFrame, batch: str = "batch_no", index: HistoryIndex | None = None) -> DataFrame:
    """(source, row) of the rows of batches 1 and later that repeat an accepted row; batch 0 is accepted history.

    rows: the columns of ``keyed`` and ``batch``. Batches come in their order, rows within them in the order of ``row``;
    rows without a batch are history too.
    """
    index = index or HistoryIndex(rows.sparkSession)
    rows = rows.withColumn("__batch", F.greatest(F.coalesce(F.col(f"`{batch}`").cast("long"), F.lit(0)), F.lit(0)))
    accepted = []
    # Every row is keyed once, and the copies within a batch are counted as one.
    with Scratch(rows.sparkSession, "first") as keep:
        nodes = stored(index._nodes(rows, keep, ("__batch",)), "nodes", by="__batch")
    for b in sorted(r[0] for r in nodes.select("__batch").distinct().collect()):
        with Scratch(rows.sparkSession, "batch") as keep:
            part = nodes.where(F.col("__batch") == b).drop("__batch")
            if b:
                accepted.append(index._accepted(part, keep).select("row"))
            else:
                index._accept(part, keep)
    asked = rows.where(F.col("__batch") > 0).select("source", "row")
    return asked.join(reduce(DataFrame.unionByName, accepted), "row", "left_anti").select("source", "row") if accepted else asked
