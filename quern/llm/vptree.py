"""Most similar vectors by vantage-point trees over shards.

Vectors are points on the unit sphere and their distance is the angle, so the triangle inequality holds. Centres fitted
on a bounded sample part them into shards; every vector is indexed in one. A query visits a shard, and below it a branch
of the shard's tree, unless the angles to a vantage point prove that nothing there lies within its radius. The proof may
be relaxed: the margin is ``factor`` times the radius. With factor 1 the search is exact; in d dimensions the angles of
two vectors at distance r to a vantage point differ by about r / sqrt(d), so much smaller factors lose little.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import stored

#: Rows the centres are fitted on; rows of a shard; points of a leaf.
SAMPLE, SHARD_ROWS, LEAF = 20_000, 16_384, 384
#: Centres of the first level, and of a shard of the second, at most; rows of a shard that the second level is fitted on.
FIRST, SECOND, SECOND_SAMPLE = 256, 512, 4096
#: Parts of one shard at most; the number of a part is shard * PARTS + part.
PARTS = 1 << 16
_ROW = T.StructType([T.StructField("vid", T.LongType()), T.StructField("own", T.LongType()), T.StructField("raw", T.BinaryType())])
_CELL = T.StructType([T.StructField("own", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
_TASK = T.StructType([T.StructField("target", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("vid", T.LongType()), T.StructField("raw", T.BinaryType()), T.StructField("radius", T.FloatType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def usable(df: DataFrame, vid: str, vector: str) -> DataFrame:
    """(vid, v): vectors of the commonest length, all of finite numbers, not all zero."""
    kind = df.schema[vector].dataType
    v = F.col(f"`{vector}`").cast("array<float>" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "array<double>")
    rows = df.select(F.col(f"`{vid}`").cast("long").alias("vid"), v.alias("v")).where(F.col("vid").isNotNull() & F.col("v").isNotNull())
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where((F.size("v") == (length["n"] if length else 0)) & F.forall("v", good) & F.exists("v", lambda x: x != 0))
    if not df.groupBy(F.col(f"`{vid}`")).count().where("count > 1").isEmpty():
        # Of rows of one id, which are rare, one usable vector stays; the same one at every run.
        rows = rows.groupBy("vid").agg(F.min("v").alias("v"))
    return rows


def _matrix(column: pa.Array | list) -> np.ndarray:
    """Unit vectors in double precision out of their bytes, of which the first tells a number's width."""
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    if not raw:
        return np.empty((0, 0))
    width = raw[0][0]
    x = np.frombuffer(b"".join([r[1:] for r in raw]), f"<f{width}").reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def centres(sample: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 0] = sums[norm > 0] / norm[norm > 0][:, None]
    return c


class Tree:
    """A vantage-point tree; a vantage point is the centre of the points around one of them, a split is at the widest gap."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.f = x, x.astype(np.float32)
        self.root = self._grow(np.arange(len(x)), leaf, np.random.RandomState(len(x)))

    def _grow(self, at: np.ndarray, leaf: int, rng: np.random.RandomState) -> tuple:
        if len(at) <= leaf:
            return (at, np.ascontiguousarray(self.f[at].T))
        f = self.f[at]
        seeds = f[rng.choice(len(at), 12, replace=False)]
        spread = (seeds @ f[:: max(1, len(at) // 1024)].T).std(1)
        near = f @ seeds[spread.argmax()]
        c = f[np.argpartition(-near, len(at) // 10)[: len(at) // 10]].mean(0)
        if not (n := np.linalg.norm(c)) > 0:
            return (at, np.ascontiguousarray(f.T))
        c = c / n
        far = np.arccos(np.clip(f @ c, -1, 1))
        order = np.sort(far)
        lo, hi = len(at) // 16, len(at) * 5 // 8
        step = max(1, len(at) // 64)
        gaps = order[lo + step : hi + step] - order[lo:hi]
        cut = lo + int(gaps.argmax()) + step // 2
        inner = far <= order[cut]
        if inner.all() or not inner.any():
            return (at, np.ascontiguousarray(f.T))
        bounds = (float(far[inner].min()), float(far[inner].max()), float(far[~inner].min()), float(far[~inner].max()))
        return (c, bounds, self._grow(at[inner], leaf, rng), self._grow(at[~inner], leaf, rng))

    def within(self, q: np.ndarray, least: float, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, point, similarity) with a similarity of at least ``least``."""
        f, margin = q.astype(np.float32), factor * math.acos(least) + 1e-3
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if len(node) == 2:
                at, block = node
                for s in range(0, len(rows), 4096):
                    part = rows[s : s + 4096]
                    i, j = np.nonzero(f[part] @ block >= np.float32(least - 1e-5))
                    if len(i):
                        exact = np.einsum("ij,ij->i", q[part[i]], self.x[at[j]])
                        ok = exact >= least
                        yield part[i[ok]], at[j[ok]], exact[ok]
                continue
            c, (a, b, d, e), inner, outer = node
            far = np.arccos(np.clip(f[rows] @ c, -1, 1))
            stack.append((inner, rows[(far >= a - margin) & (far <= b + margin)]))
            stack.append((outer, rows[(far >= d - margin) & (far <= e + margin)]))

    def nearest(self, q: np.ndarray, radius: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query the similarities and places of the k most similar points within its radius, best first; -2 where there are fewer."""
        f = q.astype(np.float32)
        best = np.full((len(q), k), -2.0)
        place = np.full((len(q), k), -1)
        reach = radius.astype(np.float64).copy()
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, rows, gap = stack.pop()
            keep = gap <= factor * reach[rows] + 1e-3
            rows = rows[keep]
            if not len(rows):
                continue
            if len(node) == 2:
                at, block = node
                for s in range(0, len(rows), 1024):
                    part = rows[s : s + 1024]
                    near = (q[part] @ self.x[at].T) if len(at) * len(part) < 1 << 14 else (f[part] @ block).astype(np.float64)
                    take = min(k, len(at))
                    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    exact = np.einsum("ij,ikj->ik", q[part], self.x[at[top]])
                    every, where = np.concatenate([best[part], exact], 1), np.concatenate([place[part], at[top]], 1)
                    order = np.argsort(-every, 1, kind="stable")[:, :k]
                    best[part], place[part] = np.take_along_axis(every, order, 1), np.take_along_axis(where, order, 1)
                    reach[part] = np.minimum(reach[part], np.arccos(np.clip(best[part][:, -1], -1, 1)))
                continue
            c, (a, b, d, e), inner, outer = node
            far = np.arccos(np.clip(f[rows] @ c, -1, 1))
            gi, go = np.maximum(0, np.maximum(a - far, far - b)), np.maximum(0, np.maximum(d - far, far - e))
            # The branch that is nearer for most queries comes first and shrinks their reach for the other.
            pair = [(inner, rows, gi), (outer, rows, go)]
            stack.extend(pair if (gi > go).mean() > 0.5 else pair[::-1])
        return best, place


class Reach:
    """What tells which cells a query may leave out: centres, counts, and ranges of angles of shards and of their cells.

    A shard is one cell, or, where it holds too many rows, as many as it has centres of the second level. A cell that
    still holds too many (copies of one vector, say) is parted by the hash of the id, so no task holds more than about
    twice ``shard_rows`` points.
    """

    def __init__(self, centres: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, shard_rows: int):
        self.centres, self.n, self.lo, self.hi, self.shard_rows = centres, n, lo, hi, shard_rows
        self.cells: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]] = [(None, np.zeros(1), np.full(1, math.pi))] * len(n)
        self.parts = [np.maximum(1, -(-n[i : i + 1] // (2 * shard_rows))) for i in range(len(n))]

    def divide(self, shard: int, centres: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.cells[shard] = (centres, lo, hi)
        self.parts[shard] = np.maximum(1, -(-n // (2 * self.shard_rows)))

    def width(self) -> int:
        return int(sum(p.sum() for p in self.parts))

    def shards(self, x: np.ndarray, margin: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which shards a query's margin reaches, by its angle to each shard's centre and to its own."""
        far = angles(x, self.centres)
        m = margin[:, None] + 1e-3
        ok = (far >= np.diag(self.lo)[None] - m) & (far <= np.diag(self.hi)[None] + m)
        mine = far[np.arange(len(x)), own][:, None]
        return ok & (mine >= self.lo.T[own] - m) & (mine <= self.hi.T[own] + m) & (self.n > 0)[None]

    def cell(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The cell, within its shard, of each vector."""
        out = np.zeros(len(own), np.int64)
        for shard in np.unique(own).tolist():
            if (c := self.cells[shard][0]) is not None:
                at = np.flatnonzero(own == shard)
                out[at] = (x[at] @ c.T).argmax(1)
        return out

    def place(self, own: np.ndarray, cell: np.ndarray, vid: np.ndarray) -> np.ndarray:
        """The task of each vector: its shard, cell and part."""
        out = np.empty(len(own), np.int64)
        for shard in np.unique(own).tolist():
            at, parts = np.flatnonzero(own == shard), self.parts[shard]
            first = np.cumsum(parts) - parts
            out[at] = shard * PARTS + first[cell[at]] + vid[at] % parts[cell[at]]
        return out

    def tasks(self, x: np.ndarray, ok: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(shard, cell, tasks, queries) for the cells that the queries' margins reach among the shards ``ok``."""
        for shard in np.flatnonzero(ok.any(0)).tolist():
            hit = np.flatnonzero(ok[:, shard])
            c, lo, hi = self.cells[shard]
            near = None
            if c is not None:
                far, m = angles(x[hit], c), margin[hit][:, None] + 1e-3
                near = (far >= lo[None] - m) & (far <= hi[None] + m)
            first = shard * PARTS
            for cell, parts in enumerate(self.parts[shard].tolist()):
                rows = hit if near is None else hit[near[:, cell]]
                if len(rows):
                    yield shard, cell, np.arange(first, first + parts), rows
                first += parts


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Tree, pa.RecordBatch]]:
    """(ids, tree, queries) for each run of queries to one part, whose points came before them."""
    target, ids, raw, tree = None, [], [], None
    for batch in batches:
        where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(where):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])]))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
            part = batch.slice(s, e - s)
            if where[s] != target:
                target, ids, raw, tree = int(where[s]), [], [], None
            if kind[s] == 0:
                ids.extend(part.column(2).to_pylist())
                raw.extend(part.column(3).to_pylist())
            elif tree is not None or ids:
                if tree is None:
                    tree, ids, raw = Tree(_matrix(raw)), np.array(ids), []
                yield ids, tree, part


class VantageIndex:
    """Shards of the usable vectors of a table: their centres, counts and ranges of angles, and the vectors themselves.

    Centres are fitted on at most ``SAMPLE`` vectors, those of the smallest hash of their id, and those of a shard's cells
    on at most ``SECOND_SAMPLE`` of its own; every vector is indexed. What reaches the driver and the tasks is bounded by
    that sample, by the square of the ``FIRST`` centres, and by ``SECOND`` centres for each of them.
    """

    def __init__(self, df: DataFrame, vid: str, vector: str, shard_rows: int = SHARD_ROWS, least_shards: int = 12):
        rows = usable(df, vid, vector)
        pack = F.col("v")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1)
                x = np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.empty((0, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes([x.itemsize]) + r.tobytes() for r in x], pa.binary())], ["vid", "raw"])

        plain = rows.select("vid", pack).mapInArrow(packed, T.StructType([_ROW["vid"], _ROW["raw"]]))
        held = plain.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).collect()
        total = rows.count() if len(held) == SAMPLE else len(held)
        self.empty = not held
        if self.empty:
            return
        sample = _matrix([bytes(r.raw) for r in held])
        count = min(FIRST, len(held), max(least_shards, total // shard_rows))
        c = centres(sample, count)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                own = (x @ c.T).argmax(1) if len(x) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), batch.column(1)], ["vid", "own", "raw"])

        self.rows = stored(plain.mapInArrow(assign, _ROW), "vectors")
        facts = T.StructType([T.StructField("own", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lo", T.ArrayType(T.DoubleType())), T.StructField("hi", T.ArrayType(T.DoubleType()))])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, lo, hi = np.zeros(count, np.int64), np.full((count, count), 9.0), np.full((count, count), -9.0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                far, own = angles(_matrix(batch.column(2)), c), batch.column(1).to_numpy()
                np.add.at(n, own, 1)
                np.minimum.at(lo, own, far)
                np.maximum.at(hi, own, far)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(lo[at]), pa.list_(pa.float64())), pa.array(list(hi[at]), pa.list_(pa.float64()))], ["own", "n", "lo", "hi"])

        each = self.rows.mapInArrow(ranges, facts)
        sized = each.groupBy("own").agg(F.sum("n").alias("n"))
        lows = each.select("own", F.posexplode(F.arrays_zip("lo", "hi"))).groupBy("own", "pos").agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"))
        n, lo, hi = np.zeros(count, np.int64), np.full((count, count), 9.0), np.full((count, count), -9.0)
        for r in sized.collect():
            n[r.own] = r.n
        for r in lows.collect():
            lo[r.own, r.pos], hi[r.own, r.pos] = r.lo, r.hi
        self.reach = Reach(c, n, lo, hi, shard_rows)
        if (n > 2 * shard_rows).any():
            self._divide(n, shard_rows)

    def _divide(self, n: np.ndarray, shard_rows: int) -> None:
        """Cells for the shards that hold too many rows."""
        reach, wanted = self.reach, {i: int(min(SECOND, -(-n[i] // shard_rows))) for i in np.flatnonzero(n > 2 * shard_rows).tolist()}
        big = self.rows.where(F.col("own").isin(list(wanted)))
        order = F.row_number().over(Window.partitionBy("own").orderBy(F.xxhash64("vid"), "vid"))
        sample = big.withColumn("place", order).where(F.col("place") <= SECOND_SAMPLE).select("own", "raw")

        def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(frame["raw"].tolist())
            return pd.DataFrame({"own": [key[0]], "centres": [centres(x, min(len(x), wanted[key[0]])).tobytes()]})

        for r in sample.groupBy("own").applyInPandas(fit, "own long, centres binary").collect():
            c = np.frombuffer(bytes(r.centres), float).reshape(-1, reach.centres.shape[1])
            reach.divide(r.own, c, np.ones(len(c), np.int64), np.zeros(len(c)), np.full(len(c), math.pi))
        shared = self.rows.sparkSession.sparkContext.broadcast(reach)

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = _matrix(batch.column(2)), batch.column(1).to_numpy()
                if not len(own):
                    continue
                cell = shared.value.cell(x, own)
                far = np.array([math.acos(min(1.0, max(-1.0, float(v @ shared.value.cells[s][0][k])))) for v, s, k in zip(x, own.tolist(), cell.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(cell), pa.array(np.ones(len(own), np.int64)), pa.array(far), pa.array(far)], _CELL.names)

        facts: dict[int, list] = {}
        for r in big.mapInArrow(ranges, _CELL).groupBy("own", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            facts.setdefault(r.own, []).append(r)
        for own, rows in facts.items():
            k = len(reach.cells[own][0])
            count, lo, hi = np.zeros(k, np.int64), np.full(k, 9.0), np.full(k, -9.0)
            for r in rows:
                count[r.cell], lo[r.cell], hi[r.cell] = r.n, r.lo, r.hi
            reach.divide(own, reach.cells[own][0], count, lo, hi)

    def _points(self) -> DataFrame:
        shared = self._shared()

        def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, vid, reach = batch.column(1).to_numpy(), batch.column(0).to_numpy(), shared.value
                place = reach.place(own, reach.cell(_matrix(batch.column(2)), own), vid)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.zeros(len(own), np.int8)), batch.column(0), batch.column(2), pa.array(np.zeros(len(own), np.float32))], _TASK.names)

        return self.rows.mapInArrow(points, _TASK)

    def _shared(self):
        return self.rows.sparkSession.sparkContext.broadcast(self.reach)

    def _tasks(self, tasks: DataFrame) -> DataFrame:
        """Points of a part before the queries to it, part by part; queries stream past the part's tree."""
        return tasks.repartition(max(1, 3 * self.reach.width()), "target").sortWithinPartitions("target", "kind")

    def pairs(self, least: float, factor: float = 1.0) -> DataFrame:
        """(a, b, similarity), a < b, of the pairs with a cosine similarity of at least ``least``."""
        shared, radius = self._shared(), math.acos(least)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, vid, reach = batch.column(1).to_numpy(), batch.column(0).to_numpy(), shared.value
                if not len(own):
                    continue
                x, margin = _matrix(batch.column(2)), np.full(len(own), factor * radius)
                mine = reach.place(own, reach.cell(x, own), vid)
                rows, targets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for _, _, places, hit in reach.tasks(x, reach.shards(x, margin, own), margin):
                    for t in places.tolist():
                        # Of two parts the lower asks the higher; within a part all ask all.
                        rows.append(hit[mine[hit] <= t])
                        targets.append(np.full(len(rows[-1]), t))
                r = np.concatenate(rows)
                order = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(targets)), pa.array(np.ones(len(r), np.int8)), batch.column(0).take(order), batch.column(2).take(order), pa.array(np.zeros(len(r), np.float32))], _TASK.names)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, tree, part in _streams(batches):
                asked = part.column(2).to_numpy()
                for q, p, s in tree.within(_matrix(part.column(3)), least, factor):
                    a, b = asked[q], ids[p]
                    # A pair within one part is met from both sides.
                    ok = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(s[ok])], _PAIR.names)

        return self._tasks(self._points().unionByName(self.rows.mapInArrow(ask, _TASK))).mapInArrow(answer, _PAIR).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    def nearest(self, queries: DataFrame, k: int = 10, factor: float = 0.3) -> DataFrame:
        """(a, b, similarity, rank): for each of ``queries`` (rows of this index) its k most similar other vectors.

        A first search in the query's own cell gives the radius of the second, which visits the others within reach.
        """
        shared = self._shared()

        def ask(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own, reach = batch.column(1).to_numpy(), shared.value
                    if not len(own):
                        continue
                    x = _matrix(batch.column(2))
                    cell = reach.cell(x, own)
                    radius = np.full(len(own), math.pi) if first else batch.column(3).to_numpy().astype(float)
                    if first:
                        ok = np.zeros((len(own), len(reach.n)), bool)
                        ok[np.arange(len(own)), own] = True
                    else:
                        ok = reach.shards(x, factor * radius, own)
                    rows, targets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                    for shard, k, places, hit in reach.tasks(x, ok, radius if first else factor * radius):
                        home = (own[hit] == shard) & (cell[hit] == k)
                        hit = hit[home if first else ~home]
                        rows += [hit] * len(places)
                        targets += [np.full(len(hit), t) for t in places.tolist()]
                    r = np.concatenate(rows)
                    order = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(targets)), pa.array(np.ones(len(r), np.int8)), batch.column(0).take(order), batch.column(2).take(order), pa.array(radius[r].astype(np.float32))], _TASK.names)

            return run

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, tree, part in _streams(batches):
                asked = part.column(2).to_numpy()
                # One more than k, as a query meets itself.
                best, place = tree.nearest(_matrix(part.column(3)), part.column(4).to_numpy(), k + 1, factor)
                q, j = np.nonzero(place >= 0)
                a, b = asked[q], ids[place[q, j]]
                ok = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(best[q, j][ok])], _PAIR.names)

        search = lambda asked: self._tasks(self._points().unionByName(asked)).mapInArrow(answer, _PAIR)
        top = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).where(F.col("rank") <= k)
        asked = queries.select("vid", "own", "raw")
        first = stored(search(asked.mapInArrow(ask(True), _TASK)), "first")
        # Fewer than k in the own cell leave the radius open.
        radius = top(first).groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.acos(F.least(F.min("similarity"), F.lit(1.0)))).otherwise(math.pi).alias("radius"))
        second = asked.join(radius, asked["vid"] == radius["a"], "left").select("vid", "own", "raw", F.coalesce("radius", F.lit(math.pi)).cast("float").alias("radius"))
        return top(first.unionByName(search(second.mapInArrow(ask(False), _TASK))))


def similar_pairs(df: DataFrame, vid: str, vector: str, least: float = 0.9, factor: float = 1.0) -> DataFrame:
    """(``vid``_a, ``vid``_b, similarity), a < b, of vectors with a cosine similarity of at least ``least``.

    Null, all-zero, non-finite and odd-length vectors, and those without an id, are in no pair; rows of one id are one vector and make no pair with
    themselves; an empty table gives none. Lengths do not matter. Only the two columns named are read.
    """
    index = VantageIndex(df, vid, vector)
    if index.empty:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(f"{vid}_a", T.LongType()), T.StructField(f"{vid}_b", T.LongType()), _PAIR["similarity"]]))
    return index.pairs(least, factor).select(F.col("a").alias(f"{vid}_a"), F.col("b").alias(f"{vid}_b"), "similarity")


def most_similar(df: DataFrame, vid: str, vector: str, every: int = 100, k: int = 10, factor: float = 0.3) -> DataFrame:
    """(``vid``, other, similarity, rank): the k most similar other vectors of each vector whose id is divisible by ``every``.

    The queries go against all usable vectors; ``every`` = 1 asks for each. Ties are ranked by id.
    """
    index = VantageIndex(df, vid, vector)
    if index.empty:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(vid, T.LongType()), T.StructField("other", T.LongType()), _PAIR["similarity"], T.StructField("rank", T.IntegerType())]))
    return index.nearest(index.rows.where(F.col("vid") % every == 0), k, factor).select(F.col("a").alias(vid), F.col("b").alias("other"), "similarity", "rank")
