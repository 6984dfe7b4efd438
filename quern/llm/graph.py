"""Navigable small-world graphs over short names: building, walks in beams and the choice of the beam.

A node is a name under a key (what must be equal between two rows). Links lead to the nearest nodes of the same key, to
nodes of whose nearest it is one, to a few far ones, and to the neighbours in the order of the names and of the names
read backwards. Every search is a walk, whatever the size of a key: it enters at the places where the query would stand
in both orders and at evenly spread nodes, and goes on from the nearest nodes it has met. All walks of a shard advance
together in arrays.
"""

from __future__ import annotations

import pickle
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np

#: Links of a node: its nearest nodes, nodes of whose nearest it is one, far ones, and two in each of the two orders.
NEAR, BACK, FAR, ORDER = 12, 4, 2, 4
WIDTH = NEAR + BACK + FAR + ORDER
DIMS = 64
#: A character that may not differ counts this often, so that siblings which differ in a numeral lie far apart.
WEIGHT = 3
#: Two names one edit apart lie within this distance.
REACH = 2
#: Spread entries of a walk, and entries around its place in each order.
SPREAD, AROUND = 6, 4
#: Walks that advance together, and nodes that one of them expands in one step.
TOGETHER, STEP = 512, 6
#: Characters in which two names may not differ: digits, Latin letters and these.
NUMERALS = frozenset("〇零一二三四五六七八九十百千萬億")


@lru_cache(1 << 16)
def fixed(c: str) -> bool:
    return c.isdigit() or c in NUMERALS or unicodedata.name(c, "").startswith("LATIN")


def one_edit(a: str, b: str) -> bool:
    """Equal, or different by one inserted, dropped or replaced character that is none of the fixed ones."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] and not fixed(a[i]) and not fixed(b[i])
    return a[i:] == b[i + 1 :] and not fixed(b[i])


_weight = np.zeros(0x110000, np.int8)


def vectors(names: list[str]) -> np.ndarray:
    """Weighted counts of characters, hashed to ``DIMS`` places; one edit moves a name by at most ``REACH``."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    weight = _weight[codes]
    if not weight.all():
        for code in np.unique(codes[weight == 0]).tolist():
            _weight[code] = WEIGHT if fixed(chr(code)) else 1
        weight = _weight[codes]
    spot = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)
    at = np.repeat(np.arange(len(names)) * DIMS, lengths) + spot
    # Names of more than 60 like characters are told apart by the exact comparison alone.
    return np.minimum(np.bincount(at, weight, len(names) * DIMS), 60).astype(np.int8).reshape(-1, DIMS)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).sum(-1, dtype=np.int32)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """The place of each element within its run of equal elements."""
    n = len(sorted_)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if n else np.empty(0, np.int64)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


class Graph:
    """The nodes of a shard, sorted by key and name. A dead node leads on but is never found."""

    def __init__(self, keys: list[bytes], names: list[str], rows: list[int]):
        order = sorted(range(len(keys)), key=lambda i: (keys[i], names[i]))
        keys = [keys[i] for i in order]
        self.names = [names[i] for i in order]
        self.rows = np.array([rows[i] for i in order], np.int64)
        self.dead = np.zeros(len(order), bool)
        self.begin = np.array([i for i, k in enumerate(keys) if not i or k != keys[i - 1]], np.int64)
        self.keys = [keys[i] for i in self.begin.tolist()]
        self.vectors = vectors(self.names)
        self.back = np.array([i for b, e in self._spans() for i in sorted(range(b, e), key=lambda i: self.names[i][::-1])], np.int64)
        self._open()
        self.links = self._build()
        self.beam = self._tune()

    def _spans(self) -> list[tuple[int, int]]:
        return list(zip(self.begin.tolist(), [*self.begin[1:].tolist(), len(self.names)], strict=True)) if len(self.begin) else []

    def _open(self) -> None:
        self.size = np.diff(np.append(self.begin, len(self.names))) if len(self.begin) else np.empty(0, np.int64)
        self.place = {k: i for i, k in enumerate(self.keys)}
        self.backward = [self.names[i][::-1] for i in self.back.tolist()]

    def pack(self) -> bytes:
        small = np.int16 if len(self.names) < 1 << 15 else np.int32
        return pickle.dumps((b"".join(len(k).to_bytes(1, "big") + k for k in self.keys), self.begin.tobytes(), "\0".join(self.names).encode("utf-8", "surrogatepass"), self.rows.tobytes(), self.dead.tobytes(), self.vectors.tobytes(), small().itemsize, self.links.astype(small).tobytes(), self.back.astype(small).tobytes(), self.beam), 5)

    @classmethod
    def unpack(cls, payload: bytes) -> Graph:
        g = cls.__new__(cls)
        keys, begin, names, rows, dead, vecs, width, links, back, g.beam = pickle.loads(payload)
        small = np.int16 if width == 2 else np.int32
        g.begin, g.rows, g.dead = np.frombuffer(begin, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(dead, bool).copy()
        g.names = names.decode("utf-8", "surrogatepass").split("\0") if len(g.rows) else []
        g.vectors = np.frombuffer(vecs, np.int8).reshape(-1, DIMS)
        g.links, g.back = np.frombuffer(links, small).reshape(-1, WIDTH), np.frombuffer(back, small)
        g.keys, at = [], 0
        while at < len(keys):
            g.keys.append(keys[at + 1 : at + 1 + keys[at]])
            at += 1 + keys[at]
        g._open()
        return g

    def living(self) -> list[tuple[bytes, str, int]]:
        """(key, name, row) of the nodes that are not dead."""
        owner = np.repeat(np.arange(len(self.keys)), self.size)
        return [(self.keys[owner[i]], self.names[i], int(self.rows[i])) for i in np.flatnonzero(~self.dead).tolist()]

    def _build(self) -> np.ndarray:
        n_all = len(self.names)
        links = np.full((n_all, WIDTH), -1, np.int32)
        exact = self.vectors.astype(np.float32)
        norm = (exact**2).sum(1)
        rng = np.random.RandomState(1)
        for b, e in self._spans():
            n = e - b
            if n < 2:
                continue
            if n <= NEAR + 1:
                # Of few nodes each is a neighbour of all.
                every = np.broadcast_to(np.arange(b, e), (n, n))
                links[b:e, : n - 1] = every[~np.eye(n, dtype=bool)].reshape(n, n - 1)
                continue
            space = np.empty((n, NEAR), np.float32)
            # A key's nodes in one graph are bounded, so its nearest neighbours are found exactly, a block of rows at a time.
            for s in range(b, e, 512):
                t = min(s + 512, e)
                # Squared distances: one product a block instead of a difference a dimension.
                far = norm[None, b:e] - 2 * (exact[s:t] @ exact[b:e].T)
                far[np.arange(t - s), np.arange(s, t) - b] = np.inf
                near = np.argpartition(far, NEAR - 1, axis=1)[:, :NEAR]
                links[s:t, :NEAR] = near + b
                space[s - b : t - b] = np.take_along_axis(far, near, 1)
            links[b:e, NEAR + BACK : NEAR + BACK + FAR] = rng.randint(b, e, (n, FAR))
            # Links back keep every node within reach of its neighbours; the nearest ones come first.
            to, by = links[b:e, :NEAR].ravel(), np.repeat(np.arange(b, e), NEAR)
            order = np.lexsort((by, space.ravel(), to))
            to, by = to[order], by[order]
            slot = _runs(to)
            kept = slot < BACK
            links[to[kept], NEAR + slot[kept]] = by[kept]
            at = WIDTH - ORDER
            links[b + 1 : e, at] = np.arange(b, e - 1)
            links[b : e - 1, at + 1] = np.arange(b + 1, e)
            links[self.back[b + 1 : e], at + 2] = self.back[b : e - 1]
            links[self.back[b : e - 1], at + 3] = self.back[b + 1 : e]
        return links

    def exhaustive(self, keys: list[bytes], names: list[str]) -> set[tuple[int, int]]:
        """(query, node) of all nodes within ``REACH``: what a walk is measured by."""
        v, out = vectors(names), set()
        for q, k in enumerate(keys):
            if (i := self.place.get(k, -1)) >= 0:
                b = int(self.begin[i])
                out |= {(q, b + int(n)) for n in np.flatnonzero(_far(self.vectors[b : b + int(self.size[i])], v[q]) <= REACH)}
        return out

    def search(self, keys: list[bytes], names: list[str], beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) for the nodes within ``REACH`` that the walks meet; the caller ranks them exactly."""
        at = np.array([self.place.get(k, -1) for k in keys], np.int64)
        known = np.flatnonzero(at >= 0)
        q_out, n_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(known):
            v = vectors(names)
            # Walks over keys of a like size go together, as they share the width of what they have seen.
            known = known[np.argsort(self.size[at[known]], kind="stable")]
            for s in range(0, len(known), TOGETHER):
                part = known[s : s + TOGETHER]
                q, n = self._walk([names[i] for i in part.tolist()], at[part], v[part], beam or self.beam)
                q_out.append(part[q])
                n_out.append(n)
        return np.concatenate(q_out), np.concatenate(n_out)

    def _entries(self, names: list[str], at: np.ndarray) -> np.ndarray:
        begin, size = self.begin[at], self.size[at]
        out = np.empty((len(names), SPREAD + 2 * AROUND), np.int64)
        out[:, :SPREAD] = begin[:, None] + (np.arange(SPREAD) * size[:, None]) // SPREAD
        around = np.arange(AROUND) - AROUND // 2
        fore = np.fromiter((bisect_left(self.names, n, b, b + s) for n, b, s in zip(names, begin.tolist(), size.tolist(), strict=True)), np.int64, len(names))
        back = np.fromiter((bisect_left(self.backward, n[::-1], b, b + s) for n, b, s in zip(names, begin.tolist(), size.tolist(), strict=True)), np.int64, len(names))
        last = (begin + size - 1)[:, None]
        out[:, SPREAD : SPREAD + AROUND] = np.clip(fore[:, None] + around, begin[:, None], last)
        out[:, SPREAD + AROUND :] = self.back[np.clip(back[:, None] + around, begin[:, None], last)]
        return out

    def _walk(self, names: list[str], at: np.ndarray, v: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        begin, width = self.begin[at], int(self.size[at].max())
        seen, writer = np.zeros(len(names) * width, bool), np.empty(len(names) * width, np.int32)
        entries = self._entries(names, at)
        row, node = np.repeat(np.arange(len(names)), entries.shape[1]), entries.ravel()
        spot = row * width + node - begin[row]
        q_hit, n_hit = [], []

        def met(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            # Of several ways to one node the last one counts.
            order = np.arange(len(spot), dtype=np.int32)
            writer[spot] = order
            spot = spot[writer[spot] == order]
            seen[spot] = True
            r = spot // width
            n = spot - r * width + begin[r]
            d = _far(self.vectors[n], v[r])
            q_hit.append(r[d <= REACH])
            n_hit.append(n[d <= REACH])
            return r, n, d

        row, node, far = met(spot)
        done = np.zeros(len(row), bool)
        while True:
            order = np.lexsort((far, row))
            order = order[_runs(row[order]) < beam]
            row, node, far, done = row[order], node[order], far[order], done[order]
            rest = np.flatnonzero(~done)
            rest = rest[_runs(row[rest]) < STEP]
            if not len(rest):
                break
            done[rest] = True
            near = self.links[node[rest]]
            ok = near >= 0
            r = np.repeat(row[rest], ok.sum(1))
            spot = r * width + near[ok] - begin[r]
            r, n, d = met(spot[~seen[spot]])
            row, node, far, done = np.concatenate([row, r]), np.concatenate([node, n]), np.concatenate([far, d]), np.concatenate([done, np.zeros(len(r), bool)])
        q, n = np.concatenate(q_hit), np.concatenate(n_hit)
        alive = ~self.dead[n]
        return q[alive], n[alive]

    def _tune(self, sample: int = 48, least: int = 8, widen: int = 2) -> int:
        """The beam, doubled until sampled walks meet every node that exhaustive search finds, and then widened."""
        large = np.flatnonzero(np.repeat(self.size, self.size) > least) if len(self.size) else np.empty(0, np.int64)
        if not len(large):
            return least * widen
        picks = large[np.linspace(0, len(large) - 1, min(sample, len(large))).astype(int)].tolist()
        owner = np.searchsorted(self.begin, picks, "right") - 1
        keys, names = [self.keys[i] for i in owner.tolist()], [self.names[i] for i in picks]
        want, beam, most = self.exhaustive(keys, names), least, int(self.size.max())
        while beam < most and not want <= set(zip(*(x.tolist() for x in self.search(keys, names, beam)), strict=True)):
            beam *= 2
        return beam * widen
