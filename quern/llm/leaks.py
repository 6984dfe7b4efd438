"""Held-out evaluation items inside training documents, found by winnowing.

Both sides are brought to comparison form (letters and digits, one character form and case). Of every ``w`` consecutive
k-grams the one of least hash is kept, with k + w - 1 = ``min_chars``; so every shared span of ``min_chars`` characters
holds a kept k-gram of both sides. Equal fingerprints are joined and each hit is extended to its whole span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.codes import Rolling, blocks, code_points, comparison_codes, winnow


def _codes(text: str) -> np.ndarray:
    return comparison_codes(code_points(text), text)


def longest_run(a: np.ndarray, p: int, b: np.ndarray, q: int) -> int:
    """Length of the longest equal run of two texts on the diagonal through a[p], b[q]."""
    back = min(p, q)
    n = min(len(a) - p, len(b) - q) + back
    equal = a[p - back : p - back + n] == b[q - back : q - back + n]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


class Index:
    """Fingerprints of a bounded set of texts, sorted by hash."""

    def __init__(self, ids: list, texts: list[str], min_chars: int, k: int):
        self.ids, self.min_chars, self.k = ids, min_chars, k
        self.parts = [_codes(t) for t in texts]
        rolling = Rolling(self.parts)
        hashes, inside = rolling.windows(k)
        at = winnow(hashes, inside, min_chars - k + 1)
        at = at[np.argsort(hashes[at], kind="stable")]
        self.hashes, self.owner = hashes[at], rolling.text_of(at)
        self.offset = at - rolling.starts[self.owner]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, number of the item, longest shared span) for every pair that shares ``min_chars``."""
        parts = [_codes(t) for t in texts]
        rolling = Rolling(parts)
        hashes, inside = rolling.windows(self.k)
        at = winnow(hashes, inside, self.min_chars - self.k + 1)
        left, right = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        hit = np.flatnonzero(right > left)
        best: dict[tuple[int, int], int] = {}
        seen: set[tuple[int, int, int]] = set()
        owners = rolling.text_of(at[hit])
        for j, n in zip(hit.tolist(), owners.tolist(), strict=True):
            p = int(at[j] - rolling.starts[n])
            for x in range(int(left[j]), int(right[j])):
                i, q = int(self.owner[x]), int(self.offset[x])
                if (n, i, p - q) not in seen:
                    seen.add((n, i, p - q))
                    run = longest_run(parts[n], p, self.parts[i], q)
                    if run >= self.min_chars:
                        best[n, i] = max(best.get((n, i), 0), run)
        for (n, i), run in best.items():
            yield n, i, run


def _grams(id_column: str, text_column: str, min_chars: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i, t) for i, t in zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist(), strict=True) if t)
            for ids, texts in blocks(rows):
                rolling = Rolling([_codes(t) for t in texts])
                hashes, inside = rolling.windows(k)
                at = winnow(hashes, inside, min_chars - k + 1)
                pairs = np.unique(np.stack([rolling.text_of(at), hashes[at].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array([ids[n] for n in pairs[0]], batch.schema.field(id_column).type)], ["gram", id_column])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_chars: int = 30, k: int = 15, most_item_chars: int = 4_000_000) -> DataFrame:
    """(``doc_id``, ``item_id``, shared_chars) for every document and item that share ``min_chars`` consecutive letters and digits.

    shared_chars is the longest such span. Null and blank texts share nothing; ids that repeat give one row a pair. The
    items' fingerprints go to every task while the items' texts hold at most ``most_item_chars`` characters; beyond that
    both sides' fingerprints are joined by a shuffle and each pair is read again. Both ways give the same rows. Only the
    two columns named of each side are read, so others may have any name.
    """
    if not 1 <= k <= min_chars:
        raise ValueError("k must lie between 1 and min_chars")
    left = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{doc_text}`").alias("doc_text"))
    right = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("item_text")).where(F.col("item_text").isNotNull()).distinct()
    doc_field, item_field = left.schema["doc"], right.schema["item"]
    out = T.StructType([T.StructField("doc", doc_field.dataType), T.StructField("item", item_field.dataType), T.StructField("shared_chars", T.IntegerType())])
    size = right.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if size <= most_item_chars:
        held = right.collect()
        index = docs.sparkSession.sparkContext.broadcast(Index([r.item for r in held], [r.item_text for r in held], min_chars, k))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.schema.field("doc").type
                for ids, texts in blocks((i, t) for i, t in zip(batch.column("doc").to_pylist(), batch.column("doc_text").to_pylist(), strict=True) if t):
                    if found := list(index.value.search(texts)):
                        yield pa.RecordBatch.from_pydict({"doc": pa.array([ids[n] for n, _, _ in found], kind), "item": [index.value.ids[i] for _, i, _ in found], "shared_chars": pa.array([run for _, _, run in found], pa.int32())})

        found = left.mapInArrow(search, out)
    else:
        gram = lambda df, i, t: df.mapInArrow(_grams(i, t, min_chars, k), T.StructType([T.StructField("gram", T.LongType()), df.schema[i]]))
        pairs = gram(left, "doc", "doc_text").join(gram(right, "item", "item_text"), "gram").select("doc", "item").distinct()

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                runs = [max((run for _, _, run in Index([0], [r["item_text"]], min_chars, k).search([r["doc_text"]])), default=0) for r in rows]
                kept = [i for i, run in enumerate(runs) if run]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(kept, pa.int64())), batch.column("item").take(pa.array(kept, pa.int64())), pa.array([runs[i] for i in kept], pa.int32())], ["doc", "item", "shared_chars"])

        found = pairs.join(right, "item").join(left.where(F.col("doc_text").isNotNull()), "doc").mapInArrow(verify, out)
    # A document whose row stands more than once, or an item of several texts, is one pair.
    return found.groupBy("doc", "item").agg(F.max("shared_chars").alias("shared_chars")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared_chars")
