"""What needs a model, behind small protocols with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, messages: list[dict[str, str]]) -> str: ...

    def healthy(self) -> bool: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashes of character pairs, of unit length; equal texts get equal vectors on every machine."""

    dims: int = 64

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for a, b in zip(text, text[1:] + " "):
                h = int.from_bytes(hashlib.blake2b((a + b).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


@dataclass(frozen=True)
class LexicalReranker:
    """The share of a query's distinct characters, letters and digits, that the text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            want = {c for c in query.lower() if c.isalnum()}
            out.append(len(want & set(text.lower())) / len(want) if want else 0.0)
        return out


@dataclass(frozen=True)
class SilentGenerator:
    """Answers nothing; the rule-made text stands."""

    def generate(self, messages: list[dict[str, str]]) -> str:
        return ""

    def healthy(self) -> bool:
        return True


def with_retry(call: Callable[[], str], tries: int = 2, pause: float = 2.0, errors: tuple[type[Exception], ...] = (OSError,)) -> str:
    """The call's result; on one of ``errors`` again after a pause, at most ``tries`` times in all."""
    for n in range(1, tries + 1):
        try:
            return call()
        except errors:
            if n == tries:
                raise
            time.sleep(pause)
    raise ValueError("tries must be at least 1")


def embedding(embedder: Embedder, text: Column, batch: int = 64, pause: float = 0.0) -> Column:
    """The embeddings of a text column, ``batch`` texts a call and ``pause`` seconds between calls; null texts get null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            out: list = [None] * len(s)
            held = [i for i, t in enumerate(s) if t is not None]
            for at in range(0, len(held), batch):
                part = held[at : at + batch]
                for i, v in zip(part, np.asarray(embedder.embed([s.iloc[i] for i in part]), np.float32), strict=True):
                    out[i] = v
                if pause and at + batch < len(held):
                    time.sleep(pause)
            yield pd.Series(out)

    return run(text)


def with_scores(df: DataFrame, reranker: Reranker, query: str, text: str, out: str, batch: int = 64) -> DataFrame:
    """``df`` with the reranker's score of (query, text); nulls are scored as empty texts, empty batches not at all."""

    @F.pandas_udf(T.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
        scores: list[float] = []
        for at in range(0, len(pairs), batch):
            scores += [float(x) for x in reranker.score(pairs[at : at + batch])]
        return pd.Series(scores, dtype="float64")

    return df.withColumn(out, run(F.col(query), F.col(text)))


def generated(df: DataFrame, generator: Generator, messages: str, out: str) -> DataFrame:
    """``df`` with the generator's answer to an array of (role, content)."""

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ms: generator.generate([dict(m) for m in ms]), na_action="ignore")

    return df.withColumn(out, run(F.col(messages)))


def stream_tokens(lines: Iterator[str]) -> Iterator[str]:
    """The pieces of a streamed answer: one JSON object a line, blank and broken lines skipped, up to the one that says done."""
    import json

    for line in lines:
        if not line.strip():
            continue
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if piece := (event.get("message") or {}).get("content"):
            yield piece
        if event.get("done"):
            return
