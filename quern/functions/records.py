"""JSON of any depth as lines of ``path: value``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def flattened(value: object) -> list[tuple[str, object]]:
    """(path, scalar) in the order of the document. Keys are joined by dots, places stand in brackets; empty containers vanish."""
    out: list[tuple[str, object]] = []
    stack: list[tuple[str, object]] = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            inner = [(f"{path}.{k}" if path else str(k), x) for k, x in v.items()]
        elif isinstance(v, list):
            inner = [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        else:
            out.append((path, v))
            continue
        stack.extend(reversed(inner))
    # A key that comes twice keeps its first place and its last value.
    return list(dict(out).items())


def _body(value: object) -> str:
    return "\n".join(f"{k}: {v}" for k, v in flattened(value))


def is_json_lines(text: str) -> bool:
    """Whether the first lines, up to five whole ones, are JSON each and there is more than one."""
    lines = [x for x in text.strip().splitlines()[:6] if x.strip()]
    if len(lines) < 2:
        return False
    try:
        for line in lines[:5]:
            json.loads(line)
    except ValueError:
        return False
    return True


def rendered(text: str) -> str:
    """A JSON file as text: a numbered block a record or item, a bare body for one object, the text itself if it is no JSON.

    Records are numbered by their physical line, also across lines that are skipped.
    """
    if is_json_lines(text):
        blocks = []
        for n, line in enumerate(text.splitlines(), 1):
            try:
                blocks.append(f"--- RECORD {n} ---\n{_body(json.loads(line))}")
            except ValueError:
                continue
        return "\n\n".join(blocks)
    try:
        value = json.loads(text)
    except ValueError:
        return text
    if isinstance(value, list):
        return "\n\n".join(f"--- ITEM {n} ---\n{_body(x)}" for n, x in enumerate(value, 1))
    return _body(value) if isinstance(value, dict) else str(value)


@F.pandas_udf(_LINES)
def flatten_json(texts: pd.Series) -> pd.Series:
    """The (path, value) pairs of a JSON text; null where it is none."""

    def one(t: str | None) -> list[dict] | None:
        try:
            return None if t is None else [{"path": k, "value": str(v)} for k, v in flattened(json.loads(t))]
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def render_json(texts: pd.Series) -> pd.Series:
    return texts.map(rendered, na_action="ignore")
