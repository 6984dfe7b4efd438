"""Texts as arrays of code points: comparison form, rolling hashes and winnowing, a block of texts at a time."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from quern.llm.canonical import LATIN_OF

_UNKNOWN, _MANY = -1, -2
_form = np.full(0x110000, _UNKNOWN, np.int32)

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spelled(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(LATIN_OF.get(c, c) for c in folded if c.isalnum()).lower()


def comparison_form(text: str) -> str:
    """Letters and digits only, in one character form, one letter case, and Latin for look-alike letters."""
    # Marks that follow a letter join it first, also where an invisible character stands between.
    bare = "".join(c for c in text if unicodedata.category(c) != "Cf") if not text.isascii() else text
    return "".join(LATIN_OF.get(c, c) for c in _spelled(bare))


def comparison_codes(codes: np.ndarray, text: str) -> np.ndarray:
    """Code points of ``comparison_form(text)``; ``codes`` are those of the text."""
    mapped = _form[codes]
    if (mapped == _UNKNOWN).any():
        for code in np.unique(codes[mapped == _UNKNOWN]).tolist():
            c = chr(code)
            plain = "" if 0xD800 <= code < 0xE000 else comparison_form(c)
            # Marks can join what stands before them; such texts go the slow way.
            joins = unicodedata.category(c)[0] == "M"
            _form[code] = _MANY if len(plain) > 1 or joins else ord(plain) if plain else 0
        mapped = _form[codes]
    if (mapped == _MANY).any():
        return code_points(comparison_form(text)).astype(np.int32)
    return mapped[mapped > 0]


def blocks(rows: Iterator[tuple[object, str]], most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Rows (id, text) in blocks of about ``most`` characters, so that memory follows the longest text, not the batch."""
    ids, texts, size = [], [], 0
    for i, text in rows:
        if texts and size + len(text) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, BASE, np.uint64))])
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads near values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes, modulo 2^64, of all windows of concatenated texts; characters are spread first."""

    def __init__(self, parts: list[np.ndarray]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.codes = codes
        _grow(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes) * _powers[: len(codes)], out=self.sums[1:])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k characters at each position, and which of them lie within one text."""
        n = max(0, len(self.codes) - k + 1)
        inside = np.zeros(n, bool)
        if n:
            hashes = mix((self.sums[k:] - self.sums[:n]) * _inverses[:n])
            marks = np.zeros(len(self.codes) + 1, np.int32)
            full = self.lengths >= k
            np.add.at(marks, self.starts[:-1][full], 1)
            np.add.at(marks, self.starts[1:][full] - k + 1, -1)
            inside = np.cumsum(marks)[:n] > 0
            return hashes, inside
        return np.empty(0, np.uint64), inside

    def at(self, starts: np.ndarray, k: int) -> np.ndarray:
        return mix((self.sums[starts + k] - self.sums[starts]) * _inverses[starts])

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def winnow(hashes: np.ndarray, inside: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every ``w`` consecutive windows within a text, the last of equal ones.

    A text of fewer than ``w`` windows has none: it is shorter than every span that the choice guarantees.
    """
    n = len(hashes)
    if n < w:
        return np.empty(0, np.int64)
    # The place stands in the low bits, counted from the end, so that one minimum gives both the hash and its last place.
    bits = np.uint64(max(20, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low, width = (hashes >> bits << bits) | (mask - np.arange(n, dtype=np.uint64)), 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: n - w + 1], low[w - width :][: n - w + 1])
    run = np.concatenate([[0], np.cumsum(inside)])
    whole = (run[w:] - run[:-w]) == w
    chosen = np.zeros(n, bool)
    chosen[(mask - (low[whole] & mask)).astype(np.int64)] = True
    return np.flatnonzero(chosen)


class _Forms(dict):
    def __missing__(self, code: int) -> str:
        # A mark can join what stands before it; a zero tells of it.
        self[code] = form = "" if 0xD800 <= code < 0xE000 else "\0" if unicodedata.category(chr(code))[0] == "M" else comparison_form(chr(code))
        return form


_forms = _Forms()


def form(text: str) -> str:
    """``comparison_form``, a character at a time where none of them joins its neighbour."""
    plain = text.translate(_forms)
    return comparison_form(text) if "\0" in plain else plain
