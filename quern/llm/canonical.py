"""One consistent form for text that looks the same but is spelled with other characters.

Letters are looked at token by token. Every letter has a set of scripts, its script extensions; the sets
are intersected over the token (Han, kana and Hangul end a token, as they stand beside Latin in ordinary text).
An empty intersection is a mixed-script token, a token all of whose letters have a twin in Latin is a
whole-script confusable, unless the text proves that its script is in real use; both are respelled in the script that
the remaining letters prove. Odd letters of the Latin script itself (phonetic ones, small capitals) are spelling. Afterwards
compatibility forms, separate marks, invisible characters and odd spaces are normalised. Chinese punctuation,
accents, symbols such as Ω or σ, and line feeds stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPAT, MARK, INVISIBLE, SPACE, LOOKALIKE = 1, 2, 4, 8, 16

# Letters of other scripts and the Latin letters they are drawn like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝүӏ", "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwyl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj", strict=True))
#: Drawn like Latin letters only within a word; alone they are usual symbols.
GREEK_WEAK = dict(zip("αγικρυχ", "ayikpux", strict=True))
ARMENIAN = dict(zip("ՕՏԼՍօսոհզցյ", "OSLUounhqgj", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏂᏏᏴ", "DRTiAJEWMHYGZRWSVSLCPKdhbB", strict=True))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HIKMNOPCTXopc", strict=True))
LISU = dict(zip("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
TWINS = {"Cyrl": CYRILLIC, "Grek": GREEK | GREEK_WEAK, "Armn": ARMENIAN, "Cher": CHEROKEE, "Copt": COPTIC, "Lisu": LISU}
LATIN_OF = {a: b for twins in TWINS.values() for a, b in twins.items()}
_TO = {script: {b: a for a, b in reversed(twins.items())} for script, twins in TWINS.items()}
_SCRIPTS = {script: regex.compile(rf"\p{{scx={script}}}") for script in ("Latn", *TWINS)}
_FOREIGN = regex.compile("[" + "".join(rf"\p{{scx={script}}}" for script in TWINS) + "&&\\p{L}]", regex.V1)

#: Rows without any of these characters are in their final form; Spark tells them apart without Python.
SUSPECT = "[^\\x00-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff\\u00b7\\u2013\\u2014\\u2018-\\u201d\\u2026\\u3001-\\u3029\\u4e00-\\u9fff\\uff01-\\uff0f\\uff1a-\\uff20\\uff3b-\\uff40\\uff5b-\\uff65]"

_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
_OWN = re.compile("[⺀-⿿々-〇〡-ㄯㆠ-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_IGNORABLE = re.compile("[͏ᅟᅠ឴឵᠋-᠏︀-️\U000e0100-\U000e01ef]")


@lru_cache(1 << 16)
def _char(c: str) -> tuple[int, str]:
    """Mask of what is odd about a character and what it becomes outside words."""
    kind = unicodedata.category(c)
    if kind == "Cf" or _IGNORABLE.match(c):
        return INVISIBLE, ""
    if kind in ("Zs", "Zl", "Zp"):
        return (SPACE if c != " " else 0), " "
    plain = unicodedata.normalize("NFKC", c)
    if plain != c and any(x.isalnum() for x in plain):
        return COMPAT, plain
    return 0, c


@lru_cache(1 << 16)
def scripts(c: str) -> frozenset[str] | None:
    """Scripts in which a letter is used, by its script extensions; None for what is no letter or belongs to every script."""
    if not c.isalpha() or regex.match(r"\p{scx=Common}|\p{scx=Inherited}", c):
        return None
    return frozenset(s for s, p in _SCRIPTS.items() if p.match(c)) or frozenset(("Othr",))


@lru_cache(1 << 16)
def _readable(c: str) -> frozenset[str]:
    """Scripts in which a letter or its twin can be written."""
    out = set(scripts(c) or ())
    if c in LATIN_OF:
        out.add("Latn")
    return frozenset(out | {script for script, twin in _TO.items() if c in twin})


def _token(word: str, foreign: frozenset[str]) -> str:
    """The spelling of a word in its consistent script. foreign: scripts proven to be in real use in this text."""
    sets = [s for s in map(scripts, word) if s]
    if not sets or all(s == {"Latn"} for s in sets):
        return word
    resolved = frozenset.intersection(*sets)
    letters = [c for c in word if scripts(c)]
    possible = frozenset.intersection(*map(_readable, letters))
    if not resolved:
        for script in ("Latn", *TWINS):
            if script in possible:
                spelling = LATIN_OF if script == "Latn" else _TO[script]
                return "".join(c if script in (scripts(c) or (script,)) else spelling.get(c, c) for c in word)
        return word
    if "Latn" in possible and not resolved & foreign and not (len(letters) == 1 and letters[0] in GREEK_WEAK):
        return "".join(LATIN_OF.get(c, c) for c in word)
    return word


def _proven(text: str) -> frozenset[str]:
    """Scripts in real use: a word of two letters and more is written in one of them, with a letter that has no Latin twin.

    A symbol that stands alone, such as Δ or σ, proves nothing.
    """
    out = set()
    for m in _WORD.finditer(text):
        for run in _OWN.split(m[0]):
            sets = [s for s in map(scripts, run) if s]
            if len(sets) > 1 and (own := frozenset.intersection(*sets) - {"Latn", "Othr"}) and any(c not in LATIN_OF for c in run if scripts(c)):
                out |= own
    return frozenset(out)


@lru_cache(1 << 15)
def _cached(word: str, foreign: frozenset[str]) -> tuple[str, bool]:
    parts, found, at = [], False, 0
    for piece in [*_OWN.finditer(word), None]:
        run = word[at : piece.start()] if piece else word[at:]
        if run:
            new = _token(run, foreign)
            found |= any(a != b and scripts(a) != {"Latn"} for a, b in zip(run, new, strict=True))
            parts.append(new)
        if piece:
            parts.append(piece[0])
            at = piece.end()
    return "".join(parts), found


#: Raised and lowered digits and signs, and fractions, which say more than the digits they are made of.
_RAISED = re.compile("(?<=[^\\W_])([⁰¹²³⁴-⁹⁺⁻]+)|(?<=[)\\]])([⁰¹²³⁴-⁹⁺⁻]+)")
_LOWERED = re.compile("(?<=[^\\W_])([₀-₉₊₋]+)")
_FRACTION = re.compile("(\\d?)([¼-¾⅐-⅞])")


def canonical(text: str) -> tuple[str, int]:
    """The text in its one form, and a mask of what was odd in it.

    Raised digits that follow a letter, digit or bracket come out as ``^2``, lowered ones as ``_2``, fractions as ``1/2``
    (after a digit with a space between), so that m² does not become m2 nor 3½ become 31/2.
    """
    mask, out = 0, []
    if not text.isascii() and (_RAISED.search(text) or _LOWERED.search(text) or _FRACTION.search(text)):
        mask |= COMPAT
        flat = lambda s: unicodedata.normalize("NFKC", s).replace("\u2212", "-").replace("\u2044", "/")
        text = _RAISED.sub(lambda m: "^" + flat(m[0]), text)
        text = _LOWERED.sub(lambda m: "_" + flat(m[0]), text)
        text = _FRACTION.sub(lambda m: m[1] + " " * bool(m[1]) + flat(m[2]), text)
    for c in text:
        if c < "\x80":
            out.append(c)
        else:
            odd, plain = _char(c)
            mask |= odd
            out.append(plain)
    plain = "".join(out)
    if any(unicodedata.category(b) == "Mn" and a.isalpha() for a, b in zip(plain, plain[1:]) if b > "˿"):
        mask |= MARK
        plain = unicodedata.normalize("NFC", plain)
    if _FOREIGN.search(plain):
        foreign = _proven(plain)

        def word(m: re.Match) -> str:
            nonlocal mask
            new, found = _cached(m[0], foreign)
            mask |= LOOKALIKE * found
            return new

        plain = _WORD.sub(word, plain)
    return plain, mask


@F.pandas_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("odd", T.IntegerType())]))
def _canonical(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, 0) if t is None else canonical(t) for t in texts]
    return pd.DataFrame(rows, columns=["canonical", "odd"])


def with_canonical(df: DataFrame, column: str, out: str = "canonical", odd: str = "odd") -> DataFrame:
    """``df`` with the consistent form of ``column`` and a bit mask of what was odd: 1 compatibility form, 2 separate mark,
    4 invisible character, 8 space other than U+0020, 16 look-alike letter.

    Null stays null with mask 0, an empty text stays empty. Only rows that hold a suspect character visit Python; the
    rest pass as nulls. Columns named like the results are replaced; all others, whatever their names, are kept.
    """
    c = F.col(f"`{column}`")
    suspect: Column = c.rlike(SUSPECT)
    done = df.withColumn("__canonical", _canonical(F.when(suspect, c)))
    return done.withColumns({out: F.when(suspect, F.col("__canonical.canonical")).otherwise(c), odd: F.coalesce(F.col("__canonical.odd"), F.lit(0))}).drop("__canonical")
