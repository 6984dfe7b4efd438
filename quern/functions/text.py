"""Text scalars as Column builders. Only Unicode normalisation, HTML and free-form dates visit Python, in Arrow batches.

All keep null as null unless they say otherwise. White space means Unicode white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.timestamps import parse_instant

_BREAK = re.compile(r"(?i)<br\s*/?>")
_SPACE = r"[\s\x1c-\x1f]"
# Marks that begin a list line.
BULLET = r"[•‣●■◦•‧·．\-–—]|\(\d+\)|\d+[\.、)]|\([一二三四五六七八九十]\)|[一二三四五六七八九十]、|\([甲乙丙丁]\)|[甲乙丙丁]、|\([A-Za-z]\)|[A-Za-z][\.\)]"
# Fixed value: dates of the Minguo calendar from year 100 to 199.
MINGUO = r"(?U)(1\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
# Fixed value: an e-mail address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# Semester codes and their long forms.
SEMESTERS = {f"{y}{h}": f"大{y}{h}學期" for y in "一二三四" for h in "上下"}
# Record types that become sentences.
SENTENCE_TYPES = ("course_table_row", "table_row")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return texts.map(lambda s: unicodedata.normalize("NFKC", s) if isinstance(s, str) and not s.isascii() else s)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.silent = [], False, 0

    def handle_starttag(self, tag, attrs):
        self.open = False
        self.silent += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.open = False
        self.silent -= tag in ("script", "style", "template") and self.silent > 0

    def handle_comment(self, data):
        self.open = False

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if self.silent:
            return
        if self.open:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
            self.open = True


def html_text(html: str | None) -> str:
    """The text nodes of a document, one a line; ``<br>`` is a line end; comments, scripts and styles are no text."""
    if not html or not html.strip():
        return ""
    parser = _Text()
    parser.feed(_BREAK.sub("\n", html))
    parser.close()
    return "\n".join(parser.nodes)


@F.pandas_udf(T.StringType())
def strip_html(texts: pd.Series) -> pd.Series:
    """``html_text``; null and blank give an empty text."""
    return texts.map(html_text, na_action=None)


@F.pandas_udf(T.StringType())
def iso8601_taipei(texts: pd.Series) -> pd.Series:
    """ISO 8601 with +08:00 of a time in any notation; without a zone it is Taipei's. Null where it denotes none."""
    zone, start = timezone(timedelta(hours=8)), datetime(1970, 1, 1, tzinfo=timezone(timedelta(0)))

    def iso(s: str | None) -> str | None:
        at = parse_instant(s)
        return None if at is None else (start + timedelta(microseconds=at)).astimezone(zone).isoformat()

    return texts.map(iso, na_action="ignore")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space, the ideographic and the no-break space among it, as one space."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_SPACE}+", " "))


def normalize_space(c: Column) -> Column:
    """No-break spaces and runs of spaces and tabs as one space, at most one blank line, trimmed; null as an empty text."""
    c = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\xa0", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def minguo_dates(c: Column) -> Column:
    """Minguo dates, years 100 to 199, as ISO dates. The replacement is computed, so matches are folded over the text."""
    part = lambda m, i: F.translate(F.regexp_extract(m, MINGUO, i), "０１２３４５６７８９", "0123456789").cast("int")
    iso = lambda m: F.concat_ws("-", F.lpad((part(m, 1) + 1911).cast("string"), 4, "0"), F.lpad(part(m, 2).cast("string"), 2, "0"), F.lpad(part(m, 3).cast("string"), 2, "0"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(MINGUO), F.lit(0)), c, lambda text, m: F.replace(text, m, iso(m)))


def normalize_bullet(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?U)^{_SPACE}*(?:{BULLET}){_SPACE}*", "- ")


def fix_lines(c: Column) -> Column:
    """Every line in composed form, with a plain list mark and single spaces; blank lines stay."""
    return F.array_join(F.transform(F.split(nfkc(c), "\n"), lambda line: normalize_space(normalize_bullet(line))), "\n")


def checksum(*parts: Column) -> Column:
    """SHA-256 of the parts without a separator; null counts as empty."""
    return F.sha2(F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def sha1_of(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")))


def chunk_id(doc_id: Column, text: Column) -> Column:
    """SHA-1 of the document's id and the text with white space collapsed."""
    return F.sha1(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), collapse(text)))


def semester_name(code: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in SEMESTERS.items() for x in kv))
    trimmed = strip(F.coalesce(code, F.lit("")))
    return F.coalesce(pairs[trimmed], trimmed)


def filled(c: Column) -> Column:
    """The text without surrounding space, or null where nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, or an empty text."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))


def joined(parts: Iterable[Column], separator: str = "｜") -> Column:
    """The parts that are not blank, joined."""
    return F.array_join(F.filter(F.array(*(c.cast("string") for c in parts)), lambda x: x.isNotNull() & (strip(x) != "")), separator)


def joined_all(parts: Iterable[Column], separator: str = "｜") -> Column:
    """All parts, empty ones too, without separators at either end."""
    text = F.concat_ws(separator, *(F.coalesce(c.cast("string"), F.lit("")) for c in parts))
    return F.regexp_replace(text, f"^(?:{separator})+|(?:{separator})+$", "")


def record_sentence(kind: Column, title: Column, semester: Column, category: Column, sub_category: Column, name: Column, credit: Column) -> Column:
    """A course record as one sentence of the fields that it has; an empty text for records of other types."""
    said = F.concat_ws(
        "，",
        filled(title),
        F.concat(F.lit("在"), F.nullif(semester_name(semester), F.lit(""))),
        F.concat(F.lit("屬於"), filled(category)),
        F.concat(filled(sub_category), F.lit("類")),
        F.concat(F.lit("課程名稱為「"), filled(name), F.lit("」")),
        F.concat(F.lit("學分數為 "), F.nullif(credit.cast("string"), F.lit("")), F.lit(" 學分")),
    )
    said = F.regexp_replace(said, "^，+|，+$", "")
    return F.when(kind.isin(*SENTENCE_TYPES), F.when((said != "") & ~F.endswith(said, F.lit("。")), F.concat(said, F.lit("。"))).otherwise(said)).otherwise("")


def sentence_keeps_fields(sentence: Column, semester: Column, category: Column, sub_category: Column, name: Column, credit: Column) -> Column:
    """Whether a written sentence holds every field's value; a semester may stand in its long form."""
    has = lambda v: filled(v).isNull() | F.contains(sentence, filled(v))
    term = has(semester) | F.contains(sentence, semester_name(semester))
    digits = credit.isNull() | F.contains(sentence, credit.cast("string"))
    return F.coalesce((sentence != "") & term & has(category) & has(sub_category) & has(name) & digits, F.lit(False))


def email_of(c: Column) -> Column:
    """The first e-mail address, or the text unchanged; null as an empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(c, EMAIL, 0), F.lit("")), c)


def snippet(c: Column, length: int = 100) -> Column:
    return F.substring(F.translate(c, "\n", " "), 1, length)


def score_text(c: Column, digits: int = 3) -> Column:
    """A number with fixed digits, ``NA`` where there is none."""
    number = c.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), "NA").otherwise(F.format_string(f"%.{digits}f", number))


def base_name(path: Column, slug: str | None = None) -> Column:
    """The slug, or else the file's name without folders and extension."""
    return F.lit(slug) if slug else F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
