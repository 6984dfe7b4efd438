"""Member cards and links out of HTML listings, and member records out of cards."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import email_of, joined, sha1_of

# How a listing marks a card and a name, the heading that is no datum, and the mark of adjunct staff.
CARD_CLASS, NAME_STYLE, HEADING, ADJUNCT = "mdetail", "color:#0000cd;", "學術研究發表｜研究計畫", "兼任"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CARD = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("paragraphs", T.ArrayType(T.StringType()))])


class _Collector(HTMLParser):
    """The texts of the elements that rules name: (name of the rule, number of the card, text)."""

    def __init__(self, rules: dict, card: str | None = None):
        super().__init__(convert_charrefs=True)
        self.rules, self.card_class, self.stack, self.cards, self.found = rules, card, [], -1, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _VOID:
            return
        if tag == "p":
            self._close_until("p")
        is_card = self.card_class is not None and self.card_class in a.get("class", "").split()
        self.cards += is_card
        inside = is_card or any(x["card"] for x in self.stack)
        hits = []
        for rule, test in self.rules.items():
            if (inside or self.card_class is None) and test(tag, a):
                self.found.append([rule, self.cards, [], a])
                hits.append(self.found[-1])
        self.stack.append({"tag": tag, "card": is_card, "hits": hits})

    def _close_until(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is not None and not any(x["card"] for x in self.stack[at + 1 :]):
            del self.stack[at:]

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        if data.strip():
            for x in self.stack:
                for hit in x["hits"]:
                    hit[2].append(data.strip())


def links(html: str | None) -> list[tuple[str, str]]:
    """(text, address) of the links of a page."""
    c = _Collector({"a": lambda tag, a: tag == "a" and "href" in a})
    c.feed(html or "")
    return [("".join(texts), a["href"]) for _, _, texts, a in c.found]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])))
def page_links(pages: pd.Series) -> pd.Series:
    return pages.map(lambda h: [{"text": t, "href": a} for t, a in links(h)], na_action=None)


def first_link(html: Column, phrase: str) -> Column:
    """The address of the first link whose text holds ``phrase``; null if there is none."""
    return F.get(F.filter(page_links(html), lambda x: F.contains(x["text"], F.lit(phrase))), F.lit(0))["href"]


@F.pandas_udf(T.ArrayType(_CARD))
def _cards(pages: pd.Series) -> pd.Series:
    def one(html: str | None) -> list[dict]:
        c = _Collector({"name": lambda tag, a: a.get("style", "") == NAME_STYLE, "p": lambda tag, a: tag == "p"}, CARD_CLASS)
        c.feed(html or "")
        return [{"names": ["".join(t) for r, n, t, _ in c.found if n == i and r == "name" and t], "paragraphs": ["".join(t) for r, n, t, _ in c.found if n == i and r == "p"]} for i in range(c.cards + 1)]

    return pages.map(one, na_action=None)


def card_facts(names: Column, paragraphs: Column) -> Column:
    """The names as one fact, then each paragraph that no kept fact holds already; the heading is left out."""
    name = F.array_join(names, ", ")
    first = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    held = lambda kept, p: F.exists(kept, lambda x: F.contains(x, p)) | ((p == HEADING) & (F.size(kept) > 0))
    return F.aggregate(paragraphs, first, lambda kept, p: F.when(held(kept, p), kept).otherwise(F.concat(kept, F.array(p))))


def member_records(pages: DataFrame, html: str = "html", slug: str = "department_members") -> DataFrame:
    """person_name, phone, email, office, metadata, text, doc_id and checksum_clean of each card; cards without facts have none.

    Facts stand by their place: name, phone, e-mail, office, the rest. An adjunct's second to fourth are metadata and the
    fifth is the e-mail.
    """
    cards = pages.select("*", F.posexplode(_cards(html)).alias("card", "c")).withColumn("facts", card_facts(F.col("c.names"), F.col("c.paragraphs"))).where(F.size("facts") > 0)
    at = lambda i: F.coalesce(F.get("facts", F.lit(i)), F.lit(""))
    adjunct = F.contains(at(0), F.lit(ADJUNCT))
    pick = lambda a, b: F.when(adjunct, a).otherwise(b)
    out = cards.withColumns(
        {
            "person_name": at(0),
            "phone": pick(F.lit(""), at(1)),
            "email": pick(email_of(at(4)), email_of(at(2))),
            "office": pick(F.lit(""), at(3)),
            "metadata": pick(F.array_join(F.slice("facts", 2, 3), "。"), F.array_join(F.slice("facts", 5, 1 << 20), "")),
        }
    )
    out = out.withColumns({"text": joined([F.col(c) for c in ("person_name", "phone", "email", "office", "metadata")]), "doc_id": sha1_of(F.concat(F.lit(f"{slug}|"), F.col("person_name")))})
    return out.withColumn("checksum_clean", sha1_of(F.col("text"))).drop("c", "facts")
