"""Markup residue in text: HTML, Markdown, wiki text and LaTeX taken off, structure kept.

A text is read into a tree of candidate nodes: everything that could be markup of one of the four languages, and also
what only looks like it (prices, comparisons, paths, placeholders, hash tags). Gradient-boosted trees give every node
probabilities of being text, a wrapper (its marks go, its content stays) or waste (it goes with its content), from
features of the node and its place in the tree. The tree is then decoded as a whole: below waste everything is waste,
below code everything is text, and of all such labelings the most probable one counts.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
import math
import pickle
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.canonical import SUSPECT, canonical
from quern.session import shared_dir

TEXT, WRAP, WASTE = 0, 1, 2

# Names of HTML elements and LaTeX commands that occur in running text.
HTML = set("a abbr b blockquote body br button caption center cite code col colgroup dd del div dl dt em figure footer font form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav nowiki ol option p pre ref s script section select small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul video".split())
BLOCKS = set("p div li ul ol table tr h1 h2 h3 h4 h5 h6 blockquote section article header footer dl dt dd pre hr br figure".split())
#: Elements and commands that go with their content.
WASTED = {"script", "style", "head", "iframe", "nav", "form", "select", "button", "footnote", "includegraphics", "label", "vspace", "hspace", "usepackage"}
LATEX = set("alpha begin beta bf big cdot chapter cite delta emph end epsilon footnote frac gamma geq href hspace include infty int it item label lambda left leq ldots ln log mathbb mathbf mathrm mu neq noindent omega paragraph part partial pi pm prod quad ref rho right section sigma sin cos sqrt subsection subsubsection sum textbf textit textrm textsc texttt theta times title underline url usepackage vspace".split())

KINDS = ["comment", "open", "close", "entity", "fence", "code", "image", "link", "heading", "quote", "rule", "row", "bullet", "wikihead", "wikitable", "wikilink", "template", "quotes", "env", "math", "command", "stars", "unders", "tildes", "dollar", "angle", "bracket", "brace", "hash", "equals", "less", "amp", "pipe", "backslash"]
KIND = {k: i for i, k in enumerate(KINDS)}
FAMILY = {k: f for f, ks in {"html": "comment open close entity angle less amp", "markdown": "fence code image link heading quote rule row bullet stars unders tildes hash bracket", "wiki": "wikihead wikitable wikilink template quotes equals brace pipe", "latex": "env math command dollar backslash"}.items() for k in ks.split()}
FAMILIES = ["html", "markdown", "wiki", "latex"]

_SCAN = re.compile(
    r"""
      (?P<comment><!--.*?-->|<!--|-->)
    | (?P<close></\s*[A-Za-z][\w:.-]*\s*>)
    | (?P<open><[A-Za-z][\w:.-]*+(?:\s+[\w:.@-]++(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"']+))?)*+\s*/?>)
    | (?P<entity>&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)
    | ^[ ]{0,3}(?P<fence>(?:```|~~~)[\w+-]*[ ]*)$
    | (?P<code>`+[^`\n]+`+)
    | (?P<image>!\[[^\]\n]*\]\([^()\n]*\))
    | (?P<link>\[[^\[\]\n]+\]\([^()\n]*\)|\[https?://\S+[ ][^\[\]\n]+\])
    | ^(?P<heading>[ ]{0,3}\#{1,6}[ ]+(?=\S|$))
    | ^(?P<quote>[ ]{0,3}>[ ]?)(?=\S)
    | ^[ ]{0,3}(?P<rule>(?:-{3,}|\*{3,}|_{3,}))[ ]*$
    | ^(?P<wikitable>\{\|[^\n]*|\|[-}][ ]*(?=$))
    | ^(?P<wikihead>={2,6}[ ]?(?=[^=\n]*[^=\n]={2,6}[ ]*$))
    | (?P<wikitail>[ ]?={2,6})[ ]*$
    | ^(?P<row>[|!](?![|\]])(?:[^\n]*[|][ ]*(?=$)|[^\n]*\|\|[^\n]*|[^\n]*))
    | ^(?P<bullet>[ ]{0,6}[*+•‧●◦][ ]+)(?=\S)
    | (?P<wikilink>\[\[[^\[\]\n]*\]\])
    | (?P<template>\{\{(?:[^{}]++|\{(?!\{)[^{}]*+\}(?!\}\})|\{\{[^{}]*+\}\})*+\}\})
    | (?P<quotes>'{2,5})
    | (?P<env>\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?)
    | (?P<math>\\\[.*?\\\]|\\\(.*?\\\)|\$\$[^$]+\$\$|\$(?=\S)[^$\n]++(?<=\S)\$(?!\d)|\\[\[\]()])
    | (?P<command>\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})*+)
    | (?P<stars>\*{1,3})
    | (?P<unders>_{1,3})
    | (?P<tildes>~{1,2})
    | (?P<dollar>\$)
    | (?P<angle><[^<>\n\s][^<>\n]*+>)
    | (?P<bracket>\[\^?[^\[\]\n]++\])
    | (?P<brace>\{[^{}\n]*+\})
    | (?P<hash>\#)
    | (?P<equals>={2,3})
    | (?P<less>[<>])
    | (?P<amp>&)
    | (?P<pipe>\|+)
    | (?P<backslash>\\.?)
    """,
    re.X | re.M | re.S,
)
#: Rows without any of these hold no candidate; Spark tells them apart without Python.
CANDIDATE = r"[<>&`\\$*_~\[\]{}|#=']|^[ ]{0,6}[+•‧●◦] |-{3}"


class Node:
    __slots__ = ("attrs", "body", "children", "depth", "end", "kind", "label", "name", "parent", "partner", "raw", "score", "start")

    def __init__(self, kind: str, start: int, end: int, raw: str):
        self.kind, self.start, self.end, self.raw = kind, start, end, raw
        self.name, self.attrs, self.body = "", 0, (end, end)
        self.children, self.parent, self.partner, self.depth, self.label, self.score = [], None, None, 0, TEXT, None


def parse(text: str) -> list[Node]:
    """The candidates of a text in order, each linked to its parent, its children and its closing mark."""
    nodes: list[Node] = []
    fenced = False
    for m in _SCAN.finditer(text):
        kind = m.lastgroup
        if kind == "wikitail":
            kind = "wikihead"
        node = Node(kind, m.start(kind if kind != "wikihead" or m["wikihead"] else "wikitail"), m.end(m.lastgroup), m[m.lastgroup])
        raw = node.raw
        if kind in ("open", "close"):
            node.name = re.match(r"</?\s*([\w:.-]+)", raw)[1].lower()
            node.attrs = len(re.findall(r"\s[\w:.@-]+\s*(?==|\s|/?>)", raw))
        elif kind in ("command", "env"):
            node.name = re.match(r"\\([A-Za-z]+)", raw)[1]
            node.attrs = raw.count("{") + raw.count("[")
            if kind == "env":
                node.name = re.search(r"\{([A-Za-z*]+)\}", raw)[1]
        elif kind == "fence":
            fenced = not fenced
        nodes.append(node)
    # Partners: closing tags, environments and paired marks. Then parents by containment.
    open_: dict[str, list[Node]] = {}
    for n in nodes:
        pair = None
        if n.kind == "open" and not n.raw.endswith("/>"):
            open_.setdefault("<", []).append(n)
        elif n.kind == "close":
            stack = open_.get("<", [])
            same = next((x for x in reversed(stack) if x.name == n.name or (x.name[0] == n.name[0] == "h" and x.name[1:].isdigit() and n.name[1:].isdigit())), None)
            if same is not None:
                del stack[stack.index(same) :]
                pair = same
        elif n.kind == "env":
            stack = open_.setdefault("env " + n.name, [])
            if n.raw.startswith("\\begin"):
                stack.append(n)
            elif stack:
                pair = stack.pop()
        elif n.kind == "wikitable":
            stack = open_.setdefault("{|", [])
            if n.raw.startswith("{|"):
                stack.append(n)
            elif n.raw.startswith("|}") and stack:
                pair = stack.pop()
        elif n.kind in ("stars", "unders", "tildes", "quotes", "fence", "wikihead") or (n.kind == "dollar"):
            key = n.kind + (str(len(n.raw.strip())) if n.kind != "fence" else "")
            stack = open_.setdefault(key, [])
            if stack:
                pair = stack.pop()
            else:
                stack.append(n)
        if pair is not None:
            pair.partner, n.partner = n, pair
            pair.body = (pair.end, n.start)
    enclosing: list[Node] = []
    for n in nodes:
        while enclosing and enclosing[-1].body[1] <= n.start:
            enclosing.pop()
        if enclosing and enclosing[-1].body[1] > n.start:
            n.parent = enclosing[-1]
            n.depth = n.parent.depth + 1
            n.parent.children.append(n)
        if n.body[1] > n.body[0]:
            enclosing.append(n)
    return nodes


def _class(c: str) -> int:
    """0 nothing or line end, 1 space, 2 Han, 3 letter, 4 digit, 5 other."""
    if not c or c == "\n":
        return 0
    if c.isspace():
        return 1
    return 2 if "㐀" <= c <= "鿿" else 3 if c.isalpha() else 4 if c.isdigit() else 5


def _entity(raw: str) -> bool:
    return raw[1] == "#" or raw[1:] in html.entities.html5


FEATURES = len(KINDS) + 4 + 24


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """Of every node: what it is, its attributes, its depth and siblings, its subtree's size and density, its surroundings."""
    out = np.zeros((len(nodes), FEATURES), np.float32)
    families = np.zeros(4)
    for n in nodes:
        families[FAMILIES.index(FAMILY[n.kind])] += 1
    roots = [n for n in nodes if n.parent is None]
    for i, n in enumerate(nodes):
        row = out[i]
        row[KIND[n.kind]] = 1
        base = len(KINDS)
        row[base : base + 4] = np.minimum(families, 20)
        base += 4
        before, after = text[max(0, n.start - 1) : n.start], text[n.end : n.end + 1]
        inside = n.raw.strip("<>{}[]()$\\`*_~|#=&;' ")
        siblings = n.parent.children if n.parent else roots
        body = text[n.body[0] : n.body[1]]
        row[base : base + 24] = (
            n.name in HTML if n.kind in ("open", "close") else _entity(n.raw) if n.kind == "entity" else n.name in LATEX or n.kind == "env",
            min(n.attrs, 5), n.depth, min(len(siblings), 30), sum(s.kind == n.kind for s in siblings) if len(siblings) < 50 else 50,
            min(len(n.children), 30), len(body) / (1 + len(n.children)) if body else 0, n.partner is not None,
            _class(before), _class(after), len(n.raw), len(inside), sum(_class(c) == 2 for c in inside) / max(1, len(inside)),
            sum(c.isdigit() for c in inside) / max(1, len(inside)), "\\" in inside or "^" in inside or "_" in inside, n.start == 0 or before == "\n", after in ("", "\n"),
            text[n.start - 2 : n.start - 1].isalnum() if n.start > 1 and before in ":\\" else 0, before == "\\" or after == "\\" or before == ":", body.count("\n") if body else 0,
            text[n.end : n.end + 1].isdigit() and before.isdigit(), n.name in WASTED, ":" in n.raw and "|" in n.raw, (n.partner is not None) and (n.partner.end - n.start if n.partner.start > n.start else n.end - n.partner.start) <= 12,
        )
    return out


class BoostedTrees:
    """One-against-rest gradient-boosted trees of fixed depth over quantile bins; small, exact and without chance."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int = 3) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.prior, self.trees = [], []
        for k in range(classes):
            t = (y == k).astype(float)
            p = min(max(t.mean(), 1e-4), 1 - 1e-4)
            f = np.full(len(y), math.log(p / (1 - p)))
            trees = []
            for _ in range(self.rounds):
                q = 1 / (1 + np.exp(-f))
                g, h = t - q, q * (1 - q)
                tree, at = self._tree(b, g, h)
                f += self.rate * tree[2][at]
                trees.append(tree)
            self.prior.append(math.log(p / (1 - p)))
            self.trees.append(trees)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        n, feats = b.shape
        at = np.zeros(n, np.int64)
        which, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 1 << 20, np.int64)
        for level in range(self.depth):
            width = 2**level
            gain, choice = np.zeros(width), [(0, 1 << 20)] * width
            for j in range(feats):
                key = at * (self.bins + 1) + b[:, j]
                gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + self.least) + (gt - gs) ** 2 / (ht - hs + self.least) - gt**2 / (ht + self.least)
                s = value.argmax(1)
                for node in np.flatnonzero(value[np.arange(width), s] > gain + 1e-9):
                    gain[node], choice[node] = value[node, s[node]], (j, int(s[node]))
            for node, (j, s) in enumerate(choice):
                which[width - 1 + node], cut[width - 1 + node] = j, s
            at = at * 2 + (b[np.arange(n), which[width - 1 + at]] > cut[width - 1 + at])
        gs, hs = np.bincount(at, g, 2**self.depth), np.bincount(at, h, 2**self.depth)
        return (which, cut, gs / (hs + self.least)), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        rows, out = np.arange(len(x)), np.empty((len(x), len(self.trees)))
        for k, trees in enumerate(self.trees):
            f = np.full(len(x), self.prior[k])
            for which, cut, leaf in trees:
                at = np.zeros(len(x), np.int64)
                for level in range(self.depth):
                    node = 2**level - 1 + at
                    at = at * 2 + (b[rows, which[node]] > cut[node])
                f += self.rate * leaf[at]
            out[:, k] = -np.log1p(np.exp(-f))
        return out - np.log(np.exp(out).sum(1, keepdims=True))


def decode(nodes: list[Node], scores: np.ndarray) -> None:
    """The most probable labels of all nodes of which no two contradict: waste covers its subtree, code keeps its own as text."""
    for n, s in zip(nodes, scores, strict=True):
        n.score = s
    # Closing marks follow their opening ones, so each pair is decided once, on both its marks.
    joint = {id(n): n.score + (n.partner.score if n.partner is not None else 0) for n in nodes}
    follows = {id(n) for n in nodes if n.partner is not None and n.partner.start < n.start}
    below: dict[int, tuple[float, float, float]] = {}
    for n in reversed(nodes):
        free = text = waste = 0.0
        for c in n.children:
            if id(c) in follows:
                continue
            f, t, w = below[id(c)]
            free, text, waste = free + f, text + t, waste + w
        s = joint[id(n)]
        code = n.kind in ("fence", "code") or n.name in ("code", "pre")
        options = (s[TEXT] + free, s[WRAP] + (text if code else free), s[WASTE] + waste)
        below[id(n)] = (max(options), s[TEXT] + text, s[WASTE] + waste)
        n.label = int(np.argmax(options))

    def settle(n: Node, forced: int | None) -> None:
        if forced is not None:
            n.label = forced
        if n.partner is not None:
            n.partner.label = n.label
        code = n.kind in ("fence", "code") or n.name in ("code", "pre")
        down = WASTE if n.label == WASTE else TEXT if forced == TEXT or (code and n.label == WRAP) else None
        for c in n.children:
            if id(c) not in follows:
                settle(c, down)

    for n in nodes:
        if n.parent is None and id(n) not in follows:
            settle(n, None)
    # A pair can overlap another without lying in it; its closing mark follows all the same.
    for n in nodes:
        if id(n) in follows:
            n.label = n.partner.label


# ---- labelled examples -------------------------------------------------------------------------------------------

_PHRASES = "請於期限內完成登記|系辦公室將公布名單|專題成果發表會 12 點開始|共 35 人參加|申請表另行寄送|The lab opens at nine|Please return 12 forms|各組需準備簡報檔|地點改至三樓會議室|2024-05-01 起受理|本週值班表已更新|Room 305 is closed|成績計算以公告為準|共計 48213 元整|分機 7730 轉 12|In week 1288 of 2031|自112年10月8日起|09:45 至 17:30 開放".split("|")


def examples(count: int = 3000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with the true label of spans in them: markup of the four languages and ordinary text that resembles it."""
    rng = np.random.RandomState(seed)
    pick = lambda xs: xs[rng.randint(len(xs))]
    num = lambda: str(rng.randint(1, 99))
    word = lambda: pick(_PHRASES)[: rng.randint(2, 9)]
    wrap = lambda a, b: [(a, WRAP), (pick(_PHRASES), None), (b, WRAP)]
    line = lambda parts: [("\n", None), *parts, ("\n", None)]
    tags = ["p", "b", "i", "em", "strong", "span", "div", "a", "td", "li", "ul", "h2", "h3", "font", "u"]
    inline = [
        lambda: wrap(f"<{(t := pick(tags))}{pick(['', '', ' class=x', ' style="color:#123456"', ' href="https://a.example/1"'])}>", f"</{pick([t, t, t.upper()])}>"),
        lambda: [(pick(["<br>", "<br/>", "<BR />", "<hr>", "<p>", "</p>", "</div>", "<li>", "</span>", '<span style="color:#001122">', "<img src=a.png>"]), WRAP)],
        lambda: [(f"<!-- {word()} {num()} -->", WASTE)],
        lambda: [("<script>", WASTE), (f"var k={num()};run(k);", None), ("</script>", WASTE)],
        lambda: [(pick(["&nbsp;", "&lt;", "&amp;", "&#8226;", "&#x4E2D;", "&quot;", "&hellip;", "&copy;"]), WRAP)],
        lambda: [(f"`{pick(['make -j ', 'run ', 'x=', 'ls /tmp/'])}{num()}`", WRAP)],
        lambda: [(f"![{word()}](img/{num()}.png)", WASTE)],
        lambda: [(f"[{word()}](https://a.example/{num()})", WRAP)],
        lambda: wrap(*[pick(["**", "***", "__", "~~", "'''", "''", "'''''"])] * 2),
        lambda: [(pick(["**", "***", "'''", "~~"]), WRAP)],
        lambda: [(num(), None), (m := (pick(["**", "***", "__", "~~"]), WRAP)), (num() + pick(["", " 元，", "-", ":00 "]), None), m, (num(), None)],
        lambda: [(f"[[{word()}]]", WRAP)] if rng.rand() < 0.5 else [(f"[[{word()}|{word()}]]", WRAP)],
        lambda: [(f"[[{pick(['檔案', 'File', 'Image'])}:{word()}.png|thumb]]", WASTE)],
        lambda: [("{{" + word() + f"|n={num()}" + "}}", WASTE)],
        lambda: [(pick([f"$O(n^{{{num()}}}\\log n)$", f"\\(\\frac{{{num()}}}{{x_1}}\\)", f"\\[ S = \\sum_{{i=1}}^{{{num()}}} a_i \\]", f"$x_{num()} + y^2$", "$\\alpha$"]), WRAP)],
        lambda: [(f"\\{pick(['textbf', 'emph', 'underline', 'section', 'subsection', 'paragraph', 'textit', 'texttt'])}{{{word()}}}", WRAP)],
        lambda: [(f"\\{pick(['footnote', 'footnote', 'label', 'includegraphics'])}{{{word()} {num()}}}", WASTE)],
        lambda: [("\\begin{itemize}", WRAP), ("\\item ", WRAP), (pick(_PHRASES), None), ("\\end{itemize}", WRAP)],
        lambda: line([(pick(["# ", "## ", "### ", "#### "]), WRAP), (word(), None)]),
        lambda: line([("> ", WRAP), (pick(_PHRASES), None)]),
        lambda: line([("```", WRAP), (f"\nx = a[{num()}]\n", None), ("```", WRAP)]),
        lambda: line([((h := pick(["==", "==="])), WRAP), (f" {word()} ", None), (h, WRAP)]),
        lambda: line([("{| class=wikitable", WRAP), ("\n", None), ("|-", WRAP), ("\n", None), (f"| {word()} || {num()}", WRAP), ("\n", None), ("|}", WRAP)]),
        lambda: line([(f"| {word()} | {num()} |", WRAP), ("\n", None), ("|---|---:|", WRAP), ("\n", None), (f"| {word()} | {num()} |", WRAP)]),
        lambda: line([(pick(["* ", "+ ", "• "]), WRAP), (pick(_PHRASES), None)]),
        lambda: line([(pick(["---", "***", "___"]), WRAP)]),
        lambda: line([(f"| {word()}", WRAP)]),
    ]
    plain = [
        lambda: f"若比例 < {num()}% 且 > {num()}% 則重算",
        lambda: f"條件 x == {num()} 時成立，a != b 時不成立",
        lambda: f"甲 -> 乙 -> 丙 共 {num()} 站 <-> A => B",
        lambda: f"費用 $ {num()}00 元，押金 ${num()}0。",
        lambda: f"price $ {num()} and ${num()}.50 in total",
        lambda: f"#活動快報 #第{num()}期",
        lambda: f"參考[{num()}]及[{num()}]。",
        lambda: f"路徑為 D:\\data\\{num()}\\logs 與 C:\\temp\\item\\a.txt",
        lambda: f"檔名 file_{num()}_v{num()}_final.pdf 與 a_b_c",
        lambda: "信箱為 <帳號>@mail.example，<name> 請自填",
        lambda: "標題寫 {系所}{姓名} 或 {name}",
        lambda: f"面積 {num()}*{num()}*{num()} 公分，{num()} * {num()}",
        lambda: "會用 C# 或 F# 者佳，A# 調",
        lambda: "R&D 部與 Q&A 時間，AT&T",
        lambda: f"時間 {num()}~{num()} 週，約 ~{num()} 分",
        lambda: f"\n- {word()}\n1) {word()} 2) {word()}\n",
        lambda: f"It's the students' {num()} forms",
        lambda: f"a | b 擇一，第 {num()} 版",
    ]
    out = []
    for _ in range(count):
        parts: list[tuple[str, int | None]] = []
        for _ in range(rng.randint(2, 7)):
            r = rng.rand()
            if r < 0.65:
                parts += [(pick(_PHRASES) + pick(["。", "，", " ", ""]), None)] if r < 0.35 else [(pick(plain)(), TEXT)]
                continue
            # Marks stand anywhere, also within a word or a number.
            around, marks = pick(_PHRASES), pick(inline)()
            if rng.rand() < 0.3:
                marks = [*marks, (pick(["", " ", "，"]), None), *pick(inline)()]
            if rng.rand() < 0.3 and not marks[0][0].startswith("\n"):
                marks = [(" ", None), *marks, (" ", None)]
            cut = rng.randint(len(around) + 1) if rng.rand() < 0.7 and not marks[0][0].startswith("\n") else 0
            parts += [(around[:cut], None), *marks, (around[cut:], None)]
        text, spans = "", []
        for s, label in parts:
            if label is not None:
                spans.append((len(text), len(text) + len(s), label))
            text += s
        out.append((text, spans))
    return out


def labelled(sample: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, spans in sample:
        nodes = parse(text)
        if not nodes:
            continue
        y = []
        for n in nodes:
            over = [lab for a, b, lab in spans if a < n.end and n.start < b]
            # What stands in waste goes with it; other words between spans are text.
            y.append(max(over, default=TEXT))
        xs.append(features(text, nodes))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(2)
def model(count: int = 3000, seed: int = 7) -> BoostedTrees:
    """Fitted on ``count`` made-up labelled texts; nothing of the input is needed, so it is the same at every size."""
    return BoostedTrees().fit(*labelled(examples(count, seed)))


def stored_model(spark: SparkSession, count: int = 3000, seed: int = 7) -> BoostedTrees:
    """``model``, fitted once for all sessions that share a folder: it is kept there under a name that its code gives."""
    name = hashlib.sha256(f"{count} {seed} {Path(__file__).read_text()}".encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/quern/models/markup-{name}"
    if (path, count, seed) not in _models:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            _models[path, count, seed] = pickle.loads(spark.read.parquet(path).first()[0])
        else:
            _models[path, count, seed] = model(count, seed)
            spark.createDataFrame([(bytearray(pickle.dumps(_models[path, count, seed])),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _models[path, count, seed]


_models: dict[tuple[str, int, int], BoostedTrees] = {}


# ---- rendering ---------------------------------------------------------------------------------------------------

_SYMBOL = {"sum": "Σ", "prod": "Π", "int": "∫", "infty": "∞", "times": "×", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "pm": "±", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "theta": "θ", "omega": "ω", "partial": "∂", "ldots": "…", "quad": " ", "left": "", "right": ""}


def formula(tex: str) -> str:
    """A formula in one line of plain signs."""
    s = re.sub(r"^(?:\\[\[(]|\$\$?)\s*|\s*(?:\\[\])]|\$\$?)$", "", tex)
    for _ in range(4):
        s = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m[1] + (m[2] if len(m[2]) == 1 else f"({m[2]})"), s)
        s = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", s)
        s = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", s)
        s = re.sub(r"\\(?:mathrm|mathbf|mathbb|text\w*)\{([^{}]*)\}", r"\1", s)
    return re.sub(r"\\([A-Za-z]+)", lambda m: _SYMBOL.get(m[1], m[1]), s).replace("{", "").replace("}", "")


#: A heading's level stands before it as so many signs.
LEVEL = "§"
#: Levels of LaTeX headings.
_LATEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _heading(level: int) -> str:
    return f"\n\n{LEVEL * level} "


def _raised(inner: str, sign: str) -> str:
    return sign + (inner if len(inner) < 2 or inner.isdigit() else f"({inner})")


def _shown(n: Node) -> str:
    """What stands for a wrapper's own marks; the content of pairs stands between them in the text."""
    raw, kind = n.raw, n.kind
    first = n.partner is None or n.partner.start > n.start
    if kind == "entity":
        plain = html.unescape(raw)
        return " " if plain == "\xa0" else plain
    if kind in ("open", "close"):
        if n.name == "li":
            return "\n- " if kind == "open" else "\n"
        if n.name in ("td", "th"):
            return "｜" if kind == "close" else ""
        if n.name in ("sup", "sub"):
            return {"sup": "^", "sub": "_"}[n.name] if kind == "open" and n.partner is not None else ""
        if n.name[0] == "h" and n.name[1:].isdigit():
            return _heading(int(n.name[1:])) if kind == "open" and n.partner is not None else "\n\n"
        return "\n" if n.name in BLOCKS else ""
    if kind in ("link", "wikilink"):
        inner = raw.strip("[]")
        if kind == "wikilink":
            return inner.split("|")[-1]
        return raw[1 : raw.index("](")] if "](" in raw else inner.split(" ", 1)[1]
    if kind == "math":
        return formula(raw) if len(raw) > 2 else ""
    if kind == "command":
        if n.name == "item":
            return "\n- " + raw[5:].strip("{}")
        inner = "".join(re.findall(r"\{([^{}]*)\}", raw))
        if n.name in ("textsuperscript", "textsubscript") and inner:
            return _raised(inner, "^" if n.name == "textsuperscript" else "_")
        return f"{_heading(_LATEX_LEVEL[n.name])}{inner}\n\n" if n.name in _LATEX_LEVEL and inner else inner or _SYMBOL.get(n.name, "")
    if kind == "row":
        cells = [c.strip() for c in re.split(r"\|\||!!|\|", raw.strip("|! "))]
        return "" if all(re.fullmatch(r":?-+:?", c) for c in cells) else "｜".join(cells)
    if kind == "env":
        return "\n"
    if kind == "bullet":
        return "- "
    if kind == "wikihead":
        return (_heading(len(raw.strip())) if first and n.partner is not None else "\n")
    if kind == "heading":
        return _heading(raw.count("#"))
    if kind in ("angle", "bracket", "brace"):
        return raw[1:-1]
    return ""


#: Noncharacters that hold the place of code until all else is clean, so that marks within code stay.
_HELD, _END = "\ufdd0", "\ufdd1"


def _code(n: Node, text: str) -> str | None:
    """What an inline or block of code stands for; a block is indented by four spaces. None: no code."""
    if n.kind == "code":
        return n.raw.strip("`")
    if n.partner is None or n.partner.start < n.start or n.kind not in ("fence", "open") or (n.kind == "open" and n.name not in ("pre", "code")):
        return None
    inner = text[n.end : n.partner.start]
    if n.kind == "open" and n.name == "code":
        return html.unescape(inner)
    if n.kind == "open":
        inner = html.unescape(re.sub(r"(?i)^\s*<code[^<>]*>|</code\s*>\s*$", "", inner))
    lines = inner.strip("\n").split("\n")
    return "\n" + "\n".join("    " + x.rstrip() if x.strip() else "" for x in lines) + "\n"


def restored(text: str, held: list[str]) -> str:
    return re.sub(f"{_HELD}(\\d+){_END}", lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], text) if held else text


def clean(text: str, trees: BoostedTrees, scores: np.ndarray | None = None, nodes: list[Node] | None = None, held: list[str] | None = None) -> tuple[str, int]:
    """The text without its markup, and how many nodes of markup it held. held: takes the code, whose places stay marked."""
    nodes = parse(text) if nodes is None else nodes
    if not nodes:
        return text, 0
    decode(nodes, trees.log_probabilities(features(text, nodes)) if scores is None else scores)
    kept = [] if held is None else held
    out, at, found = [], 0, 0
    for n in nodes:
        if n.start < at:
            found += n.label != TEXT and (n.parent is None or n.parent.label != WASTE)
            continue
        if n.label == TEXT:
            continue
        found += 1
        out.append(text[at : n.start])
        at = n.end
        if n.label == WRAP:
            if (code := _code(n, text)) is not None:
                out.append(f"{_HELD}{len(kept)}{_END}")
                kept.append(code)
                at = n.end if n.partner is None else n.partner.end
            else:
                out.append(_shown(n))
        elif n.partner is not None and n.partner.start > n.start:
            at = n.partner.end
    out.append(text[at:])
    plain = "".join(out)
    if found:
        plain = re.sub(r"[ \t]+\n", "\n", re.sub(r"｜(?=\s|$)", "", plain))
        plain = re.sub(r"(?m)^- +", "- ", plain)
        plain = re.sub(r"\n{3,}", "\n\n", plain).strip()
    return (restored(plain, kept).strip("\n") if held is None else plain), found


def _cleaner(trees: BoostedTrees):
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("found", T.IntegerType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        plain, parsed, parts = [], [], []
        for t in texts:
            # Invisible characters and odd forms can hide marks, so they go first.
            t = t if t is None or t.isascii() or not _SUSPECT.search(t) else canonical(t)[0]
            nodes = parse(t) if t else []
            plain.append(t)
            parsed.append(nodes)
            if nodes:
                parts.append(features(t, nodes))
        scores = trees.log_probabilities(np.concatenate(parts)) if parts else None
        rows, at = [], 0
        for t, nodes in zip(plain, parsed, strict=True):
            held: list[str] = []
            now, found = clean(t, trees, scores[at : at + len(nodes)], nodes, held) if nodes else (t, 0)
            # Marks that another mark hid show once that one is gone; code keeps its own.
            while nodes and found and (again := clean(now, trees, held=held))[1] and again[0] != now:
                now, found = again[0], found + again[1]
            rows.append((restored(now, held).strip("\n") if held else now, found))
            at += len(nodes)
        return pd.DataFrame(rows, columns=["text", "found"])

    return run


_SUSPECT = re.compile(SUSPECT)


def with_clean_text(df: DataFrame, column: str, out: str = "clean_text", found: str = "markup", training_texts: int = 3000) -> DataFrame:
    """``df`` with the text of ``column`` without markup, and the number of markup nodes that it held.

    Kept are headings (lines of their own, after as many ``§`` as their level), list items (``- ``), table rows (cells
    joined by ``｜``), code with all its characters (blocks indented by four spaces), raised and lowered text (``^``,
    ``_``) and, in plain signs, formulas; comments, scripts, images, templates and footnotes go. Null stays null with 0; a text without
    markup stays as it is. Whole texts are read; only rows with a candidate character visit Python. The model is fitted
    on ``training_texts`` made-up examples. Columns named like the results are replaced, all others are kept.
    """
    c = F.col(f"`{column}`")
    candidate = c.rlike(f"(?m){CANDIDATE}") | c.rlike("[\\uff00-\\uffef]") & c.rlike("[＜＞＆｀＼＄＊＿～［］｛｝｜＃＝＇]")
    done = df.withColumn("__clean", _cleaner(stored_model(df.sparkSession, training_texts))(F.when(candidate, c)))
    return done.withColumns({out: F.when(candidate, F.col("__clean.text")).otherwise(c), found: F.coalesce(F.col("__clean.found"), F.lit(0))}).drop("__clean")
