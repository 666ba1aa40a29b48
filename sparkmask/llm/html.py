"""HTML extraction by the maximum-scoring subsequence of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative.  Elements that are parts of the
site (menus, adverts, comments) add nothing; which ones are, is told by weights of their tag, names and place.  All
weights are learned from labelled pages of many layouts.  One linear scan finds the contiguous region of the greatest
sum, and its blocks become the text.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmask.functions.identifiers import column

from . import labelled_pages
from .common import numbered, pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|textarea|title|svg|iframe)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<name>/?[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*|/)?)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements without content, and elements that don't end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img "
    "ruby rb rt rp".split()
)
#: Elements that a new block ends when they were left open.
_CLOSED_BY_BLOCK = frozenset(["p", *INLINE])
#: Weight of a word of the article, least cost of a tag, and how much weight a log-odds unit of a tag has.
WORD, TAG, TAG_SCALE = 1.0, -0.02, 2.0
#: How often training must show a name for it to have a weight of its own; rarer ones count as unknown.
SEEN = 4
#: Steps and decay of the logistic regression over elements.
STEPS, DECAY = 800, 1e-4


class Token:
    """A run of text or a tag, and the element it belongs to."""

    __slots__ = ("element", "kind", "name", "text")

    def __init__(self, kind: str, name: str, element: int, text: str = ""):
        self.kind, self.name, self.element, self.text = kind, name, element, text


class Page:
    """The tokens of a page in order, and its elements with what is known of each."""

    def __init__(self, page: str):
        self.tokens: list[Token] = []
        self.tags, self.parents, self.names, self.facts = ["#page"], [-1], [()], [set()]
        open_, words = [0], [0]
        for m in _TOKEN.finditer(page):
            name = m["name"]
            if name is None:
                text = m[0]
                if not (text.startswith("<") and len(text) > 1 or m["raw"]):  # else a comment, a declaration, or no text
                    self.tokens.append(Token("text", "", open_[-1], text))
                    words[open_[-1]] += len(text.split())
                continue
            name = name.lower()
            if name.startswith("/"):
                owner = open_[-1]
                if any(self.tags[e] == name[1:] for e in open_[1:]):
                    while self.tags[owner := open_.pop()] != name[1:]:
                        pass
                self.tokens.append(Token("tag", name, owner))
                continue
            if name not in INLINE and name != "br":
                while self.tags[open_[-1]] in _CLOSED_BY_BLOCK and any(self.tags[e] == "p" for e in open_[-8:]):
                    open_.pop()
            if name in VOID:
                self.tokens.append(Token("tag", name, open_[-1]))
                continue
            names = [w for groups in _HINT.findall(m["attrs"]) for w in re.split(r"[^a-z]+", "".join(groups).lower()) if w] if m["attrs"] else ()
            self.tags.append(name)
            self.parents.append(open_[-1])
            self.names.append(names)
            words.append(0)
            self.facts.append({"in:article"} & self.facts[open_[-1]] | ({"in:article"} if self.tags[open_[-1]] in ("article", "main") else set()))
            if name in ("h1", "article", "main"):
                for e in open_:
                    self.facts[e].add("holds:" + name)
            self.tokens.append(Token("tag", name, len(self.tags) - 1))
            if not m["attrs"].endswith("/"):
                open_.append(len(self.tags) - 1)
        linked = [n if t == "a" else 0 for n, t in zip(words, self.tags, strict=True)]
        for e in range(len(self.tags) - 1, 0, -1):
            words[self.parents[e]] += words[e]
            linked[self.parents[e]] += linked[e]
            if 2 * linked[e] > words[e]:
                self.facts[e].add("mostly:links")
            if not self.names[e]:
                self.facts[e].add("bare:" + self.tags[e])

    def features(self, element: int) -> list[str]:
        return ["<" + self.tags[element], *self.facts[element], *self.names[element]]

    def hidden(self, model: dict) -> list[bool]:
        """Whether each element is a part of the site rather than of the article, or lies in one."""
        weights, unknown, out, known = model["elements"], model["elements"].get("?", 0.0), [False], {}
        for e in range(1, len(self.tags)):
            if out[self.parents[e]]:
                out.append(True)
                continue
            key = (self.tags[e], *sorted(self.facts[e]), *self.names[e])
            if key not in known:
                given = set(self.features(e))
                known[key] = model["bias"] + sum(weights.get(f, 0.0) for f in given) + unknown * any(f not in weights for f in given if f[0] != "<") < 0
            out.append(known[key])
        return out


def _examples(page: str) -> tuple[Page, list[tuple[int, bool]], list[bool]]:
    """A labelled page, elements with whether they hold or belong to the article, and whether each token is the article's.

    An element that holds no word of the article counts once, not with all that it holds.
    """
    given = Page(re.sub(r"\[\[\[|\]\]\]|\{\{\{|\}\}\}", lambda m: {"[[[": "<wbr x-in>", "]]]": "<wbr x-out>", "{{{": "<wbr x-out>", "}}}": "<wbr x-in>"}[m[0]], page))
    ours, now, good, filled = [], False, set(), set()
    marks = iter(re.findall(r"\[\[\[|\]\]\]|\{\{\{|\}\}\}", page))
    for t in given.tokens:
        if t.name == "wbr":
            now = next(marks) in ("[[[", "}}}")
        ours.append(now)
        if t.kind == "text" and t.text.strip():
            e = t.element
            while e >= 0:
                filled.add(e)
                if now:
                    good.add(e)
                e = given.parents[e]
    shown = [e for e in range(1, len(given.tags)) if e in good or e in filled and (given.parents[e] in good or given.parents[e] == 0)]
    return given, [(e, e in good) for e in shown], ours


def learn(labelled: list[str]) -> dict:
    """What tells parts of a site from an article: weights of elements, their names and places by logistic regression, of
    block tags by log-odds of standing inside the article, and of a word in a link beside one that isn't."""
    examples = [_examples(p) for p in labelled]
    rows = [(set(page.features(e)), good) for page, shown, _ in examples for e, good in shown]
    seen = Counter(f for given, _ in rows for f in given)
    names = sorted(f for f, n in seen.items() if n >= SEEN)
    column = {f: i for i, f in enumerate([*names, "?"])}
    x = np.zeros((len(rows), len(column)))
    for i, (given, _) in enumerate(rows):
        for f in given:
            if f in column or f[0] != "<":
                x[i, column.get(f, len(names))] = 1
    y = np.array([good for _, good in rows], float)
    w, bias, first, second = np.zeros(len(column)), 0.0, np.zeros(len(column) + 1), np.zeros(len(column) + 1)
    for step in range(1, STEPS + 1 if len(rows) else 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y) / len(y)
        g = np.append(x.T @ error + DECAY * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    model = {"elements": {f: float(w[i]) for f, i in column.items()}, "bias": float(bias)}
    inside, outside, words = Counter(), Counter(), Counter()
    for page, _, ours in examples:
        hidden = page.hidden(model)
        for t, now in zip(page.tokens, ours, strict=True):
            if hidden[t.element]:
                continue
            if t.kind == "text":
                words[now, page.tags[t.element] == "a"] += len(t.text.split())
            elif t.name.lstrip("/") not in INLINE:
                (inside if now else outside)[t.name] += 1
    odds = lambda a, b, n, m: math.log((a + 0.5) / (n + 1)) - math.log((b + 0.5) / (m + 1))
    total = sum(inside.values()), sum(outside.values())
    model["tags"] = {n: min(TAG, TAG_SCALE * (odds(inside[n], outside[n], *total) - 0.5)) for n in inside | outside}
    link, plain = (odds(words[True, k], words[False, k], words[True, True] + words[True, False], words[False, True] + words[False, False]) for k in (True, False))
    model["link"] = min(WORD, max(-WORD, WORD + link - plain))
    return model


def region(page: Page, hidden: list[bool], model: dict) -> tuple[int, int]:
    """Bounds of the tokens with the greatest sum; the first of equals; (0, 0) where no sum is positive.

    Parts of the site add nothing and cost nothing, however long they are.
    """
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    weights, unknown = model["tags"], 2 * TAG
    for i, t in enumerate(page.tokens):
        if hidden[t.element]:
            continue
        if t.kind == "text":
            total += (model["link"] if page.tags[t.element] == "a" else WORD) * len(t.text.split())
        else:
            total += weights.get(t.name, unknown)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def extract(text: str | None, model: dict) -> str:
    """The article's blocks, joined by an empty line; empty for null, empty and wordless pages.

    Where all words stand in parts of the site, no part is left out.
    """
    if not text:
        return ""
    page = Page(text)
    hidden = page.hidden(model)
    start, end = region(page, hidden, model)
    if start == end:
        hidden = [False] * len(hidden)
        start, end = region(page, hidden, model)
    blocks, now = [], []
    for t in page.tokens[start:end]:
        if t.kind == "text":
            if not hidden[t.element]:
                now.append(html.unescape(t.text))
        elif t.name in ("br", "/br"):
            now.append(" ")
        elif t.name.lstrip("/") not in INLINE:
            blocks.append(" ".join("".join(now).split()))
            now = []
    blocks.append(" ".join("".join(now).split()))
    return "\n\n".join(b for b in blocks if b)


def article_text(pages: DataFrame, html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """All columns but the page itself, with text and n_chars (code points).

    Null and empty pages give an empty text.  Columns called text and n_chars are replaced.  Rows with equal ids or
    pages are rows of their own.
    """
    model = learn(labelled_pages.pages() if labelled is None else labelled)
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    given = pages.select(*map(column, names), column(html_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            text = pa.array([extract(p, model) for p in b.column(len(names)).to_pylist()], pa.string())
            yield pa.record_batch([*b.columns[:-1], text], b.schema.names)

    given = numbered(given)
    out = given.mapInArrow(run, given.schema).toDF(*names, "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
