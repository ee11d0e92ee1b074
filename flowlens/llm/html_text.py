"""Operator 10, HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score by the element they
stand in (its name and first class), tags by their name; the weights are
log-odds of standing inside the content, learned from labelled pages: a
bounded sample (``LABELLED_PAGES``) of pages whose own markup names the
content element.  A linear scan finds the contiguous region of the largest
sum.  Elements that are never article text hardly count and are left out of
the region: those named in ``SKIP``, and those with one of ``HINTS`` as a whole
word of their class, id or role (``share``).  A part of a longer name
(``share-price``) is a hint outside an article or main only; inside one such an
element scores by its learned weight.  An article or main without a hint of its
own counts inside a hinted element, not inside a ``SKIP`` one.  Blocks are
decoded, their white space made single spaces, and joined by an empty line.

A page is read once, from left to right; open elements are looked up by name,
so the time is linear in the page whatever its markup.

Defined cases: null or empty html, or no region of positive score, gives an
empty text; an element that is never closed ends with the page; a page
without labelled pages to learn from uses ``DEFAULT`` weights; among regions
of equal score the first, shortest one counts; repeated rows give repeated
results; an empty table an empty one; other columns are not read; what follows a tag that
no ``>`` ends is text, and a quote that none closes is an ordinary character.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import map_columns

LABELLED_PAGES = 2000
CONTENT = ("article", "main")

#: Elements without article text, and words of class, id or role that mark such.
SKIP = frozenset("nav header footer aside form script style noscript template iframe svg canvas button "
                 "select textarea head title menu dialog object".split())
HINTS = frozenset("ad ads advert adverts advertisement banner sidebar notice cookie cookies consent menu "
                  "navigation navbar nav footer header promo sponsored comment comments reply replies "
                  "disqus share social related breadcrumb breadcrumbs newsletter subscribe popup".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Weights when there are no labelled pages: words by element, tags by name.
DEFAULT = {"p": 1.0, "h1": 1.0, "h2": 1.0, "h3": 1.0, "li": 0.5, "td": 0.3, "div": 0.3,
           "blockquote": 1.0, "pre": 1.0, "article": 1.0, "main": 1.0, "li>a": -1.0}
WORD_DEFAULT, TAG_DEFAULT, SKIP_WORD = 0.1, -0.5, -0.05
CLAMP = 4.0

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOPS = re.compile(r"""[>"']""")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_P_ENDS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li table section article main blockquote pre footer "
                    "header nav aside form dl figure hr".split())


def tokens(page: str):
    """("text", string, ""), ("open", name, attributes), ("close", name, "") and
    ("void", name, attributes) for a tag that ends itself, in page order.  The
    contents of raw elements and comments are left out."""
    at, n = 0, len(page)
    unpaired = {'"': n + 1, "'": n + 1}     # from here on no such quote is closed

    def end_of_tag(i: int) -> int:
        """Place of the ``>`` of a tag, quotes skipped; -1 if there is none."""
        while (m := _STOPS.search(page, i)) is not None:
            i, c = m.end(), m.group()
            if c == ">":
                return m.start()
            if i < unpaired[c]:
                close = page.find(c, i)
                if close < 0:
                    unpaired[c] = i
                else:
                    i = close + 1
        return -1
    text = 0
    while (at := page.find("<", at)) >= 0:
        start, follows = at, page[at + 1:at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            kind = name = attributes = ""
        elif follows in ("!", "?") and follows:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            kind = name = attributes = ""
        else:
            closing = follows == "/"
            m = _NAME.match(page, at + 1 + closing)
            if m is None:
                at += 1
                if closing and (end := page.find(">", at)) >= 0:  # "</" without a name hides up to its end
                    at, kind, name, attributes = end + 1, "", "", ""
                else:
                    continue
            else:
                end = end_of_tag(m.end())
                if end < 0:
                    break
                name, attributes = m.group().lower(), page[m.end():end]
                kind = "close" if closing else "void" if attributes.endswith("/") or name in VOID else "open"
                at = end + 1
        if start > text:
            yield "text", page[text:start], ""
        if kind:
            yield kind, name, attributes
            if kind == "open" and name in RAW:
                m = _RAW_END[name].search(page, at)
                end = page.find(">", m.end()) if m else -1
                at = n if end < 0 else end + 1
                yield "close", name, ""
        text = at
    if text < n:
        yield "text", page[text:], ""


class _Open:
    """The open elements, with their names counted and the places of
    paragraphs and of what a paragraph's end does not pass."""

    def __init__(self):
        self.stack: list[tuple[str, str, int, bool]] = []  # name, key, skipped (1 by a hint, 2 by its name), in content
        self.names: Counter = Counter()
        self.paragraphs: list[int] = []
        self.walls: list[int] = []

    def top(self):
        return self.stack[-1] if self.stack else ("", "", 0, False)

    def push(self, element) -> None:
        name = element[0]
        if name == "p":
            self.paragraphs.append(len(self.stack))
        elif name not in INLINE:
            self.walls.append(len(self.stack))
        self.names[name] += 1
        self.stack.append(element)

    def pop(self):
        element = self.stack.pop()
        self.names[element[0]] -= 1
        for places in (self.paragraphs, self.walls):
            if places and places[-1] == len(self.stack):
                places.pop()
        return element

    def close(self, name: str):
        """Close the innermost element of that name, and all in it."""
        if not self.names[name]:
            return None
        while True:
            element = self.pop()
            if element[0] == name:
                return element

    def end_paragraph(self) -> None:
        """A new block ends an open paragraph and what stands in it."""
        if self.paragraphs and (not self.walls or self.walls[-1] < self.paragraphs[-1]):
            at = self.paragraphs[-1]
            while len(self.stack) > at:
                self.pop()


def hinted(attributes: str, content: bool) -> tuple[bool, str]:
    """Whether class, id or role name what is no article text, and the word
    that stands for the class in a key."""
    marks = [v.strip("\"'").lower() for _, v in _MARK.findall(attributes)] if attributes else []
    words = {w for v in marks for w in _WORDS.findall(v)}
    whole = {w for v in marks for w in v.split()}
    return bool((whole if content else words) & HINTS), min(words) if words else ""


def events(page: str):
    """("text", string, key, skipped, content), ("open" | "close", name, "",
    skipped, content) in page order.  ``key`` names the element around."""
    around = _Open()
    for kind, value, attributes in tokens(page):
        _, key, skipped, content = around.top()
        if kind == "text":
            yield "text", value, key, skipped > 0, content
            continue
        if kind == "close":
            if (element := around.close(value)) is not None:
                yield "close", value, "", element[2] > 0, element[3]
            continue
        if value in _P_ENDS and value != "hr":
            around.end_paragraph()
            _, key, skipped, content = around.top()
        hint, word = hinted(attributes, content)
        if value in SKIP:
            skipped = 2
        elif value in CONTENT:
            skipped = skipped if hint or skipped == 2 else 0
        elif hint and value not in ("html", "body"):
            skipped = max(skipped, 1)
        content = content or value in CONTENT
        yield "open", value, "", skipped > 0, content
        if kind == "void":
            continue
        if value in INLINE:
            key = f"{key}>a" if value == "a" and not key.endswith(">a") else key
        else:
            key = f"{value}.{word}" if word else value
        around.push((value, key, skipped, content))


def key_of(kind: str, value: str, key: str) -> str:
    return f"w:{key}" if kind == "text" else f"t:{value}" if kind == "open" else f"t:/{value}"


def tally(page: str) -> Counter:
    """Counts of (key, inside the content) of a labelled page."""
    out: Counter = Counter()
    for kind, value, key, skipped, content in events(page):
        n = len(value.split()) if kind == "text" else 1
        if n and not skipped:
            out[key_of(kind, value, key), content] += n
    return out


def learn(counts: Counter) -> dict[str, float]:
    """Log-odds of standing inside, clamped; empty without labelled words."""
    inside = {k: n for (k, c), n in counts.items() if c}
    outside = {k: n for (k, c), n in counts.items() if not c}
    if not inside:
        return {}
    out = {}
    for k in {*inside, *outside}:
        odds = math.log((inside.get(k, 0) + 0.5) / (outside.get(k, 0) + 0.5))
        odds = max(-CLAMP, min(CLAMP, odds))
        # tags separate: they never raise a region's score, words may
        out[k] = odds if k[0] == "w" else min(0.0, odds) - 0.01
    return out


def word_weight(key: str, weights: dict[str, float]) -> float:
    """The learned weight, else that of the element around, else a default."""
    if f"w:{key}" not in weights and key not in DEFAULT:
        key = key.partition(">")[0]
    return weights.get(f"w:{key}", DEFAULT.get(key, WORD_DEFAULT))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the maximum-scoring contiguous region; (0, 0) if none
    is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    items = list(events(page))
    scores = []
    for kind, value, key, skipped, _ in items:
        if kind == "text":
            words = len(value.split())
            scores.append(words * (SKIP_WORD if skipped else word_weight(key, weights)) if words else 0.0)
        else:
            scores.append(0.0 if skipped or value in INLINE else weights.get(key_of(kind, value, ""), TAG_DEFAULT))
    start, end = best_region(scores)
    blocks, run = [], []
    for kind, value, _, skipped, _ in items[start:end]:
        if kind == "text":
            if not skipped:
                run.append(value)
        elif value not in INLINE:
            blocks.append(run)
            run = []
        elif value == "br":
            run.append(" ")
    blocks.append(run)
    texts = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
        sample: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``sample`` pages at most, those with a hash of their
    id below a threshold; Spark counts, the driver gets one row per element
    name."""
    chosen = pages.where(F.col(id_col).isNotNull())
    n = chosen.count()
    if n > sample:
        chosen = chosen.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    chosen = chosen.select(F.col(html_col).alias("html")).where(F.lower("html").rlike("<(article|main)\\b"))

    def count(rows):
        total: Counter = Counter()
        for page in rows["html"]:
            total.update(tally(page))
        return {"key": [k for k, _ in total], "inside": [c for _, c in total], "n": list(total.values())}
    rows = map_columns(chosen, count, "key string, inside boolean, n long") \
        .groupBy("key", "inside").agg(F.sum("n").alias("n")).collect()
    return learn(Counter({(r.key, r.inside): r.n for r in rows}))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  sample: int = LABELLED_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; a map over rows."""
    weights = fit(pages, id_col, html_col, sample)

    def run(rows):
        texts = [extract(h, weights) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    return map_columns(picked, run, "page_id long, url string, text string, n_chars long")
