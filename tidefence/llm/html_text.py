"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a word loses score where it stands in
a link, in a list or cell, or inside an element that is, or calls itself by class, id or role, a menu, header,
footer, sidebar, advert, notice, form or comment. A class or id counts only if all its parts are such words or words of layout, so
``promotion-history`` says nothing, and an id only on elements that hold blocks. One linear scan finds the contiguous region with the largest total.
Within it, blocks that score below zero as a whole are left out, so an advert in the middle of an article goes although the
region spans it.

The weights are log odds counted on labelled pages: a small corpus that ``html_training`` builds, in which every
stretch of markup is known to be content or not.

Blocks are separated by block-level tags. Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by two newlines. Inline tags do not separate words; a line break does.

Cases: null, empty and text-free pages give an empty text. Unclosed elements, comments and quotes are tolerated: an open element ends
with its parent, an open comment with the page. Among regions of equal score the first one wins. Very long pages are scanned once, in linear time.
Open elements are counted by name, so neither unclosed nor nested tags cost more. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option button datalist audio video map head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
KIND_OF_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
# Words in class, id and role that name a kind of element.
KIND_OF_HINT = {
    word: kind
    for kind, words in {
        "advert": "ad ads adbox adv advert adverts advertisement advertising adsbygoogle adsense adslot sponsor sponsored promo promotion promoted dfp taboola outbrain",
        "menu": "nav navbar topnav sidenav subnav mainnav navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs",
        "header": "header siteheader pageheader masthead topbar branding logo banner",
        "footer": "footer sitefooter pagefooter copyright colophon contentinfo",
        "sidebar": "sidebar aside widget widgets related recommended recommendations trending popular complementary share sharing social follow",
        "comment": "comment comments commentlist disqus reply replies respond guestbook",
        "notice": "cookie cookies consent gdpr notice disclaimer interstitial alert popup modal overlay newsletter subscribe subscription signup paywall toast",
        "form": "form login search",
    }.items()
    for word in words.split()
}
# Words in class and id that name a part of a layout and no kind.
PARTS_OF_LAYOUT = frozenset(
    "area bar block body bottom box btn button col column container content cont entry first foot global group head heading holder inner item items label last layout left line link links "
    "list ls main mobile module outer page panel post primary right row secondary section shell site slot text title toggle top unit view wrap wrapper zone s".split()
)
HOLDS_BLOCKS = frozenset("div section aside nav header footer form ul ol dl table tbody tr td main article figure dialog details center".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
HINTS = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
#: A quote opens a value only after an equals sign.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?|[^<]+|<""", re.S)
_CLOSE: dict[str, re.Pattern] = {}
#: Tags that the content of these elements cannot hold: without an end tag before, they end there.
_ENDS = {
    "option": "p|div|article|section|main|h[1-6]|ul|ol|li|table|nav|header|footer|aside|form|blockquote|body|option|optgroup|select|datalist",
    "title": "p|div|article|section|main|h[1-6]|ul|ol|table|nav|header|footer|aside|form|body|head|link|meta|script|style|base",
    "button": "p|article|section|main|h[1-6]|table|nav|header|footer|aside|form|blockquote|body|button",
}


@dataclass
class Run:
    """Words of one text piece, or one tag (words == 0)."""

    features: tuple[str, ...]
    words: int
    block: int
    text: str = ""
    at: int = 0


def kind_of_hints(name: str, attributes: str) -> str:
    """The kind that class, id and role name, or nothing. The last fitting token decides."""
    found = ""
    for which, *values in HINTS.findall(attributes):
        if which.lower() == "id" and name not in HOLDS_BLOCKS:
            continue
        for token in "".join(values).split():
            words = [w.lower() for w in PARTS.findall(token)]
            kinds = [KIND_OF_HINT[w] for w in words if w in KIND_OF_HINT]
            if kinds and all(w in KIND_OF_HINT or w in PARTS_OF_LAYOUT for w in words):
                found = kinds[-1]
    return found


@dataclass
class _Parser:
    runs: list[Run] = field(default_factory=list)
    stack: list[tuple[str, str, str]] = field(default_factory=list)  # (element, kind that holds inside, innermost block)
    places: dict[str, list[int]] = field(default_factory=dict)  # where each open element stands in the stack
    block: int = 0
    lift: bool = False

    def kind(self) -> str:
        return self.stack[-1][1] if self.stack else "plain"

    def pop(self, name: str) -> None:
        """Closes the last open element of that name and all inside it."""
        at = self.places[name][-1]
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def inner_kind(self, name: str, attributes: str) -> str:
        outer = self.kind()
        found = KIND_OF_TAG.get(name, "")
        if name not in ("html", "body", "main", "article") and attributes:
            if HIDDEN.search(attributes):
                found = "notice"
            found = kind_of_hints(name, attributes) or found
        if outer not in ("plain", "article"):
            # a whole page may stand in a form
            return "article" if name == "main" or name == "article" and (outer == "form" or self.lift) else outer
        if outer == "article" and found == "header":
            return outer  # an article's own heading
        return found or outer

    def open(self, name: str, attributes: str, at: int) -> None:
        if name in ENDS_PARAGRAPH and self.places.get("p"):
            self.pop("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            around = ("ul", "ol", "dl", "table", "menu", *(("tr",) if name in ("td", "th") else ()))
            if (top := self.last(*alike)) > self.last(*around):
                self.pop(self.stack[top][0])
        if name not in INLINE:
            self.block += 1
        kind = self.inner_kind(name, attributes)
        self.runs.append(Run((f"tag {name}",), 0, self.block, at=at))
        if name not in VOID and not attributes.endswith("/"):
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append((name, kind, name if name not in INLINE else self.stack[-1][2] if self.stack else "body"))

    def close(self, name: str, at: int) -> None:
        if self.places.get(name):
            self.pop(name)
        if name not in INLINE:
            self.block += 1
        self.runs.append(Run((f"tag {name}",), 0, self.block, at=at))

    def text(self, raw: str, at: int) -> None:
        decoded = _html.unescape(raw)
        n = len(decoded.split())
        place = self.stack[-1][2] if self.stack else "body"
        place = "heading" if re.fullmatch("h[1-6]", place) else place if place in ("p", "li", "td") else "other"
        self.runs.append(Run((f"in {self.kind()}", f"link {bool(self.places.get('a'))}", f"place {place}"), n, self.block, decoded, at))


def parse(page: str, lift: bool = False) -> list[Run]:
    """The runs of a page in linear time. lift: an article counts as one even in elements whose kind says otherwise."""
    parser, at, end = _Parser(lift=lift), 0, len(page)
    unclosed: set[str] = set()  # raw elements without an end from here on
    while at < end:
        m = TOKEN.match(page, at)
        token, start = m[0], at
        at = m.end()
        if m[2] is None:
            if token[0] != "<" or token == "<":
                parser.text(token, start)
            elif token.startswith("<![CDATA["):
                parser.text(_html.escape(token[9:].removesuffix("]]>")), start)
            continue
        if not token.endswith(">"):  # a stray quote: the tag ends at the next >
            close = page.find(">", at)
            at = end if close < 0 else close + 1
        name = m[2].lower()
        if m[1]:
            parser.close(name, start)
        elif name in RAW and not m[3].endswith("/") and name != "head":
            if name not in _CLOSE:
                stop = rf"|(?P<stop></?(?:{_ENDS[name]})\b)" if name in _ENDS else ""
                _CLOSE[name] = re.compile(rf"</{re.escape(name)}\s*>?{stop}", re.I)
            close = None if name in unclosed else _CLOSE[name].search(page, at)
            if close:
                at = close.start() if name in _ENDS and close["stop"] else close.end()
            elif name in ("script", "style"):
                at = end
            else:
                unclosed.add(name)
        elif name == "br":
            parser.runs.append(Run(("tag br",), 0, parser.block, " ", start))
        else:
            parser.open(name, m[3], start)
    return parser.runs


@dataclass(frozen=True)
class Weights:
    """Score of a word by its features (a sum) and of a tag by its name."""

    score: dict[str, float]
    other_tag: float
    base: float

    def of(self, run: Run) -> float:
        if run.features[0].startswith("tag "):
            return self.score.get(run.features[0], self.other_tag)
        return run.words * (self.base + sum(self.score.get(f, 0.0) for f in run.features))


def train(pages: list[list[tuple[str, bool]]]) -> Weights:
    """pages: each a list of (markup, is it content). Log odds with one added to every count; tags at most -0.1."""
    inside, outside = Counter(), Counter()
    for page in pages:
        bounds, at = [], 0
        for markup, content in page:
            at += len(markup)
            bounds.append((at, content))
        part = 0
        for run in parse("".join(m for m, _ in page)):
            while run.at >= bounds[part][0] and part + 1 < len(bounds):
                part += 1
            tally = inside if bounds[part][1] else outside
            for f in run.features:
                tally[f] += max(1, run.words)
            tally["words" if run.words else "tags"] += max(1, run.words)

    def odds(f: str, whole: str) -> float:
        return log((inside[f] + 1) / (inside[whole] + 2)) - log((outside[f] + 1) / (outside[whole] + 2))

    names = {*inside, *outside} - {"words", "tags"}
    score = {f: min(-0.1, odds(f, "tags") - 1) if f.startswith("tag ") else odds(f, "words") for f in names}
    # a word's own evidence is the share of content among all words; an unknown tag counts as the mean of the known ones
    base = log((inside["words"] + 1) / (outside["words"] + 1))
    tags = [v for f, v in score.items() if f.startswith("tag ")]
    return Weights(score, sum(tags) / max(1, len(tags)), base)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous region with the largest sum; empty if none is over zero."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def extract(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    # a word list alone must not empty a page: if nothing is left, an article inside of what it names is let in
    return _extracted(parse(page), weights) or ("<article" in page.lower() and _extracted(parse(page, lift=True), weights)) or ""


def _extracted(runs: list[Run], weights: Weights) -> str:
    scores = [weights.of(r) for r in runs]
    begin, end = best_region(scores)
    if begin == end:
        return ""
    blocks: dict[int, list[Run]] = {}
    totals: Counter = Counter()
    edges = {runs[begin].block, runs[end - 1].block}
    for i, (run, score) in enumerate(zip(runs, scores, strict=True)):
        # a block that the region cuts belongs to it as a whole
        if (begin <= i < end or run.block in edges) and run.text:
            blocks.setdefault(run.block, []).append(run)
            totals[run.block] += score if run.words else 0
    texts = (" ".join("".join(r.text for r in rs).split()) for b, rs in blocks.items() if totals[b] >= 0)
    return "\n\n".join(t for t in texts if t)


_trained: list[Weights] = []


def default_weights() -> Weights:
    if not _trained:
        from .html_training import labelled_pages

        _trained.append(train(labelled_pages()))
    return _trained[0]


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html, ...)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or default_weights())

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(page, shared.value) for page in html], dtype=object)

    out = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
