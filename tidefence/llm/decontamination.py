"""Benchmark decontamination with a generalised suffix automaton over words.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. One suffix automaton holds the word
sequences of many test items. A document's words are streamed through it; at each word the automaton's state gives
the longest run of words ending there that occurs in an item. Where the run has at least ``window`` words, the last
``window`` of them are hit. Items shorter than the window are windows as a whole; a length set and a per-state mark
find them in the same stream. Words that no item has end every run, so only stretches of item words are streamed.

Every state knows the items with its runs (an item enters all states of its own prefixes, and is carried along the
suffix links), so a hit window names its items.

The items are read in blocks of at most ``block_words`` words (an item is never parted). One block's automaton at a time is built from a stream of the
items and sent to the executors; documents pass through one block after another, and what they hit is stored and united. So the driver and a
worker hold one block, whatever the size of the benchmark; each further block is one more pass over the documents.

Cases: null and empty texts have no words and no hits; items that are null or have no words are ignored; equal items are all named.
An empty benchmark hits nothing. Repeated rows are judged alike. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Of several word sequences. Transitions are one dict per state; length, link and items are lists by state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
        self.names = [name for name, _ in items]
        self.sizes = [len(words) for _, words in items]
        self.short = sorted({len(words) for _, words in items if len(words) < window})
        whole: dict[int, set[int]] = {}
        marks: dict[int, set[int]] = {}
        for i, (_, words) in enumerate(items):
            state = 0
            for w in words:
                state = self.next[state][self.number[w]]
                if len(words) >= window:
                    marks.setdefault(state, set()).add(i)
            if len(words) < window:
                whole.setdefault(self._shrink(state, len(words)), set()).add(i)
        # carried from longer to shorter runs, so a state has the items of all runs that end in it
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if s in marks and self.length[self.link[s]] >= window:
                marks.setdefault(self.link[s], set()).update(marks[s])
        self.items = {s: sorted(x) for s, x in marks.items() if self.length[s] >= window}
        self.whole = {s: sorted(x) for s, x in whole.items()}
        self.least = min([window, *self.short])

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.length.append(length)
        self.link.append(self.link[state])
        return len(self.length) - 1

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None:
            if self.length[old] == self.length[last] + 1:
                return old
            clone = self._copy(old, self.length[last] + 1)
            self.link[old] = clone
            self._redirect(last, word, old, clone)
            return clone
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, state = len(self.length) - 1, last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][word]
            if self.length[old] == self.length[state] + 1:
                self.link[new] = old
            else:
                clone = self._copy(old, self.length[state] + 1)
                self.link[old] = self.link[new] = clone
                self._redirect(state, word, old, clone)
        return new

    def _shrink(self, state: int, size: int) -> int:
        """The state of the last size words of a run in state."""
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [begin, end) in order of their ends, and the numbers of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.least or not self.number:
            return spans, found
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        begins, ends = edge[::2], edge[1::2]
        long = ends - begins >= self.least
        window, step, link, length = self.window, self.next, self.link, self.length
        for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            state = run = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and w not in step[state]:
                    state = link[state]
                    run = length[state]
                if w in step[state]:
                    state = step[state][w]
                    run += 1
                if run >= window:
                    if spans and spans[-1][1] >= i - window:
                        spans[-1] = (min(spans[-1][0], i - window), i)
                    else:
                        spans.append((i - window, i))
                    at = self._shrink(state, window)
                    found.update(self.items.get(at, ()))
                for size in self.short:
                    if run < size:
                        break
                    at = self._shrink(state, size)
                    named = [x for x in self.whole.get(at, ()) if self.sizes[x] == size]
                    if named:
                        found.update(named)
                        spans.append((i - size, i))
        return spans, found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def blocks_of(benchmark: DataFrame, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """The automata of all blocks, one after another; one without items for an empty benchmark."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((row["item"] or "", words))
        size += len(words)
    yield SuffixAutomaton(block, window)


FOUND = "n_words long, n_hit long, spans array<array<int>>, items array<string>"


def _passed(rows: DataFrame, block: Broadcast, name: str) -> DataFrame:
    """rows(text, name) with the block's hits united into the column name, a struct of FOUND."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for text, old, had in zip(texts, spans, items, strict=True):
            n, new, names = hits_of(text, [block.value])
            new = united([*new, *((int(a), int(b)) for a, b in old)])
            out.append((n, sum(b - a for a, b in new), [list(s) for s in new], sorted({*names, *had})))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "spans", "items"])

    return rows.withColumn(name, find.asNondeterministic()(F.col("text").cast("string"), F.col(name)["spans"], F.col(name)["items"]))


def screened(rows: DataFrame, blocks: Iterator[SuffixAutomaton], name: str) -> tuple[DataFrame, int]:
    """rows(text, ...) with the struct FOUND as the column name, and how many blocks there were. With several, each pass is stored."""
    context = rows.sparkSession.sparkContext
    rows = rows.withColumn(name, F.expr("named_struct('n_words', 0L, 'n_hit', 0L, 'spans', cast(array() as array<array<int>>), 'items', cast(array() as array<string>))"))
    ahead, n = next(blocks), 0
    while ahead is not None:
        sent, n = context.broadcast(ahead), n + 1
        rows, ahead = _passed(rows, sent, name), next(blocks, None)
        if ahead is not None or n > 1:
            rows = stored(rows, "screened")
            sent.destroy()
    return rows, n


def hits_of(text: str | None, blocks: list[SuffixAutomaton]) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, united hit spans, and the sorted ids of the items that occur."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    names: set[str] = set()
    for block in blocks:
        more, found = block.hits(words)
        spans += more
        names.update(block.names[i] for i in found)
    return len(words), united(spans), sorted(names)


def cut(text: str, n: int, spans: list[tuple[int, int]], min_words: int, max_coverage: float) -> tuple[bool, str, bool]:
    """Whether the text stays (hits cover at most max_coverage of its n words), the text without spans of min_words or more, whether any was."""
    if spans and sum(b - a for a, b in spans) > max_coverage * n:
        return False, text, False
    spans = [s for s in spans if s[1] - s[0] >= min_words]
    if not spans:
        return True, text, False
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    kept.append(raw[at:])
    return True, b"".join(kept).decode("utf-8", "surrogatepass"), True


def cleaned(text: str | None, blocks: list[SuffixAutomaton], min_words: int, max_coverage: float) -> str | None:
    """The text without hit spans of min_words or more; null if hits cover more than max_coverage of its words.
    Repeated until nothing is left to remove, as what stood on both sides of a span may join to a new hit."""
    while text:
        n, spans, _ = hits_of(text, blocks)
        stays, text, changed = cut(text, n, spans, min_words, max_coverage)
        if not stays:
            return None
        if not changed:
            break
    return text


def screen(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, spans (array of begin, end), items (sorted ids) for every row of docs(doc_id, text, ...)."""
    found, _ = screened(docs.select("doc_id", "text"), blocks_of(benchmark, window, block_words), "h")
    return found.select("doc_id", "h.n_words", "h.n_hit", "h.spans", "h.items")


def digest(screened: DataFrame) -> DataFrame:
    items = F.sha2(F.array_join("items", ","), 256)
    return screened.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, min_words: int = 1, max_coverage: float = 0.5, block_words: int = 200_000) -> DataFrame:
    """docs without test passages: hit spans of min_words or more are cut out of the text, and rows whose words are hit by more
    than max_coverage go. A column n_chars is counted anew where it is a whole number; all other columns stay.

    With one block a text is cut until nothing is left inside one call. With several, all rows pass all blocks and are cut, again until no row changes.
    """
    name, hits = fresh(docs, "decontaminated"), fresh(docs, "decontamination_hits")
    blocks = blocks_of(benchmark, window, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        @F.pandas_udf("keep boolean, text string")
        def clean(texts: pd.Series) -> pd.DataFrame:
            rows = [(t is None or (c := cleaned(t, [shared.value], min_words, max_coverage)) is not None, None if t is None else c) for t in texts]
            return pd.DataFrame(rows, columns=["keep", "text"])

        # marked so that the filter and the projection share one call
        done = docs.withColumn(name, clean.asNondeterministic()(F.col("text").cast("string"))).filter(F.col(name)["keep"])
        return _renewed(docs, done, name)

    @F.pandas_udf("keep boolean, text string, changed boolean")
    def once(texts: pd.Series, n: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [(True, None, False) if t is None else cut(t, k, [(int(a), int(b)) for a, b in s], min_words, max_coverage) for t, k, s in zip(texts, n, spans, strict=True)]
        return pd.DataFrame(rows, columns=["keep", "text", "changed"])

    rows = docs
    blocks = chain([first, second], blocks)
    while True:
        found, _ = screened(rows, blocks, hits)
        done = found.withColumn(name, once.asNondeterministic()(F.col("text").cast("string"), F.col(hits)["n_words"], F.col(hits)["spans"]))
        done = stored(done.filter(F.col(name)["keep"]), "cut")
        rows = _renewed(docs, done, name)
        if not done.filter(F.col(name)["changed"]).head(1):
            return rows
        blocks = blocks_of(benchmark, window, block_words)


def _renewed(docs: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """The columns of docs from done, with text (and n_chars where it changed) from the struct name."""
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.col(name)["text"].alias(c))
        elif c == "n_chars" and kind in ("bigint", "int"):
            changed = ~F.col("text").eqNullSafe(F.col(name)["text"])
            columns.append(F.when(changed, F.length(F.col(name)["text"]).cast(kind)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return done.select(*columns)
