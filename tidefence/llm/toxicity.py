"""Toxicity by weak supervision.

1. Lexicon: whole words (``^word$``) and word beginnings (``^stem``), once or several times in a document (``^stem x3``), that
   labelled toxic documents have far more often than labelled clean ones, mined on a bounded sample of labelled rows.
2. Voters: lexicon entries taken greedily (each one covers the most toxic sample rows that few others cover yet), up to ``max_voters``, plus
   pattern voters on shouting, symbol noise and repetition. A voter fires or not.
3. Label model: a two-class generative model. Every voter has a firing rate in either class. How often each voter fires and how often
   each two fire together is counted over the whole corpus, a table of voters x voters whatever the size; the rates and the share of the toxic class
   are those that explain these counts best by least squares, with the labelled rows' rates and share as anchors of equal weight, so that the
   classes keep their meaning. Voters that fire together within a class more, or less, than their rates explain are correlated: such pairs are left out of
   the fit, and a block of voters that fire together is one witness.
4. Classifier: logistic regression over all lexicon entries and patterns, trained on the label model's posterior alone, on the bounded sample of labelled
   rows and on a bounded sample of rows without a label. Labels are used to mine the lexicon, to anchor the rates, and to set the scale of the scores so that the
   threshold falls on the best cut of the labelled sample; they are never a target.

The entries of all texts are worked out once and stored; counts and scores come from them.

Labels, votes and the sample come only from rows whose crc32(doc_id as text) mod folds is not held_out_fold.

Cases: null and empty texts have no features and get the score of the intercept. Repeated rows are scored
alike; an id that is labelled twice counts as toxic if one label says so; null labels and null ids are not used.
Without any toxic or any clean label the score is 0 for every row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, remainder, stored, text_blocks

WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
STEMS = range(3, 8)
#: How often an entry must stand in a document to count as an entry of its own.
TIMES = (1, 2, 3, 5, 8)
PATTERNS = ("shouting", "symbol noise", "one word over and over", "insult marks")


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a lower-case word could match."""
    return [f"^{word}$", *(f"^{word[:k]}" for k in STEMS if len(word) >= k)]


def counted(words: Counter) -> Counter:
    """How often each entry stands in a text with these words."""
    out: Counter = Counter()
    for w, n in words.items():
        for e in entries_of(w):
            out[e] += n
    return out


def named(entry: str, times: int) -> str:
    return entry if times == 1 else f"{entry} x{times}"


def patterns_of(text: str, words: int, distinct: int) -> list[bool]:
    """Firing of the pattern voters on a whole text."""
    size = max(1, len(text))
    return [
        words >= 5 and len(UPPER.findall(text)) > 0.5 * size,
        sum(text.count(c) for c in "#$%&*@^~") > 0.05 * size,
        words >= 20 and distinct * 5 < words,
        text.count("!") * 20 > max(20, words),
    ]


class Features:
    """Turns texts into sorted entry numbers; pattern p has number len(lexicon) + p."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        self.lexicon = lexicon
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for name, i in lexicon.items():
            entry, _, times = name.partition(" x")
            self.levels.setdefault(entry, []).append((int(times or 1), i))

    def of(self, texts: pd.Series) -> list[list[int]]:
        cache: dict[str, tuple[str, ...]] = {}
        levels, base, out = self.levels, len(self.lexicon), []
        for text in texts:
            if not text:
                out.append([])
                continue
            words: Counter = Counter()
            for block in text_blocks(text):
                words.update(WORD.findall(block.lower()))
            hits: Counter = Counter()
            for w, n in words.items():
                found = cache.get(w)
                if found is None:
                    found = tuple(e for e in entries_of(w) if e in levels)
                    if len(cache) < 100_000:
                        cache[w] = found
                for e in found:
                    hits[e] += n
            features = [i for e, n in hits.items() for times, i in levels[e] if n >= times]
            features += [base + p for p, fires in enumerate(patterns_of(text, words.total(), len(words))) if fires]
            out.append(sorted(features))
        return out


@dataclass(frozen=True)
class Scorer:
    features: Features
    weights: np.ndarray
    bias: float

    def column(self, features: str) -> Column:
        """The score of a column of entry numbers, in the JVM."""
        weights = F.array(*[F.lit(float(w)) for w in self.weights]) if len(self.weights) else F.array(F.lit(0.0))
        z = F.aggregate(features, F.lit(float(self.bias)), lambda acc, f: acc + F.element_at(weights, f + 1))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def _mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            if text:
                words: Counter = Counter()
                for block in text_blocks(text):
                    words.update(WORD.findall(block.lower()))
                found[toxic].update(named(e, t) for e, n in counted(words).items() for t in TIMES if n >= t)
    for toxic, counts in found.items():
        if counts:
            yield pd.DataFrame({"entry": list(counts), "toxic": toxic, "n": list(counts.values())})


def sample_of(docs: DataFrame, labels: DataFrame, folds: int, held_out_fold: int, max_labelled: int) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled ids outside the held-out fold, chosen by a hash of the id."""
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.filter(F.col("toxic").isin(0, 1) & (remainder(F.col("label_id"), folds) != held_out_fold))
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").alias("label_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "label_id")
    # of rows that repeat an id, one
    return rows.groupBy("label_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def mine_lexicon(sample: DataFrame, max_entries: int, min_rows: int) -> tuple[dict[str, int], int, int]:
    """The max_entries entries with the strongest evidence, and how many toxic and clean rows the sample has."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}, bad, good
    n = sample.mapInPandas(_mine, "entry string, toxic int, n long").groupBy("entry")
    n = n.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    top = n.filter(F.col("bad") >= max(3, min(min_rows, bad // 50))).withColumn("odds", odds).filter("odds > 2")
    top = top.orderBy((F.col("odds") * F.sqrt("bad")).desc(), F.length("entry").desc(), "entry").limit(max_entries)
    return {r["entry"]: i for i, r in enumerate(top.collect())}, bad, good


def choose_voters(rows: list[list[int]], toxic: np.ndarray, n_lexicon: int, max_voters: int, precise: float = 50.0) -> list[int]:
    """Greedy cover of the toxic rows by lexicon entries that fire at least ``precise`` times as often in them as in clean rows (by all, if under
    ten do); all patterns vote besides."""
    holds: dict[int, set[int]] = {}
    clean: Counter = Counter()
    for i, row in enumerate(rows):
        for f in row:
            if f < n_lexicon:
                if toxic[i]:
                    holds.setdefault(f, set()).add(i)
                else:
                    clean[f] += 1
    bad, good = toxic.sum() + 1, len(rows) - toxic.sum() + 1
    sure = {f: h for f, h in holds.items() if (len(h) + 0.5) / bad >= precise * (clean[f] + 0.5) / good}
    holds = sure if len(sure) >= 10 else holds
    chosen: list[int] = []
    covered: Counter = Counter()
    while holds and len(chosen) < max_voters:
        # a row counts less with each voter that already fires on it
        best = max(holds, key=lambda f: (sum(0.5 ** covered[i] for i in holds[f]), -f))
        chosen.append(best)
        covered.update(holds.pop(best))
    return chosen + [n_lexicon + p for p in range(len(PATTERNS))]


@dataclass(frozen=True)
class LabelModel:
    """log_odds[j, v]: evidence of voter j when it does (v = 1) or does not (v = 0) fire; block[j]: its block of correlated voters; prior: log odds.

    A block is one witness: the strongest of its voters that fire speaks for it or, if none does, the strongest of those that do not.
    """

    log_odds: np.ndarray
    block: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), self.prior)
        for b in np.unique(self.block):
            some = np.flatnonzero(self.block == b)
            fired = votes[:, some] > 0
            says = np.where(fired, self.log_odds[some, 1], -np.inf).max(axis=1, initial=-np.inf)
            z += np.where(fired.any(axis=1), says, self.log_odds[some, 0].min())
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(fired: np.ndarray, together: np.ndarray, rows: float, labelled: np.ndarray, toxic: np.ndarray, rounds: int = 60, correlated: float = 0.3, unrelated: float = 0.1) -> LabelModel:
    """fired (voters) and together (voters x voters): in how many of the corpus's rows; labelled (rows x voters) with labels anchors the classes."""
    m = len(fired)
    bad, good = max(1.0, toxic.sum()), max(1.0, (1 - toxic).sum())
    anchor = np.stack([((labelled * (1 - toxic)[:, None]).sum(0) + 0.5) / (good + 1), ((labelled * toxic[:, None]).sum(0) + 0.5) / (bad + 1)])
    share = bad / (bad + good)
    rates, free = anchor.copy(), ~np.eye(m, dtype=bool)
    apart = free.copy()
    # correlation of two voters within a class, by the labelled rows; a block is what such pairs connect
    for y in (0, 1):
        part = labelled[toxic == y].astype(float)
        if len(part) > 10:
            d = part - part.mean(0)
            s = np.sqrt((d**2).mean(0)) + 1e-9
            r = (d.T @ d / len(part)) / np.outer(s, s)
            apart &= r <= correlated
            free &= np.abs(r) <= unrelated
    if rows:
        single, pair = fired / rows, together / rows
        for _ in range(rounds):
            mix = np.array([1 - share, share])
            for i in range(m):
                j = np.flatnonzero(free[i])
                # what voter i does alone and with each other one is linear in its two rates
                x = np.vstack([mix, (mix[:, None] * rates[:, j]).T])
                seen = np.concatenate([[single[i]], pair[i, j]])
                w = rows / (seen + 1 / rows)
                normal, right = (x * w[:, None]).T @ x, (x * w[:, None]).T @ seen
                hold = np.diag(normal).copy()  # the anchors weigh as much as the corpus
                rates[:, i] = np.clip(np.linalg.solve(normal + np.diag(hold), right + hold * anchor[:, i]), 1e-6, 1 - 1e-6)
            i, j = np.nonzero(np.triu(free))
            gap, base = rates[1, i] * rates[1, j] - rates[0, i] * rates[0, j], rates[0, i] * rates[0, j]
            gap, base, seen = (np.concatenate(v) for v in ((gap, rates[1] - rates[0]), (base, rates[0]), (pair[i, j], single)))
            w = rows / (seen + 1 / rows)
            found = float(np.clip((w * gap) @ (seen - base) / max(1e-12, (w * gap) @ gap), 1e-4, 0.5))
            share = (found + bad / (bad + good)) / 2
    rate = np.clip(rates, 1e-6, 1 - 1e-6)
    odds = np.stack([np.log((1 - rate[1]) / (1 - rate[0])), np.log(rate[1] / rate[0])], axis=1)
    block = np.arange(m)
    while True:  # at most m rounds
        least = np.where(apart, m, block[None, :]).min(axis=1)
        if (least >= block).all():
            break
        block = np.minimum(block, least)
    return LabelModel(odds, block, float(np.log(share / (1 - share))))


def fit_classifier(rows: list[list[int]], target: np.ndarray, width: int, n_lexicon: int) -> tuple[np.ndarray, float]:
    """Logistic regression whose lexicon weights are not negative: an entry is evidence for toxicity or none, so a text
    never gains by repeating one. Entries that come out negative are left out and the rest is fitted again."""
    alike: dict[tuple[int, ...], list[float]] = {}
    for r, t in zip(rows, target, strict=True):  # most rows are alike, clean ones above all
        seen = alike.setdefault(tuple(r), [0.0, 0.0])
        seen[0] += 1
        seen[1] += t
    count, positive = np.array(list(alike.values())).T
    active = np.ones(width, dtype=bool)
    while True:
        number = np.cumsum(active) - 1
        w, bias = newton([[number[f] for f in r if active[f]] for r in alike], count, positive, int(active.sum()))
        full = np.zeros(width)
        full[active] = w
        negative = (full < 0) & (np.arange(width) < n_lexicon)
        if not negative.any():
            return full, bias
        active &= ~negative


def newton(rows: list[list[int]], count: np.ndarray, positive: np.ndarray, width: int, rounds: int = 25, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on rows that stand for count rows with that sum of soft targets; the last
    column is the intercept, which the ridge leaves alone."""
    x = np.zeros((len(rows), width + 1))
    for i, f in enumerate(rows):
        x[i, f] = 1
    x[:, width] = 1
    penalty = np.full(width + 1, ridge)
    penalty[width] = 1e-6
    share = positive.sum() / count.sum()
    w = np.zeros(width + 1)
    w[width] = np.log((share + 1e-4) / (1 - share + 1e-4))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(count @ np.logaddexp(0, z) - positive @ z + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (count * p - positive) + penalty * w
        step = np.linalg.solve((x * (count * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - then < 1e-6 * (1 + now):
            break
        now = then
    return w[:width], float(w[width])


def calibrate(weights: np.ndarray, bias: float, rows: list[list[int]], toxic: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """Moves the score threshold to the cut that separates the sample's labels best (F1; the middle of the best gap)."""
    z = np.array([bias + weights[f].sum() for f in rows])
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + toxic.sum())
    last = np.append(z[order][1:] < z[order][:-1], True)  # a cut must not part equal scores
    i = int(np.argmax(np.where(last, f1, -1)))
    low = z[order][i + 1] if i + 1 < len(z) else z[order][i] - 1
    cut = (z[order][i] + low) / 2
    steep = 1 / max(0.25, min(1.0, z[order][i] - low))  # widens narrow gaps somewhat; keeps the order of all scores
    return weights * steep, (bias - cut) * steep + float(np.log(threshold / (1 - threshold)))


def with_entries(docs: DataFrame, features: Features, name: str) -> DataFrame:
    """docs with the entry numbers of text as the column name."""
    shared = docs.sparkSession.sparkContext.broadcast(features)

    @F.pandas_udf("array<int>")
    def entries(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(texts), dtype=object)

    return docs.withColumn(name, entries(F.col("text").cast("string")))


def co_firing(entries: DataFrame, name: str, voters: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """How often each voter fires, how often each two fire together, and how many rows there are: each task sends one table of
    voters x voters at most."""
    bit = {f: j for j, f in enumerate(voters)}
    m = len(voters)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((m, m), dtype=np.int64), 0
        for batch in it:
            n += len(batch)
            alike = Counter(tuple(bit[f] for f in fs if f in bit) for fs in batch[name])
            for fs, k in alike.items():
                if fs:
                    both[np.ix_(fs, fs)] += k
        i, j = np.nonzero(both)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], n)})

    got = entries.select(name).mapInPandas(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = int(got.loc[got["i"] < 0, "n"].sum())
    got = got[got["i"] >= 0]
    both = np.zeros((m, m))
    both[got["i"], got["j"]] = got["n"]
    return np.diag(both).copy(), both, total


def prepare(docs: DataFrame, labels: DataFrame, name: str, *, folds: int = 3, held_out_fold: int = 1, max_labelled: int = 12_000, max_unlabelled: int = 20_000, max_entries: int = 400, max_voters: int = 100, min_rows: int = 15, threshold: float = 0.7, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, Scorer]:
    """docs (or its columns keep), stored with entry numbers as the column name, and the fitted scorer.

    max_labelled bounds the labelled sample that the lexicon, the anchors and the cut come from, max_unlabelled (about) the other rows that the classifier is
    trained on; max_voters bounds the table of counts.
    """
    sample = sample_of(docs, labels, folds, held_out_fold, max_labelled)
    lexicon, bad, good = mine_lexicon(sample, max_entries, min_rows)
    features = Features(lexicon)
    width = len(lexicon) + len(PATTERNS)
    entries = with_entries(docs, features, name)
    entries = stored(entries.select(*keep, name) if keep else entries, "entries")
    if not bad or not good:
        return entries, Scorer(features, np.zeros(width), -40.0)
    got = with_entries(sample, features, "f").select("f", "toxic").toPandas()
    rows, toxic = [list(f) for f in got["f"]], got["toxic"].to_numpy(float)
    voters = choose_voters(rows, toxic, len(lexicon), max_voters)

    def votes_of(some: list[list[int]]) -> np.ndarray:
        bit = {f: j for j, f in enumerate(voters)}
        out = np.zeros((len(some), len(voters)), dtype=np.int8)
        for i, fs in enumerate(some):
            out[i, [bit[f] for f in fs if f in bit]] = 1
        return out

    seen = entries.filter(remainder(F.col("doc_id"), folds) != held_out_fold)
    fired, together, total = co_firing(seen, name, voters)
    labelled = votes_of(rows)
    model = fit_label_model(fired, together, total, labelled, toxic)
    share = min(1.0, max_unlabelled / max(1, total))
    more = seen.filter(F.pmod(F.xxhash64("doc_id", name), F.lit(1_000_000)) < share * 1_000_000).select(name).limit(2 * max_unlabelled)
    others = [list(r[0]) for r in more.collect()]
    target = np.concatenate([model.posterior(labelled), model.posterior(votes_of(others))])
    weights, bias = calibrate(*fit_classifier(rows + others, target, width, len(lexicon)), rows, toxic, threshold)
    return entries, Scorer(features, weights, bias)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...)."""
    folds, held_out = options.get("folds", 3), options.get("held_out_fold", 1)
    entries, model = prepare(docs.select("doc_id", "text"), labels, "entries", threshold=threshold, keep=("doc_id",), **options)
    held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = entries.withColumn("score", model.column("entries"))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs that score below threshold; all columns stay."""
    name = fresh(docs, "toxicity")
    entries, model = prepare(docs, labels, name, threshold=threshold, **options)
    return entries.filter(model.column(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
