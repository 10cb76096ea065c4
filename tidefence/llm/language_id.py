"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of variable order: for each context of up to ``order``
bytes, how often each next byte followed it. A byte that its context never saw costs an escape
(method C: distinct symbols / (occurrences + distinct symbols)) and is tried one order lower; below
order 0 each byte costs eight bits. Statistics are frozen after training, so the code length of a
word depends on the word alone, and texts are scored as bags of words: each word is coded on its own
with the byte of a space before it. The lowest total code length wins.

Freezing is what makes this fast: for every (context, byte) seen in any language the code length in
all languages is worked out once, so scoring a byte is one binary search in most cases.

What a text costs in its best language, in bits a byte, also tells whether it is of any learned language: ``limit`` is set above nearly all
learned documents. The query names a language for every text with letters, as its contract says; ``keep_identified`` rejects texts over the limit.

Cases: a null text, an empty one and one without a letter give ``und`` with score 0. Ties go to the
language that sorts first. With no labelled rows at all every text with letters is ``und`` too.
Rows with equal texts get equal results; null ids are never used for training. Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, remainder, text_blocks

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred string, score double, bits double, size long"


def _clean(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 0..order the packed k+1 bytes that end at each byte of each word (-1 where the word, with its
    leading space, is too short for k context bytes), and the word that each byte belongs to."""
    raw = [b" " + w.encode() for w in words]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(raw)), sizes)
    place = np.arange(len(flat)) - starts[owner]
    packed, grams = flat.copy(), []
    body = place > 0
    for k in range(order + 1):
        if k:
            before = np.zeros_like(flat)
            before[k:] = flat[:-k]
            packed = packed | before << 8 * k
        grams.append(np.where(place >= k, packed, -1)[body])
    return grams, owner[body]


def _count(order: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text:
                for block in text_blocks(text.lower()):
                    words.setdefault(lang, Counter()).update(WORD.findall(block))
    for lang, found in words.items():
        kept = [(c, n) for w, n in found.items() if (c := _clean(w))]
        if not kept:
            continue
        grams, owner = _grams([c for c, _ in kept], order)
        weight = np.array([n for _, n in kept], dtype=np.int64)[owner]
        for k, gram in enumerate(grams):
            ok = gram >= 0
            keys, at = np.unique(gram[ok], return_inverse=True)
            total = np.bincount(at, weights=weight[ok], minlength=len(keys)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "k": k, "gram": keys, "n": total})


@dataclass(frozen=True)
class ContextTrees:
    """Frozen code lengths. keys[k]: packed k+1 bytes seen in any language, sorted; bits[k]: their code lengths;
    contexts[k], escapes[k]: the same for contexts of k bytes."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    limit: float = float("inf")

    @staticmethod
    def freeze(counts: pd.DataFrame, order: int) -> ContextTrees:
        languages = sorted(counts["lang"].unique())
        column = {x: i for i, x in enumerate(languages)}
        keys, bits, contexts, escapes = [], [], [], []
        for k in range(order + 1):
            part = counts[counts["k"] == k]
            key = np.unique(part["gram"].to_numpy(np.int64))
            n = np.zeros((len(key), len(languages)))
            n[np.searchsorted(key, part["gram"].to_numpy(np.int64)), part["lang"].map(column).to_numpy(int)] = part["n"].to_numpy(float)
            context, at = np.unique(key >> 8, return_inverse=True)
            total = np.zeros((len(context), len(languages)))
            distinct = np.zeros_like(total)
            np.add.at(total, at, n)
            np.add.at(distinct, at, n > 0)
            seen = total > 0
            escape = np.where(seen, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0.0)
            if k:
                lower = bits[k - 1][np.searchsorted(keys[k - 1], key & ((1 << 8 * k) - 1))]
            else:
                lower = np.full((len(key), len(languages)), 8.0)
            own = np.log2(np.maximum(total + distinct, 1)[at] / np.maximum(n, 1))
            keys.append(key)
            bits.append(np.where(n > 0, own, escape[at] + lower))
            contexts.append(context)
            escapes.append(escape)
        return ContextTrees(languages, order, keys, bits, contexts, escapes)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits that each word costs in each language."""
        out = np.zeros((len(words), len(self.languages)))
        if not words or not self.languages:
            return out
        grams, owner = _grams(words, self.order)
        cost = np.zeros((len(owner), len(self.languages)))
        open_ = np.arange(len(owner))
        for k in range(self.order, -1, -1):
            gram = grams[k][open_]
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            found = keys[at] == gram
            cost[open_[found]] += self.bits[k][at[found]]
            open_, gram = open_[~found], gram[~found]
            context = gram >> 8
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = (gram >= 0) & (self.contexts[k][at] == context)
            cost[open_[known]] += self.escapes[k][at[known]]
        cost[open_] += 8.0
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(owner, weights=cost[:, j], minlength=len(words))
        return out

    def predict(self, texts: pd.Series, chunk_chars: int = 800_000) -> pd.DataFrame:
        """Texts are scored in chunks of about chunk_chars characters, which bounds memory and changes no result."""
        total = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts))
        lettered = np.zeros(len(texts), dtype=bool)
        words: list[str] = []
        owners: list[int] = []
        counts: list[int] = []
        pending = 0

        def flush() -> None:
            nonlocal words, owners, counts, pending
            if words:
                codes, distinct = pd.factorize(np.array(words, dtype=object))
                clean = [_clean(w) for w in distinct]
                cost = self.code_lengths(clean)
                owner = np.repeat(np.array(owners), np.array(counts))
                lettered[np.unique(owner[np.array([bool(c) for c in clean])[codes]])] = True
                size[:] += np.bincount(owner, weights=np.array([len(c.encode()) for c in clean])[codes], minlength=len(texts))
                for j in range(len(self.languages)):
                    total[:, j] += np.bincount(owner, weights=cost[codes, j], minlength=len(texts))
            words, owners, counts, pending = [], [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            for block in text_blocks(text.lower()):
                found = WORD.findall(block)
                words += found
                owners.append(i)
                counts.append(len(found))
                pending += len(block)
                if pending >= chunk_chars:
                    flush()
        flush()
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts)), "bits": 0.0, "size": 0})
        best = total.argmin(axis=1)
        odds = np.exp2(-np.minimum(total - total.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        names = np.array(self.languages, dtype=object)
        return pd.DataFrame({"lang_pred": np.where(lettered, names[best], UNDETERMINED), "score": np.where(lettered, 1 / odds, 0.0), "bits": total.min(axis=1), "size": size.astype(np.int64)})


def fit(docs: DataFrame, *, folds: int = 5, held_out_fold: int = 0, order: int = 4, max_docs_per_language: int = 1500, margin: float | None = None) -> ContextTrees:
    """Trains on rows whose lang is not null and whose crc32(doc_id as text) mod folds is not held_out_fold.

    The trees are fitted on a sample of about max_docs_per_language whole documents of each language,
    chosen by a hash of the id; that is the bound on what reaches the driver, for each language there is. With a margin, limit is
    that times the bits a byte that 99.9 % of the sample's documents stay under in the best language.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (remainder(F.col("id"), folds) != held_out_fold))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return ContextTrees([], order, [], [], [], [])
    # languages that are sampled, in one constant map: they have over max_docs_per_language documents each, so they are few; all documents of others are taken
    parts = {lang: max_docs_per_language / n for lang, n in sizes.items() if n > max_docs_per_language}
    share = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(parts)), "map<string,double>"), F.col("lang")), F.lit(1.0))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    counts = sample.mapInPandas(lambda it: _count(order, it), "lang string, k int, gram long, n long")
    model = ContextTrees.freeze(counts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas(), order)
    if margin is None or not model.languages:
        return model
    cost = sample.select(predict_column(sample, model).alias("p")).filter("p.size > 0").select((F.col("p.bits") / F.col("p.size")).alias("b"))
    high = cost.agg(F.percentile("b", 0.999).alias("b")).first()["b"]
    return replace(model, limit=margin * high if high is not None else float("inf"))


def predict_column(docs: DataFrame, model: ContextTrees):
    """A struct column (lang_pred, score) over docs.text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts)

    return predict.asNondeterministic()(F.col("text").cast("string"))  # marked so that its fields share one call


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...)."""
    folds, held_out = options.get("folds", 5), options.get("held_out_fold", 0)
    model = fit(docs, **options)
    rows = docs.select("doc_id", "text").withColumn("p", predict_column(docs, model))
    held = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, margin: float = 1.75, slack_bits: float = 64.0, **options) -> DataFrame:
    """The rows of docs that are of a learned language; all columns stay. Texts without a letter go, and those that cost more than the limit a byte
    in every language. The margin leaves room for what is dear but of the language: one word over and over, keys and passwords between words. The first
    slack_bits are free, so that a few odd words decide nothing. If no language was learned, all go."""
    name = fresh(docs, "language_guess")
    model = fit(docs, margin=margin, **options)
    guessed = docs.withColumn(name, predict_column(docs, model).alias(name))
    p = F.col(name)
    fits = p["bits"] - slack_bits <= p["size"] * F.lit(model.limit)
    return guessed.filter((p["lang_pred"] != UNDETERMINED) & fits).select(*[F.col(f"`{c}`") for c in docs.columns])
