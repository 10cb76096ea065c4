"""Hard-negative mining with exact search over k-means inverted lists.

Vectors are scaled and floored to integers, so scores (inner products) are exact. Centroids are trained on a bounded sample; every row is then listed
under its nearest centroid, and each list stores its radius, the largest distance of a row from the centroid. By Cauchy-Schwarz no row of a
list scores more than anchor . centroid + |anchor| radius with an anchor, and none less than anchor . centroid - |anchor| radius.

Lists are dealt to shards of about ``rows_per_shard`` rows; a longer list (say, of thousands of copies) is parted by a hash over several. A search goes in two
waves: each anchor first visits the shard of its best list, which gives a kth score for each of its windows of scores; then all other shards that hold a list
whose bounds meet a window and whose upper bound is not strictly below the kth score. Inside a shard lists are visited by falling bound with
the same rule and a kth score that rises. A list whose bound equals the kth score is visited, since ties go to the smaller id. So nothing is missed, whatever the lists.

First each anchor's best rows of its own label are searched (its positives), then, in a window of scores for each positive, the best rows of other labels.
Anchors meet shards in a sort of (shard, index rows before anchors) streamed through ``mapInPandas``: a task holds one shard and a batch of anchors.

Cases: rows without id, label or vector, or with a null or non-finite component, take no part. Equal rows count once; rows that share an id and differ are rows of
their own (ties then go by label and components). An anchor without another row of its label, or without a row in a window, has no result rows. Vectors of
unlike length are filled up with zeros. Scores beyond 64 bits count as the largest or smallest such number. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NONE, MOST = -(1 << 63), (1 << 63) - 1
ROW = "vec_id long, label long, key long, vector array<long>"
FOUND = "w array<int>, scores array<long>, ids array<long>, keys array<long>"
STATE = f"{ROW}, lows array<long>, highs array<long>, {FOUND}"


def integer_rows(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, key, vector of the rows that take part, each once."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    vector = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    return rows.select("vec_id", "label", F.xxhash64("label", "vector").alias("key"), "vector")


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles where every partial sum is below 2^53, else in whole numbers of any size."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, NONE, MOST).astype(np.int64)


def train(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from spread distinct rows; a centroid that loses all rows stays where it is."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.linspace(0, len(rows) - 1, min(clusters, len(rows))).astype(int)].astype(np.float64)
    sample = sample.astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centroids)[0]
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, and the distance from it (rounded up)."""
    near = np.concatenate([np.empty(0, np.int64), *((((centroids**2).sum(1) - 2 * part @ centroids.T).argmin(1)) for part in np.array_split(x, max(1, len(x) // 4096)))])
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(1)) * (1 + 1e-9)


class Lists:
    """Centroids, radii and shards of the inverted lists; bounded by the number of clusters."""

    def __init__(self, centroids: np.ndarray, sizes: dict[int, int], radii: dict[int, float], rows_per_shard: int) -> None:
        k = len(centroids)
        self.width = centroids.shape[1]
        self.full = np.array([sizes.get(c, 0) > 0 for c in range(k)], dtype=bool)
        self.centroids, self.radii = centroids, np.array([radii.get(c, 0.0) for c in range(k)])
        self.first, self.parts = np.zeros(k, dtype=np.int64), np.ones(k, dtype=np.int64)
        shard, held = 0, 0
        for c in range(k):
            n = sizes.get(c, 0)
            if held and held + n > rows_per_shard:
                shard, held = shard + 1, 0
            self.first[c], self.parts[c] = shard, max(1, -(-n // rows_per_shard))
            if self.parts[c] > 1:
                shard, held = shard + int(self.parts[c]), 0
            else:
                held += n
        self.shards = shard + 1

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the score of each anchor with any row of each list, widened by more than the rounding of doubles; an empty list is never met."""
        a = anchors.astype(np.float64)
        middle, norm = a @ self.centroids.T, np.sqrt((a**2).sum(1))[:, None]
        reach = norm * self.radii[None, :]
        reach += 1e-9 * (reach + norm * np.sqrt((self.centroids**2).sum(1))[None, :]) + 1e-6
        return np.where(self.full, middle - reach, np.inf), np.where(self.full, middle + reach, -np.inf)


def meets(low: np.ndarray, high: np.ndarray, kth: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Anchors x lists: whether some window of the anchor is to be looked for in the list."""
    out = np.zeros(low.shape, dtype=bool)
    for w in range(lows.shape[1]):
        out |= (high >= np.maximum(lows[:, w], kth[:, w])[:, None]) & (low <= highs[:, w][:, None]) & (lows[:, w] <= highs[:, w])[:, None]
    return out


def best(found: tuple[np.ndarray, ...], want: int) -> tuple[np.ndarray, ...]:
    """Of found (anchor, window, score, id, key), the first ``want`` of each anchor and window, in order."""
    order = np.lexsort((found[4], found[3], -found[2].astype(np.float64) if len(found[2]) and found[2].min() == NONE else -found[2], found[1], found[0]))
    found = tuple(x[order] for x in found)
    group = np.flatnonzero(np.r_[True, (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])]) if len(order) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[group, len(order)])
    keep = np.arange(len(order)) - np.repeat(group, sizes) < want
    return tuple(x[keep] for x in found)


def kth_scores(found: tuple[np.ndarray, ...], anchors: int, windows: int, want: int) -> np.ndarray:
    """The score of the last of ``want`` results of each anchor and window; the smallest number where there are fewer."""
    out = np.full((anchors, windows), NONE, dtype=np.int64)
    flat = found[0] * windows + found[1]
    n = np.bincount(flat, minlength=anchors * windows)
    ends = np.cumsum(n) - 1
    full = n >= want
    out.reshape(-1)[full] = found[2][ends[full]]
    return out


def padded(arrays: pd.Series, fill: int) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays), default=0)), fill, dtype=np.int64)
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def flat(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(anchor's place in batch, window, score, id, key) of what the anchors of a batch have found so far."""
    place = np.repeat(np.arange(len(batch)), [len(w) for w in batch["w"]])
    return (place, *(np.concatenate([np.empty(0, np.int64), *batch[c]]).astype(np.int64) for c in ("w", "scores", "ids", "keys")))


def search_shard(shard: pd.DataFrame, anchors: pd.DataFrame, lists: Lists, same: bool, want: int) -> pd.DataFrame:
    """Anchors with what they find in a shard's rows, lists by falling bound."""
    q, lows, highs = matrix(anchors["vector"], lists.width), padded(anchors["lows"], MOST), padded(anchors["highs"], NONE)
    labels, ids, keys = (anchors[c].to_numpy() for c in ("label", "vec_id", "key"))
    low, high = lists.bounds(q)
    before = flat(anchors)
    given = kth_scores(before, len(q), lows.shape[1], want)
    found: tuple[np.ndarray, ...] = tuple(np.empty(0, np.int64) for _ in range(5))
    kth = given
    groups = {c: g for c, g in shard.groupby("cluster")}
    for c in sorted(groups, key=lambda c: -high[:, c].max(initial=-np.inf)):
        active = np.flatnonzero(meets(low[:, [c]], high[:, [c]], kth, lows, highs)[:, 0])
        if not len(active):
            continue
        g = groups[c]
        g_labels, g_ids, g_keys = (g[x].to_numpy() for x in ("label", "vec_id", "key"))
        scores = products(q[active], matrix(g["vector"], lists.width))
        fits = (labels[active][:, None] == g_labels[None, :]) == same
        if same:
            fits &= (ids[active][:, None] != g_ids[None, :]) | (keys[active][:, None] != g_keys[None, :])
        new = []
        for w in range(lows.shape[1]):
            least = np.maximum(lows[active, w], kth[active, w])
            a, r = np.nonzero(fits & (scores >= least[:, None]) & (scores <= highs[active, w][:, None]))
            new.append((active[a], np.full(len(a), w), scores[a, r], g_ids[r], g_keys[r]))
        found = best(tuple(np.concatenate([old, *(n[i] for n in new)]) for i, old in enumerate(found)), want)
        kth = np.maximum(given, kth_scores(found, len(q), lows.shape[1], want))
    starts = np.searchsorted(found[0], np.arange(len(q) + 1))
    cut = [[x[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] for x in found[1:]]
    return anchors.assign(w=cut[0], scores=cut[1], ids=cut[2], keys=cut[3])


class Index:
    """Inverted lists over rows(vec_id, label, key, vector), stored; the sample that centroids are trained on is bounded by ``sample``."""

    def __init__(self, rows: DataFrame, *, clusters: int, sample: int, rows_per_shard: int) -> None:
        rows = stored(rows, "vectors")
        n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        picked = rows.orderBy(F.xxhash64("vec_id", "key")).limit(sample).select("vector").toPandas()["vector"]
        vectors = matrix(picked, width or 0)
        centroids = train(vectors, min(clusters, max(1, round(n**0.5)))) if n else np.zeros((1, 0))

        def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in it:
                near, far = nearest(matrix(batch["vector"], width).astype(np.float64), centroids)
                yield batch.assign(cluster=near.astype(np.int32), distance=far)

        self.rows = stored(rows.mapInPandas(assign, f"{ROW}, cluster int, distance double"), "lists")
        stats = self.rows.groupBy("cluster").agg(F.count("*"), F.max("distance")).collect()  # a row for each cluster
        self.lists = Lists(centroids, {c: k for c, k, _ in stats}, {c: r for c, _, r in stats}, rows_per_shard)

    def dealt(self) -> DataFrame:
        """The rows with their shard."""
        first, parts = (F.array(*map(F.lit, x.tolist())) for x in (self.lists.first, self.lists.parts))
        place = F.get(first, F.col("cluster")) + F.pmod(F.xxhash64("vec_id", "key"), F.get(parts, F.col("cluster")))
        return self.rows.withColumn("shard", place)

    def search(self, anchors: DataFrame, same: bool, want: int) -> DataFrame:
        """vec_id, key, w, score, other_id, other_key, rank: for each window of anchors(vec_id, label, key, vector, lows, highs) the first ``want`` rows of the same
        label (or of all other labels), by falling score and then by id."""
        none = "array()"
        state = anchors.select("vec_id", "label", "key", "vector", "lows", "highs", *(F.expr(none).cast(kind).alias(c) for c, kind in (x.split() for x in FOUND.split(", "))))
        first = stored(self._wave(state, same, want, True), "wave")
        both = first.select("vec_id", "key", "w", "scores", "ids", "keys").union(self._wave(first, same, want, False).select("vec_id", "key", "w", "scores", "ids", "keys"))
        rows = both.select("vec_id", "key", F.inline(F.arrays_zip("w", "scores", "ids", "keys"))).toDF("vec_id", "key", "w", "score", "other_id", "other_key")
        order = Window.partitionBy("vec_id", "key", "w").orderBy(F.col("score").desc(), "other_id", "other_key")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)

    def _wave(self, state: DataFrame, same: bool, want: int, first: bool) -> DataFrame:
        lists = self.lists

        def plan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in it:
                for batch in (whole.iloc[i : i + 256].reset_index(drop=True) for i in range(0, len(whole), 256)):
                    lows, highs = padded(batch["lows"], MOST), padded(batch["highs"], NONE)
                    low, high = lists.bounds(matrix(batch["vector"], lists.width))
                    nothing = np.full(lows.shape, NONE, dtype=np.int64)
                    home = np.where(meets(low, high, nothing, lows, highs), high, -np.inf).argmax(1)
                    if first:
                        yield batch.assign(shard=lists.first[home])
                        continue
                    kth = kth_scores(flat(batch), len(batch), lows.shape[1], want)
                    to = np.zeros((len(batch), lists.shards), dtype=bool)
                    a, c = np.nonzero(meets(low, high, kth, lows, highs))
                    for part in range(int(lists.parts.max())):
                        some = lists.parts[c] > part
                        to[a[some], lists.first[c[some]] + part] = True
                    to[np.arange(len(batch)), lists.first[home]] = False  # seen in the first wave
                    a, s = np.nonzero(to)
                    yield batch.iloc[a].assign(shard=s)

        def visit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, rows, shard = [], None, None
            for batch in it:
                for number, part in batch.groupby("shard"):
                    if number != shard:
                        held, rows, shard = [], None, number
                    listed = part["cluster"] >= 0
                    if listed.any():
                        held.append(part[listed][["vec_id", "label", "key", "vector", "cluster"]])
                    asked = part[~listed]
                    if len(asked):
                        rows = pd.concat(held or [part[listed]]).drop_duplicates(["vec_id", "label", "key"]) if rows is None else rows
                        for i in range(0, len(asked), 256):
                            out = search_shard(rows, asked.iloc[i : i + 256], lists, same, want)
                            yield out.drop(columns=["shard", "cluster"])

        asked = state.mapInPandas(plan, f"{STATE}, shard long").withColumn("cluster", F.lit(-1))
        blank = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in STATE.split(", ")) if c not in ("vec_id", "label", "key", "vector")]
        index = self.dealt().select("vec_id", "label", "key", "vector", *blank, "shard", "cluster")
        both = index.unionByName(asked).repartition(max(1, lists.shards), "shard").sortWithinPartitions("shard", F.col("cluster") < 0)
        return both.mapInPandas(visit, STATE)


def mine(
    embeddings: DataFrame,
    anchors: Column,
    *,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    clusters: int = 1024,
    sample: int = 16_384,
    rows_per_shard: int = 16_384,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Of embeddings(vec_id, embedding, label), the rows where ``anchors`` holds are anchors; negatives score
    from low to high hundredths of the positive's score."""
    index = Index(integer_rows(embeddings, scale), clusters=clusters, sample=sample, rows_per_shard=rows_per_shard)
    asked = stored(index.rows.filter(anchors).select("vec_id", "label", "key", "vector").dropDuplicates(["vec_id", "label", "key"]), "anchors")
    everything = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("lows", NONE), ("highs", MOST))]
    near = stored(index.search(asked.select("*", *everything), True, positives), "positives")
    # at most ``positives`` rows an anchor
    listed = near.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").alias("s"), F.col("other_id").alias("o")))).alias("p"))
    with_windows = asked.join(listed, ["vec_id", "key"]).select(
        "vec_id",
        "label",
        "key",
        "vector",
        F.transform("p", lambda p: -F.floor(-low * p["s"].cast("decimal(38,0)") / 100).cast("long")).alias("lows"),
        F.transform("p", lambda p: F.floor(high * p["s"].cast("decimal(38,0)") / 100).cast("long")).alias("highs"),
    )
    far = index.search(with_windows, False, negatives)
    paired = near.select("vec_id", "key", (F.col("rank") - 1).alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.select("vec_id", "key", "w", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")).join(paired, ["vec_id", "key", "w"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
