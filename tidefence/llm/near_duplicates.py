"""Near-duplicates: 64-bit SimHash linked through Golay-code fuzzy hashing.

Fingerprint: A-Z are lower-cased, words are runs without ASCII white space, shingles are n consecutive words
joined by spaces (fewer words: the whole sequence; none: fingerprint zero). Bit b is 1 if it is set in over half
of the shingles' XXH64 values (seed 42), repeats included.

Linking at 3 or fewer differing bits:

* The fingerprint is cut into segments of 23, 23 and 18 bits. Errors e1 <= e2 <= e3 over three segments that sum to
  at most 3 leave (e1, e2) = (0, 0), (0, 1) or (1, 1), the last only as (1, 1, 1). So some pair of segments differs by
  at most one bit in one of them, or the first pair differs by one bit in both.
* A segment is decoded by the perfect Golay code [23, 12, 7] to the index of the one codeword within 3 bits. If a
  segment x differs from y in one bit, y's codeword is within 4 bits of x; those are one to six codewords. A
  fingerprint therefore gives its own index and up to five nearby ones per segment. For each pair of segments
  these make keys of 24 bits: about 48 keys in all, of which three are its own.
* A fingerprint meets, under each of its keys, those that have the key as their own; survivors of an exact
  bit count are linked. Nothing is missed: the argument above covers every link.

Similarity of shingle sets: 3 of 64 bits is far stricter than a Jaccard similarity of 0.8 (of such pairs here, only one in ten
is that close), and texts in which one line is often repeated can be that close with hardly a shingle in common. For a stage that is defined
by similarity, ``alike`` therefore takes close fingerprints as candidates only and adds others: minimum hashes of the same shingle hashes give
``TABLES`` keys of ``ROWS`` values. Nodes that share a key and whose sketches agree are verified on whole shingle sets, inside the task that
holds the key: a union-find keeps what is joined, the row of the commonest shingles is compared with all, and every row it does not
join with all others. Only rows with an agreeing partner of another label bring their sets, no pair is ever emitted before it is verified, and at most one link per row and
label after. A key of many rows is dealt to blocks (``_blocks``). The fingerprints' components and two of the tables come first; then all tables, for what is not joined yet.

Copies share a fingerprint and are counted before anything is linked, so groups of copies cost one row. Rows of
one key are compared in blocks inside a task with a union-find that emits at most one link per fingerprint and
key, never all pairs. Components come from repeated contraction to the smallest neighbour; each round is
stored in the shared folder. No fingerprints or links reach the driver.

Cases: null and empty texts have fingerprint zero and link to each other and to any fingerprint with 3 or fewer bits. Repeated rows and repeated ids
are kept as rows; a component's id is the smallest id in it, nulls left out (null if all are). Other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every shingle, in order, repeats included; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([digest(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    return simhash(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per row of docs."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.col("text").cast("string")).alias("fp"))


class Golay:
    """Syndrome decoding of many 23-bit words at once."""

    def __init__(self) -> None:
        self.byte = []
        for shift in (0, 8, 16):
            self.byte.append(np.array([self._divide(v << shift) for v in range(256)], dtype=np.int64))
        self.leader = np.zeros(2048, dtype=np.int64)
        for weight in (1, 2, 3):
            for places in combinations(range(23), weight):
                e = sum(1 << p for p in places)
                self.leader[self._divide(e)] = e
        nearby: dict[int, list[int]] = {}
        for places in combinations(range(23), 4):
            e = sum(1 << p for p in places)
            nearby.setdefault(self._divide(e), []).append(e)
        self.has_nearby = np.zeros(2048, dtype=bool)
        self.nearby = np.zeros((2048, 5), dtype=np.int64)  # a word at 3 bits from its codeword has five others at 4 bits
        for s, errors in nearby.items():
            self.has_nearby[s], self.nearby[s] = True, errors

    @staticmethod
    def _divide(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << bit - 11
        return word

    def decode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own codeword index, the five nearby ones, and whether there are any."""
        s = self.byte[0][words & 255] ^ self.byte[1][words >> 8 & 255] ^ self.byte[2][words >> 16]
        return (words ^ self.leader[s]) >> 11, (words[:, None] ^ self.nearby[s]) >> 11, self.has_nearby[s]


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) for every key of every fingerprint."""
    u = fps.view(np.uint64)
    decoded = [golay().decode((u >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64)) for a, w in SEGMENTS]
    rows, keys, owns = [], [], []
    every = np.arange(len(fps))

    def add(pair: int, row: np.ndarray, x: np.ndarray, y: np.ndarray, own: bool) -> None:
        rows.append(row)
        keys.append(pair << 24 | x << 12 | y)
        owns.append(np.full(len(row), own))

    for p, (i, j) in enumerate(PAIRS):
        (x, near_x, some_x), (y, near_y, some_y) = decoded[i], decoded[j]
        add(p, every, x, y, True)
        rx, ry = every[some_x], every[some_y]
        for k in range(5):
            add(p, rx, near_x[rx, k], y[rx], False)
            add(p, ry, x[ry], near_y[ry, k], False)
        if p == 0:
            both = every[some_x & some_y]
            for k in range(5):
                for m in range(5):
                    add(p, both, near_x[both, k], near_y[both, m], False)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(owns)


def _explode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in it:
        fps = batch["fp"].to_numpy(np.int64)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            row, key, own = keys_of(part)
            yield pd.DataFrame({"key": key, "fp": part[row], "own": own})


def _explode_own(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The three keys that are a fingerprint's own."""
    for batch in it:
        u = batch["fp"].to_numpy(np.int64).view(np.uint64)
        index = [golay().decode((u >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64))[0] for a, w in SEGMENTS]
        yield pd.DataFrame({"key": np.concatenate([p << 24 | index[i] << 12 | index[j] for p, (i, j) in enumerate(PAIRS)])})


class _Sets:
    """Union-find over the positions of one block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _close(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= most


def links_of(key: np.ndarray, fp: np.ndarray, own: np.ndarray, most: int, block: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within most bits among rows of equal key (sorted), at most one per row and key."""
    u = fp.view(np.uint64)
    bounds = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(bounds)
    group = np.repeat(np.arange(len(size)), size)
    probes = own.astype(np.int64)
    n_own = np.bincount(group, weights=probes, minlength=len(size)).astype(np.int64)
    a, b = [], []
    order = np.lexsort((~own, group))  # own rows of a group come first
    small = np.flatnonzero((n_own > 0) & (size > 1) & (n_own * size <= 4096))
    cost = (n_own * size)[small]
    cuts = np.searchsorted(np.cumsum(cost), np.arange(0, cost.sum() + block, block))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        g = small[lo:hi]
        if len(g):
            each = n_own[g] * size[g]
            owner = np.repeat(np.arange(len(g)), each)
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            base, width = bounds[g][owner], size[g][owner]
            i, j = order[base + place // width], order[base + place % width]
            ok = (i != j) & _close(u[i], u[j], most) & (u[i] != u[j])
            a.append(fp[i[ok]])
            b.append(fp[j[ok]])
    for g in np.flatnonzero((n_own > 0) & (size > 1) & (n_own * size > 4096)):
        members = order[bounds[g] : bounds[g + 1]]
        value, first = np.unique(u[members], return_index=True)
        index = np.zeros(len(value), dtype=bool)
        index[np.searchsorted(value, u[members[: n_own[g]]])] = True
        sets, step = _Sets(len(value)), max(1, block // len(value))
        owners = np.flatnonzero(index)
        for at in range(0, len(owners), step):
            some = owners[at : at + step]
            p, q = np.nonzero(_close(value[some][:, None], value[None, :], most))
            for i, j in zip(some[p].tolist(), q.tolist(), strict=True):
                if i != j and sets.join(i, j):
                    a.append(value[i : i + 1].view(np.int64))
                    b.append(value[j : j + 1].view(np.int64))
    if not a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _match(most: int, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches come sorted by key; the last key of a batch waits for the next batch."""
    held: list[pd.DataFrame] = []

    def emit(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = links_of(rows["key"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64), rows["own"].to_numpy(bool), most)
        return pd.DataFrame({"a": a, "b": b})

    for batch in it:
        if not len(batch):
            continue
        last = batch["key"].iloc[-1]
        if held and held[0]["key"].iloc[-1] == last:
            held.append(batch)  # its rows all have the waiting key, or end in it
            if batch["key"].iloc[0] == last:
                continue
        else:
            held.append(batch)
        rows = pd.concat(held, ignore_index=True)
        cut = int(np.searchsorted(rows["key"].to_numpy(), last))
        held = [rows.iloc[cut:]]
        if cut:
            yield emit(rows.iloc[:cut])
    if held:
        yield emit(pd.concat(held, ignore_index=True))


def links(distinct: DataFrame, most: int = 3, hot: int = 65_536) -> DataFrame:
    """(a, b), a < b: links whose components are those of all pairs of distinct.fp within most <= 3 bits.

    A key that more than hot fingerprints have as their own is dealt to blocks of them; all its rows are sent to every block. Of keys that hot there are at
    most three for that many fingerprints, so their list is broadcast.
    """
    if most > 3:
        raise ValueError("three segments cover at most 3 differing bits")
    keyed = distinct.select("fp").mapInPandas(_explode, "key long, fp long, own boolean")
    own = distinct.select("fp").mapInPandas(_explode_own, "key long")
    wide = stored(own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("blocks")), "hot-keys")
    if wide.head(1):
        keyed = keyed.join(F.broadcast(wide), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        keyed = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        home = F.pmod(F.xxhash64("fp"), F.col("blocks")) == F.col("block")
        # pairs and codeword indices take 26 bits of a key
        keyed = keyed.select((F.col("key") + F.col("block").cast("long") * (1 << 26)).alias("key"), "fp", (F.col("own") & home).alias("own"))
    parts = max(1, -(-distinct.count() // 20_000))  # of about 48 keys each
    keyed = keyed.repartition(parts, "key").sortWithinPartitions("key")
    return keyed.mapInPandas(lambda it: _match(most, it), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): each round maps a node to its smallest neighbour and that one's,
    then contracts the edges; rounds shrink the graph geometrically because fingerprints are in random order."""
    edges = stored(edges, "links")
    found = None
    while True:
        if not edges.head(1):
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("up")), "up")
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = stored(up.join(top, "up").select("node", F.col("top").alias("root")), "step")
        if found is None:
            found = step
        else:
            higher = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = stored(found.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "found")
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id for rows(doc_id, fp), given edges between fingerprints."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    linked = components(edges)
    members = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    members = stored(members, "members")
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    stats = members.join(smallest, "root").select("fp", "n", "component_id")
    return skew_join(rows, stored(stats, "stats"), "fp", "n").select("doc_id", "fp", "component_id")


def group(docs: DataFrame, n: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text, ...)."""
    rows = stored(fingerprints(docs, n), "fingerprints")
    return _grouped(rows, links(rows.select("fp").distinct(), most))


# -- links by similarity of shingle sets ----------------------------------------------------------------

TABLES, ROWS, SKETCH = 12, 4, 128
#: Rows and shingles of a key that one task holds at a time.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1_000_000
_MIX = np.random.default_rng(64).integers(1, 2**63, size=(2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of SKETCH mixings of the hashes."""
    out = np.full(SKETCH, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        out = np.minimum(out, (part[None, :] * _MIX[0][:, None] + _MIX[1][:, None]).min(axis=1))
    return out


def table_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: TABLES * ROWS].reshape(TABLES, ROWS)
    key = np.arange(1, TABLES + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def node_of(shingles: np.ndarray) -> int:
    """XXH64 of a sorted set of shingle hashes, as a signed long: texts of one set are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).astype(np.int64))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, node, fp, size (distinct shingles), keys, sketch (a byte per minimum) for every row; keys and sketch are null without words."""

    @F.pandas_udf("node long, fp long, size long, keys array<long>, sketch binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            h = shingle_hashes(text, n)
            if not len(h):
                rows.append((0, 0, 0, None, None))
                continue
            distinct = np.unique(h)
            low = minima(distinct)
            byte = ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
            rows.append((node_of(distinct), np.uint64(simhash(h)).astype(np.int64), len(distinct), table_keys(low), byte.tobytes()))
        return pd.DataFrame(rows, columns=["node", "fp", "size", "keys", "sketch"]).astype({"node": "int64", "fp": "int64", "size": "int64"})

    return docs.select("doc_id", sketch(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def _fed(make, columns: list[str], it: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[pd.DataFrame]:
    """Feeds the rows of each (key, block), which come sorted with probes last, to make() and yields what its take() and close() give."""
    unit, at, held, n = None, None, [], 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(dict(zip(columns, (np.concatenate(c) for c in zip(*held, strict=True)), strict=True)))

    for batch in it:
        key, block, probe = batch["key"].to_numpy(np.int64), batch["block"].to_numpy(np.int64), batch["probe"].to_numpy(bool)
        node, label, data = batch["node"].to_numpy(np.int64), batch["label"].to_numpy(np.int64), batch["data"].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (probe[1:] != probe[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if lo == hi:
                continue
            new: list[tuple[np.ndarray, ...]] = []
            if at != (key[lo], block[lo]):
                if unit is not None:
                    new += unit.close()
                at = key[lo], block[lo]
                unit = make(*at)
            new += unit.take(bool(probe[lo]), node[lo:hi], label[lo:hi], data[lo:hi])
            held += new
            n += sum(len(x[0]) for x in new)
            if n >= most:
                yield frame()
                held, n = [], 0
    if unit is not None:
        held += unit.close()
    if held:
        yield frame()


class _Unit:
    """Rows at home in one block of one key, and what they share with each other and with probes from the key's other blocks."""

    def __init__(self, key: int, block: int) -> None:
        self.at = key, block
        self.homes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def take(self, probe: bool, node: np.ndarray, label: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        if not probe:
            self.homes.append((node, label, data))
            return []
        out = self._settle()
        return out + (self.probed(node, label, data) if self.homes else [])

    def close(self) -> list[tuple[np.ndarray, ...]]:
        return self._settle() + self.last()

    def _settle(self) -> list[tuple[np.ndarray, ...]]:
        if self.ready or not self.homes:
            return []
        self.ready = True
        self.node, self.label, data = (np.concatenate(c) for c in zip(*self.homes, strict=True))
        return self.settled(data)

    def last(self) -> list[tuple[np.ndarray, ...]]:
        return []


class _Agreeing(_Unit):
    """Gives the rows (key, block, probe, node, label) whose sketch agrees with one of another label."""

    def __init__(self, least: float, key: int, block: int) -> None:
        super().__init__(key, block)
        self.enough = int(np.ceil(least * SKETCH))

    def settled(self, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        self.sketch = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, SKETCH)
        self.open = np.zeros(len(self.node), dtype=bool)
        if (self.label != self.label[0]).any():
            for i in range(len(self.node)):
                self.open[i] = self._near(self.sketch[i], self.label[i]).any()
        return []

    def _near(self, sketch: np.ndarray, label: int) -> np.ndarray:
        return ((self.sketch == sketch).sum(axis=1) >= self.enough) & (self.label != label)

    def _rows(self, probe: bool, node: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        key, block = self.at
        return [(np.full(len(node), key), np.full(len(node), block), np.full(len(node), probe), node, label)] if len(node) else []

    def probed(self, node: np.ndarray, label: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        took = np.zeros(len(node), dtype=bool)
        for i, sketch in enumerate(data):
            near = self._near(np.frombuffer(sketch, dtype=np.uint8), label[i])
            took[i] = near.any()
            self.open |= near
        return self._rows(True, node[took], label[took])

    def last(self) -> list[tuple[np.ndarray, ...]]:
        return self._rows(False, self.node[self.open], self.label[self.open]) if self.ready else []


class _Verified(_Unit):
    """Gives links (a, b) of nodes with a Jaccard similarity of at least that, which join all such nodes of the unit; at most one for
    each row and label it is joined to."""

    def __init__(self, similarity: float, key: int, block: int) -> None:
        super().__init__(key, block)
        self.similarity = similarity

    def settled(self, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        sizes = np.array([len(s) for s in data], dtype=np.int64)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.vocabulary, code = np.unique(np.concatenate(data), return_inverse=True)
        self.code = code.astype(np.int32)
        _, first, self.place = np.unique(self.label, return_index=True, return_inverse=True)
        self.sets = _Sets(len(first))
        # the row whose shingles are the commonest joins most others, so few are left to compare with all
        common = np.add.reduceat(np.bincount(self.code)[self.code], self.start) / sizes
        anchor = int(common.argmax())
        out = self._join(anchor, self.code[self.start[anchor] :][: sizes[anchor]], sizes[anchor])
        for i in range(len(sizes)):
            if self.sets.root(self.place[i]) != self.sets.root(self.place[anchor]):
                out += self._join(i, self.code[self.start[i] :][: sizes[i]], sizes[i])
        return out

    def _near(self, code: np.ndarray, size: int) -> np.ndarray:
        mark = np.zeros(len(self.vocabulary), dtype=np.uint8)
        mark[code] = 1
        both = np.add.reduceat(mark[self.code], self.start, dtype=np.int64)
        return np.flatnonzero(both >= self.similarity * (self.size + size - both))

    def _join(self, i: int, code: np.ndarray, size: int) -> list[tuple[np.ndarray, ...]]:
        joined = [j for j in self._near(code, size).tolist() if self.sets.join(self.place[i], self.place[j])]
        return [(np.full(len(joined), self.node[i]), self.node[joined])] if joined else []

    def probed(self, node: np.ndarray, label: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        out = []
        for i, s in enumerate(data):
            code = np.searchsorted(self.vocabulary, s)
            code = np.minimum(code, len(self.vocabulary) - 1)
            near = self._near(code[self.vocabulary[code] == s], len(s))
            near = near[self.label[near] != label[i]]
            if len(near):
                _, one = np.unique([self.sets.root(p) for p in self.place[near].tolist()], return_index=True)
                out.append((np.full(len(one), node[i]), self.node[near[one]]))
        return out


UNIT = "key long, block int, probe boolean, node long, label long"


def _dealt(rows: DataFrame, per: int) -> DataFrame:
    """rows(key, block, probe, ...) to as many partitions as their count asks for, each (key, block) whole and in order."""
    parts = max(1, -(-rows.count() // per))
    return rows.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "probe")


def _blocks(one: DataFrame) -> DataFrame:
    """UNIT rows: where the nodes of one(node, label, size, keys) meet those of other labels with which they share a key.

    A key with more than BLOCK_ROWS nodes or BLOCK_SHINGLES shingles is dealt to several blocks. Each node is at home in one of them; a node
    that does not have the key's commonest label is also a probe in all others, so all pairs of different labels meet and no task gathers a key.
    """
    rows = one.select(F.explode("keys").alias("key"), "node", "label", "size")
    many = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"))
    keys = stored(keys.filter("n > 1 and low <> high").select("key", "n", many.alias("blocks")), "buckets")
    met = skew_join(rows.drop("size"), keys, "key", "n").drop("n")
    at_home = met.withColumn("block", F.pmod(F.xxhash64("key", "node"), F.col("blocks")).cast("int"))
    homes = at_home.select("key", "block", F.lit(False).alias("probe"), "node", "label")
    if not keys.filter("blocks > 1").head(1):
        return homes
    wide = at_home.filter("blocks > 1")
    commonest = wide.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("commonest"))
    # one row for each key of over BLOCK_ROWS nodes, so at most 13 rows for that many nodes
    probes = wide.join(commonest, "key").filter("label <> commonest").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("to <> block")
    return homes.unionByName(probes.select("key", F.col("to").alias("block"), F.lit(True).alias("probe"), "node", "label"))


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(node, data): the sorted set of shingle hashes of each of ids(doc_id, node)."""

    @F.pandas_udf("of long, s array<long>")
    def shingles(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, n)) for t in texts]
        return pd.DataFrame({"of": [node_of(s) for s in sets], "s": [s.view(np.int64) for s in sets]}).astype({"of": "int64"})

    ids = stored(ids, "candidate-ids")
    few = ids.count() <= broadcast_ids  # 16 bytes each
    near = F.broadcast(ids) if few else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(near, "doc_id")
    # marked so that the filter and the projection share one call; a repeated id can have several texts
    sets = rows.select("node", shingles.asNondeterministic()("text").alias("s")).filter("s.of = node")
    return sets.select("node", F.col("s.s").alias("data")).dropDuplicates(["node"])


def linked(docs: DataFrame, one: DataFrame, n: int, similarity: float) -> DataFrame:
    """(a, b): verified links between nodes of different labels that share a key of one(node, label, doc_id, size, sketch, keys)."""
    least = similarity - 0.12
    met = stored(_blocks(one), "met").join(one.select("node", F.col("sketch").alias("data")), "node")
    open_ = stored(_dealt(met, 50_000).mapInPandas(lambda it: _fed(lambda k, b: _Agreeing(least, k, b), [c.split()[0] for c in UNIT.split(", ")], it), UNIT), "open")
    ids = one.select("doc_id", "node").join(open_.select("node").distinct(), "node", "left_semi")
    whole = open_.join(stored(shingle_sets(docs, ids, n), "sets"), "node")
    pairs = _dealt(whole, 5_000).mapInPandas(lambda it: _fed(lambda k, b: _Verified(similarity, k, b), ["a", "b"], it), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike(docs: DataFrame, sketched: DataFrame, n: int, most: int, similarity: float, first_tables: int = 2) -> DataFrame:
    """(a, b): links whose components are those of all pairs of nodes whose sets of n-word shingles have at least that Jaccard similarity.

    A node's keys are those of its minimum hashes and the component of its fingerprint at most bits. Some of the keys link most
    nodes; then all keys are searched for pairs that verified links have not joined.
    A pair of that similarity is missed with a probability of 0.2 %. sketched: what sketches() gives for docs.
    """
    some = sketched.filter("sketch is not null and doc_id is not null")
    one = some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "size", "keys", "sketch")])
    close = components(links(some.select("fp").distinct(), most)).select(F.col("node").alias("fp"), "root")
    one = one.join(close, "fp", "left").select("node", "doc_id", "size", "sketch", F.concat(F.array(F.coalesce("root", "fp")), "keys").alias("keys"))
    one = stored(one, "one")
    first = one.withColumn("label", F.col("node")).withColumn("keys", F.slice("keys", 1, 1 + first_tables))
    good = stored(linked(docs, first, n, similarity), "alike")
    labels = components(good).select("node", F.col("root").alias("label"))
    rest = stored(one.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    return good.unionByName(linked(docs, rest, n, similarity)).distinct()


def group_alike(docs: DataFrame, n: int = 5, most: int = 3, similarity: float = 0.8) -> DataFrame:
    """doc_id, node, component_id for every row: like group, with links between shingle sets of at least that similarity.

    Fingerprints within most bits are candidates only, since a line repeated often can fix all bits of texts that share little else.
    """
    rows = stored(sketches(docs, n), "sketches")
    grouped = _grouped(rows.select("doc_id", F.col("node").alias("fp")), alike(docs, rows, n, most, similarity))
    return grouped.withColumnRenamed("fp", "node")


def digest(grouped: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hex digits."""
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, most: int = 3, similarity: float = 0.8, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Of each component of group_alike the row with the smallest id; of rows that repeat that id, one. Rows without an id stay.

    The ids that go are broadcast if there are at most broadcast_ids of them (8 bytes each), so texts do not move; more are joined by a shuffle.
    """
    ids = group_alike(docs, n, most, similarity).filter("doc_id is not null").groupBy("doc_id")
    ids = stored(ids.agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("rows")), "ids")
    gone = ids.filter("not stays").select("doc_id")
    kept = docs.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if ids.filter("stays and rows > 1").head(1):
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept
