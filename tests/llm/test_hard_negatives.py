import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefence.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, step=50, positives=5, negatives=3, low=50, high=95):
    ok = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted({(i, lab, tuple(v)) for i, lab, v in ok})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in ok:
        if a[0] % step:
            continue
        near = sorted(((-dot(a[2], b[2]), b[0]) for b in ok if b is not a and b[1] == a[1]))[:positives]
        for s, p in near:
            s = -s
            far = sorted(((-dot(a[2], b[2]), b[0]) for b in ok if b[1] != a[1] and low * s <= 100 * dot(a[2], b[2]) <= high * s))[:negatives]
            out += [(a[0], p, k, n, s, -t) for k, (t, n) in enumerate(far, 1)]
    return sorted(out)


def vectors(seed, n, dims, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dims))
    lab = r.integers(0, 4, n)
    return [(i, [float(np.float32(x)) for x in centres[int(r.integers(0, 6))] + spread * r.normal(size=dims)], int(lab[i])) for i in range(n)]


def mined(spark, rows, step=50, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % step == 0, **kw).collect()))


@pytest.mark.parametrize(("seed", "dims", "spread", "kw"), [(1, 8, 0.1, {}), (2, 16, 0.6, {"clusters": 9, "rows_per_shard": 40}), (3, 3, 0.02, {"clusters": 40, "sample": 50, "rows_per_shard": 25}), (4, 5, 2.0, {"rows_per_shard": 17})])
def test_against_brute_force(spark, seed, dims, spread, kw):
    rows = vectors(seed, 400, dims, spread)
    got = mined(spark, rows, 20, **kw)
    assert got and got == brute(rows, 20)


def test_odd_rows_ties_and_copies(spark):
    rows = vectors(5, 150, 4, 0.2)
    rows += [(200 + i, rows[10][1], i % 3) for i in range(120)]  # a list of copies, parted over shards
    rows += [(400, None, 1), (401, [1.0, None, 2.0, 0.0], 1), (402, [float("nan"), 0.0, 0.0, 0.0], 1), (403, [float("inf"), 0.0, 0.0, 0.0], 1), (404, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(405, [], 2), (450, [0.5], 2), (451, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 3), (452, [0.0] * 4, 2)]
    rows += rows[:9]
    assert mined(spark, rows, 10, clusters=5, rows_per_shard=30) == brute(rows, 10)


def test_windows_of_a_search_skip_lists(spark):
    rows = vectors(6, 300, 6, 0.05)
    index = H.Index(H.integer_rows(spark.createDataFrame(rows, SCHEMA), 256), clusters=12, sample=300, rows_per_shard=50)
    a = H.matrix(index.rows.toPandas()["vector"], 6)
    low, high = index.lists.bounds(a[:20])
    listed = index.rows.toPandas()
    scores = H.products(a[:20], a)
    for c in range(len(index.lists.centroids)):
        inside = scores[:, (listed["cluster"] == c).to_numpy()]
        assert (inside >= low[:, [c]]).all() and (inside <= high[:, [c]]).all()
    skipped = ~H.meets(low, high, np.full((20, 1), H.NONE), np.full((20, 1), 60_000), np.full((20, 1), H.MOST))
    assert skipped.mean() > 0.25


def test_numbers_beyond_doubles():
    a = np.array([[2**40, 3], [5, -(2**62)]], dtype=np.int64)
    assert H.products(a, a).tolist() == [[H.MOST, 5 * 2**40 - 3 * 2**62 if abs(5 * 2**40 - 3 * 2**62) < 2**63 else H.NONE], [5 * 2**40 - 3 * 2**62 if abs(5 * 2**40 - 3 * 2**62) < 2**63 else H.NONE, H.MOST]]


def test_empty_tables_and_other_columns(spark):
    assert mined(spark, []) == []
    r = random.Random(7)
    rows = [(i * 50, [r.random() for _ in range(4)], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "shard", "w", "rank", "cluster", "vector", "scores"):
        df = df.withColumn(c, F.lit("x"))
    want = brute([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert sorted(map(tuple, H.mine(df, F.col("vec_id") % 50 == 0).collect())) == want
