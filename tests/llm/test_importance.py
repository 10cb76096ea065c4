import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidefence.llm import importance as I


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, target, longest=1, buckets=10_000, seed=2024, min_words=20, percent=10):
    def hashed(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(hashed(x))
    for x in target:
        t.update(hashed(x))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t_all + buckets) / ((s[b] + 1) * (s_all + buckets)))) for s_all, t_all in [(sum(t.values()), sum(s.values()))] for b in range(buckets)]
    rows = []
    for i, x in docs:
        f = hashed(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): n for n, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((*r[:4], rank.get(id(r))) for r in rows) if all(r[0] is not None for r in rows) else [(*r[:4], rank.get(id(r))) for r in rows]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 55), (2, 500, 100)])
def test_against_brute_force(spark, longest, buckets, percent):
    r = random.Random(longest)
    stock = ["alpha", "Beta", "gämma", "δ", "x1", "42", "o'clock", "dé-jà", "ZZ"]
    docs = [(i, " ".join(r.choices(stock, k=r.choice([0, 1, 5, 19, 20, 60])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "alpha " * 30_000)]
    target = [" ".join(r.choices(stock[:4], k=30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = I.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, buckets=buckets, percent=percent, min_words=5)
    want = brute(docs, target, longest, buckets, percent=percent, min_words=5)
    assert sorted(rows_of(got)) == want
    assert ", ".join(f"{c} {k}" for c, k in got.dtypes) == "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"


def test_repeated_rows_null_ids_and_extra_columns(spark):
    text = "one two three four five six seven eight nine ten " * 3
    docs = [(7, text)] * 40 + [(None, text)] * 3 + [(8, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in ("score", "rank", "weight", "above", "n", "words", "bucket", "span", "n_words"):
        df = df.withColumn(c, F.lit("x"))
    got = rows_of(I.resample(df, spark.createDataFrame([("one two",)], "text string"), percent=50))
    assert len(got) == 44 and sorted(r[4] for r in got if r[4] is not None) == list(range(1, 22))
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in brute(docs, ["one two"]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 9), (2, "d e f " * 9)], "doc_id long, text string")
    assert rows_of(I.resample(none, some)) == []
    assert sorted(rows_of(I.resample(some, none, percent=50))) == brute([(1, "a b c " * 9), (2, "d e f " * 9)], [], percent=50)


def test_offsets_in_two_levels(spark):
    r = random.Random(2)
    values = [r.randint(-(10**6), 10**6) for _ in range(3000)] + [5] * 40
    counts = spark.createDataFrame([(v, n) for v, n in Counter(values).items()], "score long, n long")
    for drawn in (1, 7, 1500, 3040):
        got = {x.score: x.above for x in I.offsets(counts, drawn).collect()}
        every = sorted(values, reverse=True)
        want = {v: every.index(v) for v in set(values)}
        assert got == {v: a for v, a in want.items() if a < drawn}
