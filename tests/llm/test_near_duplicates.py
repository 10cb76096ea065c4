import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidefence.llm import near_duplicates as N


def brute_fp(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints():
    r = random.Random(2)
    texts = ["", None, " \t\n", "One", "one two", "A b C", "É É é", "a\u00a0b c d"] + [" ".join(r.choices(["Ab", "c", "dé", "E\x0bf", "g"], k=r.randint(1, 40))) for _ in range(60)]
    assert [N.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


def test_golay_code():
    g = N.golay()
    words = np.arange(0, 1 << 23, 997, dtype=np.int64)
    own, near, some = g.decode(words)
    code = words ^ g.leader[g.byte[0][words & 255] ^ g.byte[1][words >> 8 & 255] ^ g.byte[2][words >> 16]]
    assert (np.bitwise_count(code ^ words) <= 3).all()
    assert all(g._divide(int(c)) == 0 for c in code[:500]) and (own == code >> 11).all()
    assert near.shape[1] == 5 and some.mean() > 0.8


def test_no_link_within_three_bits_is_missed():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    fps = [base]
    for bits in (1, 2, 3, 4):
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, bits, replace=False).astype(np.uint64)) for _ in base])
        fps.append(base ^ flips)
    u = np.unique(np.concatenate(fps))
    row, key, own = N.keys_of(u.view(np.int64))
    order = np.argsort(key, kind="stable")
    for block in (2_000_000, 64):
        a, b = N.links_of(key[order], u.view(np.int64)[row[order]], own[order], 3, block)
        assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 3).all()
        got = union(zip(a.tolist(), b.tolist(), strict=True), u.view(np.int64).tolist())
        pairs = [(int(x), int(y)) for i, x in enumerate(u.view(np.int64)) for y in u[i + 1 :][np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3].view(np.int64)]
        want = union(pairs, u.view(np.int64).tolist())
        assert got == want


def test_dense_key_goes_blockwise():
    r = np.random.default_rng(3)
    centre = np.uint64(int(r.integers(0, 2**63)))
    fps = np.unique(np.concatenate([[centre], *[[centre ^ np.uint64(1 << i) ^ np.uint64(1 << j)] for i in range(64) for j in range(i)]])).view(np.int64)
    key, own = np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
    a, b = N.links_of(key, fps, own, 3)
    assert len(a) < 2 * len(fps)
    assert len(set(union(zip(a.tolist(), b.tolist(), strict=True), fps.tolist()).values())) == 1


def test_components_against_brute_force(spark, docs, corpus):
    got = N.group(docs).collect()
    rows = corpus[0]
    assert len(got) == len(rows)
    fps = {r[0]: brute_fp(r[1]) for r in rows}
    ids = [i for i in fps if i is not None]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = union(pairs, ids)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: int(r.fingerprint, 16) for r in N.digest(N.group(docs)).collect()} == fps
    assert want[240] == 3 and want[243] == 242


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i * 7919 % 10007, (i + 1) * 7919 % 10007) for i in range(300)], "a long, b long")
    edges = edges.selectExpr("least(a, b) a", "greatest(a, b) b")
    got = N.components(edges)
    assert got.count() == 301 and got.select("root").distinct().count() == 1
    assert got.first().root == min(i * 7919 % 10007 for i in range(301))


def near(r, text, edits):
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"changed{r.randrange(999)}"
    return " ".join(words)


def test_stage_takes_copies_and_alike_texts(spark, docs, clashing):
    kept = N.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 240 not in ids and 241 not in ids and 243 not in ids and None in ids
    assert set(range(240)) | {242, 244, 245} <= set(ids)
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    rows = [(10 * i + k, near(r, t, 4 * (k > 0))) for i, t in enumerate(base) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = {i: set(N.shingle_hashes(t, 5).tolist()) for i, t in rows}
    want = union([(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])], list(s))
    got = {r.doc_id: r.component_id for r in N.group_alike(df).collect()}
    assert got == want and len(set(want.values())) < 60


def brute_groups(rows):
    s = {i: set(N.shingle_hashes(t, 5).tolist()) for i, t in rows}
    return union([(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])], list(s))


def test_members_that_fail_against_a_leader_are_still_linked(spark):
    """Variants are alike to their base only, whose id is in the middle; and chains in which each text is alike to the next only."""
    r = random.Random(11)
    base = " ".join(f"w{r.randrange(5000)}" for _ in range(300))
    rows = [(i, base if i == 150 else near(r, base, 5)) for i in range(300)]
    for c in range(4):
        text = " ".join(f"c{r.randrange(5000)}" for _ in range(300))
        for k in r.sample(range(40), 40):
            words = text.split()
            words[(7 * k) % 300] = f"step{c}.{k}"
            text = " ".join(words)
            rows.append((1000 + 100 * c + k, text))
    want = brute_groups(rows)
    got = {x.doc_id: x.component_id for x in N.group_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({want[i] for i in range(300)}) < 5
    assert got == want


def test_repeated_lines_do_not_make_copies(spark):
    """A line repeated 30 times fixes the SimHash of texts whose other words are their own."""
    rows = []
    for m in (7, 9, 11):
        line = " ".join(f"l{m}.{k}" for k in range(m))
        rows += [(100 * m + i, " ".join([line] * 30 + [f"u{m}.{i}.{k}" for k in range(60)])) for i in range(20)]
    rows.append((5000, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert N.group(df, 5).select("component_id").distinct().count() < len(rows) - 20
    assert {x.doc_id: x.component_id for x in N.group_alike(df).collect()} == brute_groups(rows)
    assert N.keep_one(df).count() == len(rows) - 1


def families():
    """60 bases, each with six variants that are less alike to it than 0.8 and partly alike to each other."""
    r = random.Random(23)
    rows = []
    for f in range(60):
        words = [f"w{f}.{r.randrange(4000)}" for _ in range(300)]
        rows.append((100 * f, " ".join(words)))
        changed = words[:]
        for i in range(12):
            changed[25 * i + 3] = f"z{f}.{i}"
        for k in range(6):
            variant = changed[:]
            for _ in range(r.randrange(1, 7)):
                variant[r.randrange(300)] = f"y{f}.{k}.{r.randrange(999)}"
            rows.append((100 * f + 1 + k, " ".join(variant)))
    return rows


def test_families_whose_base_is_not_alike_enough(spark):
    rows = families()
    want = brute_groups(rows)
    assert 100 < len(set(want.values())) < 300
    got = {x.doc_id: x.component_id for x in N.group_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = [(a, b) for a in want for b in range(a + 1, a - a % 100 + 7) if b in want and want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[a] == want[b] for a in got for b in range(a + 1, a - a % 100 + 7) if b in got and got[a] == got[b])


def test_keys_dealt_to_blocks_give_the_same(spark, monkeypatch):
    """Groups of 120 near copies and chains meet block by block."""
    r = random.Random(29)
    base = " ".join(f"w{r.randrange(5000)}" for _ in range(200))
    rows = [(i, near(r, base, 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x.doc_id: x.component_id for x in N.group_alike(df).collect()}
    assert want == brute_groups(rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    one = N.sketches(df, 5).withColumn("label", F.col("node") % 7)
    met = N._blocks(one)
    assert met.groupBy("key", "block").count().filter("count > 200").count() == 0 and met.filter("probe").count() > 0
    pairs = lambda m: {tuple(sorted((x.a, x.b))) for x in m.alias("p").filter("not probe").withColumnRenamed("node", "a").withColumnRenamed("label", "la").join(m.withColumnRenamed("node", "b").withColumnRenamed("label", "lb").withColumnRenamed("probe", "pb"), ["key", "block"]).filter("la <> lb").collect()}
    in_blocks = pairs(met)
    monkeypatch.setattr(N, "BLOCK_ROWS", 10_000)
    assert in_blocks == pairs(N._blocks(one))
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    assert {x.doc_id: x.component_id for x in N.group_alike(df).collect()} == want


def test_hot_codeword_keys_are_dealt_to_blocks(spark):
    r = np.random.default_rng(4)
    centre = np.uint64(int(r.integers(0, 2**63)))
    fps = [int((centre ^ np.uint64(1 << i) ^ np.uint64(1 << j)).view(np.int64)) for i in range(46, 64) for j in range(46, i)] + [int(centre.view(np.int64))]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (65_536, 20):
        found = {(x.a, x.b) for x in N.links(df, 3, hot).collect()}
        assert len(set(union(found, fps).values())) == 1
        assert all((np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).item().bit_count() <= 3 for a, b in found)


def test_empty_table(empty):
    assert N.group(empty).count() == 0 and N.keep_one(empty).count() == 0
