import hashlib
import random
import re

import pytest

from tidefence.llm import decontamination as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w = words(text)
    hit, names = [0] * len(w), set()
    for name, t in items:
        v = words(t)
        if not v:
            continue
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                names.add(name)
                hit[i : i + k] = [1] * k
    return len(w), sum(hit), sorted(names)


@pytest.mark.parametrize("seed", range(4))
def test_hits_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(500):
        letters, window = "abcdefg"[: r.choice([2, 3, 6])], r.choice([2, 3, 4, 10])
        make = lambda n: " ".join(r.choice(letters) for _ in range(n))  # noqa: B023, E731
        items = [(str(i), make(r.randint(0, 14))) for i in range(r.randint(0, 5))]
        full = [(n, D.words_of(t)) for n, t in items if D.words_of(t)]
        blocks = [D.SuffixAutomaton(full, window)] if r.random() < 0.5 else [D.SuffixAutomaton([x], window) for x in full]
        text = make(r.randint(0, 30))
        n, spans, names = D.hits_of(text, blocks)
        assert (n, sum(b - a for a, b in spans), names) == brute(text, items, window)
        left = D.cleaned(text, blocks, 1, 1.0)
        assert left is None or brute(left, items, window)[1] == 0


def test_words_are_the_contracts():
    for t in ("Don't STOP—now", "a_b c.d 3x\u00a0y", "É Ü ß", "\x80x", ""):
        assert [w.decode() for w in D.words_of(t)] == words(t)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(0, ITEM), (1, "tiny item"), (2, None), (3, "..."), (4, ITEM), (10, "other " * 12)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_screen_and_blocks(spark, docs, benchmark, corpus):
    more = [(900, f"Intro text {ITEM.upper()} and more", "xx", "s", 0), (901, "a tiny ITEM here", "xx", "s", 0), (902, ITEM, "xx", "s", 0)]
    df = docs.union(spark.createDataFrame(more, docs.schema))
    items = [(str(r.item_id), r.text) for r in benchmark.collect()]
    rows = corpus[0] + more
    for size in (200_000, 5):
        got = {r.doc_id: r for r in D.digest(D.screen(df, benchmark, block_words=size)).collect()}
        for doc, text, *_ in rows:
            n, hit, names = brute(text, items, 10)
            r = got[doc]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    kept = {r.doc_id: r for r in D.remove_leaks(df, benchmark).collect()}
    assert sorted(map(str, D.remove_leaks(df, benchmark, block_words=15).collect())) == sorted(map(str, D.remove_leaks(df, benchmark).collect()))
    assert 902 not in kept and kept[901].text == "a  here" and kept[901].n_chars == 7
    assert kept[0].text == rows[0][1] and kept[242].text is None and kept[243].text == ""
    assert 900 not in kept or "ALPHA" not in kept[900].text


def test_empty_tables_and_clashing_columns(spark, docs, empty, clashing, benchmark):
    assert D.screen(empty, benchmark).count() == 0 and D.remove_leaks(empty, benchmark).count() == 0
    none = benchmark.limit(0)
    assert D.digest(D.screen(docs, none)).filter("contaminated").count() == 0
    kept = D.remove_leaks(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == docs.count()


def test_a_large_benchmark_comes_in_blocks(spark):
    """Each block is bounded by its words and named items are those of all blocks."""
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(40))) for i in range(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(D.blocks_of(benchmark, 10, 2000))
    assert len(blocks) == 8 and all(len(b.length) <= 2 * 2000 + 1 for b in blocks) and sum(len(b.names) for b in blocks) == 400
    text = " ".join(["lead in"] + [items[i][1] for i in (3, 120, 399)] + ["way out"])
    docs = spark.createDataFrame([(0, text), (1, "nothing"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in D.screen(docs, benchmark, block_words=2000).collect()}
    assert got[0]["items"] == sorted(["3", "120", "399"]) and got[0].n_hit == 120 and got[1].n_hit == got[2].n_hit == 0
    assert sorted(map(str, got.values())) == sorted(map(str, D.screen(docs, benchmark).collect()))
