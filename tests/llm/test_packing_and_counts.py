import zlib

import numpy as np
from tokenizers import Tokenizer

from tidefence.llm import packing as P
from tidefence.llm import token_counts as C
from tidefence.llm.tokens import default_path, encode


def tokenizer():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return t


TEXTS = ["", "plain words", "  spaces \n\n\t and tabs ", "don't they'll I'm 123,456.7", "naïve Straße élève ñandú", "中文字符 и русский", "emoji 😀👍🏽", "a" * 6000, " " * 5000 + "x", "<|endoftext|>", "\u0530 armenian", "e\u0301 combining", "x\u00a0y\u2003z", "word " * 500]


def test_ids_equal_those_of_the_tokenizer_file(corpus):
    t = tokenizer()
    for text in TEXTS + [r[1] for r in corpus[0][:80] if r[1]]:
        assert encode(text, default_path()) == t.encode(text, add_special_tokens=False).ids
    assert encode(None, default_path()) == []


def check(rows, ids, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, expected in ids.items():
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.start for r in got] == list(np.cumsum([0] + [r.length for r in got[:-1]]))
        assert sum(r.length for r in got) == len(expected)
        assert all(r.length == capacity for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(expected[r.start : r.start + r.length], dtype="<u4").tobytes())
    return len(bins)


def test_pieces_round_trip(docs, corpus):
    t, capacity = tokenizer(), 256
    rows = P.pack(docs, capacity=capacity).collect()
    seen = [r[0] for r in corpus[0]]
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in corpus[0] if seen.count(r[0]) == 1}
    n = check(rows, ids, capacity)
    total = sum(r.length for r in rows)
    assert n <= 1.1 * total / capacity + 1
    assert sum(r.doc_id == 7 for r in rows) == 2 * max(1, -(-len(t.encode(corpus[0][7][1]).ids) // capacity))


def test_open_bins_against_brute_force():
    r = np.random.default_rng(4)
    for most in (1, 3, 50):
        bins, capacity = P.OpenBins(100, most), 100
        open_, made, places = [], 0, []
        for size in r.integers(1, 101, 600).tolist():
            fits = [b for b in open_ if b[0] >= size]
            if fits:
                b = min(fits, key=lambda b: b[0])
                open_.remove(b)
            else:
                b = [capacity, made]
                made += 1
            offset = capacity - b[0]
            left = b[0] - size
            if left:
                if len(open_) == most:
                    fullest = min(open_, key=lambda b: b[0])
                    if left > fullest[0]:
                        open_.remove(fullest)
                        open_.append([left, b[1]])
                else:
                    open_.append([left, b[1]])
            places.append((b[1], offset))
            number, at = bins.place(size)
            assert at + size <= capacity
            assert bins.count <= most
        assert bins.made == made


def test_histogram_answers(docs, corpus):
    t = tokenizer()
    lengths = sorted(len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus[0])
    h = C.histogram(docs)
    rows = h.collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {n: lengths.count(n) for n in set(lengths)}
    for r in rows:
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
        assert abs(r.share_at_most - sum(n <= r.n_tokens for n in lengths) / len(lengths)) < 1e-12
    for q in (0.1, 0.5, 0.9, 1.0):
        assert C.quantile(h, q) == min(n for n in lengths if sum(m <= n for m in lengths) >= q * len(lengths) - 1e-9)
    for limit in (0, 1, 100, 333, 10**6):
        assert C.truncated_total(h, limit) == sum(min(n, limit) for n in lengths)


def test_suffix_sums_over_many_ranges(spark):
    counts = {n: n % 7 + 1 for n in range(0, 9000, 13)}
    h = C.suffix_sums(spark.createDataFrame(list(counts.items()), "n_tokens long, n_docs long"), width=64).collect()
    for r in h[::97]:
        assert r.docs_at_least == sum(c for n, c in counts.items() if n >= r.n_tokens)


def test_empty_tables_and_clashing_columns(empty, clashing, docs):
    assert P.pack(empty).count() == 0 and C.histogram(empty).count() == 0
    assert P.pack(clashing).count() == P.pack(docs).count()
    assert C.histogram(clashing).count() == C.histogram(docs).count()
