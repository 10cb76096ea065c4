import math
from collections import defaultdict

from tidefence.llm import language_id as L

from .conftest import crc


def brute(train, word, order):
    """Code length of a word in each language by the definition of the model."""
    out = {}
    for lang, texts in train.items():
        seen = defaultdict(lambda: defaultdict(int))
        for text in texts:
            for w in L.WORD.findall(text.lower()):
                b = b" " + w.encode()
                for i in range(1, len(b)):
                    for k in range(min(order, i) + 1):
                        seen[b[i - k : i]][b[i]] += 1
        bits, b = 0.0, b" " + word.encode()
        for i in range(1, len(b)):
            for k in range(min(order, i), -2, -1):
                if k < 0:
                    bits += 8
                    break
                c = seen.get(b[i - k : i])
                if not c:
                    continue
                total, distinct = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / (total + distinct))
                    break
                bits -= math.log2(distinct / (total + distinct))
        out[lang] = bits
    return out


def test_code_lengths_are_exact(spark):
    train = {"xx": ["ba komi mitur bako", "turba mi"], "yy": ["schelich ungver", "lich ver ver"], "zz": ["éa öo"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in train.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, held_out_fold=-1)
    assert model.languages == ["xx", "yy", "zz"]
    words = ["mi", "bakomi", "lichlich", "éö", "qwertz", "b", "ver", "ungé"]
    got = model.code_lengths(words)
    for w, row in zip(words, got, strict=True):
        for value, expected in zip(row, brute(train, w, 4).values(), strict=True):
            assert abs(value - expected) < 1e-9, w


def test_accuracy_and_odd_cases(docs, corpus):
    got = L.identify(docs).collect()
    assert len(got) == len(corpus[0])
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in held)
    assert sum(r.lang_pred == ("xx", "yy")[r.doc_id % 2] for r in held) / len(held) > 0.97
    for odd in (242, 243, 244):
        assert by[odd].lang_pred == "und" and by[odd].score == 0
    assert by[245].lang_pred == "xx" and by[None].lang_pred == "xx" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got) and by[240].score == by[3].score
    assert sum(r.doc_id == 7 for r in got) == 2


def test_stage_keeps_columns_and_drops_the_undetermined(clashing):
    kept = L.keep_identified(clashing)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {*range(242), 245, None}


def test_empty_table(empty):
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).count() == 0


def test_without_labels_everything_is_undetermined(docs):
    from pyspark.sql import functions as F

    got = L.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in got.collect()} == {"und"}


def test_chunks_change_nothing(docs):
    import pandas as pd

    model = L.fit(docs)
    texts = pd.Series(["koba mitur " * 50, "schelich", None, "ba"] * 5)
    assert model.predict(texts).equals(model.predict(texts, chunk_chars=10))


def test_texts_of_no_learned_language_go(spark, docs, clashing):
    import random

    r = random.Random(4)
    odd = [(5000 + i, " ".join("".join(r.choice("qxzjvwkgqyhfp") for _ in range(r.randint(3, 9))) for _ in range(40)), None, "s", 0) for i in range(20)]
    odd += [(6000 + i, "слово за слово и ещё одно слово длинное предложение на другом языке", None, "s", 0) for i in range(3)]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {x.doc_id for x in L.keep_identified(df).collect()}
    assert set(range(242)) | {245, None} <= kept and not kept & {242, 243, 244} and not any(i is not None and i >= 5000 for i in kept)
    assert L.keep_identified(clashing).columns == clashing.columns


def test_blank_lang_is_a_value(spark):
    rows = [(i, "ba komi mitur ba" if i % 2 else "schelich ungver lich", "xx" if i % 2 else "") for i in range(40)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"xx", ""} and all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_clashing_columns(docs, clashing):
    assert sorted(map(str, L.identify(clashing).collect())) == sorted(map(str, L.identify(docs).collect()))


def test_many_languages(spark):
    """More than a chain of conditions could hold; a few of them are sampled."""
    from tidefence.llm import language_id

    rows = [(i, f"wort{i % 400} lang{i % 400} text{i % 400} " * 3, f"l{i % 400}'\"") for i in range(4_000)] + [(9_000 + i, "und so weiter und so fort", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, order=2, max_docs_per_language=20)
    assert len(model.languages) == 401
    assert language_id.identify(docs, order=2, max_docs_per_language=20).filter("held_out").count() > 500
