import numpy as np

from tidefence.llm import toxicity as X

from .conftest import crc


def test_held_out_rows_are_told_apart(docs, labels, corpus):
    got = X.assess(docs, labels, min_rows=3).collect()
    assert len(got) == len(corpus[0])
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert held and all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in held)
    assert all(r.predicted == corpus[1][r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[242].predicted == by[243].predicted == 0 and by[242].score == by[243].score
    assert by[240].score == by[3].score


def test_stage(clashing, labels):
    kept = X.keep_clean(clashing, labels, min_rows=3)
    assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {i for i in range(0, 240, 5)} and {i for i in range(240) if i % 5} <= ids and None in ids


def test_no_labels_and_empty_tables(docs, labels, empty):
    assert {r.score < 1e-9 for r in X.assess(docs, labels.filter("toxic = 0")).collect()} == {True}
    assert X.assess(empty, labels).count() == 0
    assert X.keep_clean(docs, labels.filter("doc_id < 0")).count() == docs.count()


def test_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(1)
    n = 40_000
    y = (r.random(n) < 0.2).astype(float)
    fire = lambda good, bad: (r.random(n) < np.where(y > 0, bad, good)).astype(int)
    a, b, c, noise = fire(0.02, 0.7), fire(0.05, 0.6), fire(0.01, 0.3), fire(0.5, 0.5)
    votes = np.stack([a, b, c, noise, noise], axis=1)  # the last two are one voter twice
    labelled, toxic = votes[:300], y[:300]
    m = X.fit_label_model(votes.sum(0).astype(float), (votes.T @ votes).astype(float), n, labelled, toxic)
    gain = m.log_odds[:, 1] - m.log_odds[:, 0]
    assert gain[0] > gain[1] > 5 * abs(gain[3])
    assert m.block[3] == m.block[4] and len(set(m.block)) == 4
    assert abs(1 / (1 + np.exp(-m.prior)) - 0.2) < 0.05
    p = m.posterior(votes)
    assert p[y > 0].mean() > 0.7 > 0.2 > p[y == 0].mean()
    # with few and unlucky anchors the corpus brings the rates nearer to the truth
    poor = X.fit_label_model(votes.sum(0).astype(float), (votes.T @ votes).astype(float), n, votes[:40], y[:40])
    alone = X.fit_label_model(np.zeros(5), np.zeros((5, 5)), 0, votes[:40], y[:40])
    truth = np.log(0.7 / 0.02) - np.log(0.3 / 0.98)
    far = lambda x: abs(x.log_odds[0, 1] - x.log_odds[0, 0] - truth)
    assert far(poor) < far(alone)


def test_counts_of_voters_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [([i for i in range(8) if r.random() < 0.3],) for _ in range(500)]
    fired, together, n = X.co_firing(spark.createDataFrame(rows, "e array<int>"), "e", [1, 4, 6])
    assert n == 500
    for i, x in enumerate((1, 4, 6)):
        assert fired[i] == sum(x in e for (e,) in rows)
        for j, z in enumerate((1, 4, 6)):
            assert together[i, j] == sum(x in e and z in e for (e,) in rows)


def test_the_label_model_decides(docs, labels, corpus, monkeypatch):
    """The classifier's only target is the posterior: without what the label model says, no row is told apart."""
    monkeypatch.setattr(X.LabelModel, "posterior", lambda self, votes: np.full(len(votes), 0.5))
    got = {r.doc_id: r.score for r in X.assess(docs, labels, min_rows=3).collect()}
    toxic = [got[i] for i, t in corpus[1].items() if t]
    clean = [got[i] for i, t in corpus[1].items() if not t]
    assert max(toxic) - min(toxic) < 1e-6 and abs(np.mean(toxic) - np.mean(clean)) < 1e-6


def test_clashing_columns(docs, clashing, labels):
    assert sorted(map(str, X.assess(clashing.withColumn("entries", clashing["n"]), labels, min_rows=3).collect())) == sorted(map(str, X.assess(docs, labels, min_rows=3).collect()))


def test_classifier_takes_repeats_as_no_sign_of_cleanness():
    r = np.random.default_rng(2)
    # entry 0 alone marks toxic rows; entry 1 (the same twice) is rare and, by chance, mostly clean
    rows = [[0]] * 60 + [[0, 1]] * 2 + [[1]] * 6 + [[]] * 300
    target = np.array([1.0] * 60 + [1.0] * 2 + [0.0] * 6 + (r.random(300) < 0.02).astype(float).tolist())
    w, bias = X.fit_classifier(rows, target, 2, 2)
    assert w[0] > 2 and w[1] >= 0 > bias
    w, bias = X.calibrate(w, bias, rows, target, 0.7)
    score = 1 / (1 + np.exp(-(bias + w[0])))
    assert score > 0.7 > 1 / (1 + np.exp(-bias))


def test_patterns():
    loud = "THIS IS ALL VERY LOUD NOW!! YES!!"
    assert X.patterns_of(loud, 7, 7)[0]
    assert X.patterns_of("a### b%%% c$$$", 3, 3)[1]
    assert X.patterns_of("for " * 40, 40, 1)[2]
    assert not any(X.patterns_of("quite an ordinary sentence of words", 6, 6))
