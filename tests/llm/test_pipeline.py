import zlib

import numpy as np

import corpus_pipeline as P
from tidefence.llm.common import WRITTEN, small_batches
from tidefence.llm import decontamination as D
from tidefence.llm import near_duplicates as N
from tidefence.llm.tokens import default_path, encode


def tables(spark, docs, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    item = docs.filter("doc_id = 6").first().text
    spark.createDataFrame([(0, item), (1, "nothing of the kind in here at all, really not one bit")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_against_brute_force(spark, docs, labels, corpus, tmp_path):
    tables(spark, docs, labels, str(tmp_path))
    rows = {}
    before = list(WRITTEN)
    packed = P.run(spark, str(tmp_path))
    assert len(WRITTEN) == len(before) + 1  # only the result is left
    for r in packed.collect():
        rows.setdefault(r.doc_id, []).append(r)
    # odd ones (no letters), toxic ones, copies, and the one that is a benchmark item go; the rest stays
    toxic = {i for i, t in corpus[1].items() if t}
    want = {*range(240), 245, None} - toxic - {6} | ({241} if 4 in toxic else set())
    assert set(rows) == want
    text = {r[0]: r[1] for r in corpus[0]}
    sequences = {}
    for doc, parts in rows.items():
        ids = [*encode(text[doc], default_path()), 0]
        assert sum(p.length for p in parts) == len(ids)
        for p in sorted(parts, key=lambda p: p.piece):
            piece = np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(piece)
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_each_stage_alone(spark, docs, labels, clashing, empty, tmp_path):
    item = tables(spark, docs, labels, str(tmp_path))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert P.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0
    left = P.remove_benchmark(spark, docs, str(tmp_path)).filter("text is not null").collect()
    index = [D.SuffixAutomaton([("0", D.words_of(item))], 10)]
    assert all(not D.hits_of(r.text, index)[1] for r in left)
    kept = P.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    sets = [set(N.shingle_hashes(r.text, 5).tolist()) for r in kept if r.text]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_batches_only_get_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for has, want in (("64MB", 4 << 20), ("1m", 1 << 20), (str(4 << 20), 4 << 20)):
            spark.conf.set(name, has)
            small_batches(spark)
            assert spark.conf.get(name) == str(want), has
    finally:
        spark.conf.set(name, before)
