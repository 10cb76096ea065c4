import os

import pytest

from tidefence.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.execute(Q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (df.astype({c: "Int64" for c in columns if df[c].dtype.kind in "if" and (df[c].dropna() % 1 == 0).all()}) for df in (got, want))
    a, b = (df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert a.equals(b)


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op3_toxicity", "op5_language_id", "op7_packing", "op8_media", "op10_sharding", "op11_importance_resampling", "op12_bpe", "op13_hard_negatives"])
def test_schemas(spark, name):
    want = {
        "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op7_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op8_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary, times array<int>, landmarks array<int>",
        "op10_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op11_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
        "op12_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    }
    df = Q.QUERIES[name](spark, DATA)
    assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == want[name]
