import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tidefence.llm import bpe
from tidefence.llm.tokens import default_path

ALPHABETS = [
    list("abs'tremvld \t\n .,!?0123"),
    list("abs' éÉñßÀ×÷·\u0085\xa0"),
    list("ab 中文字、。，！-"),
    list("ab\n\r\t ' 12\x0b\x0c\x1c "),
    list("a's ́‍🎉\xb2\xbd\xaaс"),
    ["<|endoftext|>", "<|endo", "ftext|>", "'s", "'re", " ", "a", "\n"],
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def texts(seed, n=400):
    r = random.Random(seed)
    out = []
    for k in range(n):
        letters = ALPHABETS[k % len(ALPHABETS)]
        out.append("".join(r.choices(letters, k=r.choice([0, 1, 2, 30, 200, 900]))))
    return out


@pytest.mark.parametrize("least", [4, 64])
def test_ids_are_those_of_the_library(library, least, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST", max(least, 4))
    monkeypatch.setattr(bpe, "BITS", 3 if least == 4 else 8)
    codec = bpe.Codec(default_path())
    some = texts(least)
    want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert [list(codec.encode(t)) for t in some] == want
    if least == 64:  # candidates of a group are those of a text only if no cut lies in the first 32 bytes
        assert list(map(list, codec.encode_all(some))) == want
    assert [codec.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want] == some


def test_shared_chunks_are_encoded_once(library):
    r = random.Random(3)
    passage = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(800))
    codec = bpe.Codec(default_path())
    own = ["".join(r.choices("ijklm ", k=300)) for _ in range(40)]
    codec.encode(passage)
    once = codec.encoded_chunks
    for o in own:
        text = f"{o}{passage}{o[::-1]}"
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert once > 8 and codec.encoded_chunks - once < len(own) * 8  # the passage's own chunks came from the store, all but those at its ends
    copies = codec.encoded_chunks
    codec.encode(f"{own[0]}{passage}{own[0][::-1]}")
    assert codec.encoded_chunks == copies


def test_cuts_follow_content_and_part_no_character():
    r = random.Random(4)
    data = "".join(r.choices("abcde éß中🎉", k=40_000)).encode()
    ends = bpe.cuts(data)
    assert ends[-1] == len(data) and all(data[a:b].decode() for a, b in zip([0, *ends], ends))
    moved = bpe.cuts(b"some words before it " + data)
    assert len({e - 21 for e in moved} & set(ends)) > 0.9 * len(ends)
    assert max(b - a for a, b in zip([0, *ends], ends)) <= bpe.MOST + 3
    assert bpe.cuts(b"") == [] and bpe.cuts(b"a" * 10_000)[-1] == 10_000


def test_a_small_store_and_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 300)
    codec = bpe.Codec(default_path())
    for text in ("a" * 60_000, "word " * 30_000, "中" * 9_000, "ab" * 3_000 + " " * 3_000 + "c"):
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert codec.held[0] < 10_000


def test_other_vocabularies_are_encoded_whole(tmp_path):
    t = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, " ": 3}, [("a", "b")]))
    t.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
    t.save(str(tmp_path / "other.json"))
    codec = bpe.Codec(str(tmp_path / "other.json"))
    assert not codec.sure and list(codec.encode("ab ba" * 100)) == t.encode("ab ba" * 100).ids


def test_invalid_bytes_decode_as_in_the_library(library):
    codec = bpe.Codec(default_path())
    r = random.Random(5)
    for _ in range(300):
        ids = [r.randrange(50_257) for _ in range(r.randint(0, 20))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, library, docs):
    some = [r for r in docs.select("doc_id", "text").collect()]
    with_names = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2)).withColumn("n_tokens", F.lit(3))
    got = sorted(map(tuple, bpe.digest(bpe.decode(bpe.encode(with_names))).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in some:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)


def test_columns_stay_and_empty_tables(spark, docs, empty):
    out = bpe.decode(bpe.encode(docs.withColumn("score", F.lit(1))))
    assert out.columns == [*docs.columns, "score", "ids", "decoded"]
    assert out.filter("coalesce(text, '') <> decoded").count() == 0
    assert bpe.digest(bpe.decode(bpe.encode(empty))).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decoded_text(F.col("ids"))).first()[0] is None
