import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that the operators make.
CLASHING = ("score", "held_out", "component_id", "fp", "shard", "slot", "size", "piece", "start", "length", "sequence_id", "language_guess", "toxicity", "decontaminated", "rule", "path", "key", "n", "s", "p", "h")
SYLLABLES = {"xx": ["ba", "ko", "mi", "tur"], "yy": ["sche", "lich", "ung", "ver"]}


def words(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Two languages, toxic words in a fifth, copies, near copies, and the odd cases."""
    r = random.Random(5)
    rows, toxic = [], {}
    for i in range(240):
        lang = ("xx", "yy")[i % 2]
        text = words(r, lang, r.randint(30, 80))
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            text = text.replace(" ", " wretch ", 1) + " grublins and grubbery"
        rows.append((i, text, lang, "src", len(text)))
    rows.append((240, rows[3][1], "yy", "src", rows[3][4]))
    rows.append((241, rows[4][1] + " extra", "xx", "src", rows[4][4] + 6))
    rows.append((242, None, None, None, None))
    rows.append((243, "", "xx", "src", 0))
    rows.append((244, "123 !!! 456", "xx", "src", 11))
    rows.append((245, words(r, "xx", 9000), "xx", "src", 0))
    rows.append((None, "koba mitur", "xx", "src", 10))
    rows.append(rows[7])
    return rows, toxic


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 1, t) for i, t in corpus[1].items()] + [(0, 1, 0), (None, 1, 1), (5, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    out = docs
    for c in CLASHING:
        out = out.withColumn(c, F.lit(1))
    return out


def crc(i):
    return zlib.crc32(str(i).encode())
