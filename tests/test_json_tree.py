import json
import random

import pytest
from pyspark.sql import functions as F

from tidefence.functions.json_tree import nodes


def walk(v, path="$", parent=None, name=None, position=None, depth=0):
    kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "number"
    text = json.dumps(v) if kind in ("number", "boolean") else v if kind == "string" else None
    yield path, parent, name, position, kind, text, depth
    if isinstance(v, dict):
        for k, x in v.items():
            step = f".{k}" if k.isidentifier() and k.isascii() else f'."{k}"'
            yield from walk(x, path + step, path, k, None, depth + 1)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]", path, None, i, depth + 1)


def random_value(r, depth):
    kind = r.choice("oaaosnb0") if depth else r.choice("snb0")
    if kind == "o":
        return {r.choice(["a", "b", "x y", "é", "c1"]): random_value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if kind == "a":
        return [random_value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {"s": r.choice(["", "t", "ü \" q"]), "n": r.randint(-5, 10**12), "b": r.random() < 0.5, "0": None}[kind]


def test_every_node_at_any_depth(spark):
    r = random.Random(8)
    docs = [(i, random_value(r, i % 6)) for i in range(60)] + [(60, json.loads("[" * 9 + "1" + "]" * 9)), (61, {}), (62, 3)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(99, None)], "id int, doc string").withColumn("path", F.lit("clash"))
    got = sorted((tuple(x) for x in nodes(df, "id", "doc").collect()), key=str)
    assert got == sorted(((i, *n) for i, v in docs for n in walk(v)), key=str)


def test_empty_tables_and_errors(spark):
    df = spark.createDataFrame([], "id int, doc string")
    assert nodes(df, "id", "doc").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        nodes(spark.createDataFrame([(1, "{a")], "id int, doc string"), "id", "doc").count()
