import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidefence.errors import ModelError
from tidefence.operators.graph import GraphQuery, Literal, Var, match, pattern_counts

SCHEMA = "s string, p string, o string, datatype string"
INT = "http://www.w3.org/2001/XMLSchema#integer"


def term(t, b):
    if isinstance(t, Var):
        return b.get(t.name)
    return (t.value, t.datatype) if isinstance(t, Literal) else (t, None)


def brute(rows, patterns):
    """Every choice of a triple for each pattern that agrees."""
    graph = {((s, None), (p, None), (o, d)) for s, p, o, d in rows if None not in (s, p, o)}
    found = [{}]
    for pattern in patterns:
        new = []
        for b, triple in itertools.product(found, graph):
            out, ok = dict(b), True
            for t, value in zip(pattern, triple):
                bound = term(t, out)
                if bound is None:
                    out[t.name] = value
                elif bound != value:
                    ok = False
                    break
            if ok:
                new.append(out)
        found = [dict(x) for x in {tuple(sorted(b.items())) for b in new}]
    return sorted(tuple(sorted((k, v[0]) for k, v in b.items())) for b in found)


def solved(df):
    return sorted(tuple(sorted((k, v) for k, v in r.asDict().items())) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    names, rows = [f"n{i}" for i in range(9)], []
    for _ in range(70):
        o = r.choice([(r.choice(names), None), (r.choice(names), "str"), (str(r.randint(0, 3)), INT)])
        rows.append((r.choice(names), r.choice(["p", "q", "n1"]), *o))
    rows += rows[:5] + [(None, "p", "n1", None), ("n1", None, "n1", None), ("n1", "p", None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))


A, B, C, D, E = map(Var, "abcde")


@pytest.mark.parametrize(
    "patterns",
    [
        [(A, "p", B)],
        [(A, "p", B), (B, "q", C)],
        [(A, "p", B), (A, "q", B)],
        [(A, "p", A)],
        [(A, B, C), (C, "p", D)],
        [(A, "p", B), (B, C, D), (D, "q", E), (A, "q", E)],
        [(A, "p", Literal("1", INT)), (A, C, B), (B, "p", D)],
        [(A, B, "n1"), (B, "p", C)],
        [(A, A, B)],
        [(A, "p", B), (C, "q", B), (C, "p", D), (D, "q", E), (A, "q", D)],
    ],
)
def test_patterns_against_all_choices(graph, patterns):
    rows, t = graph
    assert solved(match(t, GraphQuery(patterns))) == brute(rows, patterns)


def test_optional_bind_filter_select(spark):
    rows = [("x", "age", "3", INT), ("y", "age", "9", INT), ("x", "knows", "y", None), ("y", "name", "Y", "str"), ("y", "name", "YY", "str")]
    t = spark.createDataFrame(rows, SCHEMA)
    q = GraphQuery(
        [(A, "age", B)],
        optional=[[(A, "knows", C), (C, "age", D)], [(A, "name", E)]],
        binds={"old": lambda v: v["b"].cast("int") > 5, "twice": lambda v: F.when(v["old"], v["b"].cast("int") * 2)},
        filters=[lambda v: v["b"].cast("int") > 2],
        select=["a", "c", "d", "e", "old", "twice"],
    )
    got = sorted(map(tuple, match(t, q).collect()), key=str)
    assert got == [("x", "y", "9", None, False, None), ("y", None, None, "Y", True, 18), ("y", None, None, "YY", True, 18)]
    assert sorted(map(tuple, match(t, GraphQuery([(A, B, C)], select=["a"], distinct=True)).collect())) == [("x",), ("y",)]


def test_fixed_patterns_and_empty_graphs(spark):
    t = spark.createDataFrame([("x", "p", "y", None)], SCHEMA)
    assert match(t, GraphQuery([(A, "p", B), ("x", "p", "y")])).count() == 1
    assert match(t, GraphQuery([(A, "p", B), ("x", "p", "z")])).count() == 0
    assert match(t.limit(0), GraphQuery([(A, "p", B), (B, "p", C)])).count() == 0
    assert pattern_counts(t, [(A, "p", B), (A, "q", B)]) == [1, 0]


def test_errors(spark):
    t = spark.createDataFrame([("x", "p", "y", None)], SCHEMA)
    for query, said in [
        (GraphQuery([]), "needs a pattern"),
        (GraphQuery([(A, "p", B), (C, "p", D)]), "share no variable"),
        (GraphQuery([(Literal("x"), "p", B)]), "only be an object"),
        (GraphQuery([(A, "p", B)], binds={"a": lambda v: v["b"]}), "meaning already"),
        (GraphQuery([(A, "p", B)], binds={"c": lambda v: v["z"]}), "unknown variable"),
        (GraphQuery([(A, "p", B)], select=["z"]), "unknown variables"),
        (GraphQuery([(A, "p", B)], optional=[[(C, "p", D)]]), "optional group"),
    ]:
        with pytest.raises(ModelError, match=said):
            match(t, query)


def test_the_smallest_pattern_comes_first(spark):
    rows = [(f"s{i}", "common", f"o{i}", None) for i in range(50)] + [("s3", "rare", "x", None)]
    df = match(spark.createDataFrame(rows, SCHEMA), GraphQuery([(A, "common", B), (A, "rare", C)]))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.index("rare") < plan.index("common") and df.count() == 1


def test_prefix_pass_reads_only_what_may_declare(spark, tmp_path, monkeypatch):
    """Statements without a declaration are left out before any pattern; ends with blanks, a bare full stop and comments read as before."""
    from tidefence.sources import turtle

    seen = []
    monkeypatch.setattr(turtle, "prefixes", lambda found, read=turtle.prefixes: (seen.append(found.count()), read(found))[1])
    body = "".join(f"p:s{i} p:o \"v\\n{i}\" .\n" for i in range(50))
    (tmp_path / "a.ttl").write_text("# @prefix no: <urn:no#> .\n@prefix p: <urn:p#> .\n" + body + "# a remark\np:last p:o p:e .  \n\t.  \n".replace(".  \n\t.", "."))
    rows = {(r.s, r.o) for r in turtle.turtle_triples(spark, str(tmp_path / "a.ttl")).collect()}
    assert rows == {(f"urn:p#s{i}", f"v\n{i}") for i in range(50)} | {("urn:p#last", "urn:p#e")}
    assert seen[0] <= 2
