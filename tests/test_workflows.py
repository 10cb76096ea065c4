import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidefence import queries as Q
from tidefence.errors import ModelError
from tidefence.operators import checks, generate
from tidefence.operators import events as E
from tidefence.operators import machine as M
from tidefence.operators.regions import Region
from tidefence.plans import composition, rdf
from tidefence.plans.model import compile_text
from tidefence.sources import reports

CRS = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
T0 = datetime(2025, 3, 11, 6, 45)
# Minutes and positions of the published trace, whose outcome is compared.
TRACE = [(0, 5), (5, 12), (12, 5), (20, 12), (31, 13)]
Z = Region.closed("Z", ((0, 0), (10, 0), (10, 10), (0, 10)), CRS)


def test_three_encodings_give_one_outcome(spark):
    stamp = lambda m: (T0 + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")
    model = f'model C version "1" crs W = "{CRS}" region Z crs W = polygon [[0,0],[10,0],[10,10],[0,10]]\nentity S {{ property p: Point crs W state st oneof [Safe, AtRisk] }}\ninstance s: S {{ p = point(5,5) st = Safe }}\n'
    model += "".join(f'observe s.p = point({x}, 5) {{ at "{stamp(m)}" source g }}\n' for m, x in TRACE)
    model += "process D(s: S) { when leaves(s.p, Z) for 10 min changes s.st: Safe -> AtRisk }"
    data = '@prefix ex: <https://e/> . @prefix geo: <http://www.opengis.net/ont/geosparql#> . @prefix sosa: <http://www.w3.org/ns/sosa/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\nex:s a geo:Feature ; ex:initialState ex:Safe . ex:Z geo:hasGeometry ex:ZG .\n'
    data += f'ex:ZG geo:asWKT "<{CRS}> POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"^^geo:wktLiteral .\n'
    for i, (m, x) in enumerate(TRACE):
        data += f'ex:o{i} a sosa:Observation ; sosa:hasFeatureOfInterest ex:s ; sosa:resultTime "{stamp(m)}"^^xsd:dateTimeStamp ; sosa:hasResult ex:r{i} .\nex:r{i} geo:asWKT "<{CRS}> POINT ({x} 5)"^^geo:wktLiteral .\n'
    policy = '@prefix ex: <https://e/> . @prefix time: <http://www.w3.org/2006/time#> . ex:P a ex:GeofencePolicy ; ex:subject ex:s ; ex:region ex:Z ; ex:trigger ex:leaves ; ex:fromState ex:Safe ; ex:toState ex:AtRisk ; time:hasDuration [ time:numericDuration "10" ; time:unitType time:unitMinute ] .'
    feature = json.dumps({"type": "Feature", "id": "s", "temporalGeometry": {"type": "MovingPoint", "datetimes": [stamp(m) for m, _ in TRACE], "coordinates": [[x, 5] for _, x in TRACE], "interpolation": "Step"}, "properties": {"initialState": "Safe"}})
    rules = json.dumps({"type": "GeofencePolicy", "name": "P", "subject": "s", "regionName": "Z", "region": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]}, "boundaryPolicy": "coveredBy", "trigger": "leaves", "minimumDurationSeconds": 600, "fromState": "Safe", "toState": "AtRisk"})
    a = composition.from_model(spark, compile_text(model))
    b = composition.from_graphs(spark, data, policy, "https://e/")
    c = composition.from_features(spark, feature, rules)
    row = a.first()
    assert row.final_state == "AtRisk" and len(row.instantaneous) == 3 and len(row.sustained) == 1
    assert a.collect() == b.collect() == c.collect()
    assert checks.outcome_differences(a, b).count() == 0
    assert checks.outcome_differences(a, c.withColumn("final_state", F.lit("Safe"))).first().differs == ["final_state"]
    with pytest.raises(ModelError):
        composition.from_graphs(spark, data, policy.replace("unitMinute", "unitHour"), "https://e/")


def test_bounded_exploration(spark):
    """All sequences of up to four positions: deterministic, states stay in their domain, one monitor per name, the horizon empties it."""
    moves = generate.bounded_sequences(spark, [("west", -1, 5), ("edge", 0, 5), ("inside", 5, 5), ("east", 11, 5)], 4)
    assert moves.select("subject").distinct().count() == 340
    p = M.Program(("Z",), (M.Rule("in", "enters", "Z", "Safe", "Inside"), M.Rule("out", "leaves", "Z", "Inside", "Outside", 2_000_000)))
    first, second = (M.run(moves, [Z], p, initial_state="Safe") for _ in range(2))
    assert checks.snapshot(first) == checks.snapshot(second)
    states = first.filter("entry = 'final' and kind = 'state'")
    assert states.count() == 340 and states.filter(~F.col("to_state").isin("Safe", "Inside", "Outside")).count() == 0
    assert first.filter("kind = 'pending'").groupBy("subject", "name").count().filter("count > 1").count() == 0
    done = M.run(moves, [Z], p, initial_state="Safe", horizon_us=10_000_000)
    assert done.filter("kind = 'pending'").count() == 0
    assert done.filter("entry = 'final' and kind = 'state' and to_state = 'Outside'").count() > 0


def test_generators_and_ladder(spark):
    m = generate.alternating_moves(spark, 100, subjects=3)
    assert E.crossings(m, [Z]).count() == 99 * 3
    o = generate.observations(spark, 50, CRS)
    blocks = rdf.sosa(o)
    assert blocks.filter("section = 7").count() == 50 and blocks.filter("section = 5").count() == 10


def test_policies_on_constructed_traces(spark):
    """Boundary inclusion, sampling, start guard, deadline guard, cancellation and emission time on traces where they decide."""
    us = 60_000_000

    def end(rules, moves, **kw):
        f = M.Fold(M.Program(("Z",), tuple(rules), (), M.Semantics(**kw)), "s", "Safe")
        rows = [r for t, inside in moves for r in f.move(t * us, int(inside))]
        return f.state, [(r[4], r[8] // us, r[9] // us) for r in rows if r[0] == "event"]

    late = M.Rule("late", "leaves", "Z", "Safe", "AtRisk", 10 * us)
    now = M.Rule("now", "leaves", "Z", "Safe", "Busy")
    assert end([late], [(0, 1), (1, 0), (11, 1)]) == ("AtRisk", [("leaves", 1, 1), ("sustained leaves", 11, 11), ("enters", 11, 11)])
    assert end([late], [(0, 1), (1, 0), (11, 1)], timers_first=False)[0] == "Safe"
    assert end([late, now], [(0, 1), (1, 0), (20, 0)]) == ("Busy", [("leaves", 1, 1), ("sustained leaves", 11, 20)])
    assert end([late, now], [(0, 1), (1, 0), (20, 0)], guard_deadline=False)[0] == "AtRisk"
    assert end([late], [(0, 1), (1, 0), (5, 1), (30, 1)])[0] == "Safe" and end([late], [(0, 1), (1, 0), (5, 1), (30, 1)], cancel_opposite=False)[0] == "AtRisk"
    assert end([late], [(0, 1), (1, 0), (20, 0)], emit_at_deadline=True)[1][-1] == ("sustained leaves", 11, 11)
    assert checks.changed_switches(M.Semantics(duration_scale=2.0)) == ["duration_scale"]


def test_bindings(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, trigger string, seconds int")
    d = checks.binding_differences(make([("a", "leaves", 600), ("b", "enters", 5), ("c", "enters", 1)]), make([("a", "leaves", 300), ("b", "enters", 5), ("d", "enters", 1)]), "name", ["trigger", "seconds"])
    assert {r.name: r.differences for r in d.collect()} == {"a": ["seconds"], "c": ["missing right"], "d": ["missing left"]}
    bad = checks.outside_domain(spark.createDataFrame([("r", "Lost"), ("s", "Safe")], "rule string, to string"), spark.createDataFrame([("Safe",)], "value string"), "to")
    assert [r.rule for r in bad.collect()] == ["r"]
    assert spark.range(1).select(checks.crossing_name(F.lit("leaves"), F.lit("s"), F.lit("Z"))).first()[0] == "leaves__s__Z"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 12345, None)], "k string, n long, x double")
    md, js = reports.write(df, str(tmp_path / "r"), "Counts")
    assert "| a | 12,345 |  |" in md.read_text() and json.loads(js.read_text()) == [{"k": "a", "n": 12345, "x": None}]
    (tmp_path / "one.json").write_text(json.dumps({"experiment": "load", "rate": 5}))
    assert reports.stored_results(spark, str(tmp_path / "one.json"), "load", "rate int").first().rate == 5
    with pytest.raises(Exception, match="not a result"):
        reports.stored_results(spark, str(tmp_path / "one.json"), "other", "rate int").collect()
    assert reports.rising_list("1,4,8") == [1, 4, 8]
    for bad in ("", "a", "2,1", "0,1"):
        with pytest.raises(ModelError):
            reports.rising_list(bad)
    assert reports.version_of("http://r/1.1/x") == "1.1" and reports.version_of("http://r/x") == "unversioned"


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.execute(Q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (df[columns].astype(str).sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(entry.oracle_sql())


def test_hot_plans_stay_in_the_jvm_and_push_down(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("crossings", "sustained_events", "membership_covered_by", "zone_breakdown", "sosa_blocks"):
        text = plan(Q.QUERIES[name](spark, DATA))
        assert "Python" not in text and "CartesianProduct" not in text, name
    text = plan(Q.QUERIES["bbox_window_scan"](spark, DATA))
    assert "PushedFilters: [IsNotNull(value)" in text and "event_type" not in text
    assert plan(Q.QUERIES["crossings"](spark, DATA)).count("Exchange hashpartitioning") == 1


def test_counter_difference_of_groups_on_one_side(spark):
    from tidefence.operators import stats

    before = spark.createDataFrame([("a", 5, 1.5), ("gone", 4, 0.5)], "k string, n int, v double")
    after = spark.createDataFrame([("a", 7, 1.0), ("new", 3, None)], "k string, n int, v double")
    assert sorted(map(tuple, stats.counter_difference(before, after, "k").collect())) == [("a", 2, -0.5), ("gone", -4, -0.5), ("new", 3, None)]
