import json

import pytest
from pyspark.sql import functions as F

from tidefence.errors import ModelError
from tidefence.operators import stats, world
from tidefence.operators.events import crossings, sustained
from tidefence.operators.regions import Region
from tidefence.sources import documents, measurements, tracks

CSV = """SID,SEASON,BASIN,NAME,ISO_TIME,LAT,LON,TRACK_TYPE
 ,Year, , , ,degrees_north,degrees_east,
K7,1999,EP,PETREL,1999-03-05 03:00:00,-12.25,44.5,main
K7,1999,EP,PETREL,1999-03-05 09:00:00,-11.75,51.5,main
K7,1999,EP,PETREL,1999-03-06 09:00:00,-10.5,56.25,Main
K7,1999,EP,PETREL,1999-03-07 03:00:00,-10.0,63.0,main
M2,2003,SP,TERN,2003-11-20 12:00:00,5.5,-171.0,main
M2,2004,SP,GULL,2003-11-20 18:00:00,6.0,188.5,main
M2,2003,SP,TERN,2003-11-20 18:00:00,6.0,-171.5,main
Q1,1987,NI,SWIFT,1987-05-01 00:00:00,15.0,88.0,main
Q1,soon,NI,SWIFT,1987-05-01 06:00:00,15.5,87.0,main
Q1,1987,NI,SWIFT,1987-05-01 12:00:00,-95.0,86.0,main
Q1,1987,NI,SWIFT,1987-05-01 18:00:00,16.0,85.0,side
"""


def test_track_file(spark, tmp_path):
    """By hand: one units row, one season and one latitude are invalid, one row is of another type; M2's second and third rows are one point."""
    path = tmp_path / "t.csv"
    path.write_text("\ufeff" + CSV, encoding="utf-8")
    c = tracks.classify(tracks.scan(spark, str(path)))
    assert tuple(tracks.quality(c).first()) == (8, 1, 3)
    t = tracks.clean(c)
    assert t.count() == 7 and t.select("sid").distinct().count() == 3 and tracks.clean(c, 1).count() == 4
    assert {(r.season, r.name) for r in t.filter("sid = 'M2'").collect()} == {(2003, "TERN")}
    assert tuple(tracks.extent(t).first())[:4] == (1987, 2003, 3, ["EP", "NI", "SP"])
    with pytest.raises(ModelError):
        tracks.clean(c, 0)
    crs = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
    zone = Region.closed("Channel", ((50, -20), (60, -20), (60, 0), (50, 0)), crs)
    m = tracks.as_moves(t, crs)
    assert m.select("subject").distinct().count() == 2  # Q1 has one sample
    got = crossings(m, [zone]).orderBy("ts").collect()
    assert [(r.kind, r.seq) for r in got] == [("enters", 1), ("leaves", 3)]
    # entered at 09:00, still in 24 h later, left 42 h after; nothing follows the last sample
    held = sustained(m, [zone], {"24h": 24 * 3_600_000_000, "48h": 48 * 3_600_000_000}).collect()
    assert [(r.kind, r.duration, r.emitted_at.day) for r in held] == [("enters", "24h", 6)]
    tracks.write_snapshot(t, str(tmp_path / "snapshot"))
    again = tracks.clean(tracks.classify(tracks.scan(spark, str(tmp_path / "snapshot"))))
    assert again.orderBy("sid", "ts").collect() == t.orderBy("sid", "ts").collect()
    assert [r.device for r in tracks.numbered(t, 5).orderBy("device").collect()] == [1, 2, 3, 4, 5]
    from tidefence.operators.regions import region_table

    tracks.write_database_inputs(region_table(spark, [zone]), t, str(tmp_path / "db"))
    assert spark.read.csv(str(tmp_path / "db" / "samples")).count() == 7 and "POLYGON ((50 -20" in spark.read.csv(str(tmp_path / "db" / "regions")).first()[2]
    bad = tmp_path / "bad.csv"
    bad.write_text("A,B\n1,2\n")
    with pytest.raises(ModelError, match="missing columns"):
        tracks.scan(spark, str(bad))
    assert tracks.source_label("ibtracs.since1980.list.csv") == "since 1980"


def texts(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


FEATURE = {"type": "Feature", "id": "s", "temporalGeometry": {"type": "MovingPoint", "datetimes": ["2026-07-19T08:00:00Z", "2026-07-19T08:05:00Z"], "coordinates": [[5, 5], [12, 5]], "interpolation": "Step"}, "properties": {"initialState": "Safe"}}


def test_moving_features(spark):
    rows = documents.moving_features(texts(spark, FEATURE)).orderBy("seq").collect()
    assert [(r.subject, r.seq, r.x, r.initial_state) for r in rows] == [("s", 0, 5.0, "Safe"), ("s", 1, 12.0, "Safe")]
    linear = json.loads(json.dumps(FEATURE))
    del linear["temporalGeometry"]["interpolation"]
    short = json.loads(json.dumps(FEATURE))
    short["temporalGeometry"]["coordinates"] = [[5, 5]]
    falling = json.loads(json.dumps(FEATURE))
    falling["temporalGeometry"]["datetimes"] = ["2026-07-19T08:05:00Z", "2026-07-19T08:00:00Z"]
    for bad, message in ((linear, "Step"), (short, "differ"), (falling, "rising"), ({"type": "Thing"}, "feature")):
        with pytest.raises(Exception, match=message):
            documents.moving_features(texts(spark, bad)).collect()


def test_polygon_policies(spark):
    p = {"type": "GeofencePolicy", "name": "P", "subject": "s", "regionName": "Z", "region": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}, "boundaryPolicy": "coveredBy", "trigger": "leaves", "minimumDurationSeconds": 600, "fromState": "A", "toState": "B"}
    r = documents.polygon_policies(texts(spark, p)).first()
    assert (r.region, len(r.shell), r.duration_us, r.to_state) == ("Z", 4, 600_000_000, "B")


def binding(subject="a%20b", inside="false"):
    v = lambda x: {"value": x}
    return {"subject": v(f"https://e.test/instance/{subject}"), "region": v("https://e.test/region/r"), "inside": v(inside), "coveredBy": v("true"), "disjoint": v("false"), "onBoundary": v("true")}


def test_query_results(spark, tmp_path):
    doc = {"results": {"bindings": [binding()]}}
    assert documents.sparql_results(texts(spark, doc)).collect() == [("a b", "r", False, True, False, True)]
    for bad in ([binding(), binding()], [binding(inside="maybe")]):
        with pytest.raises(Exception, match="repeated|malformed"):
            documents.sparql_results(texts(spark, {"results": {"bindings": bad}})).collect()
    path = tmp_path / "rows.csv"
    path.write_text("a,r,t,t,f,f\nb,r,f,f,t,f\n")
    rows = documents.database_rows(spark, str(path))
    left = rows.withColumn("inside", F.when(F.col("subject") == "b", True).otherwise(F.col("inside")))
    assert sorted(stats.compare_rows(left, rows.filter("subject = 'b'"), ["subject", "region"]).select("subject", "status").collect()) == [("a", "left only"), ("b", "different")]


def test_result_names_are_last_parts(spark):
    names = {"https://e.test/a/b%20c": "b c", "https://e.test/a/b/": "b", "https://e.test/a/b?q=/x#y": "b", "https://e.test/a/b#/c?d": "b", "b": "b", "https://e.test/a//": ""}
    flags = {p: {"value": "true"} for p in documents.PREDICATES}
    doc = {"results": {"bindings": [{"subject": {"value": iri}, "region": {"value": f"r/{i}"}, **flags} for i, iri in enumerate(names)]}}
    got = documents.sparql_results(texts(spark, doc)).orderBy("region").collect()
    assert [r.subject for r in got] == list(names.values())


def test_result_documents_are_built_in_their_rows(spark, tmp_path):
    """One shuffle, that of the check for repeats: no document is gathered from rows of its bindings."""
    from tidefence.source_queries import query_result_rows

    rows = [(i, i % 2, float(x), f'{{"k": {y}}}') for i, (x, y) in enumerate([(10, 10), (30, 60), (50, 30), (2000, 5)])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, props string").selectExpr("*", "timestamp '2026-01-01' AS ts", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    df = query_result_rows(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.subject, r.region): (r.inside, r.coveredBy, r.disjoint, r.onBoundary) for r in df.collect()}
    inside, outside, edge = (True, True, False, False), (False, False, True, False), (False, True, False, True)
    assert len(got) == 20 and got["0", "Notch"] == inside and got["1", "Tri"] == edge and got["2", "BandLow"] == got["2", "BandMid"] == edge
    assert all(v == outside for (subject, _), v in got.items() if subject == "3")


def test_manifest_and_register(spark):
    m = documents.manifest(texts(spark, {"classes": {"core": ["/t/a", "/t/b"], "ext": ["/t/c"]}}))
    assert m.count() == 3
    register = spark.createDataFrame([("http://r/x/a",), ("http://r/y/b",), ("http://r/z/b",)], "iri string")
    assert sorted(documents.match_register(m.select("id"), register).select("id", "status").collect()) == [("/t/a", "corroborated"), ("/t/b", "ambiguous"), ("/t/c", "unmatched")]


def test_content_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "f.txt").write_bytes(b"a\r\nb")
    assert documents.content_hash(spark, str(tmp_path / "f.txt"), normalise_line_ends=True).first().sha256 == hashlib.sha256(b"a\nb").hexdigest()
    (tmp_path / "g.bin").write_bytes(b"\xff\xd0\xda\r\n\r\r\n\x00")
    assert documents.content_hash(spark, str(tmp_path / "g.bin"), normalise_line_ends=True).first().sha256 == hashlib.sha256(b"\xff\xd0\xda\n\r\n\x00").hexdigest()


def test_load_logs(spark):
    p = measurements.log_lines(texts(spark, "0 1 1000 0 1 1 0", "1 1 3000 2 1 2 1", "1 2 deadlock 2 1 3 3", "short"))
    s = measurements.log_summary(p).first()
    assert (s.transactions, s.p50_ms, s.retries, s.failures) == (2, 2.0, 4, 1)
    assert measurements.log_summary(p, "script").filter("script = 0").first().p99_ms == 1.0
    assert measurements.failures(p).collect() == [("deadlock", 1)]
    o = measurements.log_summary(measurements.log_lines(texts(spark, "0 1 2000 0 1 1 1500 2"))).first()
    assert (o.lag_p99_ms, o.retries, o.failures) == (1.5, 2, 0)
    assert measurements.late(p, 2.0).first().late == 1


def test_units_and_samples(spark):
    row = spark.range(1).select(*[measurements.byte_count(F.lit(v)) for v in ("1.5MiB", "2 GB", "7", "odd!")]).first()
    assert tuple(row) == (1_572_864, 2_000_000_000, 7, None)
    sample = json.dumps({"CPUPerc": "12.5%", "MemUsage": "1KiB / 2GiB", "NetIO": "1kB / 2kB", "BlockIO": "3MB / 4MB", "PIDs": "5"})
    df = spark.createDataFrame([(0.0, sample), (2.0, sample.replace("3MB", "5MB"))], "elapsed_s double, value string")
    s = measurements.container_samples(df)
    assert s.first().memory_bytes == 1024
    r = stats.resource_summary(s).first()
    assert (r.mean_gap_s, r.cpu_mean, r.read_delta) == (2.0, 12.5, 2_000_000)
    assert measurements.last_rate(texts(spark, "tps = 1.5 x tps = 22.25 (x)")).first().tps == 22.25
    assert measurements.substantive_lines(texts(spark, "a", "", "# c", "// d", " b")).first().lines == 2


def test_bindings_and_counters(spark):
    b = {"subject": "s", "region": "Z", "trigger": "leaves", "fromState": "A", "toState": "B", "durationSeconds": 600, "states": ["A", "B"]}
    assert documents.bindings(texts(spark, b)).first().duration_us == 600_000_000
    with pytest.raises(Exception, match="malformed"):
        documents.bindings(texts(spark, {"subject": "s"})).collect()
    make = lambda n, t: spark.createDataFrame([("wal", n, t)], "k string, bytes long, reset string")
    assert stats.counter_difference(make(100, "x"), make(260, "y"), "k").collect() == [("wal", 160)]


def test_statistics(spark):
    levels = spark.createDataFrame([(t, p) for t, p in ((1, True), (2, True), (3, False), (4, True), (5, False))], "target int, passed boolean")
    assert [r.standing for r in stats.slo_prefix(levels).orderBy("target").collect()] == ["prefix", "prefix", "first failure", "later pass", "later failure"]
    runs = spark.createDataFrame([(1, 10.0, 999, 1, 0), (1, 25.0, 1000, 0, 0), (2, 10.0, 100, 0, 0)], "target int, p99_ms double, done long, skipped long, failed int")
    assert sorted(stats.slo_levels(runs, 20.0, 0.01).select("target", "passed").collect()) == [(1, False), (2, True)]
    s = stats.level_summary(spark.createDataFrame([(4, 100.0), (4, 120.0)], "clients int, tps double"), "tps", "clients").first()
    assert (s.mean, s.deviation) == (110.0, 10.0)
    assert stats.same_protocol(runs, "failed").first().homogeneous
    probes = spark.createDataFrame([("a", "pass"), ("a", "error"), ("a", "fail"), ("b", "pass"), ("c", "manual"), ("c", "pass")], "k string, status string")
    assert sorted((r.k, r.status) for r in stats.roll_up(probes, "k").collect()) == [("a", "error"), ("b", "pass"), ("c", "manual")]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "v int"), spark.createDataFrame([(1,), (3,)], "v int")
    assert [tuple(r) for r in stats.symmetric_difference(a, b)[1].collect()] == [(1, "left"), (2, "left"), (3, "right")]
    empty = spark.createDataFrame([], "effective_at timestamp, emitted_at timestamp")
    assert tuple(stats.lag_summary(empty).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_roles_stay_apart(spark):
    positions = spark.createDataFrame([("a", 1.0, 1.0, "u"), ("b", 2.0, 2.0, "u")], "subject string, x double, y double, crs string")
    schema = "subject string, seq int, observed_at timestamp, x double, y double, crs string, confidence double, accuracy_m double"
    none = spark.createDataFrame([], schema)
    new = spark.sql("select 'a' subject, 0 seq, timestamp'2026-01-01' observed_at, 5.0d x, 5.0d y, 'u' crs, 0.5d confidence, cast(null as double) accuracy_m")
    seen = world.record(none, new)
    assert seen.count() == 1 and world.unaccepted(seen, positions).count() == 1
    assert sorted(world.accept(positions, seen).collect()) == [("a", 5.0, 5.0, "u"), ("b", 2.0, 2.0, "u")]
    with pytest.raises(Exception, match="out of range"):
        world.record(none, new.withColumn("confidence", F.lit(2.0))).collect()
    good, bad = world.split_declared(positions, spark.createDataFrame([("a",)], "subject string"))
    assert (good.count(), bad.first().code) == (1, "unknown_subject")
    u = world.upsert(spark.createDataFrame([(1, "x", 1)], "k int, v string, version int"), spark.createDataFrame([(1, "y", 2), (2, "z", 1)], "k int, v string, version int"), "k", "version")
    assert sorted(u.collect()) == [(1, "y", 2), (2, "z", 1)]


def test_turtle_in_parts(spark, tmp_path):
    from tidefence.sources.documents import read_turtle
    from tidefence.sources.turtle import statements, turtle_triples

    head = "# a comment\n@prefix e: <http://e.test/> .\n"
    body = [f'e:s{i} a e:T{i % 3} ;\n  e:says "line\\nno {i} . \\"x\\"" , {i} ;\n  e:has [ e:of e:s{i + 1} ] .\n' for i in range(500)]
    (tmp_path / "a.ttl").write_text(head + "".join(body[:300]))
    (tmp_path / "b.ttl").write_text(head + "".join(body[300:]) + "\n")
    (tmp_path / "empty.ttl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = turtle_triples(spark, str(tmp_path))
        assert statements(spark, str(tmp_path)).rdd.getNumPartitions() > 6
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = read_turtle(head + "".join(body))
    plain = lambda ts: sorted((("_" if s[0] == "_" else s), p, ("_" if o[:2] == "_:" else o), d) for s, p, o, d in ts)
    assert plain(rows) == plain(want) and len({s for s, *_ in rows if s[0] == "_"}) == 500
    # each anonymous node hangs between the same two subjects as in the whole
    link = lambda ts: sorted((s, next(o2 for s2, p2, o2, _ in ts if s2 == o)) for s, p, o, _ in ts if o[:2] == "_:")
    assert link(rows) == link(want)


def test_turtle_prefixes_and_labels(spark, tmp_path):
    from tidefence.errors import ModelError
    from tidefence.sources.turtle import turtle_triples

    (tmp_path / "a.ttl").write_text("@prefix e: <http://e.test/> .\n_:x e:p _:y .\n_:y e:p _:x .\n")
    (tmp_path / "b.ttl").write_text("_:x e:p e:z .\n")
    rows = turtle_triples(spark, str(tmp_path)).collect()
    subjects = {r.s for r in rows if r.o == "http://e.test/z"} | {r.s for r in rows if r.o != "http://e.test/z"}
    assert len(rows) == 3 and len(subjects) == 3  # x of one file is not x of the other
    (tmp_path / "c.ttl").write_text("@prefix e: <http://other.test/> .\n")
    with pytest.raises(ModelError, match="two meanings"):
        turtle_triples(spark, str(tmp_path))
