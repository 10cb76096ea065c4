from datetime import datetime, timedelta

from tidefence.operators import machine as M
from tidefence.operators.regions import Region
from tidefence.streaming.monitors import monitor

Z = Region.closed("Z", ((0, 0), (10, 0), (10, 10), (0, 10)), "urn:u")
T0 = datetime(2026, 1, 1)
PROGRAM = M.Program(("Z",), (M.Rule("late", "leaves", "Z", "Safe", "AtRisk", 600_000_000),))
SCHEMA = "subject string, seq long, ts timestamp, x double, y double"


def rows(*items):
    return [(s, i, T0 + timedelta(minutes=m), float(x), 5.0) for i, (s, m, x) in enumerate(items)]


def run(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    q.stop()


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    data = rows(("a", 0, 5), ("b", 0, 5), ("a", 5, 12), ("b", 6, 12), ("b", 7, 5), ("a", 16, 13), ("b", 30, 5))
    for part in (data[:3], data[3:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(monitor(spark.readStream.schema(SCHEMA).parquet(source), [Z], PROGRAM, initial_state="Safe"), out, checkpoint)
    got = spark.read.parquet(out)
    want = M.run(spark.createDataFrame(data, SCHEMA), [Z], PROGRAM, initial_state="Safe").filter("entry <> 'final'")
    columns = ["subject", "entry", "kind", "region", "name", "started_us", "effective_us", "emitted_us", "from_state", "to_state"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.filter("kind = 'sustained leaves'").count() == 1


def test_late_moves_come_out_as_rejects(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in (rows(("a", 0, 5), ("a", 9, 12)), rows(("a", 3, 5))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(monitor(spark.readStream.schema(SCHEMA).parquet(source), [Z], PROGRAM, initial_state="Safe"), out, checkpoint)
    assert [r.kind for r in spark.read.parquet(out).filter("entry = 'reject'").collect()] == ["backwards_time"]


def test_stays_through_a_stream_with_a_restart(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from tidefence.operators.regions import Region
    from tidefence.streaming.monitors import late_moves, zone_stays

    zones = [Region.closed("A", [(0, 0), (10, 0), (10, 10), (0, 10)], "c"), Region.closed("B", [(5, 5), (20, 5), (20, 20), (5, 20)], "c")]
    at = lambda m: datetime(2025, 3, 4, tzinfo=timezone.utc) + timedelta(minutes=m)
    rows = [("s", at(0), 1.0, 1.0), ("s", at(20), 6.0, 6.0), ("s", at(45), 50.0, 1.0), ("s", at(55), 10.0, 10.0), ("t", at(5), 5.0, 5.0), ("s", at(300), 1.0, 1.0), ("t", at(400), 99.0, 99.0)]
    late = [("t", at(6), 5.0, 5.0)]
    schema = "subject string, ts timestamp, x double, y double"
    table = spark.createDataFrame(rows, schema)
    plain = lambda df: sorted((r.subject, r.region, r.start, r.end, r.n) for r in df.collect())
    batch = plain(zone_stays(table, zones, "30 minutes", "10 minutes"))
    assert [(s, z, n) for s, z, _, _, n in batch] == [("s", "A", 2), ("s", "A", 1), ("s", "A", 1), ("s", "B", 1), ("s", "B", 1), ("t", "A", 1), ("t", "B", 1)]
    source, dropped = f"{tmp_path}/in", 0
    for k, part in enumerate((rows[:5], rows[5:], late)):  # a new query for each part goes on from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = zone_stays(stream, zones, "30 minutes", "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        dropped += late_moves(q.recentProgress)
    got = plain(spark.read.parquet(f"{tmp_path}/out"))
    assert got == [r for r in batch if r[3] <= (at(390)).astimezone().replace(tzinfo=None)] and dropped >= 1
