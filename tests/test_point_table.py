import math

import pytest
from pyspark.sql import functions as F

from tidefence.sources import point_table as P

SCHEMA = "sid string, nth int, x double, y double, note string"


def rows(df):
    xy = P.ordinates("geometry")
    got = df.select("sid", "nth", "note", "load_number", xy["x"].alias("gx"), xy["y"].alias("gy")).collect()
    return sorted((r.sid or "", r.nth, r.note, r.load_number, r.gx, r.gy) for r in got)


def test_loads_replace_by_name_and_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 0, 1.5, -2.0, "p"), ("a", 1, None, 4.0, "q"), ("b", 0, 1e-300, 7.25, None), (None, 0, 1.0, 1.0, "n")], SCHEMA).repartition(3)
    fix = spark.createDataFrame([("a", 0, 9.0, 9.0, "fixed"), ("a", 0, 9.0, 9.0, "fixed")], SCHEMA)
    P.load(first, path, "first")
    P.load(fix, path, "fix")
    want = [("a", 0, "fixed", 1, 9.0, 9.0), ("a", 1, "q", 0, None, None), ("b", 0, None, 0, 1e-300, 7.25)]
    assert rows(P.current(spark, path, "sid", "nth")) == want
    P.load(first, path, "first")  # again: its place is kept, so the later load still counts
    assert rows(P.current(spark, path, "sid", "nth")) == want and P.loaded(spark, path).count() == 6
    assert P.vacuum(path) >= 1 and rows(P.current(spark, path, "sid", "nth")) == want
    P.load(fix.filter("false"), path, "fix")
    assert [r[3] for r in rows(P.current(spark, path, "sid", "nth"))] == [0, 0, 0]


def test_a_failed_load_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", k, float(k), 0.0, "p") for k in range(40)], SCHEMA)
    P.load(good, path, "first")
    before = rows(P.loaded(spark, path))
    broken = good.repartition(4).withColumn("x", F.when(F.col("nth") == 39, float("nan")).otherwise(F.col("x") + 1))
    with pytest.raises(Exception, match="finite x"):
        P.load(broken, path, "second")
    assert rows(P.loaded(spark, path)) == before and len(P.manifest(path)["loads"]) == 1
    for other, word in ((good.drop("note"), "differ"), (good.withColumnRenamed("note", "geometry"), "geometry")):
        with pytest.raises(Exception, match=word):
            P.load(other, path, "third")
    stale = P._Writer({"path": path, "load": "slow"}, good.schema)  # another load comes in between
    P.load(good, path, "second")
    with pytest.raises(RuntimeError, match="another load"):
        stale.commit([P.Written([])])
    assert P.loaded(spark, path).count() == 80


def test_nothing_loaded_and_empty_loads(spark, tmp_path):
    with pytest.raises(Exception, match="nothing was loaded"):
        P.loaded(spark, str(tmp_path / "t")).count()
    P.load(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), "none")
    assert P.current(spark, str(tmp_path / "t"), "sid").count() == 0


def test_binaries_hold_every_bit():
    import pyarrow as pa

    values = [0.0, -0.0, math.pi, 5e-324, -1.7976931348623157e308, None]
    made = P.binaries(pa.array(values, pa.float64()), pa.array([1.0] * 6))
    assert made[5].as_py() is None and made[2].as_py().hex() == "0101000000182d4454fb210940000000000000f03f"
    assert [str(P.np.frombuffer(made[k].as_py(), P.POINT)["x"][0]) for k in range(5)] == [str(v) for v in values[:5]]
