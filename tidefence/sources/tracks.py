"""Trajectory CSV in the storm-track list layout: scan, classify, clean, and the normalised snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions.geometry import normal_longitude
from ..functions.text import polygon_wkt, short_number

REQUIRED = ("SID", "SEASON", "BASIN", "NAME", "ISO_TIME", "LAT", "LON", "TRACK_TYPE")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte order mark is tolerated; a missing column is an error."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ModelError(f"missing columns: {', '.join(missing)}")
    return raw.select(*REQUIRED).withColumn("file_row", F.monotonically_increasing_id())


def classify(raw: DataFrame) -> DataFrame:
    """Adds status: the first that fits of invalid (blank id), filtered (other track type), invalid (casts, latitude), valid."""
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in REQUIRED}
    ts = F.coalesce(F.try_to_timestamp(text["ISO_TIME"], F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text["ISO_TIME"]))
    parsed = raw.select(
        "file_row",
        text["SID"].alias("sid"),
        F.expr("try_cast(trim(SEASON) AS int)").alias("season"),
        text["BASIN"].alias("basin"),
        text["NAME"].alias("name"),
        ts.alias("ts"),
        F.expr("try_cast(trim(LAT) AS double)").alias("lat"),
        F.expr("try_cast(trim(LON) AS double)").alias("lon_raw"),
        text["TRACK_TYPE"].alias("track_type"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    casts = F.col("season").isNotNull() & F.col("ts").isNotNull() & finite("lat") & finite("lon_raw")
    status = (
        F.when(F.col("sid") == "", "invalid")
        .when(F.lower("track_type") != "main", "filtered")
        .when(~casts, "invalid")
        .when(~F.col("lat").between(-90.0, 90.0), "invalid")
        .otherwise("valid")
    )
    return parsed.withColumn("status", status).withColumn("lon", normal_longitude(F.col("lon_raw")))


def quality(classified: DataFrame) -> DataFrame:
    """One row of counters."""
    return classified.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "filtered", "invalid")])


def clean(classified: DataFrame, max_tracks: int | None = None) -> DataFrame:
    """sid, season, basin, name, ts, lat, lon, sample_index: exact repeats of a point removed, metadata of a track from its first
    valid row, samples in the order (ts, lon, lat)."""
    if max_tracks is not None and max_tracks <= 0:
        raise ModelError("max_tracks must be positive")
    valid = classified.filter("status = 'valid'")
    meta = valid.groupBy("sid").agg(F.min_by(F.struct("season", "basin", "name"), "file_row").alias("m"))
    if max_tracks is not None:
        meta = meta.orderBy("sid").limit(max_tracks)
    points = valid.select("sid", "ts", "lat", "lon").dropDuplicates()
    out = points.join(meta, "sid").select("sid", "m.season", "m.basin", "m.name", "ts", "lat", "lon")
    return out.withColumn("sample_index", F.row_number().over(Window.partitionBy("sid").orderBy("ts", "lon", "lat")) - 1)


def extent(tracks: DataFrame) -> DataFrame:
    """One row: first and last season, distinct tracks, the basins in order, first and last time, samples."""
    return tracks.agg(
        F.min("season").alias("first_season"), F.max("season").alias("last_season"), F.countDistinct("sid").alias("tracks"), F.sort_array(F.collect_set("basin")).alias("basins"),
        F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.count("*").alias("samples"),
    )


def as_moves(tracks: DataFrame, crs: str) -> DataFrame:
    """Tracks of at least two samples as moves; x is the longitude."""
    n = F.count("*").over(Window.partitionBy("sid"))
    return tracks.withColumn("n", n).filter("n >= 2").select(F.col("sid").alias("subject"), F.col("sample_index").cast("long").alias("seq"), "ts", F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(crs).alias("crs"))


def numbered(tracks: DataFrame, n: int) -> DataFrame:
    """The first n samples in the order (sid, sample_index), numbered from 1: a sort with a limit, then one small window."""
    first = tracks.orderBy("sid", "sample_index").limit(n)
    return first.withColumn("device", F.row_number().over(Window.orderBy("sid", "sample_index")))


def write_database_inputs(regions: DataFrame, tracks: DataFrame, path: str) -> None:
    """CSV folders regions (rank, name, WKT) and samples (sid, index, time, longitude, latitude) for loading elsewhere."""
    regions.select("rank", "name", polygon_wkt(F.col("shell")).alias("wkt")).write.mode("overwrite").csv(f"{path}/regions")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tracks.select("sid", "sample_index", time.alias("ts"), short_number(F.col("lon"), 15).alias("lon"), short_number(F.col("lat"), 15).alias("lat")).write.mode("overwrite").csv(f"{path}/samples")


def write_snapshot(tracks: DataFrame, path: str) -> None:
    """The normalised CSV in the order (sid, ts): coordinates with ten digits, times in UTC. One file, so meant for snapshots."""
    number = lambda c: short_number(F.col(c), 10)
    out = tracks.orderBy("sid", "ts", "sample_index").coalesce(1).select(
        F.col("sid").alias("SID"), F.col("season").alias("SEASON"), F.col("basin").alias("BASIN"), F.col("name").alias("NAME"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), number("lat").alias("LAT"), number("lon").alias("LON"), F.lit("main").alias("TRACK_TYPE"),
    )
    out.write.mode("overwrite").csv(path, header=True)


def source_label(name: str) -> str:
    """Which release of a track file a file name points to."""
    low = name.lower()
    for mark, label in (("last3years", "last three years"), ("since1980", "since 1980"), ("all", "all years")):
        if mark in low:
            return label
    return "local file"
