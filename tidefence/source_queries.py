"""Registered queries of sources, texts, geometry functions, world tables and summaries, each with the SQL it is held against.

Sources are fed with documents that are built from the supplied tables, so every row of a table passes through a parser.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geosparql as S
from .functions import planar as P
from .functions import text as T
from .operators import events as E
from .operators import stats, world
from .operators.regions import region_table
from .queries import _CROSSINGS, _MEMBERS, _MOVES, _SUSTAINED, _SUSTAINED_COLUMNS, CRS, DURATIONS, ZONES, events, moves, query
from .sources import documents, measurements, point_table, tracks
from .streaming.sinks import shared_folder

# -- numbers and texts ----------------------------------------------------------------------------------


@query("SELECT event_id AS seq, " + ", ".join(f"printf('%.{d}g', value / 7) AS g{d}" for d in (1, 6, 10, 15, 17)) + " FROM events")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full mantissas at all precisions in use."""
    v = F.col("value") / 7
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), *[T.short_number(v, d).alias(f"g{d}") for d in (1, 6, 10, 15, 17)])


@query(
    """SELECT event_id AS seq, url_encode(props || ' ~*+/é') AS part, CAST(to_json(props || chr(10) || 'é\\') AS VARCHAR) AS literal,
regexp_extract('http://e.test/a#' || event_type || '/' || user_id, '[^/]+$') AS local, CASE WHEN user_id < 1000 THEN lpad(CAST(user_id AS VARCHAR), 4, '0') ELSE CAST(user_id AS VARCHAR) END AS padded,
CAST(round_even(value * CASE event_type WHEN 'click' THEN 1e3 WHEN 'view' THEN 1e6 WHEN 'error' THEN 6e7 ELSE 3.6e9 END, 0) AS BIGINT) AS duration_us FROM events"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRI parts, JSON literals, local names, padded indices and durations."""
    p, kind = F.col("props"), F.col("event_type")
    unit = F.when(kind == "click", "ms").when(kind == "view", "s").when(kind == "error", "min").otherwise("h")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        T.iri_part(F.concat(p, F.lit(" ~*+/é"))).alias("part"),
        T.json_string(F.concat(p, F.lit("\né\\"))).alias("literal"),
        T.iri_local_name(F.concat(F.lit("http://e.test/a#"), kind, F.lit("/"), F.col("user_id"))).alias("local"),
        T.padded(F.col("user_id")).alias("padded"),
        T.duration_us(F.col("value"), unit).alias("duration_us"),
    )


# -- sources --------------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    us = F.when(kind == "error", "deadlock").otherwise(F.round(F.col("value") * 1000).cast("long").cast("string"))
    tail = F.when(F.col("user_id") % 2 == 0, F.concat_ws(" ", F.get_json_object("props", "$.k"), F.col("event_id") % 3)).otherwise((F.col("event_id") % 3).cast("string"))
    line = F.concat_ws(" ", "user_id", "event_id", us, F.length(kind), F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0), tail)
    return measurements.log_lines(events(spark, sf_dir).select(line.alias("value")))


@query(
    """WITH l AS (SELECT length(event_type) AS script, CASE WHEN event_type <> 'error' THEN CAST(round(value * 1000) AS BIGINT) / 1000.0 END AS ms,
  CASE WHEN user_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) / 1000.0 END AS lag, event_id % 3 AS retries FROM events)
SELECT script, count(ms) AS transactions, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms,
  max(ms) AS max_ms, round(quantile_cont(lag, 0.99), 6) AS lag_p99_ms, CAST(sum(retries) AS BIGINT) AS retries, count(*) - count(ms) AS failures FROM l GROUP BY script"""
)
def load_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a load generator's log line, with seven or eight fields."""
    s = measurements.log_summary(_log(spark, sf_dir), "script")
    return s.select("script", "transactions", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")], "max_ms", F.round("lag_p99_ms", 6).alias("lag_p99_ms"), "retries", "failures")


@query("SELECT CAST(user_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS seq, date_trunc('millisecond', ts) AS ts, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type IS NOT NULL AS known FROM events")
def moving_feature_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON feature for every user, parsed back to moves."""
    m = moves(spark, sf_dir).withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    per = m.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("ts", "t", "x", "y"))).alias("p"))
    track = F.struct(F.lit("MovingPoint").alias("type"), F.transform("p", lambda q: q["t"]).alias("datetimes"), F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates"), F.lit("Step").alias("interpolation"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("subject").cast("string").alias("id"), track.alias("temporalGeometry"), F.struct(F.lit("Safe").alias("initialState")).alias("properties"))
    out = documents.moving_features(per.select(F.to_json(feature).alias("value")))
    return out.select("subject", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "x", "y", F.col("initial_state").isNotNull().alias("known"))


@query(f"WITH {_MEMBERS} SELECT CAST(seq AS VARCHAR) AS subject, region, strict AS inside, covered AS \"coveredBy\", NOT covered AS disjoint, on_boundary AS \"onBoundary\" FROM members")
def query_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result document for every move, with a binding for each zone, parsed back."""
    m = moves(spark, sf_dir)
    value = lambda c: F.struct(c.cast("string").alias("value"))
    iri = lambda kind, c: F.concat(F.lit(f"https://e.test/{kind}/"), T.iri_part(c.cast("string")))

    def binding(r: Column) -> Column:
        edge, covered = r["on_boundary"], r["on_boundary"] | r["odd"]
        return F.struct(value(F.col("subject")).alias("subject"), value(iri("region", r["region"])).alias("region"), value(~edge & r["odd"]).alias("inside"), value(covered).alias("coveredBy"), value(~covered).alias("disjoint"), value(edge).alias("onBoundary"))

    m = m.select(iri("instance", F.col("seq")).alias("subject"), E.relations(m, ZONES).alias("r"))
    docs = m.select(F.array(*[binding(F.get("r", F.lit(i))) for i in range(len(ZONES))]).alias("b"))
    return documents.sparql_results(docs.select(F.to_json(F.struct(F.struct(F.col("b").alias("bindings")).alias("results"))).alias("value")))


def _track_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a track file in the shared folder: errors have no season, clicks another type, and half of the longitudes pass the seam."""
    kind = F.col("event_type")
    e = events(spark, sf_dir).select(
        F.concat(F.lit("T"), F.col("user_id")).alias("SID"),
        F.when(kind == "error", "soon").otherwise(F.concat(F.lit("20"), F.lpad((F.col("user_id") % 30).cast("string"), 2, "0"))).alias("SEASON"),
        F.concat(F.lit("B"), F.col("user_id") % 4).alias("BASIN"),
        F.lit("N").alias("NAME"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"),
        F.get_json_object("props", "$.k").alias("LAT"),
        (F.col("user_id") % 2 * 170 + F.pmod("event_id", F.lit(40))).cast("double").cast("string").alias("LON"),
        F.when(kind == "click", "spur").otherwise("Main").alias("TRACK_TYPE"),
    )
    path = f"{shared_folder(spark)}/tracks-{uuid.uuid4().hex}"
    e.write.csv(path, header=True)
    return tracks.classify(tracks.scan(spark, path))


_TRACKS = """raw AS (SELECT 'T' || user_id AS sid, event_type AS kind, 2000 + user_id % 30 AS season, 'B' || (user_id % 4) AS basin, date_trunc('second', ts) AS ts,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lat, user_id % 2 * 170 + event_id % 40 AS raw_lon FROM events),
rows AS (SELECT *, CASE WHEN kind = 'click' THEN 'filtered' WHEN kind = 'error' OR lat > 90 OR lat < -90 THEN 'invalid' ELSE 'valid' END AS status,
  CAST(CASE WHEN raw_lon > 180 THEN raw_lon - 360 ELSE raw_lon END AS DOUBLE) AS lon FROM raw),
clean AS (SELECT DISTINCT sid, CAST(season AS INT) AS season, basin, ts, lat, lon FROM rows WHERE status = 'valid')"""


@query(f"WITH {_TRACKS} SELECT count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'invalid') AS invalid FROM rows")
def track_file_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.quality(_track_file(spark, sf_dir))


@query(f"WITH {_TRACKS} SELECT sid, season, basin, ts, lat, lon, row_number() OVER (PARTITION BY sid ORDER BY ts, lon, lat) - 1 AS sample_index FROM clean")
def track_file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, cast, normalised, without repeats, in order."""
    t = tracks.clean(_track_file(spark, sf_dir))
    return t.select("sid", "season", "basin", F.col("ts").cast("timestamp_ntz").alias("ts"), "lat", "lon", F.col("sample_index").cast("long").alias("sample_index"))


@query(
    f"""WITH {_TRACKS} SELECT CAST(min(season) AS INT) AS first_season, CAST(max(season) AS INT) AS last_season, count(DISTINCT sid) AS tracks, string_agg(DISTINCT basin, ',' ORDER BY basin) AS basins,
min(ts) AS first_time, max(ts) AS last_time, count(*) AS samples FROM clean"""
)
def track_file_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = tracks.extent(tracks.clean(_track_file(spark, sf_dir)))
    return x.select("first_season", "last_season", "tracks", F.array_join("basins", ",").alias("basins"), F.col("first_time").cast("timestamp_ntz").alias("first_time"), F.col("last_time").cast("timestamp_ntz").alias("last_time"), "samples")


@query(
    f"""WITH {_TRACKS}, lagged AS (SELECT sid, basin, abs(lon - lag(lon) OVER (PARTITION BY sid ORDER BY ts, lon, lat)) AS jump FROM clean)
SELECT basin, count(*) AS jumps, count(DISTINCT sid) AS subjects, max(jump) AS largest FROM lagged WHERE jump > 180 GROUP BY basin"""
)
def track_file_seam_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dateline audit by basin."""
    t = tracks.clean(_track_file(spark, sf_dir)).select(F.col("sid").alias("subject"), "basin", "ts", F.col("sample_index").alias("seq"), F.col("lon").alias("x"))
    return stats.jump_audit(t, 180.0, group="basin")


@query(f"WITH {_TRACKS}, k AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY ts, lon, lat) - 1 AS i FROM clean) SELECT row_number() OVER (ORDER BY sid, i) AS device, sid, i AS sample_index FROM k ORDER BY sid, i LIMIT 500")
def numbered_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 samples in order, numbered: the limit is the feature."""
    d = tracks.numbered(tracks.clean(_track_file(spark, sf_dir)), 500)
    return d.select(F.col("device").cast("long").alias("device"), "sid", F.col("sample_index").cast("long").alias("sample_index"))


@query(
    """WITH ids AS (SELECT DISTINCT 'http://t.test/req/' || user_id AS id, CAST(user_id AS VARCHAR) AS local FROM events), reg AS (SELECT DISTINCT 'http://r.test/' || event_type || '#' || user_id AS iri, CAST(user_id AS VARCHAR) AS local FROM events WHERE event_type IN ('click', 'error'))
SELECT id, local, CASE count(iri) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'corroborated' ELSE 'ambiguous' END AS status FROM ids LEFT JOIN reg USING (local) GROUP BY id, local"""
)
def register_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids against a register by local name."""
    e = events(spark, sf_dir)
    ids = e.select(F.concat(F.lit("http://t.test/req/"), "user_id").alias("id")).distinct()
    register = e.filter(F.col("event_type").isin("click", "error")).select(F.concat(F.lit("http://r.test/"), "event_type", F.lit("#"), "user_id").alias("iri")).distinct()
    return documents.match_register(ids, register)


# -- geometry functions on a grid of rectangles ----------------------------------------------------------
# Every event falls into a cell; all distinct cells are compared with one fixed rectangle, whose sides are grid lines or lie between them.

_FIXED = (50, 20, 100, 60)
_CELLS = """cells AS (SELECT DISTINCT x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (SELECT CAST(floor(value / 25) * 25 AS INT) AS x0, CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 20) * 20 AS INT) AS y0,
  CASE WHEN user_id % 2 = 0 THEN 25 ELSE 50 END AS w, CASE WHEN user_id % 3 = 0 THEN 40 ELSE 20 END AS h FROM events))"""


def _rectangle(*corners: Column) -> Column:
    x0, y0, x1, y1 = corners
    at = lambda x, y: F.concat_ws(" ", x, y)
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)), F.lit("))"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = events(spark, sf_dir).select((F.floor(F.col("value") / 25) * 25).cast("int").alias("x0"), (F.floor(k / 20) * 20).cast("int").alias("y0"), F.when(F.col("user_id") % 2 == 0, 25).otherwise(50).alias("w"), F.when(F.col("user_id") % 3 == 0, 40).otherwise(20).alias("h"))
    c = e.select("x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")).distinct()
    fixed = _rectangle(*map(F.lit, _FIXED))
    return c.select("*", _rectangle(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("a"), fixed.alias("b"))


_FX0, _FY0, _FX1, _FY1 = _FIXED
_REL = f"""r AS (SELECT *, x1 < {_FX0} OR x0 > {_FX1} OR y1 < {_FY0} OR y0 > {_FY1} AS away, x1 > {_FX0} AND x0 < {_FX1} AND y1 > {_FY0} AND y0 < {_FY1} AS deep,
  x0 = {_FX0} AND x1 = {_FX1} AND y0 = {_FY0} AND y1 = {_FY1} AS same, x0 >= {_FX0} AND x1 <= {_FX1} AND y0 >= {_FY0} AND y1 <= {_FY1} AS in_b, x0 <= {_FX0} AND x1 >= {_FX1} AND y0 <= {_FY0} AND y1 >= {_FY1} AS has_b,
  x0 > {_FX0} AND x1 < {_FX1} AND y0 > {_FY0} AND y1 < {_FY1} AS well_in, x0 < {_FX0} AND x1 > {_FX1} AND y0 < {_FY0} AND y1 > {_FY1} AS well_has FROM cells)"""
#: Each relation of two rectangles in terms of the flags above.
_RELATIONS = {
    "sfEquals": "same", "sfDisjoint": "away", "sfIntersects": "NOT away", "sfTouches": "NOT away AND NOT deep", "sfCrosses": "FALSE", "sfWithin": "in_b", "sfContains": "has_b", "sfOverlaps": "deep AND NOT in_b AND NOT has_b",
    "ehEquals": "same", "ehDisjoint": "away", "ehMeet": "NOT away AND NOT deep", "ehOverlap": "deep AND NOT in_b AND NOT has_b", "ehCovers": "has_b AND NOT same AND NOT well_has", "ehCoveredBy": "in_b AND NOT same AND NOT well_in", "ehInside": "well_in", "ehContains": "well_has",
    "rcc8eq": "same", "rcc8dc": "away", "rcc8ec": "NOT away AND NOT deep", "rcc8po": "deep AND NOT in_b AND NOT has_b", "rcc8tppi": "has_b AND NOT same AND NOT well_has", "rcc8tpp": "in_b AND NOT same AND NOT well_in", "rcc8ntpp": "well_in", "rcc8ntppi": "well_has",
}


@query(f"WITH {_CELLS}, {_REL} SELECT x0, y0, x1, y1, " + ", ".join(f"{sql} AS {name}" for name, sql in _RELATIONS.items()) + " FROM r")
def rectangle_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 topological relations."""
    return _cells(spark, sf_dir).select("x0", "y0", "x1", "y1", *[S.call(name, "a", "b").alias(name) for name in _RELATIONS])


@query(
    f"""WITH {_CELLS}, {_REL} SELECT x0, y0, x1, y1, deep AND NOT in_b AND NOT has_b AS overlap_pattern, NOT away AS meets_pattern, 'POLYGON' AS base, 2 AS "coordinateDimension", 2 AS "spatialDimension", 2 AS dimension,
'http://www.opengis.net/ont/sf#Polygon' AS "geometryType", FALSE AS "is3D", FALSE AS "isMeasured", FALSE AS "isEmpty", TRUE AS "isSimple", 'http://www.opengis.net/def/crs/OGC/1.3/CRS84' AS "getSRID", 1 AS "numGeometries",
CAST(x0 AS DOUBLE) AS "minX", CAST(x1 AS DOUBLE) AS "maxX", CAST(y0 AS DOUBLE) AS "minY", CAST(y1 AS DOUBLE) AS "maxY", CAST(NULL AS DOUBLE) AS "minZ", CAST(NULL AS DOUBLE) AS "maxZ",
CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS perimeter, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area,
round(sqrt(greatest({_FX0} - x1, x0 - {_FX1}, 0) ** 2 + greatest({_FY0} - y1, y0 - {_FY1}, 0) ** 2), 6) AS distance FROM r"""
)
def rectangle_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors, measures, and relation by pattern."""
    one = ("coordinateDimension", "spatialDimension", "dimension", "geometryType", "is3D", "isMeasured", "isEmpty", "isSimple", "getSRID", "numGeometries", "minX", "maxX", "minY", "maxY", "minZ", "maxZ", "perimeter", "area")
    c = _cells(spark, sf_dir)
    meets = ~S.relate("a", "b", "FF*FF****")
    return c.select("x0", "y0", "x1", "y1", S.relate("a", "b", "T*T***T**").alias("overlap_pattern"), meets.alias("meets_pattern"), F.regexp_extract(S.call("asWKT", "a"), "([A-Z]+) ?\\(", 1).alias("base"), *[S.call(n, "a").alias(n) for n in one], F.round(S.call("distance", "a", "b"), 6).alias("distance"))


@query(
    f"""WITH {_CELLS}, {_REL}, s AS (SELECT *, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS a, CAST(CASE WHEN deep THEN (least(x1, {_FX1}) - greatest(x0, {_FX0})) * (least(y1, {_FY1}) - greatest(y0, {_FY0})) ELSE 0 END AS DOUBLE) AS i FROM r)
SELECT x0, y0, x1, y1, i AS intersection, a + {(_FX1 - _FX0) * (_FY1 - _FY0)} - i AS "union", a - i AS difference, a + {(_FX1 - _FX0) * (_FY1 - _FY0)} - 2 * i AS "symDifference",
(x0 + x1) / 2.0::DOUBLE AS centre_x, (y0 + y1) / 2.0::DOUBLE AS centre_y, a AS hull, a AS envelope, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS boundary FROM s"""
)
def rectangle_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of overlays, hulls and envelopes, centroids, lengths of boundaries."""
    c = _cells(spark, sf_dir)
    area = lambda g: S.call("area", g)
    centre = S.call("centroid", "a")
    return c.select("x0", "y0", "x1", "y1", *[area(S.call(n, "a", "b")).alias(n) for n in P.OVERLAYS], S.call("minX", centre).alias("centre_x"), S.call("minY", centre).alias("centre_y"), area(S.call("convexHull", "a")).alias("hull"), area(S.call("envelope", "a")).alias("envelope"), S.call("length", S.call("boundary", "a")).alias("boundary"))


@query(f"""WITH {_CELLS} SELECT y0, CAST(min(x0) AS DOUBLE) AS min_x, CAST(max(x1) AS DOUBLE) AS max_x, CAST(max(y1) AS DOUBLE) AS max_y, CAST((max(x1) - min(x0)) * (max(y1) - min(y0)) AS DOUBLE) AS box FROM cells GROUP BY y0""")
def rectangle_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes and hulls of groups."""
    c = _cells(spark, sf_dir)
    box, hull = S.agg_bounding_box(c, ["y0"], "a").withColumnRenamed("geometry", "box"), S.agg_convex_hull(c, ["y0"], "a").withColumnRenamed("geometry", "hull")
    j = box.join(hull, "y0")
    return j.select("y0", S.call("minX", "hull").alias("min_x"), S.call("maxX", "hull").alias("max_x"), S.call("maxY", "hull").alias("max_y"), S.call("area", "box").alias("box"))


# -- events, world, summaries -----------------------------------------------------------------------------


@query(f"WITH {_SUSTAINED} SELECT {', '.join(c for c in _SUSTAINED_COLUMNS)} FROM sustained")
def sustained_from_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layers of events from positive membership rows only."""
    m = moves(spark, sf_dir)
    positive = E.membership(m, ZONES).filter("covered").select("subject", "seq", "region")
    names = region_table(spark, ZONES).select(F.col("name").alias("region"), "rank")
    crossed = E.crossings_of_memberships(m.select("subject", "seq", "ts"), positive, names)
    return E.sustained_of_crossings(crossed, m, DURATIONS).select(*_SUSTAINED_COLUMNS)


@query(
    f"""WITH {_MEMBERS}, last AS (SELECT subject, seq, x, y FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC) AS n FROM moves) WHERE n = 1),
here AS (SELECT m.* FROM members m JOIN last USING (subject, seq))
SELECT subject, 'inside' AS kind, region, CAST(strict AS VARCHAR) AS answer FROM here WHERE region = 'Tri' UNION ALL SELECT subject, 'coveredBy', region, CAST(covered AS VARCHAR) FROM here WHERE region = 'BandMid'
UNION ALL SELECT subject, 'state', NULL, CASE WHEN subject % 2 = 0 THEN 'Safe' ELSE 'Busy' END FROM last UNION ALL SELECT subject, 'value', NULL, 'v' || subject FROM last"""
)
def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of questions about every subject."""
    p = world.latest_assertions(moves(spark, sf_dir))
    s = p.select("subject", F.when(F.col("subject") % 2 == 0, "Safe").otherwise("Busy").alias("state"))
    v = p.select(F.col("subject").alias("instance"), F.lit("mark").alias("member"), F.concat(F.lit("v"), "subject").alias("text"))
    kinds = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), F.lit(r).cast("string").alias("region"), F.lit(m).cast("string").alias("member")) for i, (k, r, m) in enumerate([("inside", "Tri", None), ("coveredBy", "BandMid", None), ("state", None, None), ("value", None, "mark")])])
    q = p.select("subject", F.inline(kinds))
    return world.answers(q, p, s, region_table(spark, ZONES), v).select("subject", "kind", "region", "answer")


@query(f"WITH {_MOVES} SELECT subject, arg_max(x, (ts, seq)) AS x, arg_max(y, (ts, seq)) AS y, 'u' AS crs FROM moves GROUP BY subject UNION ALL SELECT -1, 1.0, 2.0, 'u'")
def accepted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is recorded, then accepted as positions; a subject without evidence keeps its own."""
    m = moves(spark, sf_dir)
    old = m.select("subject").distinct().union(spark.range(1).select((F.col("id") - 1).alias("subject"))).select("subject", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit("u").alias("crs"))
    new = m.select("subject", F.col("ts").alias("observed_at"), "seq", "x", "y", F.lit("u").alias("crs"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("accuracy_m"))
    return world.accept(old, world.record(new.filter("false"), new))


@query(f"WITH {_MOVES}, d AS (SELECT DISTINCT user_id AS subject FROM events WHERE event_type = 'error' AND value > 60) SELECT subject, seq, 'unknown_subject' AS code FROM moves WHERE subject NOT IN (SELECT subject FROM d) UNION ALL SELECT subject, seq, 'known' FROM moves WHERE subject IN (SELECT subject FROM d)")
def declared_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with a large error are declared; moves of all others are rejects."""
    known = events(spark, sf_dir).filter("event_type = 'error' and value > 60").select(F.col("user_id").alias("subject"))
    good, bad = world.split_declared(moves(spark, sf_dir), known)
    return bad.select("subject", "seq", "code").unionByName(good.select("subject", "seq", F.lit("known").alias("code")))


@query("SELECT user_id, CASE WHEN max(event_id) >= 0 THEN arg_max(value, event_id) END AS value, max(event_id) AS version FROM events GROUP BY user_id")
def keyed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an update of its user's row."""
    e = events(spark, sf_dir).select("user_id", "value", F.col("event_id").alias("version"))
    start = e.select("user_id", F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("version")).distinct()
    return world.upsert(start, e, "user_id", "version")


@query("WITH h AS (SELECT event_type, count(*) FILTER (hour(ts) < 12) AS a, count(*) AS b, sum(user_id) FILTER (hour(ts) < 12) AS ua, sum(user_id) AS ub FROM events GROUP BY event_type) SELECT event_type, b - a AS n, CAST(ub - ua AS BIGINT) AS users FROM h")
def counter_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After minus before of every numeric counter; texts are left out."""
    count = lambda e: e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.lit("x").alias("note"))
    e = events(spark, sf_dir)
    return stats.counter_difference(count(e.filter(F.hour("ts") < 12)), count(e), "event_type")


@query(
    """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS cpu, CAST(json_extract_string(props, '$.k') AS BIGINT) AS memory, event_id AS read FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM s)
SELECT user_id, count(*) AS samples, round(avg(gap), 3) AS mean_gap_s, round(avg(cpu), 6) AS cpu_mean, quantile_disc(cpu, 0.95) AS cpu_p95, max(cpu) AS cpu_max, max(memory) AS memory_max, greatest(0, arg_max(read, t) - arg_min(read, t)) AS read_delta FROM g GROUP BY user_id"""
)
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("elapsed_s"), F.col("value").alias("cpu_percent"), F.get_json_object("props", "$.k").cast("long").alias("memory_bytes"), F.col("event_id").alias("read_bytes"))
    r = stats.resource_summary(s, "user_id")
    return r.withColumn("mean_gap_s", F.round("mean_gap_s", 3)).withColumn("cpu_mean", F.round("cpu_mean", 6))


@query("SELECT count(DISTINCT (event_type, user_id % 3)) AS protocols, count(DISTINCT (event_type, user_id % 3)) = 1 AS homogeneous FROM events")
def protocol_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("third", F.col("user_id") % 3)
    return stats.same_protocol(e, "event_type", "third")


@query(
    f"""WITH {_CROSSINGS} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, region, kind, count(*) AS n FROM crossings GROUP BY ALL"""
)
def crossings_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings per tumbling window, region and kind, through the stream operator."""
    from .streaming.monitors import windowed_crossings

    w = windowed_crossings(E.crossings(moves(spark, sf_dir), ZONES), "6 hours", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "region", "kind", "n")


@query(
    f"""WITH {_MEMBERS}, e AS (SELECT DISTINCT region FROM edges), w AS (SELECT region, 'POLYGON ((' || string_agg(CAST(CAST(x1 AS INT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS INT) AS VARCHAR), ', ' ORDER BY n) || ', ' || min(CAST(CAST(x1 AS INT) AS VARCHAR) || ' ' || CAST(CAST(y1 AS INT) AS VARCHAR)) FILTER (n = least_n) || '))' AS wkt
FROM (SELECT *, min(n) OVER (PARTITION BY region) AS least_n FROM (SELECT *, row_number() OVER () AS n FROM edges)) GROUP BY region) SELECT e.region, wkt FROM e JOIN w USING (region)"""
)
def zone_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons as WKT."""
    return region_table(spark, ZONES).select(F.col("name").alias("region"), T.polygon_wkt(F.col("shell")).alias("wkt"))


@query(f"WITH {_MEMBERS} SELECT seq, region, strict AS within, covered AS intersects, on_boundary AS touches, NOT covered AS disjoint FROM members")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations as SQL functions over WKT texts."""
    from .functions import wkt as W

    W.register(spark)
    p = moves(spark, sf_dir).select("seq", T.point_wkt(F.col("x"), F.col("y"), F.lit(CRS)).alias("p"))
    zones = [F.struct(F.lit(z.name).alias("region"), F.lit(f"<{CRS}> POLYGON ((" + ", ".join(f"{x:g} {y:g}" for x, y in z.shell) + "))").alias("z")) for z in ZONES]
    pairs = p.select("seq", "p", F.inline(F.array(*zones)))
    return pairs.selectExpr("seq", "region", "sf_within(p, z) AS within", "sf_intersects(p, z) AS intersects", "sf_touches(p, z) AS touches", "sf_disjoint(p, z) AS disjoint")


@query(
    f"""WITH {_MOVES}, loads AS (
  SELECT subject, seq, x, y, 0 AS load_number FROM moves UNION ALL SELECT subject, seq, -x, y + 0.5, 1 FROM moves JOIN events ON seq = event_id WHERE event_type = 'error'
)
SELECT subject, seq, max_by(x, load_number) AS x, max_by(y, load_number) AS y, max(load_number) AS load_number FROM loads GROUP BY subject, seq"""
)
def loaded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All moves loaded in bulk, those of errors corrected by a second load, the first load repeated; points are read back from the binaries of the newest rows."""
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    m = moves(spark, sf_dir).select("subject", "seq", "x", "y")
    wrong = events(spark, sf_dir).filter("event_type = 'error'").select(F.col("event_id").alias("seq"))
    fixed = m.join(wrong, "seq").select("subject", "seq", (-F.col("x")).alias("x"), (F.col("y") + 0.5).alias("y"))
    for rows, name in ((m, "moves"), (fixed, "corrections"), (m, "moves")):
        point_table.load(rows, path, name)
    xy = point_table.ordinates("geometry")
    return point_table.current(spark, path, "subject", "seq").select("subject", "seq", "load_number", xy.alias("p")).select("subject", "seq", "p.x", "p.y", "load_number")
