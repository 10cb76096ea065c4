"""Registered queries of the event engine over the supplied tables, each with the SQL it is held against.

``events`` gives moves: subject = user_id, seq = event_id, x = value, y = props.k. Five fixed zones cover that space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import text as T
from .operators import events as E
from .operators import machine as M
from .operators import corpus, policies, stats, world
from .operators.regions import Region, region_table

CRS = "urn:local:event-space"
ZONES = [
    Region.closed(name, corners, CRS, rank)
    for rank, (name, corners) in enumerate(
        [
            ("BandLow", [(0, 0), (1000, 0), (1000, 30), (0, 30)]),
            ("BandMid", [(0, 30), (1000, 30), (1000, 70), (0, 70)]),
            ("Notch", [(0, 0), (60, 0), (60, 60), (40, 60), (40, 20), (20, 20), (20, 60), (0, 60)]),
            ("Tri", [(0, 0), (80, 0), (30, 60)]),
            ("HighValue", [(50, 0), (1000, 0), (1000, 100), (50, 100)]),
        ]
    )
]
HOUR = 3_600_000_000
DURATIONS = {"6h": 6 * HOUR, "12h": 12 * HOUR, "24h": 24 * HOUR}
WINDOW = (10.0, 20.0, 60.0, 50.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.get_json_object("props", "$.k").cast("double")
    return events(spark, sf_dir).select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("x"), y.alias("y"))


# -- SQL building blocks ------------------------------------------------------------------------------

_EDGES = ", ".join(f"('{z.name}', {z.rank}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for z in ZONES for a, b in zip(z.shell, z.shell[1:], strict=False))
_MOVES = "moves AS (SELECT user_id AS subject, event_id AS seq, ts, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events)"
_MEMBERS = f"""{_MOVES},
edges(region, rank, x1, y1, x2, y2) AS (VALUES {_EDGES}),
tested AS (
  SELECT subject, seq, ts, x, y, region, rank,
    bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_boundary,
    sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS odd
  FROM moves, edges GROUP BY ALL
),
members AS (SELECT subject, seq, ts, x, y, region, rank, on_boundary, on_boundary OR odd AS covered, odd AND NOT on_boundary AS strict FROM tested)"""
_CROSSINGS = f"""{_MEMBERS},
lagged AS (
  SELECT *, lag(covered) OVER w AS prev, row_number() OVER w - 1 AS step FROM members WINDOW w AS (PARTITION BY subject, region ORDER BY ts, seq)
),
crossings AS (
  SELECT subject, seq, ts, step, region, rank, CASE WHEN covered THEN 'enters' ELSE 'leaves' END AS kind
  FROM lagged WHERE prev IS NOT NULL AND prev <> covered
)"""


def _sustained_sql(clock: str) -> str:
    tick = "m.subject = h.subject AND m.ts >= h.effective_at" if clock == "subject" else "m.ts >= h.effective_at"
    if clock == "subject":
        emitted = f"SELECT h.*, (SELECT min(m.ts) FROM moves m WHERE {tick}) AS emitted_at FROM held h"
    else:
        emitted = "SELECT h.*, m.ts AS emitted_at FROM held h ASOF LEFT JOIN (SELECT DISTINCT ts FROM moves) m ON h.effective_at <= m.ts"
    return f"""{_CROSSINGS},
durations(duration, h, spec_rank) AS (VALUES ('6h', 6, 0), ('12h', 12, 1), ('24h', 24, 2)),
nexts AS (SELECT *, lead(ts) OVER (PARTITION BY subject, region ORDER BY ts, seq) AS next_ts FROM crossings),
held AS (
  SELECT subject, seq, step, region, rank, kind, duration, spec_rank, ts AS started_at, ts + to_hours(h) AS effective_at
  FROM nexts, durations WHERE next_ts IS NULL OR ts + to_hours(h) <= next_ts
),
sustained AS (SELECT * FROM ({emitted}) WHERE emitted_at IS NOT NULL)"""


_SUSTAINED = _sustained_sql("subject")

# -- geometry -----------------------------------------------------------------------------------------


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE covered")
def membership_covered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.membership(moves(spark, sf_dir), ZONES).filter("covered").select("subject", "seq", "region")


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE strict")
def membership_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.membership(moves(spark, sf_dir), ZONES).filter("strict").select("subject", "seq", "region")


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE on_boundary")
def on_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.membership(moves(spark, sf_dir), ZONES).filter("on_boundary").select("subject", "seq", "region")


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE covered")
def membership_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a region table of measured size, small enough to be compiled into the scan."""
    return E.membership_join(moves(spark, sf_dir), region_table(spark, ZONES)).select("subject", "seq", "region")


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE covered")
def membership_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the grid join that large region tables take."""
    return E.membership_join(moves(spark, sf_dir), region_table(spark, ZONES), unrolled_edges=0).select("subject", "seq", "region")


@query(
    f"""WITH {_MEMBERS}, points AS (SELECT DISTINCT x, y, region, strict AS inside, covered, on_boundary FROM members)
SELECT x, y, region, inside, covered, NOT covered AS disjoint, on_boundary FROM points"""
)
def topology_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = moves(spark, sf_dir).select("x", "y").distinct()
    return world.topology_matrix(points, region_table(spark, ZONES)).select("x", "y", "region", "inside", "covered", "disjoint", "on_boundary")


_CASES = ", ".join(f"('{n}', {w}, {b}, {w or b})" for n, _, _, (w, b) in corpus.cases())


@query(f"SELECT * FROM (VALUES {_CASES}) t(name, within, on_boundary, covered)")
def topology_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """89 cases against their known answers."""
    return corpus.evaluate(spark)


@query(f"WITH {_MOVES} SELECT subject, seq, x, y FROM moves WHERE x BETWEEN {WINDOW[0]} AND {WINDOW[2]} AND y BETWEEN {WINDOW[1]} AND {WINDOW[3]}")
def bbox_window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).filter(world.closed_window(F.col("x"), F.col("y"), *WINDOW)).select("subject", "seq", "x", "y")


@query(f"WITH {_MOVES} SELECT seq, CASE WHEN x - 200 BETWEEN -180 AND 180 THEN x - 200 ELSE round(((x - 20) % 360 + 360) % 360 - 180, 9) END AS lon FROM moves")
def normalize_longitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = G.normal_longitude(F.col("x") - 200)
    return moves(spark, sf_dir).select("seq", F.when((F.col("x") - 200).between(-180, 180), lon).otherwise(F.round(lon, 9)).alias("lon"))


@query(
    f"""WITH {_MEMBERS} SELECT region, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n FROM members WHERE covered GROUP BY region"""
)
def bbox_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.membership(moves(spark, sf_dir), ZONES).filter("covered").groupBy("region")
    return m.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count("*").alias("n"))


@query(
    f"WITH {_MOVES} SELECT seq, 'POINT (' || CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', x), '0') END || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ')' AS wkt FROM moves"
)
def wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).select("seq", T.point_wkt(F.col("x"), F.col("y")).alias("wkt"))


# -- events -------------------------------------------------------------------------------------------


@query(f"WITH {_CROSSINGS} SELECT subject, seq, ts, step, region, kind FROM crossings")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.crossings(moves(spark, sf_dir), ZONES).select("subject", "seq", "ts", F.col("step").cast("long"), "region", "kind")


@query(f"WITH {_CROSSINGS} SELECT subject, seq, ts, step, region, kind FROM crossings")
def crossings_in_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with histories split by day, for subjects that hold much of the table."""
    return E.crossings(moves(spark, sf_dir), ZONES, "day").select("subject", "seq", "ts", F.col("step").cast("long"), "region", "kind")


@query(f"WITH {_CROSSINGS} SELECT region, count(*) FILTER (kind = 'enters') AS enters, count(*) FILTER (kind = 'leaves') AS leaves FROM crossings GROUP BY region")
def crossing_counts_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.crossings(moves(spark, sf_dir), ZONES).groupBy("region")
    return c.agg(F.count_if(F.col("kind") == "enters").alias("enters"), F.count_if(F.col("kind") == "leaves").alias("leaves"))


@query(f"WITH {_CROSSINGS} SELECT subject, seq, ts, region, kind FROM crossings")
def crossings_from_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From positive membership rows only."""
    m = moves(spark, sf_dir)
    positive = E.membership(m, ZONES).filter("covered").select("subject", "seq", "region")
    names = region_table(spark, ZONES).select(F.col("name").alias("region"), "rank")
    return E.crossings_of_memberships(m.select("subject", "seq", "ts"), positive, names).select("subject", "seq", "ts", "region", "kind")


_SUSTAINED_COLUMNS = ("subject", "seq", "region", "kind", "duration", "started_at", "effective_at", "emitted_at")


@query(f"WITH {_SUSTAINED} SELECT {', '.join(_SUSTAINED_COLUMNS)} FROM sustained")
def sustained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sustained(moves(spark, sf_dir), ZONES, DURATIONS).select(*_SUSTAINED_COLUMNS)


@query(f"WITH {_sustained_sql('global')} SELECT {', '.join(_SUSTAINED_COLUMNS)} FROM sustained")
def sustained_events_global_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sustained(moves(spark, sf_dir), ZONES, DURATIONS, clock="global").select(*_SUSTAINED_COLUMNS)


@query(f"WITH {_SUSTAINED} SELECT duration, kind, count(*) AS n FROM sustained GROUP BY ALL")
def sustained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts_by(E.sustained(moves(spark, sf_dir), ZONES, DURATIONS), "duration", "kind")


@query(
    f"""WITH {_SUSTAINED}, lags AS (SELECT (epoch_us(emitted_at) - epoch_us(effective_at)) / 1e6 AS lag FROM sustained)
SELECT count(*) AS events, count(*) FILTER (lag = 0) AS on_time, quantile_cont(lag, 0.5) AS median_s, quantile_disc(lag, 0.95) AS p95_s, max(lag) AS max_s FROM lags"""
)
def lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lag_summary(E.sustained(moves(spark, sf_dir), ZONES, DURATIONS))


@query(
    f"""WITH {_SUSTAINED},
a AS (SELECT region, count(*) AS pairs, count(*) FILTER (covered) AS inside, count(*) FILTER (NOT covered) AS outside, count(DISTINCT subject) AS subjects FROM lagged WHERE step > 0 GROUP BY region),
b AS (SELECT region, count(*) FILTER (kind = 'enters') AS enters, count(*) FILTER (kind = 'leaves') AS leaves FROM crossings GROUP BY region),
c AS (SELECT region, count(*) AS sustained FROM sustained GROUP BY region)
SELECT region, pairs, inside, outside, subjects, coalesce(enters, 0) AS enters, coalesce(leaves, 0) AS leaves, coalesce(sustained, 0) AS sustained,
  coalesce(enters, 0) + coalesce(leaves, 0) AS events, pairs - coalesce(enters, 0) - coalesce(leaves, 0) AS quiet FROM a LEFT JOIN b USING (region) LEFT JOIN c USING (region)"""
)
def zone_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zone_breakdown(moves(spark, sf_dir), ZONES, DURATIONS)


@query(
    f"""WITH {_SUSTAINED}, steps AS (SELECT subject, seq, ts, row_number() OVER (PARTITION BY subject ORDER BY ts, seq) - 1 AS at_step FROM moves),
exposing AS (SELECT subject, ts AS emitted_at, min(at_step) AS at_step FROM steps GROUP BY ALL)
SELECT subject, step, 1 AS phase, rank AS k2, kind, region, ts AS effective_at, ts AS emitted_at FROM crossings
UNION ALL SELECT subject, at_step, 0, spec_rank, 'sustained ' || kind, region, effective_at, emitted_at FROM sustained JOIN exposing USING (subject, emitted_at)"""
)
def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir)
    t = E.trace(E.crossings(m, ZONES), E.sustained(m, ZONES, DURATIONS), m)
    return t.select("subject", F.col("step").cast("long"), "phase", "k2", "kind", "region", "effective_at", "emitted_at")


# -- rules --------------------------------------------------------------------------------------------

NAMES = tuple(z.name for z in ZONES)
IMMEDIATE = M.Program(
    NAMES,
    (
        M.Rule("to-mid", "leaves", "BandLow", "Safe", "Mid"),
        M.Rule("to-risk", "enters", "BandMid", "Mid", "AtRisk"),
        M.Rule("back", "enters", "BandLow", "AtRisk", "Safe"),
    ),
)
GUARDED = M.Program(
    NAMES,
    (
        M.Rule("late", "leaves", "BandLow", "Safe", "AtRisk", 6 * HOUR),
        M.Rule("heal", "enters", "BandLow", "AtRisk", "Safe"),
    ),
)
_EVENT_LIST = f"""{_CROSSINGS},
numbered AS (SELECT subject, seq, ts, row_number() OVER (PARTITION BY subject ORDER BY ts, seq) AS n FROM moves),
flags AS (
  SELECT n.subject, n.n, n.ts, n.seq,
    coalesce(bool_or(c.region = 'BandLow' AND c.kind = 'leaves'), FALSE) AS out_low,
    coalesce(bool_or(c.region = 'BandLow' AND c.kind = 'enters'), FALSE) AS in_low,
    coalesce(bool_or(c.region = 'BandMid' AND c.kind = 'enters'), FALSE) AS in_mid
  FROM numbered n LEFT JOIN crossings c USING (subject, seq) GROUP BY ALL
)"""


@query(
    f"""WITH RECURSIVE {_EVENT_LIST},
fold AS (
  SELECT subject, 0::BIGINT AS n, 'Safe' AS state FROM (SELECT DISTINCT subject FROM flags)
  UNION ALL
  SELECT f.subject, f.n, CASE WHEN s2 = 'AtRisk' AND f.in_low THEN 'Safe' ELSE s2 END
  FROM (
    SELECT subject, n, in_low, CASE WHEN s1 = 'Mid' AND in_mid THEN 'AtRisk' ELSE s1 END AS s2
    FROM (
      SELECT f.subject, f.n, f.in_low, f.in_mid, CASE WHEN p.state = 'Safe' AND f.out_low THEN 'Mid' ELSE p.state END AS s1
      FROM fold p JOIN flags f ON f.subject = p.subject AND f.n = p.n + 1
    )
  ) f
)
SELECT subject, arg_max(state, n) AS state FROM fold GROUP BY subject"""
)
def immediate_rule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.run(moves(spark, sf_dir), ZONES, IMMEDIATE, initial_state="Safe")
    return t.filter("entry = 'final' and kind = 'state'").select("subject", F.col("to_state").alias("state"))


@query(
    f"""WITH RECURSIVE {_EVENT_LIST},
fold AS (
  SELECT subject, 0::BIGINT AS n, 'Safe' AS state, NULL::TIMESTAMP AS started, 0::BIGINT AS fired FROM (SELECT DISTINCT subject FROM flags)
  UNION ALL
  SELECT subject, n,
    CASE WHEN s1 = 'AtRisk' AND in_low THEN 'Safe' ELSE s1 END,
    CASE WHEN out_low AND s1 = 'Safe' THEN ts WHEN in_low THEN NULL ELSE p1 END,
    fired + CASE WHEN due THEN 1 ELSE 0 END
  FROM (
    SELECT subject, n, ts, in_low, out_low, fired, due,
      CASE WHEN due AND state = 'Safe' THEN 'AtRisk' ELSE state END AS s1,
      CASE WHEN due THEN NULL ELSE started END AS p1
    FROM (
      SELECT f.subject, f.n, f.ts, f.in_low, f.out_low, p.state, p.started, p.fired,
        coalesce(p.started + INTERVAL 6 HOUR <= f.ts, FALSE) AS due
      FROM fold p JOIN flags f ON f.subject = p.subject AND f.n = p.n + 1
    )
  )
)
SELECT subject, arg_max(state, n) AS state, CAST(max(fired) AS BIGINT) AS fired,
  CAST(CASE WHEN arg_max(CASE WHEN started IS NULL THEN 0 ELSE 1 END, n) = 1 THEN 1 ELSE 0 END AS BIGINT) AS pending FROM fold GROUP BY subject"""
)
def guarded_duration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.run(moves(spark, sf_dir), ZONES, GUARDED, initial_state="Safe").groupBy("subject")
    return t.agg(
        F.max(F.when((F.col("entry") == "final") & (F.col("kind") == "state"), F.col("to_state"))).alias("state"),
        F.count_if(F.col("kind") == "sustained leaves").alias("fired"),
        F.count_if(F.col("kind") == "pending").alias("pending"),
    )


@query(f"SELECT subject, state, fired FROM ({SQL['guarded_duration_states']})")
def streamed_duration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules on a stream of the table."""
    from .streaming.monitors import monitor
    from .streaming.sinks import drain, replay

    m = replay(moves(spark, sf_dir), "moves")
    t = drain(monitor(m, ZONES, GUARDED, initial_state="Safe"), "streamed-states")
    users = events(spark, sf_dir).select(F.col("user_id").alias("subject")).distinct()
    out = users.join(t, "subject", "left").groupBy("subject")
    state = (F.col("entry") == "state") & (F.col("kind") == "transition")
    order = F.struct("emitted_us", "step", "phase", "seq")
    last = F.max_by(F.when(state, F.col("to_state")), F.when(state, order))
    return out.agg(F.coalesce(last, F.lit("Safe")).alias("state"), F.count_if(F.col("kind") == "sustained leaves").alias("fired"))


@query(
    """WITH p(name, rank, entity) AS (VALUES ('leave', 0, 'even'), ('stay', 1, 'odd'), ('come', 2, 'even')),
i AS (SELECT user_id AS instance, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS entity FROM (SELECT DISTINCT user_id FROM events))
SELECT name || '@' || instance AS rule, instance AS subject, rank AS process_rank FROM p JOIN i USING (entity)"""
)
def grounded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    processes = spark.createDataFrame([("leave", 0, "even"), ("stay", 1, "odd"), ("come", 2, "even")], "name string, rank int, entity string")
    users = events(spark, sf_dir).select(F.col("user_id").alias("instance")).distinct()
    instances = users.select("instance", F.when(F.col("instance") % 2 == 0, "even").otherwise("odd").alias("entity"), F.col("instance").alias("rank"))
    return world.ground_rules(processes, instances).select("rule", "subject", "process_rank")


@query(
    "SELECT * FROM (VALUES ('deadline excluded', 3424, 329), ('double duration', 7792, 329), ('emit at deadline', 4368, 333), ('half duration', 10224, 325), "
    "('keep pending after opposite', 1680, 3145), ('move before timers', 3896, 393), ('no guard at deadline', 3832, 330), ('no guard at start', 8304, 331), "
    "('start after rules', 3832, 330), ('transition on start', 11024, 33)) t(mutant, distinguished, first_witness)"
)
def switch_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37,440 generated traces under ten changed switches; the SQL holds the published counts."""
    return policies.kill_matrix(policies.grid(spark)).select("mutant", F.col("distinguished").cast("int"), F.col("first_witness").cast("int"))


# -- world --------------------------------------------------------------------------------------------


@query(f"WITH {_MOVES} SELECT subject, arg_max(ts, (ts, seq)) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(x, (ts, seq)) AS x, arg_max(y, (ts, seq)) AS y FROM moves GROUP BY subject")
def latest_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world.latest_assertions(moves(spark, sf_dir))


@query(
    f"""WITH {_MOVES}, last AS (SELECT subject, arg_max(x, (ts, seq)) AS x, arg_max(y, (ts, seq)) AS y FROM moves GROUP BY subject)
SELECT subject, seq FROM moves m WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.subject = m.subject AND l.x = m.x AND l.y = m.y)"""
)
def evidence_not_asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir)
    return world.unaccepted(m, world.latest_assertions(m)).select("subject", "seq")


@query(
    f"""WITH {_MEMBERS}, last AS (SELECT subject, max(seq) AS seq FROM (SELECT subject, seq, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC) AS n FROM moves) WHERE n = 1 GROUP BY subject),
here AS (SELECT m.subject, m.region, m.covered, m.strict FROM members m JOIN last USING (subject, seq)),
c AS (
  SELECT 'keep-low' AS name, 0 AS rank, subject, 'BandLow' AS region, 'inside' AS predicate, strict AS ok FROM here WHERE region = 'BandLow' AND subject % 2 = 0
  UNION ALL SELECT 'keep-mid', 1, subject, 'BandMid', 'coveredBy', covered FROM here WHERE region = 'BandMid'
  UNION ALL SELECT 'nowhere', 2, subject, 'Missing', 'inside', NULL FROM here WHERE region = 'Tri'
)
SELECT name, rank, subject, region, CASE WHEN region = 'Missing' THEN 'no region Missing' ELSE 'not ' || predicate || ' ' || region END AS message FROM c WHERE ok IS NOT TRUE"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even subjects are Safe, odd ones Busy; keep-low holds for Safe only."""
    positions = world.latest_assertions(moves(spark, sf_dir))
    s = positions.select("subject")
    states = s.withColumn("state", F.when(F.col("subject") % 2 == 0, "Safe").otherwise("Busy"))
    rule = lambda name, rank, region, predicate, guard, rows: rows.select(F.lit(name).alias("name"), F.lit(rank).alias("rank"), "subject", F.lit(region).alias("region"), F.lit(predicate).alias("predicate"), F.lit(guard).cast("string").alias("while_state"))
    constraints = rule("keep-low", 0, "BandLow", "inside", "Safe", s).unionByName(rule("keep-mid", 1, "BandMid", "coveredBy", None, s)).unionByName(rule("nowhere", 2, "Missing", "inside", None, s))
    return world.violations(constraints, positions, states, region_table(spark, ZONES))


@query(
    f"""WITH {_MEMBERS}, last AS (SELECT subject, seq FROM (SELECT subject, seq, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC) AS n FROM moves) WHERE n = 1)
SELECT l.subject, count(m.region) AS regions FROM last l LEFT JOIN members m ON m.subject = l.subject AND m.seq = l.seq AND m.covered GROUP BY l.subject"""
)
def left_join_region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = world.latest_assertions(moves(spark, sf_dir))
    inside = E.membership(last, ZONES).filter("covered").groupBy("subject").agg(F.count("*").alias("n"))
    return last.join(inside, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("regions"))


@query(
    f"""WITH {_MEMBERS}, last AS (SELECT subject, seq FROM (SELECT subject, seq, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC) AS n FROM moves) WHERE n = 1)
SELECT l.subject, r.region FROM last l LEFT JOIN LATERAL (SELECT min(region) AS region FROM members m WHERE m.subject = l.subject AND m.seq = l.seq AND m.covered) r ON TRUE"""
)
def lateral_first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = world.latest_assertions(moves(spark, sf_dir))
    first = E.membership(last, ZONES).groupBy("subject").agg(F.min(F.when(F.col("covered"), F.col("region"))).alias("region"))
    return last.select("subject").join(first, "subject", "left")


@query(
    f"""WITH {_MEMBERS}, last AS (SELECT subject, seq, ts FROM (SELECT subject, seq, ts, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, seq DESC) AS n FROM moves) WHERE n = 1)
SELECT subject, CASE WHEN covered THEN 'AtRisk' ELSE 'Safe' END AS state, CASE WHEN covered THEN 1 ELSE 0 END::BIGINT AS crossings, FALSE AS inside
FROM members m JOIN last USING (subject, seq) WHERE region = 'BandLow'"""
)
def scenario_reroute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What if every subject were at (500, 90) one hour after its last move, and seven hours passed?"""
    from .operators.scenario import what_if

    m = moves(spark, sf_dir)
    program = M.Program(NAMES, (M.Rule("out", "leaves", "BandLow", "Safe", "AtRisk", 6 * HOUR),))
    last = world.latest_assertions(m)
    assumed = last.select("subject", F.lit(500.0).alias("x"), F.lit(90.0).alias("y"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    t = what_if(last, assumed, ZONES, program, initial_state="Safe", run_us=7 * HOUR)
    low = (F.col("region") == "BandLow") & (F.col("kind") == "leaves")
    return t.groupBy("subject").agg(
        F.max(F.when((F.col("entry") == "final") & (F.col("kind") == "state"), F.col("to_state"))).alias("state"),
        F.count_if(low).alias("crossings"),
        F.lit(False).alias("inside"),
    )


# -- analytics ----------------------------------------------------------------------------------------


@query(
    f"""WITH {_MOVES}, j AS (SELECT subject, abs(x - lag(x) OVER (PARTITION BY subject ORDER BY ts, seq)) AS jump FROM moves)
SELECT count(*) AS jumps, count(DISTINCT subject) AS subjects, max(jump) AS largest FROM j WHERE jump > 180"""
)
def jump_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.jump_audit(moves(spark, sf_dir), 180.0)


@query(
    f"""WITH {_CROSSINGS}, j AS (SELECT subject, seq, coalesce(abs(x - lag(x) OVER (PARTITION BY subject ORDER BY ts, seq)) > 180, FALSE) AS seam FROM moves)
SELECT region, count(*) AS changes, count(*) FILTER (seam) AS at_seam FROM crossings JOIN j USING (subject, seq) GROUP BY region"""
)
def seam_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = moves(spark, sf_dir)
    return stats.seam_memberships(m, E.crossings(m, ZONES), 180.0)


@query(f"WITH {_MOVES} SELECT DISTINCT subject, x, y FROM moves")
def dedupe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(spark, sf_dir).select("subject", "x", "y").dropDuplicates()


@query(
    f"""WITH {_MEMBERS}, a AS (SELECT subject, region FROM members WHERE covered), b AS (SELECT subject, region FROM members WHERE strict)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.membership(moves(spark, sf_dir), ZONES)
    return stats.symmetric_difference(m.filter("covered").select("subject", "region"), m.filter("strict").select("subject", "region"))[0]


@query(
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events GROUP BY event_type"""
)
def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.latency_stats(events(spark, sf_dir), "value", "event_type")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")], "max")


@query(
    """SELECT event_type, count(value) AS runs, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS deviation,
round(stddev_pop(value) / avg(value), 6) AS variation FROM events GROUP BY event_type"""
)
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.level_summary(events(spark, sf_dir), "value", "event_type")
    return s.select("event_type", "runs", F.round("mean", 6).alias("mean"), "min", "max", F.round("deviation", 6).alias("deviation"), F.round("variation", 6).alias("variation"))


@query(
    """WITH runs AS (SELECT hour(ts) AS target, quantile_cont(value, 0.99) AS p99_ms, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS skipped FROM events GROUP BY hour(ts)),
levels AS (SELECT target, p99_ms <= 250 AND skipped / (done + skipped) <= 0.3 AS passed FROM runs),
f AS (SELECT *, sum(CASE WHEN passed THEN 0 ELSE 1 END) OVER (ORDER BY target) AS n FROM levels)
SELECT target, passed, CASE WHEN n = 0 THEN 'prefix' WHEN NOT passed AND n = 1 THEN 'first failure' WHEN passed THEN 'later pass' ELSE 'later failure' END AS standing FROM f"""
)
def prefix_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("target", F.hour("ts").cast("long")).groupBy("target")
    error = F.col("event_type") == "error"
    runs = e.agg(F.percentile("value", 0.99).alias("p99_ms"), F.count_if(~error).alias("done"), F.count_if(error).alias("skipped"), F.lit(0).alias("failed"))
    return stats.slo_prefix(stats.slo_levels(runs, 250.0, 0.3)).select("target", "passed", "standing")


@query("SELECT user_id, greatest(0, arg_max(event_id, ts) - arg_min(event_id, ts)) AS delta, count(*) AS samples FROM events GROUP BY user_id")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counter_delta(events(spark, sf_dir), "ts", "event_id", "user_id")


@query(
    """WITH p AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'manual' ELSE 'pass' END AS status FROM events)
SELECT user_id, count(*) AS probes, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'manual' END AS status FROM p GROUP BY user_id"""
)
def probe_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    p = events(spark, sf_dir).select("user_id", F.when(kind == "error", "fail").when(kind == "click", "manual").otherwise("pass").alias("status"))
    return stats.roll_up(p, "user_id")


@query(
    f"""WITH {_MEMBERS}, a AS (SELECT seq, region FROM members WHERE covered), b AS (SELECT seq, region FROM members WHERE strict)
SELECT seq, region, CASE WHEN b.region IS NULL THEN 'left only' WHEN a.region IS NULL THEN 'right only' ELSE 'same' END AS status FROM a FULL JOIN b USING (seq, region)"""
)
def compare_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.membership(moves(spark, sf_dir), ZONES).select("seq", "region", "covered", "strict")
    a, b = m.filter("covered").select("seq", "region"), m.filter("strict").select("seq", "region")
    return stats.compare_rows(a, b, ["seq", "region"])


# -- graphs and geometry functions ------------------------------------------------------------------

_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.2f', {0}), '0') END"
_OBS = "https://example.org/tidefence/resource/observation/"


@query(
    f"""SELECT event_id AS seq, '<{_OBS}' || n || '> a sosa:Observation ;' || chr(10)
|| '  sosa:hasFeatureOfInterest <https://example.org/tidefence/resource/instance/' || user_id || '> ;' || chr(10)
|| '  sosa:observedProperty <https://example.org/tidefence/resource/property/position> ;' || chr(10)
|| '  sosa:madeBySensor <https://example.org/tidefence/resource/sensor/' || event_type || '> ;' || chr(10)
|| '  sosa:hasResult <{_OBS}' || n || '/result> ;' || chr(10)
|| '  sosa:resultTime "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00"^^xsd:dateTime ;' || chr(10)
|| '  st:modality st:Observed .' || chr(10)
|| '<{_OBS}' || n || '/result> a geo:Geometry, sosa:Result ;' || chr(10)
|| '  geo:asWKT "<{CRS}> POINT (' || {_NUM.format("value")} || ' ' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ')"^^geo:wktLiteral .' || chr(10) AS text
FROM (SELECT *, CASE WHEN event_id + 1 < 10000 THEN lpad(CAST(event_id + 1 AS VARCHAR), 4, '0') ELSE CAST(event_id + 1 AS VARCHAR) END AS n FROM events)"""
)
def sosa_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an observation with its result, in the graph text."""
    from .plans.rdf import sosa

    e = events(spark, sf_dir)
    o = e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("subject"),
        F.lit("position").alias("property"),
        F.col("event_type").alias("source"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.lit(CRS).alias("crs"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("observed_at_text"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("double").alias("accuracy_m"),
    )
    return sosa(o).filter("section = 7").select(F.col("name").try_cast("long").alias("seq"), "text")


@query(f"WITH {_MEMBERS} SELECT subject, seq, region, strict AS within, covered AS intersects, on_boundary AS touches FROM members")
def wkt_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predicates through WKT literals; each literal is parsed once, polygons before the join."""
    from .functions import wkt as W

    text = T.point_wkt(F.col("x"), F.col("y"), F.lit(CRS))
    m = moves(spark, sf_dir).withColumn("text", text).withColumn("p", W.first_point("text")).select("subject", "seq", "p.x", "p.y")
    # five rows of fixed size; their corners are compiled into the scan of the moves
    zones = region_table(spark, ZONES).coalesce(1).select("name", "rank", T.polygon_wkt(F.col("shell"), F.col("crs")).alias("text"))
    zones = zones.select("name", "rank", W.crs_of("text").alias("crs"), W.coordinates("text").alias("corners")).orderBy("rank").collect()
    pairs = E.membership(m, [Region.closed(z["name"], z["corners"], z["crs"], z["rank"]) for z in zones])
    return pairs.select("subject", "seq", "region", F.col("strict").alias("within"), F.col("covered").alias("intersects"), F.col("on_boundary").alias("touches"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing_counts_by_zone(spark, sf_dir)
