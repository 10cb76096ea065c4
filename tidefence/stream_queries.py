"""Registered queries that run as streams, and over documents of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.json_tree import nodes
from .queries import _MEMBERS, ZONES, events, moves, query
from .streaming.monitors import zone_stays as stays_of
from .streaming.sinks import drain, replay

GAP, DELAY = "6 hours", "2 hours"


@query(
    f"""WITH {_MEMBERS},
stepped AS (
  SELECT subject, region, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {GAP} THEN 0 ELSE 1 END AS opens FROM members WHERE covered WINDOW w AS (PARTITION BY subject, region ORDER BY ts, seq)
),
islands AS (SELECT subject, region, ts, sum(opens) OVER (PARTITION BY subject, region ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM stepped),
stays AS (SELECT subject, region, min(ts) AS start, max(ts) + INTERVAL {GAP} AS "end", count(*) AS n FROM islands GROUP BY subject, region, island)
SELECT * FROM stays WHERE "end" <= (SELECT max(ts) FROM moves) - INTERVAL {DELAY}"""
)
def zone_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of every subject in every zone, by session windows through a stream: those that the watermark has closed."""
    stream = replay(moves(spark, sf_dir).select("subject", "ts", "x", "y"), "moves")
    return drain(stays_of(stream, ZONES, GAP, DELAY), "stays")


_STEP = '{"type": "\' || event_type || \'", "cost": \' || user_id || \', "inputs": ['


@query(
    f"""WITH docs AS (
  SELECT event_id, '{{"plan": ' || repeat('{_STEP}', CAST(1 + event_id % 5 AS INT)) || props || ', null, true, "leaf"' || repeat(']}}', CAST(1 + event_id % 5 AS INT)) || '}}' AS doc FROM events
)
SELECT event_id, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE atom ->> '$' END AS text, CAST(len(regexp_extract_all(fullkey, '\\.|\\[')) AS INT) AS depth
FROM docs, json_tree(docs.doc)"""
)
def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of nested plan documents, with its path, whatever its depth."""
    step = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "cost": '), F.col("user_id").cast("string"), F.lit(', "inputs": ['))
    times = (1 + F.col("event_id") % 5).cast("int")
    doc = F.concat(F.lit('{"plan": '), F.repeat(step, times), F.col("props"), F.lit(', null, true, "leaf"'), F.repeat(F.lit("]}"), times), F.lit("}"))
    return nodes(events(spark, sf_dir).select("event_id", doc.alias("doc")), "event_id", "doc").select("event_id", "path", "kind", "text", "depth")
