"""Registered queries over the observation graph of the events: written as Turtle, read back by many tasks, and matched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import wkt as W
from .operators.graph import GraphQuery, Var, match
from .plans.rdf import PREFIXES, header, sosa
from .queries import _MEMBERS, CRS, ZONES, events, query
from .sources.documents import RDF_TYPE
from .sources.turtle import turtle_triples, write_turtle
from .streaming.sinks import shared_folder, stored

SOSA, GEO = PREFIXES["sosa"], PREFIXES["geo"]
TRI = next(z for z in ZONES if z.name == "Tri")
TRI_WKT = f"<{CRS}> POLYGON ((" + ", ".join(f"{x:g} {y:g}" for x, y in TRI.shell) + "))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as rows that the projection takes."""
    e = events(spark, sf_dir)
    return e.select(
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


def observation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the Turtle files that the events are written to; the parsed triples are stored, as patterns read them more than once."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    write_turtle(sosa(observations(spark, sf_dir)), path, header("geo", "sosa", "xsd", "st"))
    return stored(turtle_triples(spark, path), "triples")


@query(
    f"""WITH {_MEMBERS} SELECT seq, CAST(m.subject AS VARCHAR) AS subject, event_type AS sensor, strftime(m.ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS time, x, y, strict AS inside
FROM members m JOIN events e ON m.seq = e.event_id WHERE region = 'Tri' AND event_type <> 'error'"""
)
def graph_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five patterns, a filter and ``?inside``: moves with their time, sensor and whether they lie inside a zone, from the graph alone."""
    obs, subject, sensor, time, result, wkt = map(Var, ("obs", "subject", "sensor", "time", "result", "wkt"))
    found = match(
        observation_graph(spark, sf_dir),
        GraphQuery(
            [
                (obs, SOSA + "hasFeatureOfInterest", subject),
                (obs, SOSA + "madeBySensor", sensor),
                (obs, SOSA + "resultTime", time),
                (obs, SOSA + "hasResult", result),
                (result, GEO + "asWKT", wkt),
            ],
            binds={"inside": lambda v: W.sf_within(v["wkt"], F.lit(TRI_WKT)), "point": lambda v: F.get(W.coordinates(v["wkt"]), F.lit(0))},
            filters=[lambda v: T.iri_local_name(v["sensor"]) != "error"],
        ),
    )
    name = lambda c: T.iri_local_name(F.col(c))
    return found.select((name("obs").cast("long") - 1).alias("seq"), name("subject").alias("subject"), name("sensor").alias("sensor"), "time", F.col("point.x").alias("x"), F.col("point.y").alias("y"), "inside")


@query("SELECT event_type AS sensor, CAST(user_id AS VARCHAR) AS subject, count(*) AS n FROM events GROUP BY ALL")
def graph_sensor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each sensor saw each feature, by types and links of the graph; types are one of several objects of a predicate."""
    obs, subject, sensor = map(Var, ("obs", "subject", "sensor"))
    found = match(
        observation_graph(spark, sf_dir),
        GraphQuery([(obs, SOSA + "madeBySensor", sensor), (sensor, RDF_TYPE, SOSA + "Sensor"), (obs, SOSA + "hasFeatureOfInterest", subject), (subject, RDF_TYPE, SOSA + "FeatureOfInterest")]),
    )
    name = lambda c: T.iri_local_name(F.col(c)).alias(c)
    return found.groupBy(name("sensor"), name("subject")).agg(F.count("*").alias("n"))
