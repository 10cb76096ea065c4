"""One policy and one trace from three encodings: the model notation, graphs, and moving features with a JSON policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError
from ..operators.checks import outcomes
from ..operators.machine import Program, Rule, run
from ..operators.regions import Region
from ..sources.documents import moving_features, observed_moves, polygon_policies, triples
from .model import Model

TIME = "http://www.w3.org/2006/time#"
GEO = "http://www.opengis.net/ont/geosparql#"


def _outcome(moves: DataFrame, region: Region, rule: Rule, initial: str) -> DataFrame:
    return outcomes(run(moves.drop("crs") if "crs" in moves.columns else moves, [region], Program((region.name,), (rule,)), initial_state=initial))


def from_model(spark: SparkSession, model: Model) -> DataFrame:
    """The model's observations, accepted as moves."""
    t = model.tables(spark)
    moves = t["observations"].select("subject", F.col("seq").cast("long"), F.col("observed_at").alias("ts"), "x", "y")
    rule = model.rules[0]
    return _outcome(moves, model.regions[rule.region], Rule("policy", rule.kind, rule.region, rule.from_state, rule.to_state, rule.duration_us), model.states[rule.subject])


def from_graphs(spark: SparkSession, data: str, policy: str, vocabulary: str) -> DataFrame:
    """Observations, zone and initial state of a data graph under a policy graph with a duration in minutes."""
    d, p = triples(spark, data), triples(spark, policy)
    said = {iri_name(r.p): r.o for r in p.collect()}
    unit = said.get("unitType", "")
    if not unit.endswith("unitMinute"):
        raise ModelError(f"unknown duration unit {unit!r}")
    name = said["region"].rsplit("/", 1)[-1].rsplit("#", 1)[-1]
    link = d.filter((F.col("s") == said["region"]) & (F.col("p") == GEO + "hasGeometry")).select(F.col("o").alias("s"))
    wkt = link.join(d.filter(F.col("p") == GEO + "asWKT"), "s").first().o
    from ..functions.planar import from_wkt

    g = from_wkt(wkt)
    region = Region(name, g.parts[0][0], g.crs)
    initial = iri_name(d.filter(F.col("p") == vocabulary + "initialState").first().o)
    rule = Rule("policy", iri_name(said["trigger"]), name, iri_name(said["fromState"]), iri_name(said["toState"]), round(float(said["numericDuration"]) * 60e6))
    return _outcome(observed_moves(d), region, rule, initial)


def iri_name(iri: str) -> str:
    return iri.rsplit("/", 1)[-1].rsplit("#", 1)[-1]


def from_features(spark: SparkSession, feature: str, policy: str) -> DataFrame:
    text = lambda t: spark.createDataFrame([(t,)], "value string")
    moves = moving_features(text(feature))
    p = polygon_policies(text(policy)).first()
    region = Region.closed(p.region, [(c.x, c.y) for c in p.shell], "urn:feature")
    initial = moves.first().initial_state
    return _outcome(moves.drop("initial_state"), region, Rule("policy", p.trigger, p.region, p.from_state, p.to_state, p.duration_us), initial)
