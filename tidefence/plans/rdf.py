"""Turtle and shape projections as tables of text blocks, and the evaluation of shapes over triples.

A projection is a DataFrame (section, name, text): ordering by section and name and joining the texts gives the graph. Blocks are built from
Columns, so millions of observations are projected in the JVM and written without passing the driver.
"""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from ..functions import text as T
from ..streaming.sinks import stored

BASE = "https://example.org/tidefence/resource"
VOCABULARY = "https://example.org/tidefence/vocab#"
# The standard vocabularies.
PREFIXES = {
    "geo": "http://www.opengis.net/ont/geosparql#",
    "geof": "http://www.opengis.net/def/function/geosparql/",
    "sh": "http://www.w3.org/ns/shacl#",
    "sosa": "http://www.w3.org/ns/sosa/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "st": VOCABULARY,
}
FUNCTION_OF = {"inside": "geof:sfWithin", "coveredBy": "geof:sfIntersects"}


def check_base(base: str) -> str:
    """The base without a trailing slash."""
    if not base or any(c.isspace() or c in '<>"{}|\\^`' for c in base) or not urlsplit(base).scheme:
        raise ModelError(f"not a base IRI: {base!r}")
    return base.rstrip("/")


def header(*names: str) -> str:
    return "".join(f"@prefix {n}: <{PREFIXES[n]}> .\n" for n in names)


def iri(base: str, kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{check_base(base)}/{kind}/"), T.iri_part(name))


def block(subject: Column, *predicates: Column) -> Column:
    """A Turtle block; null predicates are left out."""
    return F.concat(F.lit("<"), subject, F.lit("> "), F.concat_ws(" ;\n  ", *predicates), F.lit(" .\n"))


def check_statements(blocks: DataFrame) -> DataFrame:
    """Fails on a block that does not end as ``block`` ends it; readers part files there."""
    ends = F.col("text").isNull() | F.endswith("text", F.lit(" .\n"))
    return blocks.withColumn("text", F.when(ends, F.col("text")).otherwise(F.raise_error(F.lit("a block has no end of a statement")))).filter("text IS NOT NULL")


def _link(predicate: str, target: Column) -> Column:
    return F.concat(F.lit(f"{predicate} <"), target, F.lit(">"))


def _literal(predicate: str, value: Column, datatype: str = "") -> Column:
    return F.concat(F.lit(f"{predicate} "), T.json_string(value), F.lit(f"^^{datatype}" if datatype else ""))


def feature_block(base: str, kind: str, name: Column, wkt: Column, *, types: str = "geo:Feature", asserted: bool = False) -> Column:
    feature = iri(base, kind, name)
    geometry = F.concat(feature, F.lit("/geometry"))
    mode = [F.lit("st:modality st:Asserted")] if asserted else []
    return F.concat(
        block(feature, F.lit(f"a {types}"), _link("geo:hasGeometry", geometry)),
        block(geometry, F.lit("a geo:Geometry"), _literal("geo:asWKT", wkt, "geo:wktLiteral"), *mode),
    )


def _part(df: DataFrame, section: int, name: str | Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.col(name) if isinstance(name, str) else name).alias("name"), text.alias("text"))


def geosparql(regions: DataFrame, positions: DataFrame, base: str = BASE, *, modal: bool = False) -> DataFrame:
    """Regions, then positions, as features with WKT geometries."""
    r = _part(regions, 1, "name", feature_block(base, "region", F.col("name"), T.polygon_wkt(F.col("shell"), F.col("crs")), asserted=modal))
    wkt = T.point_wkt(F.col("x"), F.col("y"), F.col("crs"))
    types = "geo:Feature, sosa:FeatureOfInterest" if modal else "geo:Feature"
    return r.unionByName(_part(positions, 2, "subject", feature_block(base, "instance", F.col("subject"), wkt, types=types, asserted=modal)))


def sosa(observations: DataFrame, base: str = BASE) -> DataFrame:
    """Properties, sensors and features, each once, then an observation and a result per row.

    observations(seq, subject, property, source, x, y, crs, observed_at_text, confidence, accuracy_m); seq counts from 0.
    """
    parts = []
    for section, (column, kind, types) in enumerate((("property", "property", "a sosa:Property"), ("source", "sensor", "a sosa:Sensor"), ("subject", "instance", "a geo:Feature, sosa:FeatureOfInterest")), 4):
        names = observations.select(F.col(column).alias("name")).distinct()
        parts.append(_part(names, section, "name", block(iri(base, kind, F.col("name")), F.lit(types))))
    number = T.padded(F.col("seq") + 1)
    me = iri(base, "observation", number)
    result = F.concat(me, F.lit("/result"))
    optional = lambda p, c: F.concat(F.lit(f'st:{p} "'), T.short_number(F.col(c), arrow=False), F.lit('"^^xsd:decimal'))
    text = F.concat(
        block(
            me,
            F.lit("a sosa:Observation"),
            _link("sosa:hasFeatureOfInterest", iri(base, "instance", F.col("subject"))),
            _link("sosa:observedProperty", iri(base, "property", F.col("property"))),
            _link("sosa:madeBySensor", iri(base, "sensor", F.col("source"))),
            _link("sosa:hasResult", result),
            _literal("sosa:resultTime", F.col("observed_at_text"), "xsd:dateTime"),
            F.lit("st:modality st:Observed"),
            optional("confidence", "confidence"),
            optional("accuracyMetres", "accuracy_m"),
        ),
        block(result, F.lit("a geo:Geometry, sosa:Result"), _literal("geo:asWKT", T.point_wkt(F.col("x"), F.col("y"), F.col("crs")), "geo:wktLiteral")),
    )
    rows = _part(observations, 7, F.lpad(F.col("seq").cast("string"), 20, "0"), text)
    out = rows
    for p in parts:
        out = out.unionByName(p)
    return out


def data_graph(regions: DataFrame, positions: DataFrame, states: DataFrame, observations: DataFrame, base: str = BASE) -> DataFrame:
    """Modes, regions, positions, states, observed resources, observations."""
    spark = regions.sparkSession
    modes = spark.range(1).select(F.explode(F.array(F.lit("Asserted"), F.lit("Observed"))).alias("mode"))
    m = _part(modes, 0, "mode", block(F.concat(F.lit(VOCABULARY), "mode"), F.lit("a st:Modality")))
    s = _part(states, 3, "subject", block(iri(base, "instance", F.col("subject")), _literal("st:state", F.col("state"))))
    return m.unionByName(geosparql(regions, positions, base, modal=True)).unionByName(s).unionByName(sosa(observations, base))


def shapes(constraints: DataFrame, base: str = BASE) -> DataFrame:
    """A node shape with a SPARQL constraint for each row of constraints, by name."""
    function = F.when(F.col("predicate") == "inside", FUNCTION_OF["inside"]).when(F.col("predicate") == "coveredBy", FUNCTION_OF["coveredBy"])
    function = F.coalesce(function, F.raise_error(F.concat(F.lit("no spatial function for "), "predicate")))
    state = F.when(F.col("while_state").isNotNull(), F.concat(F.lit("  $this st:state "), T.json_string(F.col("while_state")), F.lit(" .\n"))).otherwise("")
    select = F.concat(
        F.lit("".join(f"PREFIX {p}: <{PREFIXES[p]}>\n" for p in ("geo", "geof", "st")) + "SELECT $this\nWHERE {\n  $this geo:hasGeometry/geo:asWKT ?subjectWkt .\n  <"),
        iri(base, "region", F.col("region")),
        F.lit("> geo:hasGeometry/geo:asWKT ?regionWkt .\n"),
        state,
        F.lit("  FILTER (!"),
        function,
        F.lit("(?subjectWkt, ?regionWkt))\n}"),
    )
    message = F.concat(F.lit("constraint "), "name", F.lit(" is broken: not "), "predicate", F.lit(" "), "region")
    inner = F.concat(F.lit("sh:sparql [\n    a sh:SPARQLConstraint ;\n    sh:message "), T.json_string(message), F.lit(' ;\n    sh:select """'), select, F.lit('"""\n  ]'))
    text = block(iri(base, "shape", F.col("name")), F.lit("a sh:NodeShape"), _link("sh:targetNode", iri(base, "instance", F.col("subject"))), inner)
    return _part(constraints, 0, "name", text)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """In order, in as many files as partitions; file order is block order."""
    blocks.orderBy("section", "name").select(F.regexp_replace("text", "\n$", "").alias("value")).write.mode("overwrite").text(path)


def turtle(blocks: DataFrame, *prefixes: str) -> str:
    """A whole small graph as text, for models; large ones go through write_blocks."""
    texts = [r["text"] for r in blocks.orderBy("section", "name").toLocalIterator()]
    return header(*prefixes) + ("\n" + "\n".join(texts) if texts else "")


def write_bundle(tables: dict[str, DataFrame], directory: str, stem: str, base: str = BASE) -> tuple[Path, Path]:
    """Data and shapes of a model's tables as two Turtle files."""
    if not stem or stem in (".", "..") or "/" in stem or "\\" in stem:
        raise ModelError(f"not a file stem: {stem!r}")
    data = turtle(data_graph(tables["regions"], tables["positions"], tables["states"], tables["observations"], base), "geo", "st", "sosa", "xsd")
    shape = turtle(shapes(tables["constraints"], base), "geo", "st", "sh")
    folder = Path(directory)
    folder.mkdir(parents=True, exist_ok=True)
    out = folder / f"{stem}-data.ttl", folder / f"{stem}-shapes.ttl"
    for path, text in zip(out, (data, shape), strict=True):
        path.write_text(text, encoding="utf-8", newline="\n")
    return out


# -- evaluation over triples ----------------------------------------------------------------------------


def objects(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select("s", "o", "datatype")


def shape_results(triples: DataFrame, constraints: DataFrame, base: str = BASE) -> DataFrame:
    """The focus nodes that the shapes of constraints report, from triples(s, p, o, datatype) alone."""
    from ..functions.wkt import sf_intersects, sf_within

    path = objects(triples, PREFIXES["geo"] + "hasGeometry").select("s", F.col("o").alias("g"))
    wkt = path.join(objects(triples, PREFIXES["geo"] + "asWKT").select(F.col("s").alias("g"), F.col("o").alias("wkt")), "g").select("s", "wkt")
    state = objects(triples, VOCABULARY + "state").select("s", F.col("o").alias("state"))
    c = constraints.select("name", "predicate", "while_state", iri(base, "instance", F.col("subject")).alias("s"), iri(base, "region", F.col("region")).alias("r"))
    j = c.join(wkt, "s").join(wkt.select(F.col("s").alias("r"), F.col("wkt").alias("region_wkt")), "r").join(state, "s", "left")
    j = j.filter("while_state is null or state = while_state")
    holds = F.when(F.col("predicate") == "inside", sf_within("wkt", "region_wkt")).otherwise(sf_intersects("wkt", "region_wkt"))
    return j.filter(~holds).select("name", F.col("s").alias("focus"))


def parity(violations: DataFrame, results: DataFrame) -> DataFrame:
    """One row: both counts, both conformances, whether they agree."""
    a, b = violations.agg(F.count("*").alias("violations")), results.agg(F.count("*").alias("results"))
    out = a.crossJoin(b)  # one row each
    return out.withColumn("conforms", F.col("violations") == 0).withColumn("shapes_conform", F.col("results") == 0).withColumn("matches", F.col("violations") == F.col("results"))


def count_shape(triples: DataFrame, target_class: str, path: str, *, low: int = 0, high: int | None = None, datatype: str | None = None, of_class: str | None = None) -> DataFrame:
    """Focus nodes of a class that break a property shape: count, datatype or class of values."""
    kind = PREFIX_TYPE
    focus = triples.filter((F.col("p") == kind) & (F.col("o") == target_class)).select("s").distinct()
    values = triples.filter(F.col("p") == path).select("s", "o", "datatype")
    if of_class:
        typed = triples.filter((F.col("p") == kind) & (F.col("o") == of_class)).select(F.col("s").alias("o")).distinct().withColumn("typed", F.lit(True))
        values = values.join(typed, "o", "left")
    else:
        values = values.withColumn("typed", F.lit(True))
    good = F.col("typed").isNotNull() & (F.col("datatype").eqNullSafe(datatype) if datatype else F.lit(True))
    per = values.groupBy("s").agg(F.count("*").alias("n"), F.count_if(~good).alias("wrong"))
    out = focus.join(per, "s", "left").na.fill(0, ["n", "wrong"])
    broken = (F.col("n") < low) | (F.col("wrong") > 0)
    return out.filter(broken | (F.col("n") > high) if high is not None else broken)


PREFIX_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def subclass_closure(triples: DataFrame) -> DataFrame:
    """(s, class): types with all superclasses. Each round joins only what the last one found; rounds are stored, and end when nothing is new, so
    chains of any length and cycles are followed to their end."""
    up = stored(triples.filter(F.col("p") == "http://www.w3.org/2000/01/rdf-schema#subClassOf").select(F.col("s").alias("class"), F.col("o").alias("above")).distinct(), "subclasses")
    have = new = stored(triples.filter(F.col("p") == PREFIX_TYPE).select("s", F.col("o").alias("class")).distinct(), "types")
    while True:
        found = new.join(up, "class").select("s", F.col("above").alias("class")).distinct()
        new = stored(found.join(have, ["s", "class"], "left_anti"), "types")
        if not new.head(1):
            return have
        have = stored(have.union(new), "closure")
