"""Sources that are documents: moving features, polygon policies, Turtle, query results, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ModelError

MOVING = (
    "type string, id string, temporalGeometry struct<type:string, datetimes:array<string>, coordinates:array<array<double>>, interpolation:string>, "
    "properties struct<initialState:string>"
)
POLICY = (
    "type string, name string, subject string, regionName string, region struct<type:string, coordinates:array<array<array<double>>>>, "
    "boundaryPolicy string, trigger string, minimumDurationSeconds double, fromState string, toState string"
)


def moving_features(texts: DataFrame) -> DataFrame:
    """texts(value): a JSON feature each. Moves (subject, seq, ts, x, y, initial_state), or an error for what is no stepwise moving point."""
    f = texts.select(F.from_json("value", MOVING).alias("f")).select("f.*")
    g = F.col("temporalGeometry")
    times = F.transform(g["datetimes"], lambda t: F.to_timestamp(t))
    rising = F.forall(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.get(times, i) > F.get(times, i - 1))
    fault = (
        F.when(F.col("type").isNull() | (F.col("type") != "Feature"), "not a feature")
        .when(g["type"].isNull() | (g["type"] != "MovingPoint"), "not a moving point")
        .when(F.coalesce(g["interpolation"], F.lit("Linear")) != "Step", "interpolation is not Step")
        .when(F.size(g["datetimes"]) != F.size(g["coordinates"]), "times and coordinates differ in number")
        .when(F.size(g["datetimes"]) < 2, "fewer than two samples")
        .when(~rising, "times are not rising")
    )
    checked = f.withColumn("temporalGeometry", F.when(fault.isNull(), g).otherwise(F.raise_error(F.concat(F.lit("moving feature: "), fault)).cast(f.schema["temporalGeometry"].dataType)))
    at = lambda i: F.struct(F.get(F.col("temporalGeometry")["datetimes"], i).alias("t"), F.get(F.col("temporalGeometry")["coordinates"], i).alias("c"))
    samples = F.transform(F.sequence(F.lit(0), F.size(F.col("temporalGeometry")["datetimes"]) - 1), at)
    out = checked.select(F.col("id").alias("subject"), F.col("properties")["initialState"].alias("initial_state"), F.posexplode(samples).alias("seq", "p"))
    return out.select("subject", F.col("seq").cast("long"), F.to_timestamp("p.t").alias("ts"), F.col("p.c")[0].alias("x"), F.col("p.c")[1].alias("y"), "initial_state")


def polygon_policies(texts: DataFrame) -> DataFrame:
    """texts(value): name, subject, region, shell, trigger, duration_us, from_state, to_state of each JSON policy."""
    p = texts.select(F.from_json("value", POLICY).alias("p")).select("p.*")
    shell = F.transform(F.col("region")["coordinates"][0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    return p.select("name", "subject", F.col("regionName").alias("region"), shell.alias("shell"), F.col("boundaryPolicy").alias("predicate"), "trigger", F.bround(F.col("minimumDurationSeconds") * 1e6).cast("long").alias("duration_us"), F.col("fromState").alias("from_state"), F.col("toState").alias("to_state"))


# -- Turtle subset --------------------------------------------------------------------------------------

_TURTLE = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<prefix>@prefix\s+([\w-]*):\s*<([^>]*)>\s*\.)|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\]|\\.)*")'''
    r"|(?P<type>\^\^)|(?P<lang>@[\w-]+)|(?P<sign>[;,.\[\]])|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>[\w-]*:[\w.-]*[\w-]|[\w-]*:|a(?=\s)|true|false)"
)
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _lexemes(text: str) -> Iterator[tuple[str, str, tuple]]:
    at, end, match = 0, len(text), _TURTLE.match
    while at < end:
        m = match(text, at)
        if not m:
            raise ModelError(f"Turtle: cannot read {text[at : at + 20]!r}")
        kind = m.lastgroup
        if m["prefix"]:
            yield "prefix", m[0], m.groups()[2:4]
        elif kind != "skip":
            yield kind, m[0], ()
        at = m.end()


def read_turtle(text: str, known: dict[str, str] | None = None, *, scope: str = "", labels: str = "") -> list[tuple[str, str, str, str | None]]:
    """(s, p, o, datatype): prefixes, lists with ; and , blank node brackets and labels, and typed literals.

    known: prefixes declared elsewhere; scope and labels: what names of anonymous and of labelled nodes begin with, where a graph is read in parts."""
    items, prefixes, out, blanks = list(_lexemes(text)), dict(known or {}), [], iter(range(10**9))
    i = 0

    def unescape(s: str) -> str:
        if "\\" not in s:
            return s
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)

    def full(name: str) -> str:
        if name == "a":
            return RDF_TYPE
        prefix, _, local = name.partition(":")
        if prefix == "_":
            return f"_:{labels}n{local}"
        if prefix not in prefixes:
            raise ModelError(f"Turtle: unknown prefix {prefix!r}")
        return prefixes[prefix] + local

    def term() -> tuple[str, str | None]:
        nonlocal i
        kind, value, _ = items[i]
        i += 1
        if kind == "iri":
            return value[1:-1], None
        if kind == "name":
            return (value, XSD + "boolean") if value in ("true", "false") else (full(value), None)
        if kind == "number":
            return value, XSD + ("decimal" if "." in value else "integer")
        if kind in ("text", "long"):
            literal = unescape(value[3:-3] if kind == "long" else value[1:-1])
            datatype = XSD + "string"
            if i < len(items) and items[i][0] == "type":
                i += 1
                datatype = term()[0]
            elif i < len(items) and items[i][0] == "lang":
                i += 1
            return literal, datatype
        if value == "[":
            node = f"_:{scope}b{next(blanks)}"
            predicates(node, "]")
            i += 1
            return node, None
        raise ModelError(f"Turtle: unexpected {value!r}")

    def predicates(subject: str, end: str) -> None:
        nonlocal i
        while items[i][1] != end:
            p = term()[0]
            while True:
                o, datatype = term()
                out.append((subject, p, o, datatype))
                if items[i][1] != ",":
                    break
                i += 1
            while items[i][1] == ";":
                i += 1

    while i < len(items):
        if items[i][0] == "prefix":
            name, iri = items[i][2]
            prefixes[name] = iri
            i += 1
            continue
        subject = term()[0]
        predicates(subject, ".")
        i += 1
    return out


def triples(spark: SparkSession, text: str) -> DataFrame:
    """A graph file is small and read on the driver."""
    return spark.createDataFrame(read_turtle(text), "s string, p string, o string, datatype string")


def observed_moves(t: DataFrame) -> DataFrame:
    """Moves from sensor observations: the basic graph pattern as self-joins, by result time."""
    sosa, geo = "http://www.w3.org/ns/sosa/", "http://www.opengis.net/ont/geosparql#"
    of = lambda p, name: t.filter(F.col("p") == p).select("s", F.col("o").alias(name))
    j = of(sosa + "hasFeatureOfInterest", "subject").join(of(sosa + "resultTime", "time"), "s").join(of(sosa + "hasResult", "result"), "s")
    j = j.join(of(geo + "asWKT", "wkt").withColumnRenamed("s", "result"), "result")
    from ..functions.text import iri_local_name
    from ..functions.wkt import coordinates, crs_of

    point = F.get(coordinates("wkt"), F.lit(0))
    out = j.select(iri_local_name(F.col("subject")).alias("subject"), F.to_timestamp("time").alias("ts"), point["x"].alias("x"), point["y"].alias("y"), crs_of("wkt").alias("crs"))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("subject").orderBy("ts")).cast("long") - 1)


# -- results and manifests ------------------------------------------------------------------------------

PREDICATES = ("inside", "coveredBy", "disjoint", "onBoundary")


def sparql_results(texts: DataFrame) -> DataFrame:
    """texts(value): result documents as (subject, region, four booleans); names are IRIs' decoded last parts. Malformed rows and repeats fail."""
    cell = "struct<value:string>"
    fields = ", ".join(f"{n}:{cell}" for n in ("subject", "region", *PREDICATES))
    rows = texts.select(F.explode(F.from_json("value", f"results struct<bindings:array<struct<{fields}>>>")["results"]["bindings"]).alias("b"))

    def name(c: str) -> Column:
        # by cuts: an unanchored pattern tries every place of every IRI
        path = F.substring_index(F.substring_index(F.col(f"b.{c}.value"), "?", 1), "#", 1)
        return F.url_decode(F.substring_index(F.when(path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path), "/", -1))

    truth = lambda c: F.when(F.col(f"b.{c}.value").isin("true", "false", "1", "0"), F.col(f"b.{c}.value").isin("true", "1"))
    out = rows.select(name("subject").alias("subject"), name("region").alias("region"), *[truth(c).alias(c) for c in PREDICATES])
    return no_repeats(complete(out), "subject", "region")


def database_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows subject, region and four t/f flags."""
    raw = spark.read.csv(path, schema="subject string, region string, " + ", ".join(f"{c} string" for c in PREDICATES))
    return no_repeats(complete(raw.select("subject", "region", *[F.when(F.col(c).isin("t", "f"), F.col(c) == "t").alias(c) for c in PREDICATES])), "subject", "region")


def complete(df: DataFrame) -> DataFrame:
    """Fails on rows with a missing value."""
    ok = F.lit(True)
    for c in df.columns:
        ok = ok & F.col(c).isNotNull()
    first = df.columns[0]
    return df.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit("malformed row"))))


def no_repeats(df: DataFrame, *keys: str) -> DataFrame:
    """Fails on a second row of a key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    first = keys[0]
    return df.withColumn("n", n).withColumn(first, F.when(F.col("n") == 1, F.col(first)).otherwise(F.raise_error(F.lit("repeated pair")))).drop("n")


def manifest(texts: DataFrame) -> DataFrame:
    """texts(value): {"classes": {class: [ids]}} as (class, id)."""
    m = texts.select(F.explode(F.map_entries(F.from_json("value", "classes map<string, array<string>>")["classes"])).alias("e"))
    return m.select(F.col("e.key").alias("class"), F.explode("e.value").alias("id"))


def bindings(texts: DataFrame) -> DataFrame:
    """texts(value): a JSON binding each, of what a chart, a policy and a model should say alike."""
    fields = "subject string, region string, trigger string, fromState string, toState string, durationSeconds double, states array<string>"
    b = texts.select(F.from_json("value", fields).alias("b")).select("b.*")
    return complete(b.select("subject", "region", "trigger", F.col("fromState").alias("from_state"), F.col("toState").alias("to_state"), F.bround(F.col("durationSeconds") * 1e6).cast("long").alias("duration_us"), "states"))


def match_register(ids: DataFrame, register: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """ids(id) against register(iri) by local name: unmatched, corroborated or ambiguous."""
    from ..functions.text import iri_local_name

    local = F.regexp_replace(F.col("id"), r"^.*[/#]", "")
    for a, b in (aliases or {}).items():
        local = F.when(F.col("id") == a, b).otherwise(local)
    found = register.groupBy(iri_local_name(F.col("iri")).alias("local")).agg(F.sort_array(F.collect_set("iri")).alias("iris"))
    n = F.coalesce(F.size("iris"), F.lit(0))
    status = F.when(n <= 0, "unmatched").when(n == 1, "corroborated").otherwise("ambiguous")
    return ids.withColumn("local", local).join(found, "local", "left").select("id", "local", status.alias("status"))


def content_hash(spark: SparkSession, path: str, *, normalise_line_ends: bool = False) -> DataFrame:
    """path, sha256 of files."""
    body = F.col("content")
    if normalise_line_ends:
        # on hexadecimal digits, so bytes that are no UTF-8 stay; a pair begins at an even place only
        body = F.unhex(F.regexp_replace(F.hex("content"), r"\G((?:(?!0D0A)..)*+)0D0A", "$10A"))
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(body.cast("binary"), 256).alias("sha256"))
