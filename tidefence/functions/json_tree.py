"""Every node of JSON documents, to any depth, by exploding variants round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.sinks import stored

#: Names that a path writes without quotes.
PLAIN = r"^[A-Za-z_][A-Za-z0-9_]*$"


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, parent, name, position, kind, text, depth of every node of docs(key, text), the root included (``$``, depth 0).

    Children of a whole level are exploded at once and stored, so the number of rounds is the depth of the deepest document and no document is walked in one task's
    memory. Kinds are object, array, string, number, boolean and null; text is a value's text (null for objects, arrays and null). Names other than plain ones are
    quoted in paths. Null texts have no nodes; a text that is no JSON is an error; repeated keys give repeated nodes. Other columns are ignored.
    """
    spark = docs.sparkSession
    level = docs.filter(F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("position"), F.parse_json(text).alias("v")
    )
    level, depth, found = stored(level, "nodes-0"), 0, []
    while True:
        kind = F.schema_of_variant("v")
        kind = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
        named = level.withColumn("kind", kind)
        value = F.when(F.col("kind").isin("string", "number", "boolean"), F.col("v").try_cast("string"))
        found.append(named.select("key", "path", "parent", "name", "position", "kind", value.alias("text"), F.lit(depth).alias("depth")))
        inner = named.filter(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        inner.createOrReplaceTempView("_json_level")
        children = spark.sql("SELECT p.key, p.path AS parent, p.kind AS of, c.pos AS position, c.key AS name, c.value AS v FROM _json_level p, LATERAL variant_explode(p.v) AS c")
        spark.catalog.dropTempView("_json_level")
        member = F.when(F.col("name").rlike(PLAIN), F.concat(F.lit("."), F.col("name"))).otherwise(F.concat(F.lit('."'), F.col("name"), F.lit('"')))
        path = F.concat("parent", F.when(F.col("of") == "array", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("]"))).otherwise(member))
        depth += 1
        level = stored(children.select("key", path.alias("path"), "parent", "name", F.when(F.col("of") == "array", F.col("position")).alias("position"), "v"), f"nodes-{depth}")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("key", key)
