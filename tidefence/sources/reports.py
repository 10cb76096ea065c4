"""Reports of small results, and the loader of stored results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError


def markdown(df: DataFrame, title: str) -> str:
    """A heading and a table. For aggregates: all rows come to the driver."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    for row in df.collect():
        lines.append("| " + " | ".join(f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else "" if v is None else str(v) for v in row) + " |")
    return "\n".join(lines) + "\n"


def write(df: DataFrame, path: str, title: str) -> tuple[Path, Path]:
    """path.md and path.json."""
    md, js = Path(f"{path}.md"), Path(f"{path}.json")
    md.write_text(markdown(df, title), encoding="utf-8")
    js.write_text(json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return md, js


def stored_results(spark: SparkSession, path: str, experiment: str, schema: str) -> DataFrame:
    """Result files, each one JSON document; another experiment's file is an error."""
    df = spark.read.json(path, schema=f"experiment string, {schema}", multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("not a result of this experiment: "), F.coalesce("experiment", F.lit("none"))))
    return df.withColumn("experiment", F.when(F.col("experiment") == experiment, F.col("experiment")).otherwise(wrong))


def rising_list(text: str) -> list[int]:
    """Comma-separated whole numbers, positive and rising."""
    try:
        values = [int(v) for v in text.split(",")]
    except ValueError as e:
        raise ModelError(f"not a list of whole numbers: {text!r}") from e
    if not values or min(values) <= 0 or any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ModelError(f"numbers must be positive and rising: {text!r}")
    return values


def version_of(iri: str) -> str:
    """The version that a register's IRI names."""
    for v in ("1.1", "1.0"):
        if f"/{v}/" in iri or iri.endswith(f"/{v}"):
            return v
    return "unversioned"
