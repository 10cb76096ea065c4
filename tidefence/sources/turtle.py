"""Turtle files read by many tasks.

The writers of this package end each statement with a blank, a full stop and a line feed. No quoted literal holds a raw line feed, so that is where files are parted: Spark's
text source takes it as the line separator and splits large files at any byte, and each record is one statement. Prefixes are statements
too; a first pass collects them, and a prefix must mean the same in all files. Statements are parsed in batches where they were read.

Anonymous nodes are named by a hash of file and statement and their number in it, so a retried task names them alike; labelled ones (``_:x``) are
those of their file. Statements repeated in a file name the same nodes, which says nothing else.

Cases: empty files and comments give no triples. A statement that cannot be read, a prefix that no file declares, or one with two meanings is an error; so is a long literal over several statements.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ModelError
from .documents import read_turtle

TRIPLES = "s string, p string, o string, datatype string"
PREFIX = r"^\s*(?:#[^\n]*\n\s*)*@prefix\s+([\w-]*):\s*<([^>]*)>\s*$"
#: Declarations that the driver will hold.
MOST_PREFIXES = 10_000


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep=" .\n").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("statement"))


def _cleaned(raw: DataFrame) -> DataFrame:
    # what follows the last separator is white space, or a statement with a bare full stop; a pattern that begins with a run of blanks would try each blank of the text
    ended = F.rtrim(F.col("statement"), F.lit(" \t\n\r\f\x0b"))
    bare = F.when(F.endswith(ended, F.lit(".")), F.rtrim(F.substr(ended, F.lit(1), F.length(ended) - 1), F.lit(" \t\n\r\f\x0b"))).otherwise(ended)
    comments = F.when(F.contains("statement", F.lit("#")), F.regexp_replace("statement", r"(?m)^\s*#.*$", "")).otherwise(F.col("statement"))
    return raw.withColumn("statement", bare).filter(comments.rlike(r"\S"))


def statements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, statement (without its full stop) of the files at path."""
    return _cleaned(_raw(spark, path))


def prefixes(found: DataFrame) -> dict[str, str]:
    """The prefixes of all files."""
    declared = found.select(F.regexp_extract("statement", PREFIX, 1).alias("prefix"), F.regexp_extract("statement", PREFIX, 2).alias("iri"), F.col("statement").rlike(PREFIX).alias("is"))
    rows = declared.filter("is").select("prefix", "iri").distinct().limit(MOST_PREFIXES + 1).collect()
    if len(rows) > MOST_PREFIXES:
        raise ModelError(f"more than {MOST_PREFIXES} prefixes")
    out: dict[str, str] = {}
    for prefix, iri in rows:
        if out.setdefault(prefix, iri) != iri:
            raise ModelError(f"prefix {prefix!r} has two meanings")
    return out


def turtle_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """s, p, o, datatype of Turtle files."""
    found = statements(spark, path)
    # most statements say nothing of prefixes; what holds no such word is left out before any pattern is tried
    known = prefixes(_cleaned(_raw(spark, path).filter(F.contains("statement", F.lit("@prefix")))))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for file, statement, scope in batch.itertuples(index=False):
                rows += read_turtle(statement + " .", known, scope=scope, labels=file)
            yield pd.DataFrame(rows, columns=["s", "p", "o", "datatype"], dtype=object)

    scope = F.lower(F.hex(F.xxhash64("file", "statement")))
    rest = found.filter(~(F.contains("statement", F.lit("@prefix")) & F.col("statement").rlike(PREFIX))).select(F.lower(F.hex(F.xxhash64("file"))).alias("file"), "statement", scope.alias("scope"))
    return rest.mapInPandas(parse, TRIPLES)


def write_turtle(blocks: DataFrame, path: str, header: str) -> None:
    """blocks(text): statements that end with a blank, a full stop and a line feed, written as they are dealt; the prefixes of header stand in a file of their own."""
    from ..plans.rdf import check_statements

    head = blocks.sparkSession.range(1).select(F.lit(header).alias("text"))
    checked = check_statements(blocks.select("text"))
    head.unionByName(checked).select(F.regexp_replace("text", r"\n\z", "")).write.text(path)
