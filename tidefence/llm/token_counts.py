"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. With suffix sums over the histogram, documents and tokens at least as
long as any length, totals after truncation to any context limit and exact quantiles need no further pass.

Suffix sums are taken in two levels (lengths, then ranges of 256 lengths), so no task holds the whole histogram.

Cases: null and empty texts have length 0. An empty table gives an empty histogram. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_path, encode_all


def lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for every row of docs."""
    path = tokenizer_path or default_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in encode_all(texts, path)], dtype="int64")

    return docs.select("doc_id", count(F.col("text").cast("string")).alias("n_tokens"))


def suffix_sums(counts: DataFrame, width: int = 256) -> DataFrame:
    """From (n_tokens, n_docs), a row for each length: n_docs, tokens; docs_at_least, tokens_at_least (documents of this length
    or more); truncated_total (all tokens left when every document is cut to this length); share_at_most
    (documents of this length or less, so the q-quantile is the first length with share_at_most >= q)."""
    h = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / width).cast("long"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("tokens").alias("span_tokens"))
    totals = spans.agg(F.sum("span_docs").alias("all_docs"), F.sum("span_tokens").alias("all_tokens"))
    for c in ("docs", "tokens"):
        spans = spans.withColumn(f"{c}_above", F.coalesce(F.sum(f"span_{c}").over(above), F.lit(0)))
    inside = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(spans.drop("span_docs", "span_tokens"), "span").join(F.broadcast(totals))  # totals has one row
    h = h.withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("docs_above"))
    h = h.withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("tokens_above"))
    truncated = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    share = (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
    return h.select("n_tokens", "n_docs", "tokens", "docs_at_least", "tokens_at_least", truncated.alias("truncated_total"), share.alias("share_at_most"))


def histogram(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    counts = lengths(docs, tokenizer_path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    return suffix_sums(stored(counts, "lengths"))


def quantile(h: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of all documents do not exceed."""
    return h.filter(F.col("share_at_most") >= q).agg(F.min("n_tokens")).first()[0]


def truncated_total(h: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to limit, for any limit, from one row of the histogram."""
    all_tokens = h.agg(F.sum("tokens")).first()[0] or 0
    row = h.filter(F.col("n_tokens") >= limit).orderBy("n_tokens").first()
    return all_tokens if row is None else all_tokens - row["tokens_at_least"] + limit * row["docs_at_least"]
