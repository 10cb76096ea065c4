"""Importance resampling of documents towards a target, by hashed features and exact integer scores.

A text's features are its runs of 1 to ``longest`` consecutive words (A-Z lower-cased; runs of 0-9, a-z and non-ASCII characters), repeats
counted. A feature falls into bucket crc32 mod ``buckets``. The gain of a bucket is how much more often the target has it than the documents, in
thousandths of a logarithm; the gains are one array of ``buckets`` integers, and a document's weight is the sum of the array's
entries at its features' buckets. The score adds Gumbel noise that depends on the document's id alone, so the highest scores are a draw
without replacement in proportion to the weights' exponentials.

How many documents have each integer score is counted exactly. Suffix sums over these counts, in two levels (at most ``SPANS`` spans of scores, then the
scores of a span), say how many documents stand above a score; scores with fewer above than are to be drawn survive, and a
document's rank is that offset plus its row number by id among the documents of its own score. Nothing is sorted as a whole, and documents below the cutoff score
do not move. As the noise has a density of at most 1/2718 a unit, no score holds a larger share of distinct ids of one weight.

Cases: null and empty texts have no features and weight 0. A null id reads as an empty text in the noise and comes last among ties. Rows that repeat an id are
scored and drawn one by one. Empty tables: no documents give no rows; with an empty target gains follow from the documents alone. Texts of any length are read whole.
Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Spans of scores in the upper level of the suffix sums: bounds the rows of its one task.
SPANS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by a space."""
    if longest == 1:
        return words
    none = F.array().cast("array<string>")

    def of(w: Column) -> Column:
        size = lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        return F.concat(w, *(F.when(F.size(w) >= k, size(k)).otherwise(none) for k in range(2, longest + 1)))

    return F.transform(F.array(words), of).getItem(0)  # words are found once, not once for each run


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of texts(text) fall into it."""
    found = texts.select(F.explode(runs(words_of(F.col("text")), longest)).alias("feature"))
    return found.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000) -> list[int]:
    """The gain of each bucket: floor(1000 ln of the smoothed share in target over that in docs). Two shuffles of at most ``buckets`` rows a task."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("n", c) for x, c in ((docs, "s"), (target, "t")))
    counts = stored(every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0), "bucket-counts")
    all_s, all_t = counts.agg(F.sum("s").cast("double"), F.sum("t").cast("double")).first()
    share = (F.col("t").cast("double") + 1.0) * F.lit(all_s + buckets) / ((F.col("s").cast("double") + 1.0) * F.lit(all_t + buckets))
    rows = counts.select("bucket", F.floor(1000.0 * F.log(share)).cast("long").alias("gain")).collect()
    return [gain for _, gain in sorted(rows)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def scores(docs: DataFrame, gain: list[int], longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of docs(doc_id, text, ...)."""
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # constant: folded into the plan once
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    out = out.select("doc_id", F.size("words").cast("long").alias("n_words"), runs(F.col("words"), longest).alias("features"))
    weight = F.aggregate("features", F.lit(0).cast("long"), lambda total, f: total + F.get(array, bucket(f, len(gain)).cast("int")))
    out = out.select("doc_id", "n_words", F.size("features").cast("long").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def offsets(counts: DataFrame, drawn: int) -> DataFrame:
    """score, above of the scores with fewer than ``drawn`` rows above them, from counts(score, n)."""
    least, most = counts.agg(F.min("score"), F.max("score")).first()
    width = -(-(most - least + 1) // SPANS)
    h = counts.withColumn("span", F.expr(f"(score - ({least}L)) div {width}L"))
    before = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = h.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("span_above"))
    inside = Window.partitionBy("span").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(F.broadcast(spans.filter(F.col("span_above") < drawn)), "span")  # at most SPANS rows
    return h.select("score", (F.col("span_above") + F.sum("n").over(inside) - F.col("n")).alias("above")).filter(F.col("above") < drawn)


def draw(scored: DataFrame, drawn: int, eligible: Column) -> DataFrame:
    """scored(doc_id, n_features, weight, score, ...) with the rank (from 1) of the ``drawn`` highest scores among eligible rows; null for all others."""
    counts = stored(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n")), "score-counts")
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if drawn < 1 or counts.isEmpty():
        return none
    above = stored(offsets(counts, drawn), "score-offsets")
    cutoff = above.agg(F.min("score")).first()[0]
    reach = eligible & (F.col("score") >= cutoff)
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    place = F.col("above") + F.row_number().over(ties)
    top = scored.filter(reach).join(above, "score").withColumn("rank", F.when(place <= drawn, place)).drop("above")
    return top.unionByName(none.filter(~reach))


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; of those with at least min_words words, percent of a hundred are drawn and have a rank."""
    scored = stored(scores(docs, gains(docs, target, longest, buckets), longest, seed), "scores")
    eligible = F.col("n_words") >= min_words
    drawn = percent * scored.filter(eligible).count() // 100
    return draw(scored, drawn, eligible).select("doc_id", "n_features", "weight", "score", "rank")
