"""A cleaning pipeline over ``documents``: language, toxicity, near-duplicates, test passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All stages but the last return the
columns of documents; the last returns packed pieces.

Null and empty texts have no letters and go in the first stage; called alone, every other stage keeps them (toxicity scores them as clean, near-duplicates
keep one of them, packing gives each one end token). Very long texts are read whole. Rows without an id stay until packed; of rows that repeat an id in
one group of near-duplicates, one stays. Empty tables give empty tables, and columns of any other name are carried along.

Every stage lowers the session's limit of bytes in a batch to Python workers (``small_batches``), which a stage of long texts needs to stay in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefence.llm import decontamination, language_id, near_duplicates, packing, toxicity
from tidefence.llm.common import WRITTEN, discard, small_batches, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and texts whose code length in every learned language is over the limit that learned documents set."""
    small_batches(spark)
    return language_id.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels are those of the table; without labels of both classes nothing goes."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays. Shingles have five words; groups are linked by a similarity of 0.8 or more; at most 3 of 64 differing bits make candidates."""
    small_batches(spark)
    return near_duplicates.keep_one(docs, n=5, most=3, similarity=0.8)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words that a test item has, and whole shorter items, are cut out of the texts; a document goes if they are over half of its words."""
    small_batches(spark)
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in sequences of at most 2048 tokens; repeated rows are packed as often as they come."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and reread; what a stage stored on its way, and the result it read, are deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(WRITTEN)
        last = WRITTEN[-1] if name != STAGES[0][0] else None
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(spark, WRITTEN[before:-1] + ([last] if last else []))
    return docs
