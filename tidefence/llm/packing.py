"""Packing of documents into sequences by bounded-space online best-fit.

A document's ids are its text's ids and then an end id. Documents longer than the capacity are cut into pieces of
the capacity; the first piece takes the remainder. Pieces arrive in the order of a hash. A fixed number of bins is open; they
stand in a bitset by their free space, and a piece goes into the fullest bin that still holds it. When no bin does
and all are open, the fullest is closed. Pieces of the full capacity never wait.

Tokens are made in one pass over the texts without a shuffle; only (id, piece, length, checksum) rows move, to
partitions of about ``pieces_per_partition`` rows. The number of partitions follows from the count of pieces, and
partitions are packed on their own, so memory is one partition of small rows plus the open bins.

Cases: null and empty texts are one piece with the end id only. Repeated rows and ids are packed as often as they come; pieces without an id are packed
too. Ties in the order are broken by id and piece. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_path, encode_all

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``most`` bins of ``capacity``; bit f of the bitset says that a bin with free space f is open."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.made = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            if self.count == self.most:
                # the fullest goes; the new one too, if none is fuller
                fullest = (self.bits & -self.bits).bit_length() - 1
                if left <= fullest:
                    return number, self.capacity - free
                self._take(fullest)
            self.free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, capacity: int, tokenizer_path: str, end_id: int) -> DataFrame:
    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"], tokenizer_path), strict=True):
                ids.append(end_id)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                first = len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    rows.append((doc_id, k, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def best_fit(items: DataFrame, capacity: int, open_bins: int, pieces_per_partition: int) -> DataFrame:
    """items(length, ...) with sequence_id and offset."""
    n = items.count()
    parts = max(1, -(-n // pieces_per_partition))
    order = F.xxhash64("doc_id", "piece", "start")

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in it:
            placed = [bins.place(size) for size in batch["length"].tolist()]
            yield batch.assign(sequence_id=[base + b for b, _ in placed], offset=[o for _, o in placed]).astype({"sequence_id": "int64", "offset": "int64"})

    # by the checksum too, so that rows that repeat an id, or have none, are spread
    spread = items.repartition(parts, "doc_id", "piece", "ids_crc32").sortWithinPartitions(order, "doc_id", "piece", "ids_crc32")
    return spread.mapInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, tokenizer_path: str | None = None, open_bins: int = 1024, pieces_per_partition: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs(doc_id, text, ...)."""
    items = stored(pieces(docs, capacity, tokenizer_path or default_path(), end_id), "pieces")
    return best_fit(items, capacity, open_bins, pieces_per_partition)
