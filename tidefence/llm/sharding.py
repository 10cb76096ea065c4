"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard stands on the ring at several virtual nodes (points from a hash of shard and node number, so a shard's
points never depend on how many shards there are). The ring is cut into a fixed number of cells; a text's hash gives
its cell, so equal texts share one, and the cell belongs to the next virtual node clockwise. No shard may hold more than
(1 + slack) times the mean bytes: a cell whose home is full continues clockwise to the first shard with room. Larger
cells are seated first. Where no shard has room, the emptiest takes the cell.

Only the histogram of bytes by cell (at most ``cells`` rows) reaches the driver. A cell that fits no shard, by the bound on bytes, is split
into up to 256 parts by a hash of the id, which are seated one by one, so a group of copies larger than a shard's room fills its home first and then
flows on; every other cell, and so every group of equal texts that fits, stays whole. Rows are numbered inside cells and offsets are added, so no task
sorts a shard; a cell with over 1/256 of all rows (there are fewer than 256), however few its bytes, is numbered in 256 parts.

The law is ``bytes``: sizes nearly equal. Adding a shard moves the cells that its points take over and what the smaller bound
pushes on; see tests.

Cases: null texts have size 1. Null ids, repeated rows and ties are ordered by id, size and checksum; rows that agree in all three
are interchangeable. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, stored

SPLIT = 256


def ring_of(shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) * cells >> 32, s) for s in range(shards) for v in range(virtual_nodes))


def bound_of(total: int, shards: int, slack: float) -> float:
    """The bytes that a shard may hold."""
    return -(-total // shards) * (1 + slack)


def seat(loads: list[tuple[int, int, int]], shards: int, virtual_nodes: int, cells: int, slack: float) -> list[int]:
    """loads: (cell, part, bytes). The shard of each."""
    ring = ring_of(shards, virtual_nodes, cells)
    points = [p for p, _ in ring]
    # the order in which shards follow each virtual node
    after = []
    for i in range(len(ring)):
        seen: dict[int, None] = {}
        for k in range(len(ring)):
            seen.setdefault(ring[(i + k) % len(ring)][1])
            if len(seen) == shards:
                break
        after.append(list(seen))
    bound = bound_of(sum(b for _, _, b in loads), shards, slack)
    filled, out = [0] * shards, [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i][2], loads[i][0], loads[i][1])):
        cell, _, size = loads[i]
        home = bisect_left(points, cell) % len(ring)
        shard = next((s for s in after[home] if filled[s] + size <= bound), None)
        if shard is None:
            shard = min(range(shards), key=lambda s: (filled[s], s))
        filled[shard] += size
        out[i] = shard
    return out


def shard(docs: DataFrame, *, shards: int = 16, virtual_nodes: int = 64, cells: int = 16_384, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(cells)).cast("int").alias("cell"),
    )
    rows = stored(rows, "sizes")
    by_cell = {r["cell"]: (r["bytes"], r["n"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    total, every = sum(b for b, _ in by_cell.values()), sum(n for _, n in by_cell.values())
    bound = bound_of(total, shards, slack)
    large = {c for c, (b, n) in by_cell.items() if b > bound and n > 1}
    parted = sorted(large | {c for c, (_, n) in by_cell.items() if n * SPLIT > every and n > 1})
    part = F.when(F.col("cell").isin(parted), F.pmod(F.xxhash64("doc_id", "size"), F.lit(SPLIT))).otherwise(0) if parted else F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    loads = [(c, 0, b, n) for c, (b, n) in by_cell.items() if c not in set(parted)]
    if parted:
        split = rows.filter(F.col("cell").isin(parted)).groupBy("cell", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        loads += [(r["cell"], r["part"], r["bytes"], r["n"]) for r in split.collect()]
    loads.sort()
    # parts of a cell that fits are seated as one
    seated = [(c, p, b) for c, p, b, _ in loads if c in large] + [(c, 0, b) for c, (b, _) in by_cell.items() if c not in large]
    seat_of = dict(zip([(c, p) for c, p, _ in seated], seat(seated, shards, virtual_nodes, cells, slack), strict=True))
    seats = [seat_of[c, p if c in large else 0] for c, p, _, _ in loads]
    begins, filled = [], [0] * shards
    for (_, _, _, n), s in zip(loads, seats, strict=True):
        begins.append(filled[s])
        filled[s] += n
    # at most cells + 256 * 256 rows by construction
    flat = [v for (c, p, _, _), s, b in zip(loads, seats, begins, strict=True) for v in (c * SPLIT + p, s, b)]
    wide = literal_rows(spark, flat or [-1, 0, 0], "v", "i")
    plan = wide.groupBy((F.col("i") / 3).cast("int").alias("k")).agg(*[F.max(F.when(F.col("i") % 3 == j, F.col("v"))).alias(c) for j, c in enumerate(("place", "shard", "begin"))])
    plan = plan.select("place", F.col("shard").cast("int"), "begin")
    rows = rows.withColumn("place", (F.col("cell") * SPLIT + F.col("part")).cast("long"))
    inside = Window.partitionBy("place").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(plan), "place")
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("nth")).alias("slot"))


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
