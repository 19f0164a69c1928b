"""Consistent-hash ring with virtual nodes and bounded loads.

A row's key has a place on the ring and belongs to the first virtual node clockwise. Each shard has a
capacity; where a shard is full, the keys of its arcs that come last continue clockwise to the next virtual
node whose shard has room. Work on rows is one narrow shuffle by arc; the walk itself runs on counts by arc,
which are at most shards x virtual nodes however many rows there are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending signed 64-bit places of all virtual nodes and the shard of each."""
    at = [
        (int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    ]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int32)


def capacities(rows: int, shards: int, epsilon: float) -> list[int]:
    """With epsilon 0 the capacities add up to ``rows`` and are at most one apart; else ceil((1+epsilon) mean) each."""
    if epsilon:
        return [math.ceil((1 + epsilon) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: np.ndarray, owner: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deals the ranks of each arc to shards: (arc, first rank, end rank, shard, slot of the first rank).

    At first every shard takes from its own arcs, in ring order; then what is left over moves on by one
    virtual node a round, all arcs together, and each shard takes what it still has room for.
    """
    room, used, out = list(capacity), [0] * len(capacity), []

    def take(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            out.append((arc, low, low + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return low + n

    over = []
    for arc, n in enumerate(counts.tolist()):
        if n and (low := take(arc, 0, n, int(owner[arc]))) < n:
            over.append((arc, low, n))
    step = 0
    while over:
        step += 1
        left = []
        for arc, low, high in over:
            if (low := take(arc, low, high, int(owner[(arc + step) % len(owner)]))) < high:
                left.append((arc, low, high))
        over = left
    return out


def shard_rows(
    docs: DataFrame, shards: int = 16, vnodes: int = 512, epsilon: float = 0.0, key: str = "doc_id"
) -> DataFrame:
    """Puts every row into a shard. Returns doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 is that of the bytes (null: of none); slot
    counts a shard's rows from 0 without gaps. With epsilon 0 the shards' row counts are at most one apart;
    with more, a shard holds at most ceil((1+epsilon) mean) rows and fewer rows move when shards are added.
    Null keys share one place on the ring; repeated rows are dealt one by one; an empty table gives no rows.
    Columns other than doc_id and text aren't read. Rows with one and the same key are sorted in one task.
    """
    spark = docs.sparkSession
    places, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, h.to_numpy()) % len(places)).astype(np.int32))

    placed = docs.select(
        F.col(key).alias("doc_id"), F.col("text").cast("binary").alias("bytes"), F.xxhash64(F.col(key)).alias("place")
    ).withColumn("arc", arc_of("place"))
    counts = np.zeros(len(places), dtype=np.int64)
    for r in placed.groupBy("arc").count().collect():  # at most shards x vnodes rows
        counts[r["arc"]] = r["count"]
    dealt = walk(counts, owner, capacities(int(counts.sum()), shards, epsilon))
    table = spark.createDataFrame(
        pd.DataFrame(dealt, columns=["arc", "low", "high", "shard", "base"]).astype(
            {"arc": "int32", "low": "int64", "high": "int64", "shard": "int32", "base": "int64"}
        ),
        "arc int, low long, high long, shard int, base long",
    )
    order = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = placed.select(
        "doc_id",
        "arc",
        "place",
        (F.coalesce(F.octet_length("bytes"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32("bytes"), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("rank", F.row_number().over(order).cast("long") - 1)
    t = F.broadcast(table).alias("t")  # at most shards x shards x vnodes rows
    return ranked.alias("r").join(
        t, (F.col("r.arc") == F.col("t.arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"))
