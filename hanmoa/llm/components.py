"""Connected components of a table of links: in one task if the links, by their count, are few, else by large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import stored


#: Links, of 16 bytes each, that one task may hold.
FEW = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the whole table to (id, component), by union and find."""
    above: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = above.get(up, up)
            i = up
        return i

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = above[min(a, b)] = min(a, b)
    found = [(i, t) for i in above if (t := top(i)) != i]
    yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["id", "component"])


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, owner: str, most: int | None = None) -> DataFrame:
    """Links (a long, b long) to (id, component): each linked id but the smallest of its component, and that one.

    Every round points ids to the smallest neighbour; ids with very many neighbours are joined, never gathered.
    Each round is a stored table. ``most`` is how many links there are at most, if that is known. Null ends and links of an id to itself count for nothing.
    """
    edges = stored(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        owner,
        rows=most,
    )
    was = _digest(edges)
    if was[0] <= FEW:
        return stored(edges.coalesce(1).mapInArrow(_joined, "id long, component long"), owner)
    while True:
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where(F.col("a") > F.col("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.where(F.col("a") != F.col("b")).distinct(), owner)
        now = _digest(edges)
        if now == was:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        was = now
