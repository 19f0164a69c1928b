"""Feedback events, their retention and pair statistics, and the assignment of users to weights.

Events have query, selected_key, ts, outcome, locale and ``seq``, the order in which they came in.
"""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmoa.functions.jamo import trim_space

# Fixed values of the FNV-1a hash of 64 bits.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211


def retained(events: DataFrame, now: Column, ttl_seconds: int = 30 * 86400, max_events: int = 10_000) -> DataFrame:
    """Events not older than the time to live, of these the last ``max_events`` that came in."""
    fresh = events.where(F.col("ts") >= now - F.make_interval(secs=F.lit(max(60, ttl_seconds))))
    return fresh.orderBy(F.desc("seq")).limit(max(1, max_events))


EVENTS = "query string, selected_key string, ts timestamp, outcome string, locale string, seq long"
# What became of a suggestion.
OUTCOMES = ("acceptedSuggestion", "clickedResult", "noSuggestion", "unknown")


def record(spark: SparkSession, path: str, events: list[tuple[str, str | None, datetime, str, str | None]]) -> None:
    """Appends events (query, selected_key, ts, outcome, locale) to the log at ``path``, in the order given.

    ``seq`` goes by the time of the call, so that later calls come later; an unknown outcome is ``unknown``.
    """
    base = time.time_ns()
    rows = [(q, k, ts, o if o in OUTCOMES else "unknown", locale, base + i) for i, (q, k, ts, o, locale) in enumerate(events)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def dropped(events: DataFrame, now: Column, ttl_seconds: int = 30 * 86400, max_events: int = 10_000) -> DataFrame:
    """One row: how many events ``retained`` drops for their age, and of the others for their number."""
    fresh = F.count_if(F.col("ts") >= now - F.make_interval(secs=F.lit(max(60, ttl_seconds))))
    return events.agg((F.count(F.lit(1)) - fresh).alias("dropped_by_ttl"), F.greatest(F.lit(0), fresh - max(1, max_events)).cast("long").alias("dropped_by_size"))


def pair_stats(events: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(query, selected_key, occurrences, last_seen), trimmed and not empty, most frequent and latest first."""
    out = (
        events.select(trim_space(F.col("query")).alias("query"), trim_space(F.col("selected_key")).alias("selected_key"), "ts")
        .where("query != '' and selected_key != ''")
        .groupBy("query", "selected_key")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.max("ts").alias("last_seen"))
    )
    if max_pairs is None:
        return out
    return out.orderBy(F.desc("occurrences"), F.desc("last_seen"), "query", "selected_key").limit(max(1, max_pairs))


def training_samples(events: DataFrame, max_samples: int = 5000, min_occurrences: int = 2) -> DataFrame:
    """(query, expected_key) of pairs seen often enough."""
    n = max(1, max_samples)
    some = pair_stats(events, 2 * n).where(F.col("occurrences") >= max(1, min_occurrences))
    ordered = some.orderBy(F.desc("occurrences"), F.desc("last_seen"), "query", "selected_key").limit(n)
    return ordered.select("query", F.col("selected_key").alias("expected_key"))


def summary(events: DataFrame, max_pairs: int = 20) -> DataFrame:
    """One row: total_events, distinct_queries and the top pairs."""
    top = pair_stats(events, max_pairs).agg(F.sort_array(F.collect_list(F.struct("occurrences", "last_seen", "query", "selected_key")), asc=False).alias("top_pairs"))
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.countDistinct("query").alias("distinct_queries")).join(F.broadcast(top), how="cross")


def summary_json(events: DataFrame, max_pairs: int = 20) -> DataFrame:
    """The summary as one JSON document."""
    return summary(events, max_pairs).select(F.to_json(F.struct("distinct_queries", "top_pairs", "total_events")).alias("json"))


def fnv1a(s: Column) -> Column:
    """FNV-1a of 64 bits of a text's UTF-8 bytes, as a decimal."""
    two64 = F.lit(str(2**64)).cast("decimal(38,0)")
    hexed = F.hex(s.cast("binary"))
    place = F.when(F.length(hexed) > 0, F.sequence(F.lit(0), F.length(hexed) - 2, F.lit(2))).otherwise(F.lit([]).cast("array<int>"))
    byte = F.transform(place, lambda i: F.conv(F.substring(hexed, i + 1, F.lit(2)), 16, 10).cast("long"))

    def step(acc: Column, b: Column) -> Column:
        # xor touches the lowest byte only; the prime is 2^40 + 435, so that no product passes 38 digits
        low = F.pmod(acc, F.lit("256").cast("decimal(38,0)")).cast("long")
        mixed = (acc - low.cast("decimal(38,0)") + low.bitwiseXOR(b).cast("decimal(38,0)")).cast("decimal(20,0)")
        tail = F.pmod(mixed, F.lit(str(2**24)).cast("decimal(20,0)")).cast("decimal(8,0)")
        high = tail * F.lit(str(2**40)).cast("decimal(13,0)")
        return F.pmod((high + mixed * F.lit(str(FNV_PRIME - 2**40)).cast("decimal(3,0)")).cast("decimal(38,0)"), two64).cast("decimal(38,0)")

    return F.aggregate(byte, F.lit(str(FNV_BASIS)).cast("decimal(38,0)"), step)


def ab_bucket(user: Column, salt: str, ratio: float, enabled: bool = True, has_treatment: bool = True, forced: str | None = None) -> Column:
    """control or treatment of each user: forced, by policy, or by a hash of salt and user under the ratio."""
    if forced is not None:
        return F.lit("treatment" if forced == "treatment" and has_treatment else "control")
    ratio = min(1.0, max(0.0, ratio))
    if not enabled or not has_treatment or ratio <= 0:
        return F.lit("control")
    if ratio >= 1:
        return F.lit("treatment")
    place = F.pmod(fnv1a(F.concat(F.lit(salt + "|"), user)), F.lit(10_000).cast("decimal(38,0)")).cast("double") / 10_000.0
    return F.when(user.isNotNull() & (user != "") & (place < ratio), "treatment").otherwise("control")


def telemetry(calls: DataFrame) -> DataFrame:
    """One row of a call log (kind, is_async, outcome, cache_hit, returned, latency_ms): counts and mean latencies."""
    out = []
    for kind in ("search", "similar", "explain"):
        own = F.col("kind") == kind
        out.append(F.count_if(own & ~F.col("is_async")).alias(f"sync_{kind}_count"))
        out += [F.count_if(own & F.col("is_async") & (F.col("outcome") == o)).alias(f"async_{kind}_{o}_count") for o in ("success", "cancelled", "failure")]
        for mode, which in (("sync", ~F.col("is_async")), ("async", F.col("is_async"))):
            out.append(F.coalesce(F.avg(F.when(own & which, F.col("latency_ms"))), F.lit(0.0)).alias(f"mean_{mode}_{kind}_ms"))
    out += [F.count_if("cache_hit").alias("cache_hit_count"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned_item_count")]
    return calls.agg(*out)


def debounced(events: DataFrame, by: str, ts: str, milliseconds: int = 250) -> DataFrame:
    """Events after which the same ``by`` is quiet for so long: the latest of each burst."""
    after = F.lead(ts).over(Window.partitionBy(by).orderBy(ts))
    gap = (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= milliseconds)).drop("_gap")


def without_repeats(events: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Events whose value differs from that of the one before of the same ``by``."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(ts))
    return events.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")
