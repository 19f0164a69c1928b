"""Offline evaluation of ranking and the search for better weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanmoa.operators.search import HangulIndex
from hanmoa.operators.similarity import SimilarityOptions, Weights, candidates, component_columns, looked_at, score_columns, variants

# Factors tried on the core weights and on the bonuses, ranges of random factors, default seed, generator's constants.
CORE_FACTORS, BONUS_FACTORS = (0.65, 0.8, 1.0, 1.2, 1.35), (0.5, 0.8, 1.0, 1.2, 1.5)
CORE_RANGE, BONUS_RANGE = (0.5, 1.5), (0.2, 2.0)
SEED = 0xD0C0_2026_0219_0001
MULTIPLIER, MODULUS = 6364136223846793005, 2**64
CORE, BONUS = ("edit", "jaccard", "keyboard", "jamo"), ("prefix", "exact")


def uniforms(seed: int) -> Iterator[float]:
    """A linear congruential generator's numbers from 0 up to 1."""
    state = seed
    while True:
        state = (state * MULTIPLIER + 1) % MODULUS
        yield (state >> 11) / 2**53


def weight_candidates(base: Weights, n: int, seed: int = SEED, attempts: int = 10_000) -> list[Weights]:
    """At most n distinct weights: the base, each core weight scaled, all of them, the bonuses, then random ones.

    Distinct to four decimals. If the limits let no more differ, it ends after so many attempts.
    """

    def scaled(names: tuple[str, ...], factor: float) -> Weights:
        return replace(base, **{k: getattr(base, k) * factor for k in names})

    def proposals() -> Iterator[Weights]:
        yield base
        for factor in CORE_FACTORS:
            for name in CORE:
                yield scaled((name,), factor)
            yield scaled(CORE, factor)
        for factor in BONUS_FACTORS:
            yield scaled(BONUS, factor)
        draw = uniforms(seed)
        for _ in range(attempts):
            yield Weights(**{f.name: getattr(base, f.name) * (low + (high - low) * next(draw)) for f in fields(base) for low, high in [CORE_RANGE if f.name in CORE else BONUS_RANGE]})

    out: dict[str, Weights] = {}
    for w in proposals():
        if len(out) >= n:
            break
        w = w.sanitized()
        out.setdefault("|".join(f"{getattr(w, f.name):.4f}" for f in fields(w)), w)
    return list(out.values())


@dataclass(frozen=True)
class Metrics:
    samples: int = 0
    top1: float = 0.0
    top3: float = 0.0
    mrr: float = 0.0
    hit_rate: float = 0.0

    @property
    def objective(self) -> float:
        return self.mrr * 0.5 + self.top1 * 0.35 + self.top3 * 0.15


@dataclass(frozen=True)
class TuningReport:
    best: Weights
    baseline: Metrics
    best_metrics: Metrics
    evaluated: int
    leaderboard: list[tuple[Weights, Metrics]] = field(default_factory=list)


def first_items(index: HangulIndex, options: SimilarityOptions) -> DataFrame:
    """(raw_key, idx, copy): of the items of one name the first, as many as can be among the best."""
    items = index.table.select("raw_key", "idx").where("raw_key is not null")
    if scan := index.policy.max_candidate_scan:
        items = items.orderBy("idx").limit(scan)
    copy = F.row_number().over(Window.partitionBy("raw_key").orderBy("idx"))
    return items.withColumn("copy", copy).where(F.col("copy") <= max(1, options.limit))


def evaluate(index: HangulIndex, samples: DataFrame, weights: list[Weights], options: SimilarityOptions) -> list[Metrics]:
    """Metrics of samples (query, expected_key) under each of some weights.

    What is equal is worked out once: samples are counted, and where all items are scored, a name is scored for all its items.
    Components don't depend on weights: they are worked out once by query, form and name, and only then meet the weights.
    """
    spark = samples.sparkSession
    counted = samples.groupBy("query", "expected_key").agg(F.count(F.lit(1)).alias("times")).cache()
    n = counted.agg(F.sum("times")).first()[0]
    if not n:
        counted.unpersist()
        return [Metrics()] * len(weights)
    copies = first_items(index, options).cache() if index.posted is None and looked_at(index, options) <= options.cap else None
    if copies is not None:
        names = copies.where("copy = 1").select("raw_key", "idx").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # names are few bytes and much work
        index = HangulIndex(names, "raw_key", "idx", replace(index.policy, strategy="lazy", warm_up=False, max_candidate_scan=None))
    queries = counted.select(F.col("query").alias("qid"), "query").distinct()
    pairs = candidates(variants(queries, index, options.layouts), index, options).where("strong or coarse >= 0.05")
    for more in component_columns(options.ngram):
        pairs = pairs.withColumns(more)
    kept = pairs.select("qid", "vpos", "idx", "raw_key", "text_l", "text_r", "sim_edit", "sim_jaccard", "sim_keyboard", "sim_jamo", "is_exact", "is_prefix")
    fits = [f.name for f in fields(Weights)]
    table = spark.createDataFrame([(i, *(float(getattr(w, k)) for k in fits)) for i, w in enumerate(weights)], "wid int, " + ", ".join(f"w_{k} double" for k in fits))
    tried = kept.join(F.broadcast(table), how="cross")
    for more in score_columns({k: F.col(f"w_{k}") for k in fits}):
        tried = tried.withColumns(more)

    def best(rows: DataFrame, *of: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "idx"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= max(1, options.limit))

    formed = best(tried.where(F.col("score") >= options.minimum), "wid", "qid", "vpos")  # what is among the best is so by one of its forms
    found = best(formed.groupBy("wid", "qid", "idx", "raw_key").agg(F.max("score").alias("score")), "wid", "qid")
    if copies is not None:
        found = best(found.select("wid", "qid", "raw_key", "score").join(copies, "raw_key"), "wid", "qid")
    wanted = counted.select(F.col("query").alias("qid"), F.col("expected_key").alias("raw_key"), "times")
    hit = found.join(wanted, ["qid", "raw_key"]).groupBy("wid", "qid", "raw_key", "times").agg(F.min("rank").alias("rank"))
    times = lambda rows: F.sum(F.when(rows, F.col("times")).otherwise(0))
    sums = hit.groupBy("wid").agg(times(F.col("rank") == 1).alias("a"), times(F.col("rank") <= 3).alias("b"), F.sum(F.col("times") / F.col("rank")).alias("c"), F.sum("times").alias("d"))
    got = {r["wid"]: r for r in sums.collect()}  # a row for each weight
    for held in (counted, copies):
        if held is not None:
            held.unpersist()
    return [Metrics(n, *(got[i][k] / n for k in "abcd")) if i in got else Metrics(n) for i in range(len(weights))]


def tune(index: HangulIndex, samples: DataFrame, base: Weights | None = None, options: SimilarityOptions | None = None, n: int = 80, leaderboard: int = 10, seed: int = SEED) -> TuningReport:
    """The best of n candidates by objective, then reciprocal rank, top 1 and top 3; the earlier wins ties."""
    base = base or Weights()
    options = options or SimilarityOptions(limit=5, candidates=300, minimum=0.0)
    tried = weight_candidates(base, max(1, n), seed)
    found = evaluate(index, samples, [base, *tried], options)
    order = sorted(zip(tried, found[1:], strict=True), key=lambda x: (-x[1].objective, -x[1].mrr, -x[1].top1, -x[1].top3))
    return TuningReport(order[0][0], found[0], order[0][1], len(tried), order[: max(1, leaderboard)])
