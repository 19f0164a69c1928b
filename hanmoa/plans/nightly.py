"""The nightly job: from feedback to samples, from samples to weights, from weights to a configuration."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from hanmoa.operators.feedback import training_samples
from hanmoa.operators.search import HangulIndex
from hanmoa.operators.similarity import SimilarityOptions
from hanmoa.operators.tuning import TuningReport, tune
from hanmoa.sources.deployment import Config, MissingEnvironment, with_weights

SEED = 0xA192_2026_0225_0001  # fixed value


class InsufficientSamples(ValueError):
    pass


@dataclass(frozen=True)
class NightlyResult:
    samples: int
    report: TuningReport
    config: Config


def run_nightly(
    index: HangulIndex, events: DataFrame, config: Config, environment: str = "staging", bucket: str = "treatment", min_occurrences: int = 2,
    max_samples: int = 5000, candidates: int = 80, prefix: str = "nightly", seed: int = SEED, now: datetime | None = None,
) -> NightlyResult:
    """Tunes a bucket's weights on pairs that users chose often enough and returns the new configuration."""
    good = config.sanitized()
    if environment not in good.environments:
        raise MissingEnvironment(environment)
    samples = training_samples(events, max_samples, min_occurrences).cache()
    n = samples.count()
    if not n:
        raise InsufficientSamples("no pair was chosen often enough")
    e = good.environments[environment]
    base = e.control if bucket == "control" else e.treatment or e.control
    report = tune(index, samples, base, SimilarityOptions(limit=5, candidates=300, minimum=0.0), candidates, seed=seed)
    samples.unpersist()
    now = now or datetime.now(UTC)
    model = f"{prefix}-{environment}-{now.astimezone(UTC):%Y%m%d-%H%M%S}-from-{good.model}"
    return NightlyResult(n, report, with_weights(good, environment, bucket, report.best, model, now))
