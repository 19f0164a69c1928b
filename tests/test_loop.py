from dataclasses import replace
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from hanmoa.operators import feedback
from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.operators.similarity import Weights
from hanmoa.operators.tuning import uniforms, weight_candidates
from hanmoa.plans.nightly import InsufficientSamples, run_nightly
from hanmoa.sources import deployment as D
from hanmoa.streaming.queries import debounced_stream, search_stream

NOW = datetime(2023, 11, 14, 22, 13, 20)


def test_candidates():
    got = weight_candidates(Weights(), 32, 0xA11CE)
    assert len(got) == 32 and got[0] == Weights() and len(set(got)) == 32
    assert len(weight_candidates(Weights(100, 100, 100, 100, 9, 9), 32, attempts=50)) < 32
    assert all(0 <= x < 1 for x, _ in zip(uniforms(1), range(100), strict=False))


def test_config(tmp_path):
    path = str(tmp_path / "new" / "config.json")
    with pytest.raises(D.MissingFile):
        D.load(path)
    assert D.load_if_exists(path) is None
    dirty = D.Config(0, " ", datetime.fromtimestamp(0, UTC), {"staging": D.Environment(Weights(9, -1), None, D.Policy(True, 4.2, " "))})
    clean = dirty.sanitized()
    assert clean.version == 1 and clean.model == "v1" and set(clean.environments) == set(D.ENVIRONMENTS)
    assert clean.environments["staging"].control.edit == 2.0 and clean.environments["staging"].policy == D.Policy(False, 0.0, "staging")
    D.save(clean, path)
    assert D.load(path) == clean
    open(path, "w").write("not-json")
    assert D.load_or_default(path).model == "v1"
    e = D.Config().environments
    assert D.bucket_of(e["development"], None) == "treatment" and D.bucket_of(e["production"], "u", "treatment") == "control"
    with pytest.raises(D.MissingEnvironment):
        D.resolve(D.Config(environments={}), "staging", "u")


def test_buckets_agree(spark):
    e = D.Environment(Weights(), Weights(), D.Policy(True, 0.5, "prod-salt"))
    users = [f"user-{i}" for i in range(40)] + ["", None, "가"]
    df = spark.createDataFrame([(u,) for u in users], "u string").select("u", feedback.ab_bucket(F.col("u"), "prod-salt", 0.5).alias("b"))
    assert {r["u"]: r["b"] for r in df.collect()} == {u: D.bucket_of(e, u) for u in users}


def events(spark):
    rows = [("검삭", "검색", 1), (" 검삭", "검색", 2), ("결재", "결제", 3), ("결재", "결제", 4), ("x", None, 5), ("", "y", 6)]
    df = spark.createDataFrame([(q, k, s) for q, k, s in rows], "query string, selected_key string, seq long")
    return df.withColumn("ts", F.lit(NOW) - F.make_interval(secs=F.lit(10) - F.col("seq")))


def test_feedback(spark):
    e = events(spark)
    assert {(r["query"], r["occurrences"]) for r in feedback.pair_stats(e).collect()} == {("검삭", 2), ("결재", 2)}
    assert feedback.training_samples(e, 0).count() == 1 and feedback.training_samples(e, 5, 3).count() == 0
    old = e.unionByName(e.limit(1).withColumn("ts", F.lit(NOW) - F.expr("INTERVAL 4 DAYS")).withColumn("seq", F.lit(9).cast("long")))
    assert sorted(r["seq"] for r in feedback.retained(old, F.lit(NOW), 2 * 86400, 4).collect()) == [3, 4, 5, 6]
    s = feedback.summary(e, 1).first()
    assert s["total_events"] == 6 and s["distinct_queries"] == 5 and len(s["top_pairs"]) == 1
    assert '"total_events":6' in feedback.summary_json(e).first()["json"]


def test_nightly(spark):
    items = spark.createDataFrame(list(enumerate(["검색", "결제", "네이버"])), "id long, name string")
    index = HangulIndex(items, "name", "id")
    got = run_nightly(index, events(spark), D.Config(model="prod-1"), candidates=6, now=NOW.replace(tzinfo=UTC))
    assert got.samples == 2 and got.report.best_metrics.mrr >= got.report.baseline.mrr and got.report.best_metrics.top1 == 1.0
    assert got.config.model == "nightly-staging-20231114-221320-from-prod-1"
    assert got.config.environments["staging"].treatment == got.report.best
    with pytest.raises(InsufficientSamples):
        run_nightly(index, events(spark).limit(0), D.Config())
    assert replace(got.config, model="x") != got.config


def test_streams(spark, tmp_path):
    src = str(tmp_path / "q")
    rows = [("s", "ㅂ", "2024-01-01 00:00:00.000"), ("s", "ㄱㅅ", "2024-01-01 00:00:00.100"), ("s", "ㄱㅈ", "2024-01-01 00:00:09"), ("t", "zz", "2024-01-01 00:10:00")]
    spark.createDataFrame(rows, "session string, query string, t string").select("session", "query", F.col("t").cast("timestamp").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("session string, query string, ts timestamp").parquet(src)
    index = HangulIndex(spark.createDataFrame(list(enumerate(["검색", "결제"])), "id long, name string"), "name", "id", SearchPolicy("lazy"))
    for name, df, mode in (("found", search_stream(index, stream), "append"), ("calm", debounced_stream(stream), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
    assert {(r["query"], r["id"]) for r in spark.table("found").collect()} == {("ㄱㅅ", 0), ("ㄱㅈ", 1)}
    assert {r["query"] for r in spark.table("calm").where("session = 's'").collect()} <= {"ㄱㅅ", "ㄱㅈ"}
