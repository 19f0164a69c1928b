import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hanmoa.operators import feedback
from hanmoa.operators.running import CallLog, Cancelled, LatestSearch, Running, search_async, search_logged
from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.streaming.queries import changed_stream

NOW = datetime(2023, 11, 14, 22, 13, 20)


@pytest.fixture
def index(spark):
    items = spark.createDataFrame([(0, "프론트엔드"), (1, "백엔드"), (2, "데이터")], "id long, name string")
    made = HangulIndex.of(items, "id", SearchPolicy("lazy", cache_size=4))
    yield made
    made.close()


def slow(spark):
    @F.udf("long")
    def wait(i):
        time.sleep(60)
        return i

    return spark.range(4).select(wait("id"))


def test_async_search_and_cancel(spark, index):
    log = CallLog()
    assert [r["id"] for r in search_async(index, "ㅇㄷ", log=log).result(60)] == [0, 1]
    running = Running(spark, lambda: slow(spark), log)
    time.sleep(2)
    began = time.time()
    running.cancel()
    with pytest.raises(Cancelled):
        running.result(30)
    assert time.time() - began < 20 and not running.is_searching
    failed = Running(spark, lambda: index.search("ㄱ", "nowhere"), log)
    with pytest.raises(ValueError):
        failed.result(30)
    assert [r["id"] for r in search_logged(index, "ㄷ", "prefix", log)] == [2]
    assert [r["id"] for r in search_logged(index, "다", "prefix", log)] == [2]  # of the same onsets: from the cache
    got = log.summary(spark).first()
    assert (got["async_search_success_count"], got["async_search_cancelled_count"], got["async_search_failure_count"]) == (1, 1, 1)
    assert got["sync_search_count"] == 2 and got["cache_hit_count"] == 1 and got["returned_item_count"] == 4 and got["mean_sync_search_ms"] > 0


def test_the_latest_search_wins(spark, index):
    field = LatestSearch(index, minimum_length=2)
    first = field.submit("ㅂㅇ")
    field.submit("ㄷㅇ ")
    assert [r["id"] for r in field.results(60)] == [2] and field.query == "ㄷㅇ"
    assert not first.is_searching or first._cancelled.is_set()
    assert field.submit("ㄷ") is None and field.results() == []
    field.submit("ㅂㅇ")
    field.refresh()
    assert [r["id"] for r in field.results(60)] == [1]
    field.clear()
    assert field.results() == [] and field.query == ""


def test_default_key(spark):
    with pytest.raises(ValueError):
        HangulIndex.of(spark.range(1), "id")


def test_record_and_drop_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    feedback.record(spark, path, [("가", "나", NOW, "clickedResult", None), ("다", None, NOW, "what", "ko")])
    feedback.record(spark, path, [("라", "마", datetime(2023, 11, 1), "noSuggestion", None)])
    events = spark.read.parquet(path)
    assert [(r["query"], r["outcome"]) for r in events.orderBy("seq").collect()] == [("가", "clickedResult"), ("다", "unknown"), ("라", "noSuggestion")]
    assert feedback.dropped(events, F.lit(NOW), 86400, 1).first().asDict() == {"dropped_by_ttl": 1, "dropped_by_size": 1}
    assert feedback.dropped(events.limit(0), F.lit(NOW)).first().asDict() == {"dropped_by_ttl": 0, "dropped_by_size": 0}


def test_repeats_in_a_stream(spark, tmp_path):
    rows = [("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("s", None, 4), ("s", None, 5), ("s", "a", 6), ("t", "a", 1)]
    df = spark.createDataFrame(rows, "session string, query string, n long").select("session", "query", F.timestamp_seconds("n").alias("ts"))
    df.write.parquet(str(tmp_path / "q"))
    stream = changed_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "q")))
    stream.writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(60)
    got = spark.table("changed").orderBy("session", "ts").collect()
    assert [(r["session"], r["query"]) for r in got] == [("s", "a"), ("s", "b"), ("s", None), ("s", "a"), ("t", "a")]
