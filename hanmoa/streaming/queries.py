"""Streams of queries (ts, session, query) against an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from hanmoa.operators.search import HangulIndex, matches
from hanmoa.operators.similarity import SimilarityOptions, search_with_fallback


def search_stream(index: HangulIndex, queries: DataFrame, mode: str = "contains") -> DataFrame:
    """All matches of each query that comes in: the stream joined with the items."""
    q = queries.withColumn("lookup", index.onsets(F.col("query"))).where("lookup != ''")
    items = index.table.where("choseong_key is not null")
    return q.join(items, matches(items["choseong_key"], q["lookup"], mode)).select(*queries.columns, "idx", *index.items.columns)


def debounced_stream(queries: DataFrame, milliseconds: int = 250, watermark: str = "10 seconds") -> DataFrame:
    """The latest query of each burst of a session: bursts are parted by so long a quiet time."""
    burst = F.session_window("ts", f"{milliseconds} milliseconds")
    return queries.withWatermark("ts", watermark).groupBy("session", burst).agg(F.max_by("query", "ts").alias("query"), F.max("ts").alias("ts")).select("session", "ts", "query")


def answer_stream(index: HangulIndex, queries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: SimilarityOptions | None = None) -> StreamingQuery:
    """Answers each micro-batch by exact search, or by likeness where there is no match, and hands it to ``sink``.

    The sink gets the batch's number, by which it can pass over a batch that it has had.
    """

    def answer(batch: DataFrame, number: int) -> None:
        sink(search_with_fallback(index, batch.withColumn("qid", F.xxhash64("session", "ts", "query")), options=options), number)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_stream(events: DataFrame, by: str = "session", ts: str = "ts", value: str = "query") -> DataFrame:
    """Events of a stream whose value differs from that of the one before of the same ``by``; the last value is its state."""
    place = events.columns.index(value)

    def changes(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        before, kept = (state.get[0], True) if state.exists else (None, False)
        keep = []
        for v in rows.iloc[:, place]:
            v = None if pd.isna(v) else v
            keep.append(not kept or v != before)
            before, kept = v, True
        state.update((before,))
        yield rows[keep]

    kind = events.schema[value].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(changes, events.schema, f"value {kind}", "append", "NoTimeout")
