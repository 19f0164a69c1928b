"""Searches that run beside the caller: cancelled by job tags, the latest one wins, and each is logged.

A search is a DataFrame that is collected in a thread of its own; its jobs carry a tag, so that Spark stops their tasks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Event, Lock

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

from hanmoa.operators.feedback import telemetry
from hanmoa.operators.search import HangulIndex

CALLS = "kind string, is_async boolean, outcome string, cache_hit boolean, returned long, latency_ms double"


class Cancelled(Exception):
    """The search was cancelled before it had a result."""


@dataclass
class CallLog:
    """Calls as searches write them; ``summary`` counts them."""

    rows: list[tuple] = field(default_factory=list)
    lock: Lock = field(default_factory=Lock, repr=False)

    def add(self, kind: str, is_async: bool, outcome: str, cache_hit: bool, returned: int, began: float) -> None:
        with self.lock:
            self.rows.append((kind, is_async, outcome, cache_hit, returned, (time.perf_counter() - began) * 1000))

    def summary(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return telemetry(spark.createDataFrame(list(self.rows), CALLS))


class Running:
    """A search in a thread of its own."""

    def __init__(self, spark: SparkSession, work: Callable[[], DataFrame], log: CallLog | None = None, kind: str = "search"):
        self.tag = f"hanmoa-{uuid.uuid4().hex}"
        self._spark, self._work, self._log, self._kind = spark, work, log, kind
        self._cancelled, self._done = Event(), Event()
        self._rows: list[Row] = []
        self._error: BaseException | None = None
        InheritableThread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        context, began = self._spark.sparkContext, time.perf_counter()
        context.addJobTag(self.tag)
        try:
            if not self._cancelled.is_set():
                self._rows = self._work().collect()
        except Exception as e:  # given to the caller by result()
            self._error = e
        finally:
            context.removeJobTag(self.tag)
            if self._log:
                outcome = "cancelled" if self._cancelled.is_set() else "failure" if self._error else "success"
                self._log.add(self._kind, True, outcome, False, len(self._rows) if outcome == "success" else 0, began)
            self._done.set()

    def cancel(self) -> None:
        """Stops the search's jobs; one that is done keeps its result."""
        if not self._done.is_set():
            self._cancelled.set()
            self._spark.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def is_searching(self) -> bool:
        return not self._done.is_set()

    def result(self, timeout: float | None = None) -> list[Row]:
        """The rows; raises Cancelled, what went wrong, or TimeoutError."""
        if not self._done.wait(timeout):
            raise TimeoutError(self.tag)
        if self._cancelled.is_set():
            raise Cancelled(self.tag)
        if self._error:
            raise self._error
        return self._rows


def search_async(index: HangulIndex, query: str, mode: str = "contains", log: CallLog | None = None) -> Running:
    """``index.search`` beside the caller."""
    return Running(index.items.sparkSession, lambda: index.search(query, mode), log)


def search_logged(index: HangulIndex, query: str, mode: str, log: CallLog) -> list[Row]:
    """The rows of ``index.search``, with the call, its time and whether the cache had it logged."""
    began, hits = time.perf_counter(), index.cache_hits
    outcome, rows = "failure", []
    try:
        rows = index.search(query, mode).collect()
        outcome = "success"
        return rows
    finally:
        log.add("search", False, outcome, index.cache_hits > hits, len(rows), began)


class LatestSearch:
    """A search field: a new query cancels the one before; too short ones clear the results."""

    def __init__(self, index: HangulIndex, mode: str = "contains", minimum_length: int = 1, log: CallLog | None = None):
        self.index, self.mode, self.minimum_length, self.log = index, mode, max(1, minimum_length), log
        self.query, self.running = "", None

    def submit(self, query: str) -> Running | None:
        self.cancel()
        self.query = query.strip()
        self.running = search_async(self.index, self.query, self.mode, self.log) if len(self.query) >= self.minimum_length else None
        return self.running

    def refresh(self) -> Running | None:
        return self.submit(self.query)

    def cancel(self) -> None:
        if self.running:
            self.running.cancel()

    def clear(self) -> None:
        self.cancel()
        self.query, self.running = "", None

    def results(self, timeout: float | None = None) -> list[Row]:
        """The latest query's rows; none if it was too short, cleared or cancelled."""
        try:
            return self.running.result(timeout) if self.running else []
        except Cancelled:
            return []
