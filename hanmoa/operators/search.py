"""Initial-consonant search over a string column.

An index is a DataFrame of the items with an ``idx`` that orders them, and derived keys worked out once. A search is a
filter on ``choseong_key``; with n-grams the candidates first come from a table of postings by gram.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field
from threading import Thread

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanmoa.functions.jamo import FIRST, LAST, ONSETS
from hanmoa.functions.syllables import get_choseong, nfc_hangul

MODES = ("contains", "prefix", "exact")


@dataclass(frozen=True)
class SearchPolicy:
    """strategy: ``precompute`` (keys kept in memory), ``lazy`` (worked out when first searched) or ``ngram``."""

    strategy: str = "precompute"
    ngram: int = 2
    cache_size: int = 0
    warm_up: bool = False
    max_query_length: int | None = 256
    max_candidate_scan: int | None = None
    keep_other: bool = True
    whitespace: str = "keep"

    def __post_init__(self):
        if self.strategy not in ("precompute", "lazy", "ngram"):
            raise ValueError(self.strategy)
        object.__setattr__(self, "ngram", max(2, min(3, self.ngram)))
        for name in ("max_query_length", "max_candidate_scan"):
            if (v := getattr(self, name)) is not None:
                object.__setattr__(self, name, max(1, v))


def grams(key: Column, k: int) -> Column:
    """Distinct grams of k code points; none of a shorter key."""
    n = F.length(key) - k + 1
    return F.array_distinct(
        F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(key, i, F.lit(k)))).otherwise(F.lit([]).cast("array<string>"))
    )


def matches(key: Column, query: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(mode)
    return {"contains": F.contains(key, query), "prefix": F.startswith(key, query), "exact": key == query}[mode]


def bounded(query: Column, policy: SearchPolicy) -> Column:
    return F.left(query, F.lit(policy.max_query_length)) if policy.max_query_length else query


def with_keys(items: DataFrame, key: str, policy: SearchPolicy) -> DataFrame:
    """Items with ``raw_key``, ``norm_key`` (composed, lower case) and ``choseong_key``. Rows with a null key have null keys."""
    c = F.col(key)
    return items.withColumns(
        {
            "raw_key": c,
            "norm_key": F.lower(nfc_hangul(c)),
            "choseong_key": get_choseong(c, policy.keep_other, policy.whitespace),
        }
    )


def postings(index: DataFrame, k: int) -> DataFrame:
    """(gram, idx), a row for each distinct gram of each choseong key."""
    return index.select("idx", F.explode(grams(F.col("choseong_key"), k)).alias("gram"))


def pruned(queries: DataFrame, posted: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, idx) of items that have all grams of the query's ``lookup``; all items for a query shorter than k."""
    wanted = queries.select("qid", grams(F.col("lookup"), k).alias("grams")).withColumn("n", F.size("grams"))
    hits = (
        wanted.where("n > 0").select("qid", "n", F.explode("grams").alias("gram")).join(posted, "gram")
        .groupBy("qid", "idx").agg(F.count(F.lit(1)).alias("got"), F.first("n").alias("n")).where("got = n").select("qid", "idx")
    )
    short = wanted.where("n = 0").select("qid")
    return hits.unionAll(short.join(index.select("idx").where("choseong_key is not null"), how="cross"))


@dataclass
class HangulIndex:
    """Items to search, with ``idx`` as their order (a unique column of the items)."""

    items: DataFrame
    key: str
    order: str
    policy: SearchPolicy = field(default_factory=SearchPolicy)

    def __post_init__(self):
        table = with_keys(self.items, self.key, self.policy).withColumn("idx", F.col(self.order).cast("long"))
        self.table = table.cache() if self.policy.strategy == "precompute" or self.policy.warm_up else table
        self.posted = postings(self.table, self.policy.ngram) if self.policy.strategy == "ngram" else None
        if self.posted is not None:
            self.posted = self.posted.cache()
        if self.policy.warm_up:
            Thread(target=self.table.count, daemon=True).start()
        self._cache: OrderedDict[tuple[str, str], DataFrame] = OrderedDict()
        self.cache_hits = 0

    @classmethod
    def of(cls, items: DataFrame, order: str, policy: SearchPolicy | None = None) -> HangulIndex:
        """An index on the first string column."""
        key = next((f.name for f in items.schema if f.dataType.simpleString() == "string"), None)
        if key is None:
            raise ValueError("no column of the items is text")
        return cls(items, key, order, policy or SearchPolicy())

    def close(self) -> None:
        """Gives back what the index holds in memory."""
        for held in (*self._cache.values(), self.posted, self.table):
            if held is not None:
                held.unpersist()
        self._cache.clear()

    def count(self) -> int:
        return self.table.count()

    def onsets(self, query: Column) -> Column:
        return get_choseong(bounded(query, self.policy), self.policy.keep_other, self.policy.whitespace)

    def candidates(self, queries: DataFrame) -> DataFrame:
        """queries (qid, lookup) joined with the items to look at."""
        if self.posted is None:
            pairs = queries.join(self.table.where("choseong_key is not null"), how="cross")
        else:
            found = pruned(queries, self.posted, self.table, self.policy.ngram)
            pairs = queries.join(found, "qid").join(self.table, "idx")
        if self.policy.max_candidate_scan:
            from pyspark.sql import Window

            place = F.row_number().over(Window.partitionBy("qid").orderBy("idx"))
            pairs = pairs.withColumn("_place", place).where(F.col("_place") <= self.policy.max_candidate_scan).drop("_place")
        return pairs

    def search_all(self, queries: DataFrame, mode: str = "contains") -> DataFrame:
        """(qid, query, items' columns) of every match of queries (qid, query), which are few against the items."""
        q = queries.select("qid", "query", self.onsets(F.col("query")).alias("lookup")).where("lookup != ''")
        out = self.candidates(F.broadcast(q) if self.posted is None else q)
        return out.where(matches(F.col("choseong_key"), F.col("lookup"), mode)).select("qid", "query", "idx", *self.items.columns)

    def search(self, query: str, mode: str = "contains") -> DataFrame:
        """Items whose onsets contain, begin with or equal the query's, in order. An empty query has none."""
        if mode not in MODES:
            raise ValueError(mode)
        cut = query[: self.policy.max_query_length] if self.policy.max_query_length else query
        held = (mode, "".join(ONSETS[(ord(c) - FIRST) // 588] if FIRST <= ord(c) <= LAST else c for c in cut))  # queries of the same onsets share it
        if (hit := self._cache.get(held)) is not None:
            self._cache.move_to_end(held)
            self.cache_hits += 1
            return hit
        wanted = get_choseong(F.lit(cut), self.policy.keep_other, self.policy.whitespace)
        rows = self.table
        if self.posted is not None:
            one = rows.sparkSession.range(1).select(F.col("id").alias("qid"), wanted.alias("lookup"))
            rows = rows.join(pruned(one, self.posted, rows, self.policy.ngram).select("idx"), "idx", "left_semi")
        if self.policy.max_candidate_scan:
            rows = rows.orderBy("idx").limit(self.policy.max_candidate_scan)
        out = rows.where((wanted != "") & matches(F.col("choseong_key"), wanted, mode)).orderBy("idx").select(*self.items.columns)
        if self.policy.cache_size > 0:
            self._cache[held] = out = out.cache()
            if len(self._cache) > self.policy.cache_size:
                self._cache.popitem(last=False)[1].unpersist()
        return out
