"""Positional inverted index over training text, and the benchmark phrases found in it.

The index is split by documents: a block holds about BLOCK_TOKENS tokens and has, for each of its terms, the
ascending list of positions. A block is one row of a stored table, so nothing is shuffled to build it, and
no term's list, however frequent the term, leaves its block. A phrase is looked up in a block by taking its
terms from the rarest on and intersecting their lists, each moved by the term's place in the phrase. Phrases of
SENT_BYTES at most go to all blocks. Of more, each phrase goes by a shuffle to the blocks that have its rarest term.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import alnum_words, as_bytes, slices, stored

BLOCK_TOKENS = 1 << 20
#: The most bytes of benchmark text that are sent to all tasks.
SENT_BYTES = 16 << 20

INDEX = "block long, doc_ids binary, known binary, starts binary, terms array<binary>, ends binary, gaps binary"


def _block(number: int, ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    starts = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(w) for w in words], out=starts[1:])
    tokens = np.fromiter((vocabulary[t] for w in words for t in w), dtype=np.int32, count=int(starts[-1]))
    order = np.argsort(tokens, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(tokens, minlength=len(vocabulary))).astype(np.int32)
    gaps = np.diff(order, prepend=np.int32(0))  # a list's first entry may be negative; sums over the block are exact
    row = {
        "block": [number],
        "doc_ids": [np.array([x or 0 for x in ids], dtype=np.int64).tobytes()],
        "known": [np.array([x is not None for x in ids]).tobytes()],
        "starts": [starts.tobytes()],
        "terms": [list(vocabulary)],
        "ends": [ends.tobytes()],
        "gaps": [gaps.astype(np.int32).tobytes()],
    }
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(v, type=t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, words, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in slices(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
            w = alnum_words(text)
            if held and held + len(w) > BLOCK_TOKENS:
                yield _block(number, ids, words)
                number, ids, words, held = number + 1, [], [], 0
            ids.append(doc_id)
            words.append(w)
            held += len(w)
    if ids:
        yield _block(number, ids, words)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of doc_id and text, as a stored table of blocks."""
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_build, INDEX), "positional")


class Block:
    """A block's lists. Every row of the documents has a place in it, in the order in which they were read."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.starts = np.frombuffer(row["starts"], dtype=np.int32).astype(np.int64)
        self.term = {t: i for i, t in enumerate(row["terms"])}
        self.ends = np.frombuffer(row["ends"], dtype=np.int32)
        self.positions = np.cumsum(np.frombuffer(row["gaps"], dtype=np.int32), dtype=np.int64)

    def list_of(self, term: int) -> np.ndarray:
        return self.positions[self.ends[term - 1] if term else 0 : self.ends[term]]

    def frequencies(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each term, its number here (-1: none) and how often it occurs."""
        number = np.array([self.term.get(t, -1) for t in terms], dtype=np.int64)
        size = np.diff(self.ends, prepend=0)
        return number, np.where(number >= 0, size[number] if len(size) else 0, 0)

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def phrase(self, terms: list[int], order: np.ndarray) -> np.ndarray:
        """Places where the phrase starts, whole within a document."""
        at = self.list_of(terms[order[0]]) - order[0]
        for k in order[1:].tolist():
            if not len(at):
                break
            own = self.list_of(terms[k]) - k
            i = np.minimum(np.searchsorted(own, at), len(own) - 1)
            at = at[own[i] == at]
        at = at[at >= 0]
        return at[at + len(terms) <= self.starts[self.document_of(at) + 1]]

    def near(self, terms: list[int], order: np.ndarray, slop: int) -> np.ndarray:
        """Places of the phrase's rarest term around which, in its document, all others are within ``slop`` words of where they belong."""
        at = self.list_of(terms[order[0]])
        document = self.document_of(at)
        low, high = self.starts[document], self.starts[document + 1]
        found = np.ones(len(at), dtype=bool)
        for k in order[1:].tolist():
            own, ideal = self.list_of(terms[k]), at + (k - order[0])
            i = np.searchsorted(own, np.maximum(ideal - slop, low))
            found &= (i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= np.minimum(ideal + slop, high - 1))
        return at[found]


def windows_of(text: bytes | None, width: int) -> list[tuple[bytes, ...]]:
    """All windows of ``width`` words; a text of fewer words is one window, one without words has none."""
    w = alnum_words(text)
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)]


class Phrases:
    """Windows and the items of each, by length: a matrix of term numbers and the items of each row."""

    def __init__(self, rows: Iterable[tuple[tuple[bytes, ...], str]]):
        terms: defaultdict = defaultdict()
        terms.default_factory = terms.__len__
        of: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for window, item in rows:
            of[tuple(terms[t] for t in window)].add(item)
        self.terms = list(terms)
        by: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for w in of:
            by[len(w)].append(w)
        self.groups = [(np.array(ws, dtype=np.int64), [sorted(of[w]) for w in ws]) for _, ws in sorted(by.items())]

    def find(self, block: Block, slop: int | None = None) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """Of each window that occurs: its length, its places (with a slop, those of its rarest term), its items."""
        number, frequency = block.frequencies(self.terms)
        for windows, items in self.groups:
            rows = np.flatnonzero(frequency[windows].min(axis=1))
            rarest = np.argsort(frequency[windows[rows]], axis=1, kind="stable")
            for row, order in zip(rows.tolist(), rarest, strict=True):
                own = number[windows[row]].tolist()
                at = block.phrase(own, order) if slop is None else block.near(own, order, slop)
                if len(at):
                    yield windows.shape[1], at, items[row]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))


def _routed(index: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(block, window, item) for each block that has a window's rarest term, of windows whose terms all occur somewhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = [(w, item) for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in windows_of(text, width)]
            yield pa.record_batch([pa.array([list(w) for w, _ in rows], pa.list_(pa.binary())), pa.array([i for _, i in rows], pa.string())], names=["window", "item"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = np.diff(np.frombuffer(row["ends"], dtype=np.int32), prepend=0)
                yield pa.record_batch(
                    [pa.array([row["block"]] * len(size), pa.int64()), pa.array(row["terms"], pa.binary()), pa.array(size, pa.int64())], names=["block", "term", "n"]
                )

    windows = items.mapInArrow(cut, "window array<binary>, item string").distinct()
    has = stored(index.select("block", "terms", "ends").mapInArrow(entries, "block long, term binary, n long"), "positional")
    number = has.groupBy("term").agg(F.sum("n").alias("n"))
    each = windows.select("window", "item", F.explode(F.array_distinct("window")).alias("term")).join(number, "term")
    rarest = each.groupBy("window", "item").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "term")).alias("rarest"))
    whole = rarest.where(F.col("found") == F.size(F.array_distinct("window"))).select("window", "item", F.col("rarest.term").alias("term"))
    return whole.join(has.select("block", "term"), "term").select("block", "window", "item")


def _searched(index: DataFrame, benchmark: DataFrame, width: int, search: Callable[[Block, Phrases], pa.RecordBatch], schema: str) -> DataFrame:
    """``search`` of every block, with all windows or, of a large benchmark, those whose rarest term the block has."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > SENT_BYTES:

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = zip(right.column("window").to_pylist(), right.column("item").to_pylist(), strict=True)
            phrases = Phrases((tuple(w), i) for w, i in rows)
            return pa.Table.from_batches([search(Block(row), phrases) for row in left.to_pylist()])

        routed = _routed(index, items, width)
        return index.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(meet, schema)
    phrases = Phrases((w, r["item"]) for r in items.collect() for w in windows_of(r["text"], width))  # of SENT_BYTES at most
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield search(Block(batch.slice(row, 1).to_pylist()[0]), sent.value)

    return index.mapInArrow(run, schema)


HITS = "doc_id long, n_words long, n_hit long, items array<string>"


def find_passages(index: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """Per row of the indexed documents: doc_id, n_words, n_hit (words in any occurrence of an item's window), items.

    Windows are ``width`` consecutive item words; an item of fewer words is one window, one of none has none.
    Null texts have no words. Null item ids are listed as the empty string; equal ids are listed once, in
    ascending order of their bytes.
    """

    def search(block: Block, phrases: Phrases) -> pa.RecordBatch:
        n = len(block.doc_ids)
        cover = np.zeros(int(block.starts[-1]) + 1, dtype=np.int64)
        found: dict[int, set[str]] = defaultdict(set)
        for length, at, items in phrases.find(block):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            for d in np.unique(block.document_of(at)).tolist():
                found[d].update(items)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        return pa.record_batch(
            [
                pa.array(block.doc_ids, mask=~block.known),
                pa.array(np.diff(block.starts)),
                pa.array(hit[block.starts[1:]] - hit[block.starts[:-1]], type=pa.int64()),
                pa.array([sorted(found[d]) if d in found else [] for d in range(n)], type=pa.list_(pa.string())),
            ],
            names=["doc_id", "n_words", "n_hit", "items"],
        )

    return _searched(index, benchmark, width, search, HITS)


def find_near(index: DataFrame, phrases: DataFrame, slop: int, width: int = 13) -> DataFrame:
    """Proximity matches: per document and item (doc_id, item_id, n_matches), how often a window's terms stand together.

    Each place of a window's rarest term counts around which every other term is found within ``slop`` words of where it
    belongs, in the same document. Documents and items without matches have no row; repeated documents have a row each.
    """

    def search(block: Block, windows: Phrases) -> pa.RecordBatch:
        count: dict[tuple[int, str], int] = defaultdict(int)
        for _, at, items in windows.find(block, slop):
            for d in block.document_of(at).tolist():
                for item in items:
                    count[d, item] += 1
        docs = [d for d, _ in count]
        return pa.record_batch(
            [
                pa.array(block.doc_ids[docs], mask=~block.known[docs]),
                pa.array([i for _, i in count], type=pa.string()),
                pa.array(list(count.values()), type=pa.int64()),
            ],
            names=["doc_id", "item_id", "n_matches"],
        )

    return _searched(index, phrases, width, search, "doc_id long, item_id string, n_matches long")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Repeated documents get a row each; an empty table gives no rows; other columns aren't read.
    """
    hits = find_passages(build_index(docs), benchmark, width)
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def items_sha256(items: str = "items") -> F.Column:
    """Lower-case hex SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.col(items)), 256)
