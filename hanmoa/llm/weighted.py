"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, each as often as it occurs. Every sample draws, for each term, two gamma
variates and a uniform one from the term's hash alone, and from these and the term's weight a number and a step;
the term of the least number wins, with its step. Two texts have the same winner and step with a
probability equal to their generalised Jaccard similarity, sum of least over sum of greatest weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import slices, space_words

SAMPLES = 128
#: A fingerprint keeps one byte of each sample's winner and step.
CHANCE = 1 / 256
#: Longer words are cut into pieces of this many bytes, so that a text without white space has terms too.
WORD_BYTES = 24
#: Terms, each with its weight, whose draws a worker keeps.
KEPT = 120_000
#: Texts' bytes worked on at once, about.
CHUNK_BYTES = 512 << 10

_W = np.uint32


def terms(text: bytes) -> Counter:
    """Words, A-Z lower-cased, and how often each occurs."""
    words = space_words(text)
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return Counter(words)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalises 32-bit values in place so that all bits depend on all."""
    x ^= x >> _W(16)
    x *= _W(0x85EBCA6B)
    x ^= x >> _W(13)
    x *= _W(0xC2B2AE35)
    x ^= x >> _W(16)
    return x


def _bits(seed: np.ndarray, stream: int) -> np.ndarray:
    """32 hash bits for each 64-bit seed and sample."""
    low, high = (seed & np.uint64(0xFFFFFFFF)).astype(_W), (seed >> np.uint64(32)).astype(_W)
    x = low[:, None] + (np.arange(SAMPLES, dtype=_W) * _W(8) + _W(stream + 1)) * _W(0x9E3779B9)
    x ^= high[:, None]
    return _mix(x)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 24 bits."""
    out = (bits >> _W(8)).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-24)
    return out


def _gamma(seed: np.ndarray, stream: int) -> np.ndarray:
    """Gamma(2, 1) variates from two streams."""
    product = _uniform(_bits(seed, stream))
    product *= _uniform(_bits(seed, stream + 1))
    np.log(product, out=product)
    return np.negative(product, out=product)


def draws(seed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each weighted term and sample a whole number of which the least wins; its low byte names term and step.

    The upper bits are those of the sampled number in an order that whole numbers keep.
    """
    gamma_r, number = _gamma(seed, 0), _gamma(seed, 2)
    last = _bits(seed, 4)
    beta = _uniform(last)
    np.log(number, out=number)
    if weight.max() > 1:
        step = np.floor(np.log(weight).astype(np.float32)[:, None] / gamma_r + beta)
        number -= gamma_r * (step - beta + np.float32(1))
        last += step.astype(_W) * _W(0x27D4EB2F)
    else:  # a weight of 1 has a logarithm of 0, and beta is below 1: the step is 0
        gamma_r *= np.float32(1) - beta
        number -= gamma_r
    key = number.view(np.int32)
    key ^= (key >> np.int32(31)) & np.int32(0x7FFFFFFF)
    key &= np.int32(~255)
    # of the hash that beta is from, but mixed anew, so that a winner's name isn't bound to its winning
    key |= (_mix(last) >> _W(24)).view(np.int32)
    return key


class Rows(dict):
    """The table row of each term, given out when first asked for. A term of weight 1 is its word, others are (word, weight)."""

    def __init__(self, names: list):
        super().__init__(zip(names, range(len(names)), strict=True))
        self.names = names

    def __missing__(self, name: bytes | tuple[bytes, int]) -> int:
        row = self[name] = len(self.names)
        self.names.append(name)
        return row


class Sampler:
    """Fingerprints, with the draws of weighted terms kept from text to text."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.rows, self.drawn = kept, Rows([]), 0
        self.table = np.empty((kept, SAMPLES), dtype=np.int32)

    def _draw(self) -> None:
        """The rows given out since the last time."""
        names = self.rows.names
        if len(names) > len(self.table):
            self.table = np.concatenate([self.table[: self.drawn], np.empty((len(names) - self.drawn, SAMPLES), dtype=np.int32)])
        for at in range(self.drawn, len(names), 256):  # what is worked on stays in the cache
            some = [(n, 1) if isinstance(n, bytes) else n for n in names[at : at + 256]]
            seed = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in some], dtype=np.uint64)
            self.table[at : at + len(some)] = draws(seed, np.array([n for _, n in some], dtype=np.float64))
        self.drawn = len(names)

    def _forget(self, used: list[np.ndarray]) -> None:
        """Keeps only the draws that the last texts used."""
        stay = np.unique(np.concatenate(used))
        table = np.empty((max(self.kept, len(stay)), SAMPLES), dtype=np.int32)
        table[: len(stay)] = self.table[stay]
        self.table, self.drawn = table, len(stay)
        self.rows = Rows([self.rows.names[i] for i in stay.tolist()])

    def fingerprints(self, texts: list[bytes]) -> np.ndarray:
        """A row of SAMPLES bytes for each text; a text without terms has zeros."""
        row = self.rows
        used = [np.array([row[w] if n == 1 else row[w, n] for w, n in terms(t).items()], dtype=np.int64) for t in texts]
        self._draw()
        out = np.zeros((len(texts), SAMPLES), dtype=np.uint8)
        for k, rows in enumerate(used):
            if len(rows):
                least = self.table[rows[:GATHERED]].min(axis=0)
                for at in range(GATHERED, len(rows), GATHERED):
                    np.minimum(least, self.table[rows[at : at + GATHERED]].min(axis=0), out=least)
                out[k] = (least & np.int32(255)).astype(np.uint8)
        if self.drawn > self.kept:
            self._forget(used)
        return out


#: Terms of a text whose draws are compared at once.
GATHERED = 512

_samplers: list[Sampler] = []


def sampler() -> Sampler:
    """This process's sampler: what it keeps serves all its tasks."""
    if not _samplers:
        _samplers.append(Sampler())
    return _samplers[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated generalised Jaccard similarity of fingerprints, row by row: the share of equal bytes, less chance."""
    return np.clip(((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE), 0.0, 1.0)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (hex), without any shuffle. Null texts are empty; empty texts have zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            prints = sampler().fingerprints([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array([p.tobytes().hex() for p in prints], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def range_numbers(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each (doc_id, hash of its text), ascending in both; a doc_id that is n bounds has its rows dealt to n + 1 ranges."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    part = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    return (low + np.minimum(np.floor(part * (high - low + 1)), high - low)).astype(np.int32)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of doc_id; the first row of a range also ends the one before, marked ``ahead``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))  # nulls first
    bounds = np.array(docs.select(place.alias("place")).approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_numbers(bounds, ids.to_numpy(), hashes.to_numpy()))

    rows = rows.withColumn("range", range_of(place, "row"))
    first = rows.groupBy("range").agg(F.min(F.struct("doc_id", "row")).alias("h")).select("range", "h.doc_id", "h.row").collect()
    heads = sorted(map(tuple, first))  # a row for each range
    also = [(d, r, heads[i - 1][0]) for i, (_, d, r) in enumerate(heads)]  # the very first follows the very last
    table = F.broadcast(spark.createDataFrame(also, "head_id long, head_row long, also int"))
    marked = rows.join(table, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("row") == F.col("head_row")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    other = F.struct(F.col("also").alias("range"), F.lit(1).alias("ahead"))
    to = F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("to")
    out = marked.select("doc_id", "row", "text", to).select("doc_id", "row", "text", "to.range", "to.ahead")
    return out.repartitionById(ranges, "range").sortWithinPartitions("range", "ahead", "doc_id", "row")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness to these and to the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document by ascending doc_id (nulls first; rows with equal doc_ids by a hash of their texts); the first follows the
    last. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    are empty; a single row is its own next; rows that repeat get a row each and follow one another; an empty table gives
    no rows; other columns aren't read. Words of over WORD_BYTES bytes are several terms, of which none is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, int, int]] = []  # doc_id, text, range, ahead
        size = 0

        def flush() -> pa.RecordBatch:
            texts = [h[1] for h in held]
            pairs = [k for k in range(len(held) - 1) if held[k][2] == held[k + 1][2] and not held[k][3]]
            cut = [len(texts[k]) // 4 for k in pairs]
            edited = [(texts[k][: len(texts[k]) - q] + texts[k + 1][:q]).encode() for k, q in zip(pairs, cut, strict=True)]
            prints = sampler().fingerprints([t.encode() for t in texts] + edited)
            own, after, new = prints[pairs], prints[[k + 1 for k in pairs]], prints[len(texts) :]
            values = [
                pa.array([held[k][0] for k in pairs], pa.int64()),
                pa.array([len(texts[k]) for k in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([p.tobytes().hex() for p in own], pa.string()),
                pa.array([p.tobytes().hex() for p in new], pa.string()),
                pa.array(likeness(own, new), pa.float64()),
                pa.array(likeness(own, after), pa.float64()),
            ]
            return pa.record_batch(values, names=NAMES)

        for batch in slices(batches, "text", CHUNK_BYTES):
            for item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "ahead")), strict=True):
                held.append(item)
                size += len(item[1])
            if size >= CHUNK_BYTES and len(held) > 1:
                yield flush()
                held, size = held[-1:], 0
        if len(held) > 1:
            yield flush()

    rows = _with_next(docs).select("doc_id", "text", "range", "ahead")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
