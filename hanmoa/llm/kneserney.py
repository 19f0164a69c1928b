"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, spell words byte by byte: P(byte | the ORDER - 1 before it in the
word). What each has seen is counted by class (in how many rows a word stands). Both back off to the counts of
both classes together and those to continuation counts, of how many different bytes an n-gram follows. So a
rare form of a known stem is judged by the stem, and a spelling that is new to both says nothing. A text's score is a
logistic function of the difference of both log-likelihoods per word, and of the same difference where it is
highest over a stretch of STRETCH words; its weights are fitted on labelled rows that the models haven't seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanmoa.llm.common import BROADCAST_BYTES, alnum_words, as_bytes, slices, stored

#: Labelled rows of a class that the models are fitted on at most (about; chosen by a hash), and bytes of their texts,
#: which are taken whole in the order of another hash as long as they fit.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20
#: One labelled row in so many, by a hash, is kept from the models to fit the logistic function.
HELD_FOR_SCALE = 4
ORDER, DISCOUNT = 7, 0.75
#: Rows' worth of the counts of both classes that each class gets in every context.
SHARED = 64.0
#: Ratios of words up to this count as chance. Both were chosen by the log-loss of a cross-validation within the training rows.
CHANCE = 1.25
STRETCH = 48
#: Words of no weight that are added to each text, so that a few words say less than many.
CALM = 10
#: A word's log-likelihood ratio is held to this.
MOST = 8.0
#: Words whose ratios a task keeps at most.
KEPT = 500_000


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all words, begun and ended by the bytes 1 and 2, and the word each is of. Zeros stand before."""
    sizes = np.array([len(w) + ORDER + 1 for w in words], dtype=np.int64)
    pad = bytes(ORDER - 1)
    text = np.frombuffer(pad + b"".join(pad + b"\1" + w + b"\2" for w in words), dtype=np.uint8)
    key = np.zeros(len(text) - ORDER + 1, dtype=np.uint64)
    for i in range(ORDER):
        key = key << np.uint64(8) | text[i : i + len(key)]
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = place >= ORDER  # after the byte that begins a word
    return key[real], of[real]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in an ascending table, and whether it is."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    """Log-likelihood ratios of n-grams that a class has seen, and of backing off behind a context."""

    grams: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    weights: np.ndarray
    prior: float
    kept: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Of each word, its log-likelihood in toxic text less that in ordinary text."""
        keys, of = _grams(words)
        at, seen = _find(self.grams, keys)
        c, known = _find(self.contexts, keys >> np.uint64(8))
        one = np.where(seen, self.ratio[at] if len(self.ratio) else 0.0, np.where(known, self.backoff[c] if len(self.backoff) else 0.0, 0.0))
        ratio = np.bincount(of, weights=one, minlength=len(words))
        return np.sign(ratio) * np.clip(np.abs(ratio) - CHANCE, 0, MOST)

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """Of each text: the ratio per word, the highest per word of a stretch, and 1."""
        split = [alnum_words(t) for t in texts]
        starts = np.zeros(len(split) + 1, dtype=np.int64)
        np.cumsum([len(w) for w in split], out=starts[1:])
        if len(self.kept) > KEPT:
            self.kept.clear()
        new = [w for w in set().union(*split) if w not in self.kept]
        for i in range(0, len(new), 20_000):
            self.kept.update(zip(new[i : i + 20_000], self.of_words(new[i : i + 20_000]).tolist(), strict=True))
        get = self.kept.__getitem__
        each = np.fromiter((r for s in split for r in map(get, s)), dtype=np.float64, count=int(starts[-1]))
        total = np.concatenate([[0.0], np.cumsum(each)])
        n = np.diff(starts)
        whole = total[starts[1:]] - total[starts[:-1]]
        peak = whole.copy()
        long = np.flatnonzero(n > STRETCH)
        if len(long):
            window = np.append(total[STRETCH:] - total[:-STRETCH], -np.inf)  # a text's are n - STRETCH + 1
            first = starts[:-1][long]
            peak[long] = np.maximum.reduceat(window, np.stack([first, first + n[long] - STRETCH + 1], axis=1).ravel())[::2]
        mean = whole / (n + CALM)
        return np.stack([mean, peak / (np.minimum(n, STRETCH) + CALM), np.ones(len(mean))], axis=1)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Between 0 and 1; a text without words has features of 0."""
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _shared(keys: np.ndarray) -> np.ndarray:
    """P(last byte | ORDER - 2 before it) for distinct n-grams, from the continuation counts of all n-grams."""
    kinds, lengths = keys, []
    for n in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << 8 * n) - 1)
        kinds, count = np.unique(kinds & mask, return_counts=True)  # how many bytes each follows
        lengths.append((mask, kinds, count))
    p = np.full(len(keys), 1 / 256)
    for mask, kinds, count in reversed(lengths):
        context, at = np.unique(kinds >> np.uint64(8), return_inverse=True)
        mass, types = np.bincount(at, weights=count), np.bincount(at)
        mine, _ = _find(kinds, keys & mask)
        p = (count[mine] - DISCOUNT) / mass[at[mine]] + DISCOUNT * (types / mass)[at[mine]] * p
    return p


def fit(rows: list[tuple[list[bytes], int]], prior: float) -> Model:
    """Both models from (words, label) rows, with weights of 1 and the prior."""
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in (0, 1):
        number = Counter(w for words, label in rows if label == c for w in set(words))
        keys, of = _grams(list(number)) if number else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        gram, at = np.unique(keys, return_inverse=True)
        counts[c] = gram, np.bincount(at, weights=np.array(list(number.values()), dtype=float)[of], minlength=len(gram)) if len(gram) else np.empty(0)
    grams = np.union1d(counts[0][0], counts[1][0])
    contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    below = _shared(grams) if len(grams) else np.empty(0)
    own, mass = {}, {}
    for c in (0, 1):
        gram, n = counts[c]
        place, found = _find(gram, grams)
        own[c] = np.where(found, n[place] if len(n) else 0.0, 0.0)
        mass[c] = np.bincount(at, weights=own[c], minlength=len(contexts))

    def discounted(n: np.ndarray, total: np.ndarray, more: float, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P, and what an n-gram not seen has of the probability below."""
        left = (DISCOUNT * np.bincount(at, weights=n > 0, minlength=len(contexts)) + more) / (total + more)
        return np.maximum(n - DISCOUNT, 0) / (total + more)[at] + left[at] * base, left

    both, _ = discounted(own[0] + own[1], mass[0] + mass[1], 0.0, below)
    p, left = zip(*(discounted(own[c], mass[c], SHARED, both) for c in (0, 1)), strict=True)
    ratio = np.log(p[1] / p[0]) if len(grams) else np.empty(0)
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return Model(grams, ratio.astype(np.float32), contexts, np.log(left[1] / left[0]).astype(np.float32), np.array([1.0, 1.0, odds]), prior)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.02, 0.02, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rows(rows: list[tuple[list[bytes], int, bool]], prior: float) -> Model:
    """Models and weights from (words, label, whether it is kept for the weights) rows."""
    if {c for _, c, _ in rows} != {0, 1}:
        return fit([], min(prior, 0.49))  # no evidence but the prior, which alone makes no text toxic
    first = fit([(w, c) for w, c, h in rows if not h], prior)
    out = fit([(w, c) for w, c, _ in rows], prior)
    scale = [(w, c) for w, c, h in rows if h]
    if {c for _, c in scale} == {0, 1}:
        drawn = np.mean([c for _, c in scale])
        out.weights = _logistic(first.features([b" ".join(w) for w, _ in scale]), np.array([c for _, c in scale], dtype=float))
        out.weights[2] += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))  # the sample may hold more toxic rows
    return out


def train(docs: DataFrame, labels: DataFrame, usable: F.Column | None = None) -> Model:
    """Fits the models on a bounded sample of labelled rows (SAMPLE_ROWS and SAMPLE_BYTES a class), each with its whole text.

    labels has doc_id and toxic (0, 1; others and nulls are passed over); ``usable`` narrows its rows. A doc_id with
    several labels counts once for each, repeated documents as often as they are there. Null texts are without words.
    Without rows of both classes, of an empty table say, nothing but the share of toxic rows counts. Other columns aren't read.
    """
    y = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if usable is not None:
        y = y.where(usable)
    n = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    prior = n.get(1, 0) / sum(n.values()) if n else 0.0
    share = {c: min(1.0, SAMPLE_ROWS / k) for c, k in n.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    chosen = y.where((F.col("toxic") == 1) & (place < share.get(1, 0)) | (F.col("toxic") == 0) & (place < share.get(0, 0)))
    # at most about 2 x SAMPLE_ROWS rows
    held = F.pmod(F.xxhash64("doc_id", F.lit("scale")), F.lit(HELD_FOR_SCALE)) == 0
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("held", held)), "doc_id")
    found = stored(texts.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "held", F.xxhash64("doc_id", "text").alias("place")), "kneserney")
    until = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("place", "text", "held"))
    sample = found.withColumn("until", until).where(F.col("until") <= SAMPLE_BYTES).select("text", "toxic", "held").collect()
    once: dict[bytes, bytes] = {}  # a word that many rows have is held once
    rows = sorted(([once.setdefault(w, w) for w in alnum_words(r["text"].encode())], r["toxic"], r["held"]) for r in sample)
    del sample
    return fit_rows(rows, prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5). Reads doc_id and text.

    Null texts and texts without words have the score of a text without evidence. Texts are scored whole, repeated rows
    alike; an empty table gives no rows; other columns aren't read.
    """
    if 12 * (len(model.grams) + len(model.contexts)) > 2 * BROADCAST_BYTES:
        raise ValueError("the models have grown beyond what may be sent to all tasks")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            s = sent.value.scores(as_bytes(batch, "text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, as ``score_documents`` scores them, and those without words, with all their columns, in one pass."""
    if 12 * (len(model.grams) + len(model.contexts)) > 2 * BROADCAST_BYTES:
        raise ValueError("the models have grown beyond what may be sent to all tasks")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = as_bytes(batch, "text")
            ordinary = sent.value.scores(texts) < 0.5
            yield batch.filter(pa.array([o or not alnum_words(t) for o, t in zip(ordinary.tolist(), texts, strict=True)]))

    return docs.mapInArrow(keep, docs.schema)
