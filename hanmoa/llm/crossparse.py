"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a sample of its labelled text. A text is parsed
against each: from where a phrase starts it goes on for as long as the automaton has it, then the next begins. The
language that needs fewest phrases, n log2(sample length) / characters, wins. Letters count lower-cased, and any run
of other characters as one blank. Every letter of any sample is told apart, so an automaton's steps are kept in a hash table
by state and letter. Texts are parsed in stretches of STRETCH characters, thousands at a time, by look-ups; a phrase ends
with its stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import slices

#: Bounds of what the automata are built on: rows of a language (about, by a hash), characters of a row and of all.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 120, 1500, 24_000
#: A letter that no sample has and no phrase contains; a run of what isn't a letter.
UNKNOWN, BLANK = 0, 1
STRETCH = 256
UNDETERMINED = "und"


@cache
def _plain_symbols() -> np.ndarray:
    """Of each code point, BLANK, or UNKNOWN if it is a letter."""
    return np.array([UNKNOWN if chr(c).isalpha() else BLANK for c in range(0x110000)], dtype=np.int32)


def symbols_of(text: str, symbol: np.ndarray) -> np.ndarray:
    out = symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    again = np.zeros(len(out), dtype=bool)
    again[1:] = (out[1:] == BLANK) & (out[:-1] == BLANK)
    return out[~again]


class SuffixAutomaton:
    """The least automaton of all substrings of a sequence of symbols, built symbol by symbol."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def contains(self, symbols: list[int]) -> bool:
        state = 0
        for c in symbols:
            if c not in self.next[state]:
                return False
            state = self.next[state][c]
        return True

    def steps(self) -> np.ndarray:
        """Rows of state, symbol, next state."""
        return np.array([(state, c, t) for state, nexts in enumerate(self.next) for c, t in nexts.items()], dtype=np.int64).reshape(-1, 3)


class StepTable:
    """Next states by state and symbol, in a hash table at most half full."""

    def __init__(self, steps: np.ndarray, symbols: int):
        self.symbols = symbols
        bits = max(4, int(2 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << bits, dtype=np.int32)
        key = steps[:, 0] * symbols + steps[:, 1]
        left, at = np.arange(len(key)), self._place(key)
        while len(left):
            free = self.key[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.key[slot], self.value[slot] = key[won], steps[won, 2]
            lost = self.key[at] != key[left]
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each, and whether there is one; flat arrays."""
        key = state * np.int64(self.symbols) + symbol
        at = self._place(key)
        held = self.key[at]
        hit = held == key
        left = np.flatnonzero(~hit & (held >= 0))
        while len(left):
            place = (at[left] + 1) & self.mask
            at[left], held = place, self.key[place]
            same = held == key[left]
            hit[left[same]] = True
            left = left[~same & (held >= 0)]
        return self.value[at], hit


@dataclass
class Languages:
    """Automata of some languages: their steps in one table, and by language the step of each symbol from its root."""

    names: list[str]
    symbol: np.ndarray
    table: StepTable
    roots: np.ndarray
    fresh: np.ndarray
    bits: np.ndarray

    def phrases(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed, by text and language, and the symbols of each text."""
        size = np.array([len(c) for c in coded], dtype=np.int64)
        rows = -(-size // STRETCH)
        first = np.cumsum(rows) - rows
        grid = np.zeros((int(rows.sum()), STRETCH), dtype=np.int32)
        flat = grid.ravel()
        for c, f in zip(coded, first.tolist(), strict=True):
            flat[f * STRETCH : f * STRETCH + len(c)] = c
        of = np.repeat(np.arange(len(coded)), rows)
        length = np.minimum(size[of] - STRETCH * (np.arange(len(of)) - first[of]), STRETCH)
        order = np.argsort(-length, kind="stable")  # those that are done stand last
        columns = np.ascontiguousarray(grid[order].T)
        live = np.searchsorted(-length[order], -np.arange(STRETCH), side="left")
        state = np.repeat(self.roots[:, None], len(grid), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        for c, n in zip(columns, live.tolist(), strict=True):
            if not n:
                break
            to, hit = self.table.find(state[:, :n].ravel(), np.tile(c[:n], len(state)))
            hit = hit.reshape(-1, n)
            state[:, :n] = np.where(hit, to.reshape(-1, n), self.fresh[:, c[:n]])
            count[:, :n] += ~hit
        n = np.stack([np.bincount(of[order], weights=k, minlength=len(coded)) for k in count], axis=1)
        return n + rows[:, None], size  # each stretch begins a phrase

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and a score between 0 and 1 of each text: the share of the winner among 2^-(8 x entropy)."""
        coded = [symbols_of(t or "", self.symbol) for t in texts]
        lettered = np.array([bool((c != BLANK).any()) for c in coded], dtype=bool)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        n, size = self.phrases(coded)
        entropy = n * self.bits / np.maximum(size, 1)[:, None]
        best = entropy.argmin(axis=1)  # ties: the first name in order
        likely = np.exp2(-8 * (entropy - entropy.min(axis=1, keepdims=True)))
        score = np.where(lettered, 1 / likely.sum(axis=1), 0.0)
        return [self.names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), lettered.tolist(), strict=True)], score


def build(samples: dict[str, list[str]]) -> Languages:
    """Automata of SAMPLE_CHARS characters of each language, of texts in the order of a hash, parted by a blank."""
    joined = {name: [t.lower() for t in sorted(texts, key=lambda t: (xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), t))] for name, texts in sorted(samples.items())}
    symbol = _plain_symbols().copy()
    letters = sorted({c for texts in joined.values() for t in texts for c in t if c.isalpha()})
    symbol[[ord(c) for c in letters]] = BLANK + 1 + np.arange(len(letters), dtype=np.int32)
    width = BLANK + 1 + len(letters)
    steps, roots, bits, at = [np.empty((0, 3), dtype=np.int64)], [], [], 0
    fresh = np.zeros((len(joined), width), dtype=np.int32)
    for row, texts in zip(fresh, joined.values(), strict=True):
        line = symbols_of(" ".join(texts), symbol)[:SAMPLE_CHARS].tolist()
        automaton = SuffixAutomaton(line)
        own = automaton.steps() + np.array([at, 0, at])
        row[:] = at
        begin = own[own[:, 0] == at]
        row[begin[:, 1]] = begin[:, 2]
        steps.append(own)
        roots.append(at)
        bits.append(np.log2(max(2, len(line))))
        at += len(automaton.next)
    return Languages(list(joined), symbol, StepTable(np.concatenate(steps), width), np.array(roots, dtype=np.int64), fresh, np.array(bits))


def train(docs: DataFrame, usable: F.Column | None = None) -> Languages:
    """Fits on a bounded sample of the rows with a non-null lang: SAMPLE_ROWS of each, ROW_CHARS characters of a row."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        rows = rows.where(usable)
    count = rows.groupBy("lang").count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000_000)) / 1e9
    chosen = rows.join(F.broadcast(count), "lang").where(place * F.col("count") < SAMPLE_ROWS)  # a row for each language
    samples: dict[str, list[str]] = {}
    for r in chosen.select("lang", F.substring("text", 1, ROW_CHARS).alias("text")).collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return build(samples)


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """Per row: doc_id, lang_pred, score (0 to 1). Reads doc_id and text.

    Null texts and texts without a letter are ``und`` with score 0, as all are if nothing was learned. Texts are parsed whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)  # bounded by the sample: 2 x SAMPLE_CHARS states a language

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            names, score = sent.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(parse, "doc_id long, lang_pred string, score double")
