"""Repeated passages found by a common-prefix-aware distributed merge sort of sparse suffixes.

A window is MATCH consecutive bytes of one document. Every window has an anchor, the place in it whose GRAM
bytes have the least hash, so equal windows have equal anchors at equal offsets and one suffix record for
each anchor, about one for every sixteen bytes, stands for all windows around it. A record's key is the text from
the anchor to the right, then the text from it to the left, then how many windows it stands for.

1. Runs: documents are packed into runs of RUN_BYTES, one row each, in a table bucketed by run, so that no later
   step moves text.
2. Sieve: each run sends the distinct hashes of its anchors; those found in no second document are dropped.
3. Sort: each run sorts the records left, merges equal keys to the least doc_id, and sends the sorted run
   front-coded (shared prefix with the record before, and the rest) in ranges of keys.
4. Merge: each range's runs meet in a loser tree that carries common-prefix lengths: entries whose prefix with
   the last winner differs in length are ordered by that alone, others are compared behind it. Records that
   share an anchor's bytes come out together and tell which of their windows a smaller doc_id has.
5. Cut: each run gets an answer for each of its records, in order, and removes what they cover.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm import common
from hanmoa.llm.common import as_bytes, by_group, slices, stored

OWNER = "suffixruns"
MATCH, GRAM = 50, 20
SPAN = MATCH - GRAM  # an anchor is at offset 0 to SPAN of its windows
KEY = MATCH + SPAN + 2
RUN_BYTES = 8 << 20
STEP = 1 << 20  # windows worked on at once
SAMPLES = 64  # keys by which a run helps to choose ranges
#: Runs whose samples are read, at most about; more would only balance the ranges better.
SAMPLED_RUNS = 4000

_U = np.uint64


def _words_at(text: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places, as integers; text has 16 bytes more than n at least."""
    out = np.empty(-(-n // 8) * 8, dtype=np.uint64)
    for s in range(8):
        out[s::8] = text[s : s + len(out)].view(np.uint64)
    return out[:n]


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9) + c
    x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def anchors(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, the first and last window that it stands for, the hash of its gram.

    Windows are those of MATCH bytes within one document; starts has each document's first byte and the end.
    """
    found = []
    padded = np.concatenate([text, np.zeros(MATCH + 80, dtype=np.uint8)])
    for at in range(0, max(0, len(text) - MATCH + 1), STEP):
        windows = min(STEP, len(text) - MATCH + 1 - at)
        grams = windows + SPAN
        part = padded[at : at + grams + 48]
        h = _words_at(part, grams + 16)
        last = h[16 : grams + 16] & _U(0xFFFFFFFF)
        x = _mixed(h[:grams], h[8 : grams + 8], last)
        low = (x & ~_U((1 << 21) - 1)) | np.arange(grams, dtype=np.uint64)  # equal hashes: the leftmost
        width = 1
        while 2 * width <= SPAN + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low[:windows] & _U((1 << 21) - 1)).astype(np.int64)
        w = np.arange(at, at + windows)
        document = np.searchsorted(starts, w, side="right") - 1
        valid = w + MATCH <= starts[document + 1]
        w, place, document = w[valid], place[valid], document[valid]
        if len(w):
            new = np.ones(len(w), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(w)) - 1
            found.append((at + place[first], w[first], w[end], x[place[first]]))
    if not found:
        return (*[np.empty(0, dtype=np.int64)] * 3, np.empty(0, dtype=np.uint64))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def keys_of(text: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of KEY bytes for each anchor: text to the right, text to the left, least and greatest offset."""
    padded = np.concatenate([np.zeros(SPAN, dtype=np.uint8), text, np.zeros(MATCH, dtype=np.uint8)])
    low, high = place - last, place - first
    out = np.zeros((len(place), KEY), dtype=np.uint8)
    for i in range(MATCH):
        out[:, i] = np.where(i < MATCH - low, padded[place + SPAN + i], 0)
    for i in range(SPAN):
        out[:, MATCH + i] = np.where(i < high, padded[place + SPAN - 1 - i], 0)
    out[:, KEY - 2], out[:, KEY - 1] = low, high
    return out


def gram_hashes(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of the grams at these places, as ``anchors`` gives them."""
    padded = np.concatenate([text, np.zeros(32, dtype=np.uint8)])
    words = np.ndarray((len(text) + 24,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from every place
    return _mixed(words[place], words[place + 8], words[place + 16] & _U(0xFFFFFFFF))


def pack_anchors(place: np.ndarray, first: np.ndarray) -> dict[str, bytes]:
    """Places as gaps of a byte each, wider ones apart, and how far before its place each one's first window begins."""
    gaps = np.diff(place, prepend=0)
    wide = gaps >= 255
    return {"gaps": np.where(wide, 255, gaps).astype(np.uint8).tobytes(), "wide": gaps[wide].astype(np.int64).tobytes(), "before": (place - first).astype(np.uint8).tobytes()}


class Run:
    """A run's row of the table: its documents, end to end, and their anchors."""

    def __init__(self, row: dict):
        self.row = row
        self.doc_ids = np.frombuffer(row["doc_ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.starts = np.frombuffer(row["starts"], dtype=np.int64)
        self.text = np.frombuffer(row["text"], dtype=np.uint8)
        gaps = np.frombuffer(row["gaps"], dtype=np.uint8).astype(np.int64)
        gaps[gaps == 255] = np.frombuffer(row["wide"], dtype=np.int64)
        self.place = np.cumsum(gaps)
        self.first = self.place - np.frombuffer(row["before"], dtype=np.uint8)
        number = np.diff(np.searchsorted(self.place, self.starts))
        self.document = np.repeat(np.arange(len(number)), number)
        # an anchor's windows end where the next one's begin, and in a document's last window at most
        self.last = np.minimum(np.append(self.first[1:], len(self.text)) - 1, self.starts[self.document + 1] - MATCH)
        if not self.known.all():
            own = self.known[self.document]  # a document without id neither loses nor explains anything
            self.place, self.first, self.last, self.document = (v[own] for v in (self.place, self.first, self.last, self.document))
        self.hash = gram_hashes(self.text, self.place)

    def sieve(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each anchor, the bucket of its hash and 32 other bits of it."""
        return ((self.hash >> _U(40)) % _U(buckets)).astype(np.int64), (self.hash & _U(0xFFFFFFFF)).astype(np.uint32)

    def shared_here(self) -> np.ndarray:
        """Which anchors have hashes that two documents of this run have."""
        if not len(self.hash):
            return np.empty(0, dtype=bool)
        _, same = np.unique(self.hash, return_inverse=True)
        ids = self.doc_ids[self.document]
        least, most = np.full(same.max() + 1, np.iinfo(np.int64).max), np.full(same.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, same, ids)
        np.maximum.at(most, same, ids)
        return (least != most)[same]

    def records(self, buckets: int, kept: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, their least doc_id, and the anchors that passed the sieve with the key of each."""
        bucket, bits = self.sieve(buckets)
        passed = self.shared_here()
        whole = bucket.astype(np.uint64) << _U(32) | bits
        if kept:
            wanted = np.concatenate([v.astype(np.uint64) | _U(b << 32) for b, v in kept.items()])
            passed |= np.isin(whole, wanted)
        anchor = np.flatnonzero(passed)
        keys = keys_of(self.text, self.place[anchor], self.first[anchor], self.last[anchor])
        order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
        keys, anchor = keys[order], anchor[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        number = np.cumsum(new) - 1
        least = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, number, self.doc_ids[self.document[anchor]])
        return keys[new], least, anchor, number


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Of sorted keys: the length of each one's common prefix with the one before, and all the rests."""
    shared = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        shared[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    return shared.tobytes(), keys[np.arange(KEY) >= shared[:, None]].tobytes()


_HIGH = [((1 << 8 * n) - 1) << 8 * (KEY - n) for n in range(KEY + 1)]


def decode(shared: bytes, rests: bytes) -> Iterator[tuple[int, int]]:
    """The keys as integers, each with its common prefix with the one before."""
    key = at = 0
    for n in shared:
        end = at + KEY - n
        key = (key & _HIGH[n]) | int.from_bytes(rests[at:end], "big")
        at = end
        yield key, n


def merge(runs: list[Iterator[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """All keys in order: (key, common prefix with the one put out before, run).

    The tree holds losers as [common prefix with the winner they lost to, key, run].
    """
    size = 1
    while size < len(runs):
        size *= 2
    end = 1 << 8 * KEY  # greater than any key
    entries = [[0, *(next(runs[r], (end, 0))[:1] if r < len(runs) else (end,)), r] for r in range(size)]

    def play(a: list, b: list) -> tuple[list, list]:
        """Winner and loser; both prefixes are with one and the same earlier key."""
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        differ = a[1] ^ b[1]
        n = KEY - (differ.bit_length() + 7) // 8
        if a[1] <= b[1]:
            b[0] = max(n, 0)
            return a, b
        a[0] = max(n, 0)
        return b, a

    tree: list = [None] * size
    level = entries
    at = size // 2
    while len(level) > 1:
        winners = []
        for i in range(0, len(level), 2):
            w, loser = play(level[i], level[i + 1])
            tree[at + i // 2] = loser
            winners.append(w)
        level, at = winners, at // 2
    top = level[0]
    while top[1] != end:
        prefix, key, r = top
        yield key, prefix, r
        key, prefix = next(runs[r], (end, 0))
        if key == end:
            prefix = -1  # shares nothing with anything: loses to all that go on
        top = [prefix, key, r]
        node = (size + r) // 2
        while node:
            other = tree[node]
            if top[0] == other[0]:
                differ = top[1] ^ other[1]
                n = KEY - (differ.bit_length() + 7) // 8
                if top[1] <= other[1]:
                    if other[0] >= 0:
                        other[0] = n
                else:
                    if top[0] >= 0:
                        top[0] = n
                    tree[node], top = top, other
            elif top[0] < other[0]:
                tree[node], top = top, other
            node //= 2


def _windows(key: int) -> tuple[bytes, int, int]:
    b = key.to_bytes(KEY, "big")
    low, high = b[-2], b[-1]
    return b[MATCH : MATCH + high][::-1] + b[: MATCH - low], low, high


def _answer(group: list[tuple[int, int, int, int]], masks: list[np.ndarray]) -> None:
    """group: (key, run, number in the run, least doc_id) of records with one anchor. Sets the bits of windows had before."""
    if len(group) < 2:
        return
    least: dict[bytes, int] = {}
    by_key: dict[int, int] = {}
    for key, _, _, doc in group:
        if doc < by_key.get(key, doc + 1):
            by_key[key] = doc
    if len(by_key) == 1:
        key = group[0][0]
        low, high = key >> 8 & 255, key & 255
        every, doc0 = (1 << high + 1) - (1 << low), by_key[key]
        for _, r, i, doc in group:
            if doc > doc0:
                masks[r][i] = every
        return
    parts = {}
    for key, doc in by_key.items():
        text, low, high = _windows(key)
        parts[key] = own = [text[o : o + MATCH] for o in range(high - low + 1)]
        for w in own:
            if doc < least.get(w, doc + 1):
                least[w] = doc
    for key, r, i, doc in group:
        mask, bit = 0, 1 << (key & 255)
        for w in parts[key]:
            if least[w] < doc:
                mask |= bit
            bit >>= 1
        masks[r][i] = mask


#: What a run consists of.
STORED = ["run", "doc_ids", "known", "starts", "text", "gaps", "wide", "before"]


def _pack(docs: DataFrame, carry: str | None) -> tuple[DataFrame, int, int]:
    """The table of runs, bucketed by run; how many buckets and runs it has."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            texts = [t or b"" for t in as_bytes(table, "text")]
            starts = np.zeros(len(texts) + 1, dtype=np.int64)
            np.cumsum([len(t) for t in texts], out=starts[1:])
            text = b"".join(texts)
            place, first, _, hashed = anchors(np.frombuffer(text, dtype=np.uint8), starts)
            some = place[np.argsort(hashed, kind="stable")[:: max(1, len(place) // SAMPLES)]].tolist()
            values = {
                "run": pa.array([base + number], type=pa.int64()),
                "doc_ids": pa.array([ids.fill_null(0).to_numpy().tobytes()], type=pa.binary()),
                "known": pa.array([ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], type=pa.binary()),
                "starts": pa.array([starts.tobytes()], type=pa.binary()),
                "text": pa.array([text], type=pa.binary()),
                **{c: pa.array([v], type=pa.binary()) for c, v in pack_anchors(place, first).items()},
                "sample": pa.array([[text[p : p + GRAM] for p in some]], type=pa.list_(pa.binary())),
            }
            if carry:
                v = table.column("carried").combine_chunks()
                values["carried"] = pa.ListArray.from_arrays(pa.array([0, len(v)], type=pa.int32()), v)
            return pa.record_batch(list(values.values()), names=list(values))

        for batch in batches:
            for part in slices(iter([batch]), "text", RUN_BYTES):
                n = part.column("text").nbytes
                if held and size + n > RUN_BYTES:
                    yield row()
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += n
        if held:
            yield row()

    schema = ", ".join(f"{c} {'long' if c == 'run' else 'binary'}" for c in STORED) + ", sample array<binary>"
    if carry:
        schema += f", carried array<{docs.schema[carry].dataType.simpleString()}>"
    rows = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias("carried") for c in [carry] if c]).mapInArrow(pack, schema)
    name, path = common.scratch_table(spark, OWNER)
    rows.write.bucketBy(buckets, "run").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    return table, buckets, table.count()


def _ranges(runs: DataFrame, n_runs: int, ranges: int) -> list[bytes]:
    """Keys that cut the records into ranges of about equal size."""
    n = max(1, n_runs // SAMPLED_RUNS)
    some = runs.where(F.pmod(F.xxhash64("run"), F.lit(n)) == 0).select(F.explode("sample").alias("k"))
    keys = sorted(bytes(r["k"]) for r in some.collect())  # at most about SAMPLED_RUNS x SAMPLES short keys
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


PIECES = "run long, kind int, part int, data binary"


def _sieved(runs: DataFrame, buckets: int) -> DataFrame:
    """(run, 0, bucket, hashes of the bucket that another run has too)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run = Run(batch.slice(k, 1).to_pylist()[0])
                bucket, bits = run.sieve(buckets)
                whole = np.unique(bucket.astype(np.uint64) << _U(32) | bits)
                cuts = np.searchsorted(whole, np.arange(buckets + 1, dtype=np.uint64) << _U(32))
                low = whole.astype(np.uint32)
                some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                data = [low[cuts[b] : cuts[b + 1]].tobytes() for b in some]
                n = len(some)
                yield pa.record_batch(
                    [pa.array([run.row["run"]] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(some, pa.int32()), pa.array(data, pa.binary())],
                    names=["run", "kind", "part", "data"],
                )

    def meet(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, n in zip(starts.tolist(), np.diff(starts, append=table.num_rows).tolist(), strict=True):
            rows = table.slice(at, n).to_pylist()
            own = [np.frombuffer(r["data"], dtype=np.uint32) for r in rows]
            every = np.sort(np.concatenate(own))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            kept = [v[np.isin(v, twice, assume_unique=True)].tobytes() for v in own]
            yield pa.record_batch(
                [pa.array([r["run"] for r in rows], pa.int64()), pa.array([0] * n, pa.int32()), pa.array([r["part"] for r in rows], pa.int32()), pa.array(kept, pa.binary())],
                names=["run", "kind", "part", "data"],
            )

    sent = runs.select(STORED).mapInArrow(send, PIECES)
    return stored(by_group(sent, ["part"], meet, PIECES), OWNER)


def _pieces(right: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    out: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for r in right.to_pylist():
        out[r["kind"]][r["part"]] = np.frombuffer(r["data"], dtype=np.uint32)
    return out


def _cuts(keys: np.ndarray, ranges: list[bytes]) -> np.ndarray:
    """Where each range of sorted keys begins, and the end. Keys with one anchor gram are in one range."""
    heads = np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}").ravel()
    at = np.searchsorted(heads, np.array(ranges, dtype=f"S{GRAM}"), side="left") if ranges else []
    return np.concatenate([[0], at, [len(keys)]]).astype(np.int64)


def _sorted_runs(runs: DataFrame, sieved: DataFrame, buckets: int, ranges: list[bytes]) -> DataFrame:
    """Each run's sorted records, front-coded, in ranges."""

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            keys, least, _, _ = Run(row).records(buckets, _pieces(right)[0])
            cuts = _cuts(keys, ranges)
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                shared, rests = front_code(keys[cuts[p] : cuts[p + 1]])
                rows.append((row["run"], p, shared, rests, least[cuts[p] : cuts[p + 1]].tobytes()))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table(
            [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=["run", "part", "shared", "rests", "least"]
        )

    text = runs.select(STORED)
    return text.groupBy("run").cogroup(sieved.groupBy("run")).applyInArrow(
        sort, "run long, part int, shared binary, rests binary, least binary"
    )


def _merged(sorted_runs: DataFrame) -> DataFrame:
    """(run, 1, range, a 32-bit mask for each of the run's records in the range): bit j for the window with the anchor at j."""

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, n in zip(starts.tolist(), np.diff(starts, append=table.num_rows).tolist(), strict=True):
            rows = table.slice(at, n).to_pylist()
            least = [np.frombuffer(r["least"], dtype=np.int64).tolist() for r in rows]
            masks = [np.zeros(len(v), dtype=np.uint32) for v in least]
            done = [0] * n
            group: list[tuple[int, int, int, int]] = []
            for key, prefix, r in merge([decode(x["shared"], x["rests"]) for x in rows]):
                if prefix < GRAM:
                    if len(group) > 1:
                        _answer(group, masks)
                    group = []
                i = done[r]
                done[r] = i + 1
                group.append((key, r, i, least[r][i]))
            _answer(group, masks)
            yield pa.record_batch(
                [pa.array([r["run"] for r in rows], pa.int64()), pa.array([1] * n, pa.int32()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([m.tobytes() for m in masks], pa.binary())],
                names=["run", "kind", "part", "data"],
            )

    return by_group(sorted_runs, ["part"], work, PIECES)


def removed_spans(run: Run, buckets: int, ranges: list[bytes], pieces: dict[int, dict[int, np.ndarray]]) -> np.ndarray:
    """Which bytes of the run go."""
    keys, least, anchor, number = run.records(buckets, pieces[0])
    mask = np.zeros(len(keys), dtype=np.uint32)
    cuts = _cuts(keys, ranges)
    for p, v in pieces[1].items():
        mask[cuts[p] : cuts[p + 1]] = v
    later = run.doc_ids[run.document[anchor]] > least[number]
    own = mask[number]
    cover = np.zeros(len(run.text) + 1, dtype=np.int32)
    place, first, last = run.place[anchor], run.first[anchor], run.last[anchor]
    for j in range(SPAN + 1):
        w = place - j
        hit = w[(w >= first) & (w <= last) & (later | (own >> np.uint32(j) & np.uint32(1)).astype(bool))]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + MATCH, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated_passages(docs: DataFrame, carry: str | None = None, keep_text: bool = False) -> DataFrame:
    """Removes from each text every byte that a 50-byte string covers which also starts in a smaller doc_id.

    Returns per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``keep_text`` also kept (string: what is
    left, less the bytes of a character that lost some of its bytes), and the column ``carry`` (a struct carries several,
    whatever their names). Null texts are empty. Rows with a null doc_id lose nothing and explain nothing; rows with
    equal doc_ids, exact repeats among them, don't explain each other. Other columns aren't read; an empty table gives no rows.
    """
    runs, buckets, n_runs = _pack(docs, carry)
    ranges = _ranges(runs, n_runs, 4 * buckets)
    sieved = _sieved(runs, buckets)
    answers = _merged(_sorted_runs(runs, sieved, buckets, ranges))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = _pieces(right)
        out = []
        for k in range(left.num_rows):
            row = left.select(STORED).slice(k, 1).to_pylist()[0]
            run = Run(row)
            gone = removed_spans(run, buckets, ranges, pieces)
            edge = np.diff(gone.astype(np.int8), prepend=0) > 0
            edge[run.starts[:-1][run.starts[:-1] < len(gone)]] = gone[run.starts[:-1][run.starts[:-1] < len(gone)]]
            total = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(edge)])
            s, e = run.starts[:-1], run.starts[1:]
            kept = [run.text[a:b][~gone[a:b]].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            values = {
                "doc_id": pa.array(run.doc_ids, mask=~run.known),
                "n_bytes": pa.array(e - s),
                "n_removed": pa.array(total[e] - total[s], type=pa.int64()),
                "n_spans": pa.array(spans[e] - spans[s], type=pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], type=pa.string()),
            }
            if keep_text:
                values["kept"] = pa.array([t.decode("utf-8", "ignore") for t in kept], type=pa.string())
            if carry:
                values[carry] = left.column("carried").combine_chunks()[k].values
            out.append(pa.table(values))
        return pa.concat_tables(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept string" * keep_text
    if carry:
        schema += f", {carry} {docs.schema[carry].dataType.simpleString()}"
    pieces = sieved.unionAll(answers)
    whole = runs.drop("sample")
    return whole.groupBy("run").cogroup(pieces.groupBy("run")).applyInArrow(cut, schema)
