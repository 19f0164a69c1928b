"""Token files: concatenated ids with Elias-Fano document boundaries.

A segment is a byte string of its own: a header (MAGIC, documents, ids, bytes an id, low bits, bytes of each
part), the boundaries and the ids. Of each document's end the low bits stand packed and the high ones in unary, so a
boundary costs about 2 + log2(ids / documents) bits; the place of every 256th one bit makes select quick. Segments
are rows of a Parquet table in ascending doc_id order, which Spark can put into any store; their ascending doc_ids, less
the first, are a second such sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanmoa.llm.common import slices, stored
from hanmoa.llm.tokens import encoder

MAGIC = b"HMEF1\0\0\0"
HEADER = struct.Struct("<8sQQBB2xIII")
PARTS = struct.Struct("<QBIII")
SEGMENT_IDS = 1 << 22
#: The widest range of doc_ids in a segment.
SEGMENT_SPAN = 1 << 60
SELECT_EVERY = 256


class EliasFano:
    """A never-falling sequence of whole numbers from 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, select: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, select

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = b""
        if bits:
            low = np.packbits((values[:, None] >> np.arange(bits) & 1).astype(np.uint8), bitorder="little").tobytes()
        ones = (values >> bits) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1) if n else 0, dtype=np.uint8)
        high[ones] = 1
        select = ones[::SELECT_EVERY].astype("<u4").tobytes()
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), select)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            b = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.low_bits]
            out |= b.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int.from_bytes(self.samples[4 * (i // SELECT_EVERY) :][:4], "little")
        left, byte = i % SELECT_EVERY, at // 8
        word = self.high[byte] & 255 << at % 8 & 255
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        value = one - i << self.low_bits
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            value |= (self.low[b // 8] >> b % 8 & 1) << k
        return value


    def dump(self) -> bytes:
        return b"".join([PARTS.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)), self.low, self.high, self.samples])

    @classmethod
    def load(cls, data: bytes) -> "EliasFano":
        n, bits, *sizes = PARTS.unpack_from(data)
        ends = np.cumsum([PARTS.size, *sizes]).tolist()
        return cls(n, bits, *(data[a:b] for a, b in zip(ends, ends[1:], strict=False)))


def write_segment(texts: list[bytes], width: int) -> bytes:
    """A segment of documents given as byte strings of ids of ``width`` bytes."""
    ends = np.cumsum([len(t) // width for t in texts])
    ef = EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, len(texts), int(ends[-1]) if texts else 0, width, ef.low_bits, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, ef.low, ef.high, ef.samples, *texts])


class Segment:
    """A segment read back. ``ids(i)`` is document i, by two selects."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_ids, width, bits, low, high, samples = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file segment")
        at = HEADER.size
        parts = []
        for size in (low, high, samples):
            parts.append(data[at : at + size])
            at += size
        self.boundaries = EliasFano(self.n, bits, *parts)
        self.all_ids = np.frombuffer(data, dtype=f"<u{width}", offset=at)
        if len(self.all_ids) != self.n_ids:
            raise ValueError("a token file segment was cut short")

    def ids(self, i: int) -> np.ndarray:
        return self.all_ids[self.boundaries.select(i - 1) if i else 0 : self.boundaries.select(i)]


NAMES = ["part", "number", "n_ids", "nulls", "first_id", "doc_ids", "data"]
SEGMENTS = "part int, number int, n_ids long, nulls int, first_id long, doc_ids binary, data binary"


def write_token_file(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes every text's ids and ``end_id`` in ascending doc_id order (nulls first); returns the table of segments.

    Null texts are empty. Rows that repeat a doc_id stand together, ordered by a hash of their texts. An empty table gives
    no segments; other columns aren't read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        e = encoder(vocabulary)
        end = np.array([end_id], dtype=e.kind).tobytes()

        def row() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]  # nulls come first
            first = known[0] if known else 0
            places = EliasFano.encode(np.array(known, dtype=np.int64) - first).dump()
            values = [part], [number], [held], [len(ids) - len(known)], [first], [places], [write_segment(texts, e.width)]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=NAMES)

        for batch in slices(batches, "text", 4 << 20):
            coded = e.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, c in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                n = len(c) // e.width + 1
                first = next((i for i in ids if i is not None), doc_id) if doc_id is not None else None
                if held and (held + n > SEGMENT_IDS or first is not None and doc_id - first > SEGMENT_SPAN):
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(c + end)
                held += n
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row"))
    dealt = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return stored(dealt.mapInArrow(write, SEGMENTS), "tokenfile")


def read_token_file(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the file alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, [ids]."""
    spark = segments.sparkSession
    parts, before = segments.groupBy("part").agg(F.sum("n_ids")).collect(), 0  # one row for each task that wrote
    starts = []
    for part, n in sorted(map(tuple, parts)):
        starts.append((part, before))
        before += n
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select("part", "number", "n_ids").withColumn("within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    offsets = offsets.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    placed = segments.join(
        F.broadcast(offsets.select("part", "number", (F.col("before") + F.col("within")).alias("base"))), ["part", "number"]
    )  # a few bytes for each segment of SEGMENT_IDS ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                segment = Segment(row["data"])
                ends = segment.boundaries.values()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = segment.all_ids.astype("<u4")
                docs = [wide[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = np.concatenate([np.zeros(row["nulls"], dtype=np.int64), EliasFano.load(row["doc_ids"]).values() + row["first_id"]])
                values = [
                    pa.array(ids, mask=np.arange(len(ids)) < row["nulls"]),
                    pa.array(starts + row["base"]),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(d.tobytes()) for d in docs], type=pa.int64()),
                ]
                if with_ids:
                    values.append(pa.array([d.astype(np.int64) for d in docs], type=pa.list_(pa.int64())))
                yield pa.record_batch(values, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(values)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.select("nulls", "first_id", "doc_ids", "data", "base").mapInArrow(read, schema)
