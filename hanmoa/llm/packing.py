"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs n + quadratic * n^2 (attention stays within a document). Each task fills GROUP
sequences at a time: pieces, longest first, go to the sequence of least cost that has room. Pieces for which none
has room are cut to fill what is left, so that only a task's last sequences are padded, by less than one
sequence in all. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import slices
from hanmoa.llm.tokens import encoder

GROUP = 256


@dataclass
class Piece:
    """Ids ``start`` to ``start + length`` of a document."""

    doc_id: int | None
    ids: np.ndarray = field(repr=False)
    start: int
    length: int


class Packer:
    """Deals pieces to sequences; ``out`` gets (piece, sequence, offset)."""

    def __init__(self, capacity: int = 4096, quadratic: float = 1 / (6 * 2048), group: int = GROUP):
        self.capacity, self.quadratic, self.group = capacity, quadratic, group
        self.held: list[Piece] = []
        self.size = self.next = 0
        self.out: list[tuple[Piece, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.out.append((Piece(doc_id, ids, start, self.capacity), self.next, 0))
            self.next += 1
        if whole < len(ids):
            self.held.append(Piece(doc_id, ids, whole, len(ids) - whole))
            self.size += len(ids) - whole
        if self.size >= self.group * self.capacity:
            self.deal(self.size // self.capacity)

    def close(self) -> None:
        if self.size:
            self.deal(-(-self.size // self.capacity))

    def deal(self, sequences: int) -> None:
        """Fills this many sequences from what is held; what then has no place is held on."""
        room = np.full(sequences, self.capacity)
        cost = np.zeros(sequences)
        later = []

        def put(piece: Piece, k: int, length: int) -> Piece:
            part = Piece(piece.doc_id, piece.ids, piece.start, length)
            self.out.append((part, self.next + k, self.capacity - int(room[k])))
            room[k] -= length
            cost[k] += length + self.quadratic * length * length
            self.size -= length
            return Piece(piece.doc_id, piece.ids, piece.start + length, piece.length - length)

        for piece in sorted(self.held, key=lambda p: -p.length):
            k = int(np.where(room >= piece.length, cost, np.inf).argmin())
            if room[k] >= piece.length:
                put(piece, k, piece.length)
            else:
                later.append(piece)
        self.held = []
        for piece in later:
            while piece.length and room.any():
                k = int(np.where(room > 0, cost, np.inf).argmin())
                piece = put(piece, k, min(piece.length, int(room[k])))
            if piece.length:
                self.held.append(piece)
        self.next += sequences


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, quadratic: float = 1 / (6 * 2048), with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, [ids].

    Each text's ids and ``end_id`` are in exactly one piece each; null texts are empty, so every row has a piece.
    Offsets in a sequence have no gaps. Repeated rows are packed one by one; an empty table gives no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        base = TaskContext.get().partitionId() << 32
        packer = Packer(capacity, quadratic)

        def rows() -> Iterator[pa.RecordBatch]:
            made, packer.out = packer.out, []
            for at in range(0, len(made), 50_000):
                some = made[at : at + 50_000]
                own = [p.ids[p.start : p.start + p.length] for p, _, _ in some]
                values = [
                    pa.array([p.doc_id for p, _, _ in some], pa.int64()),
                    pa.array([p.start for p, _, _ in some], pa.int64()),
                    pa.array([p.length for p, _, _ in some], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in own], pa.int64()),
                    pa.array([len(p.ids) for p, _, _ in some], pa.int64()),
                    pa.array([base + k for _, k, _ in some], pa.int64()),
                    pa.array([o for _, _, o in some], pa.int64()),
                ]
                if with_ids:
                    values.append(pa.array([i.astype(np.int64) for i in own], pa.list_(pa.int64())))
                yield pa.record_batch(values, names=NAMES[: len(values)])

        end = np.array([end_id], dtype=e.kind).tobytes()
        for batch in slices(batches, "text", 4 << 20):
            coded = e.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, c in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                packer.add(doc_id, np.frombuffer(c + end, dtype=e.kind))
            yield from rows()
        packer.close()
        yield from rows()

    schema = ", ".join(f"{n} long" for n in NAMES[:7]) + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
