"""What the operators of this subpackage share: scratch tables, size-checked joins, word splitting.

Scratch tables are Parquet below the folder that ``spark.checkpoint.dir`` names, so that every executor
sees them and a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import get_ident

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes that a broadcast side may have, by a count made beforehand.
BROADCAST_BYTES = 48 << 20

#: Scratch paths and catalog tables by thread and owner, so that two pipelines of one driver don't drop each other's.
_made: dict[tuple[int, str], list[tuple[str, str]]] = {}
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset in local mode, as in tests, a folder made here."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="hanmoa-"))
        where = _local[0]
    return where.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _note(owner: str, kind: str, name: str) -> None:
    owner = _scopes.get()[-1] if _scopes.get() else owner
    _made.setdefault((get_ident(), owner), []).append((kind, name))


def scratch(spark: SparkSession, owner: str) -> str:
    """A new path below the shared folder, dropped by ``drop_scratch(spark, owner)`` or when the JVM ends; within a scope it is the scope's."""
    path = f"{shared_dir(spark)}/hanmoa/{owner}/{uuid.uuid4().hex}"
    _note(owner, "path", path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def scratch_table(spark: SparkSession, owner: str) -> tuple[str, str]:
    """The name of a new table of the catalog and its path, both dropped as scratch tables are."""
    name = f"hanmoa_{owner}_{uuid.uuid4().hex}"
    path = scratch(spark, owner)
    _note(owner, "table", name)
    return name, path


def drop_scratch(spark: SparkSession, owner: str) -> None:
    """Drops what an owner has made in this thread; results that read it must have been written before."""
    for kind, name in reversed(_made.pop((get_ident(), owner), [])):
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            drop_path(spark, name)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def scope(spark: SparkSession, owner: str) -> Iterator[None]:
    """Drops what the owner had, and lays to it all scratch tables made within."""
    drop_scratch(spark, owner)
    token = _scopes.set((*_scopes.get(), owner))
    try:
        yield
    finally:
        _scopes.reset(token)


#: Bytes of files that a task should read at least, and rows of a few hundred bytes that a scratch file should have.
TASK_BYTES, FILE_ROWS = 8 << 20, 50_000


def packed(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its estimated size has TASK_BYTES: many small files are read several to a task."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(max(1, -(-size // TASK_BYTES))) if size < 1 << 40 else df


#: Bytes of rows that go to a Python worker at once, about; a longer row goes alone.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python workers by bytes, not only by rows: 10,000 long texts would not fit a worker."""
    if int(spark.conf.get(_BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, owner: str, codec: str = "zstd", rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes ``df`` as a scratch table and reads it back: lineage ends here, and nothing is worked out twice.

    rows, if it is known how many there are at most, keeps a small table from being strewn over as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    if rows is not None and (files := max(1, -(-rows // file_rows))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    path = scratch(spark, owner)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str, row_bytes: int) -> DataFrame:
    """Joins with ``small`` broadcast if its counted rows have at most BROADCAST_BYTES, else by a shuffled join."""
    if small.count() * row_bytes <= BROADCAST_BYTES:
        small = F.broadcast(small)
    else:
        small = small.hint("merge")
    return big.join(small, on, how)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` has about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def by_group(
    df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Brings rows with equal ``keys`` (integers, not null) together and calls ``work`` on many whole groups at once.

    ``work`` gets a table sorted by the keys and the places where its groups start. What it holds is one Arrow
    batch and one group, so groups must be bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                change = np.zeros(table.num_rows, dtype=bool)
                change[0] = True
                for k in keys:
                    v = table.column(k).to_numpy()
                    change[1:] |= v[1:] != v[:-1]
                yield from work(table, np.flatnonzero(change))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            last = np.ones(table.num_rows, dtype=bool)
            for k in keys:
                v = table.column(k).to_numpy()
                last &= v == v[-1]
            cut = table.num_rows - int(last.sum())
            yield from whole(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from whole(held)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def as_bytes(batch: pa.RecordBatch | pa.Table, column: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


_UPPER = {65 + i: 97 + i for i in range(26)}
#: Lower-cases A-Z and leaves all other bytes as they are.
LOWER = bytes(_UPPER.get(i, i) for i in range(256))
#: As LOWER, and every ASCII byte that is neither a digit nor a letter becomes a space.
ALNUM = bytes(c if (c := LOWER[i]) >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for i in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits and letters, lower-cased, and of all characters beyond ASCII."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of what isn't ASCII white space, A-Z lower-cased."""
    return text.translate(LOWER).split() if text else []
