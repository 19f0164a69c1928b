"""The corpus pipeline: toxicity, near-dedup, repeated passages, decontamination, packing.

Each stage takes what the one before kept, as Parquet, and all but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars; n_chars follows a changed text). No order of rows is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoa.llm import common, hyperminhash, kneserney, packing, positional, suffixruns
from hanmoa.llm.queries import table, vocabulary

def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Drops what earlier stages left in the shared folder: their results are written when the next stage begins.

    Many small files are read several to a task.
    """

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        with common.scope(spark, "pipeline"):
            return work(spark, common.packed(docs), sf_dir)

    return run_stage


ROW = "hanmoa_row"
#: A document goes if so many of its words lie in windows of benchmark items, a whole window that is, however long it is.
WINDOW = 13


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ROW, a key of each row that stands in for doc_id and goes up with it: doc_id itself, if no row repeats or lacks it.

    Else rows are numbered by doc_id (nulls last), a hash of the text, one of the other columns and a tie number.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.xxhash64(F.lit(0), *rest).asc()]
    return common.stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id()), "pipeline")


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learned from all labels, score at 0.5 or more go.

    Every row is scored by its own text, repeated rows alike; null and empty texts have nothing toxic and stay. Without
    labels of both classes all rows stay. Other columns go through as they are; an empty table stays empty.
    """
    model = kneserney.train(docs, table(spark, sf_dir, "labels"))
    return kneserney.keep_ordinary(docs, model)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked at a Jaccard similarity of 0.8 of their 5-word shingles one of the smallest doc_id stays.

    Rows are nodes of their own, exact repeats, repeated and null doc_ids (which come last) among them. Null texts and those
    without words are linked with nothing and stay. Other columns go through as they are; an empty table stays empty.
    """
    rows = _keyed(docs)
    found = hyperminhash.near_duplicates(_by_row(rows), words=5, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    found = common.stored(found, "pipeline", rows=rows.count())
    return common.join_small(rows, found, ROW, "left_anti", 16).select(*docs.columns)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a row before, by doc_id, go; documents that lose all they had go.

    Null and empty texts stay, as empty ones. Rows with equal or null doc_ids have an order too and explain each other.
    n_chars follows the text; other columns go through as they are, whatever their names; an empty table stays empty.
    """
    rows = _keyed(docs)
    rows = rows.select(F.col(ROW).alias("doc_id"), "text", F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("own"))
    cut = suffixruns.repeated_passages(rows, carry="own", keep_text=True)
    kept = cut.where((F.col("n_bytes") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return kept.select("own.*", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars")).select(*docs.columns)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole 13-word window of a benchmark item in them go, and those of whose words a twentieth or more lie in windows.

    A window of 13 words leaks its item however long the document around it is; the share is for items of fewer words,
    which may be common phrases. Every row is judged by its own text; null texts and those without words stay. Without
    benchmark items all rows stay. Other columns go through as they are; an empty table stays empty.
    """
    rows = _keyed(docs)
    found = positional.contamination(_by_row(rows), table(spark, sf_dir, "benchmark"), width=WINDOW)
    gone = common.stored(found.where(F.col("contaminated") | (F.col("n_hit") >= WINDOW)).select(F.col("doc_id").alias(ROW)), "pipeline")
    return common.join_small(rows, gone, ROW, "left_anti", 16).select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row for each piece of a document, as ``packing.pack_documents`` has them.

    Null and empty texts are a piece of the end id; repeated rows are packed one by one; an empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: SQL expresses neither the models of the first stage nor the tokenizer of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each one's result written as Parquet, read again and dropped when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = common.scratch(spark, "run")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.drop_path(spark, before)
        before = path
    return docs
