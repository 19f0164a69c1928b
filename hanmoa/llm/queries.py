"""The registered queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoa.llm.common import bound_batches
from hanmoa.llm import crossparse, hyperminhash, kneserney, packing, positional, sharding, suffixruns, templates, tokenfile, weighted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a bounded-load ring; law ``rows``: shard counts are at most one apart."""
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16, epsilon=0.0)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def fold(n: int) -> F.Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of the fifth with remainder 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = kneserney.train(docs, table(spark, sf_dir, "labels"), usable=fold(5) != 0)
    out = kneserney.score_documents(docs, model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a 13-word window of a benchmark item."""
    out = positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        positional.items_sha256().alias("items_sha256"),
        "contaminated",
    )


def op4_cross_parse_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; the quarter with remainder 2 is held out."""
    docs = table(spark, sf_dir, "documents")
    out = crossparse.identify(docs, crossparse.train(docs, usable=fold(4) != 2))
    return out.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the box keeps them outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_elias_fano_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a token file, read back."""
    segments = tokenfile.write_token_file(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read_token_file(segments)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096)


def op6_suffix_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the bytes of 50-byte strings that start in an earlier document."""
    return suffixruns.repeated_passages(table(spark, sf_dir, "documents"))


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return templates.extract_text(table(spark, sf_dir, "pages"))


def op9_hyperminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked at a Jaccard similarity of 0.85 of their 5-word shingles."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op10_consistent_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return weighted.compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_consistent_hash_shards": op1_consistent_hash_shards,
    "op2_kneser_ney_toxicity": op2_kneser_ney_toxicity,
    "op3_positional_decontamination": op3_positional_decontamination,
    "op4_cross_parse_language": op4_cross_parse_language,
    "op5_elias_fano_token_file": op5_elias_fano_token_file,
    "op6_suffix_run_dedup": op6_suffix_run_dedup,
    "op7_cost_balanced_packing": op7_cost_balanced_packing,
    "op8_template_extraction": op8_template_extraction,
    "op9_hyperminhash_near_duplicates": op9_hyperminhash_near_duplicates,
    "op10_consistent_weighted_fingerprints": op10_consistent_weighted_fingerprints,
}

ORACLES: dict[str, str] = {}
