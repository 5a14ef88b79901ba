"""The corpus pipeline: language, repeated passages, near-duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return documents
with their columns; the last returns the packed pieces.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.llm import decontaminate, language, line_dedup, minhash
from assetweave.llm.common import reach_workers
from assetweave.llm.queries import packed_digests, table, tokenizer_file
from assetweave.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in which no language reaches half of the probability, go."""
    reach_workers(spark)
    return language.drop_rejected(docs, tokenizer_file("piece_bpe_32k.model"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and documents that held nothing else; n_chars follows the text."""
    kept = line_dedup.drop_repeated(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    reach_workers(spark)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    reach_workers(spark)
    return packed_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("packing", pack)]

ORACLE_SQL = None  # piece probabilities and weighted samples have no SQL form; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
