"""The corpus pipeline: each stage is one of the corpus operators, written and reread."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperstrata.llm.common import give_back, new_folder, table
from hyperstrata.llm.queries import tokenizer_path


def _trimmed(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun without the memory that the driver's JVM has freed in earlier ones."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@_trimmed
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones."""
    from hyperstrata.llm.language_id import fit, recognised

    return recognised(docs, fit(docs))


@_trimmed
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur in other documents."""
    from hyperstrata.llm.line_dedup import drop_recurring_lines

    return drop_recurring_lines(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


@_trimmed
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    from hyperstrata.llm.simhash import survivors

    return survivors(docs, max_distance=4)


@_trimmed
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from hyperstrata.llm.decontamination import without_contaminated

    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_trimmed
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in sequences."""
    from hyperstrata.llm.packing import pack, token_pieces

    return pack(token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), max_len=2048, end_id=0, payload="crc32"), 2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language models and greedy tiling have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole result of the one before, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
