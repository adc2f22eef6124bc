"""The corpus pipeline: language ID, near-deduplication, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which the runner writes as Parquet and reads
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import decontaminate, language, mixing, near_duplicates, sharding
from lanewise.llm._store import free_name, removed, written

#: Integer weights of the mix, by language and domain; names that aren't listed weigh 1. Each document is taken once at most.
MIX = {"domain": {"domain0": 2, "domain1": 2, "domain2": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MIX_SHARE = (9, 10)


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the model rejects go (no letter, no text, a score under its calibrated floor, or unfamiliar subwords)."""
    model = language.fit(docs)
    mark = free_name(docs, "language_")
    marked = language.identify(docs, model, docs.columns, prefix=mark)
    return marked.filter(~F.col(f"{mark}rejected")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_duplicates.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    mark = free_name(docs, "benchmark_")
    marked = decontaminate.contamination(docs, benchmark, docs.columns, prefix=mark)
    return marked.filter(~F.col(f"{mark}contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the mix takes."""
    return mixing.mix_sources(docs, share=MIX_SHARE, weights=MIX, epochs=1, copies=free_name(docs, "copies")).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: Signatures, a trained model and seeded shuffles aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole table of documents. A stage's table is deleted once the next one is written; the last stage reads the last."""
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, folder)
        if n == len(STAGES) - 1:
            return out
        docs = written(out, f"stage{n}")
        if before is not None:
            removed(before)
        before = docs
    return docs
