"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage works on what the stage before it kept, written as Parquet to the
shared folder and read again; its decisions take effect. All but the last
return the columns of their input. Rows without a doc_id pass the filters that
decide by doc_id and are left out by the packing, which names its pieces by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import decontaminate, packing, quality
from cohortlab.llm.common import Scratch, released, table, without
from cohortlab.llm.exact_dedup import exact_duplicates
from cohortlab.llm.near_dup import near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches one half."""
    return quality.select(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal texts."""
    return without(docs, exact_duplicates(docs).filter("NOT kept"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates."""
    return without(docs, near_duplicates(docs).filter("NOT kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def lexical_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (see ``cohortlab.llm.packing``)."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", lexical_packing),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages
#: against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, sc = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with released():                 # what the stage wrote beside its output
            docs = sc.put(f"stage-{i}", stage(spark, docs, sf_dir))
        if i:
            sc.drop(f"stage-{i - 1}")
    return docs


REGISTRY = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
