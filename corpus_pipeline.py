"""The documents of a training corpus, stage by stage: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import ensemble, packing, pii, simhash, winnow
from parlance.runtime import drop_stored, stored


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from these documents and the labels, rejects go."""
    return ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return simhash.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kinds."""
    return pii.redact(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into training sequences."""
    return packing.pack(docs)


STAGES = [("quality", _quality), ("near_duplicates", _near_duplicates), ("decontamination", _decontamination),
          ("personal_data", _personal_data), ("packing", _packing)]
# Trained models, hashes of another library and a tokenizer's ids cannot be said in SQL; a test holds the result
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents. Every stage is written and read again; what is superseded
    is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
