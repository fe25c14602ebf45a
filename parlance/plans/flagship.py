"""Flagship: conversations to turns to entities to the most widespread ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.catalog.base import conversation_nodes
from parlance.operators.stats import top_entities


def most_widespread_entities(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return top_entities(conversation_nodes(spark, sf_dir), k)
