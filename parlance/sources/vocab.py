"""Controlled vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip_ws
from parlance.runtime import first_wins


def load_vocab_by_type(vocab: DataFrame, order: str = "file", known_types: list[str] | None = None) -> DataFrame:
    """Distinct (entity_type, label, ord) with types upper-cased and blanks dropped.

    ``order='file'`` keeps every type and the first position; ``'sorted'`` keeps known types
    only and orders labels alphabetically, so ``ord`` is not needed and is left out.
    """
    clean = vocab.select(
        F.upper(F.coalesce("entity_type", F.lit(""))).alias("entity_type"),
        strip_ws(F.coalesce("label", F.lit(""))).alias("label"), "ord",
    ).filter((F.col("entity_type") != "") & (F.col("label") != ""))
    if order == "sorted":
        if known_types is not None:
            clean = clean.filter(F.col("entity_type").isin(known_types))
        return clean.select("entity_type", "label").distinct()
    return clean.groupBy("entity_type", "label").agg(F.min("ord").alias("ord"))


def merge_vocab(*vocabs: DataFrame) -> DataFrame:
    """Union of vocabularies; an earlier one wins on (lower label, type)."""
    ranked = [v.withColumn("_rank", F.lit(i)) for i, v in enumerate(vocabs)]
    whole = reduce(lambda a, b: a.unionByName(b), ranked).withColumn("_key", F.lower("label"))
    return first_wins(whole, ["_key", "entity_type"], ["_rank", "ord"]).drop("_key", "_rank")
