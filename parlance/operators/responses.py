"""Model answers as a table: parsing, status, and flattening of the three buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.parsing import is_json, json_candidates, largest_json
from parlance.functions.text import entry_text, seq_id, truncate_quote
from parlance.runtime import running_counts
from parlance.schema import BUCKETS


def parse_noisy_json(
    responses: DataFrame, schema: T.DataType | None = None, mode: str = "cascade", col: str = "content",
) -> DataFrame:
    """Add ``strategy`` and ``json`` (null when nothing parses), and ``parsed`` given a schema."""
    content = F.col(col)
    if mode == "largest":
        found = responses.withColumn("json", largest_json(content)).withColumn(
            "strategy", F.when(F.col("json").isNotNull(), "largest"))
    else:
        tried = json_candidates(content)
        pick = None
        for name, candidate in tried:
            hit = F.struct(F.lit(name).alias("strategy"), candidate.alias("json"))
            pick = F.when(is_json(candidate), hit) if pick is None else pick.when(is_json(candidate), hit)
        found = responses.withColumn("_hit", pick).select("*", "_hit.strategy", "_hit.json").drop("_hit")
    return found if schema is None else found.withColumn("parsed", F.from_json("json", schema))


def parse_status(content: Column, json: Column, is_edge: Column | None = None) -> Column:
    """LLM_FAIL without content, PARSE_FAIL without (for edges: bucketed) JSON, else OK."""
    broken = json.isNull()
    if is_edge is not None:
        has_bucket = F.lit(False)
        for bucket in BUCKETS:
            has_bucket = has_bucket | F.array_contains(F.coalesce(F.json_object_keys(json), F.array()), bucket)
        broken = broken | (is_edge & ~has_bucket)
    return F.when(F.coalesce(content, F.lit("")) == "", "LLM_FAIL").when(broken, "PARSE_FAIL").otherwise("OK")


def bucket_items(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bucket entry: (keys, bucket, bucket_rank, item_pos, entry fields)."""
    def tagged(rank: int, bucket: str) -> Column:
        return F.transform(F.coalesce(F.col(bucket), F.array()), lambda x, i: F.struct(
            F.lit(bucket).alias("bucket"), F.lit(rank).alias("bucket_rank"), i.alias("item_pos"), x.alias("item")))

    entries = F.flatten(F.array(*[tagged(r, b) for r, b in enumerate(BUCKETS)]))
    return results.select(*keys, F.inline(entries)).select(*keys, "bucket", "bucket_rank", "item_pos", "item.*")


def flatten_buckets(results: DataFrame, categories: list[str]) -> DataFrame:
    """Entries of OK answers as nodes, numbered per transcript.

    Order: category (as listed), answer (``ord``), bucket, position in the bucket.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    ok = results.filter((F.col("status") == "OK") & F.col("category").isin(categories))
    items = bucket_items(ok, ["res_id", "category", "ord"]).withColumn("cat_rank", rank)
    numbered = running_counts(
        items, ["res_id"], ["cat_rank", "ord", "bucket_rank", "item_pos"], ["cat_rank", "ord"], {"rank": None})
    return numbered.select(
        "res_id", seq_id(F.col("rank")).alias("id"), entry_text(F.col("label"), F.col("text")).alias("text"),
        F.col("category").alias("type"), F.coalesce("quote", F.lit("")).alias("evidence"), "turn_id", "bucket",
        F.col("rank").alias("ord"))


def edge_passthrough(items: DataFrame) -> DataFrame:
    """Edge entries with both endpoints, no literal self-loop, typed by their category."""
    src, dst = F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit(""))
    kept = items.filter((src != "") & (dst != "") & (src != dst))
    return kept.withColumn("type", F.col("category")).withColumn("quote", truncate_quote(F.col("quote")))


def bucket_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").pivot("bucket", BUCKETS).count().na.fill(0)


def review_listing(items: DataFrame, is_edge: bool = False, width: int = 80) -> DataFrame:
    """What a reviewer reads: bucket, label (edges as ``src → dst``), turn, shortened quote."""
    unknown = F.lit("?")
    if is_edge:
        label = F.concat(F.coalesce("src", unknown), F.lit(" → "), F.coalesce("dst", unknown))
    else:
        label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.nullif(F.col("text"), F.lit("")), unknown)
    return items.withColumns({
        "label": label,
        "turn_id": F.coalesce(F.nullif(F.col("turn_id"), F.lit("")), unknown),
        "quote": truncate_quote(F.col("quote"), width),
    })
