"""Which rows are the same thing: deduplication, renumbering, endpoint remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import canonicalize_text, norm_key, seq_id, strip_ws
from parlance.operators.filters import keep_supported, supported_quotes, valid_type_filter
from parlance.runtime import first_wins, running_counts, stored
from parlance.schema import EDGE_TYPES, NODE_TYPES


def numbered_survivors(keyed: DataFrame, keys: tuple[str, ...] = ("res_id", "text", "type")) -> DataFrame:
    """First row per key with a gapless ``rank`` and ``id`` per transcript.

    ``ord`` is a number or a struct of numbers; a struct that begins with ``source`` puts one source
    behind another.
    """
    survivors = first_wins(keyed, list(keys), ["ord"])
    kind = keyed.schema["ord"].dataType
    place = [f"ord.{f}" for f in kind.fieldNames()] if hasattr(kind, "fieldNames") else ["ord"]
    # The first number of the order that leads on from constants cuts a hot transcript into slots.
    lead = place[:2] if len(place) > 1 and kind.fieldNames()[0] == "source" else place[:1]
    ranked = running_counts(survivors, ["res_id"], [*place, "text", "type"], lead, {"rank": None})
    return ranked.withColumn("id", seq_id(F.col("rank"))).withColumn("ord", F.col("rank")).drop("rank")


def merge_nodes(raw: DataFrame, aliases: dict[str, str] | None = None, types: list[str] = NODE_TYPES) -> DataFrame:
    """Valid, canonical, non-blank mentions; the first per (text, type) of a transcript stays."""
    clean = valid_type_filter(raw, types).select(
        "res_id", F.lit("").alias("id"), canonicalize_text(F.col("text"), aliases).alias("text"), "type",
        strip_ws(F.coalesce("evidence", F.lit(""))).alias("evidence"),
        strip_ws(F.coalesce("turn_id", F.lit(""))).alias("turn_id"), "ord",
    ).filter(F.col("text") != "")
    return numbered_survivors(clean)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge per (source, target, type) keeps its evidence."""
    return first_wins(edges, ["res_id", "source_id", "target_id", "type"], ["ord"])


def dedup_mentions(items: DataFrame, buckets: list[str]) -> DataFrame:
    """One mention per (normalised text, category); matched before other before fine-grained."""
    rank = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket"))
    keyed = items.withColumns({"_key": norm_key(F.col("text")), "_rank": rank}).filter(F.col("_key") != "")
    return first_wins(keyed, ["res_id", "category", "_key"], ["_rank", "ord"]).drop("_key", "_rank")


def merge_and_remap(keyed: DataFrame, edges: DataFrame, edge_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Merge ``keyed`` nodes and carry edges over; a merged node's edges go to its survivor."""
    # Texts are made once; nodes and their new ids are read by the numbering and by both ends of the edges.
    keyed = stored(keyed)
    survivors = stored(numbered_survivors(keyed))
    moved = keyed.select("res_id", F.col("id").alias("_old"), "text", "type").join(
        survivors.select("res_id", "text", "type", F.col("id").alias("_new")), ["res_id", "text", "type"])
    id_map = moved.groupBy("res_id", "_old").agg(F.min("_new").alias("_new"))

    def endpoint(side: str) -> DataFrame:
        return id_map.select("res_id", F.col("_old").alias(side), F.col("_new").alias(f"_{side}"))

    typed = edges.withColumn("type", F.upper(F.coalesce("type", F.lit("")))).filter(F.col("type").isin(edge_types))
    mapped = typed.join(endpoint("source_id"), ["res_id", "source_id"]).join(
        endpoint("target_id"), ["res_id", "target_id"]).filter(F.col("_source_id") != F.col("_target_id"))
    renamed = mapped.withColumns({"source_id": F.col("_source_id"), "target_id": F.col("_target_id")})
    return survivors, dedup_edges(renamed.select(*edges.columns))


def renumber_graph(
    nodes: DataFrame, edges: DataFrame, aliases: dict[str, str] | None = None,
    node_types: list[str] = NODE_TYPES, edge_types: list[str] = EDGE_TYPES,
) -> tuple[DataFrame, DataFrame]:
    """Canonicalise and merge nodes, then remap, clean and deduplicate edges.

    An edge to a node that was dropped is dropped too: ids are mapped by an inner join and
    can never fall through to another node's new id.
    """
    keyed = valid_type_filter(nodes, node_types).withColumn(
        "text", canonicalize_text(F.col("text"), aliases)).filter(F.col("text") != "")
    return merge_and_remap(keyed, edges, edge_types)


def rewrite_and_remap(
    nodes: DataFrame, edges: DataFrame, rewrites: DataFrame, aliases: dict[str, str] | None = None,
    edge_types: list[str] = EDGE_TYPES,
) -> tuple[DataFrame, DataFrame]:
    """Give nodes the text ``rewrites`` (res_id, id, text) proposes, then merge and remap."""
    proposed = rewrites.select("res_id", "id", F.col("text").alias("_text"))
    new = F.nullif(canonicalize_text(F.col("_text"), aliases), F.lit(""))
    keyed = nodes.join(proposed, ["res_id", "id"], "left").withColumn(
        "text", F.coalesce(new, canonicalize_text(F.col("text"), aliases))
    ).filter(F.col("text") != "").select(*nodes.columns)
    return merge_and_remap(keyed, edges, edge_types)


def validate_graph(
    nodes: DataFrame, edges: DataFrame, transcripts: DataFrame, aliases: dict[str, str] | None = None,
    node_types: list[str] = NODE_TYPES, edge_types: list[str] = EDGE_TYPES,
) -> tuple[DataFrame, DataFrame]:
    """Known types, canonical text, grounded evidence, unique nodes and edges.

    The quotes of nodes and edges are judged in one pass over the transcripts.
    """
    quotes = nodes.select("res_id", "evidence").unionByName(edges.select("res_id", "evidence"))
    supported = stored(supported_quotes(quotes, transcripts))
    return renumber_graph(
        stored(keep_supported(nodes, supported)), stored(keep_supported(edges, supported)), aliases, node_types, edge_types)
