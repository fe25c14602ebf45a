"""The deterministic extraction layer as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.extract import pattern_extract
from parlance.operators.filters import low_value_filter
from parlance.operators.identity import renumber_graph
from parlance.operators.linking import add_inferred_edges, infer_edges
from parlance.rules import clinical
from parlance.runtime import stored
from parlance.schema import EDGE_TYPES, NODE_TYPES


def enrich_graph(
    nodes: DataFrame, edges: DataFrame, transcripts: DataFrame,
    patterns: list[tuple] | DataFrame = clinical.PATTERNS, rules: list[tuple] | None = None,
    aliases: dict[str, str] | None = clinical.ALIASES, low_value: str = clinical.LOW_VALUE_REGEX,
    node_types: list[str] = NODE_TYPES, edge_types: list[str] = EDGE_TYPES, compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Drop low-value denials, add what patterns prove, then what the relation rules imply.

    ``transcripts``: whole texts, or turns as rows, which have a column ``seq``.

    The nodes are used by several branches, so they are stored after each of the two steps
    that cost most: extraction and renumbering.
    """
    kept = stored(low_value_filter(nodes, low_value, aliases))
    found = pattern_extract(transcripts, patterns, kept, aliases, compat).select(*nodes.columns)
    # What patterns find comes after the given nodes.
    placed = [df.withColumn("ord", F.struct(F.lit(i).alias("source"), F.col("ord").cast("bigint").alias("at")))
              for i, df in enumerate((kept, found))]
    grown = stored(placed[0].unionByName(placed[1]))
    new_nodes, new_edges = renumber_graph(grown, edges, aliases, node_types, edge_types)
    new_nodes = stored(new_nodes)
    inferred = infer_edges(new_nodes, clinical.relation_rules() if rules is None else rules, aliases=aliases)
    return new_nodes, add_inferred_edges(new_edges, inferred)
