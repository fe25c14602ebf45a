"""Edges from text and from rules, as equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import canonicalize_text, norm_key
from parlance.operators.identity import dedup_edges
from parlance.runtime import rule_table


def alias_join(df: DataFrame, aliases: DataFrame, col: str = "text") -> DataFrame:
    """Replace ``col`` by its canonical form where ``aliases`` (text, canonical) has one."""
    table = aliases.select(F.col("text").alias(col), "canonical").dropDuplicates([col])
    return df.join(table, col, "left").withColumn(col, F.coalesce("canonical", col)).select(*df.columns)


def _endpoint_index(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Per transcript and text, the first node of all and the first of each of ``types``, in one aggregation."""
    first = F.struct("ord", "id")
    return nodes.withColumn("_key", norm_key(F.col("text"))).groupBy("res_id", "_key").agg(
        F.min(first).alias("_any"), *[F.min(F.when(F.col("type") == t, first)).alias(f"_of_{i}") for i, t in enumerate(types)])


def _pick(types: list[str], category: Column, priority: dict, side: int) -> Column:
    """The node of the best allowed type, else the one created first."""
    def first(wanted: list[str]) -> Column:
        # Where a text has a node there is a first one. The types behind it decide nothing: with them both sides of an
        # edge ask for the same columns, and share one index.
        rest = [t for t in types if t not in wanted]
        return F.coalesce(*[F.col(f"_of_{types.index(t)}") for t in wanted], F.col("_any"),
                          *[F.col(f"_of_{types.index(t)}") for t in rest])["id"]

    best = first([])
    for cat, sides in priority.items():
        best = F.when(category == cat, first(sides[side])).otherwise(best)
    return best


def resolve_endpoints(edge_texts: DataFrame, nodes: DataFrame, priority: dict) -> DataFrame:
    """Add source_id and target_id (null when unresolved) to edges given by text.

    ``edge_texts`` has res_id, category, src, dst, ord. Every text finds at most one index
    row, so edges are never multiplied and no window is needed to choose.
    """
    types = sorted({t for sides in priority.values() for side in sides for t in side})
    index = _endpoint_index(nodes, types)
    keyed = edge_texts.withColumns({"_src": norm_key(F.col("src")), "_dst": norm_key(F.col("dst"))}).filter(
        (F.col("_src") != "") & (F.col("_dst") != ""))
    for side, (key, out) in enumerate((("_src", "source_id"), ("_dst", "target_id"))):
        found = index.withColumnRenamed("_key", key)
        keyed = keyed.join(found, ["res_id", key], "left").withColumn(
            out, _pick(types, F.col("category"), priority, side)).drop("_any", *[f"_of_{i}" for i in range(len(types))])
    return keyed.drop("_src", "_dst")


def unresolved_edges(resolved: DataFrame) -> DataFrame:
    """Missing endpoints per category, and in total (category null)."""
    no_src, no_dst = F.col("source_id").isNull(), F.col("target_id").isNull()
    return resolved.filter(no_src | no_dst).rollup("category").agg(
        F.count_if(no_src & ~no_dst).alias("src"), F.count_if(no_dst & ~no_src).alias("dst"),
        F.count_if(no_src & no_dst).alias("both"), F.count(F.lit(1)).alias("total"))


def infer_edges(
    nodes: DataFrame, rules: list[tuple] | DataFrame, rule_sets: list[str] | None = None,
    aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Edges that rules (rule_set, ord, src, src_types, tgt, tgt_types, type) derive, a list or a table of any size.

    Rule endpoints meet the nodes in one equality join, and nodes are grouped by (transcript, rule): one shuffle of the
    few matching nodes instead of a self-join. A side with several types takes the first
    type present. Evidence falls back from source to target.
    """
    names = ["rule", "edge_type", "side", "text", "type", "prio"]
    if isinstance(rules, DataFrame):
        given = rules.toDF("rule_set", "rule", "src", "src_types", "tgt", "tgt_types", "edge_type")
        given = given if rule_sets is None else given.filter(F.col("rule_set").isin(rule_sets))
        src, tgt = (given.select("rule", "edge_type", F.lit(side).alias("side"), F.col(side).alias("text"),
                                 F.posexplode(f"{side}_types").alias("prio", "type")).select(*names) for side in ("src", "tgt"))
        table = src.unionByName(tgt)
    else:
        ends = []
        for rule_set, rule, src, src_types, tgt, tgt_types, edge_type in rules:
            if rule_sets is None or rule_set in rule_sets:
                ends += [(rule, edge_type, "src", src, t, i) for i, t in enumerate(src_types)]
                ends += [(rule, edge_type, "tgt", tgt, t, i) for i, t in enumerate(tgt_types)]
        table = rule_table(nodes.sparkSession, ends, names)
    table = table.withColumn("text", canonicalize_text(F.col("text"), aliases))
    hits = nodes.withColumn("text", F.lower("text")).join(table, ["text", "type"])
    best = F.struct("prio", "ord", "id", "evidence", "turn_id")
    paired = hits.groupBy("res_id", "rule", "edge_type").agg(
        F.min(F.when(F.col("side") == "src", best)).alias("s"),
        F.min(F.when(F.col("side") == "tgt", best)).alias("t"),
    ).filter(F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("s.id") != F.col("t.id")))

    def fallback(field: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"s.{field}"), F.lit("")), F.col(f"t.{field}"), F.lit(""))

    return paired.select(
        "res_id", F.col("s.id").alias("source_id"), F.col("t.id").alias("target_id"),
        F.col("edge_type").alias("type"), fallback("evidence").alias("evidence"),
        fallback("turn_id").alias("turn_id"), F.col("rule").cast("bigint").alias("ord"))


def add_inferred_edges(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Existing edges plus the inferred ones they do not already contain; ``ord`` becomes (source, at), as inferred edges
    follow the given ones."""
    key = ["res_id", "source_id", "target_id", "type"]
    fresh = dedup_edges(inferred.filter(F.col("source_id") != F.col("target_id"))).join(
        edges.select(*key).distinct(), key, "left_anti")
    given, new = (df.select(*edges.columns).withColumn("ord", F.struct(F.lit(i).alias("source"), F.col("ord").cast("bigint").alias("at")))
                  for i, df in enumerate((edges, fresh)))
    return given.unionByName(new)


def run_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every id of two runs with the side it occurs on: both, only_a or only_b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return left.join(right, key, "full").select(key, side.alias("side"))


def candidate_edges(
    mentions: DataFrame, allowed: list[tuple[str, str, str]] | DataFrame, window: int = 2, k: int | None = None,
) -> DataFrame:
    """Type-compatible entity pairs that occur at most ``window`` turns apart; of each source all, or the ``k`` best.

    The nearest are best, then those that occur together most often, then the first by relation, text and type.

    ``mentions`` has res_id, seq, text, type. Mentions are counted per turn first; turns are
    cut into bands as wide as the window, and a source meets only its own and the two
    neighbouring bands, so distant turns of a long transcript are never paired.
    """
    per_turn = mentions.groupBy("res_id", "seq", "text", "type").agg(F.count(F.lit(1)).alias("n"))
    band = F.floor(F.col("seq") / F.lit(window + 1))
    table = rule_table(mentions.sparkSession, allowed, ["edge_type", "src_type", "tgt_type"])
    src = per_turn.select(
        "res_id", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("seq").alias("src_seq"),
        F.col("text").alias("src_text"), F.col("type").alias("src_type"), F.col("n").alias("src_n"),
    ).join(table, "src_type")
    tgt = per_turn.select(
        "res_id", band.alias("band"), F.col("seq").alias("tgt_seq"),
        F.col("text").alias("tgt_text"), F.col("type").alias("tgt_type"), F.col("n").alias("tgt_n"))
    gap = F.abs(F.col("src_seq") - F.col("tgt_seq"))
    different = (F.col("src_text") != F.col("tgt_text")) | (F.col("src_type") != F.col("tgt_type"))
    near = src.join(tgt, ["res_id", "band", "tgt_type"]).filter((gap <= window) & different)
    scored = near.groupBy("res_id", "edge_type", "src_text", "src_type", "tgt_text", "tgt_type").agg(
        F.min(gap).alias("min_gap"), F.sum(F.col("src_n") * F.col("tgt_n")).alias("cooccurrences"))
    if k is None:
        return scored
    # Spark keeps the k best of every source in each task before it shuffles them, and again behind.
    best = Window.partitionBy("res_id", "src_text", "src_type").orderBy(
        "min_gap", F.desc("cooccurrences"), "edge_type", "tgt_text", "tgt_type")
    return scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")
