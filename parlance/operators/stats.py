"""Graph statistics and run telemetry. Every report is a partial aggregation first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import error_class
from parlance.operators.filters import with_endpoints


def _per_transcript(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(res_id, nodes, entities, edges); both tables fold to one row per transcript first."""
    n = nodes.groupBy("res_id", "text", "type").agg(F.count(F.lit(1)).alias("_c")).groupBy("res_id").agg(
        F.sum("_c").alias("nodes"), F.count(F.lit(1)).alias("entities"))
    e = edges.groupBy("res_id").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "res_id", "full").na.fill(0, ["nodes", "entities", "edges"])


def kg_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, distinct entities and edges per transcript, and their total (res_id null)."""
    return _per_transcript(nodes, edges).rollup("res_id").agg(
        F.sum("nodes").alias("nodes"), F.sum("entities").alias("entities"), F.sum("edges").alias("edges"))


def kg_density_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum, mean, least and most nodes and edges per transcript."""
    return _per_transcript(nodes, edges).agg(
        F.count(F.lit(1)).alias("transcripts"),
        *[f(c).alias(f"{name}_{c}") for c in ("nodes", "edges")
          for name, f in (("sum", F.sum), ("min", F.min), ("max", F.max))],
        F.round(F.avg("nodes"), 4).alias("avg_nodes"), F.round(F.avg("edges"), 4).alias("avg_edges"))


def type_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node type and per edge type, most frequent first."""
    n = nodes.groupBy("type").count().withColumn("kind", F.lit("node"))
    e = edges.groupBy("type").count().withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "type", F.col("count").alias("n")).orderBy(
        F.desc("kind"), F.desc("n"), "type")


def relation_type_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by (relation, source type, target type), with a subtotal per relation."""
    return with_endpoints(edges, nodes).groupingSets(
        [["type", "src_type", "tgt_type"], ["type"]], "type", "src_type", "tgt_type"
    ).agg(F.count(F.lit(1)).alias("n"))


def top_entities(nodes: DataFrame, k: int) -> DataFrame:
    """The k entities that occur in most transcripts."""
    seen = nodes.select("type", "text", "res_id").distinct()
    return seen.groupBy("type", "text").agg(F.count(F.lit(1)).alias("n_transcripts")).orderBy(
        F.desc("n_transcripts"), "type", "text").limit(k)


def top_triples(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k most repeated (source text, relation, target text)."""
    return with_endpoints(edges, nodes).groupBy("src_text", "type", "tgt_text").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src_text", "type", "tgt_text").limit(k)


def unify_exact(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge nodes across transcripts by (lower text, type).

    Returns (unified nodes with n_occurrences and n_transcripts, occurrences, unified edges).
    Occurrences stay rows keyed by node: a frequent entity would not fit in one array.
    Edge multiplicity is kept.
    """
    keyed = nodes.withColumn("text", F.lower("text"))
    node_key = F.sha2(F.concat_ws("\x1f", "type", "text"), 256)
    per_transcript = keyed.groupBy("text", "type", "res_id").agg(F.count(F.lit(1)).alias("_n"))
    unified = per_transcript.groupBy("text", "type").agg(
        F.sum("_n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_transcripts")
    ).withColumn("node_key", node_key)
    occurrences = keyed.select(node_key.alias("node_key"), "res_id", "id")
    ends = with_endpoints(edges, keyed)
    unified_edges = ends.select(
        "res_id", "src_text", "src_type", "type", "tgt_text", "tgt_type",
        F.sha2(F.concat_ws("\x1f", "src_type", "src_text"), 256).alias("source_key"),
        F.sha2(F.concat_ws("\x1f", "tgt_type", "tgt_text"), 256).alias("target_key"))
    return unified, occurrences, unified_edges


def graph_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, average degree 2E/N and density E/N."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    both = n.select("node_count", F.lit(0).alias("edge_count")).unionByName(
        e.select(F.lit(0).alias("node_count"), "edge_count"))
    return both.agg(F.sum("node_count").alias("node_count"), F.sum("edge_count").alias("edge_count")).withColumns({
        "avg_degree": F.round(F.try_divide(2 * F.col("edge_count"), F.col("node_count")), 4),
        "edge_density": F.round(F.try_divide(F.col("edge_count"), F.col("node_count")), 4),
    })


def token_usage(calls: DataFrame) -> DataFrame:
    """Prompt and completion tokens per transcript, and in total (res_id null)."""
    return calls.rollup("res_id").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))


def run_summary(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per run: transcripts ok and failed, time, tokens, nodes, edges, categories.

    ``calls`` has run_id, res_id, category, ok, ms, prompt_tokens, completion_tokens; nodes
    and edges have run_id. A transcript failed when none of its calls is ok.
    """
    per_transcript = calls.groupBy("run_id", "res_id").agg(
        F.bool_or("ok").alias("ok"), F.sum("ms").alias("ms"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("p"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("c"))
    runs = per_transcript.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_transcripts"), F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_failed"), F.sum("ms").alias("total_ms"),
        F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"))
    active = calls.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    n = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    e = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_edges"))
    return runs.join(active, "run_id").join(n, "run_id", "left").join(e, "run_id", "left").na.fill(
        0, ["total_nodes", "total_edges"])


def retry_stats(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Success per attempt number, terminal failures, errors and recovered errors by class.

    ``attempts`` has call_id, attempt (from 1), ok, status, network, empty. A call recovered
    from a class when it met it and still succeeded on a later attempt.
    """
    kind = F.when(F.col("empty"), "empty_content").otherwise(error_class(F.col("status"), F.col("network")))
    kinds = ["429", "5xx", "network", "retriable_other", "nonretriable", "empty_content"]
    tagged = attempts.withColumn("kind", F.when(~F.col("ok"), kind))
    calls = tagged.groupBy("call_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    won = F.when(F.col("won") < max_attempts, F.col("won")).when(F.col("won").isNotNull(), max_attempts)
    recovered = F.coalesce(F.col("won") > 1, F.lit(False))
    return calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        *[F.count_if(won == i).alias(f"attempt_{i}") for i in range(1, max_attempts + 1)],
        F.count_if(F.col("won").isNull()).alias("failed_after_all"),
        *[F.sum(k).alias(f"err_{k}") for k in kinds],
        *[F.count_if(recovered & (F.col(k) > 0)).alias(f"recovered_{k}") for k in kinds[:3]])


def convert_summary(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes, resolved and unresolved edges per transcript, and their total (res_id null)."""
    missing = F.col("source_id").isNull() | F.col("target_id").isNull()
    n = nodes.groupBy("res_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = resolved.groupBy("res_id").agg(
        F.count_if(~missing).alias("n_edges"), F.count_if(missing).alias("n_unresolved"))
    joined = n.join(e, "res_id", "full").na.fill(0, ["n_nodes", "n_edges", "n_unresolved"])
    return joined.rollup("res_id").agg(*[F.sum(c).alias(c) for c in ("n_nodes", "n_edges", "n_unresolved")])


def convert_unresolved(resolved: DataFrame) -> DataFrame:
    """Edges without a source, a target or both, by category and transcript, by category, and in all (nulls)."""
    no_src, no_dst = F.col("source_id").isNull(), F.col("target_id").isNull()
    return resolved.filter(no_src | no_dst).rollup("category", "res_id").agg(
        F.count_if(no_src & ~no_dst).alias("src"), F.count_if(no_dst & ~no_src).alias("dst"),
        F.count_if(no_src & no_dst).alias("both"), F.count(F.lit(1)).alias("total"))


def run_compare(runs: DataFrame, run_col: str, metrics: list[str], base=None) -> DataFrame:
    """Metrics of each run beside their change against run ``base`` (default: the previous run)."""
    if base is None:
        order = Window.orderBy(run_col)  # one row per run
        return runs.select(run_col, *metrics, *[
            (F.col(m) - F.lag(m).over(order)).alias(f"d_{m}") for m in metrics])
    whole = Window.partitionBy()  # one row per run
    return runs.select(run_col, *metrics, *[
        (F.col(m) - F.max(F.when(F.col(run_col) == base, F.col(m))).over(whole)).alias(f"d_{m}") for m in metrics])
