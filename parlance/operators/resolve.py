"""Entity resolution by vectors: nearest labels, similar pairs, leader clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import strip_ws
from parlance.functions.vectors import unit_rows
from parlance.operators.identity import merge_and_remap
from parlance.operators.leaders import er_leader_cluster  # noqa: F401
from parlance.operators.metric import BLOCK_ROWS, best_labels, nearest_in_cells, similar_pairs  # noqa: F401
from parlance.runtime import stored
from parlance.schema import EDGE_TYPES

# A vocabulary of at most this many numbers and eighths of characters (64 MB) is sent to every task; a larger one is
# searched in cells.
BROADCAST_VALUES = 8 << 20


def encode_text(df: DataFrame, col: str = "text", out: str = "embedding", n_features: int = 512) -> DataFrame:
    """Hashed character-trigram TF-IDF of unit length; swap in any other encoder's column.

    A trigram's bucket is given by the first seven hexadecimal digits of its md5, so that any engine finds the same.
    """
    padded = F.concat(F.lit("  "), F.lower(F.coalesce(col, F.lit(""))), F.lit("  "))
    # A look-ahead matches at every position, which lists overlapping trigrams in one pass.
    grams = F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1))
    bucket = F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("bigint") % n_features).cast("int"))
    rows = stored(df.withColumn("_buckets", bucket))
    total = rows.count()
    found = dict(rows.select(F.explode(F.array_distinct("_buckets")).alias("b")).groupBy("b").count().collect())
    # At most one figure per bucket.
    idf = np.log((total + 1) / (np.array([found.get(b, 0) for b in range(n_features)]) + 1))

    def weigh(buckets: pd.Series) -> pd.Series:
        units = []
        for b in buckets:
            v = np.bincount(b, minlength=n_features) * idf
            units.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(units)

    weigh.__annotations__ = {"buckets": pd.Series, "return": pd.Series}
    return rows.withColumn(out, F.pandas_udf(weigh, "array<float>")("_buckets")).drop("_buckets")


def nearest_label(nodes: DataFrame, vocab: DataFrame, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Best label of the same type per node, of cosine above 0, the smallest ord on a tie: adds label, cosine (null
    without any), has_labels.

    ``nodes``: id, type, embedding, ...; ``vocab``: label, type, ord, embedding. The size of the vocabulary, vectors and
    labels, is measured first. A small one is sent to every task and nodes are scored in place, without a shuffle; a
    larger one becomes an index of cells that each distinct vector searches, the most promising first.
    """
    size = vocab.agg(F.sum(F.size("embedding") + F.length("label") / 8 + 2)).first()[0] or 0
    if size <= broadcast_values:
        return _nearest_in_place(nodes, vocab)
    return nearest_in_cells(nodes, vocab)


def _nearest_in_place(nodes: DataFrame, vocab: DataFrame) -> DataFrame:
    by_type: dict = {}
    for r in vocab.filter(F.col("type").isNotNull()).select("type", "label", "ord", "embedding").toArrow().to_pylist():
        by_type.setdefault(r["type"], []).append((r["ord"], r["label"], r["embedding"]))
    tables = {}
    for t, rows in by_type.items():
        rows.sort(key=lambda r: r[0])
        tables[t] = [r[1] for r in rows], np.array([r[0] for r in rows]), unit_rows([r[2] for r in rows])
    shared = nodes.sparkSession.sparkContext.broadcast(tables)

    def score(kind: pd.Series, embedding: pd.Series) -> pd.DataFrame:
        label, cosine = np.full(len(kind), None, dtype=object), np.full(len(kind), np.nan)
        some = embedding.notna().to_numpy()
        for t in set(kind[some]) & set(shared.value):
            labels, ords, units = shared.value[t]
            at = np.flatnonzero(some & (kind == t).to_numpy())
            first, best = best_labels(unit_rows(embedding.iloc[at]), ords, units)
            hit = best > 0
            label[at[hit]], cosine[at[hit]] = [labels[i] for i in first[hit]], best[hit]
        return pd.DataFrame({"label": label, "cosine": cosine, "has_labels": kind.isin(list(shared.value)).to_numpy()})

    score.__annotations__ = {"kind": pd.Series, "embedding": pd.Series, "return": pd.DataFrame}
    # Non-deterministic only so that Spark evaluates it once for its three fields.
    udf = F.pandas_udf(score, "label string, cosine double, has_labels boolean").asNondeterministic()
    return nodes.withColumn("_best", udf("type", "embedding")).select(
        *nodes.columns, "_best.label", F.nanvl("_best.cosine", F.lit(None)).alias("cosine"), "_best.has_labels")


def canonicalize_to_vocab(nodes: DataFrame, vocab: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Rewrite a node's text to its nearest label from ``threshold`` on; types of text are met in upper case.

    Adds text_original and canonical_cosine (null where nothing was rewritten) and
    has_labels. Edges refer to ids and need no change.
    """
    if isinstance(nodes.schema["type"].dataType, T.StringType):
        upper = F.upper(strip_ws(F.coalesce("type", F.lit(""))))
        nodes, vocab = nodes.withColumn("type", upper), vocab.withColumn("type", upper)
    scored = nearest_label(nodes, vocab)
    text = strip_ws(F.col("text"))
    rewritten = F.coalesce(
        (text != "") & (F.col("cosine") >= threshold) & (F.lower(strip_ws(F.col("label"))) != F.lower(text)),
        F.lit(False))
    return scored.withColumns({
        "text_original": F.when(rewritten, text),
        "canonical_cosine": F.when(rewritten, F.round("cosine", 4)),
        "text": F.when(rewritten, F.col("label")).otherwise(F.col("text")),
    }).drop("label", "cosine")


def rewrite_report(canon: DataFrame) -> DataFrame:
    return canon.filter(F.col("text_original").isNotNull()).select(
        F.col("id").alias("node_id"), "type", "text_original", F.col("text").alias("text_canonical"),
        F.col("canonical_cosine").alias("cosine"))


def canon_summary(canon: DataFrame) -> DataFrame:
    blank = strip_ws(F.coalesce("text", F.lit(""))) == ""
    return canon.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(~F.col("has_labels") & ~blank).alias("n_no_labels"),
        F.count_if(F.col("text_original").isNotNull()).alias("n_rewritten"))


def er_leader_cluster_dense(texts: DataFrame, threshold: float = 0.85, front_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same clusters straight from ``texts`` (type, ord, embedding), without any pairs.

    For data in which many texts are alike, where the pairs alone would be quadratic. Each
    round settles the first ``front_rows`` undecided texts of every type in one small task,
    then lets their leaders absorb the rest, in bounded blocks. Rounds grow with the number
    of leaders per type.
    """
    kind = texts.schema["type"].dataType.simpleString()

    def settle(front: pd.DataFrame) -> pd.DataFrame:
        front = front.sort_values("ord")
        units, ords = unit_rows(front["embedding"]), front["ord"].to_numpy()
        sims = units @ units.T
        leader, cosine = np.full(len(ords), -1), np.full(len(ords), np.nan)
        for i in range(len(ords)):
            if leader[i] < 0:
                free = (leader < 0) & (sims[i] >= threshold)
                free[i] = False
                leader[free], cosine[free], leader[i] = i, sims[i][free], i
        return pd.DataFrame({"type": front["type"], "ord": ords, "leader": ords[leader], "cosine": cosine,
                             "embedding": front["embedding"]})

    def absorb(rest: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leader, cosine = np.full(len(rest), -1), np.full(len(rest), np.nan)
        if len(rest) and len(leaders):
            leaders = leaders.sort_values("ord")
            sims = unit_rows(rest["embedding"]) @ unit_rows(leaders["embedding"]).T
            first = (sims >= threshold).argmax(axis=1)
            value = sims[np.arange(len(rest)), first]
            hit = value >= threshold
            leader[hit], cosine[hit] = leaders["ord"].to_numpy()[first[hit]], value[hit]
        return pd.DataFrame({"type": rest["type"], "ord": rest["ord"], "leader": leader, "cosine": cosine,
                             "embedding": rest["embedding"]})

    shape = f"type {kind}, ord bigint, leader bigint, cosine double, embedding array<float>"
    undecided = texts.select("type", "ord", "embedding")
    rounds: list[DataFrame] = []
    while not undecided.isEmpty():
        # Whole ranges of ord, counted first: at least one range and at most front_rows texts.
        ranged = undecided.withColumn("_range", F.expr(f"ord div {front_rows}"))
        upto = F.sum("count").over(Window.partitionBy("type").orderBy("_range"))
        near = ranged.groupBy("type", "_range").count().withColumn("_upto", upto).filter(
            (F.col("_upto") <= front_rows) | (F.col("_upto") == F.col("count")))
        front = ranged.join(near.select("type", "_range"), ["type", "_range"], "left_semi").drop("_range")
        settled = stored(front.groupBy("type").applyInPandas(settle, shape))
        rest = undecided.join(settled.select("type", "ord"), ["type", "ord"], "left_anti")
        salts = max(1, -(-rest.count() // front_rows))
        salted = rest.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(salts)))
        leaders = settled.filter(F.col("leader") == F.col("ord")).select("type", "ord", "embedding").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        judged = stored(salted.groupBy("type", "_salt").cogroup(leaders.groupBy("type", "_salt")).applyInPandas(absorb, shape))
        rounds += [settled, judged.filter(F.col("leader") >= 0)]
        undecided = judged.filter(F.col("leader") < 0).select("type", "ord", "embedding")
    done = texts.select("type", "ord").limit(0).select("*", F.lit(0).cast("bigint").alias("leader"), F.lit(0.0).alias("cosine"))
    for part in rounds:
        done = done.unionByName(part.select("type", "ord", "leader", F.nanvl("cosine", F.lit(None)).alias("cosine")))
    return done


def er_canonical_name(clusters: DataFrame) -> DataFrame:
    """Per cluster (type, leader, text, ...): shortest text, then the first alphabetically."""
    return clusters.groupBy("type", "leader").agg(
        F.min(F.struct(F.length("text").alias("n"), "text"))["text"].alias("canonical_name"),
        F.count(F.lit(1)).alias("size"))


def er_apply(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Replace node texts by their cluster's canonical name, within their type."""
    names = clusters.join(er_canonical_name(clusters).select("type", "leader", "canonical_name"), ["type", "leader"])
    return nodes.join(names.select("type", "text", "canonical_name"), ["type", "text"], "left").withColumn(
        "text", F.coalesce("canonical_name", "text")).select(*nodes.columns)


def er_apply_graph(
    nodes: DataFrame, edges: DataFrame, clusters: DataFrame, edge_types: list[str] = EDGE_TYPES,
) -> tuple[DataFrame, DataFrame]:
    """The graph after resolution: nodes that share a name now are one, and edges lead to what is left of theirs."""
    return merge_and_remap(er_apply(nodes, clusters), edges, edge_types)


def er_summary(clusters: DataFrame) -> DataFrame:
    """Per type and in total (type null): texts before and after, and merged clusters."""
    return er_canonical_name(clusters).rollup("type").agg(
        F.sum("size").alias("texts_before"), F.count(F.lit(1)).alias("texts_after"),
        F.count_if(F.col("size") > 1).alias("merged_clusters"))
