"""Queries over vectors and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog.base import query, table
from parlance.operators import resolve as er

# The shared vectors are nearly orthogonal, so thresholds are lower than for real text.
PAIR_T, CANON_T = 0.30, 0.35


def vec_nodes(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"),
        F.col("label").alias("type"), "embedding")


def vec_vocab(spark, sf):
    """Every vector is also a label, of the type after its own, so that no node meets itself.

    Type 0 has no labels.
    """
    return table(spark, sf, "embeddings").filter(F.col("label") < 9).select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("label"),
        (F.col("label") + 1).alias("type"), F.col("vec_id").alias("ord"), "embedding")


NEAREST_SQL = """
n AS (SELECT vec_id AS id, label AS type, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT 'w' || vec_id AS label, label + 1 AS type, vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings WHERE label < 9),
sims AS (SELECT n.id, n.type, v.label, v.ord, list_cosine_similarity(n.e, v.e) AS cosine FROM n JOIN v USING (type)),
best AS (SELECT * FROM sims WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, ord) = 1),
canon AS (SELECT n.id, n.type, b.label, b.cosine, n.type <> 0 AS has_labels, coalesce(b.cosine >= 0.35, false) AS hit
          FROM n LEFT JOIN best b USING (id))"""


@query("nearest_label", f"WITH {NEAREST_SQL} SELECT id, type, label, round(cosine, 6) AS cosine, has_labels FROM canon")
def nearest_label(spark, sf):
    return er.nearest_label(vec_nodes(spark, sf), vec_vocab(spark, sf)).select(
        "id", "type", "label", F.round("cosine", 6).alias("cosine"), "has_labels")


@query("nearest_label_blocked", f"WITH {NEAREST_SQL} SELECT id, type, label, round(cosine, 6) AS cosine, has_labels FROM canon")
def nearest_label_blocked(spark, sf):
    """The plan for vocabularies too large to broadcast."""
    return er.nearest_label(vec_nodes(spark, sf), vec_vocab(spark, sf), broadcast_values=0).select(
        "id", "type", "label", F.round("cosine", 6).alias("cosine"), "has_labels")


@query("canonicalize_to_vocab", f"""
WITH {NEAREST_SQL}
SELECT id, type, CASE WHEN hit THEN label ELSE 'v' || id END AS text, CASE WHEN hit THEN 'v' || id END AS text_original,
       CASE WHEN hit THEN round(cosine, 4) END AS canonical_cosine FROM canon""")
def canonicalize_to_vocab(spark, sf):
    return er.canonicalize_to_vocab(vec_nodes(spark, sf), vec_vocab(spark, sf), CANON_T).select(
        "id", "type", "text", "text_original", "canonical_cosine")


@query("rewrite_report", f"""
WITH {NEAREST_SQL}
SELECT id AS node_id, type, 'v' || id AS text_original, label AS text_canonical, round(cosine, 4) AS cosine
FROM canon WHERE hit""")
def rewrite_report(spark, sf):
    return er.rewrite_report(er.canonicalize_to_vocab(vec_nodes(spark, sf), vec_vocab(spark, sf), CANON_T))


@query("canon_summary", f"""
WITH {NEAREST_SQL}
SELECT count(*) AS n_nodes, count(*) FILTER (NOT has_labels) AS n_no_labels, count(*) FILTER (hit) AS n_rewritten FROM canon""")
def canon_summary(spark, sf):
    return er.canon_summary(er.canonicalize_to_vocab(vec_nodes(spark, sf), vec_vocab(spark, sf), CANON_T))


PAIRS_SQL = """
x AS (SELECT vec_id AS ord, label AS type, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.type, a.ord AS lo, b.ord AS hi, list_cosine_similarity(a.e, b.e) AS cosine
          FROM x a JOIN x b ON a.type = b.type AND a.ord < b.ord WHERE list_cosine_similarity(a.e, b.e) >= 0.30)"""
# Greedy in order of ord: a text leads unless an earlier leader is its neighbour.
CLUSTER_SQL = f"""{PAIRS_SQL},
ordered AS (SELECT ord, type, row_number() OVER (ORDER BY ord) AS i FROM x),
lower_n AS (SELECT o.i, o.ord, o.type, coalesce(list(p.lo ORDER BY p.lo) FILTER (p.lo IS NOT NULL), []) AS lows
            FROM ordered o LEFT JOIN pairs p ON p.hi = o.ord GROUP BY ALL),
steps AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS leaders
          UNION ALL
          SELECT n.i, CASE WHEN list_has_any(s.leaders, n.lows) THEN s.leaders ELSE list_append(s.leaders, n.ord) END
          FROM steps s JOIN lower_n n ON n.i = s.i + 1),
final AS (SELECT leaders FROM steps ORDER BY i DESC LIMIT 1),
clusters AS (SELECT n.ord, n.type, coalesce(list_min(list_intersect(n.lows, f.leaders)), n.ord) AS leader,
                    'v' || n.ord AS text FROM lower_n n, final f),
names AS (SELECT type, leader, first(text ORDER BY length(text), text) AS canonical_name, count(*) AS size
          FROM clusters GROUP BY 1, 2)"""


def vec_texts(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("label").alias("type"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "embedding")


def vec_clusters(spark, sf):
    texts = vec_texts(spark, sf)
    clusters = er.er_leader_cluster(er.similar_pairs(texts, PAIR_T), texts)
    return clusters.join(texts.select("ord", "text"), "ord")


@query("similar_pairs", f"WITH {PAIRS_SQL} SELECT type, lo, hi, round(cosine, 6) AS cosine FROM pairs")
def similar_pairs(spark, sf):
    return er.similar_pairs(vec_texts(spark, sf), PAIR_T).withColumn("cosine", F.round("cosine", 6))


@query("similar_pairs_blocked", f"WITH {PAIRS_SQL} SELECT type, lo, hi, round(cosine, 6) AS cosine FROM pairs")
def similar_pairs_blocked(spark, sf):
    """Small blocks, as if each type were far larger than one task."""
    return er.similar_pairs(vec_texts(spark, sf), PAIR_T, block_rows=16).withColumn("cosine", F.round("cosine", 6))


@query("er_leader_cluster", f"WITH RECURSIVE {CLUSTER_SQL} SELECT type, ord, leader, text FROM clusters")
def er_leader_cluster(spark, sf):
    return vec_clusters(spark, sf).select("type", "ord", "leader", "text")


@query("er_leader_cluster_dense", f"WITH RECURSIVE {CLUSTER_SQL} SELECT type, ord, leader FROM clusters")
def er_leader_cluster_dense(spark, sf):
    return er.er_leader_cluster_dense(vec_texts(spark, sf), PAIR_T).select("type", "ord", "leader")


@query("er_canonical_name", f"WITH RECURSIVE {CLUSTER_SQL} SELECT type, leader, canonical_name, size FROM names")
def er_canonical_name(spark, sf):
    return er.er_canonical_name(vec_clusters(spark, sf))


@query("er_apply", f"""
WITH RECURSIVE {CLUSTER_SQL}
SELECT e.vec_id AS id, e.label AS type, n.canonical_name AS text
FROM embeddings e JOIN clusters c ON c.ord = e.vec_id JOIN names n ON n.type = c.type AND n.leader = c.leader""")
def er_apply(spark, sf):
    return er.er_apply(vec_nodes(spark, sf).drop("embedding"), vec_clusters(spark, sf))


@query("er_summary", f"""
WITH RECURSIVE {CLUSTER_SQL}
SELECT type, CAST(sum(size) AS BIGINT) AS texts_before, count(*) AS texts_after,
       count(*) FILTER (size > 1) AS merged_clusters FROM names GROUP BY ROLLUP (type)""")
def er_summary(spark, sf):
    return er.er_summary(vec_clusters(spark, sf))


@query("er_apply_graph", f"""
WITH RECURSIVE {CLUSTER_SQL},
named AS (SELECT c.ord % 20 AS res_id, c.ord AS id, n.canonical_name AS text, c.type
          FROM clusters c JOIN names n ON n.type = c.type AND n.leader = c.leader),
firsts AS (SELECT res_id, text, type, min(id) AS ord FROM named GROUP BY 1, 2, 3),
ranked AS (SELECT *, printf('N_%03d', row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type)) AS new_id FROM firsts),
m AS (SELECT res_id, id, new_id FROM named JOIN ranked USING (res_id, text, type)),
e AS (SELECT DISTINCT a.res_id, a.new_id AS source_id, b.new_id AS target_id
      FROM m a JOIN m b ON b.id = a.id + 20 WHERE a.new_id <> b.new_id)
SELECT res_id, 'node' AS kind, new_id AS a, text AS b FROM ranked
UNION ALL SELECT res_id, 'edge', source_id, target_id FROM e""")
def er_apply_graph(spark, sf):
    """Twenty graphs of the vectors, each with a chain of edges."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "label")
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    nodes = v.select((F.col("n") % 20).alias("res_id"), name(F.col("n")).alias("id"), name(F.col("n")).alias("text"),
                     F.col("label").alias("type"), F.lit("").alias("evidence"), F.lit("").alias("turn_id"), F.col("n").alias("ord"))
    edges = v.select((F.col("n") % 20).alias("res_id"), name(F.col("n")).alias("source_id"), name(F.col("n") + 20).alias("target_id"),
                     F.lit("NEXT").alias("type"), F.lit("").alias("evidence"), F.lit("").alias("turn_id"), F.col("n").alias("ord"))
    new_nodes, new_edges = er.er_apply_graph(nodes, edges, vec_clusters(spark, sf), ["NEXT"])
    return new_nodes.select("res_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("text").alias("b")).unionByName(
        new_edges.select("res_id", F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("encode_text", """
WITH g AS (SELECT doc_id, '  ' || lower(coalesce(text, '')) || '  ' AS t FROM documents),
b AS (SELECT doc_id, CAST('0x' || substr(md5(substr(t, i, 3)), 1, 7) AS BIGINT) % 512 AS b
      FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM g)),
tf AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2),
idf AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS w FROM tf GROUP BY 1),
v AS (SELECT doc_id, b, n * w AS x FROM tf JOIN idf USING (b)),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS r FROM v GROUP BY 1),
dots AS (SELECT a.doc_id, sum(a.x * c.x) / (max(na.r) * max(nc.r)) AS x
         FROM v a JOIN v c ON c.doc_id = a.doc_id - 1 AND c.b = a.b JOIN norms na ON na.doc_id = a.doc_id
         JOIN norms nc ON nc.doc_id = c.doc_id GROUP BY 1)
SELECT d.doc_id, round(coalesce(x, 0), 3) AS cosine
FROM documents d JOIN documents p ON p.doc_id = d.doc_id - 1 LEFT JOIN dots ON dots.doc_id = d.doc_id""")
def encode_text(spark, sf):
    """The cosine of every document and the one before it."""
    docs = er.encode_text(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("embedding").alias("before"))
    dot = F.aggregate(F.zip_with("embedding", "before", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return docs.join(before, "doc_id").select("doc_id", F.round(dot, 3).alias("cosine"))
