"""Queries that score one graph against another.

Student: what the users of the conversations say; baseline: what the assistants say.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from parlance.catalog.base import (
    TOKEN_EDGE_TYPES, TOKEN_NODE_TYPES, TOKEN_SQL, query, token_graph,
)
from parlance.operators import scoring as sc

# The SQL engine's edit distance counts bytes, so accented letters are first mapped to
# upper-case ASCII ones, which lower-cased text does not contain.
_ACCENTS = "àâäåáãæçéèêëíîïìñóôöòõøœßúûüùÿý"
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ12345"
_FLAT = f"translate(text, '{_ACCENTS}', '{_PLAIN}')"
T = 0.8


def _pairs_sql(s: str, b: str, same: str = "") -> str:
    """Pairs of two CTEs with a text column whose edit similarity is at least 0.8."""
    key = "s.res_id, " if same else ""
    return f"""
sf AS (SELECT *, {_FLAT} AS flat, length(text) AS len FROM {s}),
bf AS (SELECT *, {_FLAT} AS flat, length(text) AS len FROM {b}),
pairs AS (SELECT {key}s.text AS student_text, b.text AS baseline_text,
                 1 - levenshtein(s.flat, b.flat) / greatest(s.len, b.len) AS similarity
          FROM sf s JOIN bf b ON {same + ' AND ' if same else ''}b.len BETWEEN s.len * 0.79 AND s.len * 1.26
          WHERE levenshtein(s.flat, b.flat) <= floor(greatest(s.len, b.len) * 0.2 + 1e-9))"""


def _sides(spark, sf):
    return token_graph(spark, sf, "user"), token_graph(spark, sf, "assistant")


@query("fuzzy_pairs", f"""
WITH {TOKEN_SQL}, {_pairs_sql('st', 'bt')}
SELECT student_text, baseline_text, round(similarity, 6) AS similarity FROM pairs""")
def fuzzy_pairs(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.fuzzy_pairs(s, b, "levenshtein", T).withColumn("similarity", F.round("similarity", 6))


_OVERLAP_SELECT = """
c AS (SELECT (SELECT count(*) FROM st WHERE text IN (SELECT student_text FROM pairs)) AS matched_count,
             (SELECT count(*) FROM st) AS student_total,
             (SELECT count(*) FROM bt WHERE text IN (SELECT baseline_text FROM pairs)) AS baseline_matched,
             (SELECT count(*) FROM bt) AS baseline_total),
r AS (SELECT *, matched_count / student_total AS p, baseline_matched / baseline_total AS q FROM c),
overlap AS (SELECT matched_count, student_total, baseline_matched, baseline_total, round(p, 4) AS precision,
                   round(q, 4) AS recall, round(2 * p * q / (p + q), 4) AS f1 FROM r)"""
_EXACT_PAIRS = "pairs AS (SELECT text AS student_text, text AS baseline_text FROM st JOIN bt USING (text))"


@query("node_overlap", f"WITH {TOKEN_SQL}, {_pairs_sql('st', 'bt')}, {_OVERLAP_SELECT} SELECT * FROM overlap")
def node_overlap(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.node_overlap(s, b, "levenshtein", T).drop("f1_exact")


@query("node_overlap_exact", f"WITH {TOKEN_SQL}, {_EXACT_PAIRS}, {_OVERLAP_SELECT} SELECT * FROM overlap")
def node_overlap_exact(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.node_overlap(s, b, "exact", T).drop("f1_exact")


@query("node_jaccard", f"""
WITH {TOKEN_SQL}
SELECT i AS common, u AS union_size, round(i / u, 4) AS node_jaccard FROM
 (SELECT (SELECT count(*) FROM (SELECT text FROM st INTERSECT SELECT text FROM bt)) AS i,
         (SELECT count(*) FROM (SELECT text FROM st UNION SELECT text FROM bt)) AS u)""")
def node_jaccard(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.node_jaccard(s, b)


@query("edge_jaccard", f"""
WITH {TOKEN_SQL}
SELECT i AS common, s AS student_edges, b AS baseline_edges, round(i / (s + b - i), 4) AS edge_jaccard FROM
 (SELECT (SELECT count(*) FROM (SELECT DISTINCT src_text, type, tgt_text FROM se
                                INTERSECT SELECT src_text, type, tgt_text FROM be)) AS i,
         (SELECT count(*) FROM se) AS s, (SELECT count(*) FROM be) AS b)""")
def edge_jaccard(spark, sf):
    (_, s), (_, b) = _sides(spark, sf)
    return sc.edge_jaccard(s, b)


@query("type_similarity", f"""
WITH {TOKEN_SQL},
v AS (SELECT coalesce(x.n, 0) AS s, coalesce(y.n, 0) AS b FROM (SELECT type, count(*) AS n FROM sn GROUP BY 1) x
      FULL JOIN (SELECT type, count(*) AS n FROM bn GROUP BY 1) y USING (type))
SELECT round(CAST(sum(s * b) AS DOUBLE) / (sqrt(CAST(sum(s * s) AS DOUBLE)) * sqrt(CAST(sum(b * b) AS DOUBLE))), 4)
       AS type_similarity FROM v""")
def type_similarity(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.type_similarity(s, b)


_POPULATION = """
population AS (SELECT s AS student_count, b AS baseline_count, round(least(s / b, 1.5) / 1.5, 4) AS population_completeness
  FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT text, type FROM sn)) AS s,
               (SELECT count(*) FROM (SELECT DISTINCT text, type FROM bn)) AS b))"""
_RELATION = """
relation AS (SELECT s AS student_count, b AS baseline_count, round(least(s / b, 1.5) / 1.5, 4) AS relation_completeness
  FROM (SELECT (SELECT count(*) FROM se) AS s, (SELECT count(*) FROM be) AS b))"""
_SCHEMA = """
present AS (SELECT DISTINCT 'node' AS kind, type FROM sn WHERE type IN ('SHORT', 'MEDIUM', 'LONG')
            UNION SELECT DISTINCT 'edge', type FROM se WHERE type IN ('RISES', 'FALLS', 'EVEN')),
schema_c AS (SELECT count(*) AS present, round(count(*) / 6, 4) AS schema_completeness FROM present)"""


@query("population_completeness", f"WITH {TOKEN_SQL}, {_POPULATION} SELECT * FROM population")
def population_completeness(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.population_completeness(s.select("text", "type").distinct(), b.select("text", "type").distinct())


@query("relation_completeness", f"WITH {TOKEN_SQL}, {_RELATION} SELECT * FROM relation")
def relation_completeness(spark, sf):
    (_, s), (_, b) = _sides(spark, sf)
    return sc.relation_completeness(s, b)


@query("schema_completeness", f"WITH {TOKEN_SQL}, {_SCHEMA} SELECT * FROM schema_c")
def schema_completeness(spark, sf):
    (nodes, edges), _ = _sides(spark, sf)
    return sc.schema_completeness(nodes, edges, TOKEN_NODE_TYPES, TOKEN_EDGE_TYPES)


def _composite_sql(pairs: str) -> str:
    return f"""
WITH {TOKEN_SQL}, {pairs}, {_OVERLAP_SELECT}, {_POPULATION}, {_RELATION}, {_SCHEMA},
parts AS (SELECT f1 AS entity_f1, population_completeness AS population, relation_completeness AS relation,
                 schema_completeness AS schema FROM overlap, population, relation, schema_c)
SELECT *, round((entity_f1 + population + relation + schema) / 4, 4) AS composite FROM parts"""


def _composite(metric, spark, sf):
    student, baseline = _sides(spark, sf)
    return sc.composite_score(student, baseline, metric, T, TOKEN_NODE_TYPES, TOKEN_EDGE_TYPES)


query("composite_score", _composite_sql(_pairs_sql("st", "bt")))(partial(_composite, "levenshtein"))
query("composite_score_exact", _composite_sql(_EXACT_PAIRS))(partial(_composite, "exact"))

_COVERAGE_SQL = f"""{TOKEN_SQL},
sr AS (SELECT DISTINCT res_id, text FROM sn), br AS (SELECT DISTINCT res_id, text FROM bn),
{_pairs_sql('sr', 'br', 's.res_id = b.res_id')},
coverage AS (
  SELECT b.res_id, round(m / n, 4) AS recall, m AS matched, coalesce(c, 0) AS student_count, n AS baseline_count
  FROM (SELECT res_id, count(*) AS n, count(*) FILTER ((res_id, text) IN (SELECT res_id, baseline_text FROM pairs)) AS m
        FROM br GROUP BY 1) b LEFT JOIN (SELECT res_id, count(*) AS c FROM sr GROUP BY 1) s USING (res_id))"""


@query("per_patient_coverage", f"WITH {_COVERAGE_SQL} SELECT * FROM coverage")
def per_patient_coverage(spark, sf):
    (s, _), (b, _) = _sides(spark, sf)
    return sc.per_patient_coverage(s, b, "levenshtein", T)


@query("coverage_worst_k", f"WITH {_COVERAGE_SQL} SELECT * FROM coverage ORDER BY recall, res_id LIMIT 10")
def coverage_worst_k(spark, sf):
    return sc.coverage_worst_k(per_patient_coverage(spark, sf), 10)
