"""Queries over graph statistics and run telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog.base import (
    CONV_NODES_SQL, EVENT_SQL, TRADE_SQL, conversation_nodes, event_edges, event_nodes, query, table, trade_graph,
    trade_lines, trade_mentions,
)
from parlance.catalog.graph import RESOLVE_SQL, order_nodes, resolved_edges
from parlance.catalog.text import STATUS_SQL, status_column
from parlance.operators import stats as st
from parlance.runtime import running_counts

_COUNTS_SQL = f"""{TRADE_SQL},
per AS (SELECT res_id, n.nodes, n.entities, e.edges FROM
        (SELECT res_id, count(*) AS nodes, count(DISTINCT text || ':' || type) AS entities FROM mentions GROUP BY 1) n
        JOIN (SELECT res_id, count(*) AS edges FROM lines GROUP BY 1) e USING (res_id))"""


def _edges_only(spark, sf):
    return trade_lines(spark, sf).select("res_id", "type")


@query("kg_counts", f"""
WITH {_COUNTS_SQL}
SELECT res_id, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(entities) AS BIGINT) AS entities,
       CAST(sum(edges) AS BIGINT) AS edges FROM per GROUP BY ROLLUP (res_id)""")
def kg_counts(spark, sf):
    return st.kg_counts(trade_mentions(spark, sf), _edges_only(spark, sf))


@query("kg_density_summary", f"""
WITH {_COUNTS_SQL}
SELECT count(*) AS transcripts, CAST(sum(nodes) AS BIGINT) AS sum_nodes, min(nodes) AS min_nodes, max(nodes) AS max_nodes,
       CAST(sum(edges) AS BIGINT) AS sum_edges, min(edges) AS min_edges, max(edges) AS max_edges,
       round(avg(nodes), 4) AS avg_nodes, round(avg(edges), 4) AS avg_edges FROM per""")
def kg_density_summary(spark, sf):
    return st.kg_density_summary(trade_mentions(spark, sf), _edges_only(spark, sf))


@query("type_distribution", f"""
WITH {TRADE_SQL}
SELECT 'node' AS kind, type, count(*) AS n FROM mentions GROUP BY 2
UNION ALL SELECT 'edge', type, count(*) FROM lines GROUP BY 2""")
def type_distribution(spark, sf):
    return st.type_distribution(trade_mentions(spark, sf), _edges_only(spark, sf))


@query("relation_type_pairs", f"""
WITH {TRADE_SQL}
SELECT type, src_type, tgt_type, count(*) AS n FROM lines GROUP BY GROUPING SETS ((type, src_type, tgt_type), (type))""")
def relation_type_pairs(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return st.relation_type_pairs(edges, nodes)


@query("top_entities", f"""
WITH {TRADE_SQL}
SELECT type, text, count(DISTINCT res_id) AS n_transcripts FROM nodes GROUP BY 1, 2
ORDER BY n_transcripts DESC, type, text LIMIT 25""")
def top_entities(spark, sf):
    return st.top_entities(trade_mentions(spark, sf), 25)


@query("most_widespread_entities", f"""
WITH {CONV_NODES_SQL}
SELECT type, text, count(DISTINCT res_id) AS n_transcripts FROM nodes GROUP BY 1, 2
ORDER BY n_transcripts DESC, type, text LIMIT 20""")
def most_widespread_entities(spark, sf):
    return st.top_entities(conversation_nodes(spark, sf), 20)


@query("top_triples", f"""
WITH {TRADE_SQL}
SELECT src_text, type, tgt_text, count(*) AS n FROM lines GROUP BY 1, 2, 3
ORDER BY n DESC, src_text, type, tgt_text LIMIT 25""")
def top_triples(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return st.top_triples(nodes, edges, 25)


@query("unify_exact", f"""
WITH {TRADE_SQL}
SELECT 'node' AS kind, lower(text) AS a, type AS b, count(*) AS n, count(DISTINCT res_id) AS n_transcripts
FROM mentions GROUP BY 2, 3
UNION ALL
SELECT 'edge', lower(src_text) || '>' || lower(tgt_text), type, count(*), count(DISTINCT res_id) FROM lines GROUP BY 2, 3""")
def unify_exact(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    unified, _, _ = st.unify_exact(trade_mentions(spark, sf, by_order=True), edges)
    _, _, unified_edges = st.unify_exact(nodes, edges)
    pairs = unified_edges.groupBy(
        F.concat_ws(">", F.lower("src_text"), F.lower("tgt_text")).alias("a"), F.col("type").alias("b"), "res_id").agg(
        F.count(F.lit(1)).alias("c")).groupBy("a", "b").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_transcripts"))
    return unified.select(F.lit("node").alias("kind"), F.col("text").alias("a"), F.col("type").alias("b"),
                          F.col("n_occurrences").alias("n"), "n_transcripts").unionByName(
        pairs.select(F.lit("edge").alias("kind"), "a", "b", "n", "n_transcripts"))


@query("graph_structure", f"""
WITH {TRADE_SQL},
n AS (SELECT count(*) AS c FROM (SELECT DISTINCT text, type FROM mentions)), e AS (SELECT count(*) AS c FROM lines)
SELECT n.c AS node_count, e.c AS edge_count, round(2 * e.c / n.c, 4) AS avg_degree, round(e.c / n.c, 4) AS edge_density
FROM n, e""")
def graph_structure(spark, sf):
    unified = trade_mentions(spark, sf).select("text", "type").distinct()
    return st.graph_structure(unified, _edges_only(spark, sf))


# Calls: one per event. The user is the transcript, the event type the category, an error a failed call.
def calls(spark, sf):
    return table(spark, sf, "events").select(
        F.month("ts").alias("run_id"), F.col("user_id").alias("res_id"), F.col("event_type").alias("category"),
        (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") * 10).cast("bigint").alias("ms"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").cast("bigint")).alias("prompt_tokens"),
        F.when(F.col("value") > 20, F.floor("value").cast("bigint")).alias("completion_tokens"))


CALLS_SQL = """
calls AS (SELECT month(ts) AS run_id, user_id AS res_id, event_type AS category, event_type <> 'error' AS ok,
                 CAST(floor(value * 10) AS BIGINT) AS ms,
                 CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS prompt_tokens,
                 CASE WHEN value > 20 THEN CAST(floor(value) AS BIGINT) END AS completion_tokens FROM events)"""


@query("token_usage", f"""
WITH {CALLS_SQL}
SELECT res_id, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens,
       CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS completion_tokens FROM calls GROUP BY ROLLUP (res_id)""")
def token_usage(spark, sf):
    return st.token_usage(calls(spark, sf))


@query("run_summary", f"""
WITH {CALLS_SQL},
t AS (SELECT run_id, res_id, bool_or(ok) AS ok, sum(ms) AS ms, sum(coalesce(prompt_tokens, 0)) AS p,
             sum(coalesce(completion_tokens, 0)) AS c FROM calls GROUP BY 1, 2),
r AS (SELECT run_id, count(*) AS n_transcripts, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed,
             CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(p) AS BIGINT) AS prompt_tokens,
             CAST(sum(c) AS BIGINT) AS completion_tokens FROM t GROUP BY 1),
g AS (SELECT run_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
             count(*) AS total_nodes, count(*) FILTER (category = 'purchase') AS total_edges FROM calls GROUP BY 1)
SELECT * FROM r JOIN g USING (run_id)""")
def run_summary(spark, sf):
    c = calls(spark, sf)
    return st.run_summary(c, c.select("run_id"), c.filter(F.col("category") == "purchase").select("run_id"))


# Attempts: the events of one user on one day are the attempts of one call, in order.
RETRY_SQL = f"""
a AS (SELECT user_id || '/' || CAST(ts AS DATE) AS call_id,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS attempt,
             event_type IN ('purchase', 'signup') AS ok, {STATUS_SQL} AS s, event_type FROM events),
k AS (SELECT call_id, attempt, ok, CASE WHEN ok THEN NULL WHEN event_type = 'view' AND s = 200 THEN 'empty_content'
             WHEN s = 429 THEN '429' WHEN s BETWEEN 500 AND 599 THEN '5xx'
             WHEN s IS NULL AND event_type = 'error' THEN 'network' WHEN s IS NULL OR s = 408 THEN 'retriable_other'
             ELSE 'nonretriable' END AS kind FROM a),
c AS (SELECT call_id, min(attempt) FILTER (ok) AS won, count(*) FILTER (kind = '429') AS e429,
             count(*) FILTER (kind = '5xx') AS e5, count(*) FILTER (kind = 'network') AS en,
             count(*) FILTER (kind = 'retriable_other') AS er, count(*) FILTER (kind = 'nonretriable') AS ef,
             count(*) FILTER (kind = 'empty_content') AS ee FROM k GROUP BY 1)"""


@query("retry_stats", f"""
WITH {RETRY_SQL}
SELECT count(*) AS total_calls, count(*) FILTER (won = 1) AS attempt_1, count(*) FILTER (won = 2) AS attempt_2,
       count(*) FILTER (won >= 3) AS attempt_3, count(*) FILTER (won IS NULL) AS failed_after_all,
       CAST(sum(e429) AS BIGINT) AS err_429, CAST(sum(e5) AS BIGINT) AS err_5xx, CAST(sum(en) AS BIGINT) AS err_network,
       CAST(sum(er) AS BIGINT) AS err_retriable_other, CAST(sum(ef) AS BIGINT) AS err_nonretriable,
       CAST(sum(ee) AS BIGINT) AS err_empty_content,
       count(*) FILTER (won > 1 AND e429 > 0) AS recovered_429, count(*) FILTER (won > 1 AND e5 > 0) AS recovered_5xx,
       count(*) FILTER (won > 1 AND en > 0) AS recovered_network FROM c""")
def retry_stats(spark, sf):
    status = status_column()
    events = table(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("call_id"), "event_id",
        F.col("event_type").isin("purchase", "signup").alias("ok"), status.alias("status"),
        (status.isNull() & (F.col("event_type") == "error")).alias("network"),
        F.coalesce((status == 200) & (F.col("event_type") == "view"), F.lit(False)).alias("empty"))
    return st.retry_stats(running_counts(events, ["call_id"], ["event_id"], "event_id", {"attempt": None}))


@query("convert_summary", f"""
WITH {RESOLVE_SQL},
n AS (SELECT res_id, count(*) AS n_nodes FROM nodes GROUP BY 1),
r AS (SELECT res_id, count(*) FILTER (source_id IS NOT NULL AND target_id IS NOT NULL) AS n_edges,
             count(*) FILTER (source_id IS NULL OR target_id IS NULL) AS n_unresolved FROM resolved GROUP BY 1)
SELECT res_id, CAST(sum(coalesce(n_nodes, 0)) AS BIGINT) AS n_nodes, CAST(sum(coalesce(n_edges, 0)) AS BIGINT) AS n_edges,
       CAST(sum(coalesce(n_unresolved, 0)) AS BIGINT) AS n_unresolved
FROM n LEFT JOIN r USING (res_id) GROUP BY ROLLUP (res_id)""")
def convert_summary(spark, sf):
    return st.convert_summary(order_nodes(spark, sf)[1], resolved_edges(spark, sf))


@query("convert_summary_unresolved", f"""
WITH {RESOLVE_SQL}
SELECT category, res_id, count(*) FILTER (source_id IS NULL AND target_id IS NOT NULL) AS src,
       count(*) FILTER (target_id IS NULL AND source_id IS NOT NULL) AS dst,
       count(*) FILTER (source_id IS NULL AND target_id IS NULL) AS both, count(*) AS total
FROM resolved WHERE source_id IS NULL OR target_id IS NULL GROUP BY ROLLUP (category, res_id)""")
def convert_unresolved(spark, sf):
    return st.convert_unresolved(resolved_edges(spark, sf))


_RUNS_SQL = """
runs AS (SELECT year(o_orderdate) AS y, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1)"""


def _runs(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"))


@query("run_compare", f"""
WITH {_RUNS_SQL}, base AS (SELECT * FROM runs WHERE y = 1996)
SELECT runs.y, runs.n_orders, runs.n_customers, runs.n_orders - base.n_orders AS d_n_orders,
       runs.n_customers - base.n_customers AS d_n_customers FROM runs, base""")
def run_compare(spark, sf):
    return st.run_compare(_runs(spark, sf), "y", ["n_orders", "n_customers"], base=1996)


@query("run_compare_previous", f"""
WITH {_RUNS_SQL}
SELECT y, n_orders, n_customers, n_orders - lag(n_orders) OVER (ORDER BY y) AS d_n_orders,
       n_customers - lag(n_customers) OVER (ORDER BY y) AS d_n_customers FROM runs""")
def run_compare_previous(spark, sf):
    return st.run_compare(_runs(spark, sf), "y", ["n_orders", "n_customers"])


@query("event_graph_counts", f"""
WITH {EVENT_SQL},
n AS (SELECT res_id, count(*) AS nodes, count(DISTINCT text || chr(31) || type) AS entities FROM raw_nodes GROUP BY 1),
e AS (SELECT res_id, count(*) AS edges FROM raw_edges GROUP BY 1)
SELECT res_id, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(entities) AS BIGINT) AS entities,
       CAST(sum(edges) AS BIGINT) AS edges FROM n JOIN e USING (res_id) GROUP BY ROLLUP (res_id)""")
def event_graph_counts(spark, sf):
    return st.kg_counts(event_nodes(spark, sf), event_edges(spark, sf))
