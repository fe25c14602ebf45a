"""Queries over filters, identity and linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog.base import (
    CONV_NODES_SQL, DEMO_ALIASES, EVENT_EDGE_TYPES, EVENT_NODE_TYPES, EVENT_SQL, EV_SQL, MENTIONS_SQL, TRADE_SQL, canon_sql,
    conversation_nodes, event_edges, event_items, event_nodes, mapped_edges_sql, mentions, merged_sql, query,
    table, trade_graph, turns, values_sql, words_sql, ws_sql,
)
from parlance.catalog.sources import ITEMS_SQL, event_results
from parlance.operators import filters as fl
from parlance.operators import identity as idt
from parlance.operators import linking as ln
from parlance.operators import responses as rs
from parlance.rules.clinical import ALLOWED_PAIRS, NEGATION_CHECKS
from parlance.schema import BUCKETS

# --- filters ----------------------------------------------------------------------------


@query("valid_type_filter", f"""
WITH {EVENT_SQL}
SELECT id, upper(type) AS type FROM raw_nodes WHERE upper(type) IN ('CLICK', 'VIEW', 'PURCHASE', 'SIGNUP')""")
def valid_type_filter(spark, sf):
    padded = event_nodes(spark, sf).withColumn("type", F.concat(F.lit(" "), "type", F.lit("\t")))
    return fl.valid_type_filter(padded, EVENT_NODE_TYPES).select("id", "type")


LOW_VALUE = r"^(absent|no)\s+(item [1-4]\d?|pets?)$"


@query("low_value_filter", f"""
WITH {EVENT_SQL}
SELECT id, text FROM raw_nodes
WHERE NOT regexp_matches({canon_sql('text')}, '^(absent|no)\\s+(item [1-4]\\d?|pets?)$')""")
def low_value_filter(spark, sf):
    return fl.low_value_filter(event_nodes(spark, sf), LOW_VALUE).select("id", "text")


@query("keep_ids_filter", """
WITH kept AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.05)
SELECT l_orderkey AS res_id, l_linenumber AS id, l_partkey FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM kept)
   OR l_orderkey NOT IN (SELECT l_orderkey FROM kept)""")
def keep_ids_filter(spark, sf):
    lines = table(spark, sf, "lineitem")
    ids = [F.col("l_orderkey").alias("res_id"), F.col("l_linenumber").alias("id")]
    decisions = lines.filter((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).select(*ids)
    return fl.keep_ids_filter(lines.select(*ids, "l_partkey"), decisions)


@query("grounding_filter", f"""
WITH d AS (SELECT doc_id, {ws_sql('text')} AS text FROM documents),
lines AS (SELECT doc_id + 1 AS doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS ord,
                 unnest(string_split(text, chr(10))) AS line FROM documents),
ev AS (SELECT l.doc_id, ord, {ws_sql('line')} AS ev, d.text AS tr FROM lines l LEFT JOIN d ON l.doc_id = d.doc_id),
toks AS (SELECT doc_id, ord, unnest({words_sql('ev')}) AS t FROM ev),
known AS (SELECT DISTINCT doc_id, unnest({words_sql('text')}) AS t FROM d),
shares AS (SELECT x.doc_id, x.ord, count(*) AS n, count(k.t) AS hits
           FROM toks x LEFT JOIN known k ON x.doc_id = k.doc_id AND x.t = k.t GROUP BY 1, 2)
SELECT doc_id AS res_id, ord FROM ev LEFT JOIN shares USING (doc_id, ord)
WHERE ev = '' OR coalesce(contains(tr, ev), false) OR coalesce(n, 0) <= 3 OR hits / n >= 0.6""")
def grounding_filter(spark, sf):
    """Every line of a document as evidence about the next document."""
    docs = table(spark, sf, "documents")
    lines = docs.select((F.col("doc_id") + 1).alias("res_id"), F.posexplode(F.split("text", "\n")).alias("p", "evidence")
                        ).select("res_id", (F.col("p") + 1).alias("ord"), "evidence")
    return fl.grounding_filter(lines, docs.select(F.col("doc_id").alias("res_id"), "text")).select("res_id", "ord")


@query("edge_validity_filter", f"""
WITH {EVENT_SQL},
good AS (SELECT res_id, id FROM raw_nodes WHERE type <> 'error' AND NOT starts_with(text, 'No '))
SELECT e.ord AS ord, e.type AS type FROM raw_edges e
WHERE type IN ('LINKS', 'SEES', 'BUYS', 'JOINS')
  AND (res_id, source_id) IN (SELECT * FROM good) AND (res_id, target_id) IN (SELECT * FROM good)""")
def edge_validity_filter(spark, sf):
    nodes = event_nodes(spark, sf).filter((F.col("type") != "error") & ~F.col("text").startswith("No "))
    return fl.edge_validity_filter(event_edges(spark, sf), nodes, EVENT_EDGE_TYPES).select("ord", "type")


TRADE_ALLOWED = [("RF", "SMALL", "NATION"), ("RO", "SMALL", "NATION"), ("AF", "LARGE", "NATION"),
                 ("NO", "PROMO", "NATION"), ("NF", "NATION", "NATION")]


@query("type_pair_filter", f"""
WITH {TRADE_SQL}
SELECT res_id, type, src_text, tgt_text FROM lines WHERE (type, src_type, tgt_type) IN
  (VALUES ('RF', 'SMALL', 'NATION'), ('RO', 'SMALL', 'NATION'), ('AF', 'LARGE', 'NATION'),
          ('NO', 'PROMO', 'NATION'), ('NF', 'NATION', 'NATION'))""")
def type_pair_filter(spark, sf):
    nodes, edges = trade_graph(spark, sf)
    return fl.type_pair_filter(edges, nodes, TRADE_ALLOWED).select("res_id", "type", "src_text", "tgt_text")


RELATION_OF = {"click": "TAKEN_FOR", "view": "INDICATES", "purchase": "CONFIRMS", "signup": "RULES_OUT", "error": "CAUSES"}


@query("negation_blocks_edges", f"""
WITH {EVENT_SQL},
e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'TAKEN_FOR' WHEN 'view' THEN 'INDICATES'
             WHEN 'purchase' THEN 'CONFIRMS' WHEN 'signup' THEN 'RULES_OUT' ELSE 'CAUSES' END AS type,
             regexp_matches({canon_sql('src')}, '^(absent|no) ') AS s,
             regexp_matches({canon_sql("'absent ' || k || v")}, '^(absent|no) ') AND v % 2 = 0 AS t FROM ev)
SELECT event_id AS ord, type FROM e
WHERE NOT (s AND type IN ('TAKEN_FOR', 'CAUSES', 'INDICATES', 'LOCATED_AT'))
  AND NOT (t AND type IN ('TAKEN_FOR', 'CAUSES', 'CONFIRMS'))""")
def negation_blocks_edges(spark, sf):
    from parlance.functions.text import canonicalize_text
    ev = event_items(spark, sf)
    event_id = F.col("event_id").cast("string")
    target = F.when(F.col("v") % 2 == 0, "absent item").otherwise("item")
    nodes = ev.select("res_id", F.concat(F.lit("S"), event_id).alias("id"), canonicalize_text(F.col("src")).alias("text"),
                      F.lit("ITEM").alias("type")).unionByName(
        ev.select("res_id", F.concat(F.lit("T"), event_id).alias("id"), target.alias("text"), F.lit("ITEM").alias("type")))
    relation = F.create_map(*[F.lit(x) for kv in RELATION_OF.items() for x in kv])
    edges = ev.select("res_id", F.concat(F.lit("S"), event_id).alias("source_id"),
                      F.concat(F.lit("T"), event_id).alias("target_id"),
                      F.try_element_at(relation, F.col("event_type")).alias("type"), F.col("event_id").alias("ord"))
    return fl.negation_blocks_edges(edges, nodes, NEGATION_CHECKS).select("ord", "type")


@query("label_verification", f"""
WITH {ITEMS_SQL},
known AS (SELECT DISTINCT res_id, src AS text FROM ev WHERE event_type <> 'click')
SELECT i.event_id AS ord, i.item_pos, i.text, i.category,
       CASE WHEN bucket = 'matched' AND (res_id, text) NOT IN (SELECT * FROM known) THEN 'other' ELSE bucket END AS bucket
FROM items i""")
def label_verification(spark, sf):
    items = rs.bucket_items(event_results(spark, sf), ["res_id", "category", "ord"]).withColumn(
        "text", F.coalesce("label", "text"))
    entities = event_items(spark, sf).filter(F.col("event_type") != "click").select("res_id", F.col("src").alias("text"))
    return fl.label_verification(items, entities).select("ord", "item_pos", "text", "category", "bucket")


@query("speaker_guard", f"""
WITH {MENTIONS_SQL}
SELECT res_id, turn_id, start, n, type FROM mentions WHERE speaker = 'D' OR type <> 'LAB_RESULT'""")
def speaker_guard(spark, sf):
    """Mentions stand in for edges: what a patient says is no LAB_RESULT evidence."""
    cited = mentions(spark, sf).select("res_id", "turn_id", "start", "n", "type")
    return fl.speaker_guard(cited, turns(spark, sf), ["LAB_RESULT"])


STOP = [("SYMPTOM", "the"), ("DIAGNOSIS", "of"), ("LOCATION", "with")]


@query("stop_mentions", f"""
WITH {MENTIONS_SQL}
SELECT res_id, turn_id, start, type, label AS text FROM mentions
WHERE (type, lower(label)) NOT IN (VALUES ('SYMPTOM', 'the'), ('DIAGNOSIS', 'of'), ('LOCATION', 'with'))""")
def stop_mentions(spark, sf):
    found = mentions(spark, sf).select("res_id", "turn_id", "start", "type", F.col("label").alias("text"))
    return fl.stop_mentions(found, STOP)


# --- identity ---------------------------------------------------------------------------


@query("merge_nodes", f"WITH {EVENT_SQL}, {merged_sql(aliases=DEMO_ALIASES)} SELECT res_id, id, text, type, evidence, ord FROM nodes")
def merge_nodes(spark, sf):
    return idt.merge_nodes(event_nodes(spark, sf), DEMO_ALIASES, EVENT_NODE_TYPES).select(
        "res_id", "id", "text", "type", "evidence", "ord")


@query("merge_conversation_nodes", f"WITH {CONV_NODES_SQL} SELECT * FROM nodes")
def merge_conversation_nodes(spark, sf):
    return conversation_nodes(spark, sf)


def _rewrites(spark, sf):
    return event_items(spark, sf).filter(F.col("k") < 50).select(
        "res_id", F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("The bundle "), F.floor(F.col("k") / 10).cast("string"), F.lit(".")).alias("text"))


_REWRITTEN = f"coalesce('bundle ' || (CASE WHEN id LIKE 'S%' AND k < 50 THEN k // 10 END), {canon_sql('text')})"
REWRITE_SQL = f"""{EVENT_SQL},
raw2 AS (SELECT n.*, ev.k FROM raw_nodes n JOIN ev ON n.ord // 2 = ev.event_id),
{merged_sql('raw2', text=_REWRITTEN)}, {mapped_edges_sql()}"""


@query("rewrite_and_remap", f"WITH {REWRITE_SQL} SELECT res_id, source_id, target_id, type, evidence, ord FROM edges")
def rewrite_and_remap(spark, sf):
    nodes = fl.valid_type_filter(event_nodes(spark, sf), EVENT_NODE_TYPES)
    return idt.rewrite_and_remap(
        nodes, event_edges(spark, sf), _rewrites(spark, sf), edge_types=EVENT_EDGE_TYPES)[1].drop("turn_id")


@query("rewrite_nodes", f"WITH {REWRITE_SQL} SELECT res_id, id, text, type, evidence, ord FROM nodes")
def rewrite_nodes(spark, sf):
    nodes = fl.valid_type_filter(event_nodes(spark, sf), EVENT_NODE_TYPES)
    return idt.rewrite_and_remap(
        nodes, event_edges(spark, sf), _rewrites(spark, sf), edge_types=EVENT_EDGE_TYPES)[0].drop("turn_id")


RENUMBER_SQL = f"{EVENT_SQL}, {merged_sql(aliases=DEMO_ALIASES)}, {mapped_edges_sql()}"


@query("renumber_graph", f"WITH {RENUMBER_SQL} SELECT res_id, source_id, target_id, type, evidence, ord FROM edges")
def renumber_graph(spark, sf):
    return idt.renumber_graph(event_nodes(spark, sf), event_edges(spark, sf), DEMO_ALIASES,
                              EVENT_NODE_TYPES, EVENT_EDGE_TYPES)[1].drop("turn_id")


@query("dedup_edges", """
WITH e AS (SELECT l_orderkey AS res_id, l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS type,
                  l_linenumber AS ord, l_quantity AS evidence FROM lineitem)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY res_id, source_id, target_id, type ORDER BY ord, evidence) = 1""")
def dedup_edges(spark, sf):
    return idt.dedup_edges(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("res_id"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"),
        F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("evidence")))


@query("dedup_mentions", f"""
WITH {ITEMS_SQL}
SELECT res_id, category, bucket, event_id * 2 + item_pos AS ord, text FROM items
QUALIFY row_number() OVER (PARTITION BY res_id, category, lower(trim(text))
                           ORDER BY bucket_rank, event_id * 2 + item_pos) = 1""")
def dedup_mentions(spark, sf):
    items = rs.bucket_items(event_results(spark, sf), ["res_id", "category", "ord"]).select(
        "res_id", "category", "bucket", (F.col("ord") * 2 + F.col("item_pos")).alias("ord"),
        F.coalesce("label", "text").alias("text"))
    return idt.dedup_mentions(items, BUCKETS)


@query("validate_graph", f"""
WITH {EV_SQL},
docs AS (SELECT * FROM ev),
tr AS (SELECT page_id AS res_id, {ws_sql('html')} AS text FROM pages),
n0 AS (SELECT res_id, 'S' || event_id AS id, src AS text, event_type AS type, 'click the ' || k AS evidence, event_id * 2 AS ord FROM docs
       UNION ALL SELECT res_id, 'T' || event_id, dst, event_type, '', event_id * 2 + 1 FROM docs),
n1 AS (SELECT n0.* FROM n0 LEFT JOIN tr USING (res_id)
       WHERE evidence = '' OR coalesce(contains(tr.text, evidence), false) OR len({words_sql('evidence')}) <= 3),
raw_edges AS (SELECT res_id, 'S' || event_id AS source_id, 'T' || event_id AS target_id, relation AS type,
                     'a b c ' || k AS evidence, event_id AS ord FROM docs
              WHERE 'a b c ' || k = '' OR (SELECT count(*) FROM tr WHERE tr.res_id = docs.res_id
                    AND (contains(tr.text, 'a b c ' || k)
                         OR (CAST(list_contains({words_sql('tr.text')}, 'a') AS INT)
                             + CAST(list_contains({words_sql('tr.text')}, 'b') AS INT)
                             + CAST(list_contains({words_sql('tr.text')}, 'c') AS INT)
                             + CAST(list_contains({words_sql('tr.text')}, CAST(k AS VARCHAR)) AS INT)) / 4.0 >= 0.6)) > 0),
{merged_sql('n1', aliases=DEMO_ALIASES)}, {mapped_edges_sql()}
SELECT res_id, 'edge' AS kind, source_id AS a, target_id AS b, type, evidence, ord FROM edges
UNION ALL SELECT res_id, 'node', id, text, type, evidence, ord FROM nodes""")
def validate_graph(spark, sf):
    """Web pages as the transcripts of users; three short words always pass."""
    ev = event_items(spark, sf)
    eid = F.col("event_id").cast("string")
    turn = F.lit("").alias("turn_id")
    nodes = ev.select(
        "res_id", F.concat(F.lit("S"), eid).alias("id"), F.col("src").alias("text"), F.col("event_type").alias("type"),
        F.concat(F.lit("click the "), F.col("k").cast("string")).alias("evidence"), turn,
        (F.col("event_id") * 2).alias("ord")).unionByName(ev.select(
            "res_id", F.concat(F.lit("T"), eid).alias("id"), F.col("dst").alias("text"), F.col("event_type").alias("type"),
            F.lit("").alias("evidence"), turn, (F.col("event_id") * 2 + 1).alias("ord")))
    edges = ev.select(
        "res_id", F.concat(F.lit("S"), eid).alias("source_id"), F.concat(F.lit("T"), eid).alias("target_id"),
        F.col("relation").alias("type"), F.concat(F.lit("a b c "), F.col("k").cast("string")).alias("evidence"), turn,
        F.col("event_id").alias("ord"))
    texts = table(spark, sf, "pages").select(F.col("page_id").alias("res_id"), F.col("html").alias("text"))
    n, e = idt.validate_graph(nodes, edges, texts, DEMO_ALIASES, EVENT_NODE_TYPES, EVENT_EDGE_TYPES)
    return e.select("res_id", F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"),
                    "type", "evidence", "ord").unionByName(
        n.select("res_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("text").alias("b"),
                 "type", "evidence", "ord"))


# --- linking ----------------------------------------------------------------------------

# Orders as transcripts: the parts of one order are its nodes; each line names a part as its
# source and a part name plus the brand of another size as its target.
PRIORITY = {
    "R": (["SMALL", "LARGE"], ["PROMO"]), "A": (["LARGE"], ["ECONOMY", "STANDARD"]), "N": (["MEDIUM", "SMALL"], ["SMALL"]),
}
RESOLVE_SQL = f"""
n0 AS (SELECT l_orderkey AS res_id, p_name AS text, p_type AS type, min(l_linenumber) AS ord
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
nodes AS (SELECT *, type || ord AS id FROM n0),
prio AS {values_sql([(c, side, t, i + 1) for c, sides in PRIORITY.items() for side, ts in zip("sd", sides)
                     for i, t in enumerate(ts)], ["category", "side", "type", "prio"])},
texts AS (SELECT l_orderkey AS res_id, l_returnflag AS category, l_linenumber AS ord, l_partkey, l_quantity,
                 upper(p_name) || ' ' AS src,
                 CASE WHEN p_size < 25 THEN p_name WHEN p_size < 45 THEN split_part(p_name, ' ', 1) ELSE '' END AS dst
          FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT *, row_number() OVER () AS rid FROM texts WHERE trim(dst) <> ''),
rs AS (SELECT e.rid, n.id FROM e JOIN nodes n ON n.res_id = e.res_id AND n.text = lower(trim(e.src))
       LEFT JOIN prio p ON p.category = e.category AND p.side = 's' AND p.type = n.type
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY coalesce(prio, 99), n.ord, n.id) = 1),
rd AS (SELECT e.rid, n.id FROM e JOIN nodes n ON n.res_id = e.res_id AND n.text = lower(trim(e.dst))
       LEFT JOIN prio p ON p.category = e.category AND p.side = 'd' AND p.type = n.type
       QUALIFY row_number() OVER (PARTITION BY rid ORDER BY coalesce(prio, 99), n.ord, n.id) = 1),
resolved AS (SELECT e.*, rs.id AS source_id, rd.id AS target_id FROM e LEFT JOIN rs USING (rid) LEFT JOIN rd USING (rid))"""


def order_nodes(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity").join(
        part, F.col("l_partkey") == F.col("p_partkey"))
    nodes = lines.groupBy(F.col("l_orderkey").alias("res_id"), F.col("p_name").alias("text"),
                          F.col("p_type").alias("type")).agg(F.min("l_linenumber").alias("ord")).withColumn(
        "id", F.concat("type", F.col("ord").cast("string")))
    return lines, nodes


def resolved_edges(spark, sf):
    lines, nodes = order_nodes(spark, sf)
    dst = F.when(F.col("p_size") < 25, F.col("p_name")).when(
        F.col("p_size") < 45, F.substring_index("p_name", " ", 1)).otherwise("")
    texts = lines.select(
        F.col("l_orderkey").alias("res_id"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("ord"),
        "l_partkey", "l_quantity", F.concat(F.upper("p_name"), F.lit(" ")).alias("src"), dst.alias("dst"))
    return ln.resolve_endpoints(texts, nodes, PRIORITY)


@query("resolve_endpoints", f"""
WITH {RESOLVE_SQL}
SELECT res_id, category, ord, l_partkey, l_quantity, source_id, target_id FROM resolved""")
def resolve_endpoints(spark, sf):
    return resolved_edges(spark, sf).select(
        "res_id", "category", "ord", "l_partkey", "l_quantity", "source_id", "target_id")


@query("unresolved_edges", f"""
WITH {RESOLVE_SQL}
SELECT category, count(*) FILTER (source_id IS NULL AND target_id IS NOT NULL) AS src,
       count(*) FILTER (source_id IS NOT NULL AND target_id IS NULL) AS dst,
       count(*) FILTER (source_id IS NULL AND target_id IS NULL) AS both, count(*) AS total
FROM resolved WHERE source_id IS NULL OR target_id IS NULL GROUP BY ROLLUP (category)""")
def unresolved_edges(spark, sf):
    return ln.unresolved_edges(resolved_edges(spark, sf))


# Rules of the demo: (rule_set, ord, src, src_types, tgt, tgt_types, edge_type).
DEMO_RULES = [
    ("located_at", 1, "the", ["SYMPTOM", "DIAGNOSIS"], "with", ["LOCATION"], "LOCATED_AT"),
    ("located_at", 2, "of", ["SYMPTOM", "DIAGNOSIS"], "from", ["LOCATION"], "LOCATED_AT"),
    ("located_at", 3, "of the", ["SYMPTOM"], "with", ["LOCATION"], "LOCATED_AT"),
    ("indicates", 4, "plus", ["SYMPTOM"], "of", ["DIAGNOSIS"], "INDICATES"),
    ("indicates", 5, "the", ["SYMPTOM"], "to", ["DIAGNOSIS"], "INDICATES"),
    ("taken_for", 6, "in", ["TREATMENT"], "this", ["MEDICAL_HISTORY"], "TAKEN_FOR"),
    ("taken_for", 7, "that", ["TREATMENT"], "of", ["DIAGNOSIS"], "TAKEN_FOR"),
    ("rules_out", 8, "is", ["PROCEDURE"], "to", ["DIAGNOSIS"], "RULES_OUT"),
    ("rules_out", 9, "was", ["PROCEDURE"], "plus", ["DIAGNOSIS"], "RULES_OUT"),
    ("confirms", 10, "be", ["LAB_RESULT"], "plus", ["SYMPTOM"], "CONFIRMS"),
    ("causes", 11, "this", ["MEDICAL_HISTORY"], "plus", ["DIAGNOSIS", "MEDICAL_HISTORY", "SYMPTOM"], "CAUSES"),
    ("causes", 12, "by", ["MEDICAL_HISTORY"], "the", ["DIAGNOSIS", "MEDICAL_HISTORY", "SYMPTOM"], "CAUSES"),
]
_ENDS = [(o, rs_, e, side, DEMO_ALIASES.get(text, text), t, i)
         for rs_, o, s, st, d, dt, e in DEMO_RULES
         for side, text, types in (("s", s, st), ("t", d, dt)) for i, t in enumerate(types)]
INFER_SQL = f"""{CONV_NODES_SQL},
ends AS {values_sql(_ENDS, ["rule", "rule_set", "edge_type", "side", "text", "type", "prio"])},
hits AS (SELECT n.res_id, n.id, n.evidence, n.turn_id, e.rule, e.rule_set, e.edge_type, e.side
         FROM nodes n JOIN ends e USING (text, type)
         QUALIFY row_number() OVER (PARTITION BY n.res_id, rule, side ORDER BY prio, n.ord) = 1),
inferred AS (SELECT s.res_id, s.id AS source_id, t.id AS target_id, s.edge_type AS type,
                    coalesce(nullif(s.evidence, ''), t.evidence) AS evidence,
                    coalesce(nullif(s.turn_id, ''), t.turn_id) AS turn_id, s.rule AS ord, s.rule_set
             FROM hits s JOIN hits t ON s.res_id = t.res_id AND s.rule = t.rule AND s.side = 's' AND t.side = 't'
             WHERE s.id <> t.id)"""


def _register_rule_set(rule_set: str) -> None:
    @query(f"infer_{rule_set}", f"""
WITH {INFER_SQL}
SELECT res_id, source_id, target_id, type, evidence, turn_id, ord FROM inferred WHERE rule_set = '{rule_set}'""")
    def infer(spark, sf):
        return ln.infer_edges(conversation_nodes(spark, sf), DEMO_RULES, [rule_set], DEMO_ALIASES)


for _name in ("located_at", "indicates", "taken_for", "rules_out", "confirms", "causes"):
    _register_rule_set(_name)


@query("add_inferred_edges", f"""
WITH {INFER_SQL},
given AS (SELECT * FROM inferred WHERE rule_set IN ('indicates', 'located_at')
          QUALIFY row_number() OVER (PARTITION BY res_id, source_id, target_id, type ORDER BY ord) = 1),
fresh AS (SELECT * FROM inferred WHERE (res_id, source_id, target_id, type) NOT IN
          (SELECT res_id, source_id, target_id, type FROM given)
          QUALIFY row_number() OVER (PARTITION BY res_id, source_id, target_id, type ORDER BY ord) = 1)
SELECT res_id, source_id, target_id, type, evidence, turn_id, ord FROM given
UNION ALL SELECT res_id, source_id, target_id, type, evidence, turn_id, ord + 1099511627776 FROM fresh""")
def add_inferred_edges(spark, sf):
    nodes = conversation_nodes(spark, sf)
    given = idt.dedup_edges(ln.infer_edges(nodes, DEMO_RULES, ["indicates", "located_at"], DEMO_ALIASES))
    merged = ln.add_inferred_edges(given, ln.infer_edges(nodes, DEMO_RULES, aliases=DEMO_ALIASES))
    return merged.withColumn("ord", F.col("ord.at") + F.col("ord.source") * F.lit(1 << 40))


@query("run_intersection", """
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1996),
b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.id = b.id""")
def run_intersection(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y"))
    return ln.run_intersection(orders.filter(F.col("y") == 1996), orders.filter(F.col("y") == 1997), "id")


_CANDIDATES_SQL = f"""
WITH {MENTIONS_SQL},
m AS (SELECT res_id, seq, label AS text, type, count(*) AS c FROM mentions GROUP BY 1, 2, 3, 4),
allowed AS {values_sql(ALLOWED_PAIRS, ["edge_type", "src_type", "tgt_type"])},
scored AS (SELECT s.res_id, edge_type, s.text AS src_text, src_type, t.text AS tgt_text, tgt_type,
                  min(abs(s.seq - t.seq)) AS min_gap, CAST(sum(s.c * t.c) AS BIGINT) AS cooccurrences
           FROM m s JOIN allowed ON s.type = src_type JOIN m t ON s.res_id = t.res_id AND t.type = tgt_type
                AND abs(s.seq - t.seq) <= 2 AND (s.text, s.type) <> (t.text, t.type) GROUP BY ALL)
SELECT * FROM scored"""


@query("candidate_edges", _CANDIDATES_SQL)
def candidate_edges(spark, sf, k=None):
    found = mentions(spark, sf).select("res_id", "seq", F.col("label").alias("text"), "type")
    return ln.candidate_edges(found, ALLOWED_PAIRS, 2, k)


@query("candidate_edges_top_k", _CANDIDATES_SQL + """
QUALIFY row_number() OVER (PARTITION BY res_id, src_text, src_type
                           ORDER BY min_gap, cooccurrences DESC, edge_type, tgt_text, tgt_type) <= 3""")
def candidate_edges_top_k(spark, sf):
    return candidate_edges(spark, sf, 3)
