"""Queries over deterministic extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog.base import (
    CONV_NODES_SQL, DEMO_ALIASES, DEMO_VOCAB, MAX_N, MENTIONS_SQL, TURNS_SQL, canon_sql, conversation_nodes,
    demo_vocab, grams_sql, mentions, parts_sql, query, table, transcripts, turns, values_sql,
)
from parlance.catalog.graph import DEMO_RULES
from parlance.operators import extract as ex
from parlance.operators.linking import infer_edges
from parlance.plans.enrich import enrich_graph
from parlance.runtime import stored
from parlance.schema import EDGE_TYPES

# (type, name, regex, fallback terms); regexes both engines read alike.
DEMO_PATTERNS = [
    ("SYMPTOM", "the rise", r"the (?:of|and) [\p{L}]{1,4}", ["thwas"]),
    ("SYMPTOM", "and", r"and that [\p{L}]{2,5}", ["thwas"]),
    ("DIAGNOSIS", "The great fall", r"of .{0,20} from", ["whble", "edan"]),
    ("TREATMENT", "que", r"que (?:le|la|de) ", ["quepa"]),
    ("LOCATION", "der Ort", r"der [\p{L}]{3,8} und", ["dersch"]),
    ("PROCEDURE", "is that so", r"is that", ["thedan"]),
]


def _pattern_sql(patterns: list[tuple], bracketed: bool = True, by_line: bool = False) -> str:
    """CTE phits over parts: one row per (transcript, pattern) hit.

    ``by_line``: '.' stops at newlines where the place of a match is found, as it does in the match itself.
    """
    dot = "(?-s:" if by_line else "(?:"
    branches = []
    for i, (kind, name, rx, terms) in enumerate(patterns):
        rx = "(?i)" + rx.replace("'", "''")
        at = {}
        for t in terms:
            bounded = f"{t}($|[^\\p{{L}}\\p{{N}}_])"
            at[t] = (f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){bounded}') THEN length("
                     f"regexp_extract(lower(text), '(?s)^(.*?(?:^|[^\\p{{L}}\\p{{N}}_])){bounded}', 1)) + 1 ELSE 0 END")
        term = "CASE " + " ".join(f"WHEN {p} > 0 THEN '{t}'" for t, p in at.items()) + " END"
        term_at = "CASE " + " ".join(f"WHEN {p} > 0 THEN {p}" for p in at.values()) + " END"
        branches.append(f"""
SELECT res_id, {i} AS rule, '{kind}' AS type, {canon_sql(f"'{name}'", DEMO_ALIASES)} AS text,
       regexp_extract(text, '{rx}') AS m, length(regexp_extract(text, '(?s)^(.*?){dot}{rx})', 1)) + 1 AS m_at,
       {term} AS term, {term_at} AS term_at, text AS body FROM parts""")
    last = r"(?s)^.*\[([DP]-\d+)\]" if bracketed else r"(?s)^(?:.*\n)?([DP]-\d+):"
    return f"""
praw AS ({' UNION ALL '.join(branches)}),
phits AS (SELECT res_id, rule, type, text,
                 CASE WHEN m <> '' THEN trim(regexp_replace(m, '\\s+', ' ', 'g')) ELSE term END AS evidence,
                 regexp_extract(substr(body, 1, CASE WHEN m <> '' THEN m_at ELSE term_at END),
                                '{last}', 1) AS turn_id,
                 CASE WHEN m <> '' THEN 'pattern' ELSE 'fallback' END AS via
          FROM praw WHERE m <> '' OR term IS NOT NULL)"""


PATTERN_SQL = f"{parts_sql()}, {_pattern_sql(DEMO_PATTERNS)}"
PATTERN_LINES_SQL = f"{parts_sql()}, {_pattern_sql(DEMO_PATTERNS, by_line=True)}"


@query("pattern_extract", f"""
WITH {CONV_NODES_SQL}, {PATTERN_SQL.replace(TURNS_SQL + ',', '', 1)}
SELECT h.res_id, h.type, h.text, h.evidence, h.turn_id, h.via FROM phits h
LEFT JOIN nodes n ON n.res_id = h.res_id AND n.text = h.text AND n.type = h.type WHERE n.id IS NULL""")
def pattern_extract(spark, sf):
    return ex.pattern_extract(
        turns(spark, sf), DEMO_PATTERNS, conversation_nodes(spark, sf), DEMO_ALIASES
    ).select("res_id", "type", "text", "evidence", "turn_id", "via")


@query("pattern_extract_plain", f"""
WITH {parts_sql(False)}, {_pattern_sql(DEMO_PATTERNS, False, True)}
SELECT res_id, type, text, evidence, turn_id, via FROM phits""")
def pattern_extract_plain(spark, sf):
    return ex.pattern_extract(turns(spark, sf), DEMO_PATTERNS, aliases=DEMO_ALIASES, bracketed=False).select(
        "res_id", "type", "text", "evidence", "turn_id", "via")


@query("pattern_extract_whole", f"""
WITH {PATTERN_LINES_SQL} SELECT res_id, type, text, evidence, turn_id, via FROM phits""")
def pattern_extract_whole(spark, sf):
    """The same on transcripts as single texts."""
    return ex.pattern_extract(transcripts(spark, sf), DEMO_PATTERNS, aliases=DEMO_ALIASES).select(
        "res_id", "type", "text", "evidence", "turn_id", "via")


# Beside the patterns, labels that nothing holds: enough for the index of literals.
MANY_PATTERNS = DEMO_PATTERNS + [("SYMPTOM", f"none {i}", rf"\bzq{i}x (?:pain|ache)\b", [f"zq{i}x"]) for i in range(2000)]


@query("pattern_extract_many", f"""
WITH {PATTERN_LINES_SQL} SELECT res_id, type, text, evidence, turn_id, via FROM phits""")
def pattern_extract_many(spark, sf):
    """Two thousand patterns, met through the literals they need."""
    return ex.pattern_extract(turns(spark, sf), MANY_PATTERNS, aliases=DEMO_ALIASES).select(
        "res_id", "type", "text", "evidence", "turn_id", "via")


@query("pattern_extract_documents", f"""
WITH parts AS (SELECT doc_id AS res_id, text FROM documents), {_pattern_sql(DEMO_PATTERNS)}
SELECT res_id, type, text, evidence, via FROM phits""")
def pattern_extract_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("res_id"), "text")
    return ex.pattern_extract(docs, DEMO_PATTERNS, aliases=DEMO_ALIASES).select(
        "res_id", "type", "text", "evidence", "via")


@query("fallback_audit", f"""
WITH {PATTERN_SQL}
SELECT type, text, count(*) AS hits, count(*) FILTER (via = 'fallback') AS fallback_hits,
       round(count(*) FILTER (via = 'fallback') / count(*), 4) AS fallback_share FROM phits GROUP BY 1, 2""")
def fallback_audit(spark, sf):
    return ex.fallback_audit(ex.pattern_extract(
        turns(spark, sf), DEMO_PATTERNS, aliases=DEMO_ALIASES))


@query("lexicon_extract", f"""
WITH {MENTIONS_SQL} SELECT res_id, seq, turn_id, speaker, start, n, label, type, quote FROM mentions""")
def lexicon_extract(spark, sf):
    return mentions(spark, sf)


@query("lexicon_extract_documents", f"""
WITH {grams_sql('documents', 'doc_id', MAX_N)}, vocab AS {values_sql(DEMO_VOCAB, ["label", "type"])}
SELECT doc_id, label, type, count(*) AS n, min(start) AS first_at FROM grams JOIN vocab ON gram = label GROUP BY 1, 2, 3""")
def lexicon_extract_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ex.lexicon_extract(docs, demo_vocab(spark), ["doc_id"], MAX_N).groupBy("doc_id", "label", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_at"))


def _nested_sql(policy: str) -> str:
    inner, outer = ("a", "b") if policy == "longest" else ("b", "a")
    return f"""
WITH {MENTIONS_SQL}
SELECT a.res_id, a.seq, a.start, a.n, a.label, a.type FROM mentions a
WHERE NOT EXISTS (SELECT 1 FROM mentions b WHERE b.res_id = a.res_id AND b.seq = a.seq AND b.n {'>' if policy == 'longest' else '<'} a.n
  AND {outer}.start <= {inner}.start AND {outer}.start + {outer}.n >= {inner}.start + {inner}.n)"""


@query("longest_match", _nested_sql("longest"))
def longest_match(spark, sf):
    return ex.longest_match(mentions(spark, sf), ["res_id", "seq"]).select("res_id", "seq", "start", "n", "label", "type")


@query("shortest_match", _nested_sql("shortest"))
def shortest_match(spark, sf):
    return ex.longest_match(mentions(spark, sf), ["res_id", "seq"], "shortest").select(
        "res_id", "seq", "start", "n", "label", "type")


DEMO_NEGATIVE = r"^(?:the|th|on|er|an|in|at)"


@query("negated_findings", f"""
WITH {MENTIONS_SQL},
asked AS (SELECT DISTINCT res_id, seq + 1 AS seq, label, type FROM mentions WHERE speaker = 'D'),
said AS (SELECT DISTINCT res_id, seq, label, type, 1 AS affirmed FROM mentions WHERE speaker = 'P'),
listed AS (SELECT a.*, t.turn_id, regexp_matches(lower(t.text), '{DEMO_NEGATIVE}') AS negative, affirmed
           FROM asked a JOIN turns t ON a.res_id = t.res_id AND a.seq = t.seq AND t.speaker = 'P'
           LEFT JOIN said s ON s.res_id = a.res_id AND s.seq = a.seq AND s.label = a.label AND s.type = a.type),
counted AS (SELECT *, count(*) OVER (PARTITION BY res_id, seq) AS n_listed,
                   count(affirmed) OVER (PARTITION BY res_id, seq) AS n_affirmed FROM listed)
SELECT res_id, seq, turn_id, label, type, CASE WHEN affirmed = 1 THEN label ELSE 'absent ' || label END AS text,
       affirmed IS NULL AS denied
FROM counted WHERE n_listed >= 2 AND (negative OR n_affirmed > 0)""")
def negated_findings(spark, sf):
    return ex.negated_findings(turns(spark, sf), demo_vocab(spark), DEMO_NEGATIVE, MAX_N)


DEMO_CUES = ["to {x}", "that in {x}", "{x} is the", "of {x}"]


@query("exam_denials", f"""
WITH phrases AS (SELECT DISTINCT replace(cue, '{{x}}', label) AS label, type, 'absent ' || label AS text
                 FROM {values_sql(DEMO_VOCAB, ["label", "type"])}, (VALUES ('to {{x}}'), ('that in {{x}}'), ('{{x}} is the'),
                 ('of {{x}}')) c(cue)), {grams_sql('documents', 'doc_id', MAX_N + 2)}
SELECT doc_id, start, text, type, gram AS quote FROM grams JOIN phrases ON gram = label""")
def exam_denials(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ex.exam_denials(docs, demo_vocab(spark), DEMO_CUES, ["doc_id"], MAX_N)


DEMO_ANCHORS = ["the", "a", "be", "are"]


@query("outcome_retype", f"""
WITH {MENTIONS_SQL},
m AS (SELECT *, tk[start + n + 1] AS following FROM mentions),
r AS (SELECT *, type = 'PROCEDURE' AND coalesce(following IN ('the', 'a', 'be', 'are')
                    OR regexp_matches(following, '^\\p{{N}}'), false) AS is_result
      FROM m WHERE NOT (type = 'LAB_RESULT' AND (quote IN ('the', 'a', 'be', 'are') OR regexp_matches(quote, '^\\p{{N}}+$'))))
SELECT res_id, seq, start, n, CASE WHEN is_result THEN label || ' ' || following ELSE label END AS text,
       CASE WHEN is_result THEN 'LAB_RESULT' ELSE type END AS type FROM r""")
def outcome_retype(spark, sf):
    return ex.outcome_retype(mentions(spark, sf, context=1), DEMO_ANCHORS).select(
        "res_id", "seq", "start", "n", "text", "type")


@query("history_retype", f"""
WITH {MENTIONS_SQL},
b AS (SELECT *, tk[greatest(start - 3, 1):start] AS before FROM
      (SELECT * REPLACE (start AS start) FROM mentions)),
f AS (SELECT *, CASE WHEN start = 0 THEN '' ELSE ' ' || array_to_string(before, ' ') END AS spoken,
             start > 0 AND (list_contains(before, 'that') OR list_contains(before, 'er')) AS relative FROM b),
g AS (SELECT *, CASE WHEN relative THEN 'family history of ' || label
                     WHEN spoken LIKE '% of the' THEN 'of the ' || label WHEN spoken LIKE '% to' THEN 'to ' || label
                     WHEN spoken LIKE '% and' THEN 'and ' || label END AS framed FROM f)
SELECT res_id, seq, start, n, coalesce(framed, label) AS text,
       CASE WHEN framed IS NOT NULL THEN 'MEDICAL_HISTORY' ELSE type END AS type FROM g""")
def history_retype(spark, sf):
    return ex.history_retype(mentions(spark, sf, context=4), ["to", "and", "of the"], ["that", "er"]).select(
        "res_id", "seq", "start", "n", "text", "type")


@query("bucket_assign", """
WITH labels AS (SELECT DISTINCT p_name || ' small' AS label FROM part WHERE p_type = 'SMALL' AND p_size < 10
                UNION SELECT p_name FROM part WHERE p_type = 'LARGE' AND p_size > 35),
m AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS text, p_name,
             split_part(p_name, ' ', 2) || ' ' || lower(p_type) AS tail FROM part)
SELECT p_partkey, text, CASE WHEN text IN (SELECT label FROM labels) THEN 'matched'
                             WHEN p_name IN (SELECT label FROM labels) THEN 'fine_grained' ELSE 'other' END AS bucket,
       CASE WHEN text NOT IN (SELECT label FROM labels) AND p_name IN (SELECT label FROM labels) THEN p_name END
       AS coarse_candidate FROM m""")
def bucket_assign(spark, sf):
    part = table(spark, sf, "part")
    labels = part.filter((F.col("p_type") == "SMALL") & (F.col("p_size") < 10)).select(
        F.concat("p_name", F.lit(" small")).alias("label")).union(
        part.filter((F.col("p_type") == "LARGE") & (F.col("p_size") > 35)).select("p_name"))
    found = part.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    return ex.bucket_assign(found, labels, 3)


# --- the whole deterministic layer -------------------------------------------------------

_ENRICH_TYPES = "SYMPTOM DIAGNOSIS TREATMENT PROCEDURE LOCATION MEDICAL_HISTORY LAB_RESULT".split()
_ENRICH_ENDS = [(o, e, side, DEMO_ALIASES.get(text, text), t, i)
                for _, o, s, st, d, dt, e in DEMO_RULES
                for side, text, types in (("s", s, st), ("t", d, dt)) for i, t in enumerate(types)]
ENRICH_LOW_VALUE = r"^(absent|no)\s+(travel|pets?)$|^by$"
ENRICH_SQL = f"""{CONV_NODES_SQL}, {PATTERN_SQL.replace(TURNS_SQL + ',', '', 1)},
kept AS (SELECT * FROM nodes WHERE NOT regexp_matches(text, '^(absent|no)\\s+(travel|pets?)$|^by$')),
grown AS (SELECT res_id, text, type, evidence, turn_id, {{'source': 0, 'at': ord}} AS ord FROM kept
          UNION ALL SELECT h.res_id, h.text, h.type, h.evidence, h.turn_id, {{'source': 1, 'at': h.rule}} FROM phits h
          LEFT JOIN kept k ON k.res_id = h.res_id AND k.text = h.text AND k.type = h.type WHERE k.id IS NULL),
grown2 AS (SELECT res_id, {canon_sql('text', DEMO_ALIASES)} AS text, type, evidence, turn_id, ord FROM grown
           QUALIFY row_number() OVER (PARTITION BY res_id, {canon_sql('text', DEMO_ALIASES)}, type ORDER BY ord) = 1),
final AS (SELECT *, row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type) AS rank FROM grown2),
fnodes AS (SELECT res_id, printf('N_%03d', rank) AS id, text, type, evidence, turn_id, rank AS ord FROM final),
ends AS {values_sql(_ENRICH_ENDS, ["rule", "edge_type", "side", "text", "type", "prio"])},
hits AS (SELECT n.res_id, n.id, n.evidence, n.turn_id, e.rule, e.edge_type, e.side
         FROM fnodes n JOIN ends e USING (text, type)
         QUALIFY row_number() OVER (PARTITION BY n.res_id, rule, side ORDER BY prio, n.ord) = 1),
fedges AS (SELECT s.res_id, s.id AS source_id, t.id AS target_id, s.edge_type AS type,
                  coalesce(nullif(s.evidence, ''), t.evidence) AS evidence, s.rule AS ord
           FROM hits s JOIN hits t ON s.res_id = t.res_id AND s.rule = t.rule AND s.side = 's' AND t.side = 't'
           WHERE s.id <> t.id
           QUALIFY row_number() OVER (PARTITION BY s.res_id, s.id, t.id, s.edge_type ORDER BY s.rule) = 1)"""


@query("enrich_graph", f"""
WITH {ENRICH_SQL}
SELECT res_id, 'node' AS kind, id AS a, text AS b, type, evidence FROM fnodes
UNION ALL SELECT res_id, 'edge', source_id, target_id, type, evidence FROM fedges""")
def enrich_graph_query(spark, sf):
    nodes = stored(conversation_nodes(spark, sf))
    # The graph starts with the edges one rule set finds; the others are added by the plan.
    given = infer_edges(nodes, DEMO_RULES, ["confirms"], DEMO_ALIASES)
    new_nodes, new_edges = enrich_graph(
        nodes, given, turns(spark, sf), DEMO_PATTERNS, DEMO_RULES, DEMO_ALIASES, ENRICH_LOW_VALUE, _ENRICH_TYPES, EDGE_TYPES)
    return new_nodes.select("res_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("text").alias("b"),
                            "type", "evidence").unionByName(
        new_edges.select("res_id", F.lit("edge").alias("kind"), F.col("source_id").alias("a"),
                         F.col("target_id").alias("b"), "type", "evidence"))
