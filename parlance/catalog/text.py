"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.catalog.base import (
    DEMO_ALIASES, EVENT_SQL, TURNS_SQL, canon_sql, event_items, parts_sql, query, strip_sql, table, transcripts,
    turns, words_sql, ws_sql,
)
from parlance.functions import text as tx
from parlance.functions.vectors import cosine
from parlance.operators.linking import alias_join
from parlance.runtime import rule_table, running_counts


@query("normalize_ws", f"SELECT doc_id, md5({ws_sql('text')}) AS norm_md5 FROM documents")
def normalize_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalize_ws(F.col("text"))).alias("norm_md5"))


@query("norm_key", f"SELECT p_partkey, lower({strip_sql(chr(39) + '  ' + chr(39) + ' || p_name')}) || '|' AS key FROM part")
def norm_key(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(tx.norm_key(F.concat(F.lit("  "), "p_name")), F.lit("|")).alias("key"))


@query("entry_text", """
SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'view' THEN NULL
       ELSE event_type END, ''), nullif(CASE WHEN value < 5 THEN '' ELSE props END, ''), '') AS text FROM events""")
def entry_text(spark, sf):
    label = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "view", None).otherwise(
        F.col("event_type"))
    text = F.when(F.col("value") < 5, "").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", tx.entry_text(label, text).alias("text"))


@query("canonicalize_text", f"""
WITH {EVENT_SQL}
SELECT event_id, {canon_sql('src', DEMO_ALIASES)} AS src, {canon_sql("'absent absent a ' || dst || ' ;'")} AS dst,
       {canon_sql("'Non ' || event_type", {"non-view": "blind"})} AS kind FROM ev""")
def canonicalize_text(spark, sf):
    kind = F.concat(F.lit("Non "), "event_type")
    nested = F.concat(F.lit("absent absent a "), "dst", F.lit(" ;"))
    return event_items(spark, sf).select(
        "event_id", tx.canonicalize_text(F.col("src"), DEMO_ALIASES).alias("src"),
        tx.canonicalize_text(nested).alias("dst"), tx.canonicalize_text(kind, {"non-view": "blind"}).alias("kind"))


# Every document is checked against the text of the document before it.
@query("evidence_supported", f"""
WITH d AS (SELECT doc_id, {ws_sql('text')} AS text FROM documents),
pairs AS (SELECT a.doc_id, a.text AS tr, b.text AS ev FROM d a JOIN d b ON a.doc_id = b.doc_id + 1),
toks AS (SELECT doc_id, unnest({words_sql('ev')}) AS t FROM pairs),
known AS (SELECT DISTINCT doc_id, unnest({words_sql('tr')}) AS t FROM pairs),
shares AS (SELECT x.doc_id, count(*) AS n, count(k.t) AS hits
           FROM toks x LEFT JOIN known k ON x.doc_id = k.doc_id AND x.t = k.t GROUP BY 1)
SELECT doc_id, CASE WHEN ev = '' THEN false WHEN contains(tr, ev) THEN true WHEN coalesce(n, 0) <= 3 THEN true
                    ELSE hits / n >= 0.6 END AS supported
FROM pairs LEFT JOIN shares USING (doc_id)""")
def evidence_supported(spark, sf):
    docs = table(spark, sf, "documents")
    quotes = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("evidence"))
    return docs.select("doc_id", "text").join(quotes, "doc_id").select(
        "doc_id", tx.evidence_supported(F.col("evidence"), F.col("text")).alias("supported"))


# The quote of a turn is its first line with punctuation around it; the
# turn it is looked up in is the same turn or, for patients, the next one of the patient.
@query("quote_in_turn", f"""
WITH {TURNS_SQL},
q AS (SELECT res_id, turn_id, speaker, n, '"' || split_part(text, chr(10), 1) || '!? ' AS quote FROM turns),
j AS (SELECT q.res_id, q.turn_id, quote, t.text FROM q JOIN turns t ON q.res_id = t.res_id AND q.speaker = t.speaker
      AND t.n = CASE WHEN q.speaker = 'P' THEN q.n + 1 ELSE q.n END)
SELECT res_id, turn_id, contains(regexp_replace(lower(text), '\\s+', ' ', 'g'),
       regexp_replace(trim({strip_sql('lower(quote)')}, '.,!?"'''), '\\s+', ' ', 'g')) AS found FROM j""")
def quote_in_turn(spark, sf):
    t = turns(spark, sf)
    quote = F.concat(F.lit('"'), F.substring_index("text", "\n", 1), F.lit("!? "))
    n = F.when(F.col("speaker") == "P", F.col("n") + 1).otherwise(F.col("n"))
    q = t.select("res_id", "speaker", F.col("turn_id").alias("quoted"), quote.alias("quote"), n.alias("n"))
    return q.join(t.select("res_id", "speaker", "n", "text"), ["res_id", "speaker", "n"]).select(
        "res_id", F.col("quoted").alias("turn_id"), tx.quote_in_turn(F.col("quote"), F.col("text")).alias("found"))


FIND_REGEX = r"(?:of|in) that\W{1,3}\w{2,6} (?:the|and)"
FIND_TERMS = ["whble", "thwas", "edan"]


def _find_sql(compat: bool, bracketed: bool = True) -> str:
    rx = r"(?i)(?:of|in) that\W{1,3}\w{2,6} (?:the|and)"
    if compat:
        at = {t: f"strpos(lower(text), '{t}')" for t in FIND_TERMS}
    else:
        at = {t: (f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){t}($|[^\\p{{L}}\\p{{N}}_])') THEN "
                  f"length(regexp_extract(lower(text), '(?s)^(.*?(?:^|[^\\p{{L}}\\p{{N}}_])){t}(?:$|[^\\p{{L}}\\p{{N}}_])', 1))"
                  f" + 1 ELSE 0 END") for t in FIND_TERMS}
    term = "CASE " + " ".join(f"WHEN {p} > 0 THEN '{t}'" for t, p in at.items()) + " END"
    term_at = "CASE " + " ".join(f"WHEN {p} > 0 THEN {p}" for p in at.values()) + " END"
    marker = r"\[([DP]-\d+)\]"
    if compat:
        def turn(start, size, width):
            return (f"regexp_extract(substr(text, greatest({start} - {width}, 1), {start} + {size} + {width} - "
                    f"greatest({start} - {width}, 1)), '{marker}', 1)")
    else:
        def turn(start, size, width):
            last = f"(?s)^.*{marker}" if bracketed else r"(?s)^(?:.*\n)?([DP]-\d+):"
            return f"regexp_extract(substr(text, 1, {start}), '{last}', 1)"
    return f"""
hits AS (SELECT *, regexp_extract(text, '{rx}') AS m,
                length(regexp_extract(text, '(?s)^(.*?)(?:{rx})', 1)) + 1 AS m_at, {term} AS term, {term_at} AS term_at
         FROM parts),
found AS (SELECT res_id, CASE WHEN m <> '' THEN trim(regexp_replace(m, '\\s+', ' ', 'g')) ELSE term END AS evidence,
                 CASE WHEN m <> '' THEN {turn('m_at', 'length(m)', 70)}
                      ELSE {turn('term_at', 'length(term)', 60)} END AS turn_id,
                 CASE WHEN m <> '' THEN 'pattern' ELSE 'fallback' END AS via
          FROM hits WHERE m <> '' OR term IS NOT NULL)"""


def _find(spark, sf, compat, bracketed=True):
    hit = tx.find_evidence(
        F.col("text"), F.lit(FIND_REGEX), F.array(*[F.lit(t) for t in FIND_TERMS]), compat=compat)
    return transcripts(spark, sf, bracketed).select("res_id", hit.alias("h")).filter(
        F.col("h").isNotNull()).select("res_id", "h.*")


@query("find_evidence", f"WITH {parts_sql()}, {_find_sql(False)} SELECT * FROM found")
def find_evidence(spark, sf):
    return _find(spark, sf, False)


@query("find_evidence_plain", f"WITH {parts_sql(False)}, {_find_sql(False, False)} SELECT * FROM found")
def find_evidence_plain(spark, sf):
    return _find(spark, sf, False, False)


@query("find_evidence_compat", f"WITH {parts_sql()}, {_find_sql(True)} SELECT * FROM found")
def find_evidence_compat(spark, sf):
    return _find(spark, sf, True)


@query("seq_id", """
SELECT event_id, printf('N_%03d', row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS id FROM events""")
def seq_id(spark, sf):
    ranked = running_counts(
        table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], "event_id", {"rank": None})
    return ranked.select("event_id", tx.seq_id(F.col("rank")).alias("id"))


@query("truncate_quote", """
SELECT doc_id, substr(text, 1, 300) AS edge_quote, substr(text, 1, 80) AS listing_quote FROM documents""")
def truncate_quote(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.truncate_quote(text).alias("edge_quote"), tx.truncate_quote(text, 80).alias("listing_quote"))


# Each vector against the one before it.
@query("cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1""")
def cosine_query(spark, sf):
    vecs = table(spark, sf, "embeddings")
    prior = vecs.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("prior"))
    return vecs.join(prior, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("prior")), 6).alias("cosine"))


STATUS_SQL = """CASE CAST(floor(value) AS BIGINT) % 7 WHEN 0 THEN 200 WHEN 1 THEN 408 WHEN 2 THEN 429
                WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 401 END"""


def status_column():
    n = F.floor("value") % 7
    return (F.when(n == 0, 200).when(n == 1, 408).when(n == 2, 429).when(n == 3, 503)
            .when(n == 4, 404).when(n == 5, 401))


@query("error_class", f"""
SELECT event_id, CASE WHEN s = 429 THEN '429' WHEN s BETWEEN 500 AND 599 THEN '5xx'
                      WHEN s IS NULL AND event_type = 'error' THEN 'network'
                      WHEN s IS NULL OR s = 408 THEN 'retriable_other' ELSE 'nonretriable' END AS kind,
       coalesce(s IN (408, 429) OR s BETWEEN 500 AND 599, true) AS retriable
FROM (SELECT *, {STATUS_SQL} AS s FROM events)""")
def error_class(spark, sf):
    status = status_column()
    network = status.isNull() & (F.col("event_type") == "error")
    return table(spark, sf, "events").select(
        "event_id", tx.error_class(status, network).alias("kind"), tx.retriable(status).alias("retriable"))


@query("round4", "SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS r FROM embeddings")
def round4(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", tx.round4(F.element_at("embedding", 1).cast("double")).alias("r"))


PART_ALIASES = [("red plate", "scarlet dish"), ("small widget", "tiny part"), ("hot ring", "hot ring")]


@query("alias_join", """
SELECT p_partkey, CASE p_name WHEN 'red plate' THEN 'scarlet dish' WHEN 'small widget' THEN 'tiny part'
                  ELSE p_name END AS text FROM part""")
def alias_join_query(spark, sf):
    aliases = rule_table(spark, PART_ALIASES, ["text", "canonical"])
    return alias_join(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("text")), aliases)


QUALIFIERS = ["red", "blue", "small", "hot", "old"]


@query("first_qualifier", """
SELECT p_partkey, regexp_extract(lower(p_name || ' or ' || p_type), '\\b(red|blue|small|hot|old)\\b', 1) AS qualifier
FROM part""")
def first_qualifier(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.first_qualifier(
        F.concat_ws(" or ", "p_name", "p_type"), QUALIFIERS).alias("qualifier"))
