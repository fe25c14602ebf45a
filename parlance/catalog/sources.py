"""Queries over sources, segmentation and parsing."""

from __future__ import annotations

import re
import uuid

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from parlance.catalog.base import (
    CONV_NODES_SQL, EVENT_SQL, TURNS_SQL, conversation_nodes, demo_vocab, event_edges,
    event_items, event_nodes, parts_sql, query, strip_sql, table, transcripts, turns,
)
from parlance.functions import text as tx
from parlance.operators import responses as rs
from parlance.operators import turns as tn
from parlance.runtime import checkpoint_dir
from parlance.schema import BUCKET_ITEM
from parlance.sources import kgdocs, vocab
from parlance.sources import transcripts as src
from pyspark.sql import types as T

EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]


def _written(files, kind: str) -> str:
    """Files (path, text) under a new folder of the shared one, written by the tasks; returns the folder."""
    root = f"{checkpoint_dir(files.sparkSession)}/{kind}-{uuid.uuid4().hex}"

    def write(rows) -> None:
        fs, base = pafs.FileSystem.from_uri(re.sub("^file:/+", "/", root))
        for row in rows:
            fs.create_dir(f"{base}/{row['path']}".rpartition("/")[0])
            with fs.open_output_stream(f"{base}/{row['path']}") as out:
                out.write(row["text"].encode())

    files.select("path", "text").foreachPartition(write)
    return root


@query("scan_transcripts", f"""
WITH {parts_sql()} SELECT 'RES' || res_id AS res_id, text FROM parts""")
def scan_transcripts(spark, sf):
    """Every conversation as a file of its own, read by the operator; a note beside it is not a transcript."""
    name = F.concat(F.lit("RES"), F.col("res_id").cast("string"))
    files = transcripts(spark, sf).select(F.concat_ws("/", name, name).alias("stem"), "text").select(
        F.explode(F.array(F.struct(F.concat("stem", F.lit(".txt")).alias("path"), "text"),
                          F.struct(F.concat("stem", F.lit("_note.txt")).alias("path"), F.lit("a note").alias("text")))).alias("f"))
    return src.scan_transcripts(spark, _written(files.select("f.*"), "transcripts"))


@query("subset_filter", """
SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')""")
def subset_filter(spark, sf):
    return src.subset_filter(
        table(spark, sf, "events").select("event_id", "event_type"), "event_id",
        category_col="event_type", categories=["click", "purchase"], known=EVENT_TYPES)


# Events as documents: each holds its two items and the edge between them.
def _event_docs(spark, sf):
    def node(text, tag, event_id):
        return F.struct(F.concat(F.lit(tag), event_id).alias("id"), F.col(text).alias("text"),
                        F.upper("event_type").alias("type"))
    event_id = F.col("event_id").cast("string")
    doc = F.to_json(F.struct(
        F.array(node("src", "S", event_id), node("dst", "T", event_id)).alias("nodes"),
        F.array(F.struct(F.concat(F.lit("S"), event_id).alias("source_id"),
                         F.concat(F.lit("T"), event_id).alias("target_id"),
                         F.col("relation").alias("type"))).alias("edges")))
    schema = kgdocs.KG_DOC
    return event_items(spark, sf).select(
        event_id.alias("res_id"), F.from_json(doc, schema).alias("d")).select(
        "res_id", "d.nodes", "d.edges")


@query("explode_kg", f"""
WITH {EVENT_SQL}
SELECT CAST(event_id AS VARCHAR) AS res_id, 'node' AS kind, 0 AS ord, 'S' || event_id AS a, src AS b,
       upper(event_type) AS type FROM ev
UNION ALL SELECT CAST(event_id AS VARCHAR), 'node', 1, 'T' || event_id, dst, upper(event_type) FROM ev
UNION ALL SELECT CAST(event_id AS VARCHAR), 'edge', 0, 'S' || event_id, 'T' || event_id, relation FROM ev""")
def explode_kg(spark, sf):
    nodes, edges = kgdocs.explode_kg(_event_docs(spark, sf))
    return nodes.select("res_id", F.lit("node").alias("kind"), "ord", F.col("id").alias("a"),
                        F.col("text").alias("b"), "type").unionByName(
        edges.select("res_id", F.lit("edge").alias("kind"), "ord", F.col("source_id").alias("a"),
                     F.col("target_id").alias("b"), "type"))


def _part_vocab(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_type").alias("entity_type"), F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("label"),
        F.col("p_partkey").alias("ord"))


@query("load_vocab_by_type", """
SELECT upper(p_type) AS entity_type, trim(p_name) AS label, min(p_partkey) AS ord FROM part GROUP BY 1, 2""")
def load_vocab_by_type(spark, sf):
    return vocab.load_vocab_by_type(_part_vocab(spark, sf))


@query("load_vocab_by_type_sorted", """
SELECT DISTINCT upper(p_type) AS entity_type, trim(p_name) AS label FROM part
WHERE upper(p_type) IN ('SMALL', 'LARGE', 'PROMO')""")
def load_vocab_by_type_sorted(spark, sf):
    return vocab.load_vocab_by_type(_part_vocab(spark, sf), "sorted", ["SMALL", "LARGE", "PROMO"])


@query("merge_vocab", """
WITH v AS (SELECT 0 AS rank, p_type AS entity_type, p_name AS label, p_partkey AS ord, 'part' AS source FROM part
           UNION ALL SELECT 1, p_type, upper(p_name), p_partkey, 'brand' FROM part WHERE p_brand = 'Brand#1'
           UNION ALL SELECT 1, 'SUPPLIER', s_name, s_suppkey, 'brand' FROM supplier)
SELECT entity_type, label, ord, source FROM v
QUALIFY row_number() OVER (PARTITION BY lower(label), entity_type ORDER BY rank, ord) = 1""")
def merge_vocab(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_type").alias("entity_type"), F.col("p_name").alias("label"), F.col("p_partkey").alias("ord"),
        "p_brand")
    first = part.drop("p_brand").withColumn("source", F.lit("part"))
    second = part.filter(F.col("p_brand") == "Brand#1").drop("p_brand").withColumn(
        "label", F.upper("label")).unionByName(
        table(spark, sf, "supplier").select(F.lit("SUPPLIER").alias("entity_type"), F.col("s_name").alias("label"),
                                            F.col("s_suppkey").alias("ord"))).withColumn("source", F.lit("brand"))
    return vocab.merge_vocab(first, second)


@query("union_splits_last_wins", """
WITH s AS (SELECT year(o_orderdate) AS rank, o_custkey, o_orderkey, o_totalprice FROM orders),
latest AS (SELECT o_custkey, max(rank) AS rank FROM s GROUP BY 1)
SELECT o_custkey, s.rank AS split_year, min(o_orderkey) AS o_orderkey
FROM s JOIN latest USING (o_custkey, rank) GROUP BY 1, 2""")
def union_splits_last_wins(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("split_year"), "o_orderkey")
    # Inside a split ids are unique, as encounter ids are.
    unique = orders.groupBy("o_custkey", "split_year").agg(F.min("o_orderkey").alias("o_orderkey"))
    return src.last_split_wins(unique, "o_custkey", "split_year")


@query("missing_wanted", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def missing_wanted(spark, sf):
    return src.missing_keys(
        table(spark, sf, "customer"), table(spark, sf, "events").withColumnRenamed("user_id", "c_custkey"),
        "c_custkey")


@query("missing_inputs", """
WITH cells AS (SELECT DISTINCT user_id, c.cat || '-' || h.hour AS category FROM events,
               (VALUES ('click'), ('view'), ('error')) c(cat), (SELECT unnest(range(0, 24)) AS hour) h)
SELECT user_id, category FROM cells
EXCEPT SELECT user_id, event_type || '-' || hour(ts) FROM events""")
def missing_inputs(spark, sf):
    actual = table(spark, sf, "events").select(
        "user_id", F.concat_ws("-", "event_type", F.hour("ts").cast("string")).alias("category"))
    expected = [f"{t}-{h}" for t in ("click", "view", "error") for h in range(24)]
    return src.missing_inputs(actual, actual, "user_id", expected, "category")


@query("incremental_skip", """
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
                        THEN 'SKIP' ELSE 'TODO' END AS status FROM orders""")
def incremental_skip(spark, sf):
    done = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return src.incremental_skip(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("reuse_prior_stage", """
WITH prior AS (SELECT user_id, event_type, count(*) AS n_nodes FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT c_custkey AS user_id, n_nodes, CASE WHEN n_nodes IS NULL THEN 'REUSE_FAIL' ELSE 'OK' END AS status
FROM customer LEFT JOIN prior ON c_custkey = user_id""")
def reuse_prior_stage(spark, sf):
    prior = table(spark, sf, "events").filter(F.col("event_type") == "signup").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_nodes"))
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return src.reuse_prior_stage(ids, prior, "user_id")


@query("latest_run", """
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS run FROM orders
WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)""")
def latest_run(spark, sf):
    runs = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("run"))
    return src.latest_run(runs, "run")


@query("sanitize_id", """
SELECT p_partkey, replace(replace(p_name, ' ', '_'), '_', '') AS clean,
       split_part(replace(replace(p_name, ' ', '_'), '_', '') || '_v7', '_', 1) AS round_trip,
       split_part(replace(p_name, ' ', '_') || '_v7', '_', 1) AS lossy FROM part""")
def sanitize_id(spark, sf):
    raw = F.replace("p_name", F.lit(" "), F.lit("_"))
    clean = tx.sanitize_id(raw)
    return table(spark, sf, "part").select(
        "p_partkey", clean.alias("clean"), tx.id_from_stem(F.concat(clean, F.lit("_v7"))).alias("round_trip"),
        tx.id_from_stem(F.concat(raw, F.lit("_v7"))).alias("lossy"))


@query("transcript_meta", f"""
WITH {TURNS_SQL},
m AS (SELECT res_id, count(*) FILTER (speaker = 'D') AS doctor_turns, count(*) FILTER (speaker = 'P') AS patient_turns,
             sum(length(turn_id || ': ' || text)) + count(*) - 1 AS transcript_chars FROM turns GROUP BY 1),
s AS (SELECT conv_id AS res_id, sum(length(text)) AS note_chars FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT res_id, doctor_turns, patient_turns, CAST(transcript_chars AS BIGINT) AS transcript_chars,
       CAST(coalesce(note_chars, 0) AS BIGINT) AS note_chars FROM m LEFT JOIN s USING (res_id)""")
def transcript_meta(spark, sf):
    notes = table(spark, sf, "conversations").filter(F.col("role") == "system").select(
        F.col("conv_id").alias("res_id"), "text")
    return src.transcript_meta(turns(spark, sf), notes)


@query("segment_marked_turns", f"""
WITH {parts_sql()}
SELECT res_id, turn_id, speaker, text FROM turns""")
def segment_marked_turns(spark, sf):
    return tn.segment_marked_turns(transcripts(spark, sf)).select(
        "res_id", "turn_id", "speaker", "text")


@query("segment_plain_turns", f"""
WITH {parts_sql(False)}
SELECT res_id, turn_id, speaker, text FROM turns""")
def segment_plain_turns(spark, sf):
    return tn.segment_marked_turns(transcripts(spark, sf, bracketed=False)).select(
        "res_id", "turn_id", "speaker", "text")


@query("dialogue_to_turns", f"WITH {TURNS_SQL} SELECT res_id, pos, seq, turn_id, speaker, n, text FROM turns")
def dialogue_to_turns(spark, sf):
    return turns(spark, sf)


@query("split_dialogue", f"""
SELECT doc_id AS res_id, i - 1 AS pos, CASE WHEN i % 2 = 1 THEN 'doctor' ELSE 'patient' END AS role,
       {strip_sql('line')} AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def split_dialogue(spark, sf):
    """Every line of a document as the next utterance of a two-party dialogue string."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        F.when(i % 2 == 0, "[doctor] ").otherwise("[patient] "), line, F.lit("\n")))
    dialogues = table(spark, sf, "documents").select(
        F.col("doc_id").alias("res_id"), F.array_join(lines, "").alias("dialogue"))
    return tn.split_dialogue(dialogues, ["doctor", "patient", "dragon"]).withColumn(
        "text", tx.strip_ws(F.col("text")))


@query("count_turns", f"""
WITH {parts_sql()}
SELECT res_id, len(regexp_extract_all(text, '\\[[DP]-\\d+\\]')) AS n_turns FROM parts""")
def count_turns(spark, sf):
    return transcripts(spark, sf).select("res_id", tx.count_turns(F.col("text")).alias("n_turns"))


@query("render_transcript", f"WITH {parts_sql(False)} SELECT res_id, text FROM parts")
def render_transcript(spark, sf):
    return transcripts(spark, sf, bracketed=False)


TEMPLATES = [
    (t, "entity", f"Find {t}.\n{{labels}}\n---\n{{transcript}}")
    for t in ("SYMPTOM", "DIAGNOSIS", "TREATMENT", "PROCEDURE", "LOCATION", "MEDICAL_HISTORY", "LAB_RESULT")
] + [
    (t, "edge", f"Relate {t}.\n{{entities}}\n---\n{{transcript}}")
    for t in ("INDICATES", "CAUSES", "LOCATED_AT", "RULES_OUT", "TAKEN_FOR", "CONFIRMS")
]


@query("prompt_fanout", f"""
WITH {CONV_NODES_SQL},
parts AS (SELECT res_id, string_agg('[' || turn_id || '] ' || speaker || ': ' || text, chr(10) ORDER BY seq) AS text
          FROM turns GROUP BY 1),
lists AS (SELECT res_id, string_agg('  ' || ord || '. "' || text || '" (' || type || ', turn ' || turn_id || ')',
                                    chr(10) ORDER BY ord) AS entities FROM nodes GROUP BY 1),
bullets AS (SELECT type AS category, string_agg('- ' || label, chr(10) ORDER BY label) AS labels
            FROM (SELECT DISTINCT type, label FROM vocab) GROUP BY 1),
prompts AS (
  SELECT res_id, b.category, 'Find ' || b.category || '.' || chr(10) || labels || chr(10) || '---' || chr(10)
         || text AS prompt FROM parts, bullets b
  UNION ALL
  SELECT res_id, c.category, 'Relate ' || c.category || '.' || chr(10) || coalesce(entities, '(none)') || chr(10)
         || '---' || chr(10) || text
  FROM parts LEFT JOIN lists USING (res_id),
       (VALUES ('INDICATES'), ('CAUSES'), ('LOCATED_AT'), ('RULES_OUT'), ('TAKEN_FOR'), ('CONFIRMS')) c(category))
SELECT res_id, category, length(prompt) AS chars, md5(prompt) AS prompt_md5 FROM prompts""")
def prompt_fanout(spark, sf):
    return src.prompt_fanout(
        transcripts(spark, sf), TEMPLATES, demo_vocab(spark), conversation_nodes(spark, sf)
    ).select("res_id", "category", F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt_md5"))


# Answers of an imagined model: the event's JSON, wrapped in five kinds of noise.
def _answers(spark, sf):
    body, n = F.col("props"), F.col("event_id") % 6
    noisy = (F.when(n == 0, body)
             .when(n == 1, F.concat(F.lit("<think>{not this}</think>\n"), body))
             .when(n == 2, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
             .when(n == 3, F.concat(F.lit("Here it is "), F.replace(body, F.lit("}"), F.lit(", }")), F.lit(" ok")))
             .when(n == 4, F.concat(F.lit("I could not "), F.substring(body, 1, 4)))
             .otherwise(F.lit("")))
    return table(spark, sf, "events").select("event_id", "event_type", noisy.alias("content"))


ANSWERS_SQL = """
answers AS (SELECT event_id, event_type, CASE event_id % 6
    WHEN 0 THEN props WHEN 1 THEN '<think>{not this}</think>' || chr(10) || props
    WHEN 2 THEN 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 3 THEN 'Here it is ' || replace(props, '}', ', }') || ' ok'
    WHEN 4 THEN 'I could not ' || substr(props, 1, 4) ELSE '' END AS content FROM events),
c1 AS (SELECT *, trim(regexp_replace(content, '(?is)<think>.*?</think>', '', 'g'), E' \\n\\r\\t') AS whole FROM answers),
c2 AS (SELECT *, trim(regexp_extract(whole, '(?s)```(?:json)?\\s*(.*?)```', 1), E' \\n\\r\\t') AS fenced,
              regexp_replace(regexp_extract(whole, '(?s)(\\{.*\\}|\\[.*\\])', 1), ',\\s*([}\\]])', '\\1', 'g') AS outermost
       FROM c1),
parsed AS (SELECT *, CASE WHEN whole <> '' AND json_valid(whole) THEN 'whole'
                          WHEN fenced <> '' AND json_valid(fenced) THEN 'fenced'
                          WHEN outermost <> '' AND json_valid(outermost) THEN 'outer' END AS strategy FROM c2),
found AS (SELECT *, CASE strategy WHEN 'whole' THEN whole WHEN 'fenced' THEN fenced WHEN 'outer' THEN outermost END
          AS json FROM parsed)"""


@query("parse_noisy_json", f"""
WITH {ANSWERS_SQL}
SELECT event_id, strategy, CAST(json_extract(json, '$.k') AS BIGINT) AS k FROM found""")
def parse_noisy_json(spark, sf):
    schema = T.StructType([T.StructField("k", T.LongType())])
    return rs.parse_noisy_json(_answers(spark, sf), schema).select("event_id", "strategy", "parsed.k")


@query("parse_noisy_json_largest", """
SELECT event_id, CASE WHEN event_id % 6 < 4 OR event_id % 12 = 5 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       event_id % 12 = 5 AS is_array FROM events""")
def parse_noisy_json_largest(spark, sf):
    """All noise, and a fenced array of two objects where the cascade's answers are empty."""
    props = table(spark, sf, "events").select(F.col("event_id").alias("_id"), "props")
    array = F.concat(F.lit("So:\n```json\n[{\"a\": 1}, "), F.col("props"), F.lit("]\n```"))
    answers = _answers(spark, sf).join(props, F.col("event_id") == F.col("_id")).withColumn(
        "content", F.when(F.col("event_id") % 12 == 5, array).otherwise(F.col("content")))
    found = rs.parse_noisy_json(answers, mode="largest")
    return found.select(
        "event_id", F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$[1].k")).cast("bigint").alias("k"),
        F.coalesce(F.col("json").startswith("["), F.lit(False)).alias("is_array"))


@query("parse_status", f"""
WITH {ANSWERS_SQL}
SELECT event_id, CASE WHEN content = '' THEN 'LLM_FAIL' WHEN json IS NULL THEN 'PARSE_FAIL' ELSE 'OK' END AS status,
       CASE WHEN content = '' THEN 'LLM_FAIL' WHEN json IS NULL OR event_id % 5 > 0 THEN 'PARSE_FAIL' ELSE 'OK' END AS edge_status
FROM found""")
def parse_status(spark, sf):
    """Every fifth answer holds a bucket, as an edge answer must."""
    found = rs.parse_noisy_json(_answers(spark, sf)).withColumn("json", F.when(
        F.col("event_id") % 5 == 0, F.concat(F.lit('{"matched": ['), F.col("json"), F.lit("]}"))).otherwise(F.col("json")))
    return found.select(
        "event_id", rs.parse_status(F.col("content"), F.col("json")).alias("status"),
        rs.parse_status(F.col("content"), F.col("json"), F.lit(True)).alias("edge_status"))


def event_results(spark, sf):
    """Each event as one category answer: its source item in a bucket chosen by k, its target in "other"."""
    item = BUCKET_ITEM
    def entry(label, text):
        return F.struct(
            (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
            (F.col(text) if text else F.lit("")).alias("text"), F.col("src"), F.col("dst"),
            F.lit(None).cast("string").alias("turn_id"),
            F.concat(F.lit("value "), F.col("v").cast("string")).alias("quote"))
    empty = F.array().cast(T.ArrayType(item))
    k = F.col("k")
    status = F.when(k % 10 == 0, "PARSE_FAIL").otherwise("OK")
    return event_items(spark, sf).select(
        "res_id", F.upper("event_type").alias("category"), F.col("event_id").alias("ord"), status.alias("status"),
        F.when(k < 40, F.array(entry("src", None))).otherwise(empty).alias("matched"),
        F.when((k >= 40) & (k < 70), F.array(entry(None, "src"), entry(None, "dst")))
        .otherwise(F.array(entry(None, "dst"))).alias("other"),
        F.when(k >= 70, F.array(entry(None, "src"))).otherwise(empty).alias("fine_grained"))


ITEMS_SQL = f"""{EVENT_SQL},
items AS (
  SELECT res_id, upper(event_type) AS category, event_id, 0 AS bucket_rank, 'matched' AS bucket, 0 AS item_pos,
         src AS text, src, dst, v, k FROM ev WHERE k < 40
  UNION ALL SELECT res_id, upper(event_type), event_id, 1, 'other', 0, src, src, dst, v, k FROM ev WHERE k BETWEEN 40 AND 69
  UNION ALL SELECT res_id, upper(event_type), event_id, 1, 'other', CASE WHEN k BETWEEN 40 AND 69 THEN 1 ELSE 0 END,
         dst, src, dst, v, k FROM ev
  UNION ALL SELECT res_id, upper(event_type), event_id, 2, 'fine_grained', 0, src, src, dst, v, k FROM ev WHERE k >= 70)"""
FLAT_CATEGORIES = ["SIGNUP", "VIEW", "CLICK", "PURCHASE"]


@query("flatten_buckets", f"""
WITH {ITEMS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY res_id ORDER BY
             list_position(['SIGNUP', 'VIEW', 'CLICK', 'PURCHASE'], category), event_id, bucket_rank, item_pos) AS rank
      FROM items WHERE k % 10 <> 0 AND category <> 'ERROR')
SELECT res_id, printf('N_%03d', rank) AS id, text, category AS type, 'value ' || v AS evidence, bucket, rank AS ord
FROM f""")
def flatten_buckets(spark, sf):
    return rs.flatten_buckets(event_results(spark, sf), FLAT_CATEGORIES).drop("turn_id")


@query("read_category_results", f"""
WITH {ITEMS_SQL}
SELECT 'R_' || res_id AS res_id, category, bucket, CASE WHEN bucket = 'matched' THEN text END AS label,
       CASE WHEN bucket = 'matched' THEN '' ELSE text END AS text, src, dst, 'value ' || v AS quote FROM items""")
def read_category_results(spark, sf):
    """Every answer as a line of its transcript and category, read by the operator."""
    lines = event_results(spark, sf).select(F.concat(F.lit("R_"), F.col("res_id").cast("string")).alias("res_id"), "category",
                                            "matched", "other", "fine_grained")
    root = f"{checkpoint_dir(spark)}/answers-{uuid.uuid4().hex}"
    lines.write.json(root)
    return rs.bucket_items(kgdocs.read_category_results(spark, root, lines=True), ["res_id", "category"]).select(
        "res_id", "category", "bucket", "label", "text", "src", "dst", "quote")


@query("review_listing", f"""
WITH {ITEMS_SQL}
SELECT event_id AS ord, category, bucket, item_pos, text AS label, src || ' → ' || dst AS edge_label,
       '?' AS turn_id, substr('value ' || v, 1, 7) AS quote FROM items""")
def review_listing(spark, sf):
    items = rs.bucket_items(event_results(spark, sf), ["category", "ord"]).withColumn("_label", F.col("label"))
    edges = rs.review_listing(items, is_edge=True).withColumnRenamed("label", "edge_label").withColumn("label", F.col("_label"))
    return rs.review_listing(edges, width=7).select(
        "ord", "category", "bucket", "item_pos", "label", "edge_label", "turn_id", "quote")


@query("edge_passthrough", f"""
WITH {ITEMS_SQL}
SELECT event_id AS ord, category AS type, bucket, item_pos, src, dst, 'value ' || v AS quote FROM items WHERE src <> dst""")
def edge_passthrough(spark, sf):
    return rs.edge_passthrough(rs.bucket_items(event_results(spark, sf), ["category", "ord"])).select(
        "ord", "type", "bucket", "item_pos", "src", "dst", "quote")


@query("bucket_counts", f"""
WITH {ITEMS_SQL}
SELECT category, count(*) FILTER (bucket = 'matched') AS matched, count(*) FILTER (bucket = 'other') AS other,
       count(*) FILTER (bucket = 'fine_grained') AS fine_grained FROM items GROUP BY 1""")
def bucket_counts(spark, sf):
    return rs.bucket_counts(rs.bucket_items(event_results(spark, sf), ["category", "ord"]))


@query("write_kg", f"""
WITH {EVENT_SQL}
SELECT 'R_' || res_id AS res_id, 'node' AS kind, id AS a, text AS b, type, evidence FROM raw_nodes
UNION ALL SELECT 'R_' || res_id, 'edge', source_id, target_id, type, evidence FROM raw_edges""")
def write_kg(spark, sf):
    """Graphs written as documents, one per user, and read back."""
    named = lambda df: df.withColumn("res_id", F.concat(F.lit("R_"), F.col("res_id").cast("string")))
    root = f"{checkpoint_dir(spark)}/graphs-{uuid.uuid4().hex}"
    kgdocs.write_kg(named(event_nodes(spark, sf)), named(event_edges(spark, sf)), root)
    nodes, edges = kgdocs.explode_kg(kgdocs.read_kg(spark, root))
    return nodes.select("res_id", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("text").alias("b"), "type",
                        "evidence").unionByName(
        edges.select("res_id", F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"),
                     "type", "evidence"))
