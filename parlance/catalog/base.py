"""Registry of the queries, and how they read the shared tables.

The clinical rule tables do not meet the invented prose of those tables, so the queries
bind the operators to small demo tables of words that do occur. Both the Spark side and the
SQL side are generated from the same constants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.extract import lexicon_extract
from parlance.operators.identity import merge_nodes
from parlance.operators.turns import dialogue_to_turns, render_transcript
from parlance.functions.text import word_tokens
from parlance.runtime import TASK_ROWS, dealt, rule_table, spread_small

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# Tables whose queries do heavy work per row.
TEXT_TABLES = {"documents", "conversations", "pages", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def values_sql(rows: list[tuple], names: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


# --- conversations as transcripts -------------------------------------------------------

ROLES = {"user": "P", "assistant": "D"}
MAX_N = 3
DEMO_VOCAB = [
    ("the", "SYMPTOM"), ("and", "SYMPTOM"), ("of", "DIAGNOSIS"), ("to", "DIAGNOSIS"),
    ("in", "TREATMENT"), ("that", "TREATMENT"), ("is", "PROCEDURE"), ("was", "PROCEDURE"),
    ("with", "LOCATION"), ("from", "LOCATION"), ("this", "MEDICAL_HISTORY"), ("by", "MEDICAL_HISTORY"),
    ("be", "LAB_RESULT"), ("are", "LAB_RESULT"), ("of the", "SYMPTOM"), ("and the", "DIAGNOSIS"),
    ("to the", "PROCEDURE"), ("the and", "TREATMENT"), ("of the and", "SYMPTOM"),
    ("que", "SYMPTOM"), ("de", "TREATMENT"), ("und", "DIAGNOSIS"), ("der", "LOCATION"), ("la", "LOCATION"),
]
DEMO_ALIASES = {"and": "plus", "of the": "the", "que": "that", "und": "plus", "item 1": "item one", "item 2": "item one"}


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("res_id"), F.col("turn").alias("pos"), "role", "text")
    return dialogue_to_turns(talk, ROLES)


def transcripts(spark: SparkSession, sf_dir: str, bracketed: bool = True) -> DataFrame:
    return render_transcript(turns(spark, sf_dir), bracketed)


def demo_vocab(spark: SparkSession) -> DataFrame:
    return rule_table(spark, DEMO_VOCAB, ["label", "entity_type"])


def mentions(spark: SparkSession, sf_dir: str, context: int = 0) -> DataFrame:
    return lexicon_extract(
        turns(spark, sf_dir), demo_vocab(spark), ["res_id", "seq", "turn_id", "speaker"], MAX_N, context)


def mention_ord():
    """The place of a mention: its turn, its first word, its length."""
    return F.struct("seq", "start", "n")


def raw_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select(
        "res_id", F.col("label").alias("text"), "type", F.col("quote").alias("evidence"), "turn_id",
        mention_ord().alias("ord"))


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_nodes(raw_mentions(spark, sf_dir), DEMO_ALIASES)


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def ws_sql(e: str) -> str:
    return rf"trim(regexp_replace(lower({e}), '\s+', ' ', 'g'))"


def words_sql(e: str) -> str:
    return rf"regexp_extract_all({e}, '[\p{{L}}\p{{N}}_]+')"


def canon_sql(e: str, aliases: dict[str, str] | None = None) -> str:
    plain = f"trim(regexp_replace({ws_sql(e)}, '^(the|a|an) +', ''), ' .,:;')"
    head = f"regexp_extract({plain}, '^(absent ((the|a|an) )?[ .,:;]*)*')"
    leaf = f"substr({plain}, length({head}) + 1)"
    dashed = f"CASE WHEN {leaf} LIKE 'non %' THEN 'non-' || substr({leaf}, 5) ELSE {leaf} END"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (aliases or {}).items())
    known = f"CASE {dashed} {cases} ELSE {dashed} END" if cases else dashed
    depth = f"len(regexp_extract_all({head}, 'absent '))"
    return (f"CASE WHEN {leaf} = '' THEN '' ELSE repeat('absent ', {depth}) || "
            f"CASE WHEN {leaf} LIKE 'no %' THEN {leaf} ELSE {known} END END")


TURNS_SQL = f"""
utter AS (SELECT conv_id AS res_id, turn AS pos,
                 CASE role WHEN 'user' THEN 'P' WHEN 'assistant' THEN 'D' END AS speaker,
                 {strip_sql('text')} AS text FROM conversations),
turns AS (SELECT res_id, pos, speaker, text,
                 row_number() OVER (PARTITION BY res_id ORDER BY pos) AS seq,
                 row_number() OVER (PARTITION BY res_id, speaker ORDER BY pos) AS n,
                 speaker || '-' || row_number() OVER (PARTITION BY res_id, speaker ORDER BY pos) AS turn_id
          FROM utter WHERE speaker IS NOT NULL AND text <> '')"""


def parts_sql(bracketed: bool = True) -> str:
    line = "'[' || turn_id || '] ' || speaker || ': ' || text" if bracketed else "turn_id || ': ' || text"
    return f"""{TURNS_SQL},
parts AS (SELECT res_id, string_agg({line}, chr(10) ORDER BY seq) AS text FROM turns GROUP BY 1)"""


def grams_sql(source: str, keys: str, max_n: int, text: str = "text") -> str:
    """CTEs tok and grams over a table or CTE."""
    sizes = ", ".join(str(n) for n in range(1, max_n + 1))
    return f"""
tok AS (SELECT {keys}, {words_sql(f'lower({text})')} AS tk FROM {source}),
tok_n AS (SELECT *, unnest([{sizes}]) AS n FROM tok),
tok_i AS (SELECT *, unnest(range(1, len(tk) - n + 2)) AS i FROM tok_n WHERE len(tk) >= n),
grams AS (SELECT {keys}, tk, n, i - 1 AS start, array_to_string(tk[i:i + n - 1], ' ') AS gram FROM tok_i)"""


VOCAB_SQL = values_sql(DEMO_VOCAB, ["label", "type"])
MENTIONS_SQL = f"""{TURNS_SQL}, {grams_sql('turns', 'res_id, seq, turn_id, speaker', MAX_N)},
vocab AS {VOCAB_SQL},
mentions AS (SELECT res_id, seq, turn_id, speaker, start, n, label, type, gram AS quote, tk,
                    {{'seq': seq, 'start': start, 'n': n}} AS ord
             FROM grams JOIN vocab ON gram = label)"""
CONV_NODES_SQL = f"""{MENTIONS_SQL},
canon AS (SELECT res_id, {canon_sql('label', DEMO_ALIASES)} AS text, type, quote AS evidence, turn_id, ord
          FROM mentions),
firsts AS (SELECT * FROM canon
           QUALIFY row_number() OVER (PARTITION BY res_id, text, type ORDER BY ord) = 1),
nodes AS (SELECT res_id, printf('N_%03d', row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type)) AS id,
                 text, type, evidence, turn_id,
                 row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type) AS ord
          FROM firsts)"""


# --- events as mentions and edges -------------------------------------------------------

EVENT_NODE_TYPES = ["CLICK", "VIEW", "PURCHASE", "SIGNUP"]
EVENT_RELATIONS = {"click": "LINKS", "view": "SEES", "purchase": "BUYS", "signup": "JOINS", "error": "FAILS"}
EVENT_EDGE_TYPES = ["LINKS", "SEES", "BUYS", "JOINS"]
# Surface forms that canonicalisation must see through.
PREFIXES = ["The ", "", "absent the ", "An  ", "No "]
SUFFIXES = ["", ".", " , "]


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: two items and a relation, with varied surface forms."""
    def cycle(forms: list[str]):
        return F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))

    def phrase(n: str):
        return F.concat(cycle(PREFIXES), F.lit("Item "), F.col(n).cast("string"), cycle(SUFFIXES))

    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("res_id"), "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.floor("value") % 100).cast("int").alias("v"))
    relation = F.create_map(*[F.lit(x) for kv in EVENT_RELATIONS.items() for x in kv])
    return base.select("*", phrase("k").alias("src"), phrase("v").alias("dst"),
                       F.try_element_at(relation, F.col("event_type")).alias("relation"))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_items(spark, sf_dir)
    def side(tag: str, text: str, shift: int) -> DataFrame:
        return ev.select(
            "res_id", F.concat(F.lit(tag), F.col("event_id").cast("string")).alias("id"), F.col(text).alias("text"),
            F.col("event_type").alias("type"), F.concat(F.lit("value "), F.col("v").cast("string")).alias("evidence"),
            F.lit("").alias("turn_id"), (F.col("event_id") * 2 + shift).alias("ord"))
    return side("S", "src", 0).unionByName(side("T", "dst", 1))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark, sf_dir).select(
        "res_id", F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("source_id"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("target_id"),
        F.col("relation").alias("type"), F.concat(F.lit("value "), F.col("v").cast("string")).alias("evidence"),
        F.lit("").alias("turn_id"), F.col("event_id").alias("ord"))


def _cycle_sql(forms: list[str]) -> str:
    return "[" + ", ".join(f"'{f}'" for f in forms) + f"][event_id % {len(forms)} + 1]"


_REL_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_RELATIONS.items()) + " END"
EV_SQL = f"""
ev0 AS (SELECT user_id AS res_id, event_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
               CAST(floor(value) AS BIGINT) % 100 AS v FROM events),
ev AS (SELECT *, {_cycle_sql(PREFIXES)} || 'Item ' || k || {_cycle_sql(SUFFIXES)} AS src,
              {_cycle_sql(PREFIXES)} || 'Item ' || v || {_cycle_sql(SUFFIXES)} AS dst, {_REL_CASE} AS relation
       FROM ev0)"""
EVENT_SQL = f"""{EV_SQL},
raw_nodes AS (
  SELECT res_id, 'S' || event_id AS id, src AS text, event_type AS type, 'value ' || v AS evidence,
         event_id * 2 AS ord FROM ev
  UNION ALL
  SELECT res_id, 'T' || event_id, dst, event_type, 'value ' || v, event_id * 2 + 1 FROM ev),
raw_edges AS (SELECT res_id, 'S' || event_id AS source_id, 'T' || event_id AS target_id, relation AS type,
                     'value ' || v AS evidence, event_id AS ord FROM ev)"""


def merged_sql(raw: str = "raw_nodes", aliases: dict[str, str] | None = None, text: str | None = None) -> str:
    """CTEs keyed, firsts, nodes, id_map over raw event nodes: merge and renumber."""
    types = ", ".join(f"'{t}'" for t in EVENT_NODE_TYPES)
    return f"""
keyed AS (SELECT * FROM (SELECT res_id, id AS old_id, {text or canon_sql('text', aliases)} AS text,
                 upper(type) AS type, evidence, ord FROM {raw}) WHERE text <> '' AND type IN ({types})),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY res_id, text, type ORDER BY ord) = 1),
nodes AS (SELECT res_id, printf('N_%03d', row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type)) AS id,
                 text, type, evidence,
                 row_number() OVER (PARTITION BY res_id ORDER BY ord, text, type) AS ord FROM firsts),
id_map AS (SELECT k.res_id, k.old_id, n.id AS new_id FROM keyed k JOIN nodes n USING (res_id, text, type))"""


def mapped_edges_sql() -> str:
    types = ", ".join(f"'{t}'" for t in EVENT_EDGE_TYPES)
    return f"""
mapped AS (SELECT e.res_id, s.new_id AS source_id, t.new_id AS target_id, e.type, e.evidence, e.ord
           FROM raw_edges e JOIN id_map s ON e.res_id = s.res_id AND e.source_id = s.old_id
           JOIN id_map t ON e.res_id = t.res_id AND e.target_id = t.old_id
           WHERE e.type IN ({types}) AND s.new_id <> t.new_id),
edges AS (SELECT * FROM mapped
          QUALIFY row_number() OVER (PARTITION BY res_id, source_id, target_id, type ORDER BY ord) = 1)"""


# --- line items as a trade graph --------------------------------------------------------

def trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per line item: the part of an order, related to its supplier's nation."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("src_text"), F.col("p_type").alias("src_type"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("tgt_text"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    relation = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    return (line.join(part, line["l_partkey"] == part["p_partkey"])
            .join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
            .join(nation, F.col("s_nationkey") == nation["n_nationkey"])
            .select(F.col("l_orderkey").alias("res_id"), "src_text", "src_type", relation.alias("type"),
                    "tgt_text", F.lit("NATION").alias("tgt_type"), "l_linenumber", "l_quantity",
                    _key("P", "l_partkey").alias("src_id"), _key("N", "n_nationkey").alias("tgt_id")))


def _key(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def trade_mentions(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """Part and nation of every line. ``by_order``: dealt so, before a line becomes two mentions, for what is grouped by order."""
    lines = trade_lines(spark, sf_dir)
    if by_order:
        lines = dealt(lines.repartition("res_id"), table(spark, sf_dir, "lineitem").count(), ["res_id"])
    sides = lines.withColumn("_src", F.explode(F.array(F.lit(True), F.lit(False))))
    return sides.select("res_id", *[
        F.when(F.col("_src"), F.col(f"src_{c}")).otherwise(F.col(f"tgt_{c}")).alias(c) for c in ("id", "text", "type")])


def trade_graph(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Nodes are unique per order, known by the key of their part or nation; edges keep one row per line.

    Edges look no text up: one whose part or nation is missing finds no endpoint. Lines are counted first; both tables are
    dealt as endpoints are looked up, in tasks of about ``task_rows`` lines where Spark's own would be larger.
    """
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("res_id"), "l_partkey", "l_suppkey",
        F.concat("l_returnflag", "l_linestatus").alias("type"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("text"), F.col("p_type").alias("type"))
    nation = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lower("n_name").alias("text"), F.lit("NATION").alias("type"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.count()
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = sold.select("res_id", _key("P", "l_partkey").alias("source_id"), _key("N", "s_nationkey").alias("target_id"), "type")
    # Keys are made unique before their texts are looked up; one shuffle by part serves both.
    by_part = dealt(line.select("res_id", "l_partkey").repartition("l_partkey"), rows, ["l_partkey"], task_rows)
    parts = by_part.distinct().join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "res_id", _key("P", "p_partkey").alias("id"), "text", "type")
    nations = sold.select("res_id", "s_nationkey").distinct().join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")).select("res_id", _key("N", "n_nationkey").alias("id"), "text", "type")
    return (dealt(parts.unionByName(nations), rows, ["res_id", "id"], task_rows),
            dealt(edges, rows, ["res_id", "source_id"], task_rows))


TRADE_SQL = """
lines AS (SELECT l_orderkey AS res_id, p_name || ' ' || lower(p_brand) AS src_text, p_type AS src_type,
                 l_returnflag || l_linestatus AS type, lower(n_name) AS tgt_text, 'NATION' AS tgt_type
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
          JOIN nation ON s_nationkey = n_nationkey),
mentions AS (SELECT res_id, src_text AS text, src_type AS type FROM lines
             UNION ALL SELECT res_id, tgt_text, tgt_type FROM lines),
nodes AS (SELECT DISTINCT res_id, text, type FROM mentions)"""


# --- the two sides of a conversation as student and baseline graph -----------------------

TOKEN_NODE_TYPES = ["SHORT", "MEDIUM", "LONG"]
TOKEN_EDGE_TYPES = ["RISES", "FALLS", "EVEN"]


def _token_type(c):
    return F.when(F.length(c) <= 3, "SHORT").when(F.length(c) <= 7, "MEDIUM").otherwise("LONG")


def token_graph(spark: SparkSession, sf_dir: str, role: str) -> tuple[DataFrame, DataFrame]:
    """What one side said: its words as nodes, neighbouring words as edges."""
    rows = table(spark, sf_dir, "conversations").filter(F.col("role") == role).select(
        F.col("conv_id").alias("res_id"), word_tokens(F.lower("text")).alias("tk"))
    nodes = rows.select("res_id", F.explode("tk").alias("text")).select(
        "res_id", "text", _token_type(F.col("text")).alias("type"))
    pairs = F.arrays_zip(F.slice("tk", 1, F.greatest(F.size("tk") - 1, F.lit(0))).alias("a"),
                         F.slice("tk", 2, F.greatest(F.size("tk") - 1, F.lit(0))).alias("b"))
    la, lb = F.length("src_text"), F.length("tgt_text")
    edges = rows.select("res_id", F.inline(pairs).alias("src_text", "tgt_text")).withColumn(
        "type", F.when(la < lb, "RISES").when(la > lb, "FALLS").otherwise("EVEN"))
    return nodes, edges


_TYPE_SQL = "CASE WHEN length(text) <= 3 THEN 'SHORT' WHEN length(text) <= 7 THEN 'MEDIUM' ELSE 'LONG' END"


def _token_side_sql(prefix: str, role: str) -> str:
    return f"""
{prefix}tk AS (SELECT conv_id AS res_id, {words_sql('lower(text)')} AS tk FROM conversations WHERE role = '{role}'),
{prefix}n AS (SELECT res_id, text, {_TYPE_SQL} AS type FROM (SELECT res_id, unnest(tk) AS text FROM {prefix}tk)),
{prefix}e AS (SELECT res_id, src_text, tgt_text, CASE WHEN length(src_text) < length(tgt_text) THEN 'RISES'
                     WHEN length(src_text) > length(tgt_text) THEN 'FALLS' ELSE 'EVEN' END AS type
              FROM (SELECT res_id, tk[i] AS src_text, tk[i + 1] AS tgt_text
                    FROM (SELECT *, unnest(range(1, len(tk))) AS i FROM {prefix}tk)))"""


# Student words s..., baseline words b...; nodes n, edges e, distinct texts t.
TOKEN_SQL = f"""{_token_side_sql('s', 'user')}, {_token_side_sql('b', 'assistant')},
st AS (SELECT DISTINCT text FROM sn), bt AS (SELECT DISTINCT text FROM bn)"""
