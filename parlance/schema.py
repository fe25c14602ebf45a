"""Shapes shared by every operator.

nodes  (res_id, id, text, type, evidence, turn_id, ord)
edges  (res_id, source_id, target_id, type, evidence, turn_id, ord)
turns  (res_id, pos, seq, turn_id, speaker, n, text)

``ord`` makes list order explicit: "first wins" always means smallest ``ord``.
"""

from pyspark.sql import types as T

# The vocabulary of node and edge types.
NODE_TYPES = [
    "SYMPTOM", "DIAGNOSIS", "TREATMENT", "PROCEDURE",
    "LOCATION", "MEDICAL_HISTORY", "LAB_RESULT",
]
EDGE_TYPES = ["INDICATES", "CAUSES", "LOCATED_AT", "RULES_OUT", "TAKEN_FOR", "CONFIRMS"]
BUCKETS = ["matched", "other", "fine_grained"]

NODE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("turn_id", T.StringType()),
])
EDGE = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("turn_id", T.StringType()),
])
USAGE = T.StructType([
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
])
KG_DOC = T.StructType([
    T.StructField("res_id", T.StringType()),
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("edges", T.ArrayType(EDGE)),
    T.StructField("_usage", USAGE),
    T.StructField("_method", T.StringType()),
])
BUCKET_ITEM = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("turn_id", T.StringType()),
    T.StructField("quote", T.StringType()),
])
BUCKET_DOC = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("status", T.StringType()),
    *[T.StructField(b, T.ArrayType(BUCKET_ITEM)) for b in BUCKETS],
])
VOCAB = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("source_code", T.StringType()),
])
