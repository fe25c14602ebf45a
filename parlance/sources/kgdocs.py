"""Graph documents: nodes and edges as JSON, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import id_from_stem, sanitize_id
from parlance.runtime import TASK_ROWS, dealt
from parlance.schema import BUCKET_DOC, KG_DOC
from parlance.sources.transcripts import file_stem


def read_kg(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Graph documents; the id comes from the document, else from the file name."""
    docs = spark.read.schema(KG_DOC).json(path, multiLine=multi_line)
    name = id_from_stem(file_stem(F.col("_metadata.file_path")))
    return docs.withColumn("res_id", F.coalesce("res_id", name))


def explode_kg(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents, list positions kept as ``ord``."""
    def rows(field: str) -> DataFrame:
        return docs.select("res_id", F.posexplode(field)).select("res_id", "col.*", F.col("pos").cast("bigint").alias("ord"))
    return rows("nodes"), rows("edges")


_NODE = ["id", "text", "type", "evidence", "turn_id"]
_EDGE = ["source_id", "target_id", "type", "evidence", "turn_id"]


def pack_kg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per transcript, its lists in the order of ``ord``: for formats in which a document is one value."""
    def packed(df: DataFrame, field: str, names: list[str]) -> DataFrame:
        item = F.struct("ord", *names)
        return df.groupBy("res_id").agg(
            F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[n].alias(n) for n in names]))
            .alias(field))
    n, e = packed(nodes, "nodes", _NODE), packed(edges, "edges", _EDGE)
    return n.join(e, "res_id", "full").withColumns({
        "nodes": F.coalesce("nodes", F.array().cast(KG_DOC["nodes"].dataType)),
        "edges": F.coalesce("edges", F.array().cast(KG_DOC["edges"].dataType)),
    })


def kg_fragments(nodes: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The documents as lines of JSON in pieces (value), sorted so that a task writes one after the other: a piece per
    node and per edge, the first with the head, the one where the lists meet with the bridge, the last with the end. No
    document is ever one value. Rows are counted first and dealt to tasks of about ``task_rows``, which sort them once."""
    def part(df: DataFrame, section: int, names: list[str]) -> DataFrame:
        return df.select("res_id", F.lit(section).alias("section"), "ord", F.to_json(F.struct(*names)).alias("value"))

    items = part(nodes, 1, _NODE).unionByName(part(edges, 3, _EDGE))
    items = dealt(items, items.count(), ["res_id"], task_rows)
    key = F.col("res_id").cast("string")
    named = F.to_json(F.struct(key.alias("res_id"), sanitize_id(key).alias("file_id")))
    head = F.concat(F.substr(named, F.lit(1), F.length(named) - 1), F.lit(', "nodes": ['))
    bridge, end = F.lit('], "edges": ['), F.lit("]}\n")
    order = ["section", "ord", "value"]
    of_graph = Window.partitionBy("res_id").orderBy(*order)
    around = items.withColumns({"before": F.lag("section").over(of_graph), "after": F.lead("section").over(of_graph)})
    first, last, edge = F.col("before").isNull(), F.col("after").isNull(), F.col("section") == 3
    # A comma stands before every item but the first of its list.
    between = F.when(edge & (first | (F.col("before") != F.col("section"))), bridge).when(~first, ",").otherwise("")
    piece = F.concat(F.when(first, head).otherwise(""), between, "value", F.when(last & ~edge, bridge).otherwise(""),
                     F.when(last, end).otherwise(""))
    # The window has sorted the rows this way already, so Spark drops this sort.
    return around.sortWithinPartitions("res_id", *order).select(piece.alias("value"))


def write_kg(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Write documents under their own ids; Spark's commit protocol makes the write atomic.

    ``file_id`` is the sanitised id, for those who name files after it; two ids may share one. JSON is written from
    sorted rows as they pass, no more of them in a task than about a million or one graph; in any other format a document is one row.
    """
    if fmt == "json":
        # White space may stand between any two pieces.
        kg_fragments(nodes, edges).write.mode("overwrite").text(path, lineSep=" ")
        return
    docs = pack_kg(nodes, edges).withColumn("res_id", F.col("res_id").cast("string")).withColumn(
        "file_id", sanitize_id(F.col("res_id")))
    docs.write.mode("overwrite").format(fmt).save(path)


def read_category_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Per-transcript, per-category answers ``<res>_<CATEGORY>.json``; absent files add nothing.

    ``lines``: files of one answer a line, which name their transcript (res_id) and category themselves; a transcript
    may have several lines of a category, so that no list needs to be one value.
    """
    if lines:
        return spark.read.schema(T.StructType([T.StructField("res_id", T.StringType()), *BUCKET_DOC])).json(path)
    stem = file_stem(F.col("_metadata.file_path"))
    category = F.regexp_extract(stem, r"_([A-Z]+(?:_[A-Z]+)*)$", 1)
    return spark.read.schema(BUCKET_DOC).json(path, multiLine=True, recursiveFileLookup=True,
                                              pathGlobFilter="*.json").withColumns({
        "category": F.coalesce("category", category),
        "res_id": F.substr(stem, F.lit(1), F.length(stem) - F.length(category) - F.lit(1)),
    })
