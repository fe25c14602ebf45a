"""Transcripts in, and which of them still need work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.runtime import first_wins, literal_array


def scan_transcripts(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """``<path>/RES*/RES*.txt`` as (res_id, text); only files named after their folder."""
    files = spark.read.text(f"{path}/RES*/RES*.txt", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.txt$", 1).alias("res_id"),
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("_stem"),
        F.col("value").alias("text"),
    ).filter(F.col("res_id") == F.col("_stem")).drop("_stem")
    return files if ids is None else files.filter(F.col("res_id").isin(ids))


def subset_filter(
    df: DataFrame, id_col: str, ids: list | None = None,
    category_col: str | None = None, categories: list[str] | None = None, known: list[str] | None = None,
) -> DataFrame:
    """Restrict to ids and categories; a category outside ``known`` is an error."""
    if categories is not None:
        unknown = sorted(set(categories) - set(known if known is not None else categories))
        if unknown:
            raise ValueError(f"unknown categories: {unknown}")
        df = df.filter(F.col(category_col).isin(categories))
    return df if ids is None else df.filter(F.col(id_col).isin(ids))


def last_split_wins(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """The same for splits in one table: the row of the highest ``rank`` of each key, in one pass."""
    return first_wins(rows.withColumn("_rank", -F.col(rank)), [key], ["_rank"]).drop("_rank")


def union_splits_last_wins(splits: list[DataFrame], key: str) -> DataFrame:
    """One row per key out of several splits; a later split overwrites an earlier one."""
    ranked = [s.withColumn("_rank", F.lit(-i)) for i, s in enumerate(splits)]
    whole = ranked[0]
    for split in ranked[1:]:
        whole = whole.unionByName(split)
    return first_wins(whole, [key], ["_rank"]).drop("_rank")


def missing_keys(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def missing_inputs(actual: DataFrame, ids: DataFrame, id_col: str, categories: list[str], cat_col: str) -> DataFrame:
    """Expected (id, category) cells that have no data."""
    cells = ids.select(id_col).distinct().select(
        id_col, F.explode(F.array(*[F.lit(c) for c in categories])).alias(cat_col))
    return cells.join(actual.select(id_col, cat_col).distinct(), [id_col, cat_col], "left_anti")


def incremental_skip(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Mark each input SKIP when its output exists, TODO otherwise."""
    done = existing.select(key).distinct().withColumn("_done", F.lit(True))
    return new.join(done, key, "left").withColumn(
        "status", F.when(F.col("_done"), "SKIP").otherwise("TODO")).drop("_done")


def reuse_prior_stage(ids: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Carry a previous run's results over; ids it lacks get status REUSE_FAIL."""
    return ids.join(prior.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "status", F.when(F.col("_hit"), "OK").otherwise("REUSE_FAIL")).drop("_hit")


def latest_run(runs: DataFrame, run_col: str) -> DataFrame:
    """Rows of the newest run; on a partition column only its folder is read."""
    return runs.filter(F.col(run_col) == runs.agg(F.max(run_col)).scalar())


def transcript_meta(turns: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Doctor and patient turns and characters per transcript, and of its note."""
    line = F.length(F.concat_ws(": ", "turn_id", "text"))
    meta = turns.groupBy("res_id").agg(
        F.count_if(F.col("speaker") == "D").alias("doctor_turns"),
        F.count_if(F.col("speaker") == "P").alias("patient_turns"),
        (F.sum(line) + F.count(F.lit(1)) - 1).alias("transcript_chars"),
    )
    if notes is None:
        return meta
    sizes = notes.groupBy("res_id").agg(F.sum(F.length("text")).alias("note_chars"))
    return meta.join(sizes, "res_id", "left").withColumn("note_chars", F.coalesce("note_chars", F.lit(0)))


def prompt_fanout(
    transcripts: DataFrame, templates: list[tuple[str, str, str]],
    vocab: DataFrame | None = None, nodes: DataFrame | None = None, keys: tuple[str, ...] = ("res_id",),
) -> DataFrame:
    """One prompt per transcript and (category, kind, template).

    ``{labels}`` becomes the bulleted vocabulary of the category, ``{entities}`` the numbered
    node list of the transcript, ``{transcript}`` its text; an empty list reads "(none)".
    """
    keys = list(keys)
    base = transcripts.select(*keys, "text")
    none = F.lit("(none)")
    if nodes is not None:
        line = F.concat(F.lit('"'), F.col("text"), F.lit('" ('), F.col("type"), F.lit(", turn "),
                        F.coalesce("turn_id", F.lit("")), F.lit(")"))
        lists = nodes.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_items")
        ).select(*keys, F.array_join(F.transform(
            "_items", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["line"])), "\n"
        ).alias("_entities"))
        base = base.join(lists, keys, "left")
    else:
        base = base.withColumn("_entities", F.lit(None).cast("string"))
    fan = base.select("*", F.inline(literal_array(templates, ["category", "kind", "template"])))
    if vocab is not None:
        bullets = vocab.groupBy(F.col("entity_type").alias("category")).agg(
            F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "label"))), "\n").alias("_labels"))
        fan = fan.join(bullets, "category", "left")
    else:
        fan = fan.withColumn("_labels", F.lit(None).cast("string"))
    filled = F.col("template")
    for slot, value in (("{labels}", "_labels"), ("{entities}", "_entities"), ("{transcript}", "text")):
        filled = F.replace(filled, F.lit(slot), F.coalesce(F.col(value), none))
    return fan.select(*keys, "category", filled.alias("prompt"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
