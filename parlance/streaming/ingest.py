"""Incremental ingestion: new transcripts only, once each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.extract import lexicon_extract
from parlance.operators.turns import segment_marked_turns


def transcript_stream(spark: SparkSession, in_path: str, max_files: int = 10_000) -> DataFrame:
    """A stream of the text files below a folder, as (res_id, text)."""
    files = (spark.readStream.format("text").option("wholetext", True)
             .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.txt").load(in_path))
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("res_id"),
        F.col("value").alias("text"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def first_deliveries(transcripts: DataFrame, keys: tuple[str, ...] = ("res_id",)) -> DataFrame:
    """Every transcript of a stream once: its smallest text in the batch that first delivers it.

    The state holds one flag per transcript, in the store of its partition, so a batch looks up only the transcripts
    it delivers, however many came before. A retried batch starts from the same state and finds the same text. Several
    deliveries of one transcript pass through in pieces; only the smallest text so far is held.
    """
    fields = [transcripts.schema[k] for k in keys]

    def first(key: tuple, deliveries: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        best = None
        for rows in deliveries:
            best = min([*rows["text"].dropna(), *([] if best is None else [best])], default=None)
        state.update((True,))
        yield pd.DataFrame([(*key, best)], columns=[*keys, "text"])

    return transcripts.select(*keys, "text").groupBy(*keys).applyInPandasWithState(
        first, T.StructType([*fields, T.StructField("text", T.StringType())]), "seen boolean", "append", GroupStateTimeout.NoTimeout)


def incremental_ingest_stream(
    transcripts: DataFrame, vocab: DataFrame, out_path: str, checkpoint: str, max_n: int = 4,
    keys: tuple[str, ...] = ("res_id",),
):
    """Start a query that appends the mentions of new transcripts to parquet under ``out_path``.

    The checkpoint remembers which files were read, and in its state store which transcripts: one that is delivered
    again, in whatever file, adds nothing. Each batch overwrites its own ``batch=<id>`` folder, so a retried batch
    leaves no duplicates and loses nothing. Of a transcript that a batch holds twice the smallest text is read.

    State beyond an executor's memory needs the store on disk, which is set here unless the session names another.
    """
    spark = transcripts.sparkSession
    if spark.conf.get(STATE_STORE, "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def sink(batch: DataFrame, batch_id: int) -> None:
        turns = segment_marked_turns(batch, keys)
        mentions = lexicon_extract(turns, vocab, [*keys, "turn_id"], max_n)
        mentions.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (first_deliveries(transcripts, keys).writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
