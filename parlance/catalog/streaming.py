"""The streaming query, driven to completion over the given conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parlance.catalog.base import MAX_N, MENTIONS_SQL, demo_vocab, query, transcripts
from parlance.runtime import checkpoint_dir
from parlance.streaming.ingest import incremental_ingest_stream


@query("incremental_ingest_stream", f"""
WITH {MENTIONS_SQL} SELECT res_id, turn_id, start, n, label, type, quote FROM mentions""")
def ingest(spark, sf):
    """Two deliveries: half of the transcripts, then the others and a third of the first ones once more."""
    root = f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    texts = transcripts(spark, sf)
    part = F.pmod(F.xxhash64("res_id"), F.lit(6))
    arrivals = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/in/*")
    for number, delivery in enumerate((texts.filter(part < 3), texts.filter(part > 1))):
        delivery.write.parquet(f"{root}/in/{number}")
        incremental_ingest_stream(arrivals, demo_vocab(spark), f"{root}/out", f"{root}/state", MAX_N).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")
