"""Helpers that keep plans safe on skewed keys and lost executors."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest constant table (rules, aliases, templates) that may be inlined or broadcast.
MAX_RULE_ROWS = 10_000
# Rows of one key that a single task may have to sort when numbering.
SLOT_ROWS = 1 << 20
# Rows of a task, where they are counted.
TASK_ROWS = 1 << 20


def rule_table(spark: SparkSession, rows: list[tuple] | DataFrame, names: list[str]) -> DataFrame:
    """A table of rules, given in code or as a DataFrame whose first columns they are.

    One given in code of at most MAX_RULE_ROWS rows is broadcast; for any other Spark chooses the join.
    """
    if isinstance(rows, DataFrame):
        return rows.toDF(*names, *rows.columns[len(names):]).select(*names)
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    table = spark.createDataFrame(pa.table({n: pa.array(list(c)) for n, c in zip(names, columns)}))
    return F.broadcast(table) if len(rows) <= MAX_RULE_ROWS else table


def literal_array(rows: list[tuple], names: list[str]) -> Column:
    """The same constant as an array column, to be exploded without any join."""
    if len(rows) > MAX_RULE_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a literal")

    def lit(value):
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]) if value else F.array().cast("array<string>")
        return F.lit(value)

    return F.array(*[F.struct(*[lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])


def spread_small(df: DataFrame, floor: int = 1 << 20, limit: int = 256 << 20) -> DataFrame:
    """Deal out a small input that its files do not split, before heavy text work.

    Only an input of at most ``limit`` bytes, whatever the cluster, is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if floor <= size <= limit else df


def dealt(df: DataFrame, rows: float, on: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of ``task_rows`` of ``rows`` each, where Spark's own number of partitions is too small for that."""
    parts = math.ceil(rows / task_rows)
    return df.repartition(parts, *on) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def running_counts(
    df: DataFrame, keys: list[str], order: list[str], ord_col: str | list[str],
    counts: dict[str, Column | None], slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add, per key, running counts of the rows up to and including each row.

    ``counts`` maps an output column to a condition (None counts every row, which gives
    ``row_number``). A key is cut into slots of ``ord_col`` so that a hot key is sorted by
    many tasks; slot totals, one row per slot, then give each slot its starting offset. Where
    ``ord_col`` is a list, its last column is cut and those before it lead, as they do in ``order``.
    Rows without an order come last; a null key is an error.
    """
    *lead, last_ord = [ord_col] if isinstance(ord_col, str) else ord_col
    rest = [F.col(c) for c in df.columns if c not in keys]
    within = Window.partitionBy(*keys, "_slot").orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # Nulls are the last slot of their column; no other slot is as large.
    cut = F.coalesce(F.expr(f"{last_ord} div {slot_rows}"), F.lit((1 << 63) - 1))
    first = [F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(f"_{i}") for i, c in enumerate(lead)]
    local = df.withColumn("_slot", F.struct(*first, cut.alias("cut")))
    for c in keys:
        local = local.withColumn(c, F.coalesce(c, F.raise_error(f"a null {c}").cast(df.schema[c].dataType)))
    for name, cond in counts.items():
        one = F.lit(1) if cond is None else F.when(cond, 1).otherwise(0)
        local = local.withColumn(name, F.sum(one.cast("bigint")).over(within))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    # The last row of a slot holds its totals. Whole rows are compared, so that this branch reads
    # the same columns as the other and both share one shuffle of the input.
    last = F.max(F.struct(*[F.col(n) for n in counts], *rest)).alias("_last")
    starts = local.groupBy(*keys, "_slot").agg(last).select(
        *keys, "_slot",
        *[F.coalesce(F.sum(f"_last.{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in counts])
    starts = starts.withColumnRenamed("_slot", "_slot_").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    met = local["_slot"].eqNullSafe(starts["_slot_"])
    for k in keys:
        met = met & (local[k] == starts[f"_k_{k}"])
    joined = local.join(starts, met).drop("_slot_", *[f"_k_{k}" for k in keys])
    out = {n: F.col(n) + F.col(f"_s_{n}") for n in counts}
    return joined.withColumns(out).drop("_slot", *[f"_s_{n}" for n in counts])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key; partial aggregation keeps hot keys map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_first")
    return df.groupBy(*keys).agg(pick).select(*keys, "_first.*").select(*df.columns)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage; a scratch one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_WRITTEN: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For results that several branches of a plan use: they are computed once, survive lost
    executors, keep column pruning, and bring exact sizes for the joins that follow. The folder
    stays until ``drop_stored`` or the end of the driver.
    """
    spark = df.sparkSession
    if not _WRITTEN:
        atexit.register(drop_all_stored)
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _WRITTEN[path] = spark.sparkContext.applicationId
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more."""
    for df in tables:
        for path in [p for p in _WRITTEN if any(p in f for f in df.inputFiles())]:
            _delete(df.sparkSession, path)
            del _WRITTEN[path]


def drop_all_stored() -> None:
    """Delete every folder that ``stored`` wrote in this application; results that read them are void then."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path, app in list(_WRITTEN.items()):
        if app == spark.sparkContext.applicationId:
            _delete(spark, path)
            del _WRITTEN[path]
