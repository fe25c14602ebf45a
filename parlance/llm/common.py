"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that a helper column never clashes with one of the table's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, name: str = "doc") -> DataFrame:
    return df.select(f"{name}.*")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fixed split into learning and held-out rows. A null key gives 0."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus, F.lit(0))


def slices(column: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a string column as UTF-8 bytes (null: empty), in runs of about ``limit`` bytes.

    A longer text makes a run of its own.
    """
    run: list[bytes] = []
    size, start = 0, 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        data = value.as_py() or b""
        if run and size + len(data) > limit:
            yield start, run
            run, size, start = [], 0, i
        run.append(data)
        size += len(data)
    if run:
        yield start, run
