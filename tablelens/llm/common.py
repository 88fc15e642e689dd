"""Shared pieces of the training-data operators: table scans, lineage cuts, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import stable  # noqa: F401  (re-exported)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB SQL, if any."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def scan(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``{new name: (column of df, type)}`` and nothing else, so that other columns cannot clash."""
    return df.select(*[col(c).cast(t).alias(n) for n, (c, t) in columns.items()])


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch at ``max_bytes`` of text, so that a task holds a bounded slice
    (or one single text, when that alone is longer)."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n + 64
    if at < len(sizes):
        yield batch.slice(at)


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows: the size check in front of a broadcast."""
    return df.limit(limit + 1).count() <= limit
