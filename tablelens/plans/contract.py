"""Contract queries: Spark implementation + equivalent DuckDB SQL per operator.

Every query reads whole test tables (no row caps, no id subsets).  Doubles are
rounded to 6 decimals on both sides and every column is aliased identically,
so the driver's order-insensitive value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.options import Options
from tablelens.sources.tables import load_table

R = 6  # decimals compared by the oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def rnd(c, d: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def cols_of(df: DataFrame, names: list[str]) -> list[tuple[int, str]]:
    return [(df.columns.index(n), n) for n in names]


def numeric_columns(df: DataFrame, opts: Options = Options()) -> list[tuple[int, str]]:
    from tablelens.operators.roles import detect
    _, info = detect(df, opts)
    return [(info.ordinal(c), c) for c in info.numeric]
