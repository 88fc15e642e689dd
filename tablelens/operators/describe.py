"""Descriptive statistics and distribution tables (AGG1–AGG9, AGG16–AGG19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import sample_kurtosis, sample_skewness
from tablelens.operators.ranks import unpivot
from tablelens.operators.selection import QUARTILES, box_stats, quantiles
from tablelens.session import stable
from tablelens.sources.tables import q


def moments(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """One aggregate for all columns: count, mean, std (ddof 1), min, max,
    sample skewness G1 and excess kurtosis G2 — one row per column."""
    items = []
    for i, c in columns:
        x = q(c).cast("double")
        n = F.count(x)
        items.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), n.alias("count"),
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            sample_skewness(F.skewness(x), n).alias("skewness"),
            sample_kurtosis(F.kurtosis(x), n).alias("kurtosis")))
    return df.agg(F.array(*items).alias("cols")).select(F.inline("cols"))


def describe(df: DataFrame, columns: list[tuple[int, str]], quartiles: DataFrame | None = None) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max, skewness, kurtosis per numeric column."""
    m = moments(df, columns)
    qs = quartiles if quartiles is not None else quantiles(unpivot(df, columns), ["ordinal"], QUARTILES)
    qs = qs.select(
        "ordinal", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"), F.col("q_2").alias("q75"))
    return m.join(F.broadcast(qs), "ordinal", "left").select(
        "ordinal", "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")


def _bin_index(x, lo, hi, bins: int):
    """numpy.histogram's bin of ``x`` for ``bins`` equal-width bins on [lo, hi]."""
    step = (hi - lo) / F.lit(float(bins))
    edge = lambda k: F.when(k >= bins, hi).otherwise(k.cast("double") * step + lo)
    i0 = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i0 = F.least(i0, F.lit(bins - 1))
    return (F.when(x < edge(i0), i0 - 1)
            .when((i0 < bins - 1) & (x >= edge(i0 + 1)), i0 + 1)
            .otherwise(i0))


def histogram(df: DataFrame, columns: list[tuple[int, str]], bins: int = 30) -> DataFrame:
    """Equal-width histograms (numpy semantics, empty bins kept) for many columns.

    Job 1 gets min/max of every column (one small row on the driver: the bin
    edges are plan constants); job 2 bins all columns in one narrow pass and
    one tiny (ordinal, bin) aggregate.
    """
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "ordinal int, column string, bin int, lower double, "
                                         "upper double, count long")
    mm = df.agg(*[F.min(q(c).cast("double")).alias(f"mn{i}") for i, c in columns],
                *[F.max(q(c).cast("double")).alias(f"mx{i}") for i, c in columns]).first()
    structs, edges = [], []
    for i, c in columns:
        mn, mx = mm[f"mn{i}"], mm[f"mx{i}"]
        if mn is None:
            continue
        if mn == mx:
            mn, mx = mn - 0.5, mx + 0.5
        x = q(c).cast("double")
        lo, hi = F.lit(float(mn)), F.lit(float(mx))
        structs.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("ordinal"),
                                                      _bin_index(x, lo, hi, bins).alias("bin"))))
        step = (mx - mn) / bins
        for b in range(bins):
            edges.append((i, c, b, b * step + mn, mx if b == bins - 1 else (b + 1) * step + mn))
    if not structs:
        return spark.createDataFrame([], "ordinal int, column string, bin int, lower double, "
                                         "upper double, count long")
    counts = (df.select(F.explode(F.array(*structs)).alias("s")).where(F.col("s").isNotNull())
              .groupBy("s.ordinal", "s.bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame(edges, "ordinal int, column string, bin int, lower double, upper double")
    return (grid.join(counts, ["ordinal", "bin"], "left")
            .select("ordinal", "column", "bin", "lower", "upper",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def box_table(df: DataFrame, columns: list[tuple[int, str]], quartiles: DataFrame | None = None) -> DataFrame:
    """Box-plot statistics per numeric column (AGG17)."""
    names = df.sparkSession.createDataFrame(columns, "ordinal int, column string")
    return box_stats(unpivot(df, columns), ["ordinal"], quartiles=quartiles).join(F.broadcast(names), "ordinal")


def box_by_level(df: DataFrame, value: str, level: str) -> DataFrame:
    """Box-plot statistics of ``value`` per non-null level of ``level`` (AGG17, grouped)."""
    long = df.select(q(level).cast("string").alias("level"), q(value).cast("double").alias("value")) \
             .where(F.col("level").isNotNull())
    return box_stats(long, ["level"])


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Counts per non-null value, count desc then value asc (AGG6, PRJ8)."""
    vc = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    if normalize:
        vc = vc.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))
    return vc.orderBy(F.desc("count"), F.asc("value"))


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent non-null value, smallest on ties (AGG9), via a top-1 window
    that Spark pre-limits per map task."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.asc("value"))
    vc = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    return vc.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def numeric_chart_data(df: DataFrame, columns: list[tuple[int, str]], bins: int = 30,
                       quartiles: DataFrame | None = None) -> dict[str, DataFrame]:
    """Data of the numeric distribution charts (AGG19): histogram + mean/median + box."""
    quartiles = quartiles if quartiles is not None else stable(quantiles(unpivot(df, columns), ["ordinal"], QUARTILES))
    return {"histogram": histogram(df, columns, bins), "box": box_table(df, columns, quartiles),
            "center": describe(df, columns, quartiles).select("ordinal", "column", "mean", F.col("q50").alias("median"))}
