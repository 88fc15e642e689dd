"""Grouped aggregates and level tables (AGG10–AGG14, AGG20, JN2, JN7, PRJ8, SET3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.sources.tables import q


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean / std (ddof 1) / count of ``value`` per non-null level of ``key`` (AGG11, AGG20)."""
    x = q(value).cast("double")
    return (df.where(q(key).isNotNull()).groupBy(q(key).alias("level"))
            .agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("count")))


def named_group_aggregate(df: DataFrame, key: str, spec: list[tuple[str, str, str]]) -> DataFrame:
    """``spec`` = [(column, function, alias)], function in mean/std/count/min/max/sum/median (AGG13)."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "count": F.count, "min": F.min, "max": F.max,
           "sum": F.sum, "median": F.median}
    return df.groupBy(q(key).alias(key)).agg(*[fns[f](q(c)).alias(a) for c, f, a in spec])


def crosstab(df: DataFrame, row: str, col: str, col_levels: list[str] | None = None) -> DataFrame:
    """Counts of (row level, col level) including zero cells, long form (AGG14).

    One count per cell, left-joined to the grid of levels: every row level
    takes the list of column levels, one value of the aggregate.  Rows with a
    null in either key are dropped, as ``pd.crosstab`` does.
    """
    base = df.where(q(row).isNotNull() & q(col).isNotNull()).select(
        q(row).cast("string").alias("row_level"), q(col).cast("string").alias("col_level"))
    counts = base.groupBy("row_level", "col_level").agg(F.count(F.lit(1)).alias("count"))
    if col_levels is None:
        levels = counts.agg(F.collect_set("col_level").alias("levels")).withColumn("grid", F.lit(1))
        rows = (counts.select("row_level", F.lit(1).alias("grid")).distinct().join(levels, "grid")
                .select("row_level", F.explode("levels").alias("col_level")))
    else:
        rows = counts.select("row_level").distinct().select(
            "row_level", F.explode(F.array(*[F.lit(v) for v in col_levels])).alias("col_level"))
    return rows.join(counts, ["row_level", "col_level"], "left").select(
        "row_level", "col_level", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def ordered_levels(df: DataFrame, column: str, order: list[str], keep_missing: bool = True) -> DataFrame:
    """Counts reindexed to a fixed level order; absent levels give null (JN2) or are
    dropped with ``keep_missing=False`` (JN7 / SET3 intersection)."""
    spark: SparkSession = df.sparkSession
    order_df = spark.createDataFrame([(i, lv) for i, lv in enumerate(order)], "ord int, level string")
    counts = (df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("level"))
              .agg(F.count(F.lit(1)).alias("count")))
    how = "left" if keep_missing else "inner"
    return order_df.join(counts, "level", how).select("ord", "level", "count")


def value_share(df: DataFrame, column: str) -> DataFrame:
    """level, count, share of non-null rows in percent (PRJ8, WIN4).

    The total is a scalar subquery, so no task sees all levels."""
    total = df.agg(F.count(q(column))).scalar()
    vc = (df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("level"))
          .agg(F.count(F.lit(1)).alias("count")))
    return vc.withColumn("share_pct", F.col("count") / total * 100.0)


def level_extremes(means: DataFrame, keys: list[str], level: str = "level", value: str = "mean") -> DataFrame:
    """Level with highest / lowest mean and max/min ratio (inf when min <= 0) (WIN5)."""
    return means.groupBy(*keys).agg(
        F.max_by(level, value).alias("top_level"), F.min_by(level, value).alias("bottom_level"),
        F.max(value).alias("max_mean"), F.min(value).alias("min_mean")).withColumn(
        "ratio", F.when(F.col("min_mean") > 0, F.col("max_mean") / F.col("min_mean"))
        .otherwise(F.lit(float("inf"))))
