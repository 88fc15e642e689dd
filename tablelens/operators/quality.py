"""Data-quality report: missing values (DQ1) and IQR outliers (DQ2), sorted (DQ3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import severity
from tablelens.operators.ranks import unpivot
from tablelens.operators.selection import box_stats
from tablelens.sources.tables import q


def missing_report(df: DataFrame) -> DataFrame:
    """column, n_missing, percentage (of all rows), severity; only columns with nulls, highest rate first."""
    items = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                      F.count_if(q(c).isNull()).cast("long").alias("n_missing"))
             for i, c in enumerate(df.columns)]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*items).alias("cols"))
    long = wide.select("n_rows", F.inline("cols")).where(F.col("n_missing") > 0)
    pct = F.col("n_missing") / F.col("n_rows") * 100.0
    return long.select("ordinal", "column", "n_missing", pct.alias("percentage"),
                       severity(pct, 20.0, 5.0).alias("severity")).orderBy(F.desc("percentage"), "ordinal")


def outlier_report(df: DataFrame, columns: list[tuple[int, str]], quartiles: DataFrame | None = None) -> DataFrame:
    """IQR rule per numeric column: count, percentage of non-null, bounds, severity.
    Only columns with at least one outlier, highest rate first."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, column string, n_outliers long, percentage double, "
                "lower_bound double, upper_bound double, severity string")
    names = df.sparkSession.createDataFrame([(i, c) for i, c in columns], "ordinal int, column string")
    bs = box_stats(unpivot(df, columns), ["ordinal"], quartiles=quartiles).join(F.broadcast(names), "ordinal")
    pct = F.col("n_fliers") / F.col("n") * 100.0
    return (bs.where(F.col("n_fliers") > 0)
            .select("ordinal", "column", F.col("n_fliers").alias("n_outliers"), pct.alias("percentage"),
                    F.col("lower_fence").alias("lower_bound"), F.col("upper_fence").alias("upper_bound"),
                    severity(pct, 10.0, 3.0).alias("severity")).orderBy(F.desc("percentage"), "ordinal"))
