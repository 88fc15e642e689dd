"""Views and records over result tables: multiple-testing correction, verdicts, ranked top-k views and the nested
test record (TST12, FLT7, SRT1–SRT3, LIM1, SNK2, SCA16, SCA8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bonferroni(tests: DataFrame, alpha: float = 0.05, p: str = "p_raw") -> DataFrame:
    """Adds p_value (4 decimals), significant, n_tests, bonferroni_alpha, significant_bonferroni (rounded p
    against the corrected level, as the reference does) and significant_bonferroni_raw.

    The number of tests is a scalar subquery: no task sees all rows."""
    n = tests.agg(F.count(F.lit(1))).scalar()
    below = lambda c, level: F.coalesce(F.col(c) < level, F.lit(False))
    return (tests.withColumn("p_value", F.round(p, 4)).withColumn("significant", below(p, F.lit(alpha)))
            .withColumn("n_tests", n).withColumn("bonferroni_alpha", F.lit(alpha) / F.col("n_tests"))
            .withColumn("significant_bonferroni", below("p_value", F.col("bonferroni_alpha")))
            .withColumn("significant_bonferroni_raw", below(p, F.col("bonferroni_alpha"))))


def verdict() -> Column:
    """corrected / raw / none: which level of a corrected test table a row reaches (FLT7)."""
    return F.when(F.col("significant_bonferroni"), F.lit("corrected")).when(F.col("significant"), F.lit("raw")) \
        .otherwise(F.lit("none"))


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, k: int | None = None) -> DataFrame:
    """``df`` with its ``position`` in ``order`` (from 1) within each ``by`` group, cut at ``k`` if given (LIM1, SRT1–SRT3).

    ``row_number <= k`` lets Spark keep only k rows per group and task before the exchange."""
    out = df.withColumn("position", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))
    return out if k is None else out.where(F.col("position") <= k)


def test_records(tests: DataFrame, normality: DataFrame, posthoc: DataFrame, means: DataFrame) -> DataFrame:
    """One nested row per test: its columns, ``normality`` and ``posthoc`` as arrays of structs (ordered by
    level) and ``group_means`` as a map level → mean.

    The children hold at most the levels, or pairs of levels, of one categorical column."""
    keys = ["num", "cat"]
    by_level = normality.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("level", "n", "jb", "jb_p", "normal", "note"))).alias("normality"))
    by_pair = posthoc.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("group1", "group2", "mean_diff", "statistic", "p_value", "method", "keep"))).alias("posthoc"))
    by_mean = means.where(F.col("level").isNotNull()).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "mean")))).alias("group_means"))
    none = by_pair.schema["posthoc"].dataType
    return (tests.join(by_level, keys, "left").join(by_pair, keys, "left").join(by_mean, keys, "left")
            .withColumn("posthoc", F.coalesce("posthoc", F.array().cast(none))))


def stamped(df: DataFrame, at: Column | None = None) -> DataFrame:
    """``df`` with the text ``created`` (yyyy-MM-dd HH:mm:ss): now, or the given time (SCA8)."""
    return df.withColumn("created", F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss"))
