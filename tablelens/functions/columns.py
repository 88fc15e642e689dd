"""Column-expression helpers (JVM-side, stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(pct: Column, high: float, medium: float) -> Column:
    """'high' if pct > high, 'medium' if pct > medium, else 'low' (strict)."""
    return (F.when(pct > high, F.lit("high"))
            .when(pct > medium, F.lit("medium"))
            .otherwise(F.lit("low")))


def effect_label(v: Column, large: float, medium: float) -> Column:
    return (F.when(v > large, F.lit("large"))
            .when(v > medium, F.lit("medium"))
            .otherwise(F.lit("small")))


def silhouette_label(v: Column) -> Column:
    return F.when(v > 0.5, F.lit("good")).when(v > 0.25, F.lit("fair")).otherwise(F.lit("poor"))


def sample_skewness(g1: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson G1 from Spark's population skewness g1."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Unbiased excess kurtosis G2 from Spark's population excess kurtosis g2."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def neg_log10_p(p: Column) -> Column:
    """-log10(p) with 10 for p == 0 (significance score of a test)."""
    return F.when(p > 0, -F.log10(p)).otherwise(F.lit(10.0))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws(" × ", a, b)
