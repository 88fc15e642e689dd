"""User-level operators of the fixed-schema scripts (EDA1–EDA4, ADV1–ADV3, FND11).

They take column names as parameters instead of hard-coding one shopping
table, and compose the stage operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import neg_log10_p
from tablelens.operators import correlate as C
from tablelens.operators import describe as D
from tablelens.operators import grouped as G
from tablelens.operators import hypothesis as H
from tablelens.operators import segment as SG
from tablelens.options import Options
from tablelens.sources.tables import q


def distribution(df: DataFrame, column: str, kind: str = "counts", bins: int = 30,
                 order: list[str] | None = None) -> DataFrame:
    """EDA1: 'hist' → histogram; 'counts' → value counts (optionally in a fixed
    order); 'share' → percentage share; 'sorted' → counts by value."""
    if kind == "hist":
        return D.histogram(df, [(df.columns.index(column), column)], bins)
    if kind == "share":
        return G.value_share(df, column)
    if order is not None:
        return G.ordered_levels(df, column, order)
    vc = D.value_counts(df, column)
    return vc.orderBy("value") if kind == "sorted" else vc


def group_stats(df: DataFrame, key: str, value: str, sort_by_mean: bool = False) -> DataFrame:
    """EDA2 / ADV3: mean, std, count per level (optionally by mean desc)."""
    g = G.group_stats(df, key, value)
    return g.orderBy(F.desc("mean")) if sort_by_mean else g.orderBy("level")


def crosstab(df: DataFrame, row: str, col: str, row_order: list[str] | None = None) -> DataFrame:
    """EDA2: crosstab, rows reindexed to a fixed order when given."""
    ct = G.crosstab(df, row, col)
    if row_order is None:
        return ct
    order = df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(row_order)], "ord int, row_level string")
    return order.join(ct, "row_level", "left").orderBy("ord", "col_level")


def box_stats(df: DataFrame, value: str, key: str) -> DataFrame:
    """EDA3: box statistics of ``value`` per level of ``key``."""
    return D.box_by_level(df, value, key)


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """EDA4: Pearson matrix (long, upper triangle) of the given columns."""
    return C.pearson(df, [(df.columns.index(c), c) for c in columns])


def segment(df: DataFrame, columns: list[str], k: int = 4, opts: Options = Options()) -> dict[str, DataFrame]:
    """ADV1: k-means with a fixed K on the given columns + elbow curve + PCA."""
    return SG.segment(df, columns, opts, k=k)


def ab_test(df: DataFrame, value: str, flag: str, first: str = "Yes", second: str = "No") -> DataFrame:
    """ADV2 / ADV3: two-group Student t-test."""
    return H.ab_test(df, value, flag, first, second)


def anova(df: DataFrame, value: str, factor: str, levels: list[str] | None = None) -> DataFrame:
    """ADV2: one-way ANOVA over all (or the listed) levels."""
    return H.anova(df, value, factor, levels)


def significance_score(tests: DataFrame, p_col: str = "p_value") -> DataFrame:
    """ADV3: -log10(p) (10 when p == 0) and the p < 0.05 flag."""
    return tests.withColumn("neg_log10_p", neg_log10_p(F.col(p_col))) \
        .withColumn("significant", F.col(p_col) < 0.05)


def key_figures(df: DataFrame, numeric: list[str], shares: list[tuple[str, str]],
                modes: list[str]) -> DataFrame:
    """FND11: key figures as (key, value) rows from one aggregate: n, mean/min/max/
    median of numerics, share of a level, and modes (smallest on ties)."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n_rows")]
    for c in numeric:
        x = q(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
    for c, lv in shares:
        aggs.append((F.count_if(q(c).cast("string") == lv) / F.count(q(c)) * 100).alias(f"pct_{c}_{lv}"))
    wide = df.agg(*aggs)
    keys = [n for n in wide.columns]
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("double").alias("value"))
                                          for k in keys])))
    parts = [long]
    if numeric:
        med = D.describe(df, [(df.columns.index(c), c) for c in numeric]).select(
            F.concat(F.lit("median_"), F.col("column")).alias("key"), F.col("q50").alias("value"))
        parts.append(med)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("text", F.lit(None).cast("string"))
    for c in modes:
        m = D.mode(df, c).select(F.lit(f"mode_{c}").alias("key"), F.lit(None).cast("double").alias("value"),
                                 F.col("value").cast("string").alias("text"))
        out = out.unionByName(m)
    return out
