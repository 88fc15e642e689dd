"""The full automatic analysis: every stage, in the reference's order.

``analyze(df)`` returns a dict name → DataFrame.  Only the role table (one row
per column), a few level lists and the ≤ 10-row K table reach the driver to
plan later stages; all data work stays in Spark.  Shared intermediates are
built once: the quartiles of all numerics feed describe, outliers and box plots;
the moment table feeds every parametric test and the group means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import correlate as C
from tablelens.operators import describe as D
from tablelens.operators import drivers as RG
from tablelens.operators import findings as FD
from tablelens.operators import hypothesis as H
from tablelens.operators import quality as QY
from tablelens.operators import roles as RL
from tablelens.operators import segment as SG
from tablelens.operators.ranks import unpivot
from tablelens.operators.selection import QUARTILES, quantiles
from tablelens.options import Options
from tablelens.session import stable


def analyze(df: DataFrame, opts: Options = Options(), targets: list[str] | None = None,
            stages: set[str] | None = None) -> dict[str, DataFrame]:
    """Run the analysis.  ``stages`` limits it to a subset of
    {quality, describe, charts, correlation, tests, clustering, drivers, findings}."""
    want = (lambda s: True) if stages is None else (lambda s: s in stages)
    spark = df.sparkSession
    out: dict[str, DataFrame] = {}
    roles, info = RL.detect(df, opts)
    out["roles"] = roles
    out["table_summary"] = RL.table_summary(df)
    out["column_overview"] = RL.column_overview(roles)
    num = [(info.ordinal(c), c) for c in info.numeric]
    cats = [(info.ordinal(c), c) for c in info.categorical]
    out["category_counts"] = RL.category_counts(df, cats, opts.top_n) if cats else None
    quartiles = stable(quantiles(unpivot(df, num), ["ordinal"], QUARTILES)) if num else None

    if want("quality"):
        out["missing"] = QY.missing_report(df)
        out["outliers"] = QY.outlier_report(df, num, quartiles)
    if want("describe") and num:
        out["describe"] = D.describe(df, num, quartiles)
    if want("charts"):
        hist_cols = num[:opts.max_hist_numeric]
        if hist_cols:
            out["histogram"] = D.histogram(df, hist_cols, opts.hist_bins)
            out["box"] = D.box_table(df, num, quartiles).where(F.col("ordinal").isin([i for i, _ in hist_cols]))
        bar_cols = [i for i, _ in cats[:opts.max_bar_categorical]]
        if out.get("category_counts") is not None:
            out["category_chart"] = out["category_counts"].where(F.col("ordinal").isin(bar_cols))
    strong = hints = None
    if want("correlation") and len(num) >= 2:
        corr = C.correlations(df, num, {c: info.missing(c) for _, c in num}).cache()
        strong, hints = C.strong_pairs(corr, opts.corr_threshold), C.nonlinear_hints(corr, opts.nonlinear_threshold)
        out.update(correlation=corr, strong_pairs=strong, nonlinear_hints=hints, heatmap=C.heatmap(corr))
    tests = None
    eligible = info.eligible_categorical(opts)
    if want("tests") and info.numeric and eligible:
        nums_t, cats_t = info.numeric[:opts.max_test_numeric], eligible[:opts.max_test_categorical]
        res = H.group_comparison(df, nums_t, cats_t, {c: info.distinct(c) for c in cats_t}, opts)
        tests = res["tests"]
        out.update(tests=H.ordered_tests(tests), normality=res["normality"], group_means=res["group_means"],
                   posthoc=res["posthoc"], test_counts=H.test_counts(tests))
    seg = None
    if want("clustering") and len(info.numeric) >= 2:
        feats = SG.cluster_features(info.numeric, {c: info.distinct(c) for c in info.numeric}, opts)
        seg = SG.segment(df, feats, opts)
        if seg is not None:
            out.update(cluster_summary=seg["summary"], k_table=SG.elbow_table(seg["k_table"]),
                       cluster_profile=seg["profile"], cluster_scatter=seg["scatter"])
    drv = None
    if want("drivers") and len(info.numeric) >= 2:
        drv = RG.driver_analysis(df, info.numeric, eligible, targets, opts)
        out.update(driver_models=drv["models"], drivers=drv["drivers"])
    if want("findings"):
        parts = []
        if "missing" in out:
            parts.append(FD.quality_findings(out["missing"], out["outliers"]))
        if drv is not None:
            parts.append(FD.driver_findings(drv["models"], drv["drivers"]))
        if tests is not None:
            parts.append(FD.test_findings(tests, out["group_means"], out["posthoc"]))
        if strong is not None:
            parts.append(FD.correlation_findings(strong))
        seg_info = None
        if seg is not None:
            parts.append(FD.cluster_findings(seg["summary"], seg["profile"]))
            seg_info = seg["summary"].first().asDict()
        recs = FD.recommendations(
            spark, drv["models"] if drv else None, drv["drivers"] if drv else None, tests,
            out.get("group_means"), out.get("posthoc"), seg_info,
            seg["profile"] if seg else None, hints, opts.max_recommendations)
        parts.append(recs)
        out["findings"] = reduce(DataFrame.unionByName, parts)
    return {k: v for k, v in out.items() if v is not None}
