"""Findings and recommendations as rule tables (FND1–FND10).

Each rule turns small result tables into rows of
``findings(kind, rule, seq, subject, metric, value, text)``.  Inputs are the
stage outputs (at most a few hundred rows), so the rules are plain DataFrame
filters, windows and unions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "kind string, rule string, seq int, subject string, metric string, value double, text string"


def _rows(df: DataFrame, kind: str, rule: str, seq, subject, metric: str, value, text) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), seq.cast("int").alias("seq"),
                     subject.cast("string").alias("subject"), F.lit(metric).alias("metric"),
                     value.cast("double").alias("value"), text.alias("text"))


def quality_findings(missing: DataFrame, outliers: DataFrame) -> DataFrame:
    """FND1: medium / high quality warnings, or one row saying that there are none."""
    m = missing.where(F.col("severity").isin("high", "medium"))
    o = outliers.where(F.col("severity").isin("high", "medium"))
    a = _rows(m, "finding", "missing", F.row_number().over(Window.orderBy(F.desc("percentage"), "column")),
              F.col("column"), "missing_pct", F.col("percentage"),
              F.format_string("%s: %d missing (%.1f%%, %s)", F.col("column"), F.col("n_missing"),
                              F.col("percentage"), F.col("severity")))
    b = _rows(o, "finding", "outliers", F.row_number().over(Window.orderBy(F.desc("percentage"), "column")),
              F.col("column"), "outlier_pct", F.col("percentage"),
              F.format_string("%s: %d IQR outliers (%.1f%%, range %.2f ~ %.2f, %s)", F.col("column"),
                              F.col("n_outliers"), F.col("percentage"), F.col("lower_bound"),
                              F.col("upper_bound"), F.col("severity")))
    none = m.select("column").unionByName(o.select("column")).agg(F.count("column").alias("n")).where("n = 0")
    c = _rows(none, "finding", "quality_ok", F.lit(1), F.lit(None), "problems", F.col("n"),
              F.lit("no severe data quality problem"))
    return a.unionByName(b).unionByName(c)


def driver_findings(models: DataFrame, drivers: DataFrame) -> DataFrame:
    """FND2: R² and the three strongest drivers of every target."""
    top = drivers.where(F.col("rank") <= 3).join(models.select("target", "r_squared"), "target")
    head = _rows(models, "finding", "driver_model", F.lit(0), F.col("target"), "r_squared",
                 F.col("r_squared"), F.format_string("model explains %.1f%% of %s (R²=%.3f)",
                                                     F.col("r_squared") * 100, F.col("target"), F.col("r_squared")))
    body = _rows(top, "finding", "driver_top3", F.col("rank"), F.col("target"), "beta", F.col("coefficient"),
                 F.format_string("#%d %s: %s (Beta=%.3f, %s)", F.col("rank"), F.col("feature"),
                                 F.when(F.col("coefficient") > 0, F.lit("positive")).otherwise(F.lit("negative")),
                                 F.col("coefficient"),
                                 F.when(F.col("significant"), F.lit("significant"))
                                 .otherwise(F.lit("not significant"))))
    return head.unionByName(body)


def test_findings(tests: DataFrame, means: DataFrame, posthoc: DataFrame) -> DataFrame:
    """FND3: corrected significant tests (top 3 by p) with max/min mean ratio and the
    post-hoc pair with the largest |mean difference|; else raw-only or none."""
    counts = tests.agg(F.count(F.lit(1)).alias("n"), F.count_if("significant_bonferroni").alias("nb"),
                       F.count_if("significant").alias("ns"))
    w = Window.orderBy(F.asc_nulls_last("p_value"), "num", "cat")
    corr = tests.where("significant_bonferroni").withColumn("seq", F.row_number().over(w)).where("seq <= 3")
    ext = means.groupBy("num", "cat").agg(
        F.max("mean").alias("mx"), F.min("mean").alias("mn"),
        F.max_by("level", "mean").alias("top_level"), F.min_by("level", "mean").alias("bottom_level"))
    ratio = F.when(F.col("mn") > 0, F.col("mx") / F.col("mn")).otherwise(F.lit(float("inf")))
    top = _rows(corr.join(ext, ["num", "cat"]), "finding", "test_corrected", F.col("seq"),
                F.concat_ws(" by ", "numeric", "categorical"), "p_value", F.col("p_value"),
                F.format_string("%s has a significant effect on %s (p=%.4f); highest group mean is %.1f× the lowest",
                                F.col("categorical"), F.col("numeric"), F.col("p_value"), ratio))
    summary = _rows(counts, "finding", "test_summary", F.lit(0), F.lit("tests"), "n_significant_bonferroni",
                    F.col("nb"),
                    F.when(F.col("nb") > 0, F.format_string("%d/%d group tests significant after Bonferroni",
                                                            F.col("nb"), F.col("n")))
                    .when(F.col("ns") > 0, F.format_string(
                        "%d/%d tests significant before correction, none after Bonferroni", F.col("ns"), F.col("n")))
                    .otherwise(F.format_string("no significant group difference in %d tests", F.col("n"))))
    ph = (posthoc.where("keep").join(corr.select("num", "cat"), ["num", "cat"])
          .withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.abs(F.col("mean_diff"))), "num", "cat")))
          .where("r = 1"))
    pair = _rows(ph, "finding", "test_posthoc", F.lit(1), F.concat_ws(" vs ", "group1", "group2"), "mean_diff",
                 F.col("mean_diff"), F.format_string("post-hoc: %s vs %s (mean diff=%.2f, p=%.4f)",
                                                     F.col("group1"), F.col("group2"), F.col("mean_diff"),
                                                     F.col("p_value")))
    return summary.unionByName(top).unionByName(pair)


def correlation_findings(strong: DataFrame) -> DataFrame:
    """FND4: number of |pearson| > t pairs and the top three."""
    ps = strong.where("pearson_strong")
    w = Window.orderBy(F.desc(F.abs(F.col("pearson"))), "i", "j")
    cnt = _rows(ps.agg(F.count(F.lit(1)).alias("c")).where("c > 0"), "finding", "correlation_count", F.lit(0),
                F.lit("pairs"), "n_pairs", F.col("c"), F.format_string("%d variable pairs with |r| > 0.3", F.col("c")))
    top = ps.withColumn("seq", F.row_number().over(w)).where("seq <= 3")
    body = _rows(top, "finding", "correlation_top", F.col("seq"), F.col("pair"), "pearson", F.col("pearson"),
                 F.format_string("%s: r=%.3f", F.col("pair"), F.col("pearson")))
    return cnt.unionByName(body)


def cluster_findings(summary: DataFrame, profile: DataFrame) -> DataFrame:
    """FND5: K, smallest and largest segment with share."""
    ext = profile.agg(F.min("size").alias("mn"), F.max("size").alias("mx"), F.sum("size").alias("tot"))
    k = _rows(summary, "finding", "clusters", F.lit(0), F.lit("segments"), "k", F.col("k_optimal"),
              F.format_string("%d distinct segments", F.col("k_optimal")))
    small = _rows(ext, "finding", "cluster_smallest", F.lit(1), F.lit("smallest"), "size", F.col("mn"),
                  F.format_string("smallest segment: %d rows (%.1f%%)", F.col("mn"), F.col("mn") / F.col("tot") * 100))
    large = _rows(ext, "finding", "cluster_largest", F.lit(2), F.lit("largest"), "size", F.col("mx"),
                  F.format_string("largest segment: %d rows (%.1f%%)", F.col("mx"), F.col("mx") / F.col("tot") * 100))
    return k.unionByName(small).unionByName(large)


def recommendations(spark: SparkSession, models: DataFrame | None, drivers: DataFrame | None,
                    tests: DataFrame | None, means: DataFrame | None, posthoc: DataFrame | None,
                    seg_info: dict | None, profile: DataFrame | None, hints: DataFrame | None,
                    max_lines: int | None = None) -> DataFrame:
    """FND6–FND10: the recommendations (the first ``max_lines``, if given), or one fallback line."""
    parts = []
    if models is not None and drivers is not None:
        sig_models = models.where("model_significant").select("target")
        cand = drivers.where("rank <= 3 AND significant").join(sig_models, "target")
        first = cand.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy("rank"))).where("r = 1")
        parts.append(_rows(first, "recommendation", "focus_driver", F.lit(1), F.col("target"), "beta",
                           F.col("coefficient"),
                           F.format_string("focus on %s: prioritise %s (Beta=%.3f)", F.col("target"),
                                           F.col("feature"), F.col("coefficient"))))
    if tests is not None and means is not None:
        w = Window.orderBy(F.asc_nulls_last("p_value"), "num", "cat")
        top2 = tests.where("significant_bonferroni").withColumn("seq", F.row_number().over(w)).where("seq <= 2")
        ext = means.groupBy("num", "cat").agg(F.max_by("level", "mean").alias("top_level"),
                                              F.min_by("level", "mean").alias("bottom_level"))
        parts.append(_rows(top2.join(ext, ["num", "cat"]), "recommendation", "differentiate", F.col("seq") + 1,
                           F.concat_ws(" by ", "numeric", "categorical"), "p_value", F.col("p_value"),
                           F.format_string("%s drives %s (%s, p=%.4f): '%s' performs best, '%s' has most room",
                                           F.col("categorical"), F.col("numeric"), F.col("method"),
                                           F.col("p_value"), F.col("top_level"), F.col("bottom_level"))))
        if posthoc is not None:
            ph = (posthoc.where("keep").join(top2.select("num", "cat", "seq"), ["num", "cat"])
                  .withColumn("r", F.row_number().over(Window.partitionBy("num", "cat")
                                                       .orderBy(F.desc(F.abs(F.col("mean_diff"))))))
                  .where("r = 1"))
            parts.append(_rows(ph, "recommendation", "posthoc", F.col("seq") + 1,
                               F.concat_ws(" vs ", "group1", "group2"), "p_value", F.col("p_value"),
                               F.format_string("post-hoc confirms %s vs %s (p=%.4f, %s)", F.col("group1"),
                                               F.col("group2"), F.col("p_value"), F.col("method"))))
    if seg_info is not None and profile is not None and seg_info.get("silhouette") is not None \
            and seg_info["silhouette"] > 0.25:
        ext = profile.agg(F.max_by("cluster", "size").alias("largest"), F.max("size").alias("lsize"),
                          F.min_by("cluster", "size").alias("smallest"), F.min("size").alias("ssize"),
                          F.count(F.lit(1)).alias("k")).where("k >= 2")
        parts.append(_rows(ext, "recommendation", "segments", F.lit(5), F.lit("segments"), "silhouette",
                           F.lit(seg_info["silhouette"]),
                           F.format_string("%d segments (silhouette=%.3f): scale reach for cluster %d (%d rows), "
                                           "deepen cluster %d (%d rows)", F.lit(seg_info["k_optimal"]),
                                           F.lit(seg_info["silhouette"]), F.col("largest"), F.col("lsize"),
                                           F.col("smallest"), F.col("ssize"))))
    if hints is not None:
        top = hints.withColumn("r", F.row_number().over(Window.orderBy(F.desc("difference"), "i", "j"))).where("r = 1")
        parts.append(_rows(top, "recommendation", "nonlinear", F.lit(6), F.col("pair"), "difference",
                           F.col("difference"),
                           F.format_string("explore %s: Pearson %.3f vs Spearman %.3f (difference %.3f)",
                                           F.col("pair"), F.col("pearson"), F.col("spearman"), F.col("difference"))))
    if not parts:
        return spark.createDataFrame([("recommendation", "fallback", 99, None, None, None,
                                       "no signal strong enough for a recommendation")], SCHEMA)
    allrec = reduce(DataFrame.unionByName, parts)
    ranked = allrec.withColumn("_o", F.row_number().over(Window.orderBy("seq", "rule", "subject"))) \
        .where(F.lit(True) if max_lines is None else F.col("_o") <= max_lines).drop("_o").cache()
    if ranked.limit(1).count() == 0:
        return spark.createDataFrame([("recommendation", "fallback", 99, None, None, None,
                                       "no signal strong enough for a recommendation")], SCHEMA)
    return ranked
