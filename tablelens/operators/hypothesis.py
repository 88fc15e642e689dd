"""Numeric × categorical hypothesis tests (TST0–TST14).

Plan per analysis (not per pair):

* **moment table** — one shuffle: categoricals unpivoted, then
  ``groupBy(cat, level)`` with count / mean / var / skewness / kurtosis of every tested
  numeric (map-side combine → at most cats × levels rows per task).  t, F, Cohen's d,
  eta², normality, Tukey HSD and group means all come from it.
* **normality** — Jarque-Bera from the moments, for groups of any size.  With
  ``normality_rule="shapiro"``: Shapiro-Wilk per (numeric, categorical, level) group of 3 to
  ``shapiro_max_n`` values, larger groups count as normal.
* **rank tests** — only pairs that need Mann-Whitney / Kruskal-Wallis: values
  counted per (numeric, value, levels) and passed once in order, for all categoricals together; the
  matrix of wins of level over level gives U, H and every post-hoc U.
* p-values through Arrow UDFs over the (small) result rows.

Level order is ascending by the level's string value (Spark has no row order);
it decides the sign of t and which sample U belongs to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import pvalues as PV
from tablelens.functions.columns import effect_label
from tablelens.functions.distributions import shapiro_wilk
from tablelens.operators.records import bonferroni
from tablelens.options import Options
from tablelens.session import shuffle_partitions, stable
from tablelens.sources.tables import q


# ------------------------------------------------------------------ moments
def moment_table(df: DataFrame, numerics: list[str], categoricals: list[str]) -> DataFrame:
    """num, cat, numeric, categorical, level, rows, n, mean, var, skew, kurt (excess).

    ``rows`` counts rows of the level (null numerics included: the size filter
    of the tests), ``n`` the non-null values (the post-hoc filter).  The table (levels × numerics rows) is
    written once, so the rows are read once however many statistics branch off it."""
    cat_structs = [F.struct(F.lit(j).alias("cat"), q(c).cast("string").alias("level"))
                   for j, c in enumerate(categoricals)]
    num_structs = [F.struct(F.lit(i).alias("num"), q(c).cast("double").alias("x"))
                   for i, c in enumerate(numerics)]
    # one set of aggregates for all numerics: a set per numeric is too wide for compiled code
    long = (df.select(F.array(*num_structs).alias("xs"), F.inline(F.array(*cat_structs))).where(F.col("level").isNotNull())
            .select("cat", "level", F.inline("xs")))
    x = F.col("x")
    per = long.groupBy("num", "cat", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    name = lambda columns, at: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)
    return stable(per.select("num", "cat", name(numerics, "num").alias("numeric"), name(categoricals, "cat").alias("categorical"),
                             "level", "rows", "n", "mean", "var", "skew", "kurt"))


_MOMENTS_SCHEMA = ("num int, cat int, numeric string, categorical string, level string, rows long, n long, "
                   "mean double, var double, skew double, kurt double")


def group_means(mt: DataFrame) -> DataFrame:
    """Mean of every level incl. small ones (AGG10)."""
    return mt.select("num", "cat", "numeric", "categorical", "level", "mean")


# ---------------------------------------------------------- one expression per statistic
def student_t(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(t, degrees of freedom, Cohen's d) of two structs ``(n, mean, var)`` under a pooled variance."""
    n1, n2 = a["n"].cast("double"), b["n"].cast("double")
    dfree = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * a["var"] + (n2 - 1) * b["var"], dfree)
    diff = a["mean"] - b["mean"]
    t = F.when((dfree > 0) & (pooled > 0), diff / F.sqrt(pooled * (1 / n1 + 1 / n2)))
    d = F.when(dfree > 0, F.when(pooled > 0, F.abs(diff) / F.sqrt(pooled)).otherwise(F.lit(0.0)))
    return t, dfree, d


def one_way(moments: DataFrame) -> DataFrame:
    """num, cat, k, n_total, f, eta_sq of a one-way ANOVA over the moment rows of each (num, cat).

    Two aggregates and a join on (num, cat), no window: a factor may have any number of levels."""
    keys = ["num", "cat"]
    totals = moments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"))
    squares = moments.join(totals.select(*keys, "grand"), keys).groupBy(*keys).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(F.lit(0.0))).alias("ssw"))
    k, n, ssb, ssw = F.col("k").cast("double"), F.col("n_total").cast("double"), F.col("ssb"), F.col("ssw")
    return totals.join(squares, keys).select(
        *keys, "k", "n_total",
        F.when((k > 1) & (n > k) & (ssw > 0), (ssb / (k - 1)) / (ssw / (n - k))).alias("f"),
        F.when(ssb + ssw > 0, ssb / (ssb + ssw)).otherwise(F.lit(0.0)).alias("eta_sq"))


def parametric(moments: DataFrame) -> DataFrame:
    """``one_way`` plus g1, g2 (n, mean, var of the first two levels), t, t_df and cohen_d per (num, cat)."""
    keys = ["num", "cat"]
    group = F.struct("n", "mean", "var")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("level"))
    two = moments.withColumn("pos", pos).groupBy(*keys).agg(
        F.max(F.when(F.col("pos") == 1, group)).alias("g1"), F.max(F.when(F.col("pos") == 2, group)).alias("g2"))
    t, dfree, d = student_t(F.col("g1"), F.col("g2"))
    return one_way(moments).join(two.select(*keys, "g1", "g2", t.alias("t"), dfree.alias("t_df"),
                                            d.alias("cohen_d")), keys)


def rank_statistics(wins: DataFrame) -> DataFrame:
    """Per (num, cat) of a ``win_matrix``: U of the first level ascending, its tie-corrected z (continuity,
    larger U), and Kruskal's H in the centred form, which does not cancel at large N.

    A level's rank sum is its wins over all other levels plus the ranks n (n + 1) / 2 it would have alone."""
    keys = ["num", "cat"]
    per_level = wins.where("a <> b AND n_a > 0").groupBy(*keys, F.col("a").alias("level")).agg(
        F.max("n_a").alias("n"), F.sum("u").alias("won"))
    whole = wins.where("a = b AND n_a > 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k_ranked"), F.sum("n_a").alias("n_ranked"), F.max("tie_all").alias("tie"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("level"))
    n, n1, n2, tie = F.col("n_ranked").cast("double"), F.col("u_n1"), F.col("u_n2"), F.col("tie")
    gap = (F.col("won") + F.col("n") * (F.col("n") + 1) / 2) / F.col("n") - (n + 1) / 2
    one = per_level.withColumn("pos", pos).join(whole, keys).groupBy(*keys).agg(
        F.max("k_ranked").alias("k_ranked"), F.max("n_ranked").alias("n_ranked"), F.max("tie").alias("tie"),
        F.max(F.when(F.col("pos") == 1, F.col("n"))).cast("double").alias("u_n1"),
        F.max(F.when(F.col("pos") == 1, F.col("won"))).alias("u"),
        F.max(F.when(F.col("pos") == 2, F.col("n"))).cast("double").alias("u_n2"),
        F.sum(F.col("n") * F.pow(gap, 2)).alias("spread"))
    u = F.col("u")
    sigma = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.try_divide(tie, n * (n - 1))))
    untied = 1 - F.try_divide(tie, F.pow(n, 3) - n)
    return one.select(
        *keys, "k_ranked", "n_ranked", "u_n1", "u_n2", "tie", "u",
        (((n1 <= 8) | (n2 <= 8)) & (tie == 0)).alias("u_exact"),
        F.when(sigma > 0, (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma).alias("z"),
        F.when(untied > 0, F.lit(12.0) / (n * (n + 1)) * F.col("spread") / untied).alias("h"))


#: Fixed value: the largest |Z| of a rank effect, the normal quantile of a one-sided p of 1e-10.
MAX_Z = 6.361340902404056


def rank_effect(z: Column, n: Column) -> Column:
    """r = |Z| / sqrt(N), the effect size of a rank test (TST11)."""
    return F.when(n > 0, F.least(F.abs(z), F.lit(MAX_Z)) / F.sqrt(n.cast("double")))


# ---------------------------------------------------------- normality
def jarque_bera(moments: DataFrame) -> DataFrame:
    """Adds jb = n/6 · (skew² + kurt²/4) and jb_p = exp(-jb/2), its χ² tail with two degrees of freedom.

    Groups of fewer than three values: null.  A constant group: jb 0, jb_p 1."""
    s, k = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("skew", "kurt"))
    return moments.withColumn("jb", F.when(F.col("n") >= 3, F.col("n") / 6.0 * (F.pow(s, 2) + F.pow(k, 2) / 4))) \
        .withColumn("jb_p", F.exp(-F.col("jb") / 2))


_SHAPIRO_SCHEMA = T.StructType([
    T.StructField("num", T.IntegerType()), T.StructField("cat", T.IntegerType()),
    T.StructField("level", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("shapiro_stat", T.DoubleType()), T.StructField("shapiro_p", T.DoubleType())])


def _shapiro_group(key, pdf: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(pdf["x"].to_numpy())
    return pd.DataFrame([{"num": key[0], "cat": key[1], "level": key[2], "n": len(pdf),
                          "shapiro_stat": w, "shapiro_p": p}])


def _level_filter(categoricals: list[str], wanted: dict[tuple[int, int], list[str]],
                  numerics: list[str], value_name: str = "x") -> tuple[Column, list[Column]]:
    """Row predicate (any wanted level present) and the exploded structs."""
    by_cat: dict[int, set] = {}
    for (i, j), lv in wanted.items():
        by_cat.setdefault(j, set()).update(lv)
    pred = None
    for j, lv in by_cat.items():
        c = q(categoricals[j]).cast("string").isin(sorted(lv))
        pred = c if pred is None else (pred | c)
    structs = []
    for (i, j), lv in wanted.items():
        lvl = q(categoricals[j]).cast("string")
        x = q(numerics[i]).cast("double")
        structs.append(F.when(lvl.isin(sorted(lv)) & x.isNotNull(), F.struct(
            F.lit(i).alias("num"), F.lit(j).alias("cat"), lvl.alias("level"), x.alias(value_name))))
    return pred, structs


def normality(df: DataFrame, numerics: list[str], categoricals: list[str], surv: list[dict],
              opts: Options) -> DataFrame:
    """Shapiro-Wilk per surviving group with 3 <= n <= shapiro_max_n."""
    spark = df.sparkSession
    wanted: dict[tuple[int, int], list[str]] = {}
    for r in surv:
        if 3 <= r["n"] <= opts.shapiro_max_n:
            wanted.setdefault((r["num"], r["cat"]), []).append(r["level"])
    if not wanted:
        return spark.createDataFrame([], _SHAPIRO_SCHEMA)
    pred, structs = _level_filter(categoricals, wanted, numerics)
    long = (df.where(pred).select(F.explode(F.array(*structs)).alias("s"))
            .where(F.col("s").isNotNull()).select("s.*"))
    return long.groupBy("num", "cat", "level").applyInPandas(_shapiro_group, _SHAPIRO_SCHEMA)


# ---------------------------------------------------------- wins of level over level
_SLICE = "part int, num int, cat int, a string, b string, own double, tie double, n_a long, n_b long, tie_all double"
_SLICE_NAMES = [c.split()[0] for c in _SLICE.split(", ")]
_SLICE_ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "long": pa.int64()}[t])
                          for n, t in (c.split() for c in _SLICE.split(", "))])


def win_matrix(df: DataFrame, numerics: list[str], categoricals: list[str],
               groups: dict[tuple[int, int], list[str]]) -> DataFrame:
    """num, cat, a, b, u, tie, n_a, n_b, tie_all for every two of the given levels of each pair of columns.

    ``u`` counts the pairs of values in which level ``a`` is above level ``b`` (ties half): the Mann-Whitney U of ``a``.
    ``tie`` is the sum of t³ - t over the values of both levels, ``tie_all`` that over all given levels.

    Rows are counted per (numeric, value, levels of all its categoricals), range-partitioned by (numeric, value) and
    passed once in order, for all categoricals together: with C the counts of a slice's values by level of one of
    them and B the counts below each value in the slice, the slice adds Cᵀ (B + C / 2); the counts of the slices before
    it add n_a · before_b.  A slice emits levels² sums per pair, whatever its size, and no count is copied per pair of
    levels or per categorical.  Levels travel as numbers."""
    order = {k: {lv: at for at, lv in enumerate(sorted(v))} for k, v in groups.items()}
    cats = sorted({j for _, j in groups})
    levels = {j: sorted({lv for (_, c), v in groups.items() if c == j for lv in v}) for j in cats}
    names = [f"c{j}" for j in cats]

    def code(j: int) -> Column:
        known = F.create_map(*[x for at, lv in enumerate(levels[j]) for x in (F.lit(lv), F.lit(at))])
        return F.coalesce(F.try_element_at(known, q(categoricals[j]).cast("string")), F.lit(-1)).alias(f"c{j}")

    nums = sorted({i for i, _ in groups})
    wide = df.select(*[q(numerics[i]).cast("double").alias(f"x{i}") for i in nums], *[code(j) for j in cats])
    counts = (wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("num"), F.col(f"x{i}").alias("value"),
                 *[(F.col(c) if (i, j) in groups else F.lit(-1)).alias(c) for j, c in zip(cats, names)]) for i in nums])))
        .where(F.col("value").isNotNull() & (F.greatest(F.lit(-1), *names) >= 0))
        .groupBy("num", "value", *names).agg(F.count(F.lit(1)).cast("long").alias("cnt")))
    place = {(i, j): np.array([at.get(lv, -1) for lv in levels[j]] + [-1]) for (i, j), at in order.items()}

    def run(batches):
        from pyspark import TaskContext
        part, sums, held = TaskContext.get().partitionId(), {}, None

        def add(num, value, codes, cnt):
            bounds = np.flatnonzero(np.r_[True, num[1:] != num[:-1], True])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                i = int(num[lo])
                for col, j in zip(codes, cats):
                    if (i, j) not in order:
                        continue
                    level = place[(i, j)][col[lo:hi]]
                    seen = np.flatnonzero(level >= 0)
                    if not len(seen):
                        continue
                    v = value[lo:hi][seen]
                    row = np.cumsum(np.r_[False, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
                    at = order[(i, j)]
                    c = np.bincount(row * len(at) + level[seen], cnt[lo:hi][seen], (row[-1] + 1) * len(at)).reshape(-1, len(at))
                    below, own, square, cube, tied = sums.setdefault((i, j), [np.zeros(len(at)), 0.0, 0.0, 0.0, 0.0])
                    b = np.cumsum(c, axis=0) - c + below
                    t = c.sum(axis=1)
                    sums[(i, j)] = [below + c.sum(axis=0), own + c.T @ (b + c / 2), square + (c * c).T @ c,
                                    cube + (c ** 3).sum(axis=0), tied + (t ** 3 - t).sum()]

        def columns(batch):
            num, value, cnt, *codes = (batch.column(n).to_numpy() for n in ("num", "value", "cnt", *names))
            return num, value, codes, cnt.astype(float)

        for batch in batches:                                     # rows come sorted by (num, value)
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            num, value = batch.column("num").to_numpy(), batch.column("value").to_numpy()
            other = (num != num[-1]) | ~((value == value[-1]) | (np.isnan(value) & np.isnan(value[-1])))
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = batch.slice(cut)                               # the last value may go on in the next batch
            if cut:
                add(*columns(batch.slice(0, cut)))
        if held is not None:
            add(*columns(held))
        out = [(part, i, j, a, b, float(own[x, y]), float(cube[x] + cube[y] + 3 * (square[x, y] + square[y, x]) - n[x] - n[y]),
                int(n[x]), int(n[y]), float(tied))
               for (i, j), (n, own, square, cube, tied) in sums.items()
               for a, x in order[(i, j)].items() for b, y in order[(i, j)].items()]
        yield pa.RecordBatch.from_pylist([dict(zip(_SLICE_NAMES, r)) for r in out], _SLICE_ARROW)

    parts = shuffle_partitions(df.sparkSession)
    slices = stable(counts.repartitionByRange(parts, "num", "value").sortWithinPartitions("num", "value")
                    .mapInArrow(run, _SLICE))
    keys = ["num", "cat", "a", "b"]
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # a row per slice
    placed = slices.withColumn("before_b", F.coalesce(F.sum("n_b").over(before), F.lit(0)))
    return stable(placed.groupBy(*keys).agg(
        F.sum(F.col("own") + F.col("n_a") * F.col("before_b")).alias("u"), F.sum("tie").alias("tie"),
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("tie_all").alias("tie_all")))


# ---------------------------------------------------------- the stage
def pairs_frame(spark, numerics, categoricals, n_levels=None):
    """num, cat, numeric, categorical, n_groups (null without ``n_levels``) of every pair of columns."""
    rows = [(i, j, numerics[i], categoricals[j], int(n_levels[c]) if n_levels else None)
            for i in range(len(numerics)) for j, c in enumerate(categoricals)]
    return spark.createDataFrame(rows, "num int, cat int, numeric string, categorical string, n_groups int")


def group_comparison(df: DataFrame, numerics: list[str], categoricals: list[str],
                     n_levels: dict[str, int], opts: Options = Options()) -> dict[str, DataFrame]:
    """Runs the test battery over ``numerics × categoricals`` (already capped / eligible).

    Returns tables ``tests``, ``normality``, ``group_means``, ``posthoc``, ``moments``."""
    spark = df.sparkSession
    if not numerics or not categoricals:
        return {name: spark.createDataFrame([], schema) for name, schema in [
            ("tests", _TESTS_SCHEMA), ("normality", _NORMALITY_SCHEMA), ("group_means", _MEANS_SCHEMA),
            ("posthoc", _POSTHOC_SCHEMA), ("moments", _MOMENTS_SCHEMA)]}
    mt = moment_table(df, numerics, categoricals)
    mt_rows = [r.asDict() for r in mt.collect()]            # ≤ 8 × 8 × 15 rows: plan input
    surv = [r for r in mt_rows if r["rows"] >= opts.min_group_size]
    n_surv: dict[tuple[int, int], int] = {}
    for r in surv:
        n_surv[(r["num"], r["cat"])] = n_surv.get((r["num"], r["cat"]), 0) + 1
    tested = {k for k, v in n_surv.items() if v >= 2}
    surv = [r for r in surv if (r["num"], r["cat"]) in tested]
    pairs = pairs_frame(spark, numerics, categoricals, {c: n_levels[c] for c in categoricals}) \
        .where(F.struct("num", "cat").isin([F.struct(F.lit(i), F.lit(j)) for i, j in sorted(tested)])
               if tested else F.lit(False))

    # normality ------------------------------------------------------------
    columns = [c.split()[0] for c in _MOMENTS_SCHEMA.split(", ")]
    surv_df = spark.createDataFrame([tuple(r[c] for c in columns) for r in surv], _MOMENTS_SCHEMA)
    norm = jarque_bera(surv_df)
    if opts.normality_rule == "shapiro":
        sw = normality(df, numerics, categoricals, surv, opts).drop("n")
        norm = norm.join(sw, ["num", "cat", "level"], "left")
        large = F.col("n") > opts.shapiro_max_n
        p, note = F.when(large, F.lit(1.0)).otherwise(F.col("shapiro_p")), F.when(
            large, F.lit(f"n>{opts.shapiro_max_n}, CLT applies"))
    else:
        norm = norm.withColumns({c: F.lit(None).cast("double") for c in ("shapiro_stat", "shapiro_p")})
        p, note = F.col("jb_p"), F.lit(None).cast("string")
    few = F.col("n") < 3
    norm = norm.withColumn("normal", ~few & F.coalesce(p > opts.alpha, F.lit(False))) \
        .withColumn("note", F.when(few, F.lit("n<3")).otherwise(note))
    norm = stable(norm)
    norm_rows = [r.asDict() for r in norm.select("num", "cat", "normal").collect()]
    all_normal: dict[tuple[int, int], bool] = {}
    for r in norm_rows:
        k = (r["num"], r["cat"])
        all_normal[k] = all_normal.get(k, True) and bool(r["normal"])

    # parametric statistics from moments -------------------------------------
    par = parametric(surv_df).drop("g1", "g2")

    # rank statistics only where needed ---------------------------------------
    need_rank = sorted(p for p in tested if not all_normal.get(p, False))
    rank_rows = wins = None
    if need_rank:
        groups = {}
        for r in surv:
            if (r["num"], r["cat"]) in need_rank:
                groups.setdefault((r["num"], r["cat"]), []).append(r["level"])
        wins = win_matrix(df, numerics, categoricals, groups)
        rank_rows = rank_statistics(wins)

    # assemble ------------------------------------------------------------------
    an = spark.createDataFrame([(i, j, bool(all_normal.get((i, j), False))) for i, j in sorted(tested)],
                               "num int, cat int, normality_met boolean")
    t = pairs.join(an, ["num", "cat"]).join(par, ["num", "cat"])
    if rank_rows is not None:
        t = t.join(rank_rows, ["num", "cat"], "left")
    else:
        t = t.select("*", *[F.lit(None).cast(ty).alias(c) for c, ty in [
            ("u", "double"), ("u_n1", "double"), ("u_n2", "double"), ("tie", "double"),
            ("u_exact", "boolean"), ("h", "double")]])
    two = F.col("n_groups") == 2
    normal = F.col("normality_met")
    method = (F.when(two & normal, F.lit("t-test")).when(two, F.lit("Mann-Whitney U"))
              .when(normal, F.lit("ANOVA")).otherwise(F.lit("Kruskal-Wallis")))
    stat_name = (F.when(two & normal, F.lit("t")).when(two, F.lit("U"))
                 .when(normal, F.lit("F")).otherwise(F.lit("H")))
    statistic = (F.when(two & normal, F.col("t")).when(two, F.col("u"))
                 .when(normal, F.col("f")).otherwise(F.col("h")))
    p_raw = (F.when(two & normal, PV.t_two_sided_p(F.col("t"), F.col("t_df")))
             .when(two, PV.mann_whitney_p(F.col("u"), F.col("u_n1"), F.col("u_n2"), F.col("tie"),
                                          F.col("u_exact")))
             .when(normal, PV.f_sf_p(F.col("f"), F.col("k").cast("double") - 1,
                                     F.col("n_total").cast("double") - F.col("k")))
             .otherwise(PV.chi2_sf_p(F.col("h"), F.col("k").cast("double") - 1)))
    eta_h = F.when(F.col("n_total") > 1, F.round(F.col("h"), 3) / (F.col("n_total") - 1)).otherwise(F.lit(0.0))
    effect = F.when(two, F.col("cohen_d")).when(normal, F.col("eta_sq")).otherwise(eta_h)
    effect_name = (F.when(two, F.lit("Cohen's d")).when(normal, F.lit("η² (eta-squared)"))
                   .otherwise(F.lit("η²_H (Kruskal-Wallis)")))
    effect_interp = F.when(two, effect_label(effect, 0.8, 0.5)).otherwise(effect_label(effect, 0.14, 0.06))
    tests = t.select(
        "num", "cat", "numeric", "categorical", "n_groups", F.col("k").alias("k_tested"),
        F.col("n_total").cast("long").alias("n_total"), "normality_met",
        method.alias("method"), stat_name.alias("statistic_name"), statistic.alias("statistic"),
        p_raw.alias("p_raw"), effect.alias("effect_size"), effect_name.alias("effect_size_name"),
        effect_interp.alias("effect_size_interpretation"),
        "t", "f", "u", "h", "cohen_d", "eta_sq", "t_df")
    tests = bonferroni(stable(tests), opts.alpha)
    tests = stable(tests)
    posthoc = posthoc_tables(df, numerics, categoricals, mt, tests, opts, wins)
    return {"tests": tests, "normality": norm, "group_means": group_means(mt), "posthoc": posthoc,
            "moments": mt}


_MEANS_SCHEMA = "num int, cat int, numeric string, categorical string, level string, mean double"
_NORMALITY_SCHEMA = _MOMENTS_SCHEMA + (", jb double, jb_p double, shapiro_stat double, shapiro_p double, "
                                       "normal boolean, note string")
_TESTS_SCHEMA = ("num int, cat int, numeric string, categorical string, n_groups int, k_tested long, "
                 "n_total long, normality_met boolean, method string, statistic_name string, "
                 "statistic double, p_raw double, effect_size double, effect_size_name string, "
                 "effect_size_interpretation string, t double, f double, u double, h double, cohen_d double, "
                 "eta_sq double, t_df double, p_value double, significant boolean, n_tests long, "
                 "bonferroni_alpha double, significant_bonferroni boolean, significant_bonferroni_raw boolean")


def ordered_tests(tests: DataFrame) -> DataFrame:
    """Tests by rounded p ascending (nulls last), ties by (num, cat) (SRT1)."""
    return tests.orderBy(F.asc_nulls_last("p_value"), "num", "cat")


def test_counts(tests: DataFrame) -> DataFrame:
    """n_tests, n_significant, n_significant_bonferroni (TST13)."""
    return tests.agg(F.count(F.lit(1)).alias("n_tests"),
                     F.count_if("significant").alias("n_significant"),
                     F.count_if("significant_bonferroni").alias("n_significant_bonferroni"))


# ---------------------------------------------------------- post-hoc
_POSTHOC_SCHEMA = ("num int, cat int, numeric string, categorical string, group1 string, group2 string, "
                   "mean_diff double, statistic double, p_value double, bonferroni_alpha double, "
                   "method string, keep boolean")


def level_pairs(mt_small: DataFrame) -> DataFrame:
    """Unordered pairs of *levels* (i < j) per (num, cat) — bounded by max_categories²,
    never pairs of data rows (JN3)."""
    a = mt_small.select("num", "cat", F.col("level").alias("group1"), F.col("n").alias("n1"),
                        F.col("mean").alias("m1"))
    b = mt_small.select("num", "cat", F.col("level").alias("group2"), F.col("n").alias("n2"),
                        F.col("mean").alias("m2"))
    return a.join(b, ["num", "cat"]).where(F.col("group1") < F.col("group2"))


def tukey_hsd(mt_groups: DataFrame) -> DataFrame:
    """Tukey-Kramer statistics for every pair of the given groups (n ≥ 5 after dropna)."""
    agg = mt_groups.groupBy("num", "cat").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"))
    pairs = level_pairs(mt_groups).join(agg, ["num", "cat"])
    mse = F.col("ssw") / (F.col("n_total") - F.col("k"))
    se = F.sqrt(mse / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    qstat = F.when(se > 0, F.abs(F.col("m1") - F.col("m2")) / se)
    return pairs.select("num", "cat", "group1", "group2", (F.col("m1") - F.col("m2")).alias("mean_diff"),
                        qstat.alias("statistic"), "k", (F.col("n_total") - F.col("k")).alias("df"))


def pairwise_u(wins: DataFrame) -> DataFrame:
    """Mann-Whitney U of the first level, and its p, for each pair of levels a < b of a ``win_matrix``."""
    n1, n2 = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    exact = ((n1 <= 8) | (n2 <= 8)) & (F.col("tie") == 0)
    return wins.where("a < b").select(
        "num", "cat", F.col("a").alias("group1"), F.col("b").alias("group2"), F.col("u").alias("statistic"),
        PV.mann_whitney_p(F.col("u"), n1, n2, F.col("tie"), exact).alias("p_raw"))


def posthoc_tables(df: DataFrame, numerics: list[str], categoricals: list[str], mt: DataFrame,
                   tests: DataFrame, opts: Options, wins: DataFrame | None = None) -> DataFrame:
    """Tukey HSD after significant ANOVA, pairwise U + Bonferroni after significant
    Kruskal-Wallis; both need >= 3 groups with n >= min_group_size non-null values.

    ``wins``: a ``win_matrix`` with all these pairs and levels; U and ties of two levels do not depend on the others."""
    spark = df.sparkSession
    sig = tests.where("significant AND method IN ('ANOVA', 'Kruskal-Wallis')").select(
        "num", "cat", "method").collect()
    if not sig:
        return spark.createDataFrame([], _POSTHOC_SCHEMA)
    mt_ok = mt.where(F.col("n") >= opts.min_group_size)
    counts = {(r["num"], r["cat"]): r["c"] for r in
              mt_ok.groupBy("num", "cat").agg(F.count(F.lit(1)).alias("c")).collect()}
    anova = [(r["num"], r["cat"]) for r in sig if r["method"] == "ANOVA" and counts.get((r["num"], r["cat"]), 0) >= 3]
    kw = [(r["num"], r["cat"]) for r in sig if r["method"] == "Kruskal-Wallis"
          and counts.get((r["num"], r["cat"]), 0) >= 3]
    names = pairs_frame(spark, numerics, categoricals).drop("n_groups")
    out = []
    if anova:
        sel = F.struct("num", "cat").isin([F.struct(F.lit(i), F.lit(j)) for i, j in anova])
        tk = tukey_hsd(mt_ok.where(sel))
        tk = tk.select("num", "cat", "group1", "group2", "mean_diff", "statistic",
                       PV.tukey_p(F.col("statistic"), F.col("k").cast("double"), F.col("df").cast("double"))
                       .alias("p_raw"), F.lit(None).cast("double").alias("bonferroni_alpha"),
                       F.lit("Tukey HSD").alias("method"))
        tk = tk.withColumn("keep", F.coalesce(F.col("p_raw") < opts.alpha, F.lit(False)))
        out.append(tk)
    if kw:
        groups = {}
        for r in mt_ok.select("num", "cat", "level").collect():
            if (r["num"], r["cat"]) in kw:
                groups.setdefault((r["num"], r["cat"]), []).append(r["level"])
        if wins is None:
            wins = win_matrix(df, numerics, categoricals, groups)
        pu = pairwise_u(wins)                                     # the join with diffs keeps the levels of mt_ok
        diffs = level_pairs(mt_ok).select("num", "cat", "group1", "group2",
                                          (F.col("m1") - F.col("m2")).alias("mean_diff"))
        npairs = {k: len(v) * (len(v) - 1) // 2 for k, v in groups.items()}
        alpha_df = spark.createDataFrame([(i, j, opts.alpha / n) for (i, j), n in npairs.items()],
                                         "num int, cat int, bonferroni_alpha double")
        pu = (pu.join(diffs, ["num", "cat", "group1", "group2"]).join(F.broadcast(alpha_df), ["num", "cat"])
              .select("num", "cat", "group1", "group2", "mean_diff", "statistic", "p_raw", "bonferroni_alpha",
                      F.lit("Mann-Whitney U (Bonferroni)").alias("method")))
        pu = pu.withColumn("keep", F.coalesce(F.col("p_raw") < F.col("bonferroni_alpha"), F.lit(False)))
        out.append(pu)
    if not out:
        return spark.createDataFrame([], _POSTHOC_SCHEMA)
    res = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return res.join(names, ["num", "cat"]).select(
        "num", "cat", "numeric", "categorical", "group1", "group2", "mean_diff", "statistic",
        F.col("p_raw").alias("p_value"), "bonferroni_alpha", "method", "keep")


# ---------------------------------------------------------- named battery (TST14)
def ab_test(df: DataFrame, value: str, flag: str, first: str = "Yes", second: str = "No") -> DataFrame:
    """Student t-test of ``value`` between ``flag == first`` and ``flag == second`` (one aggregate)."""
    group = F.struct("n", "mean", "var")
    g = moment_table(df.where(q(flag).cast("string").isin(first, second)), [value], [flag]).agg(
        F.max(F.when(F.col("level") == first, group)).alias("g1"),
        F.max(F.when(F.col("level") == second, group)).alias("g2"))
    t, dfree, _ = student_t(F.col("g1"), F.col("g2"))
    return g.select(F.lit(value).alias("value"), F.lit(flag).alias("flag"),
                    F.coalesce("g1.n", F.lit(0)).alias("n1"), F.col("g1.mean").alias("mean1"),
                    F.coalesce("g2.n", F.lit(0)).alias("n2"), F.col("g2.mean").alias("mean2"),
                    t.alias("t"), PV.t_two_sided_p(t, dfree).alias("p_value"))


def anova(df: DataFrame, value: str, factor: str, levels: list[str] | None = None) -> DataFrame:
    """One-way ANOVA of ``value`` over the levels of ``factor`` (all, or the given list)."""
    base = df.where(q(value).isNotNull())
    if levels is not None:
        base = base.where(q(factor).cast("string").isin(levels))
    k, n = F.col("k").cast("double"), F.col("n_total").cast("double")
    return one_way(moment_table(base, [value], [factor])).select(
        F.lit(value).alias("value"), F.lit(factor).alias("factor"), "k", F.col("n_total").alias("N"), "f",
        PV.f_sf_p(F.col("f"), k - 1, n - k).alias("p_value"))
