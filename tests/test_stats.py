"""Correlation, hypothesis tests, regression and segmentation on hand-made frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import correlate as C
from tablelens.operators import drivers as RG
from tablelens.operators import hypothesis as H
from tablelens.operators import segment as SG
from tablelens.options import REFERENCE_CAPS, Options


def frame(spark, data: dict):
    pdf = pd.DataFrame(data)
    return spark.createDataFrame(pdf)


def run_battery(spark, pdf, nums, cats):
    df = spark.createDataFrame(pdf)
    levels = {c: pdf[c].dropna().nunique() for c in cats}
    return H.group_comparison(df, nums, cats, levels, Options())


def test_pairwise_complete_correlation(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=300)
    b = a + rng.normal(size=300)
    c = np.exp(a)
    b[::5] = np.nan
    c[::7] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf).select(*[F.when(F.isnan(x), None).otherwise(F.col(x)).alias(x) for x in "abc"])
    out = {(r["col_i"], r["col_j"]): r for r in C.correlations(df, [(0, "a"), (1, "b"), (2, "c")]).collect()}
    for (x, y), r in out.items():
        assert r["pearson"] == pytest.approx(pdf[x].corr(pdf[y]), rel=1e-9)
        both = pdf[[x, y]].dropna()
        assert r["spearman"] == pytest.approx(both[x].rank().corr(both[y].rank()), rel=1e-9)
    hints = C.nonlinear_hints(C.correlations(df, [(0, "a"), (2, "c")]), 0.05).collect()
    assert hints and hints[0]["spearman"] == 1.0


def test_two_groups_t_and_u(spark):
    rng = np.random.default_rng(5)
    normal = pd.DataFrame({"x": np.r_[rng.normal(0, 1, 60), rng.normal(0.8, 1, 60)], "g": ["a"] * 60 + ["b"] * 60})
    t = run_battery(spark, normal, ["x"], ["g"])["tests"].first()
    assert t["method"] == "t-test"
    a, b = normal.x[:60], normal.x[60:]
    sp = np.sqrt((59 * a.var() + 59 * b.var()) / 118)
    assert t["statistic"] == pytest.approx((a.mean() - b.mean()) / (sp * np.sqrt(2 / 60)))
    assert t["effect_size"] == pytest.approx(abs(a.mean() - b.mean()) / sp)
    skewed = pd.DataFrame({"x": np.r_[rng.exponential(1, 60), rng.exponential(3, 60)], "g": ["a"] * 60 + ["b"] * 60})
    u = run_battery(spark, skewed, ["x"], ["g"])["tests"].first()
    assert u["method"] == "Mann-Whitney U"
    ranks = skewed.x.rank()
    assert u["statistic"] == pytest.approx(ranks[:60].sum() - 60 * 61 / 2)


def test_tiny_no_ties_exact_u(spark):
    pdf = pd.DataFrame({"x": [1.1, 2.3, 3.5, 4.2, 5.9, 6.1, 7.7, 3.0, 4.4, 5.5, 6.6, 7.1, 8.8, 9.9, 10.5, 11.2],
                        "g": ["a"] * 7 + ["b"] * 9})
    res = run_battery(spark, pdf, ["x"], ["g"])
    t = res["tests"].first()
    # either branch is allowed by normality; check the exact U when chosen
    if t["method"] == "Mann-Whitney U":
        from tablelens.functions.distributions import mann_whitney_p
        u1 = pdf.x.rank()[:7].sum() - 28
        assert t["p_raw"] == pytest.approx(mann_whitney_p(u1, 7, 9, 0.0, True))


def test_anova_identity_and_tukey(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(0, 1, 50), rng.normal(1, 1, 50), rng.normal(2, 1, 50)],
                        "g": ["a"] * 50 + ["b"] * 50 + ["c"] * 50})
    res = run_battery(spark, pdf, ["x"], ["g"])
    t = res["tests"].first()
    assert t["method"] == "ANOVA" and t["significant"]
    groups = [pdf.x[pdf.g == k] for k in "abc"]
    gm = pdf.x.mean()
    ssb = sum(len(g) * (g.mean() - gm) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert t["statistic"] == pytest.approx((ssb / 2) / (ssw / 147))
    assert t["effect_size"] == pytest.approx(ssb / (ssb + ssw))
    ph = res["posthoc"].collect()
    assert {(r["group1"], r["group2"]) for r in ph} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(r["method"] == "Tukey HSD" for r in ph)


def test_kruskal_and_pairwise_u(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": np.r_[rng.exponential(1, 40), rng.exponential(4, 40), rng.exponential(9, 40)].round(1),
                        "g": ["a"] * 40 + ["b"] * 40 + ["c"] * 40})
    res = run_battery(spark, pdf, ["x"], ["g"])
    t = res["tests"].first()
    assert t["method"] == "Kruskal-Wallis"
    r = pdf.x.rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.g == k].sum() ** 2 / 40 for k in "abc") - 3 * (n + 1)
    ties = pdf.x.value_counts()
    h /= 1 - ((ties ** 3 - ties).sum() / (n ** 3 - n))
    assert t["statistic"] == pytest.approx(h)
    assert t["effect_size"] == pytest.approx(round(h, 3) / (n - 1))
    ph = res["posthoc"].collect()
    assert ph and all(row["method"] == "Mann-Whitney U (Bonferroni)" for row in ph)


def test_small_level_filters(spark):
    # levels of 4, 5 and 6 rows: 4 is dropped for the test (rows < 5)
    pdf = pd.DataFrame({"x": [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
                        "g": ["a"] * 4 + ["b"] * 5 + ["c"] * 6})
    t = run_battery(spark, pdf, ["x"], ["g"])["tests"].first()
    assert t["n_groups"] == 3 and t["k_tested"] == 2 and t["n_total"] == 11


def test_all_tied_gives_null_statistic(spark):
    pdf = pd.DataFrame({"x": [1.0] * 100, "g": ["a"] * 50 + ["b"] * 50})
    t = run_battery(spark, pdf, ["x"], ["g"])["tests"].first()
    assert t["method"] == "t-test"             # constant groups: Shapiro W = 1
    assert t["statistic"] is None and t["p_raw"] is None


def test_bonferroni_uses_rounded_p(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "y": rng.normal(size=200),
                        "g": (["a", "b"] * 100)})
    t = run_battery(spark, pdf, ["x", "y"], ["g"])["tests"].collect()
    assert all(r["bonferroni_alpha"] == pytest.approx(0.025) for r in t)
    assert all(r["significant_bonferroni"] == (r["p_value"] < 0.025) for r in t)


def test_ols_two_feature_closed_form(spark):
    rng = np.random.default_rng(4)
    x1, x2 = rng.normal(size=500), rng.normal(size=500)
    y = 2 * x1 - x2 + rng.normal(size=500)
    df = frame(spark, {"y": y, "x1": x1, "x2": x2})
    res = RG.driver_analysis(df, ["y", "x1", "x2"], [], ["y"])
    beta = {r["feature"]: r["coefficient"] for r in res["drivers"].collect()}
    z = lambda v: (v - v.mean()) / v.std()
    X = np.c_[np.ones(500), z(x1), z(x2)]
    coef = np.linalg.lstsq(X, z(y), rcond=None)[0]
    assert beta["x1"] == pytest.approx(coef[1]) and beta["x2"] == pytest.approx(coef[2])
    m = res["models"].first()
    resid = z(y) - X @ coef
    assert m["r_squared"] == pytest.approx(1 - (resid ** 2).sum() / 500)


def test_collinear_and_short_model(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=100)
    df = frame(spark, {"y": x + rng.normal(size=100), "x": x, "x2": 2 * x})
    m = RG.driver_analysis(df, ["y", "x", "x2"], [], ["y"])["models"].first()
    assert m["collinear"] and m["redundant_features"] == ["x2"] and m["r_squared"] < 1
    d = {r["feature"]: r for r in RG.driver_analysis(df, ["y", "x", "x2"], [], ["y"])["drivers"].collect()}
    only = RG.driver_analysis(df, ["y", "x"], [], ["y"])["drivers"].first()
    assert (d["x2"]["coefficient"], d["x2"]["std_error"], d["x2"]["redundant"]) == (0.0, None, True)
    assert (d["x"]["coefficient"], d["x"]["std_error"]) == pytest.approx((only["coefficient"], only["std_error"]))
    short = frame(spark, {"y": rng.normal(size=29), "x": rng.normal(size=29)})
    assert RG.driver_analysis(short, ["y", "x"], [], ["y"])["models"].count() == 0


def test_kpi_targets(spark):
    names = ["Age", "Purchase_Amount_(USD)", "Review_Rating", "Previous_Purchases", "Order_Count"]
    assert RG.kpi_targets(spark, names) == names[1:]
    assert RG.kpi_targets(spark, names, opts=REFERENCE_CAPS) == names[1:4]
    assert RG.kpi_targets(spark, ["a", "b", "c", "d"]) == ["a", "b", "c", "d"]
    assert RG.kpi_targets(spark, ["a", "b", "c", "d"], opts=REFERENCE_CAPS) == ["a", "b", "c"]
    assert RG.kpi_targets(spark, ["a", "b"], ["x", "b", "a"]) == ["b", "a"]


def test_blobs_choose_three(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0], [10, 0], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.5, size=(100, 2)) for c in centers])
    df = frame(spark, {"a": pts[:, 0], "b": pts[:, 1]})
    seg = SG.segment(df, ["a", "b"], Options(max_k=6))
    s = seg["summary"].first()
    assert s["k_optimal"] == 3 and s["silhouette_quality"] == "good"
    sizes = sorted(r["size"] for r in seg["profile"].collect())
    assert sizes == [100, 100, 100]
    inertia = [r["inertia"] for r in seg["k_table"].orderBy("k").collect()]
    assert all(a >= b for a, b in zip(inertia, inertia[1:]))


def test_elbow_rule(spark):
    def chosen(inertia, silhouette=()):
        rows = [(i + 1, float(v), silhouette[i - 1] if 0 < i <= len(silhouette) else None) for i, v in enumerate(inertia)]
        return tuple(SG.choose_k(spark.createDataFrame(rows, "k int, inertia double, silhouette double")).first())

    assert chosen([100, 50, 40, 35]) == (2, 2, 2)
    assert chosen([100, 90]) == (3, 3, 3)
    assert chosen([100, 50, 20, 18, 17], [0.5, 0.6, 0.4, 0.3]) == (3, 3, 3)
    assert chosen([100, 90, 80, 20, 18, 17], [0.5, 0.48, 0.47, 0.3, 0.2]) == (4, 4, 2)   # within 0.05 of the best
    assert chosen([100, 90, 80, 20, 18, 17], [0.6, 0.48, 0.47, 0.3, 0.2]) == (2, 4, 2)


def test_small_levels_give_empty_tables(spark):
    df = spark.createDataFrame([(float(i), f"g{i}") for i in range(5)], "x double, g string")
    res = H.group_comparison(df, ["x"], ["g"], {"g": 5})
    assert {k: v.count() for k, v in res.items() if k != "moments"} == {
        "tests": 0, "normality": 0, "group_means": res["group_means"].count(), "posthoc": 0}


def test_base_level_is_the_smallest_number(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, {"y": rng.normal(size=60), "f": [9.0, 10.0] * 30})
    names = {r["feature"] for r in RG.driver_analysis(df, ["y", "x"], ["f"], ["y"])["drivers"].collect()} \
        if "x" in df.columns else set(RG._levels(df, F.lit(True), ["f"])["f"][1:])
    assert names == {"10.0"}


def test_whiskers_stay_outside_the_box(spark):
    df = frame(spark, {"x": [0.0, 0.0, 0.0, 1000.0]})
    from tablelens.operators.describe import box_table
    r = box_table(df, [(0, "x")]).first()
    assert (r["q3"], r["whisker_high"], r["whisker_low"]) == (250.0, 250.0, 0.0)


def test_crosstab_with_awkward_levels(spark):
    from tablelens.operators.grouped import crosstab
    df = spark.createDataFrame([("a", "row_level"), ("b", "x`y"), ("a", "row_level")], "r string, c string")
    got = {(r.row_level, r.col_level): r["count"] for r in crosstab(df, "r", "c").collect()}
    assert got == {("a", "row_level"): 2, ("a", "x`y"): 0, ("b", "row_level"): 0, ("b", "x`y"): 1}


def test_one_ordered_pass_for_tests_and_posthoc(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.exponential(size=300), "g": rng.choice(list("abc"), 300), "h": rng.choice(list("uvw"), 300)})
    pdf["x"] += (pdf["g"] == "a") * 2.0 + (pdf["h"] == "u") * 2.0
    passes, inner = [], H.win_matrix
    monkeypatch.setattr(H, "win_matrix", lambda *a: passes.append(a) or inner(*a))
    res = H.group_comparison(spark.createDataFrame(pdf), ["x"], ["g", "h"], {"g": 3, "h": 3}, Options())
    got = {(r["categorical"], r["group1"], r["group2"]): r["statistic"] for r in res["posthoc"].collect()}
    assert len(passes) == 1 and len(got) == 6
    for (c, a, b), u in got.items():
        x, y = (pdf["x"][pdf[c] == lv].to_numpy() for lv in (a, b))
        assert u == (x[:, None] > y).sum()


def test_moments_are_one_set_of_aggregates(spark, monkeypatch):
    """As many aggregates for twelve numerics as for one: wider ones are not compiled."""
    plans = []
    monkeypatch.setattr(H, "stable", lambda df: plans.append(df) or df)
    df = spark.createDataFrame([(g, *[float(g * i) for i in range(12)]) for g in range(9)], ["g", *[f"x{i}" for i in range(12)]])
    got = H.moment_table(df, [f"x{i}" for i in range(12)], ["g"])
    assert got.count() == 108
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("kurtosis(") == 1


def test_ranks_are_joined_once(spark, monkeypatch):
    """The means of ranks are known, and a column with more values than a broadcast holds is joined with its frequent ones spread."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 400, 900).astype(float), "b": rng.integers(0, 5, 900).astype(float),
                        "c": np.where(rng.random(900) < .2, np.nan, rng.random(900))})
    df = spark.createDataFrame(pdf).select("a", "b", F.when(~F.isnan("c"), F.col("c")).alias("c"))
    given, inner = [], C.pairwise_corr
    monkeypatch.setattr(C, "pairwise_corr", lambda *a, **k: given.append(k.get("means")) or inner(*a, **k))
    monkeypatch.setattr(C, "BROADCAST_ROWS", 10)
    got = {(r["i"], r["j"]): r["spearman"] for r in C.spearman(df, [(0, "a"), (1, "b"), (2, "c")]).collect()}
    assert given and all(m is not None for m in given)
    want = pdf.corr("spearman").to_numpy()
    for (i, j), s in got.items():
        assert s == pytest.approx(want[i, j], abs=1e-12)


def test_cluster_rows_are_dealt_out(spark, monkeypatch):
    """k-means passes run in many tasks although the input is one partition."""
    from tablelens.operators import kmeans
    files, inner = [], kmeans.sweep
    monkeypatch.setattr(kmeans, "sweep", lambda z, *a: files.append(len(z.inputFiles())) or inner(z, *a))
    df = spark.range(500).selectExpr("cast(id % 7 as double) x", "cast(id % 11 as double) y").coalesce(1)
    assert SG.segment(df, ["x", "y"], Options(), k=2) is not None
    assert files[0] > 1


def test_tied_centroids_take_the_first(spark):
    from tablelens.operators import kmeans
    z = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "z0 double")
    got = kmeans._partial_sums(z, ["z0"], [np.array([[1.0], [-1.0]]), np.array([[0.0], [0.0]])], True)
    assert [got[i][0] for i in sorted(got)] == [2, 1, 3] and sorted(got) == [0, 1, 2]


def _ordered_points(n: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed).random((n, 3))
    return x[np.lexsort((x * 16).astype(int).T)]


def test_cluster_sums_compare_few_rows(monkeypatch):
    """Rows of a box that one centroid owns are added as a whole: the same sums with a small part of the comparisons."""
    from tablelens.operators import kmeans
    x, rng, compared, inner = _ordered_points(262_144, 5), np.random.default_rng(6), [], kmeans._nearest_rows
    monkeypatch.setattr(kmeans, "_nearest_rows", lambda y, stack, *a: compared.append(y.shape[1] * len(stack)) or inner(y, stack, *a))
    centers = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 5, 5, 9, 9)]
    stack, model = np.vstack(centers), np.repeat(np.arange(6), [len(c) for c in centers])
    sums = np.zeros((len(stack), 6))
    for part in (*np.split(x[:229_376], 7), x[229_376:262_100], x[262_100:]):         # the last but one ends in less than a block
        kmeans._add_sums(sums, part, stack, model)
    assert sum(compared) < len(x) * len(stack) / 2
    for at, c in zip(np.cumsum([0, 1, 2, 5, 5, 9]), centers):
        own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        for i in range(len(c)):
            mine = x[own == i]
            assert sums[at + i, :-1] == pytest.approx([len(mine), *mine.sum(0), (mine ** 2).sum()])


def test_cluster_sums_of_ties_and_far_rows():
    from tablelens.operators import kmeans
    rng = np.random.default_rng(7)
    for x in (rng.integers(0, 3, (5_000, 2)).astype(float), rng.normal(size=(5_000, 2)) * 1e-3 + 100, np.ones((700, 2)),
              np.vstack([rng.normal(size=(3_000, 2)), np.full((1, 2), 1e6)])):
        stack = np.vstack([x[[0, 1, 2]], x[[0, 0, 3]], x[-2:]])    # equal centroids too
        model = np.array([0, 0, 0, 1, 1, 1, 2, 2])
        sums = np.zeros((8, 5))
        kmeans._add_sums(sums, x, stack, model)
        for m in range(3):
            c = stack[model == m]
            own = ((c * c).sum(1)[:, None] - 2 * c @ x.T).argmin(0)
            assert list(sums[model == m, 0]) == list(np.bincount(own, minlength=len(c)))


def test_cluster_rows_follow_near_rows(spark, monkeypatch):
    """Passes read packed records of rows in order of place, with the values and numbers of the table."""
    from tablelens.operators import kmeans
    x = np.random.default_rng(8).random((4_000, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    held, inner = [], kmeans.sweep
    monkeypatch.setattr(kmeans, "sweep", lambda z, *a: held.append(z) or inner(z, *a))
    assert SG.segment(df, list("abc"), Options(kmeans_restarts=2), k=3) is not None
    cols = ["z0", "z1", "z2"]
    for part in held[0].select(kmeans.in_order(cols).alias("k"), F.spark_partition_id().alias("p"), F.input_file_name().alias("f")) \
            .groupBy("f").agg(F.collect_list("k").alias("ks")).collect():
        assert part.ks == sorted(part.ks)
    records = kmeans.packed(held[0], cols)
    got = {}
    for r in records.collect():
        got.update(zip(np.frombuffer(r.rows, np.int64).tolist(), map(tuple, np.frombuffer(r.points).reshape(-1, 3))))
    assert records.count() < 400 and got == {r[0]: tuple(r[1:]) for r in held[0].select("row", *cols).collect()}


def test_cluster_draws_are_the_least_keys(spark):
    """Draws that skip rows too near to matter are those of all keys."""
    from tablelens.operators import kmeans
    x = _ordered_points(3_000, 9)
    z = spark.createDataFrame(pd.DataFrame(x, columns=["z0", "z1", "z2"])).withColumn("row", F.monotonically_increasing_id()).coalesce(1)
    rows = z.select("row", "z0", "z1", "z2").collect()
    row, x = np.array([r[0] for r in rows]), np.array([list(r)[1:] for r in rows])
    known = {1: np.empty((0, 3)), 2: x[[5, 1_700]]}
    got = kmeans._draw(kmeans.packed(z, ["z0", "z1", "z2"]), ["z0", "z1", "z2"], known, 12, 1)
    for s, c in known.items():
        key = -np.log(kmeans._uniform(row, s, 1)) / (kmeans._squared(x, c).min(1) if len(c) else 1.0)
        assert sorted(map(tuple, got[s][len(c):])) == sorted(map(tuple, x[np.argsort(key)[:12]]))
