"""Win matrix, multi-model k-means, gated roles, the nested record, sinks and ranked views against brute force."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import drivers as RG
from tablelens.operators import hypothesis as H
from tablelens.operators import kmeans as KM
from tablelens.operators import records as RC
from tablelens.operators import roles as RL
from tablelens.operators import segment as SG
from tablelens.options import Options
from tablelens.session import scratch, stable
from tablelens.sources import sinks


def test_win_matrix_counts_pairs(spark):
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"x": rng.integers(0, 12, n).astype(float), "y": rng.normal(size=n).round(1), "g": rng.choice(list("abcd"), n)})
    pdf.loc[::9, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    groups = {(0, 0): ["a", "b", "c"], (1, 0): ["b", "d", "e"]}            # a level that does not occur has no values
    got = {(r["num"], r["a"], r["b"]): r for r in H.win_matrix(df, ["x", "y"], ["g"], groups).collect()}
    for (i, _), levels in groups.items():
        v = {lv: pdf["xy"[i]][(pdf.g == lv)].dropna().to_numpy() for lv in levels}
        for a in levels:
            for b in levels:
                r, one, two = got[(i, a, b)], v[a][:, None], v[b][None, :]
                assert r["u"] == (one > two).sum() + (one == two).sum() / 2
                assert (r["n_a"], r["n_b"]) == (len(v[a]), len(v[b]))
                if a != b:
                    t = pd.Series(np.r_[v[a], v[b]]).value_counts()
                    assert r["tie"] == (t ** 3 - t).sum()
    st = {r["num"]: r for r in H.rank_statistics(H.win_matrix(df, ["x", "y"], ["g"], groups)).collect()}
    assert st[0]["k_ranked"] == 3 and st[1]["k_ranked"] == 2 and st[1]["n_ranked"] == sum(len(v[x]) for x in "bd")


def test_all_models_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    z = stable(spark.createDataFrame(pd.DataFrame(x, columns=["z0", "z1"])).withColumn("row", F.monotonically_increasing_id()))
    start = [KM.Model(k, 0, x[:k].copy()) for k in (2, 3)]
    KM.lloyd(z, ["z0", "z1"], start, 5, 0.0)
    KM.evaluate(z, ["z0", "z1"], start)
    for m, k in zip(start, (2, 3)):                                # the same iterations, one model at a time
        c = x[:k].copy()
        for _ in range(5):
            own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        d = np.sqrt(((x[:, None] - c) ** 2).sum(2))
        own = d.argmin(1)
        a = d[np.arange(len(x)), own]
        d[np.arange(len(x)), own] = np.inf
        b = d.min(1)
        assert m.centers == pytest.approx(c) and m.inertia == pytest.approx((a ** 2).sum())
        assert m.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean()) and list(m.sizes) == list(np.bincount(own, minlength=k))
    best = KM.sweep(z, ["z0", "z1"], [2, 3, 4], [1, 2], 50)
    again = KM.sweep(z.repartition(3), ["z0", "z1"], [2, 3, 4], [1, 2], 50)
    assert sorted(best[3].sizes) == [60, 60, 60] and best[4].inertia < best[3].inertia < best[2].inertia
    assert all(best[k].inertia == pytest.approx(again[k].inertia) for k in best)
    few = stable(spark.createDataFrame(pd.DataFrame({"z0": [0.0, 0.0, 1.0, 1.0], "z1": [0.0, 0.0, 1.0, 1.0]}))
                 .withColumn("row", F.monotonically_increasing_id()))
    assert KM.sweep(few, ["z0", "z1"], [3], [1], 10)[3].inertia == 0       # fewer points than centroids


def test_sweep_is_the_least_squares_solution():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] - 2 * x[:, 1]                                # a combination of two others
    y = x @ [1.0, 2.0, -1.0, 0.0] + rng.normal(size=200)
    a = np.cov(np.c_[x, y].T, bias=True)
    left = RG.sweep(a, [0, 1, 2, 3])
    used = [i for i in range(4) if i not in left]
    coef = np.linalg.lstsq(np.c_[np.ones(200), x[:, used]], y, rcond=None)[0]
    assert len(left) == 1 and left[0] != 2
    assert a[used, 4] == pytest.approx(coef[1:]) and 200 * a[4, 4] == pytest.approx(((y - np.c_[np.ones(200), x[:, used]] @ coef) ** 2).sum())


def test_gated_roles_equal_exact_roles(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({
        "two": rng.integers(0, 2, n), "three": rng.integers(0, 3, n), "many": rng.normal(size=n),
        "k15": [f"v{i % 15}" for i in range(n)], "k16": [f"v{i % 16}" for i in range(n)], "k101": [f"v{i % 101}" for i in range(n)],
        "near": [f"id{i}" if i < 2705 else "id0" for i in range(n)], "under": [f"id{i}" if i < 2690 else "id0" for i in range(n)],
        "unique": [f"id{i}" for i in range(n)], "day": [f"2024-01-{i % 28 + 1:02d}" for i in range(n)],
        "month": [["5 May 2020", "17 December 2021"][i % 2] for i in range(n)], "mixed": [["5 May 2020", "2020-05-05"][i % 2] for i in range(n)]})
    df = spark.createDataFrame(pdf)
    exact = {r["column"]: r for r in RL.column_roles(df).collect()}
    gated = {r["column"]: r for r in RL.column_roles(df, exact=False).collect()}
    assert {c: r["role"] for c, r in exact.items()} == {c: r["role"] for c, r in gated.items()} == {
        "two": "categorical", "three": "numeric", "many": "numeric", "k15": "categorical", "k16": "categorical", "k101": "categorical",
        "near": "id", "under": "categorical", "unique": "id", "day": "datetime", "month": "datetime", "mixed": "categorical"}
    assert all(gated[c]["n_distinct"] == exact[c]["n_distinct"] for c in ("two", "three", "k15", "k16", "near", "under"))
    assert not gated["many"]["distinct_exact"] and not gated["unique"]["distinct_exact"]


def test_record_comes_back_from_json(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(0, 1, 40), rng.normal(1, 1, 40), rng.normal(3, 1, 40)], "g": ["a"] * 40 + ["b"] * 40 + ["c"] * 40})
    res = H.group_comparison(spark.createDataFrame(pdf), ["x"], ["g"], {"g": 3}, Options())
    records = RC.test_records(res["tests"], res["normality"], res["posthoc"], res["group_means"])
    path = scratch(spark, "records")
    sinks.write_json(records, path)
    whole, back = records.first(), spark.read.schema(records.schema).json(path).first()
    assert back == whole
    assert [p["group2"] for p in whole["posthoc"]] == ["b", "c", "c"] and set(whole["group_means"]) == {"a", "b", "c"}
    lines = [json.loads(x.value) for x in spark.read.text(path).collect()]
    assert lines[0]["group_means"]["c"] == pytest.approx(pdf.x[80:].mean())


def test_ranked_views_and_stamp(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    top = {(r["g"], r["position"]): r["v"] for r in RC.ranked(df, [F.desc("v")], by=["g"], k=2).collect()}
    assert top == {("a", 1): 3.0, ("a", 2): 2.0, ("b", 1): 5.0}
    assert len(RC.stamped(df).first()["created"]) == 19
    assert RC.stamped(df, F.lit("2024-01-02 03:04:05").cast("timestamp")).first()["created"] == "2024-01-02 03:04:05"
    corrected = RC.bonferroni(spark.createDataFrame([(0.001,), (0.04,), (0.5,), (None,)], "p_raw double")).withColumn("v", RC.verdict())
    assert [r["v"] for r in corrected.orderBy("p_raw").collect()] == ["none", "corrected", "raw", "none"]


def test_principal_axes(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.3]])
    ratio, axes = SG.principal_components(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])), ["a", "b", "c"])
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    assert ratio == pytest.approx(list(values[::-1] / 3))
    assert np.abs((axes * vectors.T[::-1]).sum(axis=1)) == pytest.approx(np.ones(3)) and all(a[np.abs(a).argmax()] > 0 for a in axes)


def test_scratch_is_in_the_checkpoint_folder(spark):
    assert os.path.dirname(scratch(spark)) == spark.sparkContext.getCheckpointDir().rstrip("/")
