"""The shared formula expressions, normality at any size, and empty stages."""

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import hypothesis as H
from tablelens.options import Options


def test_jarque_bera_covers_large_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(size=3000), rng.exponential(size=3000), np.ones(10), [1.0, 2.0]],
                        "g": ["n"] * 3000 + ["e"] * 3000 + ["c"] * 10 + ["t"] * 2})
    rows = {r["level"]: r for r in H.jarque_bera(H.moment_table(spark.createDataFrame(pdf), ["x"], ["g"])).collect()}
    for level in "ne":
        x = pdf.x[pdf.g == level].to_numpy()
        z = (x - x.mean()) / x.std()
        jb = len(x) / 6 * ((z ** 3).mean() ** 2 + ((z ** 4).mean() - 3) ** 2 / 4)
        assert rows[level]["jb"] == pytest.approx(jb)
    assert rows["n"]["jb_p"] > 0.05 > rows["e"]["jb_p"]
    assert rows["c"]["jb_p"] == 1.0 and rows["t"]["jb_p"] is None


def test_large_skewed_groups_get_a_rank_test_by_default(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.exponential(size=5000).round(2), "g": ["a", "b"] * 2500})
    df = spark.createDataFrame(pdf)
    method = {rule: H.group_comparison(df, ["x"], ["g"], {"g": 2}, Options(normality_rule=rule))["tests"].first()["method"]
              for rule in ("jarque_bera", "shapiro")}
    assert method == {"jarque_bera": "Mann-Whitney U", "shapiro": "t-test"}


def test_one_way_and_named_battery_agree(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=90), "g": ["a", "b", "c"] * 30})
    df = spark.createDataFrame(pdf)
    par = H.parametric(H.moment_table(df, ["x"], ["g"])).first()
    assert H.anova(df, "x", "g").first()["f"] == pytest.approx(par["f"])
    ab = H.ab_test(df, "x", "g", "a", "b").first()
    assert (ab["n1"], ab["n2"]) == (30, 30) and ab["t"] == pytest.approx(par["t"])
    assert H.ab_test(df, "x", "g", "none", "nil").first()["n1"] == 0


def test_no_columns_gives_five_empty_tables(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    res = H.group_comparison(df, [], ["g"], {"g": 1})
    assert set(res) == {"tests", "normality", "group_means", "posthoc", "moments"}
    assert all(t.count() == 0 for t in res.values())
    full = H.group_comparison(spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(20)], df.schema),
                              ["x"], ["g"], {"g": 2})
    for name, t in res.items():
        assert set(t.columns) == set(full[name].columns), name
