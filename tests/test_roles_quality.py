"""Role detection, quality report and sources on hand-made frames (FIXTURES.md §D)."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest

from tablelens.operators import quality as QY
from tablelens.operators import roles as RL
from tablelens.operators import selection
from tablelens.operators.ranks import rank_table, unpivot
from tablelens.options import Options
from tablelens.sources import normalise, read_csv


def roles_of(spark, pdf, schema=None):
    df = normalise(spark.createDataFrame(pdf, schema=schema))
    _, info = RL.detect(df, Options())
    return {c["column"]: c["role"] for c in info.columns}, info


def test_all_null_constant_boolean(spark):
    pdf = pd.DataFrame({"a": [None] * 6, "b": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
                        "c": [7.0] * 6, "f": [True, False] * 3})
    r, info = roles_of(spark, pdf, "a double, b double, c double, f boolean")
    assert r == {"a": "none", "b": "numeric", "c": "categorical", "f": "categorical"}
    assert info.n_cols == 4 and info.missing("a") == 6
    assert "c" not in info.eligible_categorical(Options())       # one level only


def test_nan_is_null(spark):
    pdf = pd.DataFrame({"x": [1.0, float("nan"), None, 4.0, 5.0], "g": list("aabbc")})
    df = normalise(spark.createDataFrame(pdf, "x double, g string"))
    m = {r["column"]: r["n_missing"] for r in QY.missing_report(df).collect()}
    assert m == {"x": 2}


def test_id_threshold_is_strict(spark):
    n = 110
    hundred = [f"k{i % 100}" for i in range(n)]       # 100 distinct: not > 100 → categorical
    hundred_one = [f"k{i % 101}" for i in range(n)]   # 101 distinct, ratio .918 → id
    pdf = pd.DataFrame({"a": hundred, "b": hundred_one})
    r, _ = roles_of(spark, pdf, "a string, b string")
    assert r == {"a": "categorical", "b": "id"}


def test_text_and_dates(spark):
    long_text = ["word " * 20 + str(i % 3) for i in range(30)]
    dates = [f"2024-01-{(i % 28) + 1:02d}" for i in range(30)]
    mixed = ["2024-01-01", "yesterday"] * 15
    pdf = pd.DataFrame({"t": long_text, "d": dates, "m": mixed})
    r, _ = roles_of(spark, pdf, "t string, d string, m string")
    assert r == {"t": "text", "d": "datetime", "m": "categorical"}


def test_duplicates_and_summary(spark):
    pdf = pd.DataFrame({"a": [1, 1, 2, None, None], "b": ["x", "x", "y", "z", "z"]})
    df = spark.createDataFrame(pdf, "a double, b string")
    s = RL.table_summary(normalise(df)).first()
    assert (s["n_rows"], s["n_cols"], s["n_duplicate_rows"], s["n_missing_cells"]) == (5, 2, 2, 2)
    # (null, x) and (x, null) are different rows
    df2 = spark.createDataFrame([(None, "1"), ("1", None)], "a string, b string")
    assert RL.table_summary(df2).first()["n_duplicate_rows"] == 0


def test_dirty_csv(spark, case_sensitive):
    d = tempfile.mkdtemp(prefix="tablelens-test-")
    path = os.path.join(d, "dirty.csv")
    with open(path, "w") as fh:
        fh.write(' Age ,age,Purchase Amount (USD),a.b,note\n')
        fh.write('20,1,10.5,x,"said ""hi"""\n')
        fh.write('NA,2,N/A,y,plain\n')
        fh.write('35,3,12.0,,"multi\nline"\n')
    with pytest.raises(ValueError, match="differ by case only"):    # Spark's own reader would call them Age0, age1
        normalise(spark.createDataFrame([(1, 2)], "Age int, b int").toDF("Age", "age"))
    case_sensitive(True)
    df = read_csv(spark, path, multi_line=True)
    assert df.columns == ["Age", "age", "Purchase_Amount_(USD)", "a.b", "note"]
    types = dict(df.dtypes)
    assert types["Age"] == "bigint" and types["Purchase_Amount_(USD)"] == "double" and types["a.b"] == "string"
    rows = df.orderBy("age").collect()
    assert rows[1]["Age"] is None and rows[1]["Purchase_Amount_(USD)"] is None
    assert rows[0]["note"] == 'said "hi"' and rows[2]["a.b"] is None


def test_quantiles_match_numpy_with_ties_and_nulls(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=997) * 3).astype(float)
    y = rng.exponential(size=997)
    y[::7] = np.nan
    hot = np.where(rng.random(997) < 0.5, 0.0, rng.normal(size=997))            # one value holds half of the rows
    half = np.repeat([0.0, 1.0], 499)[:997]                                     # the median's bracket cannot shrink
    df = normalise(spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "hot": hot, "half": half})))
    long = unpivot(df, list(enumerate(["x", "y", "hot", "half"])))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    for grid, limit in [(selection.GRID, selection.LIMIT), (10, 5)]:            # whole groups, then two or three narrowings
        monkeypatch.setattr(selection, "GRID", grid)
        monkeypatch.setattr(selection, "ACCURACY", 10 * grid)
        got = {r["ordinal"]: r for r in selection.quantiles(long, ["ordinal"], probs, limit=limit).collect()}
        for i, v in enumerate([x, y[~np.isnan(y)], hot, half]):
            assert got[i]["n"] == len(v)
            assert [got[i][f"q_{k}"] for k in range(len(probs))] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=1e-15)
        box = {r["ordinal"]: r for r in selection.box_stats(long, ["ordinal"]).collect()}
        q1, q3 = np.quantile(hot, [0.25, 0.75])
        inside = hot[(hot >= q1 - 1.5 * (q3 - q1)) & (hot <= q3 + 1.5 * (q3 - q1))]
        assert (box[2]["n_fliers"], box[2]["whisker_low"], box[2]["whisker_high"]) == (len(hot) - len(inside), min(inside.min(), q1),
                                                                                     max(inside.max(), q3))
    assert "rangepartitioning" not in selection.quantiles(long, ["ordinal"], probs)._jdf.queryExecution().toString()
    assert selection.quantiles(long.limit(0), ["ordinal"], probs).count() == 0


def test_midranks_equal_pandas(spark):
    x = np.round(np.random.default_rng(3).normal(size=997) * 3).astype(float)
    df = normalise(spark.createDataFrame(pd.DataFrame({"x": x})))
    rt = rank_table(unpivot(df, [(0, "x")]), ["ordinal"], num_partitions=5, max_key_groups=2)
    ranks = {r["value"]: r["below"] + (r["cnt"] + 1) / 2 for r in rt.collect()}
    assert all(ranks[v] == pytest.approx(e) for v, e in zip(x, pd.Series(x).rank()))


def test_outliers(spark):
    vals = [float(v) for v in range(1, 21)] + [100.0, -80.0]
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    r = QY.outlier_report(df, [(0, "v")]).first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert r["n_outliers"] == 2
    assert r["lower_bound"] == pytest.approx(q1 - 1.5 * (q3 - q1))
    assert r["severity"] == "medium"          # 2/22 = 9.1 % > 3 and not > 10
