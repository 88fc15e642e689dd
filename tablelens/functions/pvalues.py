"""Arrow-batched pandas UDFs that turn test statistics into p-values.

They run over *result rows* (one per test / per pair of levels), never over
data rows, so the Python cost does not grow with the table.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import distributions as D


def _nan_to_none(v: float):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)


def _map(fn, *series: pd.Series) -> pd.Series:
    out = []
    for args in zip(*series):
        if any(a is None or (isinstance(a, float) and math.isnan(a)) for a in args):
            out.append(None)
        else:
            out.append(_nan_to_none(fn(*args)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _map(D.t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_sf_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _map(D.f_sf, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_sf_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return _map(D.chi2_sf, x, k)


@F.pandas_udf(T.DoubleType())
def tukey_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _map(lambda a, b, c: D.studentized_range_sf(a, int(b), c), q, k, df)


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie: pd.Series,
                   exact: pd.Series) -> pd.Series:
    return _map(lambda u, a, b, t, e: D.mann_whitney_p(u, int(a), int(b), t, bool(e)),
                u1, n1, n2, tie, exact.astype(float))


@F.pandas_udf(T.DoubleType())
def rank_effect_r(p: pd.Series, n: pd.Series) -> pd.Series:
    """|Z| / sqrt(N) with Z from the two-sided p (floor 1e-10)."""
    return _map(lambda pv, nv: abs(D.norm_ppf(max(pv / 2.0, 1e-10))) / math.sqrt(nv), p, n)
