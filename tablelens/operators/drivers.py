"""Driver analysis: standardised OLS per KPI target (REG1–REG11).

The complete rows are the same for every target, so the stage scans them three times however
many targets there are: levels, means and one **Gram pass**.  That is the cross-products of the
mean-shifted numerics and dummies, added up per task (``mapInPandas``) and summed by ``(i, j)`` —
p(p+1)/2 partial sums per task, so the shuffle does not grow with the rows.  Each target's system
is a block of that p × p matrix, swept on the driver (p is the number of columns, not rows).
Features that are combinations of others are named, get no coefficient of their own and no test.

Standardisation (ddof 0) is applied algebraically to the covariances:
numerics and the target are z-scored, dummies stay 0/1, exactly as in the
reference; the intercept absorbs the means, so the slope block of
``inv(X_augᵀ X_aug)`` equals ``inv(n · Cov(X))``.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.distributions import f_sf, t_two_sided
from tablelens.options import Options
from tablelens.sources.tables import q

# KPI keywords matched as substrings of the lower-cased column name.
KPI_KEYWORDS = ["amount", "value", "revenue", "score", "rating", "spend", "purchase", "sales", "price",
                "cost", "roi", "rate", "conversion", "frequency", "order", "click"]


def kpi_targets(spark: SparkSession, numerics: list[str], targets: list[str] | None = None,
                opts: Options = Options()) -> list[str]:
    """Targets (REG1): the user's, as far as they are numeric, else the numerics whose
    name holds a KPI keyword, in table order; if there is none, the numerics
    (the first ``fallback_targets``, if given)."""
    names = spark.createDataFrame(list(enumerate(numerics)), "ordinal int, name string")
    if targets is not None:
        wanted = spark.createDataFrame(list(enumerate(targets)), "place int, name string")
        chosen = names.join(wanted, "name").orderBy("place")
    else:
        plain = F.lower(F.regexp_replace("name", "[()]", ""))
        marked = names.withColumn("kpi", plain.rlike("|".join(KPI_KEYWORDS)))
        some = F.max("kpi").over(Window.partitionBy())           # as many rows as numeric columns
        early = F.lit(True) if opts.fallback_targets is None else F.col("ordinal") < opts.fallback_targets
        chosen = marked.withColumn("some", some).where("kpi OR NOT some").where(F.col("some") | early).orderBy("ordinal")
    if opts.max_targets is not None:
        chosen = chosen.limit(opts.max_targets)
    return [r.name for r in chosen.collect()]


def _levels(df: DataFrame, complete, cats: list[str]) -> dict[str, list[str]]:
    """Sorted levels of each categorical among the complete rows (bounded: eligible columns)."""
    if not cats:
        return {}
    structs = [F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v")) for c in cats]
    rows = (df.where(complete).select(F.inline(F.array(*structs))).distinct().collect())
    out: dict[str, list[str]] = {c: [] for c in cats}
    for r in rows:
        out[r["c"]].append(r["v"])
    # in the order of the column's own type: 9 before 10
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return {c: sorted(v, key=float) if c in numeric else sorted(v) for c, v in out.items()}


def _gram_batches(df: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Shift by the means, then XᵀX per task, summed by (i, j): rows, means and covariances (ddof 0)."""
    p = len(names)
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"f{i}")).alias(f"m{i}") for i in range(p)]).first()
    n = first["n"]
    shift = np.array([first[f"m{i}"] or 0.0 for i in range(p)])
    cols = [f"f{i}" for i in range(p)]

    def partial(batches):
        g, s = np.zeros((p, p)), np.zeros(p)
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float) - shift
            g += x.T @ x
            s += x.sum(axis=0)
        iu = np.triu_indices(p)
        yield pd.DataFrame({"i": np.concatenate([iu[0], np.full(p, -1)]).astype("int32"),
                            "j": np.concatenate([iu[1], np.arange(p)]).astype("int32"),
                            "s": np.concatenate([g[iu], s])})

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("s", T.DoubleType())])
    sums = df.select(*cols).mapInPandas(partial, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    g = np.zeros((p, p))
    s = np.zeros(p)
    for r in sums:
        if r["i"] == -1:
            s[r["j"]] = r["s"]
        else:
            g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    cov = (g - np.outer(s, s) / n) / n
    return n, shift + s / n, cov


def sweep(a: np.ndarray, over: list[int], tolerance: float = 1e-9) -> list[int]:
    """Sweeps the symmetric matrix ``a`` in place over the given rows, best conditioned first; returns those left out.

    Before each step the remaining diagonal over the first one is the share of a feature that the swept ones do not
    explain.  A feature with no more than ``tolerance`` of it is redundant: a combination of the swept ones.
    Swept rows hold the inverse of their block and, against the other rows, the regression coefficients."""
    start, left = np.diag(a).copy(), list(over)
    while left:
        share = np.array([a[i, i] / start[i] if start[i] > 0 else 0.0 for i in left])
        at = int(share.argmax())                                  # the first of equal ones
        if share[at] <= tolerance:
            break
        k = left.pop(at)
        pivot, row = a[k, k], a[k].copy()
        a -= np.outer(row, row) / pivot
        a[k], a[:, k] = row / pivot, row / pivot
        a[k, k] = -1.0 / pivot
    return left


def fit_standardised_ols(n: int, cov: np.ndarray, kinds: list[str], names: list[str]) -> dict:
    """OLS of the z-scored target (last column of ``cov``) on the features, by sweeping them out."""
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    scale = np.where((np.array(kinds) == "num") & (sd > 0), sd, 1.0)
    z = cov / np.outer(scale, scale)
    p, sst = len(names), n * z[-1, -1]
    redundant = sweep(z, list(range(p))) if sst > 0 else list(range(p))
    used = np.array([i not in redundant for i in range(p)])
    beta = np.where(used, z[:-1, -1], 0.0)
    ssr = max(n * z[-1, -1], 0.0)
    r2 = 1.0 - ssr / sst if sst > 0 else 0.0
    rank = int(used.sum())
    dfe = n - rank - 1
    adj = 1 - (1 - r2) * (n - 1) / dfe
    f_stat = (r2 / rank) / ((1 - r2) / dfe) if 0 < r2 < 1 and rank else 0.0
    mse = ssr / dfe
    se = np.sqrt(np.clip(-np.diag(z)[:-1] * mse / n, 0.0, None))
    t = beta / np.maximum(se, 1e-10)
    pv = [t_two_sided(float(abs(x)), float(dfe)) for x in t]
    return {"beta": beta, "se": se, "t": t, "p": pv, "r2": r2, "adj_r2": adj, "f": f_stat,
            "f_p": f_sf(f_stat, rank, dfe) if f_stat > 0 else 1.0,   # a perfect fit has no F, as in the reference
            "redundant": ~used, "rank": rank}


_MODEL_SCHEMA = ("target string, n_samples long, n_features int, r_squared double, adj_r_squared double, "
                 "f_statistic double, f_pvalue double, model_significant boolean, collinear boolean, redundant_features array<string>")
_DRIVER_SCHEMA = ("target string, feature string, coefficient double, std_error double, t_statistic double, "
                  "p_value double, significant boolean, abs_importance double, redundant boolean")


def driver_analysis(df: DataFrame, numerics: list[str], eligible_cats: list[str],
                    targets: list[str] | None = None, opts: Options = Options()) -> dict[str, DataFrame]:
    """Per target: model table row + ranked drivers (REG1–REG10)."""
    spark = df.sparkSession
    models, drivers = [], []
    wanted = kpi_targets(spark, numerics, targets, opts) if len(numerics) >= 2 else []
    if wanted:
        cats = eligible_cats[:opts.max_onehot_features]
        complete = F.lit(True)
        for c in numerics + cats:
            complete = complete & q(c).isNotNull()
        levels = _levels(df, complete, cats)
        dummies = [(c, lv) for c in cats for lv in levels[c][1:]]        # without the first sorted level
        names = numerics + [f"{c}_{lv}" for c, lv in dummies]
        kinds = np.array(["num"] * len(numerics) + ["dummy"] * len(dummies))
        exprs = [q(c).cast("double") for c in numerics] + [
            F.when(q(c).cast("string") == lv, F.lit(1.0)).otherwise(F.lit(0.0)) for c, lv in dummies]
        n, _, cov = _gram_batches(df.where(complete).select(*[e.alias(f"f{i}") for i, e in enumerate(exprs)]), names)
        p = len(names) - 1
        if n < opts.min_model_rows or p >= n - 1:
            wanted = []
        for target in wanted:
            at = numerics.index(target)
            block = [i for i in range(len(names)) if i != at] + [at]
            feats = [names[i] for i in block[:-1]]
            fit = fit_standardised_ols(n, cov[np.ix_(block, block)], list(kinds[block]), feats)
            models.append((target, int(n), p, float(fit["r2"]), float(fit["adj_r2"]), float(fit["f"]),
                           float(fit["f_p"]), bool(fit["f_p"] < opts.alpha), bool(fit["redundant"].any()),
                           [feats[i] for i in np.flatnonzero(fit["redundant"])]))
            for i, name in enumerate(feats):
                out, pv = bool(fit["redundant"][i]), fit["p"][i]
                drivers.append((target, name, float(fit["beta"][i]), None if out else float(fit["se"][i]),
                                None if out else float(fit["t"][i]), None if out else float(pv), bool(pv < opts.alpha) and not out,
                                abs(float(fit["beta"][i])), out))
    model_df = spark.createDataFrame(models, _MODEL_SCHEMA)
    drv = spark.createDataFrame(drivers, _DRIVER_SCHEMA)
    w = Window.partitionBy("target").orderBy(F.desc("abs_importance"), F.asc("feature"))
    drv = drv.withColumn("rank", F.row_number().over(w))
    return {"models": model_df, "drivers": drv}


def top_drivers(drivers: DataFrame, k: int = 15) -> DataFrame:
    """Chart data: the k strongest drivers per target (REG11, LIM1)."""
    return drivers.where(F.col("rank") <= k)
