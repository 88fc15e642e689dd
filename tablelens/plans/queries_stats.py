"""Contract queries: grouped tables, correlation, tests, regression, segments, findings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablelens.operators import correlate as C
from tablelens.operators import describe as D
from tablelens.operators import drivers as RG
from tablelens.operators import grouped as G
from tablelens.operators import hypothesis as H
from tablelens.operators import roles as RL
from tablelens.operators import segment as SG
from tablelens.options import Options
from tablelens.plans import scripts as S
from tablelens.plans.analyze import analyze
from tablelens.plans.contract import R, cols_of, query, rnd, table
from tablelens.plans.queries_profile import LINEITEM_NUMERIC

ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_CATS = ["o_orderstatus", "o_orderpriority"]


# ------------------------------------------------------------------ grouped tables
@query("group_mean_std_count", f"""
SELECT o_orderpriority AS level, round(avg(o_totalprice), {R}) AS mean, round(stddev_samp(o_totalprice), {R}) AS std,
       count(o_totalprice)::BIGINT AS count
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def q_group_mean_std_count(spark, sf):
    g = G.group_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return g.select("level", rnd("mean").alias("mean"), rnd("std").alias("std"), "count")


@query("group_means", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS numeric, '{c}' AS categorical, CAST({c} AS VARCHAR) AS level, count(*)::BIGINT AS rows, "
    f"count({n})::BIGINT AS n, round(avg(CAST({n} AS DOUBLE)), {R}) AS mean, "
    f"round(stddev_samp(CAST({n} AS DOUBLE)), {R}) AS std FROM orders WHERE {c} IS NOT NULL GROUP BY 3"
    for n in ORDERS_NUMERIC for c in ORDERS_CATS))
def q_group_means(spark, sf):
    mt = H.moment_table(table(spark, sf, "orders"), ORDERS_NUMERIC, ORDERS_CATS)
    return mt.select("numeric", "categorical", "level", "rows", "n", rnd("mean").alias("mean"),
                     rnd(F.sqrt("var")).alias("std"))


@query("crosstab", """
WITH r AS (SELECT DISTINCT o_orderstatus AS row_level FROM orders WHERE o_orderstatus IS NOT NULL
                                                         AND o_orderpriority IS NOT NULL),
c AS (SELECT DISTINCT o_orderpriority AS col_level FROM orders WHERE o_orderstatus IS NOT NULL
                                                       AND o_orderpriority IS NOT NULL),
n AS (SELECT o_orderstatus AS row_level, o_orderpriority AS col_level, count(*) AS cnt FROM orders
      WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2)
SELECT r.row_level, c.col_level, coalesce(n.cnt, 0)::BIGINT AS count
FROM r CROSS JOIN c LEFT JOIN n ON n.row_level = r.row_level AND n.col_level = c.col_level
""")
def q_crosstab(spark, sf):
    return G.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


# A level order for the reindex query (the last level does not occur).
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query("ordered_levels", "SELECT o.ord, o.level, c.count FROM (VALUES " + ", ".join(
    f"({i}, '{lv}')" for i, lv in enumerate(PRIORITY_ORDER)) + """) o(ord, level)
LEFT JOIN (SELECT o_orderpriority AS level, count(*)::BIGINT AS count FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1) c ON o.level = c.level
""")
def q_ordered_levels(spark, sf):
    return G.ordered_levels(table(spark, sf, "orders"), "o_orderpriority", PRIORITY_ORDER)


@query("value_share", f"""
SELECT event_type AS level, count(*)::BIGINT AS count,
       round(count(*) * 100.0 / sum(count(*)) OVER (), {R}) AS share_pct
FROM events WHERE event_type IS NOT NULL GROUP BY 1
""")
def q_value_share(spark, sf):
    v = G.value_share(table(spark, sf, "events"), "event_type")
    return v.select("level", "count", rnd("share_pct").alias("share_pct"))


_MODE_COLS = [("events", "event_type"), ("events", "user_id"), ("orders", "o_orderpriority"),
              ("lineitem", "l_quantity")]


@query("mode_values", "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
    f"count(*)::BIGINT AS count FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} ASC LIMIT 1)"
    for t, c in _MODE_COLS))
def q_mode_values(spark, sf):
    out = None
    for t, c in _MODE_COLS:
        m = D.mode(table(spark, sf, t), c).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                                                  F.col("value").cast("string").alias("value"), "count")
        out = m if out is None else out.unionByName(m)
    return out


@query("eda_key_figures", f"""
SELECT key, round(value, {R}) AS value, text FROM (
  SELECT 'n_rows' AS key, count(*)::DOUBLE AS value, NULL::VARCHAR AS text FROM orders
  UNION ALL SELECT 'mean_o_totalprice', avg(o_totalprice), NULL FROM orders
  UNION ALL SELECT 'min_o_totalprice', min(o_totalprice), NULL FROM orders
  UNION ALL SELECT 'max_o_totalprice', max(o_totalprice), NULL FROM orders
  UNION ALL SELECT 'pct_o_orderstatus_F', count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(o_orderstatus),
                   NULL FROM orders
  UNION ALL SELECT 'median_o_totalprice', quantile_cont(o_totalprice, 0.5), NULL FROM orders
  UNION ALL SELECT * FROM (SELECT 'mode_o_orderpriority', NULL::DOUBLE, o_orderpriority FROM orders
                           WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
                           ORDER BY count(*) DESC, o_orderpriority LIMIT 1))
""")
def q_eda_key_figures(spark, sf):
    kf = S.key_figures(table(spark, sf, "orders"), ["o_totalprice"], [("o_orderstatus", "F")], ["o_orderpriority"])
    return kf.select("key", rnd("value").alias("value"), "text")


# ------------------------------------------------------------------ correlation
def _pearson_sql(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)::BIGINT "
        f"AS n, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {R}) AS pearson FROM {tbl}"
        for a, b in combinations(cols, 2))


def _spearman_sql(src: str, cols: list[str], digits: int = R, extra: str = "") -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
                      for c in cols)
    body = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, corr(r_{a}, r_{b}) AS spearman FROM rk" for a, b in combinations(cols, 2))
    return f"WITH rk AS (SELECT {ranks} FROM {src}) SELECT col_i, col_j, round(spearman, {digits}) AS spearman FROM ({body})"


@query("pearson_matrix", _pearson_sql("lineitem", LINEITEM_NUMERIC))
def q_pearson_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    return C.pearson(li, cols_of(li, LINEITEM_NUMERIC)).select("col_i", "col_j", "n", rnd("pearson").alias("pearson"))


@query("spearman_matrix", _spearman_sql("lineitem", LINEITEM_NUMERIC))
def q_spearman_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    c = cols_of(li, LINEITEM_NUMERIC)
    s = C.spearman(li, c, {n: 0 for _, n in c})
    names = spark.createDataFrame(c, "i int, col_i string")
    names_j = spark.createDataFrame(c, "j int, col_j string")
    return s.join(names, "i").join(names_j, "j").select("col_i", "col_j", rnd("spearman").alias("spearman"))


def _pair_table_sql(src: str, cols: list[str], where: str) -> str:
    pear = "\nUNION ALL\n".join(
        f"SELECT '{a} × {b}' AS pair, corr({a}, {b}) AS p FROM src" for a, b in combinations(cols, 2))
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
                      for c in cols)
    spear = "\nUNION ALL\n".join(
        f"SELECT '{a} × {b}' AS pair, corr(r_{a}, r_{b}) AS s FROM rk" for a, b in combinations(cols, 2))
    return (f"WITH src AS ({src}), rk AS (SELECT {ranks} FROM src), pp AS ({pear}), ss AS ({spear}), "
            f"m AS (SELECT pp.pair, p, s FROM pp JOIN ss ON pp.pair = ss.pair) SELECT {{select}} FROM m WHERE {where}")


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


@query("strong_pairs", _pair_table_sql(
    "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part",
    _PART_NUM, "abs(p) > 0.3 OR abs(s) > 0.3").replace(
    "{select}", "pair, round(p, 3) AS pearson, round(s, 3) AS spearman, abs(p) > 0.3 AS pearson_strong"))
def q_strong_pairs(spark, sf):
    p = table(spark, sf, "part")
    corr = C.correlations(p, cols_of(p, _PART_NUM), {c: 0 for c in _PART_NUM})
    return C.strong_pairs(corr).select("pair", "pearson", "spearman", "pearson_strong")


_EVENT_NUM = ["event_id", "user_id", "value", "value_exp"]


@query("nonlinear_hints", _pair_table_sql(
    "SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id, value, "
    "exp(value / 60.0) AS value_exp FROM events",
    _EVENT_NUM, "abs(abs(p) - abs(s)) > 0.2").replace(
    "{select}", "pair, round(p, 3) AS pearson, round(s, 3) AS spearman, round(abs(abs(p) - abs(s)), 3) AS difference"))
def q_nonlinear_hints(spark, sf):
    e = table(spark, sf, "events").withColumn("value_exp", F.exp(F.col("value") / 60.0))
    corr = C.correlations(e, cols_of(e, _EVENT_NUM))
    return C.nonlinear_hints(corr).select("pair", "pearson", "spearman", "difference")


# ------------------------------------------------------------------ tests
@query("ttest", "\nUNION ALL\n".join(f"""
SELECT '{n}' AS numeric, n1, n2, round(m1, {R}) AS mean1, round(m2, {R}) AS mean2,
       round((m1 - m2) / sqrt(sp * (1.0 / n1 + 1.0 / n2)), {R}) AS t,
       round(abs(m1 - m2) / sqrt(sp), {R}) AS cohen_d
FROM (SELECT n1, n2, m1, m2, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp FROM (
  SELECT count({n}) FILTER (WHERE l_linestatus = 'F')::BIGINT AS n1, count({n}) FILTER (WHERE l_linestatus = 'O')::BIGINT AS n2,
         avg({n}) FILTER (WHERE l_linestatus = 'F') AS m1, avg({n}) FILTER (WHERE l_linestatus = 'O') AS m2,
         var_samp({n}) FILTER (WHERE l_linestatus = 'F') AS v1, var_samp({n}) FILTER (WHERE l_linestatus = 'O') AS v2
  FROM lineitem))""" for n in LINEITEM_NUMERIC))
def q_ttest(spark, sf):
    mt = H.moment_table(table(spark, sf, "lineitem"), LINEITEM_NUMERIC, ["l_linestatus"])
    names = spark.createDataFrame(list(enumerate(LINEITEM_NUMERIC)), "num int, numeric string")
    return H.parametric(mt).join(names, "num").select(
        "numeric", F.col("g1.n").alias("n1"), F.col("g2.n").alias("n2"), rnd("g1.mean").alias("mean1"),
        rnd("g2.mean").alias("mean2"), rnd("t").alias("t"), rnd("cohen_d").alias("cohen_d"))


@query("anova", "\nUNION ALL\n".join(f"""
SELECT '{n}' AS numeric, '{c}' AS categorical, k, n_total,
       round((ssb / (k - 1)) / (ssw / (n_total - k)), {R}) AS f, round(ssb / (ssb + ssw), {R}) AS eta_sq
FROM (SELECT count(*)::BIGINT AS k, sum(n)::BIGINT AS n_total, sum(n * (m - g) * (m - g)) AS ssb, sum((n - 1) * v) AS ssw
      FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g FROM (
            SELECT count(*) AS rows_, count({n}) AS n, avg(CAST({n} AS DOUBLE)) AS m, var_samp(CAST({n} AS DOUBLE)) AS v
            FROM orders WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 5)))""" for n in ORDERS_NUMERIC
                                           for c in ORDERS_CATS))
def q_anova(spark, sf):
    mt = H.moment_table(table(spark, sf, "orders"), ORDERS_NUMERIC, ORDERS_CATS).where(
        F.col("rows") >= Options().min_group_size)
    names = H.pairs_frame(spark, ORDERS_NUMERIC, ORDERS_CATS)
    return H.one_way(mt).join(names, ["num", "cat"]).select(
        "numeric", "categorical", F.col("k").cast("long").alias("k"), F.col("n_total").cast("long").alias("n_total"),
        rnd("f").alias("f"), rnd("eta_sq").alias("eta_sq"))


@query("normality_by_group", "\nUNION ALL\n".join(f"""
SELECT '{n}' AS numeric, '{c}' AS categorical, level, n, round(skew, {R}) AS skewness, round(kurt, {R}) AS kurtosis,
       round(exp(-jb / 2), {R}) AS p_value, exp(-jb / 2) > 0.05 AS normal
FROM (SELECT *, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb FROM (
  SELECT level, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (
    SELECT level, count(*)::BIGINT AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
    FROM (SELECT {c} AS level, CAST({n} AS DOUBLE) AS x, avg(CAST({n} AS DOUBLE)) OVER (PARTITION BY {c}) AS m
          FROM orders WHERE {c} IS NOT NULL AND {n} IS NOT NULL) GROUP BY level)))""" for n in ORDERS_NUMERIC
                                                        for c in ORDERS_CATS))
def q_normality_by_group(spark, sf):
    o = Options()
    mt = H.moment_table(table(spark, sf, "orders"), ORDERS_NUMERIC, ORDERS_CATS)
    return H.jarque_bera(mt).select(
        "numeric", "categorical", "level", "n", rnd("skew").alias("skewness"), rnd("kurt").alias("kurtosis"),
        rnd("jb_p").alias("p_value"), (F.col("jb_p") > o.alpha).alias("normal"))


def _rank_sql(tbl: str, num: str, cat: str) -> str:
    """Rank statistics of ``num`` over the levels of ``cat`` with >= 5 rows."""
    return f"""
WITH lv AS (SELECT CAST({cat} AS VARCHAR) AS level FROM {tbl} WHERE {cat} IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT CAST({cat} AS VARCHAR) AS level, CAST({num} AS DOUBLE) AS x FROM {tbl}
      WHERE {num} IS NOT NULL AND CAST({cat} AS VARCHAR) IN (SELECT level FROM lv)),
rk AS (SELECT level, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM d),
per AS (SELECT level, count(*) AS n, sum(r) AS rs, row_number() OVER (ORDER BY level) AS pos FROM rk GROUP BY level),
ties AS (SELECT sum(t * t * t - t) AS tie FROM (SELECT count(*)::DOUBLE AS t FROM d GROUP BY x)),
tot AS (SELECT count(*)::DOUBLE AS nn FROM d)
SELECT '{num}' AS numeric, '{cat}' AS categorical, (SELECT count(*) FROM per)::BIGINT AS k, nn::BIGINT AS n_total,
       u1 AS u, round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5)
               / sqrt(n1 * n2 / 12.0 * ((nn + 1) - tie / (nn * (nn - 1)))), {R}) AS z,
       round((12.0 / (nn * (nn + 1)) * s2 - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)), {R}) AS h
FROM (SELECT (SELECT rs FROM per WHERE pos = 1) - (SELECT n FROM per WHERE pos = 1) * ((SELECT n FROM per WHERE pos = 1) + 1) / 2.0 AS u1,
             (SELECT n FROM per WHERE pos = 1)::DOUBLE AS n1, (SELECT n FROM per WHERE pos = 2)::DOUBLE AS n2,
             (SELECT sum(rs * rs / n) FROM per) AS s2), ties, tot"""


_RANK_CASES = [("labels", "doc_id", "quality"), ("labels", "doc_id", "toxic"), ("conversations", "turn", "role"),
               ("conversations", "conv_id", "role")]


def _rank_spark(spark, sf, tname, num, cat):
    t = table(spark, sf, tname)
    mt = H.moment_table(t, [num], [cat]).where(F.col("rows") >= Options().min_group_size)
    levels = [r["level"] for r in mt.select("level").collect()]
    st = H.rank_statistics(H.win_matrix(t, [num], [cat], {(0, 0): levels}))
    return st.select(F.lit(num).alias("numeric"), F.lit(cat).alias("categorical"), F.col("k_ranked").cast("long").alias("k"),
                     F.col("n_ranked").cast("long").alias("n_total"), "u", rnd("z").alias("z"), rnd("h").alias("h"))


@query("mannwhitney_u", "\nUNION ALL\n".join(f"SELECT numeric, categorical, n_total, u, z FROM ({_rank_sql(t, n, c)})"
                                              for t, n, c in _RANK_CASES[:2]))
def q_mannwhitney_u(spark, sf):
    out = None
    for t, n, c in _RANK_CASES[:2]:
        r = _rank_spark(spark, sf, t, n, c).select("numeric", "categorical", "n_total", "u", "z")
        out = r if out is None else out.unionByName(r)
    return out


@query("kruskal_h", "\nUNION ALL\n".join(f"SELECT numeric, categorical, k, n_total, h FROM ({_rank_sql(t, n, c)})"
                                          for t, n, c in _RANK_CASES[2:]))
def q_kruskal_h(spark, sf):
    out = None
    for t, n, c in _RANK_CASES[2:]:
        r = _rank_spark(spark, sf, t, n, c).select("numeric", "categorical", "k", "n_total", "h")
        out = r if out is None else out.unionByName(r)
    return out


@query("posthoc_pairs_stat", f"""
WITH d AS (SELECT role AS level, CAST(turn AS DOUBLE) AS x FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT level, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY level HAVING count(*) >= 5),
a AS (SELECT count(*) AS k, sum(n) AS nn, sum((n - 1) * v) AS ssw FROM g),
pairs AS (SELECT g1.level AS group1, g2.level AS group2, g1.n AS n1, g2.n AS n2, g1.m - g2.m AS diff
          FROM g g1 JOIN g g2 ON g1.level < g2.level),
pd AS (SELECT p.group1, p.group2, d.level, d.x FROM pairs p JOIN d ON d.level = p.group1 OR d.level = p.group2),
rk AS (SELECT group1, group2, level, rank() OVER (PARTITION BY group1, group2 ORDER BY x)
              + (count(*) OVER (PARTITION BY group1, group2, x) - 1) / 2.0 AS r FROM pd),
u AS (SELECT group1, group2, sum(r) FILTER (WHERE level = group1) AS r1, count(*) FILTER (WHERE level = group1) AS c1
      FROM rk GROUP BY group1, group2)
SELECT p.group1, p.group2, round(p.diff, {R}) AS mean_diff,
       round(abs(p.diff) / sqrt(a.ssw / (a.nn - a.k) / 2.0 * (1.0 / p.n1 + 1.0 / p.n2)), {R}) AS q,
       u.r1 - u.c1 * (u.c1 + 1) / 2.0 AS u
FROM pairs p JOIN u ON p.group1 = u.group1 AND p.group2 = u.group2, a
""")
def q_posthoc_pairs_stat(spark, sf):
    o = Options()
    cv = table(spark, sf, "conversations")
    mt = H.moment_table(cv, ["turn"], ["role"]).where(F.col("n") >= o.min_group_size)
    tk = H.tukey_hsd(mt).select("group1", "group2", rnd("mean_diff").alias("mean_diff"), rnd("statistic").alias("q"))
    levels = [r["level"] for r in mt.select("level").collect()]
    pu = H.pairwise_u(H.win_matrix(cv, ["turn"], ["role"], {(0, 0): levels})).select("group1", "group2", F.col("statistic").alias("u"))
    return tk.join(pu, ["group1", "group2"])


@query("ab_test", f"""
SELECT n1, round(m1, {R}) AS mean1, n2, round(m2, {R}) AS mean2,
       round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), {R}) AS t
FROM (SELECT count(o_totalprice) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n1,
             avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1,
             var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v1,
             count(o_totalprice) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS n2,
             avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2,
             var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS v2
      FROM orders WHERE o_orderstatus IN ('F', 'O'))
""")
def q_ab_test(spark, sf):
    r = S.ab_test(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return r.select("n1", rnd("mean1").alias("mean1"), "n2", rnd("mean2").alias("mean2"), rnd("t").alias("t"))


@query("anova_factor", f"""
SELECT k::BIGINT AS k, nn::BIGINT AS N, round((ssb / (k - 1)) / (ssw / (nn - k)), {R}) AS f
FROM (SELECT count(*) AS k, sum(n) AS nn, sum(n * (m - g) * (m - g)) AS ssb, sum((n - 1) * v) AS ssw
      FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS g
            FROM (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
                  FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderpriority)))
""")
def q_anova_factor(spark, sf):
    r = S.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return r.select(F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("N"), rnd("f").alias("f"))


# rows-only: p-values, Shapiro W and selection need the distribution library
@query("shapiro_by_group")
def q_shapiro_by_group(spark, sf):
    o = Options()
    cu = table(spark, sf, "customer")
    nums = ["c_custkey", "c_nationkey", "c_acctbal"]
    mt = H.moment_table(cu, nums, ["c_mktsegment"])
    surv = [r.asDict() for r in mt.where(F.col("rows") >= o.min_group_size).collect()]
    return H.normality(cu, nums, ["c_mktsegment"], surv, o)


def _full_tests(spark, sf, tname):
    o = Options()
    t = table(spark, sf, tname)
    _, info = RL.detect(t, o)
    cats = info.eligible_categorical(o)[:o.max_test_categorical]
    return H.group_comparison(t, info.numeric[:o.max_test_numeric], cats, {c: info.distinct(c) for c in cats}, o)


@query("test_selection")
def q_test_selection(spark, sf):
    t = _full_tests(spark, sf, "customer")["tests"]
    return t.select("numeric", "categorical", "n_groups", "normality_met", "method", "statistic", "p_value",
                    "effect_size", "effect_size_name")


@query("bonferroni")
def q_bonferroni(spark, sf):
    t = _full_tests(spark, sf, "lineitem")["tests"]
    return H.ordered_tests(t).select("numeric", "categorical", "method", "p_raw", "p_value", "significant",
                                     "bonferroni_alpha", "significant_bonferroni", "significant_bonferroni_raw")


@query("posthoc_pairs")
def q_posthoc_pairs(spark, sf):
    return _full_tests(spark, sf, "conversations")["posthoc"]


# ------------------------------------------------------------------ segmentation
_Z_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("zscore", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) "
    f"OVER () ELSE 1 END, {R}) AS z_{c}" for c in _Z_COLS) + " FROM lineitem WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in _Z_COLS))
def q_zscore(spark, sf):
    li = table(spark, sf, "lineitem")
    base = li.where(" AND ".join(f"{c} IS NOT NULL" for c in _Z_COLS))
    z = SG.zscore(base, _Z_COLS, keep=["l_orderkey", "l_linenumber"])
    return z.select("l_orderkey", "l_linenumber", *[rnd(c).alias(f"z_{c}") for c in _Z_COLS])


def customer_features(spark, sf):
    """Per-customer features from customer ⋈ orders (Spark-derived)."""
    cu = table(spark, sf, "customer")
    od = table(spark, sf, "orders")
    feat = od.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"),
                                       F.sum("o_totalprice").alias("total_spend"),
                                       F.avg("o_totalprice").alias("avg_order"))
    return cu.join(feat, cu.c_custkey == feat.o_custkey, "left").select(
        "c_custkey", "c_acctbal", F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
        "total_spend", "avg_order")


_SEG_COLS = ["c_acctbal", "n_orders", "total_spend", "avg_order"]


@query("k_choice")
def q_k_choice(spark, sf):
    return SG.segment(customer_features(spark, sf), _SEG_COLS, Options())["summary"]


@query("elbow_curve")
def q_elbow_curve(spark, sf):
    seg = SG.segment(customer_features(spark, sf), _SEG_COLS, Options())
    return SG.elbow_table(seg["k_table"])


@query("kmeans_profile")
def q_kmeans_profile(spark, sf):
    return S.segment(customer_features(spark, sf), _SEG_COLS, k=4)["profile"]


@query("pca_variance")
def q_pca_variance(spark, sf):
    return SG.pca_variance(customer_features(spark, sf), _SEG_COLS)


# ------------------------------------------------------------------ regression
@query("ols_two_feature", f"""
WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS ry1, corr(l_extendedprice, l_discount) AS ry2,
                  corr(l_quantity, l_discount) AS r12 FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
b AS (SELECT (ry1 - ry2 * r12) / (1 - r12 * r12) AS b1, (ry2 - ry1 * r12) / (1 - r12 * r12) AS b2, ry1, ry2 FROM c)
SELECT 'l_quantity' AS feature, round(b1, {R}) AS coefficient, round(b1 * ry1 + b2 * ry2, {R}) AS r_squared FROM b
UNION ALL
SELECT 'l_discount', round(b2, {R}), round(b1 * ry1 + b2 * ry2, {R}) FROM b
""")
def q_ols_two_feature(spark, sf):
    li = table(spark, sf, "lineitem")
    res = RG.driver_analysis(li, ["l_extendedprice", "l_quantity", "l_discount"], [], ["l_extendedprice"])
    return res["drivers"].join(res["models"].select("target", "r_squared"), "target").select(
        "feature", rnd("coefficient").alias("coefficient"), rnd("r_squared").alias("r_squared"))


@query("driver_ranking")
def q_driver_ranking(spark, sf):
    o = Options()
    li = table(spark, sf, "lineitem")
    _, info = RL.detect(li, o)
    return RG.driver_analysis(li, info.numeric, info.eligible_categorical(o), None, o)["drivers"]


# ------------------------------------------------------------------ findings
@query("findings")
def q_findings(spark, sf):
    return analyze(table(spark, sf, "orders"), Options())["findings"]
