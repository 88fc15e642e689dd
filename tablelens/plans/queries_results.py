"""Contract queries: tests without p-values in SQL, records, sinks, ranked views, spearman with nulls, regression, PCA."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablelens.operators import correlate as C
from tablelens.operators import describe as D
from tablelens.operators import drivers as DR
from tablelens.operators import grouped as G
from tablelens.operators import hypothesis as H
from tablelens.operators import records as RC
from tablelens.operators import roles as RL
from tablelens.operators import segment as SG
from tablelens.options import Options
from tablelens.plans import scripts as S
from tablelens.plans.contract import R, cols_of, query, rnd, table
from tablelens.plans.queries_profile import LINEITEM_NUMERIC
from tablelens.plans.queries_stats import ORDERS_CATS, ORDERS_NUMERIC, _rank_sql, customer_features
from tablelens.session import scratch
from tablelens.sources import read_csv, sinks

_O = Options()
_CASES = {"customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_mktsegment"]),
          "orders": (ORDERS_NUMERIC, ORDERS_CATS),
          "lineitem": (LINEITEM_NUMERIC, ["l_returnflag", "l_linestatus"])}


# ------------------------------------------------------------------ test selection, statistics and effects
def _test_sql(tbl: str, num: str, cat: str) -> str:
    """One row: method, statistic, effect and label of ``num`` over ``cat``, without the p-value."""
    return f"""
SELECT '{tbl}' AS table_name, '{num}' AS numeric, '{cat}' AS categorical, n_groups, normality_met, method,
       round(CASE method WHEN 't-test' THEN t WHEN 'Mann-Whitney U' THEN u WHEN 'ANOVA' THEN f ELSE h END, {R}) AS statistic,
       round(CASE WHEN n_groups = 2 THEN d WHEN normality_met THEN eta ELSE round(h, 3) / (nn - 1) END, {R}) AS effect_size,
       CASE WHEN n_groups = 2 THEN CASE WHEN d > 0.8 THEN 'large' WHEN d > 0.5 THEN 'medium' ELSE 'small' END
            WHEN (CASE WHEN normality_met THEN eta ELSE round(h, 3) / (nn - 1) END) > 0.14 THEN 'large'
            WHEN (CASE WHEN normality_met THEN eta ELSE round(h, 3) / (nn - 1) END) > 0.06 THEN 'medium'
            ELSE 'small' END AS effect_label
FROM (
WITH x0 AS (SELECT CAST({cat} AS VARCHAR) AS level, CAST({num} AS DOUBLE) AS x FROM {tbl} WHERE {cat} IS NOT NULL),
lv AS (SELECT level FROM x0 GROUP BY level HAVING count(*) >= {_O.min_group_size}),
src AS (SELECT * FROM x0 WHERE level IN (SELECT level FROM lv) AND x IS NOT NULL),
g AS (SELECT level, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM src GROUP BY level),
mom AS (SELECT s.level, any_value(n) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
        FROM src s JOIN g ON g.level = s.level GROUP BY s.level),
norm AS (SELECT bool_and(n >= 3 AND coalesce(exp(-n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) / 2), 1)
                         > {_O.alpha}) AS normality_met FROM mom),
tot AS (SELECT count(*) AS k, sum(n)::DOUBLE AS nn, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS ssw FROM g),
sq AS (SELECT sum(n * pow(m - grand, 2)) AS ssb FROM g, tot),
two AS (SELECT *, row_number() OVER (ORDER BY level) AS pos FROM g),
ab AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS sp
       FROM two a JOIN two b ON a.pos = 1 AND b.pos = 2),
rk AS (SELECT level, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM src),
rs AS (SELECT level, count(*) AS n, sum(r) AS s, row_number() OVER (ORDER BY level) AS pos FROM rk GROUP BY level),
ties AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM src GROUP BY x)),
kw AS (SELECT 12.0 / (nn * (nn + 1)) * sum(n * pow(s / n - (nn + 1) / 2, 2)) / (1 - any_value(tie) / (nn * nn * nn - nn)) AS h
       FROM rs, tot, ties GROUP BY nn)
SELECT (SELECT count(DISTINCT level) FROM x0)::INT AS n_groups, normality_met, nn, h, ssb / (ssb + ssw) AS eta,
       (ssb / (k - 1)) / (ssw / (nn - k)) AS f, (m1 - m2) / sqrt(sp * (1.0 / n1 + 1.0 / n2)) AS t, abs(m1 - m2) / sqrt(sp) AS d,
       (SELECT s - n * (n + 1) / 2.0 FROM rs WHERE pos = 1) AS u,
       CASE WHEN (SELECT count(DISTINCT level) FROM x0) = 2 THEN CASE WHEN normality_met THEN 't-test' ELSE 'Mann-Whitney U' END
            WHEN normality_met THEN 'ANOVA' ELSE 'Kruskal-Wallis' END AS method
FROM tot, sq, norm, ab, kw)"""


def _battery(spark, sf, tname):
    t = table(spark, sf, tname)
    _, info = RL.detect(t, _O)
    cats = info.eligible_categorical(_O)
    return H.group_comparison(t, info.numeric, cats, {c: info.distinct(c) for c in cats}, _O)


@query("test_statistics", "\nUNION ALL\n".join(_test_sql(t, n, c) for t, (ns, cs) in _CASES.items() for n in ns for c in cs))
def q_test_statistics(spark, sf):
    out = None
    for tname in _CASES:
        r = _battery(spark, sf, tname)["tests"].select(
            F.lit(tname).alias("table_name"), "numeric", "categorical", "n_groups", "normality_met", "method",
            rnd("statistic").alias("statistic"), rnd("effect_size").alias("effect_size"),
            F.col("effect_size_interpretation").alias("effect_label"))
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ correction, verdicts and ranked views over closed-form p-values
def _jb_sql(num: str, cat: str) -> str:
    return f"""SELECT '{num}' AS numeric, '{cat}' AS categorical, level, exp(-jb / 2) AS p FROM (
  SELECT level, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM (
    SELECT level, count(*) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
    FROM (SELECT CAST({cat} AS VARCHAR) AS level, CAST({num} AS DOUBLE) AS x, avg(CAST({num} AS DOUBLE)) OVER (PARTITION BY {cat}) AS m
          FROM customer WHERE {cat} IS NOT NULL AND {num} IS NOT NULL) GROUP BY level))"""


_JB_NUM, _JB_CATS = ["c_custkey", "c_acctbal"], ["c_mktsegment", "c_nationkey"]
_CORRECTED_SQL = f"""
WITH p AS ({' UNION ALL '.join(_jb_sql(n, c) for n in _JB_NUM for c in _JB_CATS)}),
c AS (SELECT *, round(p, 4) AS p_value, p < 0.05 AS significant, count(*) OVER () AS n_tests FROM p),
v AS (SELECT *, 0.05 / n_tests AS bonferroni_alpha, p_value < 0.05 / n_tests AS significant_bonferroni FROM c),
w AS (SELECT *, CASE WHEN significant_bonferroni THEN 'corrected' WHEN significant THEN 'raw' ELSE 'none' END AS verdict FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY p_value, numeric, categorical, level) AS position FROM w)"""


def _corrected(spark, sf):
    mt = H.jarque_bera(H.moment_table(table(spark, sf, "customer"), _JB_NUM, _JB_CATS))
    return RC.bonferroni(mt.withColumn("p_raw", F.col("jb_p"))).withColumn("verdict", RC.verdict())


_VIEW_ORDER = ["p_value", "numeric", "categorical", "level"]


@query("corrected_tests", _CORRECTED_SQL + f"""
SELECT numeric, categorical, level, p_value, significant, n_tests, round(bonferroni_alpha, 9) AS bonferroni_alpha,
       significant_bonferroni, verdict, position::INT AS position FROM k WHERE position <= 10
""")
def q_corrected_tests(spark, sf):
    """The ten smallest p-values of each verdict, with their positions."""
    view = RC.ranked(_corrected(spark, sf), [F.asc(c) for c in _VIEW_ORDER], by=["verdict"], k=10)
    return view.select("numeric", "categorical", "level", "p_value", "significant", "n_tests",
                       rnd("bonferroni_alpha", 9).alias("bonferroni_alpha"), "significant_bonferroni", "verdict", "position")


@query("significance_scores", _CORRECTED_SQL + f"""
SELECT numeric, categorical, level, round(CASE WHEN p > 0 THEN -log10(p) ELSE 10 END, {R}) AS neg_log10_p, significant FROM k
""")
def q_significance_scores(spark, sf):
    return S.significance_score(_corrected(spark, sf), "p_raw").select(
        "numeric", "categorical", "level", rnd("neg_log10_p").alias("neg_log10_p"), "significant")


@query("test_count_summary", _CORRECTED_SQL + """
SELECT count(*)::BIGINT AS n_tests, count_if(significant)::BIGINT AS n_significant,
       count_if(significant_bonferroni)::BIGINT AS n_significant_bonferroni FROM k
""")
def q_test_count_summary(spark, sf):
    return H.test_counts(_corrected(spark, sf))


# ------------------------------------------------------------------ nested record, through the JSON sink and back
@query("test_record", f"""
WITH m AS (SELECT c_mktsegment AS level, avg(c_acctbal) AS mean, count(*)::BIGINT AS n FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY 1 HAVING count(*) >= {_O.min_group_size})
SELECT 'c_acctbal' AS numeric, 'c_mktsegment' AS categorical, level, round(mean, {R}) AS mean, n,
       (SELECT count(*) FROM m)::INT AS n_means FROM m
""")
def q_test_record(spark, sf):
    """Nested records of the customer tests, written as JSON lines, read back and unfolded."""
    res = _battery(spark, sf, "customer")
    records = RC.test_records(res["tests"], res["normality"], res["posthoc"], res["group_means"])
    path = scratch(spark, "records")
    sinks.write_json(records, path)
    back = spark.read.schema(records.schema).json(path)
    one = back.where("numeric = 'c_acctbal' AND categorical = 'c_mktsegment'")
    return one.select("numeric", "categorical", "group_means", F.inline("normality")).select(
        "numeric", "categorical", "level", F.round(F.element_at("group_means", F.col("level")), R).alias("mean"), "n",
        F.size("group_means").alias("n_means"))


# ------------------------------------------------------------------ CSV and text, out and in
_CSV_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_custkey % 3 = 0 AS flag FROM orders"


@query("csv_round_trip", _CSV_SQL)
def q_csv_round_trip(spark, sf):
    """Orders written by the CSV sink and read by the CSV source, which infers every type again."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                                          (F.col("o_custkey") % 3 == 0).alias("flag"))
    path = scratch(spark, "csv")
    sinks.write_csv(o, path)
    return read_csv(spark, path)


@query("text_key_values", """
SELECT 'n_rows: ' || count(*) AS line FROM orders
UNION ALL SELECT 'customers: ' || count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'top: ' || (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
""")
def q_text_key_values(spark, sf):
    o = table(spark, sf, "orders")
    facts = o.agg(F.count(F.lit(1)).cast("string").alias("a"), F.count_distinct("o_custkey").cast("string").alias("b")).select(
        F.inline(F.array(F.struct(F.lit("n_rows").alias("key"), F.col("a").alias("value")),
                         F.struct(F.lit("customers").alias("key"), F.col("b").alias("value")))))
    facts = facts.unionByName(D.mode(o, "o_orderpriority").select(F.lit("top").alias("key"), "value"))
    path = scratch(spark, "text")
    sinks.write_key_values(facts, "key", "value", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("tables_round_trip", "SELECT 'regions' AS name, r_regionkey AS key, r_name AS label FROM region "
                            "UNION ALL SELECT 'nations', n_nationkey, n_name FROM nation")
def q_tables_round_trip(spark, sf):
    root = scratch(spark, "tables")
    results = {"regions": table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label")),
               "nations": table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))}
    out = None
    for name, path in zip(results, sinks.write_tables(results, root)):
        r = spark.read.parquet(path).select(F.lit(name).alias("name"), "key", "label")
        out = r if out is None else out.unionByName(r)
    return out


@query("report_stamp", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created, count(*)::BIGINT AS n FROM events")
def q_report_stamp(spark, sf):
    e = table(spark, sf, "events").agg(F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))
    return RC.stamped(e, F.col("at")).select("created", "n")


# ------------------------------------------------------------------ grouped views
@query("named_aggregate", f"""
SELECT o_orderpriority, round(avg(o_totalprice), {R}) AS mean_price, round(stddev_samp(o_totalprice), {R}) AS std_price,
       count(o_custkey)::BIGINT AS n, min(o_custkey) AS first_customer, max(o_totalprice) AS top_price,
       round(quantile_cont(o_totalprice, 0.5), {R}) AS median_price FROM orders GROUP BY 1
""")
def q_named_aggregate(spark, sf):
    g = G.named_group_aggregate(table(spark, sf, "orders"), "o_orderpriority", [
        ("o_totalprice", "mean", "mean_price"), ("o_totalprice", "std", "std_price"), ("o_custkey", "count", "n"),
        ("o_custkey", "min", "first_customer"), ("o_totalprice", "max", "top_price"), ("o_totalprice", "median", "median_price")])
    return g.withColumns({c: rnd(c) for c in ("mean_price", "std_price", "median_price")})


@query("level_extremes", "\nUNION ALL\n".join(f"""
SELECT '{n}' AS numeric, '{c}' AS categorical, arg_max(level, m) AS top_level, arg_min(level, m) AS bottom_level,
       round(CASE WHEN min(m) > 0 THEN max(m) / min(m) END, {R}) AS ratio
FROM (SELECT CAST({c} AS VARCHAR) AS level, avg(CAST({n} AS DOUBLE)) AS m FROM orders WHERE {c} IS NOT NULL GROUP BY 1)"""
                                             for n in ORDERS_NUMERIC for c in ORDERS_CATS))
def q_level_extremes(spark, sf):
    means = H.group_means(H.moment_table(table(spark, sf, "orders"), ORDERS_NUMERIC, ORDERS_CATS))
    e = G.level_extremes(means, ["numeric", "categorical"])
    return e.select("numeric", "categorical", "top_level", "bottom_level",
                    F.when(F.col("ratio") < float("inf"), rnd("ratio")).alias("ratio"))


@query("chart_centers", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), {R}) AS mean, round(quantile_cont({c}, 0.5), {R}) AS median, "
    f"(SELECT count(DISTINCT least(CAST(floor(({c} - lo) * (20 / (hi - lo))) AS INT), 19)) FROM orders, "
    f"(SELECT min({c}) AS lo, max({c}) AS hi FROM orders))::BIGINT AS used_bins FROM orders" for c in ["o_totalprice"]))
def q_chart_centers(spark, sf):
    o = table(spark, sf, "orders")
    data = D.numeric_chart_data(o, cols_of(o, ["o_totalprice"]), bins=20)
    used = data["histogram"].where("count > 0").groupBy("ordinal").agg(F.count(F.lit(1)).alias("used_bins"))
    return data["center"].join(used, "ordinal").select(F.col("column").alias("column_name"), rnd("mean").alias("mean"),
                                                       rnd("median").alias("median"), "used_bins")


_TWO_PRIORITIES = "(SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))"


@query("rank_effects", "\nUNION ALL\n".join(
    f"SELECT numeric, n_total AS n, u, z, round(least(abs(z), {H.MAX_Z}) / sqrt(n_total), {R}) AS r "
    f"FROM ({_rank_sql(_TWO_PRIORITIES, n, 'o_orderpriority')})" for n in ORDERS_NUMERIC))
def q_rank_effects(spark, sf):
    """|Z| / sqrt(N) beside U for every numeric of the orders and the first against the last priority."""
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    st = H.rank_statistics(H.win_matrix(o, ORDERS_NUMERIC, ["o_orderpriority"], {
        (i, 0): ["1-URGENT", "5-LOW"] for i in range(len(ORDERS_NUMERIC))}))
    names = spark.createDataFrame(list(enumerate(ORDERS_NUMERIC)), "num int, numeric string")
    return st.join(names, "num").select("numeric", F.col("n_ranked").cast("long").alias("n"), "u", rnd("z").alias("z"),
                                        F.round(H.rank_effect(F.col("z"), F.col("n_ranked")), R).alias("r"))


# ------------------------------------------------------------------ correlation with nulls, ranked
_NULL_COLS = ["c_acctbal", "n_orders", "total_spend", "avg_order", "first_order"]
_FEATURES_SQL = """(SELECT c.c_custkey, c.c_acctbal, coalesce(f.n_orders, 0)::DOUBLE AS n_orders, f.total_spend, f.avg_order,
  CASE WHEN f.n_orders > 12 THEN f.first_order END AS first_order
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spend,
  avg(o_totalprice) AS avg_order, min(o_orderkey)::DOUBLE AS first_order FROM orders GROUP BY 1) f ON c.c_custkey = f.o_custkey)"""


def _null_features(spark, sf):
    """Customer features; spending is null without orders, first_order for all but the busiest customers."""
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").cast("double").alias("first"))
    return customer_features(spark, sf).join(first, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn(
        "first_order", F.when(F.col("n_orders") > 12, F.col("first")))


def _spearman_null_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_i, '{b}' AS col_j, count(*)::BIGINT AS n, round(corr(x, y), {R}) AS pearson,
       round(corr(rx, ry), {R}) AS spearman
FROM (SELECT {a} AS x, {b} AS y, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry
      FROM {_FEATURES_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("correlations_with_nulls", "\nUNION ALL\n".join(_spearman_null_sql(a, b) for a, b in combinations(_NULL_COLS, 2)))
def q_correlations_with_nulls(spark, sf):
    f = _null_features(spark, sf)
    return C.correlations(f, cols_of(f, _NULL_COLS)).select("col_i", "col_j", "n", rnd("pearson").alias("pearson"),
                                                            rnd("spearman").alias("spearman"))


@query("top_correlations", "WITH c AS (" + "\nUNION ALL\n".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS col_i, '{b}' AS col_j, round(corr({a}, {b}), 3) AS pearson FROM lineitem"
    for (i, a), (j, b) in combinations(enumerate(LINEITEM_NUMERIC), 2)) + """)
SELECT col_j AS "row", col_i AS "col", pearson, (row_number() OVER (ORDER BY abs(pearson) DESC, i, j))::INT AS position
FROM c QUALIFY position <= 10
""")
def q_top_correlations(spark, sf):
    """The ten strongest cells of the heat map, strongest first."""
    li = table(spark, sf, "lineitem")
    p = C.pearson(li, cols_of(li, LINEITEM_NUMERIC)).withColumn("r", F.round("pearson", 3))
    top = RC.ranked(p, [F.desc(F.abs("r")), F.asc("i"), F.asc("j")], k=10)
    return top.select(F.col("col_j").alias("row"), F.col("col_i").alias("col"), F.col("r").alias("pearson"), "position")


# ------------------------------------------------------------------ principal components by power iteration
_PCA_COLS = ["c_acctbal", "n_orders", "total_spend", "avg_order"]
_PCA_SQL = f"""
WITH RECURSIVE f AS (SELECT * FROM {_FEATURES_SQL} WHERE total_spend IS NOT NULL AND avg_order IS NOT NULL AND c_acctbal IS NOT NULL),
m AS (SELECT [{', '.join('[' + ', '.join('1.0' if a == b else f'corr({a}, {b})' for b in _PCA_COLS) + ']' for a in _PCA_COLS)}] AS a FROM f),
power1(i, v) AS (
  SELECT 0, [1.0, 0.9, 0.8, 0.7]::DOUBLE[] UNION ALL
  SELECT i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT i, list_transform(a, lambda r: list_dot_product(r, v)) AS w FROM power1, m WHERE i < 400)),
first AS (SELECT v, list_dot_product(list_transform(a, lambda r: list_dot_product(r, v)), v) AS l FROM power1, m WHERE i = 400),
rest AS (SELECT list_transform(a, lambda r, k: list_transform(r, lambda x, n: x - l * v[k] * v[n])) AS a FROM m, first),
power2(i, v) AS (
  SELECT 0, [0.3, -0.9, 0.5, 0.7]::DOUBLE[] UNION ALL
  SELECT i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT i, list_transform(a, lambda r: list_dot_product(r, v)) AS w FROM power2, rest WHERE i < 3000)),
second AS (SELECT list_dot_product(list_transform(a, lambda r: list_dot_product(r, v)), v) AS l FROM power2, rest WHERE i = 3000)
SELECT 1 AS component, round(l / 4, {R}) AS explained_variance FROM first
UNION ALL SELECT 2, round(l / 4, {R}) FROM second
"""


@query("pca_explained", _PCA_SQL)
def q_pca_explained(spark, sf):
    return SG.pca_variance(customer_features(spark, sf), _PCA_COLS).select(
        "component", rnd("explained_variance").alias("explained_variance"))


# ------------------------------------------------------------------ bend of a curve over K
@query("binning_elbow", f"""
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
k AS (SELECT r::INT AS k FROM range(1, 11) t(r)),
c AS (SELECT k, least(floor((o_totalprice - lo) / (hi - lo) * k), k - 1) AS bin, count(*) AS n, var_pop(o_totalprice) AS v
      FROM orders, b, k WHERE o_totalprice IS NOT NULL GROUP BY 1, 2),
i AS (SELECT k, sum(n * v) / 1e9 AS inertia FROM c GROUP BY k),
d AS (SELECT k, inertia, inertia - lead(inertia) OVER (ORDER BY k) AS diff1 FROM i)
SELECT k, round(inertia, 3) AS inertia, round(diff1, 3) AS diff1, round(diff1 - lead(diff1) OVER (ORDER BY k), 3) AS diff2 FROM d
""")
def q_binning_elbow(spark, sf):
    """First and second differences of the squared error left by K equal-width bins of the order price."""
    o = table(spark, sf, "orders").where("o_totalprice IS NOT NULL").select("o_totalprice")
    b = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    bins = (o.join(F.broadcast(b)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10))))          # one row of bounds
            .withColumn("bin", F.least(F.floor((F.col("o_totalprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")),
                                       F.col("k") - 1)))
    inertia = (bins.groupBy("k", "bin").agg((F.count(F.lit(1)) * F.var_pop("o_totalprice")).alias("s"))
               .groupBy("k").agg((F.sum("s") / 1e9).alias("inertia")))
    return SG.elbow_table(inertia).select("k", *[rnd(c, 3).alias(c) for c in ("inertia", "diff1", "diff2")])


# ------------------------------------------------------------------ regression by Gauss-Jordan elimination
_DUMMIES = [("l_returnflag", "N"), ("l_returnflag", "R"), ("l_linestatus", "O")]
_FEATURES = LINEITEM_NUMERIC + [f"{c}_{v}" for c, v in _DUMMIES]


def _ols_sql(target: str) -> str:
    at = _FEATURES.index(target)
    rest = [i for i in range(len(_FEATURES)) if i != at]
    p = len(rest)
    start = ", ".join("[" + ", ".join([f"a[{i + 1}][{j + 1}]" for j in rest] + [str(float(i == j)) for j in rest] + [f"a[{i + 1}][{at + 1}]"])
                      + "]" for i in rest)
    return f"""SELECT '{target}' AS target, feature, round(m[i][{2 * p + 1}], {R}) AS coefficient,
       round(sqrt(m[i][{p} + i] * mse / n), {R}) AS std_error, round(m[i][{2 * p + 1}] / sqrt(m[i][{p} + i] * mse / n), 4) AS t_statistic
FROM (
WITH RECURSIVE gj(k, m) AS (
  SELECT 0, [{start}] FROM cov UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM gj WHERE k < {p}),
f AS (SELECT unnest([{', '.join(f"'{_FEATURES[i]}'" for i in rest)}]) AS feature, unnest(range(1, {p + 1})) AS i,
      unnest([{', '.join(str(i + 1) for i in rest)}]) AS col),
fit AS (SELECT m, n, n * (a[{at + 1}][{at + 1}] - list_sum(list_transform(range(1, {p + 1}), lambda i: m[i][{2 * p + 1}]
        * a[[{', '.join(str(i + 1) for i in rest)}][i]][{at + 1}]))) / (n - {p} - 1) AS mse FROM gj, cov WHERE k = {p})
SELECT * FROM f, fit)"""


_Z = [f"({c} - (SELECT avg({c}) FROM src)) / (SELECT stddev_pop({c}) FROM src)" for c in LINEITEM_NUMERIC] + [
    f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END" for c, v in _DUMMIES]
_OLS_SQL = f"""
WITH src AS (SELECT * FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LINEITEM_NUMERIC + ['l_returnflag', 'l_linestatus'])}),
z AS (SELECT {', '.join(f'{e} AS z{i}' for i, e in enumerate(_Z))} FROM src),
cov AS (SELECT count(*)::DOUBLE AS n, [{', '.join('[' + ', '.join(f'covar_pop(z{i}, z{j})' for j in range(len(_Z))) + ']' for i in range(len(_Z)))}] AS a FROM z)
{{body}}"""


@query("driver_estimates", _OLS_SQL.replace("{body}", "\nUNION ALL\n".join(
    _ols_sql(t) for t in ["l_orderkey", "l_extendedprice"])))
def q_driver_estimates(spark, sf):
    """Standardised coefficients, standard errors and t of both targets, from one Gram pass."""
    li = table(spark, sf, "lineitem")
    d = DR.driver_analysis(li, LINEITEM_NUMERIC, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_extendedprice"])["drivers"]
    return d.select("target", "feature", rnd("coefficient").alias("coefficient"), rnd("std_error").alias("std_error"),
                    F.round("t_statistic", 4).alias("t_statistic"))


@query("redundant_features", """
SELECT 'total' AS target, ['double_price'] AS redundant, 3 AS n_features, count(*)::BIGINT AS n_samples FROM orders
WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_orderkey IS NOT NULL
""".replace("['double_price'] AS redundant", "'double_price' AS redundant"))
def q_redundant_features(spark, sf):
    """A design in which one feature is twice another: the sweep names it."""
    o = table(spark, sf, "orders").select(
        (F.col("o_totalprice") + F.col("o_custkey")).alias("total"), F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").cast("double").alias("key"), (2 * F.col("o_totalprice")).alias("double_price"))
    m = DR.driver_analysis(o, ["total", "price", "key", "double_price"], [], ["total"])["models"]
    return m.select("target", F.array_join("redundant_features", ",").alias("redundant"), "n_features", "n_samples")
