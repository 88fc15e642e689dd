"""Contract queries: roles, quality, descriptive statistics, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import describe as D
from tablelens.operators import quality as QY
from tablelens.operators import roles as RL
from tablelens.options import Options
from tablelens.plans.contract import R, cols_of, numeric_columns, query, rnd, table

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


# ------------------------------------------------------------------ table_summary
@query("table_summary", """
SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS n_cols,
       (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::BIGINT AS n_duplicate_rows,
       (count(*) - count(o_orderkey) + count(*) - count(o_custkey) + count(*) - count(o_orderstatus)
        + count(*) - count(o_totalprice) + count(*) - count(o_orderdate)
        + count(*) - count(o_orderpriority))::BIGINT AS n_missing_cells
FROM orders
""")
def q_table_summary(spark, sf):
    return RL.table_summary(table(spark, sf, "orders"))


# ------------------------------------------------------------------ column_roles
_ROLE_TABLES = {
    "customer": [("c_custkey", "num"), ("c_name", "str"), ("c_nationkey", "num"),
                 ("c_acctbal", "num"), ("c_mktsegment", "str")],
    "documents": [("doc_id", "num"), ("text", "str"), ("lang", "str"), ("source", "str"),
                  ("n_chars", "num")],
    "part": [("p_partkey", "num"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"),
             ("p_size", "num"), ("p_retailprice", "num")],
}
# DuckDB spellings of the datetime patterns in roles.DATETIME_PATTERNS.
_DUCK_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S",
                 "%Y-%m-%d %H:%M:%S.%f", "%Y/%m/%d", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y",
                 "%m/%d/%Y %H:%M:%S", "%d.%m.%Y", "%Y-%m", "%H:%M", "%H:%M:%S", "%d %b %Y"]


def _role_sql(tbl: str, ordinal: int, col: str, kind: str, o: Options = Options()) -> str:
    nd = f"count(DISTINCT {col})"
    nn = f"count({col})"
    if kind == "num":
        role = f"CASE WHEN {nn} = 0 THEN 'none' WHEN {nd} <= 2 THEN 'categorical' ELSE 'numeric' END"
    else:
        parsed = " OR ".join(
            f"count(CASE WHEN length({col}) <= 32 THEN try_strptime({col}, '{f}') END) = {nn}"
            for f in _DUCK_FORMATS)
        role = (f"CASE WHEN {nn} = 0 THEN 'none' WHEN ({parsed}) THEN 'datetime' "
                f"WHEN {nd} / {nn} > {o.id_unique_ratio} AND {nd} > {o.id_min_unique} THEN 'id' "
                f"WHEN avg(length({col})) > {o.text_avg_len_threshold} THEN 'text' "
                f"ELSE 'categorical' END")
    return (f"SELECT '{tbl}' AS table_name, {ordinal} AS ordinal, '{col}' AS column_name, {role} AS role, "
            f"{nn}::BIGINT AS n_non_null, {nd}::BIGINT AS n_distinct FROM {tbl}")


_ROLES_SQL = "\nUNION ALL\n".join(
    _role_sql(t, i, c, k) for t, cs in _ROLE_TABLES.items() for i, (c, k) in enumerate(cs))


@query("column_roles", _ROLES_SQL)
def q_column_roles(spark, sf):
    out = None
    for t in _ROLE_TABLES:
        r = RL.column_roles(table(spark, sf, t)).select(
            F.lit(t).alias("table_name"), "ordinal", F.col("column").alias("column_name"), "role",
            "n_non_null", "n_distinct")
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ roles from sketches and gated exact counts
_DATE_COLUMNS = {"d_iso": "%Y-%m-%d", "d_stamp": "%Y-%m-%d %H:%M:%S", "d_slash": "%m/%d/%Y", "d_name": "%d %b %Y", "d_dot": "%d.%m.%Y"}


def _gated_sql(tbl: str, ordinal: int, col: str, kind: str, src: str = "", o: Options = Options()) -> str:
    role = _role_sql(tbl, ordinal, col, kind).split("AS column_name, ")[1].split(" AS role")[0]
    return (f"SELECT '{tbl}' AS table_name, {ordinal} AS ordinal, '{col}' AS column_name, {role} AS role, "
            f"CASE WHEN count(DISTINCT {col}) BETWEEN 1 AND {o.max_categories} THEN count(DISTINCT {col}) END::BIGINT AS n_levels "
            f"FROM {src or tbl}")


def dated_events(spark, sf):
    """Events with their time written out in several forms (strings), and one mixed column that is no date."""
    e = table(spark, sf, "events")
    day = F.to_date("ts")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("d_iso"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("d_stamp"),
        F.date_format("ts", "MM/dd/yyyy").alias("d_slash"), F.date_format("ts", "dd MMM yyyy").alias("d_name"),
        F.date_format("ts", "dd.MM.yyyy").alias("d_dot"),
        F.when(F.col("event_id") % 1000 == 7, F.lit("2024-13-45")).otherwise(day.cast("string")).alias("d_broken"))


_DATED = ("(SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS {c}" for c, f in _DATE_COLUMNS.items())
          + ", CASE WHEN event_id % 1000 = 7 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d') END AS d_broken FROM events)")


@query("gated_roles", "\nUNION ALL\n".join(
    [_gated_sql(t, i, c, k) for t, cs in _ROLE_TABLES.items() for i, (c, k) in enumerate(cs)]
    + [_gated_sql("dated_events", i, c, k, _DATED) for i, (c, k) in enumerate(
        [("event_id", "num"), *[(c, "str") for c in [*_DATE_COLUMNS, "d_broken"]]])]))
def q_gated_roles(spark, sf):
    """Roles and level counts as the stages use them: sketches, exact counts near a threshold, dates by shape."""
    out = None
    for t in [*_ROLE_TABLES, "dated_events"]:
        df = dated_events(spark, sf) if t == "dated_events" else table(spark, sf, t)
        r = RL.column_roles(df, exact=False).select(
            F.lit(t).alias("table_name"), "ordinal", F.col("column").alias("column_name"), "role",
            F.when(F.col("n_distinct").between(1, Options().max_categories) & F.col("distinct_exact"),
                   F.col("n_distinct")).alias("n_levels"))
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ category_top_n
def _topn_sql(tbl: str, col: str, n: int = 10) -> str:
    return (f"SELECT '{tbl}' AS table_name, '{col}' AS column_name, value, count, rank, "
            f"round(count / total, {R}) AS share FROM ("
            f"SELECT value, count, sum(count) OVER () AS total, "
            f"row_number() OVER (ORDER BY count DESC, value ASC) AS rank FROM ("
            f"SELECT CAST({col} AS VARCHAR) AS value, count(*)::BIGINT AS count FROM {tbl} "
            f"WHERE {col} IS NOT NULL GROUP BY 1)) WHERE rank <= {n}")


_TOPN = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_name"),
         ("part", "p_brand"), ("part", "p_type")]


@query("category_top_n", "\nUNION ALL\n".join(f"SELECT * FROM ({_topn_sql(t, c)})" for t, c in _TOPN))
def q_category_top_n(spark, sf):
    o = Options()
    out = None
    for tname in ("orders", "part"):
        t = table(spark, sf, tname)
        cols = [(i, c) for t2, c in _TOPN if t2 == tname for i in [t.columns.index(c)]]
        r = RL.category_counts(t, cols, o.top_n).select(
            F.lit(tname).alias("table_name"), F.col("column").alias("column_name"), "value",
            "count", F.col("rank").cast("long").alias("rank"), rnd("share").alias("share"))
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ missing_report
@query("missing_report", f"""
WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (
  SELECT 0 AS ordinal, 'doc_id' AS column_name, count(*) - count(doc_id) AS n, count(*) AS t FROM j
  UNION ALL SELECT 1, 'text', count(*) - count(text), count(*) FROM j
  UNION ALL SELECT 2, 'lang', count(*) - count(lang), count(*) FROM j
  UNION ALL SELECT 3, 'source', count(*) - count(source), count(*) FROM j
  UNION ALL SELECT 4, 'n_chars', count(*) - count(n_chars), count(*) FROM j
  UNION ALL SELECT 5, 'quality', count(*) - count(quality), count(*) FROM j
  UNION ALL SELECT 6, 'toxic', count(*) - count(toxic), count(*) FROM j)
SELECT ordinal, column_name, n::BIGINT AS n_missing, round(n / t * 100.0, {R}) AS percentage,
       CASE WHEN n / t * 100.0 > 20 THEN 'high' WHEN n / t * 100.0 > 5 THEN 'medium' ELSE 'low' END AS severity
FROM m WHERE n > 0
""")
def q_missing_report(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return QY.missing_report(j).select("ordinal", F.col("column").alias("column_name"), "n_missing",
                                       rnd("percentage").alias("percentage"), "severity")


# ------------------------------------------------------------------ outlier_report
def _outlier_sql(tbl: str, col: str) -> str:
    return f"""
SELECT '{tbl}' AS table_name, '{col}' AS column_name, n_outliers, round(n_outliers / n * 100.0, {R}) AS percentage,
       round(lo, {R}) AS lower_bound, round(hi, {R}) AS upper_bound,
       CASE WHEN n_outliers / n * 100.0 > 10 THEN 'high' WHEN n_outliers / n * 100.0 > 3 THEN 'medium'
            ELSE 'low' END AS severity
FROM (SELECT count(*) FILTER (WHERE x < lo OR x > hi)::BIGINT AS n_outliers, count(x) AS n, any_value(lo) AS lo,
             any_value(hi) AS hi
      FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {tbl} WHERE {col} IS NOT NULL) v,
           (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
            FROM (SELECT quantile_cont(CAST({col} AS DOUBLE), 0.25) AS q1,
                         quantile_cont(CAST({col} AS DOUBLE), 0.75) AS q3 FROM {tbl})) b)
WHERE n_outliers > 0"""


_OUTLIER_TABLES = {"events": ["event_id", "user_id", "value"], "documents": ["doc_id", "n_chars"]}


@query("outlier_report", "\nUNION ALL\n".join(
    f"SELECT * FROM ({_outlier_sql(t, c)})" for t, cs in _OUTLIER_TABLES.items() for c in cs))
def q_outlier_report(spark, sf):
    out = None
    for tname in _OUTLIER_TABLES:
        t = table(spark, sf, tname)
        r = QY.outlier_report(t, numeric_columns(t)).select(
            F.lit(tname).alias("table_name"), F.col("column").alias("column_name"), "n_outliers",
            rnd("percentage").alias("percentage"), rnd("lower_bound").alias("lower_bound"),
            rnd("upper_bound").alias("upper_bound"), "severity")
        out = r if out is None else out.unionByName(r)
    return out


# ------------------------------------------------------------------ describe_numeric
def _describe_sql(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c})::BIGINT AS count, round(avg({x}), {R}) AS mean, "
            f"round(stddev_samp({x}), {R}) AS std, round(min({x}), {R}) AS min, "
            f"round(quantile_cont({x}, 0.25), {R}) AS q25, round(quantile_cont({x}, 0.5), {R}) AS q50, "
            f"round(quantile_cont({x}, 0.75), {R}) AS q75, round(max({x}), {R}) AS max, "
            f"round(skewness({x}), {R}) AS skewness, round(kurtosis({x}), {R}) AS kurtosis FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


@query("describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC))
def q_describe_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    d = D.describe(li, cols_of(li, LINEITEM_NUMERIC))
    return d.select(F.col("column").alias("column_name"), "count",
                    *[rnd(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max",
                                                "skewness", "kurtosis"]])


# ------------------------------------------------------------------ histogram_30
@query("histogram_30", f"""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
x AS (SELECT l_extendedprice AS v, lo, hi, (hi - lo) / 30.0 AS step,
             least(CAST(floor((l_extendedprice - lo) * (30.0 / (hi - lo))) AS INTEGER), 29) AS i0
      FROM lineitem, b WHERE l_extendedprice IS NOT NULL),
y AS (SELECT CASE WHEN v < i0 * step + lo THEN i0 - 1
                  WHEN i0 < 29 AND v >= (CASE WHEN i0 + 1 >= 30 THEN hi ELSE (i0 + 1) * step + lo END) THEN i0 + 1
                  ELSE i0 END AS bin FROM x),
g AS (SELECT CAST(s AS INTEGER) AS bin, lo, hi, (hi - lo) / 30.0 AS step FROM b, range(30) t(s))
SELECT g.bin, round(g.bin * g.step + g.lo, {R}) AS lower,
       round(CASE WHEN g.bin = 29 THEN g.hi ELSE (g.bin + 1) * g.step + g.lo END, {R}) AS upper,
       count(y.bin)::BIGINT AS count
FROM g LEFT JOIN y ON g.bin = y.bin GROUP BY g.bin, g.lo, g.hi, g.step
""")
def q_histogram_30(spark, sf):
    li = table(spark, sf, "lineitem")
    h = D.histogram(li, cols_of(li, ["l_extendedprice"]), 30)
    return h.select("bin", rnd("lower").alias("lower"), rnd("upper").alias("upper"), "count")


# ------------------------------------------------------------------ box stats
def _box_sql(src: str, with_level: bool) -> str:
    """``src`` yields (level, x) with no nulls."""
    fence = "x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)"
    return f"""
WITH s AS (SELECT level, x FROM {src}),
b AS (SELECT level, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3,
             count(x) AS n FROM s GROUP BY level)
SELECT {'b.level AS level, ' if with_level else ''}b.n::BIGINT AS n, round(q1, {R}) AS q1,
       round(med, {R}) AS median, round(q3, {R}) AS q3,
       round(least(min(x) FILTER (WHERE {fence}), any_value(q1)), {R}) AS whisker_low,
       round(greatest(max(x) FILTER (WHERE {fence}), any_value(q3)), {R}) AS whisker_high,
       count(*) FILTER (WHERE NOT ({fence}))::BIGINT AS n_fliers
FROM b JOIN s ON b.level = s.level
GROUP BY b.level, b.n, q1, med, q3"""


_BOX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("box_stats", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, n, q1, median, q3, whisker_low, whisker_high, n_fliers FROM ("
    + _box_sql(f"(SELECT 1 AS level, CAST({c} AS DOUBLE) AS x FROM lineitem WHERE {c} IS NOT NULL)", False)
    + ")"
    for c in _BOX_COLS))
def q_box_stats(spark, sf):
    li = table(spark, sf, "lineitem")
    b = D.box_table(li, cols_of(li, _BOX_COLS))
    return b.select(F.col("column").alias("column_name"), "n", *[rnd(c).alias(c) for c in [
        "q1", "median", "q3", "whisker_low", "whisker_high"]], "n_fliers")


@query("box_stats_by_level", _box_sql(
    "(SELECT l_returnflag AS level, l_extendedprice AS x FROM lineitem "
    "WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL)", True))
def q_box_stats_by_level(spark, sf):
    li = table(spark, sf, "lineitem")
    b = D.box_by_level(li, "l_extendedprice", "l_returnflag")
    return b.select("level", "n", *[rnd(c).alias(c) for c in [
        "q1", "median", "q3", "whisker_low", "whisker_high"]], "n_fliers")
