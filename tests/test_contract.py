"""Contract queries against their DuckDB SQL on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

FAST = ["table_summary", "column_roles", "category_top_n", "missing_report", "outlier_report",
        "describe_numeric", "histogram_30", "box_stats", "box_stats_by_level", "group_mean_std_count",
        "group_means", "crosstab", "ordered_levels", "value_share", "mode_values", "eda_key_figures",
        "pearson_matrix", "spearman_matrix", "strong_pairs", "nonlinear_hints", "ttest", "anova",
        "mannwhitney_u", "kruskal_h", "posthoc_pairs_stat", "ab_test", "anova_factor", "zscore",
        "ols_two_feature", "gated_roles", "corrected_tests", "significance_scores", "test_count_summary", "test_record",
        "csv_round_trip", "text_key_values", "tables_round_trip", "report_stamp", "named_aggregate", "level_extremes",
        "chart_centers", "rank_effects", "correlations_with_nulls", "top_correlations", "pca_explained", "binning_elbow",
        "driver_estimates", "redundant_features"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: ("nan" if isinstance(v, float) and math.isnan(v) else
                      repr(round(v, 9)) if isinstance(v, float) else repr(v))
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_a_callable():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, rows) == canon(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "mean" in df.columns
