"""Date forms of string columns, sorted quality tables and the all-clear row."""

import pytest

from tablelens.operators import findings as FD
from tablelens.operators import quality as QY
from tablelens.operators import roles as RL


@pytest.mark.parametrize("values, expected", [
    (["5/7/2020", "12/31/2021"], True), (["2020-01-05T10:00:00Z", "2020-01-05T10:00:00.25+01:00"], True),
    (["2020-01-05 10:00:00", "2020-01-05 10:00:00.123456"], True), (["5 Jan 2020", "17 Dec 2021"], True),
    (["January 5, 2020", "May 17, 2021"], True), (["10 bananas", "5 Jan 2020"], False),
    (["2020-01-05", "never"], False)])
def test_date_forms(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert RL.column_profile(df).first()["parses_as_datetime"] is expected


def test_quality_tables_are_sorted_and_can_be_clear(spark):
    df = spark.createDataFrame([(1, None, None)] + [(i, i, None if i < 5 else i) for i in range(2, 10)],
                               "a int, b int, c int")
    missing = QY.missing_report(df)
    assert [r["column"] for r in missing.collect()] == ["c", "b"]
    none = QY.outlier_report(df, [])
    assert {r["rule"] for r in FD.quality_findings(missing, none).collect()} == {"missing"}
    clear = FD.quality_findings(QY.missing_report(df.select("a")), none).collect()
    assert [r["rule"] for r in clear] == ["quality_ok"]
