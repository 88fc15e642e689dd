"""Sources: parquet / CSV scans plus the normalisation every analysis starts with.

* column names: strip outer whitespace, then ' ' -> '_' (parentheses kept);
* float NaN -> null (pandas treats both as missing);
* decimals -> double (statistics run in double precision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-value tokens pandas' CSV reader recognises by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Spellings pandas reads as booleans in a CSV column.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def q(name: str) -> Column:
    """Column by exact name (names may hold '.', '(' or spaces)."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_names(df: DataFrame) -> DataFrame:
    names = [c.strip().replace(" ", "_") for c in df.columns]
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise ValueError(f"column name collision after normalisation: {n!r}")
        seen.add(n)
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true" and len({n.lower() for n in names}) < len(names):
        twice = sorted(n for n in names if [m.lower() for m in names].count(n.lower()) > 1)
        raise ValueError(f"columns {twice} differ by case only: set spark.sql.caseSensitive=true to analyse them")
    return df.toDF(*names)


def normalise(df: DataFrame) -> DataFrame:
    """Names normalised, NaN -> null on float columns, decimals cast to double."""
    df = normalise_names(df)
    cols = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet (or any Spark-readable directory) → normalised DataFrame."""
    return normalise(spark.read.parquet(path))


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """CSV scan with pandas-like type inference.

    ``multi_line`` allows line feeds inside quotes, at the price of one task
    per file; without it a file is split over many tasks.

    All fields are read as strings, the NA tokens become null, then each
    column is cast to the narrowest of long / double / boolean that holds all
    its non-null values (one aggregate pass decides all columns); otherwise it
    stays a string (dates stay strings, as in pandas, and are sniffed by the
    role detector).
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line,
                         quote='"', escape='"', sep=sep)
    raw = normalise_names(raw)
    cleaned = raw.select(*[
        F.when(q(c).isin(NA_TOKENS) | F.trim(q(c)).isin(NA_TOKENS), F.lit(None)).otherwise(q(c)).alias(c)
        for c in raw.columns
    ])
    probes = []
    for c in cleaned.columns:
        v = q(c)
        probes += [
            F.count(v).alias(f"nn::{c}"),
            F.count(F.trim(v).try_cast("long")).alias(f"long::{c}"),
            F.count(F.when(F.trim(v).rlike(NUMBER), F.trim(v).try_cast("double"))).alias(f"double::{c}"),
            F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"bool::{c}"),
        ]
    stats = cleaned.agg(*probes).first().asDict() if cleaned.columns else {}
    out = []
    for c in cleaned.columns:
        nn = stats[f"nn::{c}"]
        v = q(c)
        if nn > 0 and stats[f"long::{c}"] == nn:
            out.append(F.trim(v).cast("long").alias(c))
        elif nn > 0 and stats[f"double::{c}"] == nn:
            d = F.trim(v).cast("double")
            out.append(F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d).alias(c))
        elif nn > 0 and stats[f"bool::{c}"] == nn:
            out.append(v.isin(TRUE_TOKENS).alias(c))
        elif nn == 0:
            out.append(F.lit(None).cast("double").alias(c))   # pandas: all-NA → float
        else:
            out.append(v.alias(c))
    return cleaned.select(*out)


def preview(df: DataFrame, n: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; give ``order_by`` for a deterministic preview."""
    if order_by:
        df = df.orderBy(*[q(c) for c in order_by])
    return df.limit(n)
