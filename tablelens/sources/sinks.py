"""Sinks for result tables (all distributed writers, nothing routed via the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows (structs / arrays / maps) as splittable JSON lines; null fields are written."""
    df.write.option("ignoreNullFields", False).mode(mode).json(path)


def write_key_values(df: DataFrame, key: str, value: str, path: str, mode: str = "overwrite") -> None:
    """``key: value`` text lines (EDA summary file)."""
    df.select(F.concat_ws(": ", F.col(key), F.col(value).cast("string")).alias("value")) \
        .write.mode(mode).text(path)


def write_tables(results: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> list[str]:
    """Write every result table of an analysis under ``root/<name>``."""
    written = []
    for name, df in results.items():
        if not isinstance(df, DataFrame):
            continue
        target = f"{root.rstrip('/')}/{name}"
        df.write.mode(mode).format(fmt).save(target)
        written.append(target)
    return written
