"""Exact, distributed ranking of values within key groups (WIN1): average ranks for Spearman,
Mann-Whitney U and Kruskal-Wallis H.  (Quantiles need no ranks: see ``selection``.)

Scale design
------------
A running ``sum(cnt) OVER (PARTITION BY key ORDER BY value)`` puts a whole
key group (e.g. all distinct values of one continuous column) into one task.
Instead:

1. collapse to distinct ``(key, value) -> cnt`` (hash aggregate with map-side
   combine: a hot value costs one row per map task, not a third of the data);
2. ``repartitionByRange(key, value)`` — every task holds one contiguous slice
   of the value order;
3. per task, a prefix sum over its sorted slice (``mapInPandas``);
4. a tiny table ``(partition, key) -> slice total`` (at most partitions + keys
   rows) gives each slice its global offset through a window, and is joined
   back (broadcast behind a row-count check).

Step 3's output is checkpointed so that partition ids stay consistent if a
task is re-run.  Every task is bounded by (distinct values / partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import shuffle_partitions, stable

BROADCAST_ROWS = 200_000


def unpivot(df: DataFrame, columns: list[tuple[int, str]], value_type: str = "double",
            key: str = "ordinal", value: str = "value", keep: list[Column] | None = None) -> DataFrame:
    """Narrow unpivot: one row per (input row, column) as (key, value) — no shuffle."""
    from tablelens.sources.tables import q
    structs = [F.struct(F.lit(i).alias(key), q(c).cast(value_type).alias(value)) for i, c in columns]
    cols = [F.inline(F.array(*structs))]
    if keep:
        cols = list(keep) + cols
    return df.select(*cols)


def _prefix_fn(key_names: list[str]):
    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[key_names]
            change = keys.ne(keys.shift()).any(axis=1)
            change.iloc[0] = True
            seg = change.cumsum()
            cnt = pdf["cnt"].astype("int64")
            below = cnt.groupby(seg).cumsum() - cnt
            first_key = tuple(keys.iloc[0].tolist())
            if last_key is not None and first_key == last_key:
                below = below.where(seg != 1, below + carry)
            pdf["_local_below"] = below.astype("int64")
            pdf["_pid"] = pid
            last_key = tuple(keys.iloc[-1].tolist())
            carry = int(below.iloc[-1] + cnt.iloc[-1])
            yield pdf
    return run


def rank_table(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None,
               num_partitions: int | None = None, max_key_groups: int | None = None) -> DataFrame:
    """Distinct values per key group with exact positions.

    Returns ``keys..., value, cnt, below, n`` where ``below`` is the number of
    rows of the group with a smaller value and ``n`` the group size.  Nulls
    are ignored.  ``weight`` sums pre-counted rows instead of counting.
    ``max_key_groups`` bounds the number of key groups (for the broadcast check).
    """
    spark = df.sparkSession
    agg = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight))
    vc = (df.where(F.col(value).isNotNull())
          .groupBy(*keys, value).agg(agg.cast("long").alias("cnt")))
    parts = num_partitions or shuffle_partitions(spark)
    ranged = vc.repartitionByRange(parts, *keys, value).sortWithinPartitions(*keys, value)
    out_schema = T.StructType(vc.schema.fields + [
        T.StructField("_local_below", T.LongType()), T.StructField("_pid", T.IntegerType())])
    local = stable(ranged.mapInPandas(_prefix_fn(keys), out_schema))
    totals = local.groupBy("_pid", *keys).agg(F.sum("cnt").alias("_slice"))
    by_key = Window.partitionBy(*keys)
    offsets = totals.select(
        "_pid", *keys,
        (F.sum("_slice").over(by_key.orderBy("_pid")) - F.col("_slice")).alias("_offset"),
        F.sum("_slice").over(by_key).alias("n"))
    bound = parts + (max_key_groups if max_key_groups is not None else BROADCAST_ROWS)
    if bound <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return local.join(offsets, ["_pid", *keys]).select(
        *keys, value, "cnt", (F.col("_offset") + F.col("_local_below")).alias("below"), "n")


def with_midrank(rt: DataFrame) -> DataFrame:
    """Average rank (1-based) of each distinct value: below + (cnt + 1) / 2."""
    return rt.withColumn("midrank", F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))
