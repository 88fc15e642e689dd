"""Exact quantiles without a sort: bracketed selection (AGG5), and the box statistics built on it (AGG17, DQ2).

For every key group and probability the wanted order statistics are enclosed, counted and then picked:

1. **Sketch.** One aggregate gives each group its size and a mergeable quantile summary (``percentile_approx`` over a
   grid of ``GRID`` steps, rank error 1 / ``ACCURACY``). The grid values one step outside the wanted rank are a bracket
   that is certain to hold it. Groups of up to ``10 * GRID`` values take their minimum and maximum.
2. **Narrowing.** A bracket of more than ``limit`` distinct values is sketched again, inside itself: each pass leaves about
   3 / ``GRID`` of its values, so groups of up to 10^7 values need none and 10^10 one. A bracket that shrinks no more holds
   frequent values and few distinct ones.
3. **Count.** One aggregate counts, exactly, the values below each bracket (all under one key: a row a task) and
   each distinct value inside (map-side combined, so a frequent value is a row a task too).
4. **Pick.** Running counts over the at most ``limit`` distinct values of a bracket give the two neighbours of the wanted
   rank, which are interpolated linearly (pandas, numpy ``linear``).

Only steps 1 to 3 see the rows. Nothing is range-partitioned and no row leaves its partition uncounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import stable

GRID = 1_000
ACCURACY = 10_000
#: Distinct values of one bracket that are ranked together.
LIMIT = 50_000


def _grid(value: Column) -> Column:
    """Approximate quantiles at 0, 1 / GRID, ..., 1."""
    steps = F.expr("array(" + ", ".join(f"{j / GRID!r}D" for j in range(GRID + 1)) + ")")
    return F.percentile_approx(value, steps, ACCURACY)


def _enclose(grid: Column, low: Column, high: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Grid values one step outside the relative ranks ``low`` and ``high``; beyond the grid ``first`` and ``last``."""
    a = (F.floor(low * GRID) - 1).cast("int")
    b = (F.ceil(high * GRID) + 1).cast("int")
    return (F.when(a >= 0, F.element_at(grid, F.greatest(a, F.lit(0)) + 1)).otherwise(first),
            F.when(b <= GRID, F.element_at(grid, F.least(b, F.lit(GRID)) + 1)).otherwise(last))


def _brackets(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """keys, i, n, lo, hi, frac, a, b, distinct: a first bracket for every group and probability."""
    v = F.col("value")
    sketch = long.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("first"), F.max(v).alias("last"), _grid(v).alias("grid"))
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(float(p))
        a, b = _enclose(F.col("grid"), F.lit(float(p)), F.lit(float(p)), F.col("first"), F.col("last"))
        few = F.col("n") <= 10 * GRID
        wanted.append(F.struct(
            F.lit(i).alias("i"), F.floor(h).alias("lo"), F.ceil(h).alias("hi"), (h - F.floor(h)).alias("frac"),
            F.when(few, F.col("first")).otherwise(a).alias("a"), F.when(few, F.col("last")).otherwise(b).alias("b"),
            F.when(few, F.lit(0)).otherwise(F.col("n") * 4 / GRID).alias("distinct")))
    return sketch.select(*keys, "n", F.inline(F.array(*wanted)))


def _narrowed(long: DataFrame, keys: list[str], wide: DataFrame) -> DataFrame:
    """The brackets ``wide`` after one more sketch, inside each of them."""
    inside = F.when(F.col("value") >= F.col("a"), F.col("value"))
    seen = (long.join(wide.select(*keys, "i", "a", "b"), keys).where(F.col("value") <= F.col("b")).groupBy(*keys, "i")
            .agg(F.count_if(F.col("value") < F.col("a")).alias("below"), F.count(inside).alias("size"),
                 F.approx_count_distinct(inside).alias("found"), _grid(inside).alias("grid")))
    at = lambda rank: (F.col(rank) - F.col("below")) / F.col("size")
    a, b = _enclose(F.col("grid"), at("lo"), at("hi"), F.col("a"), F.col("b"))
    shrinks = (F.col("size") > 10 * GRID) & ((a > F.col("a")) | (b < F.col("b")))
    return wide.join(seen, [*keys, "i"]).select(
        *keys, "n", "i", "lo", "hi", "frac", F.when(shrinks, a).otherwise(F.col("a")).alias("a"),
        F.when(shrinks, b).otherwise(F.col("b")).alias("b"),
        F.when(shrinks, F.least(F.col("found"), F.col("size") * 4 / GRID)).otherwise(F.lit(0)).alias("distinct"))


def quantiles(df: DataFrame, keys: list[str], probs: list[float], value: str = "value", limit: int = LIMIT) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` (nulls ignored) per key group: ``keys..., n, q_<i>``.

    Keys must not be null; a group without a value has no row. At most 31 probabilities."""
    long = df.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull())
    brackets = stable(_brackets(long, keys, probs))
    while (wide := brackets.where(F.col("distinct") > limit)).limit(1).count():
        brackets = stable(brackets.where(F.col("distinct") <= limit).unionByName(_narrowed(long, keys, wide)))
    across = brackets.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}")
                                           for i in range(len(probs)) for c in ("a", "b")])
    below = sum((F.when(F.col("value") < F.col(f"a{i}"), 1 << i).otherwise(0) for i in range(len(probs))), F.lit(0))
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | F.col("value").between(F.col(f"a{i}"), F.col(f"b{i}"))
    counted = stable(long.join(across, keys).groupBy(*keys, below.alias("below"), F.when(inside, F.col("value")).alias("v"))
                     .agg(F.count(F.lit(1)).alias("cnt")))
    under = F.expr("(below & shiftleft(1, i)) != 0")
    both = counted.join(brackets, keys)
    base = both.groupBy(*keys, "i").agg(F.sum(F.when(under, F.col("cnt")).otherwise(0)).alias("base"))
    ordered = Window.partitionBy(*keys, "i").orderBy("v")          # at most ``limit`` values, or those of a small group
    placed = (both.where(F.col("v").between(F.col("a"), F.col("b")))
              .withColumn("upto", F.sum("cnt").over(ordered)).join(base, [*keys, "i"])
              .withColumn("upto", F.col("upto") + F.col("base")).withColumn("from", F.col("upto") - F.col("cnt")))
    holds = lambda rank: (F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    picked = placed.groupBy(*keys, "i", "n", "frac").agg(F.max(F.when(holds("lo"), F.col("v"))).alias("vlo"),
                                                         F.max(F.when(holds("hi"), F.col("v"))).alias("vhi"))
    at = F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")
    return picked.groupBy(*keys).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("i") == i, at)).alias(f"q_{i}") for i in range(len(probs))])


QUARTILES = [0.25, 0.5, 0.75]


def box_stats(df: DataFrame, keys: list[str], value: str = "value", whisker: float = 1.5,
              quartiles: DataFrame | None = None) -> DataFrame:
    """Box-plot statistics per key group: q1, median, q3, IQR fences, whiskers (extreme data inside the
    fences), number of fliers, min and max. One more aggregate over the rows after ``quantiles``."""
    long = df.select(*keys, F.col(value).alias("value")).where(F.col("value").isNotNull())
    qs = quartiles if quartiles is not None else quantiles(long, keys, QUARTILES)
    qs = qs.select(*keys, "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    qs = stable(qs.withColumn("iqr", F.col("q3") - F.col("q1"))
                .withColumn("lower_fence", F.col("q1") - F.lit(whisker) * F.col("iqr"))
                .withColumn("upper_fence", F.col("q3") + F.lit(whisker) * F.col("iqr")))
    v = F.col("value")
    inside = v.between(F.col("lower_fence"), F.col("upper_fence"))
    seen = long.join(qs.select(*keys, "lower_fence", "upper_fence"), keys).groupBy(*keys).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"), F.min(v).alias("min"), F.max(v).alias("max"))
    # a whisker never lies inside the box: without a point between quartile and fence it ends at the quartile
    return (qs.join(seen, keys).withColumn("whisker_low", F.least("whisker_low", "q1"))
            .withColumn("whisker_high", F.greatest("whisker_high", "q3")))
