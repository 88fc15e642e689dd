"""Column-role detection and table profile (ROL1–ROL7).

* Profile: one ``agg`` over the table gives row count, per-column non-null count, mean string length, a
  HyperLogLog distinct count (a mergeable sketch of 2^``SKETCH_BITS`` registers) and, for string columns, how many values have the character
  shape of each datetime pattern.
* Dates: only columns whose values all have shapes of one pattern are read again; there each value is
  parsed once, with the pattern of its shape.
* Distinct counts: exact where a role rule needs them.  ``detect`` counts exactly only the columns
  whose sketch is within its error of a threshold (2 values, ``max_categories``, ``id_min_unique``, the unique ratio);
  ``column_roles`` can count all.  Exact counts use 128-bit fingerprints ``(xxhash64(v), xxhash64('~', v))``: the
  shuffle carries 16 bytes per distinct (column, value) per map task instead of the values, and map-side combining
  makes hot values cheap.

The role rules then run as a ``when`` chain over the one-row-per-column profile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.options import Options
from tablelens.sources.tables import q

# Datetime patterns tried when sniffing string columns.
DATETIME_PATTERNS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "M/d/yyyy",
    "M/d/yyyy HH:mm[:ss]",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "dd.MM.yyyy",
    "yyyy-MM",
    "HH:mm",
    "HH:mm:ss",
]
_SNIFF_MIN_LEN, _SNIFF_MAX_LEN = 3, 32      # no value of a pattern above is shorter or longer

#: Character shapes (a run of digits: 0, a run of letters: a) and the patterns that can hold them, as positions in
#: DATETIME_PATTERNS.  Of the slashed forms, those that start with four digits are year first.
_SHAPES = {
    "0-0-0": 0, "0-0-0 0:0": 1, "0-0-0 0:0:0": 2, "0-0-0 0:0:0.0": 2, "0-0-0a0:0:0": 3, "0-0-0a0:0:0.0": 3,
    "0/0/0": 6, "0/0/0 0:0": 7, "0/0/0 0:0:0": 7, "0 a 0": 8, "a 0, 0": 10, "0.0.0": 12, "0-0": 13, "0:0": 14, "0:0:0": 15,
}
_ZONES = ["a", "+0:0", "-0:0"]
_YEAR_FIRST = {6: 4, 7: 5}
#: Short and full month names share a shape; May is both.
_FULL_NAME = {8: 9, 10: 11}

#: log2 of the registers of a distinct-count sketch, its relative standard deviation, and the deviations a gate allows for.
SKETCH_BITS, SKETCH_ERROR, DEVIATIONS = 14, 0.0083, 5

ROLE_NUMERIC, ROLE_CATEGORICAL, ROLE_DATETIME = "numeric", "categorical", "datetime"
ROLE_ID, ROLE_TEXT, ROLE_NONE, ROLE_UNSUPPORTED = "id", "text", "none", "unsupported"


def family(dt: T.DataType) -> str:
    if isinstance(dt, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                       T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "nested"


def _hash_value(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)      # -0.0 and 0.0 are one value
    return c


def _fingerprints(df: DataFrame, ordinals: set[int] | None = None) -> DataFrame:
    """(ordinal, h1, h2) for every non-null cell (of the given columns), plus ordinal -1 for whole rows."""
    structs = []
    hashable = []
    for i, f in enumerate(df.schema.fields):
        if isinstance(f.dataType, T.MapType):
            continue
        v = _hash_value(q(f.name), f.dataType)
        hashable.append((f.name, v))
        if ordinals is None or i in ordinals:
            structs.append(F.when(q(f.name).isNotNull(), F.struct(
                F.lit(i).alias("ordinal"), F.xxhash64(v).alias("h1"),
                F.xxhash64(F.lit("~"), v).alias("h2"))))
    if hashable and (ordinals is None or -1 in ordinals):
        # the null mask keeps (null, x) and (x, null) apart
        mask = F.concat(*[F.when(q(n).isNull(), F.lit("1")).otherwise(F.lit("0")) for n, _ in hashable])
        vals = [v for _, v in hashable]
        structs.append(F.struct(F.lit(-1).alias("ordinal"), F.xxhash64(mask, *vals).alias("h1"),
                                F.xxhash64(F.lit("~"), mask, *vals).alias("h2")))
    return (df.select(F.explode(F.array(*structs)).alias("fp"))
            .where(F.col("fp").isNotNull()).select("fp.*"))


def distinct_counts(df: DataFrame, ordinals: set[int] | None = None) -> DataFrame:
    """Exact distinct count per ordinal (-1: distinct rows), of all columns or the given ones."""
    if ordinals is not None and not ordinals:
        return df.sparkSession.createDataFrame([], "ordinal int, n_distinct long")
    return (_fingerprints(df, ordinals).distinct().groupBy("ordinal")
            .agg(F.count(F.lit(1)).alias("n_distinct")))


def shape_class(c: Column) -> Column:
    """Position of the datetime pattern that a string's character shape belongs to (short month names and
    year last for shared shapes), or null."""
    forms = {form + zone: at for form, at in _SHAPES.items() for zone in ([""] + _ZONES if at in (2, 3) else [""])}
    forms |= {"year" + form: _YEAR_FIRST[at] for form, at in _SHAPES.items() if at in _YEAR_FIRST}
    known = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    shape = F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[A-Za-z]+", "a")
    year_first = F.when(c.rlike("^[0-9]{4}/"), F.lit("year")).otherwise(F.lit(""))
    return F.when(F.length(c).between(_SNIFF_MIN_LEN, _SNIFF_MAX_LEN), F.try_element_at(known, F.concat(year_first, shape)))


def _candidates(classed: int, least: int | None, most: int | None, n: int) -> list[int]:
    """Patterns whose shapes cover all ``n`` values, from the number of classed values and their least and greatest class."""
    full = {v: k for k, v in _FULL_NAME.items()}
    return [p for p in range(len(DATETIME_PATTERNS)) if n and classed == n and least == most == full.get(p, p)]


def _parsed(c: Column, patterns: list[int]) -> dict[int, Column]:
    """For each candidate pattern whether it holds the value; every value is parsed at most once.

    All values of the column have the shape of the candidates, which are one pattern, or the short and the full
    month name of one: a name of three letters is tried as the short form, and May counts for both."""
    if len(patterns) == 1:
        return {patterns[0]: F.try_to_timestamp(c, F.lit(DATETIME_PATTERNS[patterns[0]])).isNotNull()}
    short, full = sorted(patterns)
    name = F.regexp_extract(c, "[A-Za-z]+", 0)
    holds = F.when(F.length(name) <= 3, F.try_to_timestamp(c, F.lit(DATETIME_PATTERNS[short]))) \
        .otherwise(F.try_to_timestamp(c, F.lit(DATETIME_PATTERNS[full]))).isNotNull()
    return {short: holds & (F.length(name) <= 3), full: holds & ((F.length(name) > 3) | (F.lower(name) == "may"))}


_PROFILE = ("n_rows long, ordinal int, column string, dtype string, family string, n_non_null long, avg_len double, "
            "sketched long, parses_as_datetime boolean")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, mean length, sketched distinct count and whether all values are dates."""
    items = []
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        fam = family(f.dataType)
        none = F.lit(None).cast("double")
        shape = F.col(f"shape{i}")
        shapes = F.array(F.count(shape), F.min(shape).cast("long"), F.max(shape).cast("long")) if fam == "string" else F.array().cast("array<bigint>")
        sketch = F.lit(0).cast("long") if isinstance(f.dataType, T.MapType) \
            else F.hll_sketch_estimate(F.hll_sketch_agg(
                F.when(c.isNotNull(), F.xxhash64(_hash_value(c, f.dataType))), F.lit(SKETCH_BITS)))
        items.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(fam).alias("family"), F.count(c).alias("n_non_null"),
            (F.avg(F.length(c)).cast("double") if fam == "string" else none).alias("avg_len"),
            sketch.alias("sketched"), shapes.alias("shapes")))
    classed = df.select("*", *[shape_class(q(f.name)).alias(f"shape{i}") for i, f in enumerate(df.schema.fields)
                               if family(f.dataType) == "string"])
    rows = [r.asDict() for r in classed.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*items).alias("cols"))
            .select("n_rows", F.inline("cols")).collect()]        # one row per column
    tried = {r["ordinal"]: _candidates(*r["shapes"], r["n_non_null"]) for r in rows if r["family"] == "string"}
    probes = [F.count_if(holds).alias(f"d{i}_{p}") for i, ps in tried.items() if ps
              for p, holds in _parsed(q(df.columns[i]), ps).items()]
    dates = df.agg(*probes).first().asDict() if probes else {}
    out = [(r["n_rows"], r["ordinal"], r["column"], r["dtype"], r["family"], r["n_non_null"], r["avg_len"], r["sketched"],
            any(dates[f"d{r['ordinal']}_{p}"] == r["n_non_null"] for p in tried.get(r["ordinal"], []))) for r in rows]
    return df.sparkSession.createDataFrame(out, _PROFILE)


def gated(profile: list[dict], opts: Options = Options()) -> set[int]:
    """Columns whose sketched distinct count is within its error of a threshold that decides something."""
    margin = DEVIATIONS * SKETCH_ERROR
    near = lambda d, t: d * (1 - margin) <= t + 1 and d * (1 + margin) >= t - 1
    out = set()
    for r in profile:
        d, n = r["sketched"], r["n_non_null"]
        few = d * (1 - margin) <= opts.max_categories + 1         # number of levels: always exact
        ratio = r["family"] == "string" and d * (1 + margin) > opts.id_min_unique and near(d, opts.id_unique_ratio * n)
        least = r["family"] == "string" and near(d, opts.id_min_unique) and d * (1 + margin) > opts.id_unique_ratio * n
        if r["family"] in ("numeric", "string") and n and (few or ratio or least):
            out.add(r["ordinal"])
    return out


def column_roles(df: DataFrame, opts: Options = Options(), exact: bool = True) -> DataFrame:
    """Role table: ordinal, column, dtype, family, role, n_rows, n_non_null, n_missing, n_distinct, distinct_exact,
    unique_ratio, avg_len.  Without ``exact`` only the gated columns are counted exactly, the others sketched;
    the roles are the same."""
    profile = column_profile(df)
    wanted = None
    if not exact:
        wanted = gated([r.asDict() for r in profile.collect()], opts)
    dist = distinct_counts(df, wanted).where("ordinal >= 0")
    t = profile.join(F.broadcast(dist), "ordinal", "left")        # one row per column
    t = t.withColumn("distinct_exact", F.col("n_distinct").isNotNull() | (F.col("n_non_null") == 0))
    t = t.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0) if exact else F.least("sketched", "n_non_null")).cast("long"))
    ratio = F.when(F.col("n_non_null") > 0, F.col("n_distinct") / F.col("n_non_null"))
    role = (F.when(F.col("n_non_null") == 0, F.lit(ROLE_NONE))
            .when(F.col("family") == "nested", F.lit(ROLE_UNSUPPORTED))
            .when(F.col("family") == "numeric",
                  F.when(F.col("n_distinct") <= 2, F.lit(ROLE_CATEGORICAL)).otherwise(F.lit(ROLE_NUMERIC)))
            .when(F.col("family") == "datetime", F.lit(ROLE_DATETIME))
            .when(F.col("parses_as_datetime"), F.lit(ROLE_DATETIME))
            .when((ratio > opts.id_unique_ratio) & (F.col("n_distinct") > opts.id_min_unique), F.lit(ROLE_ID))
            .when(F.col("avg_len") > opts.text_avg_len_threshold, F.lit(ROLE_TEXT))
            .otherwise(F.lit(ROLE_CATEGORICAL)))
    return (t.select("ordinal", "column", "dtype", "family", role.alias("role"), "n_rows", "n_non_null",
                     (F.col("n_rows") - F.col("n_non_null")).alias("n_missing"), "n_distinct", "distinct_exact",
                     ratio.alias("unique_ratio"), "avg_len")
            .orderBy("ordinal"))


@dataclass
class RoleInfo:
    """The small role table on the driver, used only to *plan* later stages."""
    n_rows: int
    n_cols: int
    columns: list[dict] = field(default_factory=list)

    def of(self, role: str) -> list[str]:
        return [c["column"] for c in self.columns if c["role"] == role]

    @property
    def numeric(self) -> list[str]:
        return self.of(ROLE_NUMERIC)

    @property
    def categorical(self) -> list[str]:
        return self.of(ROLE_CATEGORICAL)

    def distinct(self, col: str) -> int:
        return next(c["n_distinct"] for c in self.columns if c["column"] == col)

    def missing(self, col: str) -> int:
        return next(c["n_missing"] for c in self.columns if c["column"] == col)

    def ordinal(self, col: str) -> int:
        return next(c["ordinal"] for c in self.columns if c["column"] == col)

    def eligible_categorical(self, opts: Options) -> list[str]:
        return [c for c in self.categorical if 2 <= self.distinct(c) <= opts.max_categories]


def detect(df: DataFrame, opts: Options = Options()) -> tuple[DataFrame, RoleInfo]:
    """Role table as a DataFrame plus its driver-side copy (one row per column)."""
    roles = column_roles(df, opts, exact=False)
    rows = [r.asDict() for r in roles.collect()]
    n_rows = rows[0]["n_rows"] if rows else df.count()
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], roles.schema), RoleInfo(
        n_rows=n_rows, n_cols=len(df.columns), columns=rows)


def table_summary(df: DataFrame) -> DataFrame:
    """n_rows, n_cols, n_duplicate_rows, n_missing_cells (ROL3–ROL5) in one row."""
    n_cols = len(df.columns)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    mask = F.concat(*[F.when(q(f.name).isNull(), F.lit("1")).otherwise(F.lit("0")) for f in fields])
    vals = [_hash_value(q(f.name), f.dataType) for f in fields]
    nulls = sum((F.when(q(c).isNull(), F.lit(1)).otherwise(F.lit(0)) for c in df.columns), F.lit(0))
    per_row = df.select(F.xxhash64(mask, *vals).alias("h1"), F.xxhash64(F.lit("~"), mask, *vals).alias("h2"),
                        nulls.cast("long").alias("nulls"))
    per_fp = per_row.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.sum("nulls").alias("s"))
    out = per_fp.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_rows"),
                     F.count(F.lit(1)).alias("n_distinct_rows"),
                     F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("n_missing_cells"))
    return out.select("n_rows", F.lit(n_cols).cast("long").alias("n_cols"),
                      (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicate_rows"),
                      "n_missing_cells")


def category_counts(df: DataFrame, columns: list[tuple[int, str]], top_n: int | None = 10,
                    with_share: bool = True) -> DataFrame:
    """Top-N value counts of every given column in one shuffle (ROL6, AGG6, LIM2).

    Order: count desc, value asc.  ``row_number() <= n`` lets Spark insert a
    partial WindowGroupLimit before the exchange, so no task ever holds all
    distinct values of a column.
    """
    structs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                        q(c).cast("string").alias("value")) for i, c in columns]
    long = df.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())
    vc = long.groupBy("ordinal", "column", "value").agg(F.count(F.lit(1)).alias("count"))
    out = vc
    if top_n is not None:
        w = Window.partitionBy("ordinal").orderBy(F.desc("count"), F.asc("value"))
        out = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    if with_share:
        tot = long.groupBy("ordinal").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(F.broadcast(tot), "ordinal").withColumn(
            "share", F.col("count") / F.col("_n")).drop("_n")
    return out


def column_overview(roles: DataFrame, k: int = 8) -> DataFrame:
    """Per role: number of columns and the first k names in ordinal order (ROL7)."""
    return (roles.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))),
                            lambda s: s["column"]), 1, k).alias("first_columns")))
