"""Contiguous, byte-balanced shards from global prefix sums (DataFrame operations only).

1. Only ``(id, size, crc32)`` travels: the rows are range-partitioned by id and written
   once with the number of their partition, so that every later step sees the same cut.
2. One row per partition gives totals; their running sums are each partition's offset
   (a table of as many rows as there are partitions).
3. A window inside each partition adds the running sum, and the row's mid-point in the
   global byte order, divided by ``total / n_shards``, is its shard.

Defined results: a null text has only the fixed ``overhead`` as its size and the crc32 of
no bytes (0); null ids come first; equal ids (repeated rows) are ordered by size, crc32 and
scan position, each keeps its own slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, stable, table


def shard_by_bytes(df: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row of ``df``; see the module text."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scan(df, {"id": (id_col, "long"), "text": (text_col, "string")}).select(
        "id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seq"))
    rows = stable(rows.repartitionByRange(parts, "id", "size", "text_crc32", "seq")
                  .withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy("id", "size", "text_crc32", "seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (rows.join(F.broadcast(offsets), "part")      # bounded: one row per partition
              .withColumn("upto", F.col("bytes_before") + F.sum("size").over(inside))
              .withColumn("row", F.col("rows_before") + F.count(F.lit(1)).over(inside) - 1)
              # twice the mid-point over twice the target, by integer division
              .withColumn("shard", F.least(F.lit(n_shards - 1).cast("long"), F.expr(
                  f"cast(2 * upto - size as decimal(22, 0)) * {int(n_shards)} div cast(2 * total as decimal(22, 0))")).cast("int")))
    # The slots of a shard start after all rows of the partitions and shards before it.
    counts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))        # at most n_shards rows
    return placed.join(F.broadcast(counts), "shard").select(
        "id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


# crc32 from its polynomial: the 256-entry table is computed, then folded over the bytes in hexadecimal.
OP5_SQL = """
WITH RECURSIVE poly(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN (c & 1) = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
sized AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
         list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                     lambda p: ('0x' || p)::BIGINT)) AS bs
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295::BIGINT,
         list_reduce(bs, lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS text_crc32
  FROM sized, crc_table),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER () AS total
  FROM summed),
cut AS (
  SELECT *, least(39, ((2 * upto - size)::HUGEINT * 40) // (2 * total)::HUGEINT)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM cut
"""


@query("op5_sharding", OP5_SQL)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
