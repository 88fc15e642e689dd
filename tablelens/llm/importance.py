"""Importance resampling towards a target table, with hashed word features.

1. Features. A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, all runs of 1 to ``max_words``
   consecutive words joined by one blank, repeats counted. A feature's bucket is the unsigned crc32 of its
   bytes modulo ``n_buckets``.
2. Buckets. The distinct features of a slice of texts are grouped by equal length into two-dimensional
   uint8 matrices; one table step per column updates the checksums of all rows, and the buckets are
   scattered back to the occurrences. A feature beyond ``WIDE`` bytes is laid out as several rows of
   ``WIDE`` bytes, whose checksums are joined by the linear map of ``WIDE`` zero bytes. The bucket list of every
   document is written once (2 or 4 bytes a feature); nothing reads the texts again.
3. Gains. Bucket counts are added up per task, then over tasks, for the source and the target. The gain
   table has ``n_buckets`` rows, whatever the size of the input: it is the only thing the driver sees.
4. Scores. ``weight`` is the floored mean of the gains, ``score`` adds the Gumbel noise of the row's key.
5. Draw. Rows that may be drawn are range-partitioned by (score, id) and written once with their
   position in the partition; a rank is the number of rows in the partitions before, plus that position.
   Equal scores and equal ids are spread over partitions by a row number, so no group meets in one task.

Defined results: null and empty texts have no feature and weight 0; a null id takes the noise of the
empty key and, in ties, comes first; repeated rows are scored, and drawn, each on its own; an empty target gives
every bucket the gain of its rarity in the source; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, slices, stable, table

#: Longest row of a checksum matrix.
WIDE = 512
#: Bytes of one text whose features are held at once.
BLOCK = 4_000_000

# Word bytes are 0-9, a-z and everything from 0x80; the rest becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


# ---------------------------------------------------------------- checksums by columns

def _table() -> np.ndarray:
    """The byte table of crc32, from its reflected polynomial."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)
    return crc


_TABLE = _table()


def crc_columns(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The registers ``state`` after the bytes of each row of ``rows``, one column at a time."""
    for column in rows.T:
        state = _TABLE[(state ^ column) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


#: Byte j of a register, moved over WIDE zero bytes.
_SHIFT = [crc_columns(np.zeros((256, WIDE), np.uint8), np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)]


def _wide_crc(feature: bytes) -> int:
    """Checksum of one long feature: its head, then rows of WIDE bytes joined by the shift."""
    head = len(feature) % WIDE
    state = crc_columns(np.frombuffer(feature, np.uint8, head)[None, :], np.full(1, 0xFFFFFFFF, np.uint32))[0]
    body = np.frombuffer(feature, np.uint8, offset=head).reshape(-1, WIDE)
    for part in crc_columns(body, np.zeros(len(body), np.uint32)):
        state = (_SHIFT[0][state & 255] ^ _SHIFT[1][(state >> 8) & 255] ^ _SHIFT[2][(state >> 16) & 255]
                 ^ _SHIFT[3][state >> 24] ^ part)
    return int(state) ^ 0xFFFFFFFF


def feature_buckets(features: set[bytes], n_buckets: int) -> dict[bytes, int]:
    """The bucket of every distinct feature."""
    by_length: dict[int, list[bytes]] = {}
    for f in features:
        by_length.setdefault(len(f), []).append(f)
    out: dict[bytes, int] = {}
    for length, group in by_length.items():
        if length > WIDE:
            out.update((f, _wide_crc(f) % n_buckets) for f in group)
            continue
        rows = np.frombuffer(b"".join(group), np.uint8).reshape(len(group), length)
        crc = crc_columns(rows, np.full(len(group), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
        out.update(zip(group, (crc % np.uint32(n_buckets)).tolist()))
    return out


# ---------------------------------------------------------------- texts to bucket lists

def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of at most BLOCK bytes (or one longer word)."""
    folded = text.translate(_FOLD)
    at = 0
    while len(folded) - at > BLOCK:
        cut = folded.rfind(b" ", at, at + BLOCK)
        if cut <= at:
            cut = folded.find(b" ", at + BLOCK)
            if cut < 0:
                break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


def runs(words: list[bytes], max_words: int, tail: list[bytes]) -> list[bytes]:
    """All runs that end in ``words``; ``tail`` holds up to ``max_words - 1`` words before them."""
    out = list(words)
    for n in range(2, max_words + 1):
        line = tail[len(tail) - min(len(tail), n - 1):] + words
        out += map(b" ".join, zip(*(line[k:] for k in range(n))))
    return out


def encode_texts(texts: list[bytes | None], n_buckets: int, max_words: int, dtype) -> tuple[list[int], list[bytes]]:
    """Number of words and bucket list (as bytes) of each text."""
    n_words, pieces, held, owner, size = [], [[] for _ in texts], [], [], 0

    def flush():
        nonlocal size
        bucket = feature_buckets(set().union(*held), n_buckets) if held else {}
        for i, features in zip(owner, held):
            pieces[i].append(np.fromiter(map(bucket.__getitem__, features), dtype, len(features)).tobytes())
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        total, tail = 0, []
        for words in word_blocks(text or b""):
            total += len(words)
            held.append(runs(words, max_words, tail))
            owner.append(i)
            size += sum(map(len, words))
            tail = (tail + words)[-(max_words - 1):] if max_words > 1 else []
            if size > BLOCK:
                flush()
        n_words.append(total)
    flush()
    return n_words, [b"".join(p) for p in pieces]


def _dtype(n_buckets: int):
    return np.dtype("<u2") if n_buckets <= 1 << 16 else np.dtype("<u4")


def hash_features(df: DataFrame, n_buckets: int = 10_000, max_words: int = 1, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``id, n_words, buckets`` (little-endian bucket numbers, one per feature) for every row of ``df``."""
    dtype = _dtype(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text", BLOCK)):
            n_words, buckets = encode_texts(part.column("text").cast(pa.binary()).to_pylist(), n_buckets, max_words, dtype)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_words, pa.int64()), pa.array(buckets, pa.binary())],
                ["id", "n_words", "buckets"])
    return scan(df, {"id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(
        run, "id long, n_words long, buckets binary")


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and the number of features of each row."""
    sizes = np.array([len(x) for x in column.to_pylist()], np.int64) // dtype.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype), sizes


def bucket_counts(hashed: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, n`` over all rows: one partial count per task and bucket, then their sums."""
    dtype = _dtype(n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for b in (p for x in batches for p in slices(x, "buckets")):
            counts += np.bincount(_flat(b.column("buckets"), dtype)[0], minlength=n_buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["bucket", "n"])
    return hashed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, gain`` of all ``n_buckets`` buckets from two tables of bucket counts."""
    spark = source.sparkSession
    both = (spark.range(n_buckets).select(F.col("id").alias("bucket"))
            .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
            .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]))
    totals = both.agg((F.sum("s") + n_buckets).alias("s_all"), (F.sum("t") + n_buckets).alias("t_all"))     # one row
    ratio = ((F.col("t") + 1) * F.col("s_all")) / ((F.col("s") + 1) * F.col("t_all"))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of the Gumbel variate of ``sha256("<seed>:<key>")``, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n_buckets: int = 10_000,
             max_words: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` for every row of ``df``; see the module text.

    ``rank`` numbers the drawn rows (``percent`` % of those with ``min_words`` words or more) from 1."""
    spark, dtype = df.sparkSession, _dtype(n_buckets)
    hashed = stable(hash_features(df, n_buckets, max_words, id_col, text_col))
    aimed = hash_features(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")),
                          n_buckets, max_words, "id", "text")
    gains = np.zeros(n_buckets, np.int64)
    for r in bucket_gains(bucket_counts(hashed, n_buckets), bucket_counts(aimed, n_buckets), n_buckets).collect():
        gains[r.bucket] = r.gain                                 # n_buckets rows, a parameter
    shared = spark.sparkContext.broadcast(gains)                 # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in slices(x, "buckets")):
            flat, sizes = _flat(b.column("buckets"), dtype)
            sums = np.r_[0, np.cumsum(shared.value[flat])]
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("n_words"), pa.array(sizes), pa.array(total // np.maximum(sizes, 1))],
                ["id", "n_words", "n_features", "weight"])

    rows = stable(hashed.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
                  .withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
                  .withColumn("seq", F.monotonically_increasing_id()))
    shared.destroy()
    may = rows.where(F.col("n_words") >= min_words)
    drawn = may.count() * percent // 100
    out = ["id", "n_words", "n_features", "weight", "score"]
    ranked = rank_rows(may, [F.desc("score"), F.asc("id"), F.asc("seq")])
    return ranked.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(
        rows.where(F.col("n_words") < min_words).select(*out, F.lit(None).cast("long").alias("rank")))


def rank_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``place``, the row's position (from 0) in the whole table's ``order``.

    The partitions of one range partitioning are written once, each row with its position in its partition;
    the offsets of the partitions are a table of one row per partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()                          # partition << 33 | position
    rows = stable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at__", at))
    part = F.shiftright("at__", 33)
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)          # one row per partition
    offsets = rows.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__")).select(
        "part__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__"))
    return (rows.withColumn("part__", part).join(F.broadcast(offsets), "part__")
            .withColumn("place", F.col("before__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("part__", "before__", "at__"))


# crc32 from its polynomial: the 256-entry table is computed, then folded over the bytes of each distinct word.
OP11_SQL = r"""
WITH RECURSIVE poly(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN (c & 1) = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT kind, row, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT kind, row, unnest(ws) AS w FROM worded),
buckets AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
         list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda p: ('0x' || p)::BIGINT)),
         lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), crc_table),
occurrences AS (SELECT kind, row, bucket FROM words JOIN buckets USING (w)),
totals AS (SELECT count(*) FILTER (kind = 0) AS s_all, count(*) FILTER (kind = 1) AS t_all FROM occurrences),
gains AS (
  SELECT bucket, floor(1000 * ln(((count(*) FILTER (kind = 1) + 1)::DOUBLE * (s_all + 10000)::DOUBLE)
         / ((count(*) FILTER (kind = 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM occurrences, totals GROUP BY bucket, s_all, t_all),
weights AS (
  SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM occurrences JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
scored AS (
  SELECT id AS doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM worded LEFT JOIN weights USING (row) WHERE kind = 0),
full_score AS (
  SELECT doc_id, n_features, weight,
         weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS n FROM full_score)
SELECT doc_id, n_features, weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""


@query("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20,
                    n_buckets=10_000, max_words=1, seed=2024).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
