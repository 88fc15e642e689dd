"""MinHash near-duplicates with circulant signatures.

Set of a text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, distinct ``shingle``-word runs joined by a blank
(fewer words: the whole sequence; none: the empty set, linked with nothing). Two sets are linked if
``100 * common >= percent * union``.

1. Signatures. Two permutations of the 64-bit words, ``SIGMA`` and ``PI`` (each an invertible mix), make every coordinate:
   coordinate k of a set is the least ``PI(SIGMA(x) + k)`` over its hashed shingles x, that is PI shifted
   circularly by k. No further hash function is drawn.
2. Nodes. Rows with the same set are one node (its sorted 64-bit shingle hashes, hashed to 128 bits).
3. Bands. ``BANDS`` bands of ``ROWS`` coordinates: two sets at 0.85 meet in no band with odds of about 1 in 120,000, those
   above it more rarely. A bucket is the nodes with equal values in a band.
4. Exact check. A task gets the normalised texts of a bucket, one per node, numbers their shingles (full strings, not
   hashes), and counts the common ones of its nodes by products of 0/1 matrices. It emits one edge from each
   node to the first node of its local component, never a list of pairs.
5. Rounds. ``FIRST`` bands are checked first. Buckets whose nodes all hang together then hold no open question; the
   others are checked with the remaining bands. A bucket beyond ``NODES`` nodes or ``SHINGLES`` shingles is dealt out at
   random in these two rounds. If it still holds several components afterwards, the nodes outside its largest component are
   compared, in blocks, with all others. (A bucket beyond ``AGAIN`` nodes first splits by prefix shingles: with the shingles
   of every set in one order, the rarest in the bucket's nodes first, two linked sets share one of their first
   ``size - ceil(percent * size / 100) + 1``. Unlike texts that share a frequent passage part there, no linked ones do.) So
   a task holds a bounded number of shingles, or one text, nothing is cut off, and every two sets of a bucket that are
   linked end in one component, whatever the bucket's size: the splits only save comparisons.
6. Components by large-star and small-star steps, as in the SimHash operator.

Defined results: null and empty texts and texts of blanks have size 0 and are components of their own; the component id is
the smallest non-null doc_id of the component (null only if no member has one); ``kept`` marks the rows that
carry it, so rows repeated with that id are each marked; an empty table gives no rows. A text's distinct shingles
must fit in a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, slices, stable, table
from tablelens.llm.simhash import components, merge

BANDS, ROWS = 20, 5
#: Bands of the first round.
FIRST = 3
#: Nodes and shingles of a block; at most two blocks meet in one task.
NODES, SHINGLES = 500, 500_000
#: Nodes of a bucket that splits by prefix shingles, and counters of the sketch that orders the shingles.
AGAIN = 20_000
COUNTERS = 1 << 18
#: Columns of an incidence matrix.
COLUMNS = 4_096


# ---------------------------------------------------------------- sets and signatures

def shingles(text: bytes | None, shingle: int) -> set[bytes]:
    """Distinct shingles of a normalised text (see ``normalise``)."""
    words = (text or b"").split(b" ")
    if len(words) <= shingle:
        return {text} if text else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))


def normalise(text: bytes | None) -> bytes:
    """A-Z lower-cased, words joined by one blank (bytes: only ASCII letters and blanks are touched)."""
    return b" ".join((text or b"").lower().split())


def _mix(x: np.ndarray, keys: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 64-bit words: xor-shifts and odd multipliers are each invertible."""
    add, m1, m2 = (np.uint64(k) for k in keys)
    x = x + add
    x = (x ^ (x >> np.uint64(30))) * m1
    x = (x ^ (x >> np.uint64(27))) * m2
    return x ^ (x >> np.uint64(31))


#: The two permutations (odd multipliers).
SIGMA = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PI = (0xD1B54A32D192ED03, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least PI(SIGMA(x) + k), k = 0, 1, ..., size - 1."""
    placed = _mix(hashes, SIGMA)
    shifts = np.arange(size, dtype=np.uint64)
    least = np.full(size, ~np.uint64(0))
    for at in range(0, len(placed), 256):                         # a block of the matrix stays in cache
        np.minimum(least, _mix(placed[at:at + 256, None] + shifts, PI).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, set_a, set_b`` (the set's 128-bit name), ``bands`` (one 64-bit value per band) and ``words``
    (the normalised text, compressed) for every row; null names and bands for the empty set."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest
    from zstandard import ZstdCompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = ZstdCompressor(level=1).compress
        for part in (p for b in batches for p in slices(b, "text")):
            out = {"n_shingles": [], "set_a": [], "set_b": [], "bands": [], "words": []}
            for raw in part.column("text").cast(pa.binary()).to_pylist():
                words = normalise(raw)
                found = shingles(words, shingle)
                a = b = bands = None
                if found:
                    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
                    hashes.sort()
                    a, b = np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64).tolist()
                    coords = signature(hashes, BANDS * ROWS).reshape(BANDS, ROWS)
                    bands = [xxh3_64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(coords)]
                for name, value in zip(out, (len(found), a, b, bands, pack(words))):
                    out[name].append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array(v, t) for v, t in zip(out.values(), types)]], ["id", *out])
    return scan(docs, {"id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(
        run, "id long, n_shingles long, set_a long, set_b long, bands array<long>, words binary")


# ---------------------------------------------------------------- exact check inside a bucket

def common_counts(sets: list[set[bytes]]) -> np.ndarray:
    """Number of common members of every two sets, by products of 0/1 matrices over the members of two sets or more."""
    number: dict[bytes, int] = {}
    members = [np.fromiter((number.setdefault(x, len(number)) for x in s), np.int64, len(s)) for s in sets]
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(sets)), [len(m) for m in members])
    often = np.bincount(flat, minlength=len(number)) > 1
    column = np.cumsum(often) - 1                                 # members of one set only count in its size
    flat, owner = flat[often[flat]], owner[often[flat]]
    flat = column[flat]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    counts = np.zeros((len(sets), len(sets)), np.int64)
    total = int(often.sum())
    for at in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(flat, [at, at + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        block[owner[lo:hi], flat[lo:hi] - at] = 1
        counts += (block @ block.T).astype(np.int64)              # exact: sums of at most COLUMNS ones
    return counts


def bucket_links(nodes: list[int], texts: list[bytes], shingle: int, percent: int) -> list[tuple[int, int]]:
    """``(node, first node of its component)`` for the nodes that hang together through links among them."""
    sets = [shingles(t, shingle) for t in texts]
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(nodes) == 2 and 100 * sizes.min() < percent * sizes.max():
        return []
    both = common_counts(sets)
    i, j = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1))
    label = merge(np.arange(len(nodes)), i, j)
    return [(nodes[k], nodes[label[k]]) for k in np.flatnonzero(label != np.arange(len(nodes)))]


def _check(shingle: int, percent: int):
    from zstandard import ZstdDecompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = ZstdDecompressor().decompress
        key, nodes, texts = None, [], []

        def links():
            found = bucket_links(nodes, list(map(unpack, texts)), shingle, percent)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()),
                                               pa.array([v for _, v in found], pa.int64())], ["u", "v"])
        for b in (p for x in batches for p in slices(x, "words")):
            for k, node, text in zip(b.column("bucket").to_pylist(), b.column("node").to_pylist(),
                                     b.column("words").to_pylist()):
                if k != key:                                      # rows come sorted by bucket
                    if len(nodes) > 1:
                        yield links()
                    key, nodes, texts = k, [], []
                nodes.append(node)
                texts.append(text)
        if len(nodes) > 1:
            yield links()
    return run


# ---------------------------------------------------------------- rounds

def _blocks(nodes: Column, weight: Column) -> Column:
    """Blocks of at most about NODES nodes and SHINGLES shingles."""
    return F.greatest(F.ceil(nodes / F.lit(NODES)), F.ceil(weight / F.lit(SHINGLES))).cast("long")


def _open_buckets(routed: DataFrame) -> DataFrame:
    """``key, blocks`` of the buckets ``routed(key, node, weight, label)`` whose nodes do not all hang together yet."""
    return (routed.groupBy("key").agg(_blocks(F.count(F.lit(1)), F.sum("weight")).alias("blocks"),
                                      F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo < hi").select("key", "blocks"))


def _checked(meet: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among the nodes of each bucket of ``meet(bucket, node)``."""
    return (meet.join(texts, "node").select("bucket", "node", "words")
            .repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_check(shingle, percent), "u long, v long"))


def _dealt(routed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of one round: open buckets, large ones dealt out at random into pairs of blocks."""
    part = F.pmod(F.xxhash64(F.lit(7), "node"), F.greatest(F.lit(1), F.ceil(F.col("blocks") / 2)))
    meet = routed.join(_open_buckets(routed), "key").select(F.xxhash64("key", part).alias("bucket"), "node")
    return _checked(meet, texts, shingle, percent)


def _settled(routed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links inside buckets of any size: nodes outside the largest component against all, in blocks.

    Nodes of the largest component need no comparison among each other. The others are cut into ``s`` blocks, the largest
    component into ``m`` blocks; a block of others meets every block once."""
    sizes = routed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    keys = (sizes.groupBy("key").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"),
                                     F.count(F.lit(1)).alias("labels"))
            .where("labels > 1").select("key", F.col("top.label").alias("main"), _blocks(F.col("top.n"), F.col("top.w")).alias("m"),
                                        _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("s")))
    own = lambda blocks: F.pmod(F.xxhash64(F.lit(11), "node"), blocks)
    # block numbers: others 0 .. s-1, largest component s .. s+m-1; a meeting is (block of others, any block)
    number = F.when(F.col("odd"), own(F.col("s"))).otherwise(F.col("s") + own(F.col("m")))
    others = F.sequence(F.lit(0).cast("long"), F.col("s") - 1)
    every = F.sequence(F.lit(0).cast("long"), F.col("s") + F.col("m") - 1)
    meetings = F.when(F.col("odd"), F.transform(every, lambda x: F.struct(
        F.least(x, F.col("number")).alias("a"), F.greatest(x, F.col("number")).alias("b")))).otherwise(
        F.transform(others, lambda x: F.struct(x.alias("a"), F.col("number").alias("b"))))
    meet = (routed.join(keys, "key").withColumn("odd", F.col("label") != F.col("main")).withColumn("number", number)
            .select("key", "node", F.explode(meetings).alias("met"))
            .select(F.xxhash64("key", "met.a", "met.b").alias("bucket"), "node"))
    return _checked(meet, texts, shingle, percent)


def _hashed(words: bytes, shingle: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    found = shingles(words, shingle)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def prefixes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``node, gram`` (hashed) of the prefix of every set of ``texts(node, words)``.

    Any one order of all shingles is right; that by a sketch of their frequencies (``COUNTERS`` sums) keeps prefixes rare."""
    from zstandard import ZstdDecompressor

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counts = ZstdDecompressor().decompress, np.zeros(COUNTERS, np.int64)
        for part in (p for b in batches for p in slices(b, "words")):
            for words in part.column("words").to_pylist():
                np.add.at(counts, (_hashed(unpack(words), shingle) % np.uint64(COUNTERS)).astype(np.int64), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["slot", "n"])

    order = np.zeros(COUNTERS, np.int64)
    for slot, n in texts.select("words").mapInArrow(sketch, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        order[slot] = n                                           # at most COUNTERS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = ZstdDecompressor().decompress
        for part in (p for b in batches for p in slices(b, "words")):
            nodes, grams = [], []
            for node, words in zip(part.column("node").to_pylist(), part.column("words").to_pylist()):
                hashes = _hashed(unpack(words), shingle)
                first = np.lexsort((hashes, order[(hashes % np.uint64(COUNTERS)).astype(np.int64)]))
                keep = len(hashes) + percent * len(hashes) // -100 + 1        # size - ceil(...) + 1
                nodes.append(np.full(min(keep, len(hashes)), node, np.int64))
                grams.append(hashes[first[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(grams))], ["node", "gram"])
    return texts.select("node", "words").mapInArrow(run, "node long, gram long")


def labelled(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, label`` (smallest node of the component) for every node. Equal labels always mean one component; with few
    ``rounds`` a component may still have several, which only leaves more buckets open."""
    roots = components(links, rounds)
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``; see the module text."""
    rows = stable(signatures(docs, shingle, id_col, text_col).withColumn("node", F.monotonically_increasing_id()))
    filled, blank = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    # one node per set: the first of its rows
    sets = stable(filled.groupBy("set_a", "set_b").agg(F.min("node").alias("node"), F.min("id").alias("smallest")))
    nodes = sets.select("node")
    bands = stable(filled.join(nodes, "node", "left_semi")
                   .select("node", F.col("n_shingles").alias("weight"), F.posexplode("bands").alias("band", "value"))
                   .select(F.xxhash64("band", "value").alias("key"), "band", "node", "weight"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = stable(bands.join(shared, "key"))                       # only nodes that meet another one anywhere go on
    needed = stable(met.select("node").distinct())                # written, so that Spark knows its size when it plans the join
    texts = stable(rows.select("node", "words").join(needed, "node", "left_semi"))

    def routed(where, label: DataFrame) -> DataFrame:
        return met.where(where).select("key", "node", "weight").join(label, "node")

    alone = nodes.withColumn("label", F.col("node"))
    links = stable(_dealt(routed(F.col("band") < FIRST, alone), texts, shingle, percent))
    label = stable(labelled(nodes, links, rounds=1))
    links = links.unionByName(stable(_dealt(routed(F.col("band") >= FIRST, label), texts, shingle, percent)))
    hot = met.groupBy("key").agg(_blocks(F.count(F.lit(1)), F.sum("weight")).alias("blocks"), F.max("size").alias("all")).where("blocks > 2")
    if hot.limit(1).count():
        label = stable(labelled(nodes, links))
        left = routed(F.lit(True), label).join(hot.select("key", "all"), "key")
        left = stable(left.join(_open_buckets(left).select("key"), "key", "left_semi"))
        large = left.where(F.col("all") > AGAIN).select("key", "node", "weight", "label")
        again = large.limit(0)
        if large.limit(1).count():
            held = stable(texts.join(large.select("node").distinct(), "node", "left_semi"))
            again = large.join(prefixes(held, shingle, percent), "node").select(
                F.xxhash64("key", "gram").alias("key"), "node", "weight", "label")
        direct = left.where(F.col("all") <= AGAIN).select("key", "node", "weight", "label")
        links = links.unionByName(stable(_settled(stable(direct.unionByName(again)), texts, shingle, percent)))
    named = sets.join(labelled(nodes, links), "node")
    ids = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = named.join(ids, "label").select("set_a", "set_b", "component_id")
    # The row side may hold a third of all rows under one set; the other side has one row per set, so the
    # skewed partition can be split (adaptive skew join).
    out = filled.join(named, ["set_a", "set_b"]).select("id", "n_shingles", "component_id").unionByName(
        blank.select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM docs)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
links AS (
  SELECT a.r AS u, b.r AS v FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(r, c) AS (SELECT r, r FROM docs UNION SELECT reach.r, e.v FROM reach JOIN edges e ON e.u = reach.c),
named AS (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN docs o ON o.r = reach.c GROUP BY reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs d JOIN named USING (r) LEFT JOIN sizes s USING (r)
"""


@query("op13_minhash", OP13_SQL)
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
