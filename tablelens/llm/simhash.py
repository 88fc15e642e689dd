"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, all ``shingle``-word shingles
(repeats included, joined by a blank; fewer words: the whole sequence), each hashed with XXH64
(seed 42); a bit is 1 if it is set in over half the hashes. No words: fingerprint zero.

Links (distance <= ``max_bits``), over *distinct* fingerprints, exact copies being one node:

1. Routing. Two fingerprints within d bits agree on at least one of d + 1 disjoint blocks, so
   a fingerprint goes to the d + 1 partitions of its (block, value). A (block, value) with
   over ``GROUP_LIMIT`` fingerprints is dealt out again, the same way, on blocks of its other
   bits; the table of group sizes has at most (d + 1) * 2^(block bits) rows.
2. Index. A task sorts each group by Gray rank, so that neighbours share long bit patterns,
   and builds levels of ``FANOUT`` children. A node keeps the mask and the pattern of the
   bits that all fingerprints below share; a bit pattern that an upper node holds is not
   looked at again below it.
3. Search. Pairs of nodes are descended level by level; each pair carries the differences
   accumulated in the masks above, adds those of the newly shared bits, and the whole pair of
   groups is pruned beyond ``max_bits``. Nodes whose fingerprints already hang together are
   not compared again, so a clump of mutual near copies costs no all-pairs list: a task emits
   one edge from each fingerprint to the smallest one of its local component.
4. Components of those edges by alternating large-star and small-star steps (distributed,
   each step written to the shared folder).

Defined results: null and empty texts have fingerprint zero and are linked like any other;
the component id is the smallest non-null doc_id reachable (null only if no member has one);
equal ids and repeated rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import col, hex64, query, scan, slices, stable, table

#: A routing group of more fingerprints is split on further blocks (bounds a task, drops nothing).
GROUP_LIMIT = 1_000
FANOUT = 8
#: Node pairs expanded at once (bounds a task's memory).
FRONTIER = 200_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(np.int64)   # byte -> bits, low first


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()     # bytes: only A-Z and ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint as a signed long (Spark's and Parquet's 64-bit type)."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    octets = h.view(np.uint8).reshape(-1, 8)            # little-endian: octet j holds bits 8j..8j+7
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text")):
            fps = [fingerprint(t, shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    return scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- Gray-order hierarchical index

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in Gray order (the inverse Gray code)."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after linking ``i[k]`` with ``j[k]``."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


class GrayIndex:
    """Groups of fingerprints in Gray order, and levels of nodes with their shared bits.

    ``group`` is not decreasing; inside a group ``x`` is sorted by Gray rank. Level 0 are the
    fingerprints; every node of a level belongs to one group.
    """

    def __init__(self, x: np.ndarray, group: np.ndarray):
        self.x = x
        self.levels = [(x, np.full(len(x), ~np.uint64(0)))]       # (pattern, mask of shared bits)
        self.first = []                                           # per upper level: first child of a node
        self.starts = [np.arange(len(x))]                         # per level: first fingerprint of a node
        ones, zeros = x, ~x
        while len(group) and len(group) > len(np.unique(group)):
            # position inside the group, cut every FANOUT
            begin = np.r_[True, group[1:] != group[:-1]]
            at = np.arange(len(group)) - np.maximum.accumulate(np.where(begin, np.arange(len(group)), 0))
            first = np.flatnonzero(begin | (at % FANOUT == 0))
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones, ones | zeros))
            self.first.append(np.r_[first, len(group)])
            self.starts.append(self.starts[-1][first])
            group = group[first]

    def components(self, max_bits: int) -> np.ndarray:
        """For each fingerprint the smallest position linked with it, directly or through others."""
        n = len(self.x)
        label = np.arange(n)
        if n < 2 or len(self.levels) == 1:
            return label
        top = len(self.levels) - 1
        group = np.repeat(np.arange(len(self.levels[top][0])), np.diff(np.r_[self.starts[top], n]))
        for k in range(1, FANOUT + 1):                            # neighbours in Gray order come first
            near = np.flatnonzero((group[k:] == group[:-k]) & (np.bitwise_count(self.x[k:] ^ self.x[:-k]) <= max_bits))
            label = merge(label, near, near + k)
        self._whole(label)
        roots = np.arange(len(self.levels[top][0]))
        many = np.diff(np.r_[self.starts[top], n]) > 1
        stack = [(top, roots[many], roots[many], np.zeros(many.sum(), np.uint64), np.zeros(many.sum(), np.int64))]
        while stack:
            level, a, b, seen, acc = stack.pop()
            if len(a) > FRONTIER:
                for k in range(0, len(a), FRONTIER):
                    stack.append((level, a[k:k + FRONTIER], b[k:k + FRONTIER], seen[k:k + FRONTIER], acc[k:k + FRONTIER]))
                continue
            # groups that hang together already need no comparison
            open_ = ~((self.low[level][a] == self.high[level][a]) & (self.low[level][b] == self.high[level][b])
                      & (self.low[level][a] == self.low[level][b]))
            a, b, seen, acc = a[open_], b[open_], seen[open_], acc[open_]
            if level == 0:
                label = merge(label, a, b)
                continue
            # all pairs of children, each unordered pair once
            ca, cb, parent = self._children(level, a, b)
            pattern, mask = self.levels[level - 1]
            fresh = mask[ca] & mask[cb] & ~seen[parent]           # bits that both sides share from here on
            total = acc[parent] + np.bitwise_count((pattern[ca] ^ pattern[cb]) & fresh).astype(np.int64)
            keep = total <= max_bits
            if level == 1:
                keep &= ca != cb
            if keep.any():
                stack.append((level - 1, ca[keep], cb[keep], (seen[parent] | fresh)[keep], total[keep]))
            if level == 1 and len(stack) % 64 == 0:
                self._whole(label)
        return label

    def _whole(self, label: np.ndarray) -> None:
        """Smallest and largest label below every node."""
        self.low = [np.minimum.reduceat(label, s) for s in self.starts]
        self.high = [np.maximum.reduceat(label, s) for s in self.starts]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray):
        f = self.first[level - 1]
        na, nb = f[a + 1] - f[a], f[b + 1] - f[b]
        size = na * nb
        parent = np.repeat(np.arange(len(a)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ca, cb = f[a][parent] + at // nb[parent], f[b][parent] + at % nb[parent]
        once = (a[parent] != b[parent]) | (ca <= cb)
        return ca[once], cb[once], parent[once]


#: Fingerprints indexed at once in a task; a group is never cut.
CHUNK = 500_000


def _index_groups(max_bits: int):
    def links(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        x = fp.view(np.uint64)
        order = np.lexsort((gray_rank(x), key))
        x, key = x[order], key[order]
        label = GrayIndex(x, key).components(max_bits)
        linked = np.flatnonzero(label != np.arange(len(x)))
        return pa.RecordBatch.from_arrays(
            [pa.array(x[linked].view(np.int64)), pa.array(x[label[linked]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys, held = [], [], 0
        for batch in batches:                                     # rows come sorted by key
            fps.append(batch.column("fp").to_numpy())
            keys.append(batch.column("key").to_numpy())
            held += batch.num_rows
            if held >= CHUNK:
                fp, key = np.concatenate(fps), np.concatenate(keys)
                whole = int(np.searchsorted(key, key[-1]))        # the last group may go on
                if whole:
                    yield links(fp[:whole], key[:whole])
                fps, keys, held = [fp[whole:]], [key[whole:]], len(fp) - whole
        if held:
            yield links(np.concatenate(fps), np.concatenate(keys))
    return run


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(bits, parts)]


def _value(fp: Column, bits: list[int]) -> Column:
    """The bits of a contiguous-or-not block as one number."""
    out = F.lit(0).cast("long")
    runs = np.split(bits, np.flatnonzero(np.diff(bits) != 1) + 1)
    at = 0
    for r in runs:
        piece = F.shiftrightunsigned(fp, int(r[0])).bitwiseAND(F.lit((1 << len(r)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, at))
        at += len(r)
    return out


def local_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges ``(u, v)`` over distinct fingerprints ``nodes.fp``: linked ones hang together through them."""
    blocks = _cuts(list(range(64)), max_bits + 1)
    routed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _value(F.col("fp"), b).alias("value")) for k, b in enumerate(blocks)]))
        .alias("r")).select("fp", "r.block", "r.value")
    # at most (max_bits + 1) * 2^13 groups, of which only the hot ones remain
    hot = stable(routed.groupBy("block", "value").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP_LIMIT))
    if hot.isEmpty():
        dealt = routed.select("fp", "block", "value", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subvalue"))
    else:
        marked = routed.join(F.broadcast(hot), ["block", "value"], "left")      # bounded as above
        sub = F.lit(None)
        for k, own in enumerate(blocks):
            rest = _cuts([i for i in range(64) if i not in own], max_bits + 1)
            sub = F.when(F.col("block") == k, F.array(*[
                F.struct(F.lit(s + 1).alias("sub"), _value(F.col("fp"), r).alias("subvalue"))
                for s, r in enumerate(rest)])).otherwise(sub)
        none = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
        dealt = marked.select("fp", "block", "value", F.explode(
            F.when(F.col("size").isNotNull(), sub).otherwise(none)).alias("s")).select("fp", "block", "value", "s.*")
    key = F.xxhash64("block", "value", "sub", "subvalue").alias("key")
    # A key collision only puts two groups into one index, which finds the same links.
    return (dealt.select(key, "fp").repartition("key").sortWithinPartitions("key")
            .mapInArrow(_index_groups(max_bits), "u long, v long"))


# ---------------------------------------------------------------- components

def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over distinct edges ``u > v``."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (both.join(low, "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(low, "u")
             .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
             .select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct())
    return stable(small)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, root)``: the smallest node reachable over undirected ``edges(u, v)``, for nodes with an edge. After so many
    ``rounds``, if given, a smaller node that is reachable, though maybe not the smallest."""
    e = stable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    if rounds is not None:
        for _ in range(rounds):
            e = _stars(e)
        return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    now = state(e)
    while now[0]:
        e = _stars(e)
        before, now = now, state(e)
        if tuple(before) == tuple(now):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id, root`` (the component's smallest fingerprint) for every row; see the module text."""
    rows = stable(fingerprints(docs, shingle, id_col, text_col))
    nodes = stable(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    roots = components(local_links(nodes, max_bits))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root"))
    classes = joined.groupBy("root").agg(F.min("smallest").alias("component_id"))
    # The row side of this join may hold a third of all rows under one fingerprint; the other side has one
    # row per fingerprint, so the skewed partition can be split (adaptive skew join).
    return rows.join(joined.join(classes, "root").select("fp", "component_id", "root"), "fp").select(
        "doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id. Rows that share an id
    (repeated rows, null ids) are told apart by their fingerprints: of those in one group, one stays."""
    found = stable(near_duplicates(docs, shingle, max_bits, id_col, text_col))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keep = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(first).alias("first")).where("first").select(
        F.col("doc_id").alias("keep"), "rows")
    row = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).cast("long").alias("id"),
                      col(text_col).cast("string").alias("text"))
    kept = row.join(keep, F.col("id").eqNullSafe(F.col("keep")))
    single = kept.where("rows = 1").select("row")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, shingle)).astype("int64")

    roots = found.where(first).select(F.col("doc_id").alias("at"), F.col("fp").alias("own"), "root").distinct()
    several = (kept.where("rows > 1").withColumn("fp", print_of("text"))
               .join(roots, F.col("id").eqNullSafe(F.col("at")) & (F.col("fp") == F.col("own")))
               .dropDuplicates(["root"]).select("row"))
    return single.unionByName(several).select("row.*")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
