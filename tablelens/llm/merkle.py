"""Merkle manifest of a table, kept as a postorder append log.

H is the lower-case hex sha256 of its inputs, concatenated. A leaf is H over the row's fields, each ``-`` if
null, else ``<UTF-8 bytes>:<value>``. Per group, leaves ascend by (id, leaf); while several nodes remain, every
``ARITY`` consecutive ones (last run: fewer, even one) become their H. Group roots, null group first, then
bytewise, are folded in the same way to the root of the table.

1. Leaves. Digests are taken where the rows are read and written once; the texts travel no further.
2. Index. The leaves are range-partitioned by (group, id, leaf) and written with their position; totals by
   (partition, group) give a leaf's index in its group and the group's size. A group of any size is spread
   over partitions, and the join key (partition, group) holds no more rows than a partition.
3. Builders. A builder owns an aligned block of ``arity ** levels`` leaves. It appends the digests of its
   subtree to its log segment in completion order: a leaf when it arrives, a node as soon as its run is
   complete. Block tops are the leaves of the next round, so a round is smaller by the block size and three rounds hold
   10^10 leaves.
4. Addresses. In a postorder log a complete subtree of height h takes ``(ARITY^(h+1) - 1) / (ARITY - 1)``
   entries. So leaf i stands at ``i + i // ARITY + i // ARITY^2 + ...``, and node (h, j) stands h entries after its last leaf.
   ``Shape.position`` is that closed form; siblings are read from the log at their positions, no node is searched.
5. Proofs. From the last round down, a block's segment and the path above it give every leaf its sibling
   runs up to the root. A task holds one block (4,369 digests) and one path.

Defined results: null and empty texts are ordinary values (``-`` and ``0:``); equal ids (repeated rows) are
ordered by their leaves and each is a leaf of its own; a null id comes first, and counts for the tampering rule as the
empty string; the root of an empty table does not exist, so an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import col, query, stable, table

#: Children of a node.
ARITY = 16
#: Levels above the leaves that one builder completes.
HEIGHT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Shape:
    """Children of a node, and levels above the leaves that one builder completes."""
    arity: int = ARITY
    levels: int = HEIGHT

    @property
    def block(self) -> int:
        """Leaves of a builder."""
        return self.arity ** self.levels

    def height(self, n: int) -> int:
        """Levels above ``n`` leaves."""
        h = 0
        while n > 1:
            n, h = -(-n // self.arity), h + 1
        return h

    def inside(self, n: int) -> int:
        """Levels a builder completes in a group of ``n`` leaves: to the root in a group of one block."""
        return min(self.height(n), self.levels)

    def position(self, level: int, j: int, n: int) -> int:
        """Place of node (level, j) in the postorder log of ``n`` leaves."""
        last = min((j + 1) * self.arity ** level, n) - 1
        at, step = last + level, last
        while step := step // self.arity:
            at += step
        return at


# ---------------------------------------------------------------- leaves and their index

def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for null, else byte count, colon, value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(
        F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (column ``grp`` first in the order) with ``idx``, the position in its group, and ``n``, its size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stable(rows.repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
                    .withColumn("at", F.monotonically_increasing_id())
                    .withColumn("part", F.shiftright("at", 33)))
    runs = placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    by_group = Window.partitionBy("grp")                          # a group has one row per partition
    starts = runs.select(
        F.col("part").alias("part_"), F.col("grp").alias("grp_"), "first",
        (F.sum("rows").over(by_group.orderBy("part")) - F.col("rows")).alias("before"),
        F.sum("rows").over(by_group).alias("n"))
    return (placed.join(starts, (F.col("part") == F.col("part_")) & F.col("grp").eqNullSafe(F.col("grp_")))
            .withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
            .drop("part", "part_", "grp_", "at", "first", "before"))


# ---------------------------------------------------------------- the log

class Builder:
    """Appends digests in completion order."""

    def __init__(self, levels: int, arity: int = ARITY):
        self.arity, self.log, self.open = arity, [], [[] for _ in range(levels + 1)]

    def add(self, digest: str, level: int = 0) -> None:
        self.log.append(digest)
        self.open[level].append(digest)
        if level + 1 < len(self.open) and len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run = hashlib.sha256("".join(self.open[level]).encode()).hexdigest()
        self.open[level].clear()
        self.add(run, level + 1)

    def finish(self) -> list[str]:
        """Completes the last, shorter runs; the top is the last entry."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._close(level)
        return self.log


def build(leaves: DataFrame, shape: Shape) -> DataFrame:
    """``grp, block, n, nodes`` from ``leaves`` (grp, idx, n, digest): one log segment (hex digests in a row) per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, builder = None, None

        def segment():
            grp, blk, n = now
            return pa.RecordBatch.from_pylist([{"grp": grp, "block": blk, "n": n, "nodes": "".join(builder.finish())}],
                                              schema=pa.schema([("grp", pa.string()), ("block", pa.int64()),
                                                                ("n", pa.int64()), ("nodes", pa.string())]))
        for b in batches:                                         # rows come sorted by (grp, idx)
            for grp, blk, n, digest in zip(*(b.column(c).to_pylist() for c in ("grp", "block", "n", "digest"))):
                if now != (grp, blk, n):
                    if now:
                        yield segment()
                    now, builder = (grp, blk, n), Builder(shape.inside(n), shape.arity)
                builder.add(digest)
        if now:
            yield segment()
    rows = leaves.select("grp", F.expr(f"idx div {shape.block}").alias("block"), "idx", "n", "digest")
    return (rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
            .mapInArrow(run, "grp string, block long, n long, nodes string"))


def build_rounds(leaves: DataFrame, shape: Shape) -> list[DataFrame]:
    """The log segments of every round until each group has one node; the last digest of a segment is its top."""
    rounds = [stable(build(leaves, shape))]
    while rounds[-1].where("block > 0").limit(1).count():
        rounds.append(stable(build(_tops(rounds[-1], shape), shape)))
    return rounds


def _tops(segments: DataFrame, shape: Shape) -> DataFrame:
    """The leaves of the next round: grp, idx, n and digest of the tops of blocks."""
    return segments.where(F.col("n") > shape.block).select(
        "grp", F.col("block").alias("idx"), F.expr(f"(n + {shape.block - 1}) div {shape.block}").alias("n"),
        F.substring("nodes", -64, 64).alias("digest"))


def group_roots(rounds: list[DataFrame], shape: Shape) -> DataFrame:
    """``grp, digest``: the root of each group, from the round in which it had one block."""
    tops = [r.where(F.col("n") <= shape.block).select("grp", F.substring("nodes", -64, 64).alias("digest")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


# ---------------------------------------------------------------- proofs

def sibling_runs(idx: int, n: int, block: int, nodes: str, shape: Shape) -> list[tuple[int, str]]:
    """(own place, digests of the whole run) of leaf ``idx`` on each level of its block, read from the log.

    Positions are relative to the block, the aligned subtree of leaves ``0 .. size - 1``."""
    first = block * shape.block
    size = width = min(n - first, shape.block)
    out, j = [], idx - first
    for level in range(shape.inside(n)):
        run = j // shape.arity * shape.arity
        places = [shape.position(level, k, size) for k in range(run, min(run + shape.arity, width))]
        out.append((j - run, "".join(nodes[64 * p:64 * p + 64] for p in places)))
        j, width = j // shape.arity, -(-width // shape.arity)
    return out


def fold(digest: str, path: list[tuple[int, str]]) -> str:
    """The root recomputed from a leaf and the other members of its runs."""
    for at, run in path:
        digest = hashlib.sha256((run[:64 * at] + digest + run[64 * at + 64:]).encode()).hexdigest()
    return digest


def siblings(path: list[tuple[int, str]]) -> str:
    """All siblings of a path, level by level, left to right."""
    return "".join(run[:64 * at] + run[64 * at + 64:] for at, run in path)


def _walk(batches: Iterator[pa.RecordBatch], columns: list[str], shape: Shape):
    """(row, path up to the root) for the leaf rows that follow the header row of their block."""
    segment = None
    for b in batches:
        rows = b.select(["kind", "block", "idx", "n", "nodes", "places", "runs", *columns]).to_pylist()
        for r in rows:
            if r["kind"] == 0:
                segment, above = r, list(zip(r["places"] or [], r["runs"] or []))
            else:
                yield r, sibling_runs(r["idx"], segment["n"], r["block"], segment["nodes"], shape) + above


def descend(segments: DataFrame, paths: DataFrame, leaves: DataFrame, shape: Shape) -> DataFrame:
    """Header rows (a block's log segment and the path above it) and its leaf rows, sorted into one stream."""
    head = segments.alias("s").join(paths.alias("p"), F.col("s.grp").eqNullSafe(F.col("p.grp"))
                                    & (F.col("s.block") == F.col("p.idx")), "left").select(
        "s.grp", "s.block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("idx"), "s.n", "s.nodes", "p.places", "p.runs")
    body = leaves.withColumns({"kind": F.lit(1), "block": F.expr(f"idx div {shape.block}")})
    return (head.unionByName(body, allowMissingColumns=True)
            .repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "idx"))


_PATHS = "grp string, idx long, places array<int>, runs array<string>"


def paths_of(segments: DataFrame, paths: DataFrame, leaves: DataFrame, shape: Shape) -> DataFrame:
    """The path of every leaf (of an upper round, where a leaf is the top of a block below)."""
    schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("places", pa.list_(pa.int32())),
                        ("runs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r, path in _walk(batches, ["grp"], shape):
            out.append({"grp": r["grp"], "idx": r["idx"], "places": [a for a, _ in path], "runs": [s for _, s in path]})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return descend(segments, paths, leaves, shape).mapInArrow(run, _PATHS)


def manifest(df: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source",
             tampered: tuple[Column, dict[str, Column]] | None = None, shape: Shape = Shape()) -> DataFrame:
    """``id, grp, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``df``.

    ``tampered`` is a rule and, for the rows that meet it, what was found in place of some fields when the
    proofs were checked; the other rows were found as they are."""
    rule, changed = tampered or (F.lit(False), {})
    rows = df.select(col(id_col).cast("long").alias("id"), col(group_col).cast("string").alias("grp"), rule.alias("rule"),
                     *[col(c).alias(f"f{i}") for i, c in enumerate(fields)],
                     *[changed[c].alias(f"t{i}") for i, c in enumerate(fields) if c in changed])
    leaf = leaf_digest([F.col(f"f{i}") for i in range(len(fields))])
    check = F.when(F.col("rule"), leaf_digest([F.col(f"t{i}" if c in changed else f"f{i}") for i, c in enumerate(fields)]))
    # one scan of the texts; only digests go on
    leaves = indexed(stable(rows.select("id", "grp", leaf.alias("digest"), check.alias("found"))), ["id", "digest", "found"])
    leaves = stable(leaves)
    rounds = build_rounds(leaves, shape)
    subroots = stable(indexed(group_roots(rounds, shape).select(
        F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"]))
    top = build_rounds(subroots.select("grp", "idx", "n", "digest"), shape)
    root = top[-1].select(F.substring("nodes", -64, 64)).first()
    root = root and root[0]                                        # one digest, the last entry of the log

    # from the root down: a path for the top of every round
    empty = df.sparkSession.createDataFrame([], _PATHS)
    path = empty
    for k in range(len(top) - 1, -1, -1):
        path = stable(paths_of(top[k], path, _round_leaves(subroots, top, k, shape), shape))
    path = path.join(subroots.select("idx", "name"), "idx").select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "places", "runs")
    for k in range(len(rounds) - 1, 0, -1):
        inner = stable(paths_of(rounds[k], path, _round_leaves(leaves, rounds, k, shape), shape))
        # groups that had one block in an earlier round keep the path of their root
        path = inner.unionByName(path.join(rounds[k].select(F.col("grp").alias("g_")).distinct(),
                                           F.col("grp").eqNullSafe(F.col("g_")), "left_anti"))
    schema = pa.schema([("id", pa.int64()), ("grp", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()),
                        ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, sub = [], None, None
        for r, path in _walk(batches, ["id", "grp", "digest", "found"], shape):
            inside = shape.height(r["n"])                                # levels inside the group; the others are above it
            if known != (r["grp"], r["block"]):
                known, sub = (r["grp"], r["block"]), fold(r["digest"], path[:inside])
            out.append({"id": r["id"], "grp": r["grp"], "leaf": r["digest"], "subroot": sub, "root": root,
                        "proof_sha256": hashlib.sha256(siblings(path).encode()).hexdigest(),
                        "folded_root": fold(r["found"] or r["digest"], path)})
            if len(out) == 4000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return (descend(rounds[0], path, leaves, shape).mapInArrow(
        run, "id long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
        .withColumn("verified", F.col("folded_root") == F.col("root")))


def _round_leaves(leaves: DataFrame, rounds: list[DataFrame], k: int, shape: Shape) -> DataFrame:
    """grp, idx, n of the leaves of round ``k``: the rows themselves, or the blocks of the round before."""
    return (_tops(rounds[k - 1], shape) if k else leaves).select("grp", "idx", "n")


def _encoded(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source AS grp, sha256({' || '.join(map(_encoded, _FIELDS))}) AS leaf,
         sha256({' || '.join(map(_encoded, _FIELDS[:-1]))} || {_encoded(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered
  FROM documents),
poly(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN (c & 1) = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
placed AS (
  SELECT row_number() OVER () AS row, doc_id, grp, leaf,
         CASE WHEN xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
              list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda p: ('0x' || p)::BIGINT)),
              lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 5 = 0 THEN lowered ELSE leaf END AS found,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves, crc_table),
nodes(grp, level, idx, n, digest) AS (
  SELECT grp, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT grp, level + 1, idx // {ARITY}, (any_value(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY grp, level, idx // {ARITY}),
roots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper(level, idx, n, digest) AS (
  SELECT 0, idx, n, subroot FROM roots
  UNION ALL
  SELECT level + 1, idx // {ARITY}, (any_value(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // {ARITY}),
runs AS (SELECT grp, level, idx // {ARITY} AS run, string_agg(digest, '' ORDER BY idx) AS members FROM nodes
         WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, idx // {ARITY} AS run, string_agg(digest, '' ORDER BY idx) AS members FROM upper
               WHERE n > 1 GROUP BY ALL),
inner_fold(row, grp, level, idx, n, digest, proof) AS (
  SELECT row, grp, 0, idx, n, found, '' FROM placed
  UNION ALL
  SELECT f.row, f.grp, f.level + 1, f.idx // {ARITY}, (f.n + {ARITY - 1}) // {ARITY},
         sha256(left(members, 64 * (f.idx % {ARITY})) || f.digest || substr(members, 64 * (f.idx % {ARITY}) + 65)),
         f.proof || left(members, 64 * (f.idx % {ARITY})) || substr(members, 64 * (f.idx % {ARITY}) + 65)
  FROM inner_fold f JOIN runs r ON r.grp IS NOT DISTINCT FROM f.grp AND r.level = f.level AND r.run = f.idx // {ARITY}
  WHERE f.n > 1),
outer_fold(row, level, idx, n, digest, proof) AS (
  SELECT f.row, 0, r.idx, r.n, f.digest, f.proof FROM inner_fold f JOIN roots r ON r.grp IS NOT DISTINCT FROM f.grp WHERE f.n = 1
  UNION ALL
  SELECT f.row, f.level + 1, f.idx // {ARITY}, (f.n + {ARITY - 1}) // {ARITY},
         sha256(left(members, 64 * (f.idx % {ARITY})) || f.digest || substr(members, 64 * (f.idx % {ARITY}) + 65)),
         f.proof || left(members, 64 * (f.idx % {ARITY})) || substr(members, 64 * (f.idx % {ARITY}) + 65)
  FROM outer_fold f JOIN upper_runs r ON r.level = f.level AND r.run = f.idx // {ARITY} WHERE f.n > 1)
SELECT p.doc_id, p.leaf, r.subroot, u.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root,
       o.digest = u.digest AS verified
FROM placed p JOIN outer_fold o ON o.row = p.row AND o.n = 1 JOIN roots r ON r.grp IS NOT DISTINCT FROM p.grp
JOIN upper u ON u.n = 1
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), _FIELDS, "doc_id", "source",
                    tampered=(rule, {"text": F.translate("text", UPPER, LOWER)})).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
