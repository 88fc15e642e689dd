"""k-means for many models at once (CLU3–CLU5).

Every pass over the rows carries the centroids of all (K, seed) models: a task computes one product of its rows
with the stacked centroids, and emits one row of partial sums per model and cluster.  A Lloyd iteration of a sweep is
therefore one job, not one per model, and its shuffle is tasks × clusters rows whatever the size of the table.

* Rows are written once in an order in which near rows follow each other (``in_order``), many to a record (``packed``).
  Lloyd's sums are taken over boxes of such rows wherever only one centroid can be the nearest of its model to all of
  a box; only the rows of the others are compared.  The order decides the time and nothing else.
* Seeding (k-means|| with reservoirs): per seed, ``ROUNDS`` passes draw ``2 · max K`` rows each, without
  replacement and with odds in proportion to the squared distance from the rows drawn before (the smallest
  ``-log(u) / d²`` of every task, then of all; u is a hash of row number, seed and round, so a task that runs again draws the
  same rows).  One more pass counts the rows nearest to each; weighted k-means++ on these few rows starts every K.
* Lloyd: models whose centroids have moved by less than the tolerance leave the next pass; the best model of each K
  goes on to a tighter one.
* Evaluation: one pass gives the inertia and sizes of all models, another those and the simplified silhouette of the best: with a the
  distance to the own and b that to the nearest other centroid, the mean of ``(b - a) / max(a, b)``.  It is Euclidean, the scale
  of the usual cut points, and linear in rows, where the full silhouette needs all pairs of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import scratch

ROUNDS = 3
#: Total squared movement of a model's centroids at which it stops, in the sweep and for the model kept.
TOLERANCE, FINAL_TOLERANCE = 1e-4, 1e-6
#: Rows that are compared with the centroids as one box, at first and then; values of a packed record, and its columns.
UNIT, BLOCK = 32_768, 64
RECORD, PACKED = 192, ["rows", "points"]
#: Records of a file: many small files are dealt to tasks more evenly than a few long ones.
FILE = 4_096
#: More than rounding can add to a squared distance, relative to the squares it is made of.
ROUNDING = 1e-12


@dataclass
class Model:
    k: int
    seed: int
    centers: np.ndarray
    inertia: float = np.inf
    silhouette: float | None = None
    sizes: np.ndarray | None = None


def packed(z: DataFrame, cols: list[str]) -> DataFrame:
    """The row numbers and ``cols`` of ``z``, some rows to a record: passes read them as they are, without a step per value."""
    many = max(1, RECORD // len(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = _numbers(b).astype(np.int64), np.ascontiguousarray(_matrix(b, cols), float)
            yield pa.RecordBatch.from_arrays([pa.array([x[at:at + many].tobytes() for at in range(0, len(x), many)], pa.binary())
                                              for x in both], PACKED)

    path = scratch(z.sparkSession, "points")
    records = z.select("row", *cols).mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED))
    records.write.option("maxRecordsPerFile", FILE).parquet(path, compression="none")
    return z.sparkSession.read.parquet(path)


def in_order(cols: list[str]) -> Column:
    """A number that is close for rows close to each other: the leading bits of the columns, interleaved.  It decides how
    much a pass can skip, not what it finds."""
    cols = cols[:60]
    bits = min(16, 60 // len(cols))
    cell = [F.least(F.floor((F.col(c) / (F.abs(F.col(c)) + 1) + 1) * 2.0 ** (bits - 1)), F.lit(2 ** bits - 1)).cast("long") for c in cols]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(c, t).bitwiseAND(F.lit(1).cast("long")), t * len(cols) + j)
                                                for t in range(bits) for j, c in enumerate(cell)])


def _chosen(z: DataFrame, cols: list[str], row: bool = False) -> DataFrame:
    """What a pass reads of ``z``: its columns, or the records of a ``packed`` one."""
    if z.dtypes == [(c, "binary") for c in PACKED]:
        return z if row else z.select(PACKED[1])
    return z.select(*["row"] * row, *cols)


def _is_packed(batch: pa.RecordBatch) -> bool:
    return batch.schema.names[-1] == PACKED[1] and not pa.types.is_floating(batch.schema.types[-1])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    if not len(column):
        return np.empty(0, kind)
    _, ends, data = column.buffers()                              # the records lie end to end
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:][:len(column) + 1]
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // 8, ends[0])


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    if _is_packed(batch):
        return _unpacked(batch.column(PACKED[1]), float).reshape(-1, len(cols))
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    if _is_packed(batch):
        return _unpacked(batch.column(PACKED[0]), np.int64)
    return batch.column("row").to_numpy(zero_copy_only=False)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` from the rows of ``c``."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0.0)


def _uniform(row: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) from row number, seed and round (64-bit mixing)."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + turn * 7_919 + 1) % (1 << 63))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54


def _possible(boxes: tuple[np.ndarray, np.ndarray], stack: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boxes (least and greatest values) and centroids, ordered by model: whether the centroid can be nearest of its
    model to a point of the box (a row per centroid), and how many can (a row per model).

    The squared distances of two centroids differ by a linear function of the point, so its least value over a box is known
    from the middle and the widths: with c nearest to the middle, another one is out if it is farther there by more than
    c gains anywhere in the box.  What rounding may decide is left possible."""
    mid, half = (boxes[0] + boxes[1]) / 2, (boxes[1] - boxes[0]) / 2
    starts = np.flatnonzero(np.r_[True, model[1:] != model[:-1]])
    at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(model)]))
    size = (stack * stack).sum(1)
    d = size[:, None] - 2 * stack @ mid.T
    least = np.minimum.reduceat(d, starts, axis=0)[at]
    own = np.maximum.reduceat(np.where(d == least, np.arange(len(stack))[:, None], -1), starts, axis=0)
    gain = np.zeros_like(d)
    for c, h in zip(stack.T, half.T):
        gain += np.abs(c[own][at] - c[:, None]) * h
    slack = ROUNDING * (1 + size.max() + (np.abs(boxes[0]) + np.abs(boxes[1])).max(1) ** 2 * stack.shape[1])
    can = ~(d - least > 2 * gain + slack)                         # not a number: possible
    return can, np.add.reduceat(can.astype(int), starts, axis=0)


def _nearest_rows(x: np.ndarray, stack: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points (a column each): squared distances less |x|² (a row per centroid), the least of every model, and which
    centroid has it, the first one on ties."""
    d = (stack * stack).sum(1)[:, None] - 2 * stack @ x
    if len(starts) == 1:
        least = d.min(0)[None]
        hot = d == least
    else:
        least = np.minimum.reduceat(d, starts, axis=0)
        hot = d == np.repeat(least, np.diff(np.r_[starts, len(stack)]), axis=0)
    if np.count_nonzero(hot) > len(starts) * x.shape[1]:
        tied = np.flatnonzero(np.count_nonzero(hot, axis=0) > len(starts))
        some = hot[:, tied]
        for a, b in zip(starts, np.r_[starts[1:], len(stack)]):
            some[a:b] &= np.cumsum(some[a:b], axis=0) == 1
        hot[:, tied] = some
    return d, least, hot


def _add_sums(sums: np.ndarray, x: np.ndarray, stack: np.ndarray, model: np.ndarray) -> None:
    """Adds rows, sums of the columns and of |x|² of the rows ``x`` to their nearest centroids (a row of ``sums`` each).

    A box of rows that has one possible centroid of a model is added as a whole: first all rows, then ``BLOCK`` at a
    time.  Only rows of blocks with several are compared, with these."""
    y = np.ascontiguousarray(x.T)
    m = np.vstack([np.ones((1, len(x))), y, (y * y).sum(0)])
    first = lambda of: np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    whole, many = len(x) // BLOCK * BLOCK, len(m)
    rest = m[:, whole:]
    if len(x) > whole:                                            # fewer rows than a block
        sums[:, :many] += _nearest_rows(rest[1:-1], stack, first(model))[2].astype(float) @ rest.T
    if not whole:
        return
    blocks = m[:, :whole].reshape(many, -1, BLOCK)
    lo, hi, total = blocks[1:-1].min(2).T, blocks[1:-1].max(2).T, blocks.sum(2).T
    can, possible = _possible((lo.min(0)[None], hi.max(0)[None]), stack, model)
    several = np.repeat(possible[:, 0] != 1, np.bincount(model - model[0]))
    sums[can[:, 0] & ~several, :many] += total.sum(0)
    left = np.flatnonzero(can[:, 0] & several)
    if not len(left):
        return
    can, possible = _possible((lo, hi), stack[left], model[left])
    starts = first(model[left])
    ends = np.r_[starts[1:], len(left)]
    sums[left, :many] += (can & np.repeat(possible == 1, ends - starts, axis=0)).astype(float) @ total
    for a, b, n in zip(starts, ends, possible):
        unsure = np.flatnonzero(n != 1)
        if len(unsure):
            some = left[a + np.flatnonzero(can[a:b, unsure].any(1))]
            rows = blocks[:, unsure].reshape(many, -1)
            sums[some, :many] += _nearest_rows(rows[1:-1], stack[some], np.zeros(1, int))[2].astype(float) @ rows.T


def _partial_sums(z: DataFrame, cols: list[str], centers: list[np.ndarray], silhouette: bool) -> dict[int, np.ndarray]:
    """For every model's every cluster (numbered through): rows, sums of the columns, of squared distances and, with
    ``silhouette``, of silhouettes (else 0)."""
    stack = np.vstack(centers)
    ends = np.cumsum([len(c) for c in centers])
    starts = ends - [len(c) for c in centers]
    width = len(cols) + 3
    fields = [f"s{i}" for i in range(width)]
    model = np.repeat(np.arange(len(centers)), ends - starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(stack), width))
        step = 1024 if silhouette else UNIT
        for x in (m[at:at + step] for b in batches for m in [_matrix(b, cols)] for at in range(0, len(m), step)):
            if not silhouette:
                _add_sums(sums, x, stack, model)
                continue
            d, least, hot = _nearest_rows(x.T, stack, starts)
            second = np.minimum.reduceat(np.where(hot, np.inf, d), starts, axis=0)
            hot, norm = hot.astype(float), (x * x).sum(1)
            least, wide = np.maximum(least + norm, 0.0), np.isfinite(second)
            near, other = np.sqrt(least), np.sqrt(np.maximum(second + norm, 0.0))
            with np.errstate(invalid="ignore"):                   # a model of one cluster has no other centroid
                score = np.where(wide, (other - near) / np.maximum(np.maximum(near, other), 1e-300), 0.0)
            sums[:, 0] += hot.sum(1)
            sums[:, 1:-2] += hot @ x
            sums[:, -2] += (hot * least[model]).sum(1)
            sums[:, -1] += (hot * score[model]).sum(1)
        if not silhouette:                                        # Σ|x - c|² from the sums of 1, x and |x|²
            inertia = sums[:, -2] - 2 * (stack * sums[:, 1:-2]).sum(1) + (stack * stack).sum(1) * sums[:, 0]
            sums[:, -2] = np.maximum(inertia, 0.0)
        seen = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *[pa.array(c) for c in sums[seen].T]], ["cluster", *fields])

    rows = _chosen(z, cols).mapInArrow(run, "cluster long, " + ", ".join(f"{c} double" for c in fields)).groupBy("cluster").agg(
        *[F.sum(c).alias(c) for c in fields]).collect()           # one row per cluster of a model
    return {r[0]: np.array(r[1:]) for r in rows}


def _draw(z: DataFrame, cols: list[str], known: dict[int, np.ndarray], many: int, turn: int) -> dict[int, np.ndarray]:
    """``many`` further rows per seed, with odds in proportion to the squared distance from ``known`` (none known: equal).

    No row of a unit is farther from ``known`` than the far corner of the unit's box: rows whose key would be too great even
    there are not compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {s: (np.empty(0), np.empty((0, len(cols)))) for s in known}
        units = ((m[at:at + UNIT], n[at:at + UNIT]) for b in batches for m, n in [(_matrix(b, cols), _numbers(b))] for at in range(0, len(m), UNIT))
        for x, row in units:
            lo, hi = x.min(0), x.max(0)
            for s, (keys, points) in best.items():
                key, at = -np.log(_uniform(row, s, turn)), np.arange(len(x))
                if len(keys) == many:
                    far = (np.maximum(np.abs(lo - known[s]), np.abs(hi - known[s])) ** 2).sum(1).min() if len(known[s]) else 1.0
                    far += ROUNDING * (1 + far + (lo * lo + hi * hi).sum())
                    at = np.flatnonzero(~(key > keys[-1] * far))
                    if not len(at):
                        continue
                y = x[at]
                weight = _squared(y, known[s]).min(1) if len(known[s]) else np.ones(len(y))
                with np.errstate(divide="ignore"):
                    key = key[at] / weight
                key, y = np.r_[keys, key], np.vstack([points, y])
                keep = np.argsort(key, kind="stable")[:many]
                keep = keep[np.isfinite(key[keep])]
                best[s] = key[keep], y[keep]
        for s, (keys, points) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), s), pa.int64()), pa.array(keys),
                                              pa.array(list(points), pa.list_(pa.float64()))], ["seed", "key", "point"])

    first = Window.partitionBy("seed").orderBy("key", "point")    # Spark limits the rows of a task before they meet
    rows = (_chosen(z, cols, True).mapInArrow(run, "seed long, key double, point array<double>")
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= many).orderBy("seed", "key", "point").collect())
    return {s: np.vstack([c, *[np.array(r.point)[None, :] for r in rows if r.seed == s]]) for s, c in known.items()}


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and Lloyd on the few drawn rows."""
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    while len(chosen) < min(k, len(points)):
        odds = weight * _squared(points, points[chosen]).min(1)
        if odds.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=odds / odds.sum())))
    centers = points[chosen]
    for _ in range(30):
        own = _squared(points, centers).argmin(1)
        mass = np.bincount(own, weight, len(centers))
        moved = np.column_stack([np.bincount(own, weight * c, len(centers)) for c in points.T]) / np.maximum(mass, 1e-300)[:, None]
        moved = np.where(mass[:, None] > 0, moved, centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def seeded(z: DataFrame, cols: list[str], ks: list[int], seeds: list[int]) -> list[Model]:
    """A first model for every K and seed."""
    known = {s: np.empty((0, len(cols))) for s in seeds}
    for turn in range(ROUNDS):
        known = _draw(z, cols, known, 2 * max(ks), turn)
    known = {s: np.unique(c, axis=0) for s, c in known.items()}
    counts = _partial_sums(z, cols, [known[s] for s in seeds], False)
    models, at = [], 0
    for s in seeds:
        weight = np.array([counts[i][0] if i in counts else 0.0 for i in range(at, at + len(known[s]))])
        at += len(known[s])
        models += [Model(k, s, _plus_plus(known[s], weight, k, np.random.default_rng([s, k]))) for k in ks]
    return models


def lloyd(z: DataFrame, cols: list[str], models: list[Model], max_iter: int, tolerance: float) -> None:
    """Iterates all models together; each leaves once its centroids rest."""
    active = list(models)
    for _ in range(max_iter):
        if not active:
            return
        sums, at, still = _partial_sums(z, cols, [m.centers for m in active], False), 0, []
        for m in active:
            now = m.centers.copy()
            for i in range(len(now)):
                if at + i in sums:                                 # an empty cluster keeps its centroid
                    s = sums[at + i]
                    now[i] = s[1:-2] / s[0]
            at += len(now)
            moved = ((now - m.centers) ** 2).sum()
            m.centers = now
            if moved > tolerance:
                still.append(m)
        active = still


def evaluate(z: DataFrame, cols: list[str], models: list[Model], silhouette: bool = True) -> None:
    """Inertia, cluster sizes and (unless told not to) silhouette of every model, in one pass."""
    sums, at = _partial_sums(z, cols, [m.centers for m in models], silhouette), 0
    for m in models:
        mine = np.array([sums.get(at + i, np.zeros(len(cols) + 3)) for i in range(len(m.centers))])
        at += len(m.centers)
        m.sizes, m.inertia = mine[:, 0].astype(int), float(mine[:, -2].sum())
        m.silhouette = float(mine[:, -1].sum() / mine[:, 0].sum()) if silhouette and len(m.centers) > 1 else None


def sweep(z: DataFrame, cols: list[str], ks: list[int], seeds: list[int], max_iter: int) -> dict[int, Model]:
    """The best of all restarts for every K (least inertia, first seed on ties).  ``z`` has a column ``row``, a
    number that does not change when a task runs again."""
    z = packed(z, cols)
    models = seeded(z, cols, ks, seeds)
    lloyd(z, cols, models, max_iter, TOLERANCE)
    evaluate(z, cols, models, silhouette=False)                   # the inertia decides; the kept ones are evaluated again
    best: dict[int, Model] = {}
    for m in models:
        if m.k not in best or m.inertia < best[m.k].inertia:
            best[m.k] = m
    lloyd(z, cols, list(best.values()), max_iter, FINAL_TOLERANCE)
    evaluate(z, cols, list(best.values()))
    for m in best.values():                                       # size descending, then first coordinate
        order = sorted(range(len(m.centers)), key=lambda i: (-m.sizes[i], *m.centers[i]))
        m.centers, m.sizes = m.centers[order], m.sizes[order]
    return best


def nearest(centers: np.ndarray, cols: list[str]) -> Column:
    """Number of the nearest centroid, as one expression over the columns."""
    distance = [sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, row)), F.lit(0.0))
                for row in centers]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("c")) for i, d in enumerate(distance)]))["c"]
