"""Toxicity by class-conditional Kneser-Ney language models.

Events are characters given the four before them, over the lower-cased text with white space
runs as one blank; a text starts after four marks. Each class c (toxic, ordinary) has

    p_c(x | ctx) = max(n_c(ctx x) - D_c, 0) / n_c(ctx) + D_c T_c(ctx) / n_c(ctx) * p(x | shorter ctx)

with n_c its counts, T_c(ctx) its distinct continuations and D_c = n1 / (n1 + 2 n2) from its own
counts of counts. The backoff p is *shared*: Kneser-Ney continuation counts (how many distinct
characters stand before a string) over the strings of both classes together, down to single
characters and then evenly over all characters seen, so that a rare expression, which one class saw by chance, is smoothed by what
both have in common. The difference ``log p_toxic - log p_ordinary`` of an unseen continuation
is that of the two backoff weights alone, and 0 in an unseen context.

All counting is distributed: per-task partial counts of distinct strings, summed by key, over
*every* labelled training row. A scoring task gets two tables of log-ratios (strings, contexts), one
entry per distinct string, so they grow with the labelled text: 16 bytes an entry or a little more,
in every Python worker. An entry is found by its whole 64-bit hash, never by a part of it: an unseen
string backs off (two strings of one hash: odds of about n^2 / 2^65).

Score: a logistic function of two length-normalised differences, the text's own (mean over its
characters) and that of its most toxic expression (largest sum over a word, per character of
the word plus `PRIOR_CHARS`). Its few coefficients are fitted on at most `CALIBRATION_ROWS` training
rows of `CALIBRATION_FOLD`, chosen by hash, with a first model that counts all training rows but
these; the model that scores counts them too.

Training rows are those with crc32(id as text) mod 5 <> 0. Labels, language, source and id never
enter a score. Defined results: null and empty texts score as a text of no characters (both
differences 0); null labels and ids are no training rows; of repeated label rows all count; an
id with several texts has all of them labelled; without training rows of both classes every
score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import count_at_most, query, scan, slices, stable, table

ORDER = 5
FOLDS = 5
CALIBRATION_FOLD = 4
CALIBRATION_ROWS = 20_000
PRIOR_CHARS = 4.0
#: Labels are broadcast up to this many rows (16 bytes each) and joined by shuffle beyond.
BROADCAST_LABELS = 2_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normalised texts, each behind ORDER - 1 zeros; starts and lengths of the texts."""
    norm = [" ".join((t or "").lower().split()) for t in texts]
    lead = "\0" * (ORDER - 1)
    flat = np.frombuffer("".join(lead + t for t in norm).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in norm], np.int64)
    stops = np.cumsum(sizes + ORDER - 1)
    return flat, stops - sizes, sizes


def rolling(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the string of ORDER characters that ends at each position, and of the context without its last one."""
    c = flat.astype(np.uint64) + np.uint64(1)
    n = len(c) - ORDER + 1
    ctx = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER - 1):
        ctx = (ctx ^ c[k:k + n]) * _MULT
        ctx ^= ctx >> np.uint64(29)
    full = (ctx ^ c[ORDER - 1:]) * _MULT
    full ^= full >> np.uint64(32)
    return full, ctx


def positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row of `rolling` for every character of every text, in order."""
    stop = np.cumsum(sizes)
    return np.repeat(starts - (ORDER - 1) - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings of ORDER characters with their counts in toxic and ordinary texts, per task."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def reduced():
        key, chars, tox, ordy = (np.concatenate(x) for x in zip(*held))
        key, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        return key, chars[at], np.bincount(inverse, tox, len(key)), np.bincount(inverse, ordy, len(key))

    def batch_of(key, chars, tox, ordy):
        strings = np.ascontiguousarray(chars).view(f"<U{ORDER}").ravel()
        # a NUL cannot end a numpy string: marks travel as line feeds, which no normalised text holds
        return pa.RecordBatch.from_arrays(
            [pa.array(strings.tolist(), pa.string()), pa.array(tox.astype(np.int64)), pa.array(ordy.astype(np.int64))],
            ["s", "tox", "ordy"])

    for batch in batches:
        for part in slices(batch, "text"):
            flat, starts, sizes = codes(part.column("text").to_pylist())
            toxic = np.repeat(np.asarray(part.column("toxic").to_pylist(), np.int64), sizes)
            at = positions(starts, sizes)
            key = rolling(flat)[0][at]
            key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            tox = np.bincount(inverse, toxic, len(key))
            marked = np.where(flat == 0, np.uint32(10), flat)
            chars = marked[at[first][:, None] + np.arange(ORDER)[None, :]]
            held.append((key, chars, tox, np.bincount(inverse, minlength=len(key)) - tox))
            n += len(key)
            if n > 2_000_000:
                held = [reduced()]
                n = len(held[0][0])
                if n > 1_500_000:                        # bounded memory: hand over and start anew
                    yield batch_of(*held[0])
                    held, n = [], 0
    if held:
        yield batch_of(*reduced())


def _ratios(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(s, llr)`` of every seen string and of every seen context."""
    n1 = strings.agg(*[F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in ("tox", "ordy") for k in (1, 2)])
    r = n1.first()
    d = {c: max(0.1, (r[f"{c}1"] or 0) / max(1, (r[f"{c}1"] or 0) + 2 * (r[f"{c}2"] or 0))) for c in ("tox", "ordy")}
    # Shared backoff: distributions of orders ORDER - 1 .. 1 from continuation counts of both classes.
    # Level m holds every distinct string of m characters with k, the distinct characters before it.
    levels = {}
    longer = strings.select("s")
    for m in range(ORDER - 1, 0, -1):
        longer = longer.groupBy(F.expr(f"substring(s, 2, {m})").alias("s")).agg(F.count(F.lit(1)).alias("k"))
        levels[m] = stable(longer)
        longer = levels[m].select("s")
    chars = max(1, levels[1].count())
    lower = None
    for m in range(1, ORDER):
        level = levels[m].withColumn("ctx", F.expr(f"substring(s, 1, {m - 1})"))
        c = level.agg(F.sum((F.col("k") == 1).cast("long")).alias("a"), F.sum((F.col("k") == 2).cast("long")).alias("b")).first()
        disc = max(0.1, (c["a"] or 0) / max(1, (c["a"] or 0) + 2 * (c["b"] or 0)))
        sums = level.groupBy("ctx").agg(F.sum("k").alias("of"), F.count(F.lit(1)).alias("kinds"))
        level = level.join(sums, "ctx")
        if lower is None:
            back = F.lit(1.0 / chars)
        else:
            low = lower.select(F.col("s").alias("t"), F.col("p").alias("pb"))
            level = level.join(low, F.expr(f"substring(s, 2, {m - 1}) = t"))
            back = F.col("pb")
        lower = level.select("s", ((F.greatest(F.col("k") - disc, F.lit(0.0)) + disc * F.col("kinds") * back)
                                   / F.col("of")).alias("p"))
    lower = stable(lower)
    at = strings.withColumn("ctx", F.expr(f"substring(s, 1, {ORDER - 1})"))
    ctx = at.groupBy("ctx").agg(*[a for c in ("tox", "ordy") for a in (
        F.sum(c).alias(f"N_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"T_{c}"))])
    full = (at.join(ctx, "ctx").join(lower.select(F.col("s").alias("t"), "p"), F.expr(f"substring(s, 2, {ORDER - 1}) = t")))

    def prob(c):
        return F.when(F.col(f"N_{c}") > 0, (F.greatest(F.col(c) - d[c], F.lit(0.0)) + d[c] * F.col(f"T_{c}") * F.col("p"))
                      / F.col(f"N_{c}")).otherwise(F.col("p"))

    def weight(c):
        return F.when(F.col(f"N_{c}") > 0, d[c] * F.col(f"T_{c}") / F.col(f"N_{c}")).otherwise(F.lit(1.0))

    seen = full.select("s", (F.log(prob("tox")) - F.log(prob("ordy"))).alias("llr"))
    backs = ctx.select(F.col("ctx").alias("s"), (F.log(weight("tox")) - F.log(weight("ordy"))).alias("llr"))
    return seen, backs


def _to_keys(kind: int):
    """Hash each string (kind 0) or context (kind 1) as the scorer does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = ORDER - kind
        for b in batches:
            if not b.num_rows:
                continue
            text = "".join(b.column("s").to_pylist())
            c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(-1, size)
            c = np.where(c == 10, 0, c).astype(np.uint32)
            if kind:
                c = np.concatenate([c, np.zeros((len(c), 1), np.uint32)], axis=1)
            full, ctx = rolling(c.ravel())
            h = (ctx if kind else full)[::ORDER]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("llr")], ["key", "llr"])
    return run


class Ratios:
    """Log-ratios by 64-bit hash: sorted hashes, and where those of each leading part start."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        # one greater than any hash but the greatest ends every search
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order].astype(np.float32), np.float32(np.nan))
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        parts = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(self.keys, parts).astype(np.uint32 if len(keys) < 2**32 else np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The log-ratio of each hash, NaN where there is none."""
        at = self.starts.take((h >> self.shift).astype(np.int64)).astype(np.int64)
        found = self.keys.take(at)
        open_ = np.flatnonzero(found < h)
        while len(open_):
            at[open_] += 1
            found[open_] = self.keys.take(at[open_])
            open_ = open_[found[open_] < h[open_]]
        out = self.values.take(at)
        out[found != h] = np.nan
        return out


class Model:
    """Log-ratio tables, which grow with the distinct strings of the labelled text, and the calibration."""

    def __init__(self, strings: Ratios, contexts: Ratios, weights: np.ndarray | None = None):
        self.strings, self.contexts, self.weights = strings, contexts, weights

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Per text: mean difference per character, largest difference of a word per character of it."""
        flat, starts, sizes = codes(texts)
        out = np.zeros((len(texts), 2))
        if not sizes.sum():
            return out
        full, ctx = rolling(flat)
        at = positions(starts, sizes)
        llr = self.strings.find(full[at])
        unseen = np.isnan(llr)
        llr[unseen] = np.nan_to_num(self.contexts.find(ctx[at[unseen]]))
        llr = llr.astype(np.float64)
        some = sizes > 0
        first = (np.cumsum(sizes) - sizes)[some]
        out[some, 0] = np.add.reduceat(llr, first) / sizes[some]
        # a word takes the blank behind it
        char = flat[at + ORDER - 1]
        word = np.union1d(first, np.flatnonzero(char == 32) + 1)
        word = word[word < len(llr)]
        size = np.diff(np.r_[word, len(llr)])
        per = np.add.reduceat(llr, word) / (size + PRIOR_CHARS)
        out[some, 1] = np.maximum.reduceat(per, np.searchsorted(word, first))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return logistic(self.differences(texts), self.weights)


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = w[0] + (x - w[3:5]) / w[5:7] @ w[1:3]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton steps on standardised features; returns bias, weights, means and deviations."""
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.c_[np.ones(len(x)), (x - mean) / dev]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w, mean, dev]


def _table(df: DataFrame, kind: int) -> Ratios:
    """The log-ratios of all strings or contexts; the driver takes 12 bytes of each."""
    got = df.mapInArrow(_to_keys(kind), "key long, llr double").select("key", F.col("llr").cast("float")).toArrow()
    return Ratios(got.column("key").to_numpy().view(np.uint64), got.column("llr").to_numpy())


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic") -> Model:
    """Count the two classes over all training rows of ``labels`` and calibrate; see the module text."""
    spark = docs.sparkSession
    marks = (scan(labels, {"id": (id_col, "long"), "toxic": (label_col, "int")})
             .where("toxic IN (0, 1)").withColumn("fold", fold("id")).where("fold <> 0"))
    texts = scan(docs, {"id": (id_col, "long"), "text": (text_col, "string")})
    hint = F.broadcast if count_at_most(marks, BROADCAST_LABELS) else (lambda x: x)
    rows = texts.join(hint(marks), "id").withColumn("at", F.xxhash64("id"))
    # the calibration rows: those of the fold with the lowest hashes, about CALIBRATION_ROWS of them
    n = marks.where(F.col("fold") == CALIBRATION_FOLD).count()
    top = 2**63 - 1 if n <= CALIBRATION_ROWS else (CALIBRATION_ROWS << 64) // n - 2**63
    held = (F.col("fold") == CALIBRATION_FOLD) & (F.col("at") <= top)

    def counted(part: DataFrame) -> DataFrame:
        return part.select("text", "toxic").mapInArrow(_count_strings, "s string, tox long, ordy long")

    def summed(parts: DataFrame) -> DataFrame:
        return stable(parts.groupBy("s").agg(F.sum("tox").alias("tox"), F.sum("ordy").alias("ordy")))

    def modelled(strings: DataFrame) -> Model | None:
        totals = strings.agg(F.sum("tox"), F.sum("ordy")).first()
        if not totals[0] or not totals[1]:
            return None
        seen, backs = _ratios(strings)
        return Model(_table(seen, 0), _table(backs, 1))

    others = summed(counted(rows.where(~held)))
    every = summed(others.unionByName(counted(rows.where(held))))
    model, first = modelled(every), modelled(others)
    if model is None:
        none = Ratios(np.zeros(0, np.uint64), np.zeros(0))
        return Model(none, none)
    if first is None:
        return model
    shared = spark.sparkContext.broadcast(first)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text")):
            x = shared.value.differences(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), part.column("toxic"),
                                              part.column("at")], ["a", "b", "toxic", "at"])
    got = (rows.where(held).select("text", "toxic", "at").mapInArrow(features, "a double, b double, toxic int, at long")
           .orderBy("at").limit(CALIBRATION_ROWS).toArrow())
    y = got.column("toxic").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return model
    model.weights = fit_logistic(np.c_[got.column("a").to_numpy(), got.column("b").to_numpy()], y)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, mean_difference, word_difference`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in (p for b in batches for p in slices(b, "text", 1_000_000)):
            texts = part.column("text").to_pylist()
            x = m.differences(texts) if m.weights is not None else np.zeros((len(texts), 2))
            score = logistic(x, m.weights) if m.weights is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(x[:, 0]),
                                              pa.array(x[:, 1])], ["doc_id", "score", "mean_difference", "word_difference"])
    return scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(
        run, "doc_id long, score double, mean_difference double, word_difference double")


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``; columns unchanged, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, text_col, 1_000_000)):
            yield part.filter(pa.array(shared.value.scores(part.column(text_col).to_pylist()) < threshold))
    return docs.mapInArrow(run, docs.schema)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_difference", "word_difference")
