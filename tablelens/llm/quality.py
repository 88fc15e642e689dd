"""Quality rules: base counts, then line labels by a linear-chain conditional random field.

A text's ``\\n``-split lines are a chain of labels, content or boilerplate. Each line has binary
features of its characters (`FEATURES`); the field scores ``sum(weights of a boilerplate line's
features) + transition of neighbouring labels``, and Viterbi decoding gives the best labelling.
The words in content lines over all words is the content share, which decides retention.

Training: documents of known quality (``labels.quality``) outside the held-out fold, at most
``TRAIN_DOCS`` of them, chosen by hash, that pass the base rule and have at most ``TRAIN_LINES`` lines
(the documented bound of the sample; scoring has none). Lines of poor documents start as boilerplate, lines of good ones as
content; after each fit the poor documents' lines are decoded again, so that a clean line in a poor
document becomes content. Weights maximise the conditional log-likelihood (forward-backward, Adam).

Words are runs of anything but ``[\\x20\\x09-\\x0D]``. Defined results: a null text is empty, has no
words and fails the base rule; ids may be null or repeat (each row is judged by itself); without
training rows of both kinds every line is content; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, slices, table
from tablelens.llm.toxicity import fold

TRAIN_DOCS = 1_200
TRAIN_LINES = 60
MIN_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

FEATURES = ["any line", "no word", "1-3 words", "8 words or more", "60 words or more", "symbols > 2 %",
            "symbols > 10 %", "capitals > 30 %", "capitals > 70 %", "marks !? > 3 %", "digits > 20 %",
            "letters < 70 %", "no final mark", "mean word > 12", "bars", "repeats an earlier line"]

#: Byte classes: 0 other, 1 blank, 2 small letter, 3 capital, 4 digit, 5 symbol, 6 ! or ?, 7 inside a character
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[0xC0:] = 2
_CLASS[ord("A"):ord("Z") + 1] = 3
_CLASS[ord("0"):ord("9") + 1] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[list(b"!?")] = 6
_CLASS[0x80:0xC0] = 7


class Lines:
    """Base counts of a slice of texts and features of all their lines."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [r.split() for r in raw]
        self.n_words = np.array([len(s) for s in split], np.int64)
        lines = [r.split(b"\n") for r in raw]
        self.per_doc = np.array([len(x) for x in lines], np.int64)
        flat = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = _CLASS[flat]
        ends = np.flatnonzero(flat == 10)                        # one line feed ends each line of each text
        starts = np.r_[0, ends[:-1] + 1]

        def per_line(mask):
            total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
            return total[ends] - total[starts]
        blank = kind == 1
        chars = per_line((kind != 1) & (kind != 7))
        word_starts = ~blank & np.r_[True, blank[:-1]]
        words = per_line(word_starts)
        caps, symbols = per_line(kind == 3), per_line(kind == 5)
        letters = caps + per_line(kind == 2)
        marks, digits, bars = per_line(kind == 6), per_line(kind == 4), per_line(flat == ord("|"))
        solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(flat))))
        last = flat[np.maximum(solid[np.maximum(ends - 1, 0)], 0)]   # last character of the line that is no blank
        self.dup = np.zeros(len(ends), bool)
        at = 0
        for x in lines:
            seen: set[bytes] = set()
            for line in x:
                if line in seen:
                    self.dup[at] = words[at] > 0
                else:
                    seen.add(line)
                at += 1
        doc = np.repeat(np.arange(len(texts)), self.per_doc)
        self.words, n = words, np.maximum(chars, 1)
        self.features = np.stack([
            np.ones(len(ends), bool), words == 0, (words > 0) & (words <= 3), words >= 8, words >= 60,
            symbols > 0.02 * n, symbols > 0.1 * n, caps > 0.3 * np.maximum(letters, 1), caps > 0.7 * np.maximum(letters, 1),
            marks > 0.03 * n, digits > 0.2 * n, letters < 0.7 * n, ~np.isin(last, list(b".!?\"")) & (words > 0),
            chars > 12 * np.maximum(words, 1), bars > 2, self.dup], axis=1)
        self.word_chars = np.bincount(doc, chars, len(texts)).astype(np.int64)
        self.n_symbols = np.bincount(doc, symbols, len(texts)).astype(np.int64)
        self.n_dup_lines = np.bincount(doc, self.dup, len(texts)).astype(np.int64)
        self.n_repeat_words = self._repeats(split)
        self.failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)

    def _repeats(self, split: list[list[bytes]]) -> np.ndarray:
        flat = list(chain.from_iterable(split))
        out = np.zeros(len(split), np.int64)
        if len(flat) < 3:
            return out
        number = {w: i for i, w in enumerate(set(flat))}
        w = np.fromiter(map(number.__getitem__, flat), np.uint64, len(flat))
        doc = np.repeat(np.arange(len(split)), self.n_words)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        # 64-bit mix of (document, three words): equal mixes stand for equal windows
        mult = np.uint64(0x9E3779B97F4A7C15)
        h = (doc[inside].astype(np.uint64) + np.uint64(1)) * mult
        for k in range(3):
            h ^= h >> np.uint64(31)
            h = (h ^ w[inside + k]) * mult
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(inside), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(flat), bool)
        for k in range(3):
            covered[inside[twice] + k] = True
        return np.bincount(doc, covered, len(split)).astype(np.int64)


class ChainField:
    """A two-label linear-chain conditional random field (1: boilerplate)."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change              # change[a, b]: score of label b after a

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights

    def decode(self, emission: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Viterbi labels of chains laid end to end; all chains advance in step."""
        n = len(per_doc)
        if not n:
            return np.zeros(0, np.int8)
        first = np.cumsum(per_doc) - per_doc
        order = np.argsort(-per_doc, kind="stable")
        back = np.zeros((len(emission), 2), np.int8)
        score = np.zeros((n, 2))
        score[:, 1] = emission[first]
        longest = int(per_doc.max())
        alive = np.searchsorted(-per_doc[order], -np.arange(longest + 1), side="left")   # chains longer than t
        for t in range(1, longest):
            d = order[:alive[t]]
            step = score[d][:, :, None] + self.change[None]
            at = first[d] + t
            back[at] = step.argmax(1)
            score[d] = step.max(1)
            score[d, 1] += emission[at]
        label = np.zeros(len(emission), np.int8)
        now = score.argmax(1).astype(np.int8)
        label[first + per_doc - 1] = now
        for t in range(longest - 1, 0, -1):
            d = order[:alive[t]]
            at = first[d] + t
            label[at - 1] = back[at, label[at]]
        return label

    @staticmethod
    def fit(features: np.ndarray, per_doc: np.ndarray, label: np.ndarray, steps: int = 100,
            ridge: float = 1e-3) -> ChainField:
        """Maximise the mean conditional log-likelihood of the labels (Adam, forward-backward on padded chains)."""
        n, width, k = len(per_doc), int(per_doc.max()), features.shape[1]
        cell = np.arange(width)[None, :] < per_doc[:, None]
        x = np.zeros((n, width, k))
        x[cell] = features
        y = np.zeros((n, width), int)
        y[cell] = label
        pair = cell[:, 1:]
        seen = np.stack([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)])
        seen_x = (x * y[:, :, None]).sum((0, 1))
        total = float(cell.sum())
        w = np.zeros(k + 4)
        m1, m2 = np.zeros(k + 4), np.zeros(k + 4)
        for i in range(1, steps + 1):
            change = w[k:].reshape(2, 2)
            e = np.stack([np.zeros((n, width)), x @ w[:k]], axis=2)
            fwd, bwd = np.zeros((n, width, 2)), np.zeros((n, width, 2))
            fwd[:, 0] = e[:, 0]
            for t in range(1, width):
                step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + change[None], axis=1) + e[:, t]
                fwd[:, t] = np.where(cell[:, t, None], step, fwd[:, t - 1])
            for t in range(width - 2, -1, -1):
                step = np.logaddexp.reduce(change[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(cell[:, t + 1, None], step, 0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            p = np.exp(fwd + bwd - z[:, None, None]) * cell[:, :, None]
            both = np.exp(fwd[:, :-1, :, None] + change + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grad = np.r_[seen_x - (x * p[:, :, 1:]).sum((0, 1)), (seen - (both * pair[:, :, None, None]).sum((0, 1))).ravel()]
            grad = grad / total - ridge * w
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
            w += 0.15 * (m1 / (1 - 0.9 ** i)) / (np.sqrt(m2 / (1 - 0.999 ** i)) + 1e-8)
        return ChainField(w[:k], w[k:].reshape(2, 2))


def fit_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", rounds: int = 2) -> ChainField:
    """The field fitted on the bounded sample that the module text describes."""
    marks = (scan(labels, {"id": (id_col, "long"), "good": (label_col, "int")})
             .where("good IN (0, 1)").where(fold("id") != 0).withColumn("at", F.xxhash64("id")))
    marks = (marks.where("good = 0").orderBy("at", "id").limit(TRAIN_DOCS // 2)
             .unionAll(marks.where("good = 1").orderBy("at", "id").limit(TRAIN_DOCS // 2)))     # bounded
    texts = scan(docs, {"id": (id_col, "long"), "text": (text_col, "string")})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 1 << np.arange(len(FEATURES))
        for part in (p for b in batches for p in slices(b, "text")):
            x = Lines(part.column("text").to_pylist())
            mask = (x.features @ bits).astype(np.int32)
            edge = np.r_[0, np.cumsum(x.per_doc)]
            keep = (x.per_doc <= TRAIN_LINES) & ~x.failed
            lists = [mask[a:b].tolist() for a, b, k in zip(edge[:-1], edge[1:], keep) if k]
            yield pa.RecordBatch.from_arrays([part.column("good").filter(pa.array(keep)),
                                              pa.array(lists, pa.list_(pa.int32()))], ["good", "lines"])
    got = (texts.join(F.broadcast(marks), "id").select("text", "good").mapInArrow(features, "good int, lines array<int>")
           .orderBy(F.xxhash64("lines"), "good").limit(TRAIN_DOCS).collect())
    neutral = ChainField(np.r_[-1.0, np.zeros(len(FEATURES) - 1)], np.zeros((2, 2)))
    if len({r.good for r in got}) < 2:
        return neutral
    per_doc = np.array([len(r.lines) for r in got])
    mask = np.concatenate([r.lines for r in got])
    x = (mask[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
    poor = np.repeat([r.good == 0 for r in got], per_doc)
    label = poor.astype(np.int8)
    doc = np.repeat(np.arange(len(got)), per_doc)
    for i in range(rounds):
        field = ChainField.fit(x, per_doc, label)
        # at first each line of a poor document speaks for itself: its neighbours' labels are only assumed
        decoded = field.emissions(x) > 0 if i == 0 else field.decode(field.emissions(x), per_doc)
        again = np.where(poor, decoded, 0)
        none = np.bincount(doc, again, len(got)) == 0            # a poor document keeps some boilerplate
        label = np.where(none[doc], label, again)
    return field


def _judge(texts: list[str | None], field: ChainField, min_share: float) -> tuple[Lines, dict[str, np.ndarray]]:
    x = Lines(texts)
    label = field.decode(field.emissions(x.features), x.per_doc)
    doc = np.repeat(np.arange(len(texts)), x.per_doc)
    content = np.bincount(doc, x.words * (label == 0), len(texts)).astype(np.int64)
    share = content / np.maximum(x.n_words, 1)
    return x, {"failed": x.failed, "share": share, "label": label, "kept": ~x.failed & (share >= min_share),
               "n_lines": x.per_doc, "n_boilerplate": np.bincount(doc, label, len(texts)).astype(np.int64)}


def judge_quality(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text",
                  min_share: float = MIN_SHARE) -> DataFrame:
    """Base counts, content share, boilerplate line numbers and the verdict of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)        # some twenty numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text", 1_000_000)):
            x, v = _judge(part.column("text").to_pylist(), shared.value, min_share)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (
                x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, v["failed"], v["kept"],
                v["share"], v["n_lines"], v["n_boilerplate"]))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                 "content_share", "n_lines", "n_boilerplate"])
    return scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate long")


def label_lines(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, boilerplate`` with the 0-based numbers of the boilerplate lines."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text", 1_000_000)):
            x, v = _judge(part.column("text").to_pylist(), shared.value, 0.0)
            edge = np.r_[0, np.cumsum(x.per_doc)]
            lists = [np.flatnonzero(v["label"][a:b]).tolist() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))],
                                             ["doc_id", "boilerplate"])
    return scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(
        run, "doc_id long, boilerplate array<int>")


def keep_good(docs: DataFrame, field: ChainField, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with the rows that are kept; columns unchanged, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, text_col, 1_000_000)):
            yield part.filter(pa.array(_judge(part.column(text_col).to_pylist(), shared.value, min_share)[1]["kept"]))
    return docs.mapInArrow(run, docs.schema)


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_lines(docs, table(spark, sf_dir, "labels")))
