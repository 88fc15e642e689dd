"""Token ids in binary segments: Simple-8b word-aligned coding.

Words of 64 bits: a selector in the top 4 bits, values packed from the low end. Selector s
says how many values of how many bits follow (`COUNTS`, `WIDTHS`); selector 0 is the escape:
its 60 payload bits are the low bits of one value, and its 4 high bits are the low bits of
the next word. Values are cut into blocks of ``BLOCK`` values (the last one of a document may
be shorter), each starts at a word of its own, and the block's first word is stored, so that
all blocks are decoded at once with array operations.

A segment is one self-contained binary value, little-endian::

    magic 'S8BSEG01' | n_docs u64 | n_blocks u64 | n_words u64
    doc_id i64[n_docs] (null: a bit in null_doc u8[n_docs]) | n_ids u64[n_docs]
    first word of each block u32[n_blocks + 1] | words u64[n_words]

Segments are rows of a Parquet table in ascending document order (``part``, ``seq``), which
gives atomic, repeatable task commits on any store. ``start`` inside a part is known to the
task that writes it; the parts' own starts are sums over one row per part.

Defined results: a null or empty text has only the end id; null ids come first; equal ids are
ordered by scan position; an empty table gives an empty file.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, slices, stable, table

BLOCK = 128
MAGIC = b"S8BSEG01"
#: Fixed values of the format: values per word and bits per value for selectors 1 to 15 (0: escape).
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A segment is closed at so many ids (one slice of texts is never cut).
SEGMENT_IDS = 1_000_000
#: Text that is tokenized at once.
SLICE_BYTES = 2_000_000


# ---------------------------------------------------------------- Simple-8b

def encode(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, first word of each block)`` of documents of ``lengths`` ids laid end to end.

    All blocks advance in step: step k writes the k-th word of every block that has values left.
    A word that reaches over the end of its block is padded with zeros.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    per_doc = -(-lengths // BLOCK)
    n_blocks = int(per_doc.sum())
    if not n_blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    inside = np.arange(n_blocks) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    size = np.minimum(BLOCK, np.repeat(lengths, per_doc) - inside * BLOCK)
    # one row per block with room behind it for zeros: a word never looks into the next block
    grid = np.zeros((n_blocks, BLOCK + 120), np.uint64)
    grid[:, :BLOCK][np.arange(BLOCK)[None, :] < size[:, None]] = ids
    need = _need(grid)                                            # smallest width, as a selector from the end
    width = BLOCK + 120
    need, grid = need.ravel(), grid.ravel()
    base = np.arange(n_blocks) * width                            # flat position of each block's next value
    stop, pos = base + size, np.zeros(n_blocks, np.int64)
    rows, made = np.arange(n_blocks), []                          # (block, position in the block, word)
    while len(rows):
        here = base[rows]
        sel = np.zeros(len(rows), np.int8)                        # 0: escape
        most, at, open_ = need.take(here), here, np.arange(len(rows))
        # from one value a word upwards: once a count does not fit, no larger one does
        for s in range(15, 0, -1):
            for k in range(COUNTS[s + 1] if s < 15 else 1, COUNTS[s]):
                np.maximum(most, need.take(at + k), out=most)
            fits = np.flatnonzero(most < s)
            if not len(fits):
                break
            if len(fits) < len(open_):
                most, at, open_ = most[fits], at[fits], open_[fits]
            sel[open_] = s
        word = np.zeros(len(rows), np.uint64)
        for s in range(16):
            m = np.flatnonzero(sel == s)
            if not len(m):
                continue
            at = here[m]
            if s == 0:                                            # two words for one value
                value = grid.take(at)
                word[m] = value & np.uint64((1 << 60) - 1)
                made.append((rows[m], pos[rows[m]] + 1, value >> np.uint64(60)))
                continue
            packed = np.full(len(m), np.uint64(s << 60))
            if WIDTHS[s]:
                for k in range(COUNTS[s]):
                    packed |= grid.take(at + k) << np.uint64(k * WIDTHS[s])
            word[m] = packed
        made.append((rows, pos[rows], word))
        base[rows] = here + COUNTS[sel]
        pos[rows] += np.where(sel == 0, 2, 1)
        rows = rows[base[rows] < stop[rows]]
    first = np.r_[0, np.cumsum(pos)]
    words = np.empty(int(first[-1]), np.uint64)
    for block, place, word in made:
        words[first[block] + place] = word
    return words, first.astype(np.uint32)


_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _need(values: np.ndarray) -> np.ndarray:
    """How many of the widths of selectors 1, 2, ... are too narrow for each value: selector s holds it if fewer than s."""
    if values.max(initial=0) < 1 << 16:
        return _SMALL[values.astype(np.uint16)]
    return np.searchsorted(_LIMITS, values.ravel(), side="right").astype(np.uint8).reshape(values.shape)


def decode(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All ids of documents of ``lengths`` ids, from their words and block offsets."""
    per_doc = -(-lengths // BLOCK)
    n_blocks = int(per_doc.sum())
    if not n_blocks:
        return np.empty(0, np.uint64)
    inside = np.arange(n_blocks) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    size = np.minimum(BLOCK, np.repeat(lengths, per_doc) - inside * BLOCK)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is payload, whatever its top bits are; escapes are found in order
    payload = np.zeros(len(words), bool)
    for k in np.flatnonzero(sel == 0).tolist():
        if not payload[k]:
            payload[k + 1] = True
    count = np.where(payload, 0, COUNTS[sel])
    block = np.repeat(np.arange(n_blocks), np.diff(first.astype(np.int64)))
    before = np.cumsum(count) - count
    at = before - before[first[:-1].astype(np.int64)][block]      # position of a word's first value in its block
    width = BLOCK + 120
    out = np.zeros(n_blocks * width, np.uint64)
    place = block * width + at
    for s in range(1, 16):
        m = np.flatnonzero((sel == s) & ~payload)
        if len(m) and WIDTHS[s]:
            word, to, low = words[m], place[m], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[to + k] = (word >> np.uint64(k * WIDTHS[s])) & low
    m = np.flatnonzero((sel == 0) & ~payload)
    out[place[m]] = words[m] | (words[m + 1] << np.uint64(60)) if len(m) else 0
    return out.reshape(n_blocks, width)[:, :BLOCK][np.arange(BLOCK)[None, :] < size[:, None]]


def pack_segment(doc_ids: list, lengths: np.ndarray, words: np.ndarray, first: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, np.array([len(ids), len(first) - 1, len(words)], "<u8").tobytes(), ids.tobytes(),
                     null.tobytes(), lengths.astype("<u8").tobytes(), first.astype("<u4").tobytes(),
                     words.astype("<u8").tobytes()])


def unpack_segment(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """``(doc ids, lengths, ids)`` of a segment."""
    if blob[:8] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_blocks, n_words = (int(v) for v in np.frombuffer(blob, "<u8", 3, 8))
    at = 32
    ids = np.frombuffer(blob, "<i8", n_docs, at)
    null = np.frombuffer(blob, "u1", n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(blob, "<u8", n_docs, at := at + n_docs).astype(np.int64)
    first = np.frombuffer(blob, "<u4", n_blocks + 1, at := at + 8 * n_docs)
    words = np.frombuffer(blob, "<u8", n_words, at + 4 * (n_blocks + 1))
    return [None if z else i for i, z in zip(ids.tolist(), null.tolist())], lengths, decode(words, first, lengths)


# ---------------------------------------------------------------- tokenizing

class WordEncoder:
    """Ids of whole texts with a tokenizers file, with a bounded memory of words seen before.

    The tokenizer splits at white space before anything else, so a text's ids are its blank-separated
    words' ids laid end to end. A slice's distinct words are looked up; of new ones, those of characters below U+0300 (which
    composition leaves alone) are lower-cased and split by the file's own pattern, and their parts go to
    the library's model; any other goes through the whole tokenizer. Texts that hold an ASCII separator
    control or the opening of a special token are encoded as a whole.
    """

    #: The split takes the first four for blanks, the tokenizer does not; ``<|`` may open a special token.
    WHOLE = r"[\x1c-\x1f]|<\|"

    def __init__(self, path: str, memory: int = 1_000_000):
        import json
        import os

        import regex
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        #: Only for the kind of file that this way is proven equal on; else every word takes the whole tokenizer.
        self.parts = regex.compile(split[0]["pattern"]["Regex"]) if split and kinds == [
            "NFC", "Replace", "Lowercase"] else None
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]       # byte-level alphabet, by its rule
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.memory = memory
        self.clear()
        self.clear_parts()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def clear_parts(self) -> None:
        #: Numbers of parts, and of words for the whole tokenizer as tuples of one.
        self.pieces: dict[str | tuple[str], int] = {}
        self.part_flat, self.part_at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _parts(self, word: str) -> list[str]:
        """A lower-cased word cut by the file's pattern; runs of letters, alone or before one mark, need no search."""
        if word.isalpha():
            return [word]
        if word[:-1].isalpha() and not word[-1].isalnum() and word[-1].isascii():
            return [word[:-1], word[-1]]
        return self.parts.findall(word)

    def _learn(self, words: list[str]) -> None:
        gc.disable()                                              # some 10^5 small lists and no cycle among them
        try:
            self._take(words)
        finally:
            gc.enable()

    def _take(self, words: list[str]) -> None:
        own = [self.parts is not None and (w.isascii() or max(w) < "\u0300") for w in words]
        cut = [self._parts(w.lower()) if o else [(w,)] for w, o in zip(words, own)]
        known, tokenize, letter = self.pieces, self.model.tokenize, self.letters.__getitem__
        parts = list(chain.from_iterable(cut))
        new = list(set(parts).difference(known))
        ids, sizes = [], []
        for part in new:
            if type(part) is tuple:
                got = self.whole.encode(part[0], add_special_tokens=False).ids
            else:
                got = [t.id for t in tokenize(
                    part if part.isascii() and part.isprintable() else "".join(map(letter, part.encode())))]
            ids += got
            sizes.append(len(got))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.part_flat = np.concatenate([self.part_flat, np.array(ids, np.uint32)])
        self.part_at = np.concatenate([self.part_at, self.part_at[-1] + np.cumsum(sizes, dtype=np.int64)])
        k = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        flat, stop = _gather(self.part_flat, self.part_at, k)
        stop = np.r_[0, stop][np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.flat = np.concatenate([self.flat, flat])
        self.at = np.concatenate([self.at, self.at[-1] + stop])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null) laid end to end, each with ``end_id`` behind it, and their numbers."""
        whole = pc.match_substring_regex(texts, self.WHOLE)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        parts = pc.utf8_split_whitespace(pc.if_else(whole, "", texts) if odd else texts)
        doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        words = parts.flatten()
        filled = pc.greater(pc.binary_length(words), 0)           # blanks at an end of a text leave an empty one
        words, doc = words.filter(filled).dictionary_encode(), doc[filled.to_numpy(zero_copy_only=False)]
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > self.memory:
            self.clear()
        if len(self.pieces) > self.memory:
            self.clear_parts()
        k = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        unseen = np.flatnonzero(k < 0)
        if len(unseen):
            k[unseen] = np.arange(len(self.index), len(self.index) + len(unseen))
            self._learn([found[i] for i in unseen.tolist()])
        k = k[words.indices.to_numpy()]
        size = self.at[k + 1] - self.at[k]
        own = {i: self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids for i in odd}
        lengths = np.bincount(doc, size, len(texts)).astype(np.int64) + 1
        lengths[odd] = [len(ids) + 1 for ids in own.values()]
        stop = np.cumsum(lengths)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        free = np.ones(len(out), bool)                            # places of words' ids
        free[stop - 1] = False
        out[stop - 1] = end_id
        for i, ids in own.items():
            free[stop[i] - lengths[i]:stop[i]] = False
            out[stop[i] - lengths[i]:stop[i] - 1] = ids
        out[free] = _gather(self.flat, self.at, k)[0]
        return out, lengths


def _gather(flat: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[at[i]:at[i + 1]]`` of all i in ``k`` end to end, and where each ends."""
    size = at[k + 1] - at[k]
    stop = np.cumsum(size)
    return flat[np.repeat(at[k] - (stop - size), size) + np.arange(int(stop[-1]) if len(k) else 0)], stop


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- files

SEGMENTS = "part int, seq long, first_doc long, start long, n_ids long, segment binary"
SEGMENTS_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first_doc", pa.int64()),
                            ("start", pa.int64()), ("n_ids", pa.int64()), ("segment", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Tokenize ``docs``, write the segments in ascending id order and give the table that reads them back."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, here, seq, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []                                    # (doc ids, lengths, words, block offsets)

        def close():
            docs_, lengths, words, first = zip(*held)
            shift = np.cumsum([0] + [len(w) for w in words]).astype(np.uint32)
            offsets = np.concatenate([f[:-1] + s for f, s in zip(first, shift)] + [shift[-1:]])
            lengths, docs_ = np.concatenate(lengths), [d for ds in docs_ for d in ds]
            blob = pack_segment(docs_, lengths, np.concatenate(words), offsets)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (here, seq, docs_[0], start, int(lengths.sum()), blob), SEGMENTS_ARROW.types)], schema=SEGMENTS_ARROW)

        for part in (p for b in batches for p in slices(b, "text", SLICE_BYTES)):
            ids, lengths = enc.encode(part.column("text").fill_null(""), end_id)
            words, first = encode(ids, lengths)
            held.append((part.column("doc_id").to_pylist(), lengths, words, first))
            if sum(int(x[1].sum()) for x in held) >= SEGMENT_IDS:
                n = sum(int(x[1].sum()) for x in held)
                yield close()
                held, seq, start = [], seq + 1, start + n
        if held:
            yield close()

    # The texts are ordered before they are tokenized: range bounds come from a pass over their rows, and a
    # pass over tokenized rows would tokenize twice.
    rows = scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).withColumn(
        "scan", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, "doc_id", "scan").sortWithinPartitions("doc_id", "scan")
    return stable(ordered.mapInArrow(segments, SEGMENTS))


def part_starts(files: DataFrame) -> DataFrame:
    """``(part, before)``: ids in all parts before this one (one row per part)."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("segment")):
                docs, lengths, ids = unpack_segment(blob.as_buffer().to_pybytes())
                raw = memoryview(ids.astype("<u4").tobytes())
                edge = np.r_[0, np.cumsum(lengths)].tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array([start + e for e in edge[:-1]], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edge[:-1], edge[1:])], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    placed = files.join(F.broadcast(part_starts(files)), "part").select(       # bounded: one row per part
        (F.col("start") + F.col("before")).alias("start"), "segment")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op6_token_ids")
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(files)
