"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Item and document texts become words (A-Z lower-cased; every ASCII character that is no
letter or digit separates, every other character belongs to a word). A window is ``width``
consecutive item words; an item of fewer words, but not none, is one window. All windows go
into one automaton; each document's normalised text is scanned once, and a word inside any
occurrence is hit. Occurrences carry word positions, which are mapped back to byte and
character offsets of the original text (`spans`).

The test items are a stated query set: their windows are read in blocks of at most
``BLOCK_BYTES`` of pattern text, one automaton each, so that the automaton an executor
holds is bounded however many items there are; the blocks' results are united per document.

Defined results: a null or word-less text has no words and is clean; a null or word-less
item, or one without an id, has no window; equal windows of several items count for each of them; ids may repeat
(each row is judged by itself); empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import query, scan, slices, table

#: Pattern bytes of one automaton (one node of some tens of bytes for each at most).
BLOCK_BYTES = 4_000_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: One pass over UTF-8 bytes: lower-case A-Z, keep letters, digits and all non-ASCII, blank the rest.
NORMAL = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def item_blocks(items: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of ``(item id, windows)``, streamed to the driver one partition at a time."""
    block, held = [], 0
    rows = scan(items, {"item": (item_col, "string"), "text": (text_col, "string")})
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        wins = windows_of(words_of(text), width) if item is not None else []
        for i in range(0, len(wins), 10_000):           # a long item may go on in the next block
            part = wins[i:i + 10_000]
            block.append((item, part))
            held += sum(map(len, part))
            if held >= BLOCK_BYTES:
                yield block
                block, held = [], 0
    if block:
        yield block


class Matcher:
    """The automaton of one block: ``match(words) -> (hit mask, item ids)``."""

    def __init__(self, block: list[tuple[str, list[bytes]]]):
        import ahocorasick
        owners: dict[bytes, set[str]] = {}
        for item, wins in block:
            for w in wins:
                owners.setdefault(w, set()).add(item)
        self.found = ahocorasick.Automaton()
        for w, items in owners.items():
            key = f" {w.decode('latin-1')} "            # whole words only
            self.found.add_word(key, (len(key), w.count(b" ") + 1, sorted(items)))
        self.found.make_automaton()

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        text = f" {b' '.join(words).decode('latin-1')} "
        ends = list(self.found.iter(text))
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        if ends:
            starts = np.zeros(len(words) + 1, np.int64)
            np.cumsum([len(w) + 1 for w in words], out=starts[1:])      # offset of each word's blank
            for end, (size, n, owned) in ends:
                first = int(np.searchsorted(starts, end - size + 1))
                hit[first:first + n] = True
                items.update(owned)
        return hit, items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text under maximal runs of hit words."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, start = [], None
    for i, (s, e) in enumerate(at):
        if hit[i] and start is None:
            start = s
        if hit[i] and (i + 1 == len(at) or not hit[i + 1]):
            out.append((len(raw[:start].decode("utf-8")), len(raw[:e].decode("utf-8"))))
            start = None
    return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    """The automaton of a broadcast block, built once per Python worker (the last one is kept)."""
    if shared.value[0] not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[shared.value[0]] = Matcher(shared.value[1])
    return _MATCHERS[shared.value[0]]


HITS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
HITS = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def shared_blocks(spark: SparkSession, items: DataFrame, item_col: str, text_col: str, width: int) -> list:
    """One broadcast variable per block (each bounded by ``BLOCK_BYTES``)."""
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, b))
            for b in item_blocks(items, item_col, text_col, width)]


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, items, spans`` (spans: character ranges of the
    original under runs of hit words). Nothing is shuffled: a slice of texts goes through the
    automata of all blocks in turn (one, up to ``BLOCK_BYTES`` of window text)."""
    rows = scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")})
    shared = shared_blocks(docs.sparkSession, items, item_col, item_text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            texts = part.column("text").to_pylist()
            words = [words_of(t) for t in texts]
            hits = [np.zeros(len(w), bool) for w in words]
            found: list[set] = [set() for _ in words]
            for s in shared:
                m = _matcher(s)
                for k, w in enumerate(words):
                    hit, its = m.match(w)
                    if its:
                        hits[k] |= hit
                        found[k] |= its
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": [len(w) for w in words],
                "n_hit": [int(h.sum()) for h in hits], "items": [sorted(f) for f in found],
                "spans": [[{"start": a, "end": b} for a, b in original_spans(t, h)] if f else []
                          for t, h, f in zip(texts, hits, found)]}, schema=HITS_ARROW)
    return rows.mapInArrow(run, HITS)


def remove_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", width: int = 10) -> DataFrame:
    """``docs`` without the rows that hold an occurrence of a window; columns and texts unchanged."""
    shared = shared_blocks(docs.sparkSession, items, item_col, item_text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, text_col)):
            keep = np.ones(part.num_rows, bool)
            texts = [words_of(t) for t in part.column(text_col).to_pylist()]
            for s in shared:
                m = _matcher(s)
                keep &= [not (k and m.match(w)[1]) for k, w in zip(keep, texts)]
            yield part.filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k:k + 9], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT rid, k, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT w.rid, w.ws, s.n, unnest(range(1, len(w.ws) - s.n + 2)) AS k FROM w, sizes s WHERE len(w.ws) >= s.n)),
hits AS (SELECT o.rid, o.k, o.n, win.item_id FROM occ o JOIN win USING (n, win)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
              FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
