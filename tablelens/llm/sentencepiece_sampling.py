"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text becomes `▁` + the text with blanks as `▁`. Its lattice has an edge for every vocabulary
piece at every place (a character without a piece: its UTF-8 bytes as byte pieces, one edge). The
file holds merge ranks, not probabilities, so an edge weighs 1 / (rank + `RANK_OFFSET`) to the
power `alpha` (Zipf's law); a path's probability is its product of weights over the sum of all paths.

No piece holds `▁` behind another character, so the lattice falls into units (a run of `▁` and what
follows it), and equal units share their edges and their sums of all paths to each place.

Sampling is a perturbed A-star search over the tree of decisions "which edge ends here" (units in
order, inside a unit from its end). Node priority is the largest Gumbel-perturbed log-probability
below a node, and the sums of paths make that exact: a node's siblings are disjoint sets of known
mass, whose maxima are Gumbel variables cut at the parent's. So the k best perturbed paths, which
are k distinct segmentations drawn without replacement, come out in order; the (k+1)-th value is the
threshold kappa, and a path of log-probability l was included with probability
1 - exp(-exp(l - kappa)).

All random numbers are hashes of (seed, row key, sample, decision), so a row gets the same samples
whatever batch or executor it falls into, and again after a lost one.

Defined results: a null or empty text has the empty segmentation (one sample, log-probability 0,
inclusion 1); a text with fewer than k segmentations gives all it has, with inclusion 1; null keys
are key 0; equal keys with equal texts get equal samples; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tablelens.llm.common import query, scan, slices, table

RANK_OFFSET = 2.7
SPACE = "▁"
#: Cells of (unit, place, length) looked up at once.
CELLS = 3_000_000
#: Edges of known units that a worker keeps (28 bytes each).
MEMORY = 3_000_000
#: exp() is 0 below this: a decision so unlikely has no finite candidate value.
LEAST_LOG = -746.0

_GOLD, _M1, _M2 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a well-spread hash of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, a, b) -> np.ndarray:
    """Numbers in (0, 1) from a row key and two counters."""
    return _drawn(_seeded(key, a), b)


def _seeded(key: np.ndarray, a) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key + _GOLD * (np.asarray(a, np.uint64) + np.uint64(1)))


def _drawn(seeded: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(seeded + _M1 * (np.asarray(b, np.uint64) + np.uint64(1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Vocabulary:
    """Pieces, weights and a hash table from the beginnings of pieces (as rolling hashes) to piece ids."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        rank = np.array([max(0.0, -sp.get_score(i)) for i in range(n)])
        self.weight = np.where(rank < n, rank + RANK_OFFSET, n + RANK_OFFSET) ** -alpha
        self.log_weight = np.log(self.weight)
        self.known, self.kept, self.number = None, Kept(), {}
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.id = {self.pieces[i]: i for i in normal}
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode()
               for i, p in enumerate(self.pieces)]                # what a piece stands for
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        self.text_size = np.array([len(r) for r in raw], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self._index(normal)

    def _index(self, normal: list[int]) -> None:
        """Open addressing with linear steps; a code is 2 (id + 1), 0 instead if only longer pieces begin so, and 1 more
        if longer ones do."""
        sizes = np.array([len(self.pieces[i]) for i in normal], np.int64)
        flat = np.frombuffer("".join(self.pieces[i] for i in normal).encode("utf-32-le"), np.uint32)
        base, ids, h = np.cumsum(sizes) - sizes, np.array(normal, np.int64), np.zeros(len(normal), np.uint64)
        keys, ends, longer = [], [], []
        for n in range(1, self.longest + 1):
            on = sizes >= n
            base, sizes, ids, h = base[on], sizes[on], ids[on], _roll(h[on], flat[base[on] + n - 1])
            keys.append(h)
            ends.append(np.where(sizes == n, ids, -1))
            longer.append(sizes > n)
        keys, which = np.unique(np.concatenate(keys), return_inverse=True)
        ends, longer = np.concatenate(ends), np.concatenate(longer)
        code = np.zeros(len(keys), np.int32)
        own = np.flatnonzero(ends >= 0)[::-1]                     # of equal pieces the first counts
        code[which[own]] = 2 * (ends[own] + 1)
        code[np.unique(which[longer])] += 1
        size = 1 << max(10, (4 * len(keys)).bit_length())
        self.table, self.keys, self.mask = np.zeros(size, np.int32), np.zeros(size, np.uint64), np.uint64(size - 1)
        left, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.table[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[free]], self.keys[slot[free]] = code[left[free]], keys[left[free]]
            left, slot = np.delete(left, free), np.delete(slot, free)
            slot = (slot + 1) & (size - 1)

    def lattices(self, units: list[str]) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold all of ``units``, and the number of each unit in them.

        A worker keeps those of the first units it meets, up to ``MEMORY`` edges (frequent units come early);
        other new ones are added for this call alone: the next call writes over them.
        """
        at = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        unseen = np.flatnonzero(at < 0).tolist()
        if not unseen and self.known is not None:
            return self.known, at
        new = {units[i]: None for i in unseen}
        new = dict(zip(new, range(len(self.number), len(self.number) + len(new))))
        at[unseen] = [new[units[i]] for i in unseen]
        more = Lattices(list(new), self)
        whole = self.kept.plus(more)
        if len(whole.src) <= MEMORY or self.known is None:
            self.known = whole
            self.kept.keep(whole)
            self.number.update(new)
        return whole, at

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each string (-1: no piece) and whether a longer piece begins with it."""
        slot = (h & self.mask).astype(np.int64)
        code = self.table[slot]
        open_ = np.flatnonzero((code > 0) & (self.keys[slot] != h))
        while len(open_):
            slot[open_] += 1
            slot[open_] &= len(self.table) - 1
            at = slot[open_]
            code[open_] = self.table[at]
            open_ = open_[(self.table[at] > 0) & (self.keys[at] != h[open_])]
        return (code >> 1) - 1, (code & 1).astype(bool)


def _roll(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more character."""
    with np.errstate(over="ignore"):
        h = (h ^ codes.astype(np.uint64)) * _GOLD
    return h ^ (h >> np.uint64(32))


def units_of(text: str) -> list[str]:
    """Cut the marked text in front of every run of blanks; no piece crosses a cut."""
    marked = SPACE + text.replace(" ", SPACE)
    parts = marked.split(SPACE)
    if "" not in parts[1:]:
        return [SPACE + p for p in parts[1:]]
    out, run = [], ""
    for p in parts[1:]:
        run += SPACE
        if p:
            out.append(run + p)
            run = ""
    return out + [run] if run else out


def numbered_units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(distinct units, the number of every unit, units of each text)``: `units_of` all texts (empty: none) at once."""
    parts = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
    count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten()
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if filled.all():
        words = words.dictionary_encode()
        return _marked(words.dictionary), words.indices.to_numpy().astype(np.int64), count
    # a unit ends at every filled part and at a text's last one; the parts since the unit before are its blanks
    end = filled.copy()
    end[np.cumsum(count) - 1] = True
    end = np.flatnonzero(end)
    run = np.diff(end, prepend=-1)
    doc = np.repeat(np.arange(len(texts)), count)[end]
    real = pc.binary_length(texts).to_numpy(zero_copy_only=False)[doc] > 0
    end, run, doc = end[real], run[real], doc[real]
    one = run == 1
    plain = words.take(pa.array(end[one])).dictionary_encode()
    units = _marked(plain.dictionary)
    numbers = np.empty(len(end), np.int64)
    numbers[one] = plain.indices.to_numpy()
    more: dict[str, int] = {}
    numbers[~one] = [more.setdefault(SPACE * n + w, len(units) + len(more)) for n, w in zip(
        run[~one].tolist(), words.take(pa.array(end[~one])).to_pylist())]
    return units + list(more), numbers, np.bincount(doc, minlength=len(texts))


def _marked(words: pa.Array) -> list[str]:
    words = pc.binary_join_element_wise(pa.scalar(SPACE), words, pa.scalar(""))
    return words.to_numpy(zero_copy_only=False).tolist()          # to_pylist makes a scalar of each first


class Lattices:
    """Edges of distinct units. Row r is a place (unit, end); its edges are ``lo[r]:lo[r + 1]``, each with the
    row it comes from (-1: the unit's start), its piece (below 0: minus a character code, its bytes) and the
    conditional probability of ending with it, also added up along the row."""

    def __init__(self, units: list[str], vocab: Vocabulary):
        sizes = np.array([len(u) for u in units], np.int64)
        base = np.cumsum(sizes) - sizes                           # first row of a unit
        self.last = base + sizes - 1                              # the row of its end
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n_rows = len(flat)
        count = np.zeros(n_rows, np.int64)                        # edges of a row so far
        rows, froms, pieces, ranks = [], [], [], []
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):                                    # chunks of units of about one length
            cells = np.arange(1, len(order) - at + 1) * sizes[order[at:]]      # ascending
            stop = at + max(1, int(np.searchsorted(cells, CELLS // vocab.longest, side="right")))
            chunk = order[at:stop]
            begin = np.repeat(base[chunk], sizes[chunk])
            size = sizes[chunk]
            offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            start = begin + offset                                # every place a piece may start at
            left = np.repeat(size, size) - offset
            h = np.zeros(len(start), np.uint64)
            for n in range(1, vocab.longest + 1):
                if not len(start):
                    break
                code = flat[start + n - 1]
                h = _roll(h, code)
                got, longer = vocab.find(h)
                if n == 1:
                    got = np.where(got < 0, -code.astype(np.int64) - 1, got)
                    hit = np.arange(len(start))
                else:
                    hit = np.flatnonzero(got >= 0)
                end = start[hit] + n - 1                          # no row twice
                rows.append(end)
                ranks.append(count[end])
                count[end] += 1
                froms.append(np.where(start[hit] == begin[hit], -1, start[hit] - 1))
                pieces.append(got[hit])
                on = np.flatnonzero(longer & (left > n))          # only where a longer piece may follow
                start, begin, left, h = start[on], begin[on], left[on], h[on]
            at = stop
        row, src, piece, rank = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, froms, pieces, ranks))
        self.lo = np.r_[0, np.cumsum(count)]
        to = self.lo[row] + rank                                  # shorter pieces first
        self.row = np.repeat(np.arange(n_rows, dtype=np.int32), count)
        self.src, self.piece = np.empty(len(row), np.int32), np.empty(len(row), np.int32)
        self.src[to], self.piece[to] = src, piece
        logw = vocab.log_weight[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        codes, which = np.unique(-piece[odd].astype(np.int64) - 1, return_inverse=True)
        logw[odd] = np.log(np.array([np.prod([vocab.weight[vocab.byte[b]] for b in _bytes(c)]) for c in codes.tolist()]))[which]
        # sums of paths, place by place for all units at once, scaled by the largest of a row: rows are numbered anew by
        # (place, unit), units from long to short, so that a place's rows and edges lie end to end
        turn = np.empty(len(sizes), np.int64)
        turn[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        place = np.arange(n_rows) - np.repeat(base, sizes)
        at = np.r_[0, np.cumsum(np.bincount(place))]              # first row of a place
        new = at[place] + np.repeat(turn, sizes)
        count_new = np.empty(n_rows, np.int64)
        count_new[new] = count
        lo = np.r_[0, np.cumsum(count_new)]
        to_new = lo[new[row]] + rank
        src_new, logw_new, cond = np.empty(len(row), np.int64), np.empty(len(row)), np.empty(len(row))
        src_new[to_new] = np.where(src < 0, n_rows, new[src])
        logw_new[to_new] = logw
        total = np.zeros(n_rows + 1)                              # log of the sum of paths; the last: a unit's start
        for r, stop in zip(at[:-1].tolist(), at[1:].tolist()):
            a, b = int(lo[r]), int(lo[stop])
            first, many = lo[r:stop] - a, count_new[r:stop]
            term = total[src_new[a:b]] + logw_new[a:b]
            top = np.maximum.reduceat(term, first)
            term = np.exp(term - np.repeat(top, many))
            add = np.add.reduceat(term, first)
            total[r:stop] = top + np.log(add)
            cond[a:b] = term / np.repeat(add, many)
        self.cond = np.empty(len(row))
        self.cond[to] = cond[to_new]
        # added up row by row, so that a row's numbers do not depend on its neighbours
        self.upto = self.cond.copy()
        j, more = 1, np.flatnonzero(count > 1)
        while len(more):
            e = self.lo[more] + j
            self.upto[e] += self.upto[e - 1]
            j += 1
            more = more[count[more] > j]
        self.upto = self.upto.astype(np.float32)


class Kept:
    """Lattices laid end to end in arrays with room behind them, so that adding some copies no others."""

    def __init__(self):
        self.units = self.rows = self.edges = 0
        self.arrays: dict[str, np.ndarray] = {}

    def plus(self, other: Lattices) -> Lattices:
        """The kept ones and ``other``'s units, rows and edges, numbered on; the next call writes over these unless kept."""
        out, rows, edges = Lattices.__new__(Lattices), self.rows, self.edges
        for name, at, values in (
                ("last", self.units, other.last + rows), ("lo", rows, other.lo + edges),
                ("row", edges, other.row + np.int32(rows)),
                ("src", edges, np.where(other.src < 0, other.src, other.src + np.int32(rows))),
                *((name, edges, getattr(other, name)) for name in ("piece", "cond", "upto"))):
            stop, array = at + len(values), self.arrays.get(name)
            if array is None or len(array) < stop:
                old, array = array, np.empty(stop + stop // 4, values.dtype)
                if old is not None:
                    array[:at] = old[:at]
                self.arrays[name] = array
            array[at:stop] = values
            setattr(out, name, array[:stop])
        return out

    def keep(self, all_: Lattices) -> None:
        self.units, self.rows, self.edges = len(all_.last), len(all_.lo) - 1, len(all_.src)


def _bytes(code: int) -> bytes:
    return chr(code).encode("utf-8", "replace")


def _pick(lat: Lattices, row: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge that ends in each row, drawn by its conditional probability."""
    edge, stop = lat.lo[row].copy(), lat.lo[row + 1] - 1
    open_ = np.flatnonzero((u > lat.upto[edge]) & (edge < stop))
    while len(open_):
        edge[open_] += 1
        e = edge[open_]
        open_ = open_[(u[open_] > lat.upto[e]) & (e < stop[open_])]
    return edge


def _walk(lat: Lattices, row: np.ndarray, key: np.ndarray, sample: int, unit_no: np.ndarray):
    """Draw whole units from ``row`` down to their starts: per step the units that are left and their edges."""
    who, row, step = np.arange(len(row)), row.copy(), 0
    out = []
    keep = row >= 0
    who, row = who[keep], row[keep]
    seeded = _seeded(key[who], np.uint64(sample) << np.uint64(40) | unit_no[who].astype(np.uint64))
    while len(who):
        edge = _pick(lat, row, _drawn(seeded, step))
        out.append((who, edge))
        row = lat.src[edge]
        keep = np.flatnonzero(row >= 0)
        who, row, seeded, step = who[keep], row[keep], seeded[keep], step + 1
    return out


def sample_slice(texts: list[str] | pa.Array, keys: np.ndarray, vocab: Vocabulary, k: int):
    """Per text a list of ``(edges, unit numbers, log-probability, perturbed value)`` and its kappa (-inf: none left)."""
    units, flat, count = numbered_units(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    lat, at = vocab.lattices(units)
    flat = at[flat]
    unit_lo = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(texts)), count)
    unit_no = np.arange(len(flat)) - unit_lo[doc] if len(flat) else np.zeros(0, np.int64)
    row = lat.last[flat] if len(flat) else np.zeros(0, np.int64)
    n = len(texts)
    results: list[list] = [[] for _ in range(n)]

    def ordered(walked, at_unit, at_doc):
        """Lay walks end to end: units come in order of document and number, steps from a unit's end."""
        n_steps = np.zeros(len(at_unit), np.int64)
        for who, _ in walked:
            n_steps[who] += 1
        first = np.cumsum(n_steps) - n_steps
        edge = np.empty(int(n_steps.sum()), np.int64)
        for step, (who, e) in enumerate(walked):
            edge[first[who] + step] = e
        return np.repeat(at_doc, n_steps), np.repeat(at_unit, n_steps), edge

    # first sample: every unit drawn by itself; the value of the whole tree is a plain Gumbel variable
    d, un, e = ordered(_walk(lat, row, keys[doc], 0, unit_no), unit_no, doc)
    value = -np.log(-np.log(uniform(keys, 1 << 60, 0)))
    state = []                                                    # per sample: arrays over its decisions

    def register(sample, docs_in, d, un, e, value, first_open):
        """File a new sample of ``docs_in`` (sorted); decisions before ``first_open`` belong to its parent."""
        p = lat.cond[e]
        lo = np.searchsorted(d, docs_in)
        hi = np.searchsorted(d, docs_in, side="right")
        logp = np.log(np.maximum(p, 1e-300))
        cum = np.empty(len(d))
        for a, b in zip(lo.tolist(), hi.tolist()):                # by document: the same in any batch
            np.cumsum(logp[a:b], out=cum[a:b])
        before = cum - logp                                       # log-probability in front of a decision
        g = np.full(len(d), -np.inf)
        open_ = np.flatnonzero((np.arange(len(d)) >= np.repeat(lo + first_open, hi - lo)) & (before > LEAST_LOG))
        spare = np.maximum(1.0 - p[open_], 0.0)
        r = lat.row[e[open_]]
        some = (lat.lo[r + 1] - lat.lo[r] > 1) & (spare > 1e-15)
        open_, spare = open_[some], spare[some]
        number = np.empty(n, np.int64)
        number[docs_in] = np.arange(len(docs_in))
        j = number[d[open_]]
        u = uniform(keys[d[open_]], (1 << 61) + sample, open_ - lo[j])
        with np.errstate(over="ignore", divide="ignore"):
            g[open_] = -np.log(np.exp(-value[j]) - np.log(u) / (spare * np.exp(before[open_])))
        total = np.where(hi > lo, np.r_[cum, 0.0][np.maximum(hi - 1, 0)], 0.0)
        state.append({"docs": docs_in, "lo": lo, "hi": hi, "d": d, "un": un, "e": e, "before": before, "g": g,
                      "closed": {}})
        for j, x in enumerate(docs_in.tolist()):
            results[x].append((e[lo[j]:hi[j]], un[lo[j]:hi[j]], float(total[j]), float(value[j])))

    every = np.arange(n)
    register(0, every, d, un, e, value, np.zeros(n, np.int64))
    kappa = np.full(n, -np.inf)
    for sample in range(1, k + 1):
        # the best open candidate of each document, over all its samples so far
        best, where, which = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        for s, st in enumerate(state):
            has = st["hi"] > st["lo"]
            if not has.any():
                continue
            lo, docs_in = st["lo"][has], st["docs"][has]
            top = np.maximum.reduceat(st["g"], lo)
            # segments lie end to end and cover the arrays, so that reduceat's ends are right
            at = np.flatnonzero(st["g"] == np.repeat(top, st["hi"][has] - lo))
            seg = np.searchsorted(lo, at, side="right") - 1
            first = np.full(len(lo), -1)
            first[seg[::-1]] = at[::-1]
            better = top > best[docs_in]
            best[docs_in[better]], which[docs_in[better]], where[docs_in[better]] = top[better], s, first[better]
        if sample == k:
            kappa = best
            break
        go = np.flatnonzero(np.isfinite(best))
        if not len(go):
            break
        new_un, new_e, first_open, walk_row, walk_unit = [], [], [], [], []
        first_u, rest_u = (uniform(keys, (1 << 62) + sample, j).tolist() for j in (0, 1))
        for x in go.tolist():
            st, t = state[which[x]], int(where[x])
            j = int(np.searchsorted(st["docs"], x))
            lo, r = int(st["lo"][j]), int(lat.row[st["e"][t]])
            shut = st["closed"].setdefault(t, {int(st["e"][t])})
            a, b = int(lat.lo[r]), int(lat.lo[r + 1])
            free = [i for i in range(a, b) if i not in shut]
            mass = lat.cond[free]
            total_mass = float(mass.sum())
            pick = free[min(int(np.searchsorted(mass.cumsum(), first_u[x] * total_mass)), len(free) - 1)]
            shut.add(pick)
            # what is left beside both stays a candidate, cut at the new value
            rest = total_mass - float(lat.cond[pick]) if len(free) > 1 else 0.0
            if rest > 1e-15:
                with np.errstate(over="ignore", divide="ignore"):
                    st["g"][t] = -np.log(np.exp(-best[x]) - np.log(rest_u[x]) / (rest * np.exp(st["before"][t])))
            else:
                st["g"][t] = -np.inf
            # decisions in front, the new one, then fresh walks: the rest of this unit and all later units
            new_un.append(st["un"][lo:t + 1])
            line = st["e"][lo:t + 1].copy()
            line[-1] = pick
            new_e.append(line)
            first_open.append(t - lo + 1)
            here = int(st["un"][t])
            later = slice(unit_lo[x] + here + 1, unit_lo[x] + count[x])
            walk_row += [lat.src[pick:pick + 1], row[later]]
            walk_unit += [st["un"][t:t + 1], unit_no[later]]
        w_row, w_unit = np.concatenate(walk_row), np.concatenate(walk_unit)
        w_doc = np.repeat(go, [len(a) + 1 for a in walk_row[1::2]])
        d2, un2, e2 = ordered(_walk(lat, w_row, keys[w_doc], sample, w_unit), w_unit, w_doc)
        d1, un1, e1 = np.repeat(go, [len(x) for x in new_un]), np.concatenate(new_un), np.concatenate(new_e)
        d1, un1, e1 = (np.concatenate(v) for v in ((d1, d2), (un1, un2), (e1, e2)))
        o = np.argsort(d1, kind="stable")                         # prefix first, then the walk, by document
        register(sample, go, d1[o], un1[o], e1[o], best[go], np.array(first_open))
    return lat, results, kappa


def pieces_in_order(lat: Lattices, samples: list[tuple[np.ndarray, np.ndarray]], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all samples ``(edges, units)`` end to end, from left to right (a unit's decisions run from its
    end), byte pieces written out; and the place where each sample ends."""
    stop = np.cumsum([len(e) for e, _ in samples])
    if not len(stop) or not stop[-1]:
        return np.zeros(0, np.int32), stop
    edges, units = (np.concatenate(x) for x in zip(*samples))
    new = np.empty(len(units), bool)
    new[0], new[1:] = True, units[1:] != units[:-1]
    new[stop[:-1][stop[:-1] < len(new)]] = True                   # a sample begins
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(units)))
    ids = lat.piece[edges][np.repeat(2 * first + size - 1, size) - np.arange(len(units))]
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        codes = -ids[odd].astype(np.int64) - 1
        spelled = {c: [vocab.byte[b] for b in _bytes(c)] for c in set(codes.tolist())}
        wide = np.ones(len(ids), np.int64)
        wide[odd] = [len(spelled[c]) for c in codes.tolist()]
        begin = np.cumsum(wide) - wide
        ids = np.repeat(ids, wide)
        for c, at in zip(codes.tolist(), begin[odd].tolist()):
            ids[at:at + len(spelled[c])] = spelled[c]
        stop = np.append(begin, len(ids))[stop]
    return ids.astype(np.int32), stop


def decode_pieces(ids, vocab: Vocabulary) -> str:
    """The text of a segmentation: the inverse of any of its encodings."""
    ids = np.asarray(ids, np.int64)
    size = vocab.text_size[ids]
    stop = np.cumsum(size)
    at = np.repeat(vocab.text_at[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(ids) else 0)
    return vocab.text[at].tobytes().decode("utf-8", "replace")[1:]


_VOCABS: dict[tuple, Vocabulary] = {}


def vocabulary(path: str, alpha: float) -> Vocabulary:
    if (path, alpha) not in _VOCABS:
        _VOCABS[path, alpha] = Vocabulary(path, alpha)
    return _VOCABS[path, alpha]


def row_keys(ids: list, seed: int) -> np.ndarray:
    return mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64) + np.uint64(seed + 1 << 40))


SCORES = "log_prob double, perturbed double, inclusion double, log_inclusion double, kappa double"
SAMPLES = "doc_id long, sample int, ids array<int>, " + SCORES


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 42,
                         id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Up to ``k`` distinct segmentations of every row, best perturbed value first.

    With ``digest`` the ids are returned as their number, their crc32 (little-endian 32-bit) and whether
    they decode to the text, in place of the arrays.  ``kappa`` is the value of the best segmentation left out (null:
    none), ``inclusion`` the odds of a segmentation to beat it; those of long texts only fit its logarithm.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for part in (p for b in batches for p in slices(b, "text", 500_000)):
            docs_, text = part.column("doc_id").to_pylist(), part.column("text").fill_null("")
            lat, results, kappa = sample_slice(text, row_keys(docs_, seed), vocab, k)
            found = [(i, j, *f) for i, fs in enumerate(results) for j, f in enumerate(fs)]
            if not found:
                continue
            who, no, edges, units, logp, value = map(list, zip(*found))
            flat, stop = pieces_in_order(lat, list(zip(edges, units)), vocab)
            edge, logp, cut = np.concatenate([[0], stop]), np.array(logp), kappa[who]
            with np.errstate(over="ignore"):
                # log(1 - exp(-exp(x))) is x itself where exp(x) is small; no sample left: included for certain
                odds = logp - cut
                chance = np.where(np.isfinite(cut), -np.expm1(-np.exp(np.minimum(odds, 700.0))), 1.0)
                log_chance = np.where(np.isfinite(cut), np.where(odds < -30, odds, np.log(np.maximum(chance, 1e-300))), 0.0)
            head = [pa.array([docs_[i] for i in who], pa.int64()), pa.array(no, pa.int32())]
            tail = [pa.array(v, pa.float64()) for v in (logp, np.array(value), chance, log_chance)]
            tail.append(pa.array(cut, pa.float64(), mask=~np.isfinite(cut)))
            names = [c.split()[0] for c in SCORES.split(", ")]
            if digest:
                raw, sizes = memoryview(flat.astype("<u4").tobytes()), vocab.text_size[flat]
                text_stop = np.cumsum(sizes)
                spelled = vocab.text[np.repeat(vocab.text_at[flat] - (text_stop - sizes), sizes)
                                     + np.arange(int(sizes.sum()))].tobytes()
                at = np.concatenate([[0], text_stop])[edge].tolist()
                texts = text.to_pylist()
                same = [spelled[a:b] == (" " + texts[i]).encode() if b > a else not texts[i]
                        for a, b, i in zip(at[:-1], at[1:], who)]
                mid = [pa.array(np.diff(edge), pa.int64()),
                       pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.int64()),
                       pa.array(same)]
                names = ["doc_id", "sample", "n_pieces", "ids_crc32", "decodes", *names]
            else:
                mid = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat, pa.int32()))]
                names = ["doc_id", "sample", "ids", *names]
            yield pa.RecordBatch.from_arrays(head + mid + tail, names)
    schema = SAMPLES if not digest else "doc_id long, sample int, n_pieces long, ids_crc32 long, decodes boolean, " + SCORES
    return scan(docs, {"doc_id": (id_col, "long"), "text": (text_col, "string")}).mapInArrow(run, schema)


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                                k=2, digest=True)
