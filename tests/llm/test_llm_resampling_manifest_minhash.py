"""Importance resampling, the Merkle manifest and MinHash near-duplicates against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import importance, merkle, minhash

SCHEMA = "doc_id long, text string, source string, rank int, node string"          # columns that clash with results
ODD = [(3, None, None, 1, "a"), (1, "", "x", 2, None), (None, "a b c d e f", None, None, None), (2, " \n\t ", "y", 3, "b"),
       (2, " \n\t ", "y", 3, "b"), (5, "word " * 30_000, "z", 4, "b"), (6, "Word " * 30_000, "z", 4, "b"),
       (4, "é ß 日本 \U0001F600 <|im_end|> \\ |", "z", 4, "c"), (7, "y" * 70_000, "", 4, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---------------------------------------------------------------- importance resampling

def test_checksums_by_columns():
    rng = np.random.default_rng(1)
    features = {rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in [*rng.integers(1, 40, 300), 511, 512, 513, 1024, 5000]}
    assert importance.feature_buckets(features, 2 ** 31 - 1) == {f: zlib.crc32(f) % (2 ** 31 - 1) for f in features}


def brute_resample(rows, bench, percent, min_words, n_buckets, max_words, seed):
    def features(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))]
        return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % n_buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in bench:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        n, f = features(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n_buckets) / ((s[b] + 1) * (T + n_buckets)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))])
    may = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(may[:len(may) * percent // 100])}
    return Counter((*r, rank.get(id(r))) for r in out)


def test_blocks_of_a_long_text(monkeypatch):
    texts = [b"Alpha beta  gamma-delta " * 9, None, b"x" * 200, b"a b", b""]
    whole = importance.encode_texts(texts, 997, 3, "<u2")
    monkeypatch.setattr(importance, "BLOCK", 30)
    n_words, buckets = importance.encode_texts(texts, 997, 3, "<u2")
    assert n_words == whole[0] == [36, 0, 1, 2, 0]
    assert [Counter(np.frombuffer(b, "<u2")) for b in buckets] == [Counter(np.frombuffer(b, "<u2")) for b in whole[1]]


@pytest.mark.parametrize("max_words", [1, 3])
def test_resampling(spark, odd, max_words):
    rng = random.Random(2)
    words = ["Alpha", "beta", "é", "日本", "x1", "gamma"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)] + [(7, "beta beta")] * 3 + [(8, None), (None, "beta")]
    bench = ["beta gamma x1", None, "Alpha-w3 w4", ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(b,) for b in bench], "text string")
    got = importance.resample(docs, target, 30, 10, 500, max_words, 7).collect()
    assert Counter(map(tuple, got)) == brute_resample(rows, bench, 30, 10, 500, max_words, 7)
    if max_words == 1:
        odd_rows = [(r[0], r[1]) for r in ODD]
        got = importance.resample(odd, target, 50, 1, 10_000).collect()
        assert Counter(map(tuple, got)) == brute_resample(odd_rows, bench, 50, 1, 10_000, 1, 2024)
        assert importance.resample(docs, target.limit(0), 30, 10, 500).count() == len(rows)
        assert importance.resample(docs.limit(0), target).count() == 0


# ---------------------------------------------------------------- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fields, arity):
    """{row: (leaf, subroot, root, proof, folded with the tampered leaf)} by plain recursion over lists."""
    def leaf(r):
        return H(*("-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in fields))

    def up(nodes, paths):
        # nodes: digests; paths: per node the leaves below it -> list of (place, run)
        levels = []
        while len(nodes) > 1:
            runs = [nodes[k:k + arity] for k in range(0, len(nodes), arity)]
            levels.append(runs)
            nodes = [H(*r) for r in runs]
        return nodes[0], levels
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        tops[g] = up([leaf(r) for r in groups[g]], None)
    root, top_levels = up([tops[g][0] for g in order], None)
    out = []
    for gi, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            tampered = dict(r)
            if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0 and r["text"] is not None:
                tampered["text"] = lower(r["text"])
            proof, now = [], leaf(tampered)
            for j, levels in ((i, tops[g][1]), (gi, top_levels)):
                for runs in levels:
                    run, at = runs[j // arity], j % arity
                    proof += run[:at] + run[at + 1:]
                    now = H(*run[:at], now, *run[at + 1:])
                    j //= arity
            out.append((r["doc_id"], leaf(r), tops[g][0], root, H(*proof), now, now == root))
    return Counter(out)


@pytest.mark.parametrize("arity,height", [(3, 2), (2, 1)])
def test_manifest(spark, odd, arity, height):
    rng = random.Random(3)
    rows = [{"doc_id": i, "source": rng.choice([None, "", "hot", "hot", "hot", "B", "a", "é"]), "text": rng.choice([None, "", "Ab c", "x é"])}
            for i in range(120)]
    rows += [rows[5], rows[5], {"doc_id": 5, "source": rows[5]["source"], "text": "other"}, {"doc_id": None, "source": None, "text": "Q"}]
    rows += [{"doc_id": 1000 + i, "source": f"s{i}", "text": "One"} for i in range(20)]
    rule = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0

    def run(df):
        return Counter(map(tuple, merkle.manifest(
            df, ["doc_id", "source", "text"], tampered=(rule, {"text": F.translate("text", merkle.UPPER, merkle.LOWER)}),
            shape=merkle.Shape(arity, height)).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["text"]) for r in rows], "doc_id long, source string, text string")
    want = brute_manifest(rows, ["doc_id", "source", "text"], arity)
    assert run(df) == want
    assert {v[-1] for v in want} == {True, False}
    if arity == 3:
        assert run(odd) == brute_manifest([dict(zip(["doc_id", "text", "source"], r)) for r in ODD], ["doc_id", "source", "text"], arity)
        assert run(df.limit(1)).total() == 1 and not run(df.limit(0))


def test_postorder_positions():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 600):
        shape = merkle.Shape()
        b = merkle.Builder(shape.height(n))
        for i in range(n):
            b.add(f"{i}")
        log, nodes = b.finish(), [str(i) for i in range(n)]
        for level in range(shape.height(n) + 1):
            assert [log[shape.position(level, j, n)] for j in range(len(nodes))] == nodes
            nodes = [hashlib.sha256("".join(nodes[k:k + merkle.ARITY]).encode()).hexdigest() for k in range(0, len(nodes), merkle.ARITY)]


# ---------------------------------------------------------------- MinHash

def brute_components(rows, shingle, percent):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    sets = [grams(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    out = Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out[(d, len(sets[i]), c, d == c)] += 1
    return out


def near_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice([4, 30, 120]))
        for _ in range(rng.choice([1, 3, 40])):
            now = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                now[rng.randrange(len(now))] = rng.choice(words)
            rows.append(" ".join(now) if rng.random() < .8 else "  ".join(now).upper())
    passage = rng.choices(words, k=60)                             # frequent, but too short for a link
    rows += [" ".join(passage + rng.choices(words, k=40)) for _ in range(40)]
    rows += [None, "", " \n", "one", "One", "one two", "é ß", "É ß", "a b a b a b"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("nodes,again", [(minhash.NODES, minhash.AGAIN), (4, 10_000), (3, 1)])
def test_minhash_equals_all_pairs(spark, monkeypatch, nodes, again):
    monkeypatch.setattr(minhash, "NODES", nodes)
    monkeypatch.setattr(minhash, "AGAIN", again)
    rows = near_rows()
    rows += [rows[3], (None, rows[4][1]), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 85)


def test_minhash_links_of_a_large_bucket(spark, monkeypatch):
    """Copies that meet in one band only, in a bucket beyond every limit, stay linked."""
    for name, value in (("BANDS", 1), ("ROWS", 1), ("FIRST", 1), ("NODES", 3), ("AGAIN", 1)):
        monkeypatch.setattr(minhash, name, value)
    from xxhash import xxh3_64_intdigest
    first = lambda t: minhash.signature(np.array([xxh3_64_intdigest(g) for g in minhash.shingles(t.encode(), 3)], np.uint64), 1)[0]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for base in range(30):
        own = [f"b{base}x{i}" for i in range(20)]
        rows += [" ".join([passage, *own[:-1], last]) for last in ("one", "two", "three")]
    rows = list(enumerate(t for t in rows if first(t) == first(passage)))
    assert len(rows) > 30
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 3, 85)


def test_minhash_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert Counter(map(tuple, got)) == brute_components([(r[0], r[1]) for r in ODD], 3, 85)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_circulant_coordinates():
    x = np.array([1, 5, 2 ** 63], np.uint64)
    got = minhash.signature(x, 7)
    for k in range(7):
        assert got[k] == min(minhash._mix(minhash._mix(x, minhash.SIGMA) + np.uint64(k), minhash.PI))
    many = np.random.default_rng(0).integers(0, 2 ** 63, 40_000, dtype=np.uint64)
    a, b = many[:30_000], many[10_000:]                            # Jaccard 0.5
    agree = (minhash.signature(a, 400) == minhash.signature(b, 400)).mean()
    assert abs(agree - 0.5) < 0.1
