"""The training-data operators on hand-made rows, against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from tablelens.llm import chat, decontaminate, html_template, quality, sharding, simhash, tokenids, toxicity, urlfilter
from tablelens.llm import sentencepiece_sampling as sps

SCHEMA = "doc_id long, text string, lang string, shard int, score double"      # columns that clash with results
ODD = [(3, None, None, 1, 0.5), (1, "", "x", 2, None), (None, "a b c d e f", None, None, None), (2, " \n\t ", "y", 3, 1.0),
       (2, " \n\t ", "y", 3, 1.0), (5, "word " * 30_000, "z", 4, 2.0), (4, "é ß 日本 \U0001F600 <|im_end|> \\ |", "z", 4, 2.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, odd, empty):
    rng = np.random.default_rng(0)
    docs = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 500))]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 7).orderBy("id").collect()
    total, before = sum(len(t) + 16 for _, t in docs), 0
    slots = Counter()
    for r, (i, t) in zip(rows, docs):
        size = len(t) + 16
        assert (r.id, r.size, r.text_crc32) == (i, size, zlib.crc32(t.encode()))
        assert r.shard == (2 * before + size) * 7 // (2 * total) and r.slot == slots[r.shard]
        before, slots[r.shard] = before + size, slots[r.shard] + 1
    got = sharding.shard_by_bytes(odd, 3).collect()
    assert len(got) == len(ODD)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(empty, 3).count() == 0


def test_url_filters(spark):
    urls = [None, "", "nothing", "http://ORG", "http://org/", "http://a.org/x", "http://example.org/es/1",
            "https://m.Example.ORG/en/12?q#f", "http://b.com/fr/1", "http://b.com/de/2", "http://notorg/x",
            "http://casino.example.net/", "http://b.com/de/2", "http://casino.example.org/x", "http://x.com/FR/1", "a://b?c://d"]
    df = spark.createDataFrame([(u, "h") for u in urls], "url string, host string")
    got = urlfilter.judge_urls(df).collect()
    assert Counter(r.url for r in got) == Counter(urls)
    for r in got:
        u = r.url or ""
        after = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", after)[0].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
        path = re.match(r"[^/?#]*(/[^?#]*)?", after)[1] or ""
        fit = [(len(rule), rule, act) for act, rule in urlfilter.HOST_RULES
               for h, s, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        low = u.lower()
        act = max(fit)[2] if fit else "block" if any(re.search(p, low) for _, p, _ in urlfilter.PATTERN_RULES) else "allow"
        assert (r.url_host, r.url_path, r.url_rule, r.url_verdict) == (host, path, max(fit)[1] if fit else None, act), u
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_decontamination(spark, odd, empty, monkeypatch):
    items = [(1, "one two three four five six"), (2, "Alpha BETA"), (3, None), (4, "..."), (None, "q r"), (10, "alpha beta")]
    texts = ["x one two, three y", "ONE two three four five six", "alpha-beta alphabeta", "one two four", None, "", "é alpha\u00a0beta"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    for block in (decontaminate.BLOCK_BYTES, 5):            # one automaton, then several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = {r.doc_id: r for r in decontaminate.find_benchmark(docs, bench, width=3).collect()}
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for item, it in items:
                iw = words(it)
                for k in range(max(1, len(iw) - 2) if iw and item is not None else 0):
                    win = iw[k:k + 3]
                    for a in range(len(w) - len(win) + 1):
                        if w[a:a + len(win)] == win:
                            hit |= set(range(a, a + len(win)))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == (len(w), len(hit), sorted(found)), t
        kept = decontaminate.remove_benchmark(docs, bench, width=3)
        assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].n_hit}
    span = got[0].spans[0]
    assert texts[0][span.start:span.end] == "one two, three"
    assert decontaminate.find_benchmark(odd, bench).count() == len(ODD)
    assert decontaminate.remove_benchmark(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.find_benchmark(empty, bench).count() == 0


def test_chat(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|b"), (1, 2, "user", None), (1, 3, "assistant", probe),
            (2, 0, None, "x"), (None, 0, "assistant", "null id"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stream = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(stream, chat.examples(stream)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    shown = {(r.conv_id, r.example_no): r for r in chat.render_examples(stream).collect()}
    assert shown[1, 0].context == "<|im_start|>user\nhi<|im_end|>\n" and shown[3, 0].context == ""
    assert shown[1, 1].context.startswith(shown[1, 0].context + shown[1, 0].target)
    assert len(shown) == chat.examples(stream).count() == 5
    for t in ("", "\\", "<|", "<\\|", "\\<|\\n", probe):
        assert chat.parse_turn(chat.format_turn("ro\nle", t)[0]) == ("ro\nle", t)
    none = chat.format_turns(df.limit(0))
    assert chat.read_back(none, chat.examples(none)).count() == 0


def test_simhash(spark, odd, empty):
    from xxhash import xxh64_intdigest

    def slow(t, k=4):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["ab", "cd", "Ef", "gh", "ij", "kl", "mn"], 60)) for _ in range(12)]
    texts = [b for b in base for _ in range(4)] + [b.replace("ab", "zz", n) for b in base for n in (1, 2)] + ["", None, "a", "a b c d e"]
    rows = list(enumerate(texts))[::-1]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [slow(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:                                         # label propagation over all pairs
        root = [min(root[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(texts))]
    for i in range(len(texts)):
        assert got[i].fp % (1 << 64) == fps[i] and got[i].component_id == root[i]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert simhash.near_duplicates(odd).count() == len(ODD)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 2 OR doc_id = 3").count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_index_against_all_pairs(monkeypatch, spark):
    rng = np.random.default_rng(1)
    for n in (2, 9, 65, 700):
        base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
        x = base[rng.integers(0, len(base), n)]
        for _ in range(5):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        x = np.unique(x)
        x = x[np.argsort(simhash.gray_rank(x))]
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
        want = np.arange(len(x))
        for _ in range(len(x)):
            want = np.where(near, want[None, :], len(x)).min(1)
        assert (simhash.GrayIndex(x, np.zeros(len(x), int)).components(4) == want).all()
    # hot routing groups are dealt out again without losing a link
    fps = [(int(v),) for v in x.view(np.int64)]
    nodes = spark.createDataFrame(fps, "fp long")
    plain = {tuple(sorted(r)) for r in simhash.components(simhash.local_links(nodes, 4)).collect()}
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 2)
    assert {tuple(sorted(r)) for r in simhash.components(simhash.local_links(nodes, 4)).collect()} == plain


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} or got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for t in range(40):
        lengths = rng.integers(0, 400, rng.integers(1, 6))
        ids = rng.integers(0, 2**63, lengths.sum(), dtype=np.uint64) >> rng.integers(0, 63, lengths.sum()).astype(np.uint64)
        if t % 3 == 0:
            ids = np.where(rng.random(len(ids)) < 0.1, ~ids, ids)       # escapes
        words, first = tokenids.encode(ids, lengths)
        assert (tokenids.decode(words, first, lengths) == ids).all()
        blob = tokenids.pack_segment([None, *range(len(lengths) - 1)], lengths, words, first)
        docs, sizes, back = tokenids.unpack_segment(blob)
        assert docs[0] is None and (sizes == lengths).all() and (back == ids).all()


def test_token_files(spark, odd, empty):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["The cat's 12 dogs!", "<|endoftext|> x", "a\x1cb", "ΣΑΣ İstanbul e\u0301", None, "", "日本\u00a0語"] + [r[1] for r in ODD]
    docs = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)][::-1], "doc_id long, text string")
    got = tokenids.read_token_files(tokenids.write_token_files(docs, path, 2)).orderBy("doc_id").collect()
    at = 0
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i]) == (7 * i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert tokenids.read_token_files(tokenids.write_token_files(odd, path, 2)).count() == len(ODD)
    assert tokenids.read_token_files(tokenids.write_token_files(empty, path, 2)).count() == 0


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(2)
    plain = ["the", "river", "runs", "under", "stone", "bridge", "every", "morning", "slowly"]
    docs, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 6 == 0:
            for k in rng.integers(0, 40, 3):
                w[k] = "zvark" + str(rng.choice(["", "es", "ing"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs_df, spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs_df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    new = spark.createDataFrame([(1, "what a zvarking day"), (2, "slowly the river")], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.remove_toxic(new, model).collect()] == [2]
    scores = toxicity.score_toxicity(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.remove_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(docs_df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.0}


def test_viterbi_and_base_counts():
    rng = np.random.default_rng(4)
    field = quality.ChainField(np.array([1.0]), rng.normal(size=(2, 2)))
    sizes = np.array([1, 7, 3, 9])
    emission = rng.normal(size=sizes.sum())
    got, at = field.decode(emission, sizes), 0
    for n in sizes:
        e = emission[at:at + n]
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: sum(v * x for v, x in zip(y, e))
                   + sum(field.change[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got[at:at + n]) == best
        at += n
    texts = ["x y z x y z\nx y z", None, "", "a\n\na\n \n \nb", "# $ | é\u0085b\u00a0c"]
    x = quality.Lines(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for k in range(3)}
        lines = (t or "").split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", v)) and v in lines[:j] for j, v in enumerate(lines))
        assert (x.n_words[i], x.word_chars[i], x.n_symbols[i], x.n_dup_lines[i], x.n_repeat_words[i]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))


def test_quality(spark, odd, empty):
    rng = np.random.default_rng(6)
    words = ["stone", "bridge", "river", "under", "morning", "light", "table", "window"]

    def line(junk):
        w = [str(v) + str(rng.integers(1000)) if not junk else f"{v}{rng.integers(1000)}###" for v in rng.choice(words, 12)]
        return " ".join(w) + ("" if junk else ".")
    docs, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        docs.append((i, "\n".join([line(False)] + [line(junk) for _ in range(8)] + [line(False)])))
        labels.append((i, int(not junk)))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    field = quality.fit_lines(docs_df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in quality.judge_quality(docs_df, field).collect()}
    assert all(got[i].kept == (i % 3 != 0) for i in got)
    assert {r.doc_id for r in quality.keep_good(docs_df, field).collect()} == {i for i in got if got[i].kept}
    marks = {r.doc_id: r.boilerplate for r in quality.label_lines(docs_df, field).collect()}
    assert marks[0] == list(range(1, 9)) and marks[1] == []
    assert quality.judge_quality(odd, field).count() == len(ODD)
    assert quality.keep_good(odd, field).columns == odd.columns
    assert quality.judge_quality(empty, field).count() == 0
    assert quality.fit_lines(docs_df, spark.createDataFrame([], "doc_id long, quality int")).weights[0] < 0


def test_sampled_segmentations(spark, odd, empty):
    model = P.path("piece_bpe_32k.model")
    vocab = sps.vocabulary(model, 1.0)
    text = "abab c"

    def paths(u):
        if not u:
            return [((), 1.0)]
        return [((vocab.id[u[:n]], *q), vocab.weight[vocab.id[u[:n]]] * w) for n in range(1, len(u) + 1)
                if u[:n] in vocab.id for q, w in paths(u[n:])]
    every = [((), 1.0)]
    for u in sps.units_of(text):
        every = [(a + b, x * y) for a, x in every for b, y in paths(u)]
    total = sum(w for _, w in every)
    prob = {a: w / total for a, w in every}
    n = 20_000
    lat, found, kappa = sps.sample_slice([text] * n, sps.row_keys(list(range(n)), 7), vocab, 2)
    seqs = [[tuple(sps.pieces_in_order(lat, [(e, u)], vocab)[0].tolist()) for e, u, _, _ in f] for f in found]
    assert all(len(set(s)) == 2 and set(s) <= set(prob) for s in seqs)
    pairs = Counter(map(tuple, seqs))
    for (a, b), m in pairs.most_common(3):
        assert abs(m / n - prob[a] * prob[b] / (1 - prob[a])) < 0.01
    assert all(abs(f[2] - math.log(prob[s])) < 1e-9 for fs, ss in zip(found[:50], seqs) for f, s in zip(fs, ss))
    # inverse inclusion probabilities make sums unbiased
    weigh = np.mean([sum(math.exp(f[2]) / -math.expm1(-math.exp(f[2] - k)) for f in fs) for fs, k in zip(found, kappa)])
    assert abs(weigh - 1) < 0.01
    lat, found, kappa = sps.sample_slice(["a"], sps.row_keys([1], 1), vocab, 50)          # all there are
    assert len(found[0]) == len(paths("▁a")) and kappa[0] == -np.inf
    rows = sps.sample_segmentations(odd, model, k=2).collect()
    by = {r[0]: r[1] or "" for r in ODD}
    assert all(sps.decode_pieces(r.ids, vocab) == by[r.doc_id] for r in rows)
    assert {r.doc_id for r in rows} == set(by) and all(0 <= r.inclusion <= 1 for r in rows)
    again = sps.sample_segmentations(odd.repartition(5), model, k=2).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))                            # the key decides, not the batch
    assert sps.sample_segmentations(empty, model).count() == 0


PAGE = ("<html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{nav}</ul></nav>"
        "<div class='ad'>Buy {i}</div><article><h1>Head {i}</h1><p>One&amp;two\n {i}<br>x<p><b>Bold {i}</p>"
        "<div class=\"comments\"><p>me too {i}</p></div><form>mail {i}</form></article><footer>&copy; site {i}</footer></body></html>")


def test_html_extraction(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i=i, nav="<li>n</li>" * (i % 3 + 1))) for i in range(12)]
    odd = [(20, None, None), (21, "http://solo/", "plain words only"), (22, "http://h.example/x", "<p>no article</p>"),
           (22, "http://h.example/x", ""), (None, "nothing", "<main>m<aside>s</aside> &lt;n&gt;</main>")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_pages")
    got = html_template.extract_pages(df).collect()
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert len(got) == len(pages) + len(odd) and all(r.n_chars == len(r.text) for r in got)
    for i, _, _ in pages:
        want = f"Head {i}\n\nOne&two {i} x\n\nBold {i}"
        assert by[i, len(want)] == want
    assert by[20, 0] == "" and by[21, 16] == "plain words only" and by[22, 10] == "no article" and by[None, 6] == "m\n\n<n>"
    assert html_template.extract_pages(df.limit(0)).count() == 0


def test_html_template_classes_decide(spark):
    # no article, no side word: only what is constant over the host tells menu and notice from the text
    whole = ("<html><body id='p{i}'><div class='top'><span>Home</span> <span>Contact us</span></div><div class='text'><h2>Title {i}</h2>"
             "<p>Body number {i} of the page</p><p>Please log in to write</p></div><div class='end'>All rights of the site</div></body></html>")
    inside = "<article><p>Story {i} of the day</p><div class='box'>Read more on the site</div></article>"
    rows = [(i, f"http://a.example/{i}", whole.format(i=i)) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", inside.format(i=i)) for i in range(6)]
    rows += [(20 + i, f"http://c.example/{i}", inside.format(i=7)) for i in range(4)]                # copies of one page
    rows += [(30, "http://d.example/", inside.format(i=8))]                                          # one page: no template
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract_pages(df).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\n\nBody number {i} of the page"
        assert got[10 + i] == f"Story {i} of the day"
    assert {got[i] for i in range(20, 24)} == {"Story 7 of the day\n\nRead more on the site"}
    assert got[30] == "Story 8 of the day\n\nRead more on the site"


def test_html_text_behind_a_side_block(spark):
    pages = [(i, f"http://h.example/{i}", f"<article><p>A {i}</p><div class='ad'>x</div><p>B {i}</p>" + f"<div>C {i} {{}}</div>" * (i % 3 + 1)
              + "</article>") for i in range(6)]
    pages += [(10 + i, f"http://{h}/{i}", f"<html><body class='has-sidebar'>{a}<p>Text {i}</p>{b}<div class='ad'>x</div></body></html>")
              for i in range(6) for h, a, b in [("m.example", "<main class='no-comments'>", "</main>") if i % 2 else ("b.example", "", "")]]
    got = {r.page_id: r.text for r in html_template.extract_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == "\n\n".join([f"A {i}", f"B {i}", *[f"C {i} {{}}"] * (i % 3 + 1)])
        assert got[10 + i] == f"Text {i}"


def test_html_without_article_keeps_short_parts(spark):
    page = ("<html><body><div class='menu'>go {i}</div><div id='x'><h1>Head {i}</h1><p>{long}</p><h2>Short {i}</h2><figure>Fig {i}</figure>"
            "<blockquote>Quote {i}</blockquote></div></body></html>")
    rows = [(i, f"http://{'one' if i == 9 else 'h'}.example/{i}", page.format(i=i, long=f"long {i} " * 50)) for i in (*range(5), 9)]
    got = {r.page_id: r.text for r in html_template.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (*range(5), 9):
        assert got[i] == "\n\n".join([f"Head {i}", (f"long {i} " * 50).strip(), f"Short {i}", f"Fig {i}", f"Quote {i}"])


def test_toxicity_tables_are_exact(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def text(n):
        return " ".join("".join(rng.choice(letters, 7)) for _ in range(n))
    rows = spark.createDataFrame([(text(400), int(i % 4 == 0)) for i in range(40)], "text string, toxic int")
    strings = toxicity.stable(rows.mapInArrow(toxicity._count_strings, "s string, tox long, ordy long")
                              .groupBy("s").sum("tox", "ordy").toDF("s", "tox", "ordy"))
    seen, backs = (toxicity.stable(x) for x in toxicity._ratios(strings))
    model = toxicity.Model(toxicity._table(seen, 0), toxicity._table(backs, 1))
    by, back = ({r.s: r.llr for r in x.collect()} for x in (seen, backs))
    assert len(by) > 100_000
    for t in [r.text for r in rows.limit(3).collect()] + [text(400), "\U0001F600 é", ""]:
        marked = "\n" * 4 + t
        want = [by.get(marked[i:i + 5], back.get(marked[i:i + 4], 0.0)) for i in range(len(t))]
        assert abs(model.differences([t])[0, 0] - (np.mean(want) if want else 0)) < 1e-6


def test_toxicity_counts_every_training_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 60)       # fewer than the fold has
    plain = "the river runs under a stone bridge every morning"
    docs = [(i, plain + (" zvark" if i % 6 == 0 else "") + (" qqwxk" if i % 6 == 0 and zlib.crc32(str(i).encode()) % 5 == 4 else ""))
            for i in range(600)]
    model = toxicity.fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    only, unseen = model.differences(["qqwxk", "jjfpd"])[:, 1]
    assert only > unseen + 0.1 and model.weights is not None


def test_shards_of_huge_rows(spark):
    """Sizes beyond what a rounded quotient could tell apart."""
    docs = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(23)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 7, overhead=10 ** 13).orderBy("id").collect()
    total, before = sum(r["size"] for r in rows), 0
    for r in rows:
        assert r.shard == (2 * before + r["size"]) * 7 // (2 * total)
        before += r["size"]


def test_keep_one_of_rows_that_share_an_id(spark):
    q, w = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(3, q), (5, w), (5, q), (7, w), (7, w), (None, "alone here")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(3, q), (5, w), (None, "alone here")])
    clash = spark.createDataFrame([(1, q, 9, "a"), (2, q, 8, "b")], "doc_id long, text string, fp int, keep string")
    assert [tuple(r) for r in simhash.keep_one(clash).collect()] == [(1, q, 9, "a")]


def test_url_columns_that_clash(spark):
    df = spark.createDataFrame([("http://casino.example.net/" + "a/" * 50_000, "h", 1, 2)], "url string, URL_HOST string, u int, best int")
    r = urlfilter.judge_urls(df).first()
    assert (r.url_host, r.url_verdict, r.u, r.best) == ("casino.example.net", "block", 1, 2)
    for action, pattern, tokens in urlfilter.PATTERN_RULES:
        assert re.search(pattern, "http://" + "-".join(tokens) + ".net/") and all(t in pattern for t in tokens)
    with pytest.raises(ValueError):
        urlfilter.host_words("block", "no.dot")


def test_html_side_marks_and_broken_quotes():
    read = lambda body: html_template.extract(body, None)[0]
    assert read('<article><p class="advert">Buy now</p><p>Keep</p><ul><li class="comment">First!</li><li>two</li></ul>'
                'x <i class="ad">buy</i> y</article>') == "Keep\n\ntwo\n\nx y"
    assert read('<article><p class="ad">Buy<p>Keep<h2 class="section-header">Head</h2><div class="share-price">12</div></article>') \
        == "Keep\n\nHead\n\n12"
    assert read('<div class="cookie-banner">c</div><div class="site-header">h</div>t') == "t"
    assert read('<article>a <a title="x>1 < 2</a> b</article>') == "a 1 < 2 b"
    assert read('<table><tr><td class="ad">x<td>y</table>') == "y"


def test_html_vectors_and_classes_against_brute_force(spark):
    """Occurrence vectors from sums of hashes group tokens as the vectors themselves do."""
    rng = np.random.default_rng(4)
    pages = [(i, "h", "<html><body><div>same words</div>" + "".join(f"<p>w{k}</p>" for k in rng.permutation(8)[:rng.integers(3, 8)])
              + "<b>twice</b><b>twice</b>" * int(i % 2) + "</body></html>") for i in range(20)]
    df = spark.createDataFrame(pages + pages[:1], "page long, host string, html string").distinct()
    row = html_template.deduce_templates(df.select("host", "page", "html")).first()
    vectors = {}
    for i, _, text in pages:
        for t, n in Counter(html_template.page_tokens(text)).items():
            vectors.setdefault(t, {})[i] = n
    frequent = {t: v for t, v in vectors.items() if len(v) >= max(html_template.MIN_PAGES, html_template.MIN_SHARE * len(pages))}
    got = {t.token: t for t in row.tokens if t.pages >= max(html_template.MIN_PAGES, html_template.MIN_SHARE * row.n_pages)}
    assert row.n_pages == 20 and set(got) == set(frequent) and all(got[t].pages == len(v) for t, v in frequent.items())
    classes = lambda of: {frozenset(t for t in of if of[t] == of[u]) for u in of}
    assert classes({t: str(sorted(v.items())) for t, v in frequent.items()}) == classes({t: got[t].vector for t in got})
    once = str(sorted({i: 1 for i in range(20)}.items()))
    assert {t for t in got if got[t].vector == row.spine} == {t for t, v in frequent.items() if str(sorted(v.items())) == once}


def test_html_templates_by_shuffle_equal_broadcast(spark, monkeypatch):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i=i, nav="<li>n</li>" * (i % 3 + 1))) for i in range(12)]
    df = spark.createDataFrame(pages * 2, "page_id long, url string, html string")
    whole = Counter(map(tuple, html_template.extract_pages(df).collect()))
    monkeypatch.setattr(html_template, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, html_template.extract_pages(df).collect())) == whole


def test_inclusion_of_a_long_text(spark):
    df = spark.createDataFrame([(1, "segmentation of several words " * 800)], "doc_id long, text string")
    for r in sps.sample_segmentations(df, P.path("piece_bpe_32k.model"), k=2).collect():
        assert r.log_prob < -700 and r.inclusion == 0 and r.log_inclusion == pytest.approx(r.log_prob - r.kappa)


def test_units_and_lattices_by_whole_slices():
    vocab = sps.Vocabulary(P.path("piece_bpe_32k.model"))
    texts = ["", " ", "two words", "  a  b ", "▁x ▁", "a\tb\nc d", "x", "漢字 ééé 😀", "two words"]
    units, numbers, count = sps.numbered_units(sps.pa.array(texts))
    assert [units[i] for i in numbers.tolist()] == [u for t in texts if t for u in sps.units_of(t)]
    assert count.tolist() == [len(sps.units_of(t)) if t else 0 for t in texts] and len(units) == len(set(units))
    lat = sps.Lattices(units, vocab)
    for unit, last in zip(units, lat.last.tolist()):
        begin = last + 1 - len(unit)
        for stop in range(1, len(unit) + 1):
            edges = slice(*lat.lo[begin + stop - 1:begin + stop + 1].tolist())
            want = [(a, vocab.id[unit[a:stop]] if unit[a:stop] in vocab.id else -ord(unit[a]) - 1)
                    for a in range(stop - 1, -1, -1) if unit[a:stop] in vocab.id or a == stop - 1]
            assert [(s - begin + 1 if s >= 0 else 0, p) for s, p in zip(lat.src[edges].tolist(), lat.piece[edges].tolist())] == want


def test_lattice_looks_up_no_more_than_beginnings_of_pieces(monkeypatch):
    vocab, cells = sps.Vocabulary(P.path("piece_bpe_32k.model")), []
    find = vocab.find
    monkeypatch.setattr(vocab, "find", lambda h: cells.append(len(h)) or find(h))
    units = ["▁" + "\x01" * 200, "▁" + "q" * 200]
    sps.Lattices(units, vocab)
    begins = {p[:n] for p in vocab.id for n in range(1, len(p))}
    assert sum(cells) == sum(1 for u in units for a in range(len(u)) for n in range(1, len(u) - a + 1)
                             if n == 1 or n <= vocab.longest and u[a:a + n - 1] in begins)


def test_lattices_kept_up_to_memory(monkeypatch):
    monkeypatch.setattr(sps, "MEMORY", 60)
    few, whole = sps.Vocabulary(P.path("piece_bpe_32k.model")), sps.Vocabulary(P.path("piece_bpe_32k.model"))
    slices_ = [["one two", "three"], ["four five two", ""], ["six seven one"], ["four one"]]
    once = iter(sps.sample_slice([t for s in slices_ for t in s], sps.row_keys(list(range(6)), 1), whole, 2)[1])
    at = 0
    for texts in slices_:
        _, found, _ = sps.sample_slice(texts, sps.row_keys(list(range(at, at + len(texts))), 1), few, 2)
        assert [[f[2:] for f in fs] for fs in found] == [[f[2:] for f in next(once)] for _ in texts]
        at += len(texts)
    assert len(few.known.src) <= 60 < len(whole.known.src) or len(few.number) < len(whole.number)


def test_words_are_looked_up_once_a_slice():
    class Counting(dict):
        asked = 0

        def get(self, *a):
            Counting.asked += 1
            return super().get(*a)
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    whole, enc = Tokenizer.from_file(path), tokenids.WordEncoder(path, memory=8)
    texts = ["the the the cat's  the ", "", "  the x́ <b>", "a\x1dthe <|endoftext|>", "ÀÉ12 the cat", "the\n"]
    for some in (texts, texts[::-1], ["漢字 kanji " * 3] * 4, texts):                     # memory runs out between
        enc.index = Counting(enc.index)
        Counting.asked = 0
        ids, lengths = enc.encode(tokenids.pa.array(some), 2)
        assert Counting.asked <= len({w for t in some for w in t.split()})
        want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    ids, lengths = enc.encode(tokenids.pa.array([], tokenids.pa.string()), 2)
    assert not len(ids) and not len(lengths)
