"""HTML extraction by equivalence-class template deduction.

Tokens are tags (name and class) and words, told apart by the path of elements they stand in. Over
the pages of a host each token has an occurrence vector, its count on every page. Tokens of one
vector form an equivalence class; a class is valid if it is frequent (on at least ``MIN_SHARE`` of
the host's pages and on ``MIN_PAGES``; fewer cannot tell a template from chance) and its tokens keep
one order: of a class that occurs once on a page, the tokens in the longest run that keeps it, and of
a repeated class all, where it repeats as a whole and each repetition nests into one slot of the
spine. The spine is the root class, once on every page.

A text block (what stands between two block tags) whose words all belong to valid classes is
template and dropped, wherever it stands; the others are the content of the slots. A template word
in a block that also varies ("Chapter 7") is kept with it. Of the slots' blocks those inside an
article (or main) part and under no side part (`SIDE`) are the main text; on pages without text in
such a part, all that are under no side part. A page of which nothing would be left (copies of one
page fill a host) keeps its template text.

At scale a vector is never built: its fingerprint is the sum over pages of a hash of (page, count),
which adds up in partial aggregation, so a host with a third of all pages costs one row per task and
token. Rare words are kept out of the shuffle without losing a frequent one: a token on half of a
host's pages is on half of them in at least one task, so tasks first name their locally frequent
tokens, and a second pass counts just these everywhere.

The text of a slot: character references decoded, white space runs one space, trimmed, blocks
joined by two line feeds. Nothing else is dropped.

Defined results: null html is empty and gives an empty text; a null url belongs to the empty host;
equal page ids are told apart by their html; a page that does not follow its host's template (or a
host whose pages share none, or too few pages) is read by its own tags under the same container
rules; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import col, query, stable, table
from tablelens.llm.urlfilter import host_path

MIN_SHARE = 0.5
MIN_PAGES = 3
#: Template tables of at most so many bytes are broadcast; beyond, pages are joined to them by shuffle.
BROADCAST_BYTES = 32_000_000
MAIN = {"article", "main"}
#: Containers of everything: their attributes name the page's kind or parts, and never make them a side part.
WHOLE = MAIN | {"html", "body"}
#: Element names, and names in class, id or role attributes, that mark a part beside the main text. A compound name
#: marks one if all its words are side words or say nothing but place and shape (`PLAIN_WORDS`): "cookie-banner" and
#: "site-header" do, "share-price" and "section-header" do not.
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title",
             "button", "select", "textarea", "iframe", "svg", "object", "menu", "dialog"}
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "banner", "nav", "navbar", "menu",
              "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside", "notice", "notices", "cookie",
              "cookies", "consent", "comment", "comments", "reply", "replies", "respond", "share", "sharing", "social",
              "related", "newsletter", "subscribe", "popup", "modal", "login", "search", "navigation", "complementary",
              "contentinfo", "widget"}
PLAIN_WORDS = {"site", "page", "top", "bottom", "left", "right", "box", "bar", "wrap", "wrapper", "container", "list", "area",
               "block", "unit", "slot", "inner", "outer", "global", "main", "primary", "secondary", "item", "links", "form", "holder"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend",
         "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul", "caption", "option"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements whose end is often left out. They do not nest, unless they are side parts themselves: then they last to their
#: end tag, that of an element around them, or an opening tag that ends them.
LOOSE = {"p", "li", "b", "i", "td", "tr", "th", "dt", "dd", "option"}
ENDS = {"p": BLOCK, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"},
        "dd": {"dt", "dd"}, "option": {"option"}, "b": set(), "i": set()}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S | re.I)                # a quote without its end: up to the next >
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Piece:
    """One token of a page: a tag (``name`` set) or a run of text."""
    __slots__ = ("key", "name", "closing", "side", "text")

    def __init__(self, key, name="", closing=False, side=False, text=""):
        self.key, self.name, self.closing, self.side, self.text = key, name, closing, side, text


def _side_name(name: str) -> bool:
    words = _NAME.findall(name)
    return any(w in SIDE_WORDS for w in words) and all(w in SIDE_WORDS or w in PLAIN_WORDS for w in words)


def pieces(page: str) -> list[Piece]:
    """Tags and text runs in order; comments, scripts and styles are left out."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(Piece("", text=page[at:m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        end, inside = (m[2], m[4]) if m[3] else (m[5], m[7])
        side, mark = name in SIDE_TAGS, ""
        if inside and not end:
            values = [(a[1] or a[2] or a[3]).lower() for a in _ATTR.findall(inside)]
            side = side or name not in WHOLE and any(_side_name(n) for v in values for n in v.split())
            mark = " " + " ".join(values) if values else ""
        out.append(Piece(f"<{end}{name}{mark}>", name, bool(end), side))
    if at < len(page):
        out.append(Piece("", text=page[at:]))
    return out


@lru_cache(50_000)
def _step(path: str, own: str) -> str:
    """The path inside an element: a hash of the path around it and its tag without digits."""
    return f"{zlib.crc32(_DIGITS.sub('', own).encode('utf-8', 'replace'), int(path, 16)):x}"


def walk(parts: list[Piece]) -> tuple[list[tuple[bool, bool]], list[str]]:
    """For each piece: (inside a main part, inside a side part), and the path of elements it stands in, as a hash
    (an opening tag stands outside its element, its closing tag inside). Unclosed inline marks do not nest."""
    where, paths, stack = [], [], []
    main = side = 0
    path = "0"
    for p in parts:
        if p.name and not p.closing and stack and stack[-1][0] in LOOSE and p.name in ENDS[stack[-1][0]]:
            _, m, s, path = stack.pop()                           # a side part without its end tag
            main, side = main - m, side - s
        paths.append(path)
        if p.name and not p.closing and p.name not in EMPTY and (p.side or p.name not in LOOSE):
            stack.append((p.name, p.name in MAIN, p.side, path))
            main, side = main + (p.name in MAIN), side + p.side
            path = _step(path, p.name if p.name in WHOLE else p.key)
        elif p.closing and any(s[0] == p.name for s in stack):
            while True:
                name, m, s, path = stack.pop()
                main, side = main - m, side - s
                if name == p.name:
                    break
        where.append((main > 0, side > 0))
    return where, paths


def token_keys(parts: list[Piece], paths: list[str]) -> list[list[str]]:
    """The tokens of each piece: a tag, or the words of a run of text, each with its path."""
    keys: list[list[str]] = []
    for p, path in zip(parts, paths):
        if p.name:
            keys.append([path + p.key])
        else:
            path += " "
            keys.append([path + w for w in (html.unescape(p.text) if "&" in p.text else p.text).split()])
    return keys


def page_tokens(page: str) -> list[str]:
    parts = pieces(page)
    return [k for keys in token_keys(parts, walk(parts)[1]) for k in keys]


#: Steps of a token's first place in a page (a whole number, so that sums do not depend on their order).
PLACES = 1_000_000


def token_stats(page: str, wanted: set[str]) -> dict[str, tuple[int, int]]:
    """Count and first place (0 to PLACES) of the wanted tokens of a page."""
    keys = page_tokens(page)
    counts: dict[str, int] = {}
    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        if k in wanted:
            if k in counts:
                counts[k] += 1
            else:
                counts[k], first[k] = 1, i
    return {k: (n, first[k] * PLACES // len(keys)) for k, n in counts.items()}


def _hash(page: int, count: int) -> int:
    """A 40-bit hash of (page, count); sums of it are kept as decimals and never wrap."""
    x = (page * 0x9E3779B97F4A7C15 + count * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) >> 24


STATS = "host string, token string, pages long, vector decimal(38,0), place long"
STATS_ARROW = pa.schema([("host", pa.string()), ("token", pa.string()), ("pages", pa.int64()),
                         ("vector", pa.decimal128(38, 0)), ("place", pa.int64())])
#: A task hands over what it holds beyond this many (host, token) pairs.
HELD = 2_000_000


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass, per task: ``host, token`` of the tokens on at least ``MIN_SHARE`` of the task's own pages of a host."""
    held: dict[str, Counter] = {}
    pages: Counter = Counter()

    def named():
        rows = [(h, t) for h, c in held.items() for t, n in c.items() if n >= MIN_SHARE * pages[h]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], []))],
                                          ["host", "token"])

    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            held.setdefault(host, Counter()).update(set(page_tokens(text)))
            pages[host] += 1
        if sum(map(len, held.values())) > HELD:
            # one task may see many hosts: hand over; a token frequent on the whole is frequent in some part
            yield named()
            held, pages = {}, Counter()
    yield named()


def _by_host(batch: pa.RecordBatch, column: str, table, made: dict, make) -> list:
    """``make`` of each row's host entry, from the broadcast table or, without one, from the row itself; kept per host."""
    hosts = batch.column("host").to_pylist()
    for i, h in enumerate(hosts):
        if h not in made:
            if len(made) > 1000:
                made.clear()
            made[h] = make(table.value.get(h) if table else batch.column(column)[i].as_py())
        hosts[i] = made[h]
    return hosts


def _count(table):
    """Second pass, per task: pages, vector fingerprint and summed place of the named tokens, whatever their
    frequency; the token '' stands for the host's pages themselves (once on each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        made: dict = {}

        def counted():
            rows = [(h, t, n, Decimal(v), place) for (h, t), (n, v, place) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                zip(*rows) if rows else [[]] * 5, STATS_ARROW)], schema=STATS_ARROW)

        for batch in batches:
            wanted = _by_host(batch, "candidates", table, made, lambda c: set(c or ()))
            for names, host, page, text in zip(wanted, *(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                for t, (n, place) in [*token_stats(text, names).items(), ("", (1, 0))]:
                    x = held.setdefault((host, t), [0, 0, 0])
                    x[0] += 1
                    x[1] += _hash(page, n)
                    x[2] += place
            if len(held) > HELD:
                yield counted()
                held = {}
        yield counted()
    return run


def _small(df: DataFrame, size) -> bool:
    """Whether ``df``, of so many bytes a row, may be held by the driver and every Python worker."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``host, n_pages, tokens`` from ``pages(host, page, html)``: the frequent tokens with their vectors and places."""
    named = stable(pages.select("host", "html").mapInArrow(_frequent, "host string, token string")
                   .groupBy("host").agg(F.collect_set("token").alias("candidates")))
    size = F.octet_length("host") + F.aggregate("candidates", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 60)
    if _small(named, size):
        table = pages.sparkSession.sparkContext.broadcast({r.host: r.candidates for r in named.collect()})
        rows = pages.select("host", "page", "html")
    else:
        table, rows = None, pages.join(named, "host").select("host", "page", "html", "candidates")
    exact = (rows.mapInArrow(_count(table), STATS).groupBy("host", "token")
             .agg(F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.sum("place").alias("place")))
    return stable(exact.groupBy("host").agg(
        F.max(F.when(F.col("token") == "", F.col("pages"))).alias("n_pages"),
        F.max(F.when(F.col("token") == "", F.col("vector"))).cast("string").alias("spine"),
        F.collect_list(F.when(F.col("token") != "", F.struct(
            "token", "pages", F.col("vector").cast("string").alias("vector"),
            (F.col("place") / F.col("pages")).alias("place")))).alias("tokens")))


def _in_order(order: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails, ends, before = [], [], []
    for i, k in enumerate(order):
        at = bisect_left(tails, k)
        before.append(ends[at - 1] if at else -1)
        tails[at:at + 1], ends[at:at + 1] = [k], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


class Template:
    """The valid classes of a host, each in order; class 0 is the spine."""

    def __init__(self, n_pages: int, spine: str, tokens: list[dict]):
        classes: dict[str, list[dict]] = {}
        for t in tokens:
            if t["pages"] >= max(MIN_PAGES, MIN_SHARE * n_pages):
                classes.setdefault(t["vector"], []).append(t)
        # the vector of "once on every page" is that of the page count itself
        valid = [classes.pop(spine, []), *(c for c in classes.values() if len(c) > 1)]
        self.sizes = [len(c) for c in valid]
        self.member = {t["token"]: (c, k) for c, ts in enumerate(valid)
                       for k, t in enumerate(sorted(ts, key=lambda t: (t["place"], t["token"])))}

    def fixed(self, tokens: list[str]) -> bytearray:
        """For each token of a page whether it belongs to a class that is valid there."""
        seen: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(tokens):
            m = self.member.get(t)
            if m:
                seen.setdefault(m[0], []).append((i, m[1]))
        flags, spine = bytearray(len(tokens)), []
        for c in sorted(seen):
            at, order = [i for i, _ in seen[c]], [k for _, k in seen[c]]
            size = self.sizes[c]
            if len(set(order)) == len(order):
                took = [at[j] for j in _in_order(order)]
            elif order == list(range(size)) * (len(order) // size):
                took = [i for j in range(0, len(at), size)
                        if bisect_left(spine, at[j]) == bisect_left(spine, at[j + size - 1]) for i in at[j:j + size]]
            else:
                continue
            spine = took if c == 0 else spine
            for i in took:
                flags[i] = 1
        return flags


def _blocks(parts: list[Piece], fixed: list[bool], places: list[int]) -> list[tuple[str, bool, int]]:
    """Text blocks of the pieces at ``places``: text, whether all its words are template, place of its first text."""
    blocks, run, same, first = [], [], True, -1

    def close():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append((text, same, first))

    for i in places:
        p = parts[i]
        if not p.name:
            run.append(p.text)
            if not p.text.isspace():
                same, first = same and fixed[i], i if first < 0 else first
        elif p.name in BLOCK:
            close()
            run, same, first = [], True, -1
        elif p.name == "br":
            run.append(" ")
    close()
    return blocks


def extract(page: str, template: Template | None) -> tuple[str, int]:
    """Main text of a page and the number of template slots it was read from (0: by its own tags)."""
    parts = pieces(page)
    where, paths = walk(parts)
    fixed, marks = [False] * len(parts), []
    if template and template.member:
        keys = token_keys(parts, paths)
        flags, at = template.fixed([k for ks in keys for k in ks]), 0
        for i, ks in enumerate(keys):
            fixed[i] = all(flags[at:at + len(ks)])
            at += len(ks)
            if parts[i].name and fixed[i]:
                marks.append(i)
    main = any(m and not s and p.text and not p.text.isspace() for (m, s), p in zip(where, parts))
    blocks = _blocks(parts, fixed, [i for i, (m, s) in enumerate(where) if not s and (m or not main)])
    kept = [b for b in blocks if not b[1]] or blocks
    return "\n\n".join(b[0] for b in kept), len({bisect_right(marks, b[2]) for b in kept}) if marks else 0


OUT = "page_id long, url string, text string, n_chars long, n_slots long"


def extract_pages(df: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_slots`` for every row; see the module text."""
    url = col(url_col).cast("string")
    pages = df.select(col(page_col).cast("long").alias("page_id"), url.alias("url"), host_path(url)[0].alias("host"),
                      F.coalesce(col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = pages.select("host", F.xxhash64("page_id", "html").bitwiseAND(F.lit((1 << 48) - 1)).alias("page"), "html")
    templates = deduce_templates(keyed)
    size = F.octet_length("host") + F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t["token"]) + 200)
    if _small(templates, size):
        entries = {r.host: (r.n_pages, r.spine, [t.asDict() for t in r.tokens]) for r in templates.collect()}
        table, joined = df.sparkSession.sparkContext.broadcast(entries), pages
    else:
        entry = F.struct("n_pages", "spine", "tokens").alias("entry")
        table, joined = None, pages.join(templates.select("host", entry), "host", "left").select(
            "page_id", "url", "host", "html", "entry")

    def template(entry) -> Template | None:
        if not entry:
            return None
        n_pages, spine, tokens = entry.values() if isinstance(entry, dict) else entry
        return Template(n_pages or 0, spine, tokens or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            known = _by_host(batch, "entry", table, made, template)
            texts = [extract(page, t) for page, t in zip(batch.column("html").to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in texts], pa.string()),
                pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([k for _, k in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_slots"])
    return joined.mapInArrow(run, OUT)


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
