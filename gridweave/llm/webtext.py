"""Main-text extraction from web pages; a host's boilerplate is found by fixed-depth suffix hashes.

Pages are cut into blocks in page order, each in one of three zones: inside the article (and nothing
like a menu, advert or form in it), chrome (menus, headers, footers ...), or open (neither). A page
with an article gives its article blocks. On pages without one the open blocks are candidates: the
token streams of the open blocks of all of a host's pages, with an article or without, are compared by their suffixes, suffixes that agree in `depth` tokens and
stand on most of the host's distinct pages (copies count once) mark boilerplate, and blocks keep the other runs.

Only whether two suffixes agree in `depth` tokens matters, so instead of a sorted suffix array
suffixes are keyed by (host, hash of `depth` tokens) and equal keys meet in a shuffle. So no host's
pages have to meet in one task, and common runs are summed before the shuffle.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .urls import host

DEPTH = 8
BATCH_ROWS = 200

# HTML element names by the part they play.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset head".split())
MAIN = frozenset("article main".split())
#: Elements that a paragraph's end tag, or the next block, closes when they were left open.
INLINE_END = frozenset("p li dd dt td th tr option".split())
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?"
    r"|sidebar|side|widget|related|recommend\w*|share|sharing|social|comments?|disqus|replies|respond|footer|header|masthead|toolbar|pagination|pager|skip|search)(?=$|[\s_-])"
)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[_-](?:body|content|text))?(?=$|\s)")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}
# ARIA roles of chrome.
_CHROME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _zone(name: str, attr: str, now: int) -> int:
    """0 open, 1 article, 2 chrome, of what stands in an element inside zone `now`."""
    if now == 2:
        return 2
    if name in CHROME:
        return 1 if name == "header" and now == 1 else 2
    if attr:
        words, role, hidden = [], "", False
        for k, a, b, c in _ATTR.findall(attr):
            k, v = k.lower(), (a or b or c).lower()
            if k == "role":
                role = v
            elif k == "hidden" or k == "aria-hidden":
                hidden = hidden or k == "hidden" or v == "true"
            else:
                words.append(v)
        names = " ".join(words)
        if hidden or role in _CHROME_ROLE or (name not in ("body", "html", "article", "main") and _CHROME_NAME.search(names)):
            return 2
        if role in ("main", "article") or _MAIN_NAME.search(names):
            return 1
    return 1 if name in MAIN else now


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page, in page order, without empty ones."""
    out: list[tuple[int, str]] = []
    have: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = at = 0

    def flush():
        if have:
            text = _SPACE.sub(" ", "".join(have)).strip()
            have.clear()
            if text:
                out.append((zone, text))

    def close(n):
        nonlocal zone
        del stack[n:]
        zone = stack[-1][1] if stack else 0

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            have.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            have.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            have.append(m["cdata"])
            continue
        if m["name"] is None:
            continue
        name, attr = m["name"].lower(), m["attr"]
        if m["end"]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i][0] in BLOCK:
                    break  # a stray inline end tag closes nothing beyond its block
                if name in INLINE_END and stack[i][0] not in INLINE_END and stack[i][0] in BLOCK:
                    break
            continue
        if name in RAW:
            if not attr.rstrip().endswith("/"):
                e = _RAW_END[name].search(page, at)
                at = page.find(">", e.start()) + 1 if e else size
                at = at or size
            continue
        if name in BLOCK:
            flush()
            if stack and stack[-1][0] in INLINE_END and (name == stack[-1][0] or stack[-1][0] == "p"):
                close(len(stack) - 1)
        if name in VOID or attr.rstrip().endswith("/"):
            continue
        z = _zone(name, attr, zone)
        if z != zone and name not in BLOCK:
            flush()
        if name in BLOCK or z != zone:
            stack.append((name, z))
            zone = z
    flush()
    return out


def _cutter(batches):
    """(id, url, h, html) -> article text (empty: no article) and the open blocks."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            p = b.slice(at, BATCH_ROWS)
            text, rest = [], []
            for page in p.column("html").to_pylist():
                found = blocks(page) if page else []
                main = [t for z, t in found if z == 1]
                text.append("\n".join(main))
                rest.append([t for z, t in found if z == 0])
            yield pa.RecordBatch.from_arrays([p.column("id"), p.column("url"), p.column("h"), pa.array(text, pa.string()), pa.array(rest, pa.list_(pa.string()))], names=["id", "url", "h", "text", "rest"])


def without_runs(rest: list[str], common: set[int], depth: int) -> str:
    """The blocks without the tokens that `common` runs of `depth` tokens cover, starting at these token numbers."""
    out, at = [], 0
    cover = np.zeros(sum(len(t.split(" ")) for t in rest) + 1, bool)
    for s in common:
        cover[s : s + depth] = True
    for t in rest:
        words = t.split(" ")
        keep = [w for i, w in enumerate(words) if not cover[at + i]]
        at += len(words)
        if keep:
            out.append(" ".join(keep))
    return "\n".join(out)


def _cleaner(depth: int):
    def run(batches):
        for b in batches:
            text = [t if not r else without_runs(r, set(g or ()), depth) for t, r, g in zip(b.column("text").to_pylist(), b.column("rest").to_pylist(), b.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string())], names=["id", "url", "text"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = DEPTH) -> DataFrame:
    """One row a page: id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
    joined by newlines in page order. On pages with an article (article, main, or a class that says
    so) it is kept whole, except for chrome in it; on others, runs of `depth` tokens or more that
    stand on two or more, and on over half, of the host's pages of distinct blocks are removed (what stands in
    articles or chrome does not count, nor do pages of nothing else). Null or empty html, or nothing but chrome: an
    empty text. A null URL is a host of its own (no name). Rows that repeat a page (id, URL and
    html) are one page and get the same text. Other columns are ignored; an empty table gives no rows.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("h"), F.col(html_col).alias("html"))
    kind = dict(p.dtypes)["id"]
    cut = materialize(p.mapInArrow(_cutter, f"id {kind}, url string, h string, text string, rest array<string>"), "blocks")
    bare = (F.col("text") == "") & (F.size("rest") > 0)
    if not cut.where(bare).isEmpty():
        every = cut.where(F.size("rest") > 0).withColumn("h", F.coalesce("h", F.lit("\0"))).withColumn("k", F.xxhash64("h", "text", "rest"))
        open_pages = every.where(bare)
        every = hot_join(every, open_pages.select("h").distinct(), "h")  # other hosts have nothing to remove
        o = every.select("h", "k", bare.alias("bare"), F.split(F.array_join("rest", " "), " ").alias("w")).distinct()
        runs = F.transform(F.when(F.size("w") >= depth, F.sequence(F.lit(0), F.size("w") - depth)).otherwise(F.array().cast("array<int>")), lambda i: F.sha2(F.array_join(F.slice("w", i + 1, depth), " ").cast("binary"), 256))
        s = materialize(o.select("h", "k", "bare", F.posexplode(runs).alias("at", "run")).select("h", "k", "bare", "at", F.md5(F.concat_ws(" ", "h", "run").cast("binary")).alias("key")), "suffixes")
        sizes = every.select("h", "k").distinct().groupBy("h").agg(F.count("*").alias("n"))
        common = s.select("h", "key", "k").distinct().groupBy("h", "key").agg(F.count("*").alias("on")).where("on > 1")
        common = hot_join(common, sizes, "h").where("2 * on > n").select("key")
        gone = hot_join(s.where("bare"), common, "key").groupBy("k").agg(F.collect_set("at").alias("gone"))
        rest = hot_join(open_pages, gone, "k", "left").select("id", "url", "text", "rest", "gone")
        closed = cut.where(~bare).select("id", "url", "text")
        cut = closed.unionByName(rest.mapInArrow(_cleaner(depth), f"id {kind}, url string, text string"))
    return cut.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
