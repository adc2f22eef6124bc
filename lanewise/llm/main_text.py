"""Main text of web pages: a suffix array over the token streams of each host, with markup as evidence.

A page is read once into blocks of text. Text of scripts, styles, comments and other hidden markup is no block. Blocks in
navigation, footers, sidebars, forms, notices, adverts and reader comments are marked as in a zone, and blocks of the page's article
as such: those in an ``article`` or ``main`` element, or else in elements named as an article, if they hold half of the page's
text. Names of class and id count whole: each part of a name has to be a word for boilerplate or for structure.

The words of all blocks of a host's pages are laid end to end and their suffixes ranked by prefix doubling up to RUN words.
Suffixes of equal rank that begin in distinct pages (pages of equal html are one) are repeated passages. Blocks in a zone go.

* On pages without an article the words that a passage of two pages covers go, and the unique runs stay.
* On pages with one, the text outside of it goes. Inside, passages go that stand in the articles of TEMPLATE_PAGES pages at least
  and of half of all the host's articles: the site's template. If they cover more than half of an article it is a copy, published
  several times, and stays whole.

No result depends on how a host is cut. For pages without an article, a host beyond PART_BYTES is worked on in parts of that size,
each with its own array, and the intervals of all arrays are merged by a 64-bit hash of their RUN words. For articles, a passage on
half of a host's pages is on half of the pages of one of its parts at least, so few passages (known by winnowed hashes of FEW
words, of which each passage has one) come out of the parts as candidates; those are then counted over the whole host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from ._store import MOST_BROADCAST, near, pinned, shipped, written
from ._text import grams, map_text, winnow, words

#: Words of a repeated passage at least, words of the hashes that find it, and bytes of text that one array is built for.
RUN, FEW = 8, 4
PART_BYTES = 1 << 20
#: Bytes of articles in a part in which candidates for a template are counted.
TEMPLATE_BYTES = 1 << 18
#: A template's passages are in the articles of so many pages, and of at least half of all.
TEMPLATE_PAGES = 3
BLOCKS = pa.list_(pa.struct([("body", pa.string()), ("zone", pa.bool_()), ("article", pa.bool_())]))

_tag = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
_names = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_body = re.compile(r"""(?:^|\s)(?:role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody)(?=["'\s/]|$)""", re.I)
_hidden = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
RAW = frozenset("script style noscript template textarea title svg iframe object annotation annotation-xml".split())
OUTSIDE = frozenset("nav footer aside form menu dialog select button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr img math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle".split()
)
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words for boilerplate in names of class, id and role; words for structure that may stand beside them; names of the article.
ZONES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle alert announcement banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notification pager pagination paywall popup promo promoted recommended related replies search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
STRUCTURE = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content entries entry float footer form "
    "global group header icon icons inline inner item items label left link links list main media message outer page panel post posts "
    "primary recent right row secondary section site slot small sticky story text title top unit wrap wrapper".split()
)
ARTICLES = frozenset("article article-body article-content content entry-content main main-content post-body post-content story story-body".split())


@lru_cache(1 << 14)
def _named(value: str) -> tuple[bool, bool, bool]:
    """Whether names mark a zone, a header, an article."""
    zone = header = article = False
    for name in value.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
        if all(x in ZONES or x in STRUCTURE for x in parts):
            zone = zone or any(x in ZONES for x in parts)
            header = header or "header" in parts
        article = article or name in ARTICLES
    return zone, header, article


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, whether in a boilerplate zone, whether in the article) of each block, in page order; white space is one space.

    An element without an end tag whose content is no text (a script, say), a comment or a declaration without an end, and so on,
    take the rest of the page, as in browsers. Unmatched end tags are passed over, in constant time.
    """
    out: list[tuple[str, bool, int]] = []  # text, zone, anchor: 0 none, 1 by name, 2 by element
    text: list[str] = []
    # Open elements: name, zone, anchor, place of the p that a block inside would close (-1: none), scope.
    stack: list[tuple[str, bool, int, int, int]] = []
    open_: Counter[tuple[int, str] | str] = Counter()
    zone, anchor, p_at, scope, scopes = False, 0, -1, 0, 0

    def flush() -> None:
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                out.append((body, zone, anchor))
            text.clear()

    def cut(first: int) -> None:
        """Closes all elements from a place in the stack on."""
        nonlocal p_at, scope
        for name, _, _, _, inside in stack[first:]:
            open_[name] -= 1
            open_[inside, name] -= 1
        del stack[first:]
        p_at = stack[-1][3] if stack else -1
        scope = 0
        if stack:
            scope = stack[-1][4] if stack[-1][0] not in ("article", "main", "body") else opened[len(stack) - 1]

    opened: dict[int, int] = {}  # the scope inside an element that begins one, by its place in the stack
    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less != at:
            text.append(page[at : less if less >= 0 else end])
            at = less if less >= 0 else end
            continue
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            at = close + 3 if close >= 0 else end
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            close = page.find(">", at)
            at = close + 1 if close >= 0 else end
            continue
        m = _tag.match(page, at)
        if m is None:
            text.append("<")
            at += 1
            continue
        at = m.end()
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if name == "p":
                flush()
            # An inline element or p ends inside the article it is in only.
            if open_[(scope, name) if name in INLINE or name == "p" else name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                outer = stack[i - 1][1:3] if i else (False, 0)
                if outer != (zone, anchor) or name not in INLINE:
                    flush()
                cut(i)
                zone, anchor = outer
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if name not in INLINE:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P and p_at >= 0:
            cut(p_at)
            zone, anchor = stack[-1][1:3] if stack else (False, 0)
        zoned, header, named = False, False, False
        inner = 2 if name in ("article", "main") else 0
        hidden = False
        if attributes:
            hidden = bool(_hidden.search(attributes))
            if "=" in attributes:
                names = " ".join(x.strip("\"'") for x in _names.findall(attributes))
                if names:
                    zoned, header, named = _named(names)
                inner = 2 if inner or _body.search(attributes) else int(named)
        if name in ("html", "body", "main"):
            zoned = header = False
        bad = hidden or zoned or name in OUTSIDE or ((name == "header" or header) and not anchor)
        inside = (zone or bad, max(anchor, inner))
        if inside != (zone, anchor):
            flush()
        zone, anchor = inside
        p_at = len(stack) if name == "p" else p_at if name in INLINE else -1
        stack.append((name, zone, anchor, p_at, scope))
        open_[name] += 1
        open_[scope, name] += 1
        if name in ("article", "main", "body"):
            scopes += 1
            scope = opened[len(stack) - 1] = scopes
    flush()
    return _anchored_by(out)


def _anchored_by(out: list[tuple[str, bool, int]]) -> list[tuple[str, bool, bool]]:
    least = 2
    if not any(anchor == 2 and not zone for _, zone, anchor in out):
        named, whole = (sum(len(body) for body, zone, anchor in out if not zone and anchor >= x) for x in (1, 0))
        least = 1 if 2 * named >= whole else 3
    return [(body, zone, anchor >= least) for body, zone, anchor in out]


def _ranked(pages: list[list[list[str]]], run: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The words, and for each place of the stream of all pages the word's number (below 0 at the end of a page), page and rank by ``run`` words."""
    ids: dict[str, int] = {}
    stream, owner = [], []
    for n, page in enumerate(pages):
        for block in page:
            stream += [ids.setdefault(w, len(ids)) for w in block]
            owner += [n] * len(block)
        stream.append(-1 - n)  # no two pages share their end
        owner.append(n)
    places = np.array(stream, np.int64)
    rank = np.unique(places, return_inverse=True)[1].astype(np.int64)
    length, size = 1, len(stream)
    while length < run:
        step = min(length, run - length)
        after = np.full(size, -1, np.int64)
        after[: max(size - step, 0)] = rank[step:]
        rank = np.unique(rank * (size + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return list(ids), places, np.array(owner, np.int64), rank


def _shared(owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether suffixes of the same rank begin in another page too."""
    size = len(rank)
    first, last = np.full(size, size, np.int64), np.full(size, -1, np.int64)
    np.minimum.at(first, rank, owner)
    np.maximum.at(last, rank, owner)
    return first[rank] < last[rank]


def _under(begins: np.ndarray, size: int, run: int) -> np.ndarray:
    """The places that a passage of ``run`` words from one of ``begins`` on covers."""
    edge = np.zeros(size + run + 1, np.int64)
    edge[: len(begins)] += begins
    edge[run : len(begins) + run] -= begins
    return np.cumsum(edge)[:size] > 0


def covered(pages: list[list[list[str]]], run: int = RUN) -> list[list[np.ndarray]]:
    """For the words of each block of each page, whether a passage of ``run`` words that is on another page too covers them."""
    _, _, owner, rank = _ranked(pages, run)
    mask = _under(_shared(owner, rank), len(rank), run)
    out, at = [], 0
    for page in pages:
        masks = []
        for block in page:
            masks.append(mask[at : at + len(block)])
            at += len(block)
        at += 1
        out.append(masks)
    return out


def _codes(distinct: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in distinct], np.uint64)


def passages(pages: list[list[list[str]]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each passage of ``run`` words in the pages, once for each rank, and on how many pages it is: 1, or 2 for more."""
    distinct, places, owner, rank = _ranked(pages, run)
    ends = np.concatenate([[0], np.cumsum(places < 0)])
    whole = np.flatnonzero(ends[run:] == ends[:-run]) if len(places) >= run else np.zeros(0, np.int64)
    first = whole[np.unique(rank[whole], return_index=True)[1]]
    codes = np.where(places < 0, np.uint64(0), np.append(_codes(distinct), np.uint64(0))[places])
    return grams(codes, run).view(np.int64)[first], _shared(owner, rank)[first] + np.int64(1)


def page_passages(page: list[list[str]], run: int = RUN) -> np.ndarray:
    """The hash of the ``run`` words from each word of a page on."""
    flat = [w for block in page for w in block]
    distinct = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    return grams(_codes(list(distinct))[[distinct[w] for w in flat]] if flat else np.zeros(0, np.uint64), run).view(np.int64)


def covered_by(page: list[list[str]], repeated: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """For the words of each block of a page, whether a passage with one of the hashes ``repeated`` covers them."""
    mask = _under(np.isin(page_passages(page, run), repeated), sum(map(len, page)), run)
    return np.split(mask, np.cumsum([len(block) for block in page])[:-1]) if page else []


def _anchored(page: list[tuple[str, bool, bool]]) -> bool:
    return any(article and not zone for _, zone, article in page)


def _words(page: list[tuple[str, bool, bool]]) -> list[list[str]]:
    return [b[0].split(" ") for b in page]


def _article(page: list[tuple[str, bool, bool]]) -> str:
    return " ".join(body for body, zone, article in page if article and not zone)


def _text(page: list[tuple[str, bool, bool]], masks: list[np.ndarray]) -> str:
    """The text of a page without an article, given which words of its blocks are covered."""
    parts = []
    for (body, zone, _), m in zip(page, masks, strict=True):
        if not zone:
            parts.append(" ".join(w for w, gone in zip(body.split(" "), m, strict=True) if not gone) if m.any() else body)
    return " ".join(x for x in parts if x)


def _without(article: str, template: np.ndarray) -> str:
    """An article without the passages whose hashes are in ``template``; a copy, of which they cover more than half, is whole."""
    body = article.split(" ")
    mask = covered_by([body], template)[0]
    if not mask.any() or 2 * int(mask.sum()) > len(body):
        return article
    return " ".join(w for w, gone in zip(body, mask, strict=True) if not gone)


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host."""
    distinct = {p: i for i, p in enumerate(dict.fromkeys(p or "" for p in pages))}
    parsed = [blocks(p) for p in distinct]
    masks = covered([_words(page) for page in parsed])
    articles = [_article(page) for page in parsed if _anchored(page)]
    often = Counter(h for a in articles for h in {*page_passages([a.split(" ")]).tolist()})
    template = np.array([h for h, n in often.items() if n >= max(TEMPLATE_PAGES, len(articles) / 2)], np.int64)
    texts = [_without(_article(page), template) if _anchored(page) else _text(page, m) for page, m in zip(parsed, masks, strict=True)]
    return [texts[distinct[p or ""]] for p in pages]


def _parsing():
    def compute(column: pa.Array) -> list:
        parsed = [blocks(p or "") for p in column.to_pylist()]
        flat = [b for page in parsed for b in page]
        kinds = BLOCKS.value_type
        struct = pa.StructArray.from_arrays([pa.array([b[i] for b in flat], kinds.field(i).type) for i in range(3)], fields=list(kinds))
        offsets = np.concatenate([[0], np.cumsum([len(page) for page in parsed])])
        undecided = [not _anchored(page) and not all(zone for _, zone, _ in page) for page in parsed]
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, type=BLOCKS), pa.array(undecided, pa.bool_())]

    return compute


def _read(column: pa.Array) -> list[list[tuple[str, bool, bool]]]:
    return [[(b["body"], b["zone"], b["article"]) for b in page] for page in column.to_pylist()]


def _portions(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``part_bytes`` of html (column size), or with one longer page."""
    for batch in batches:
        upto = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy(zero_copy_only=False))])
        first = 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(upto, upto[first] + part_bytes, "right")) - 1, first + 1)
            yield batch.slice(first, last - first)
            first = last


def _counted(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """(host, hash, n) of the passages in each portion: the intervals of the suffix array of each host in it."""
    for part in _portions(batches, part_bytes):
        of: dict[str, list[list[list[str]]]] = {}
        for host, page in zip(part.column("host").to_pylist(), _read(part.column("blocks")), strict=True):
            of.setdefault(host, []).append(_words(page))
        for host, pages in of.items():
            found, n = passages(pages)
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()).take(pa.array(np.zeros(len(found), np.int32))), pa.array(found), pa.array(n)], ["host", "hash", "n"])


def _listed(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """(host, key, hash) of the passages of each page."""
    for part in _portions(batches, part_bytes):
        found = [np.unique(page_passages(_words(page))) for page in _read(part.column("blocks"))]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        columns = [part.column("host").take(rows).cast(pa.string()), part.column("key").take(rows).cast(pa.binary()), pa.array(np.concatenate(found))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "key", "hash"])


#: What each byte counts as in a word between spaces.
_spaced = np.maximum(np.arange(256), 1).astype(np.uint8)
_spaced[0x20] = 0


def _prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of FEW words, of 32 bits, of all articles, and the article each is in: one at least in each passage of RUN words."""
    w = words(column, folding=_spaced)
    prints, places = winnow(w.hash, w.text, FEW, RUN)
    return (prints >> np.uint64(32)).astype(np.uint32).view(np.int32), w.text[places]


def _printing():
    def compute(column: pa.Array) -> list:
        prints, text = _prints(column)
        both = np.unique(text.astype(np.int64) << 32 | prints.view(np.uint32))
        begin = np.searchsorted(both >> 32, np.arange(len(column) + 1))
        return [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array((both & 0xFFFFFFFF).astype(np.uint32).view(np.int32)))]

    return compute


def _frequent(table: pa.Table) -> pa.Table:
    """(host, print) of the prints on half of a part's pages; where the part is all of a host, on TEMPLATE_PAGES at least."""
    rows = dict(zip(table["key"].to_pylist(), range(table.num_rows), strict=True)).values()  # one for pages of equal html
    kept = table["prints"].combine_chunks().take(pa.array(list(rows)))
    values, n = np.unique(kept.flatten().to_numpy(), return_counts=True)
    least = TEMPLATE_PAGES if table["parts"][0].as_py() == 1 else 1
    found = pa.array(values[(2 * n >= len(rows)) & (n >= least)], pa.int32())
    host = pa.array([table["host"][0].as_py()], pa.string())
    return pa.table({"host": host.take(pa.array(np.zeros(len(found), np.int32))), "print": found})


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, hash) of the passages of each article that hold one of the given prints."""
    for batch in batches:
        found = []
        for article, prints in zip(batch.column("article").to_pylist(), batch.column("prints").to_pylist(), strict=True):
            w = words(pa.array([article], pa.large_string()), folding=_spaced)
            few = np.isin((grams(w.hash, FEW) >> np.uint64(32)).astype(np.uint32).view(np.int32), np.array(prints, np.int32))
            hashes = page_passages([article.split(" ")])
            near_by = np.zeros(len(hashes), bool)
            for i in range(RUN - FEW + 1):
                near_by |= few[i : i + len(hashes)]
            found.append(np.unique(hashes[near_by]))
        rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        columns = [batch.column("host").take(rows).cast(pa.string()), batch.column("key").take(rows).cast(pa.binary()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "key", "hash"])


def _lists(rows: DataFrame, value: str, name: str) -> DataFrame:
    """A list for each host, broadcast if all of them are few. A host's is bounded: each element is on half of its pages, so they are no more than two pages hold."""
    lists = pinned(rows.groupBy("host").agg(F.collect_list(value).alias(name)))
    total = lists.agg(F.sum(F.size(name)).alias("n")).first()["n"] or 0
    return F.broadcast(lists) if total <= MOST_BROADCAST else lists


def _template(articles: DataFrame, part_bytes: int) -> DataFrame | None:
    """(host, template): hashes of the passages in the articles (host, key, article) of half of a host's pages; None if there are none."""
    sizes = articles.groupBy("host", "key").agg(F.max(F.octet_length("article")).alias("size")).groupBy("host")
    hosts = sizes.agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size")).filter(F.col("pages") >= TEMPLATE_PAGES)
    hosts = near(hosts.select("host", "pages", F.ceil(F.col("size") / part_bytes).cast("int").alias("parts")))
    printed = map_text(articles.join(hosts.select("host", "parts"), "host"), "article", ["host", "key", "parts"], [T.StructField("prints", T.ArrayType(T.IntegerType()))], _printing)
    part = F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))).alias("part")
    candidates = printed.select("host", "key", "parts", "prints", part).groupBy("host", "part").applyInArrow(_frequent, "host string, print int")
    candidates = pinned(candidates.distinct())
    few = candidates.count()
    if not few:
        return None
    candidates = F.broadcast(candidates) if few <= MOST_BROADCAST else candidates
    often = F.col("n") >= F.greatest(F.lit(TEMPLATE_PAGES), F.col("pages") / 2)
    held = printed.select("host", "key", F.explode("prints").alias("print")).join(candidates, ["host", "print"]).distinct()
    held = held.groupBy("host", "print").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host").filter(often)
    passages_of = articles.join(_lists(held, "print", "prints"), "host").select("host", "key", "article", "prints").mapInArrow(_holding, "host string, key binary, hash long")
    repeated = passages_of.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host").filter(often)
    return _lists(repeated, "hash", "template")


def extract_main_text(pages: DataFrame, keep: list[str], page: str = "html", url: str = "url", part_bytes: int = PART_BYTES) -> DataFrame:
    """Columns ``keep`` with ``main_text`` (never null): the article of each page.

    A null or empty html has no text. Pages without a url, or whose url has no host, share the host ''. Repeated rows each give a
    row and count as one page. An empty table gives an empty table. A very long page is read whole, by one task, in time in
    proportion to its length. Other columns may have any names; one named ``main_text`` must not be among ``keep``.
    """
    shipped(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    body = F.coalesce(F.col(f"`{page}`"), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)]
    # What is covered depends on host and html alone: rows alike in both have the same key.
    key = F.unhex(F.md5(F.concat_ws("\n", host, body)))
    source = pages.select(*kept, host.alias("host"), key.alias("key"), F.octet_length(body).cast("long").alias("size"), body.alias("body"))
    fields = [T.StructField("blocks", from_arrow_type(BLOCKS)), T.StructField("undecided", T.BooleanType())]
    parsed = written(map_text(source, "body", [*names, "host", "key", "size"], fields, _parsing), "blocks", "zstd")
    article = F.expr("array_join(transform(filter(blocks, b -> b.article and not b.zone), b -> b.body), ' ')")
    schema = T.StructType([*parsed.select(*names).schema.fields, T.StructField("main_text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def assembled(table: pa.Table | pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        return [*(table.column(n).cast(arrow.field(n).type) for n in names), pa.array(texts, arrow.field("main_text").type)]

    with_article = parsed.filter("not undecided").select(*names, "host", "key", article.alias("article"))
    template = _template(with_article.filter("article <> ''").select("host", "key", "article"), min(part_bytes, TEMPLATE_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(batch.column("article").to_pylist(), batch.column("template").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays(assembled(batch, [_without(a, np.array(t, np.int64)) if t else a for a, t in columns]), schema=arrow)

    decided = with_article.select(*names, F.col("article").alias("main_text"))
    if template is not None:
        joined = with_article.join(template, "host", "left")
        cuts = joined.filter("template is not null").select(*names, "article", "template").mapInArrow(cut, schema)
        decided = joined.filter("template is null").select(*names, F.col("article").alias("main_text")).union(cuts)

    hosts = near(parsed.groupBy("host").agg(F.sum("size").alias("size"), F.max("undecided").alias("any")).filter("any").select("host", (F.col("size") > part_bytes).alias("large")))
    placed = parsed.join(hosts, "host")

    def whole_host(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        distinct = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        rows = dict(zip(reversed(keys), reversed(range(len(keys))), strict=True))
        read = _read(table["blocks"].take(pa.array([rows[k] for k in distinct])))
        texts = [_text(page, m) for page, m in zip(read, covered([_words(page) for page in read]), strict=True)]
        asked = table["undecided"].to_pylist()
        return pa.Table.from_arrays(assembled(table.filter(table["undecided"]), [texts[distinct[k]] for k, u in zip(keys, asked, strict=True) if u]), schema=arrow)

    small = placed.filter("not large").select(*names, "host", "key", "blocks", "undecided").groupBy("host").applyInArrow(whole_host, schema)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, part_bytes):
            repeated = part.column("repeated").to_pylist()
            texts = [_text(page, covered_by(_words(page), np.array(r or [], np.int64))) for page, r in zip(_read(part.column("blocks")), repeated, strict=True)]
            yield pa.RecordBatch.from_arrays(assembled(part, texts), schema=arrow)

    large = placed.filter("large")
    counts = large.select("host", "key", "size", "blocks").dropDuplicates(["host", "key"]).select("host", "size", "blocks").mapInArrow(lambda batches: _counted(batches, part_bytes), "host string, hash long, n long")
    repeated = near(counts.groupBy("host", "hash").agg(F.sum("n").alias("n")).filter("n > 1").select("host", "hash"))
    asked = large.filter("undecided")
    found = asked.select("host", "key", "size", "blocks").mapInArrow(lambda batches: _listed(batches, part_bytes), "host string, key binary, hash long").distinct()
    marks = found.join(repeated, ["host", "hash"]).groupBy("key").agg(F.collect_list("hash").alias("repeated"))
    rest = asked.select(*names, "key", "size", "blocks").join(marks, "key", "left").mapInArrow(marked, schema)
    return decided.union(small).union(rest).toDF(*keep, "main_text")
