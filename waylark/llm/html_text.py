"""Main text of web pages by a site style tree.

Pages become streams of block elements. The style of an element is its path of
tags with class and id names (runs of digits dropped), and the style tree of a
site merges the paths of all pages of one host. Of each of its nodes are told:

* presentation: the entropy of the sequences of its child elements' styles, in
  parts of PRESENTATION_BITS,
* content: the entropy, over pages, of the texts below it, as a share of the
  highest that so many pages allow. A text that many pages repeat carries little,
* the share of its text that links hold.

Each is taken over the site's pages and smoothed towards that of all sites, as if
SMOOTHING pages more had it, so that a site of one page is judged by the tree of
all and a large one by its own. Importance is the greater of both entropies, less
the share of links; branches of low importance go. Nodes whose presentation is
diverse while links hold little of them are rich: on a page that has one, what lies
in none goes too, headings apart. So adverts and footers that change from page to page
go by their presentation, which never does.

What an element says of itself is evidence beside the tree: navigation, footer,
aside, form and hidden ones go, and branches whose class names are all of adverts,
menus, notices and comments, unless they hold most of the page's text.

Sites meet by sums of counts, so a host of any size is summed in many tasks, and
their trees (a few hundred bytes a host) go back to pages by a broadcast if they
are small, else by a join that deals each host over several partitions.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements without content, elements that begin a block, and elements that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noframes".split())
APART = frozenset("nav header footer aside form script style noscript template iframe svg textarea button select option title head menu dialog object embed canvas map xmp noframes".split())
#: Words of class and id names that say the same. A name counts if it has no other words but these and PLACE_NAMES.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus replies widget toolbar pagination pager skip tags".split()
)
PLACE_NAMES = frozenset("area bar block bottom box button buttons col column container content count inner item items left link links list main outer page right row section site text title top widget wrap wrapper".split())
#: What these name is part of an article if it stands inside one.
ARTICLE_NAMES = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element without an end tag is closed by.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that hold the article, never cut as a branch.
WHOLE = frozenset("html body main article".split())
SCOPES = frozenset("ul ol dl table body html div article section main".split())

#: A quote in a tag begins a value only after an equals sign; groups are atomic, so that no text is read twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>=]|=)*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:\s|^)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)(?:hidden(?=[\s=/]|$)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[a-zA-Z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

#: A branch goes if its importance is below this.
LEAST_IMPORTANCE = 0.3
#: A branch is rich from this presentation on, with less than this share of its text in links.
RICH, RICH_LINKS = 0.5, 0.5
PRESENTATION_BITS = 2.0
SMOOTHING = 4
#: Trees together up to so many nodes are broadcast.
BROADCAST_NODES = 200_000
SALTS = 32


class Block:
    """A piece of text with the styles above it and the numbers of their elements. Pieces of one ``line`` are one block; ``apart`` is 2 where an element says that it is no article, 1 where a name does."""

    __slots__ = ("path", "ids", "apart", "text", "linked", "line")

    def __init__(self, path: tuple[str, ...], ids: tuple[int, ...], apart: int, text: str, linked: int, line: int):
        self.path, self.ids, self.apart, self.text, self.linked, self.line = path, ids, apart, text, linked, line

    @property
    def size(self) -> int:
        return len(self.text.strip())


def _style(tag: str, attributes: str) -> tuple[str, bool]:
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if "=" in attributes else ""
    if not names:
        return tag, False
    names = names.lower()
    parts = [set(WORD.findall(n)) for n in names.split()]
    return f"{tag}.{DIGITS.sub('', names)}", any(p & APART_NAMES and p <= APART_NAMES | PLACE_NAMES for p in parts)


def blocks(source: str) -> list[Block]:
    """The blocks of a page in order. Markup that is never closed or opened is read as browsers do, as far as blocks go."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []  # tag, style, apart, number
    parts: list[str] = []
    linked = line = number = 0
    in_link = 0

    def flush(ends: bool = True) -> None:
        nonlocal linked, line
        if parts:
            text = html.unescape("".join(parts))
            parts.clear()
            if text:
                above = [x for x in stack if x[0] in BLOCK or x[2]]
                out.append(Block(tuple(x[1] for x in above), tuple(x[3] for x in above), max((x[2] for x in above), default=0), text, min(linked, len(text)), line))
        linked = 0
        line += ends

    def close(tag: str) -> None:
        nonlocal in_link
        while stack:
            top = stack.pop()[0]
            if top == "a":
                in_link = max(0, in_link - 1)
            if top == tag:
                return

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            piece = source[at:]
            at = n
            tag = None
        else:
            piece = source[at : m.start()]
            at = m.end()
            tag = m[2]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if m is None or tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            closed = [x for x in stack if x[0] == tag]
            if tag in BLOCK:
                flush()
            elif closed and any(x[2] for x in stack[stack.index(closed[-1]) :]):
                flush(False)
            if closed:
                close(tag)
            continue
        attributes = m[3] or ""
        if tag in RAW:
            if attributes.endswith("/") and tag == "svg":
                continue
            end = RAW_END[tag].search(source, at)
            if end is None:
                at = n
            else:
                close_at = source.find(">", end.end())
                at = n if close_at < 0 else close_at + 1
            parts.append(" " if tag not in ("script", "style", "template", "noscript") else "")
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                if stack[i][0] == "p":
                    del stack[i:]
                    in_link = sum(s[0] == "a" for s in stack)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    if stack[i][2]:
                        flush(False)
                    del stack[i:]
                    in_link = sum(s[0] == "a" for s in stack)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in VOID:
            if tag in ("br", "wbr", "img", "hr", "input"):
                parts.append("" if tag == "wbr" else " ")
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        style, named = _style(tag, attributes)
        inside = any(x[0] == "article" for x in stack)
        apart = 2 if tag in APART or HIDDEN.search(attributes) else int(named)
        if inside and (tag == "header" or (apart == 1 and APART_NAMES.intersection(WORD.findall(style.partition(".")[2])) <= ARTICLE_NAMES)):
            apart = 0
        if tag in WHOLE:
            apart = 0  # names on these speak of the whole page
        if apart and tag not in BLOCK:
            flush(False)
        number += 1
        stack.append((tag, style, apart, number))
        if tag == "a":
            in_link += 1
    flush()
    return out


def host_of(url):
    """The host of a URL column in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _branches(page: list[Block]) -> dict[tuple[str, ...], list[Block]]:
    """Blocks below each style of a page."""
    below: dict[tuple[str, ...], list[Block]] = {}
    for b in page:
        for depth in range(1, len(b.path) + 1):
            below.setdefault(b.path[:depth], []).append(b)
    return below


def _children(found: list[Block], depth: int) -> list[str]:
    """Styles of the child elements of a branch that hold its blocks, in order; text of its own has none."""
    out, last = [], 0
    for b in found:
        now = b.ids[depth] if len(b.ids) > depth else -b.line - 1
        if now != last:
            out.append(b.path[depth] if now > 0 else "")
            last = now
    return out


def _key(path: tuple[str, ...]) -> int:
    return int(common.mix(np.array([hash_text(">".join(path))], dtype=np.uint64)).view(np.int64)[0])


def hash_text(text: str) -> int:
    """A hash of a text that is the same everywhere."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _facts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (host, html): for each style of each page a feature of its content and one of its presentation, counted within the task."""
    counts: Counter = Counter()
    linked: Counter = Counter()

    def rows() -> pd.DataFrame:
        keys = list(counts)
        return pd.DataFrame({"host": [k[0] for k in keys], "node": [k[1] for k in keys], "kind": np.array([k[2] for k in keys], dtype=np.int32), "feature": np.array([k[3] for k in keys], dtype=np.int64), "n": np.array([counts[k] for k in keys], dtype=np.int64), "chars": np.array([linked[k][0] if k in linked else 0 for k in keys], dtype=np.int64), "links": np.array([linked[k][1] if k in linked else 0 for k in keys], dtype=np.int64)})

    for pdf in it:
        for host, source in zip(pdf["host"], pdf["html"], strict=True):
            for path, found in _branches(blocks(source) if isinstance(source, str) else []).items():
                if path[-1].partition(".")[0] in ("html", "body"):
                    continue
                node = _key(path)
                text = hash_text("\n".join(" ".join(b.text.split()) for b in found)) & (1 << 62) - 1
                shape = hash_text(">".join(_children(found, len(path)))) & (1 << 62) - 1
                counts[host, node, 0, text] += 1
                key = (host, node, 1, shape)
                counts[key] += 1
                chars, links = linked.get(key, (0, 0))
                linked[key] = (chars + sum(b.size for b in found), links + sum(b.linked for b in found))
        if len(counts) > 300_000:
            yield rows()
            counts.clear()
            linked.clear()
    if counts:
        yield rows()


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, pages, importance, rich) of each style of each site."""
    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    facts = hosted.mapInPandas(_facts, "host string, node long, kind int, feature long, n long, chars long, links long")
    summed = common.written(facts.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")), "facts")

    def nodes(rows: DataFrame, *by: str) -> DataFrame:
        # entropy of shares n/N is log N - sum(n log n)/N, so plain sums suffice
        of = lambda k, what: F.sum(F.when(F.col("kind") == k, what).otherwise(F.lit(0)))
        part = F.col("n") * F.log2(F.col("n").cast("double"))
        told = rows.groupBy(*by).agg(of(0, F.col("n")).alias("pages"), of(0, part).alias("c"), of(1, part).alias("s"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        most = F.log2(F.col("pages").cast("double"))
        return told.select(
            *by,
            "pages",
            F.when(F.col("pages") > 1, (most - F.col("c") / F.col("pages")) / most).otherwise(F.lit(1.0)).alias("content"),
            F.least(F.lit(1.0), F.when(F.col("pages") > 1, most - F.col("s") / F.col("pages")).otherwise(F.lit(0.0)) / PRESENTATION_BITS).alias("presentation"),
            (F.col("links") / F.greatest(F.col("chars"), F.lit(1))).alias("linked"),
        )

    everywhere = nodes(summed.groupBy("node", "kind", "feature").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "links"))), "node")
    own = nodes(summed, "host", "node")
    both = own.join(everywhere.select("node", *(F.col(c).alias(f"all_{c}") for c in ("content", "presentation", "linked"))), "node")
    smooth = lambda c: (F.col(c) * (F.col("pages") - 1) + F.col(f"all_{c}") * SMOOTHING) / (F.col("pages") - 1 + SMOOTHING)
    told = both.select("host", "node", "pages", *(smooth(c).alias(c) for c in ("content", "presentation", "linked")))
    told = told.withColumn("own", F.greatest("content", "presentation") * (1 - F.col("linked")))
    # against the site's best node, so that a site of copies doesn't lose its articles
    best = told.groupBy("host").agg(F.max("own").alias("best"))
    rich = (F.col("presentation") >= RICH) & (F.col("linked") < RICH_LINKS)
    return told.join(best, "host").select("host", "node", "pages", F.when(F.col("best") > 0, F.col("own") / F.col("best")).otherwise(F.lit(1.0)).alias("importance"), rich.alias("rich"))


def main_text(source: str, low: frozenset[int], rich: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that lie in no low branch, one on a line; if some lie in a rich branch, these and headings only."""
    found = blocks(source)
    total = sum(b.size for b in found if b.apart < 2)
    held: Counter = Counter()
    for b in found:
        if b.apart == 1:
            held[b.ids] += b.size
    most = {ids for ids, n in held.items() if 2 * n > total}
    kept: list[tuple[Block, bool]] = []
    for b in found:
        if b.apart == 2 or (b.apart == 1 and b.ids not in most):
            continue
        keys = {_cached_key(b.path[:d]) for d in range(1, len(b.path) + 1)} if low or rich else set()
        if not keys & low:
            kept.append((b, bool(keys & rich)))
    if any(r for _, r in kept):
        kept = [(b, r) for b, r in kept if r or any(p.partition(".")[0] in HEADINGS for p in b.path)]
    lines: dict[int, list[str]] = {}
    for b, _ in kept:
        lines.setdefault(b.line, []).append(b.text)
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in lines.values()) if t)


_keys: dict[tuple[str, ...], int] = {}


def _cached_key(path: tuple[str, ...]) -> int:
    found = _keys.get(path)
    if found is None:
        if len(_keys) > 100_000:
            _keys.clear()
        found = _keys[path] = _key(path)
    return found


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    The whole source is read. A null or empty source gives an empty text, a null URL
    or one without a host counts as a site of its own name "". Rows that repeat an id
    are extracted each. A branch of a style that is on one page only is judged by what
    its element says and by whether the page has a rich branch. An empty table gives no
    rows. Other columns are ignored.
    """
    common.text_batches(pages.sparkSession)
    trees = common.written(style_trees(pages, url_col, html_col), "styles")
    is_low = F.col("importance") < LEAST_IMPORTANCE
    told = trees.where(is_low | F.col("rich"))
    pick = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("node"))))
    lists = told.groupBy("host").agg(pick(is_low).alias("low"), pick(F.col("rich") & ~is_low).alias("rich"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if told.count() <= BROADCAST_NODES:
        met = rows.join(F.broadcast(lists), "host", "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(lists.withColumn("salt", salt), ["host", "salt"], "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for pdf in it:
            texts = []
            for host, source, *found in zip(pdf["host"], pdf["html"], pdf["low"], pdf["rich"], strict=True):
                if host not in sets:
                    if len(sets) > 10_000:
                        sets.clear()
                    sets[host] = tuple(frozenset(int(x) for x in f) if f is not None else frozenset() for f in found)
                texts.append(main_text(source, *sets[host]) if isinstance(source, str) else "")
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts})

    kind = pages.schema[id_col].dataType.simpleString()
    out = met.select("page_id", "url", "html", "host", "low", "rich").mapInPandas(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
