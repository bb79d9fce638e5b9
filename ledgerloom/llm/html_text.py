"""HTML extraction: site template removal by subtree hashes counted per host.

A page is parsed to a tree, tolerant of missing end tags. Every subtree gets a hash of its
tags and text. Spark counts, for each host, the different pages that hold a subtree; pages of
one text are one page, so mirrors of a page do not make its text template. Subtrees on at
least ``LEAST`` different pages and on ``SHARE`` of the host's, or on ``MANY``, are template,
and are deleted from its pages.
Elements that HTML itself marks as something else (nav, header of a page, footer, aside,
form, script, ...), or whose class or id says so, go as well. The main text is that of the
article elements, or of main, or else of what is left of the body. Within article or main
running text (paragraphs, headings, ...) and what holds it is never template: sites do repeat
sentences; and an article of which all is template is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_filter import url_parts
from .work import contained, stored

LEAST = 5
SHARE = 0.05
MANY = 50
BROADCAST_TREES = 1 << 21

# A quote opens a value only after an equals sign: title=it's has none.
_ATTRIBUTES = r"((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s>/]*){_ATTRIBUTES}(?:>|\Z)", re.S)
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "select", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
_SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_BOILER_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select textarea input object embed head title dialog menu".split())
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|"
    r"subscribe|share|sharing|social|comments?|comment-?list|replies|disqus|related|recommended|toolbar|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)
# In an article only names of what is no part of one count: "search" or "related" may be its topic.
_FOREIGN = r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|comments?|comment-?list|replies|disqus"
_FOREIGN_TEXT = re.compile(rf"(?:^|[\s_-])(?:{_FOREIGN})(?:$|[\s_-])", re.I)
_FOREIGN_PART = re.compile(rf"(?:^|[\s_-])(?:{_FOREIGN}|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|masthead|notice|popup|modal|login|signup)(?:$|[\s_-])", re.I)
# An article element may itself be a reader's comment or an advert.
_FOREIGN_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|reply|replies)(?:$|[\s_-])", re.I)
_BOILER_ROLE = frozenset("comment navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BODY_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl".split())
_BARRIERS = ("table", "article", "body")
_THROUGH = frozenset("table article body html main div section".split())
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt b i em strong a span code q cite small sub sup u s mark br tr tbody ul ol dl table figcaption".split())


def _is_boiler(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _BOILER_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    names = _FOREIGN_ARTICLE if tag == "article" else _BOILER_NAME if not in_article else _FOREIGN_TEXT if tag in _RUNNING else _FOREIGN_PART
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            if value.lower() in _BOILER_ROLE:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif names.search(value):
            return True
    return False


class Page:
    """The tree of a page: parent, tag, boiler mark of each node, and the runs of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.boiler = [-1], ["#"], [False]
        self.order: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        stack, open_tags = [0], ["#"]
        places: dict[str, list[int]] = {}  # where in the stack each open tag stands

        def last(*tags: str) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        def close(to: int) -> None:
            while len(stack) > to:
                node, tag = stack.pop(), open_tags.pop()
                places[tag].pop()
                if tag in _BLOCK:
                    self.order.append((node, None))

        pos = 0
        while True:
            m = _TOKEN.search(source, pos)
            text = source[pos : m.start() if m else len(source)]
            if text:
                self.order.append((stack[-1], text))
            if not m:
                break
            pos = m.end()
            if m[1]:
                tag = m[1].lower()
                k = last(tag)
                if k > 0 and (tag in _THROUGH or k >= last(*_BARRIERS)):
                    close(k)
            elif m[2]:
                tag, attributes = m[2].lower(), m[3] or ""
                if tag in _CLOSES_P:
                    k = last("p")
                    if k > last("table", "article", "button"):
                        close(k)
                elif tag in _SELF_CLOSING:
                    k = last(*(("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)))
                    if k > last(*_SELF_CLOSING[tag]):
                        close(k)
                node = len(self.parent)
                self.parent.append(stack[-1])
                self.tag.append(tag)
                self.boiler.append(_is_boiler(tag, attributes, last("article") > 0))
                if tag in _BLOCK:
                    self.order.append((node, None))
                if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _BLOCK:
                    continue
                if tag in _RAW:
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, pos)
                    pos = end.end() if end else len(source)
                    continue
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
                open_tags.append(tag)
        close(1)

    def hashes(self) -> dict[int, int]:
        """The hash of every subtree with text that may be template."""
        n = len(self.parent)
        parts: list[list[str]] = [[] for _ in range(n)]
        inside, holds = [False] * n, [False] * n
        for k in range(1, n):
            inside[k] = inside[self.parent[k]] or self.tag[k] in ("article", "main")
        for node, text in self.order:
            if text is not None and (words := text.split()):
                parts[node].append(" ".join(words))
        out = {}
        for k in range(n - 1, 0, -1):
            tag, p = self.tag[k], self.parent[k]
            holds[p] = holds[p] or holds[k] or tag in _BODY_TEXT
            if not parts[k]:
                continue
            body = f"<{tag}>" + "\x1f".join(parts[k])
            h = xxhash.xxh3_64_intdigest(body)
            parts[p].append(str(h))
            if tag not in ("html", "body", "article", "main") and not (inside[k] and (tag in _RUNNING or holds[k])):
                out[k] = h
        return out

    def identity(self) -> int:
        """A hash of all text of the page."""
        return xxhash.xxh3_64_intdigest(" ".join(" ".join(text.split()) for _, text in self.order if text is not None))

    def text(self, template) -> str:
        """The main text; ``template`` says for a subtree's hash whether to delete it."""
        found = self._left(template)
        return found if found or not {"article", "main"} & set(self.tag) else self._left(lambda h: False)

    def _left(self, template) -> str:
        n = len(self.parent)
        gone, within = [False] * n, [""] * n
        hashes = self.hashes()
        for k in range(1, n):
            p = self.parent[k]
            gone[k] = gone[p] or self.boiler[k] or (k in hashes and template(hashes[k]))
            within[k] = within[p] or (self.tag[k] if self.tag[k] in ("article", "main") else "")
        kinds = {within[node] for node, text in self.order if text is not None and not gone[node] and text.strip()}
        root = "article" if "article" in kinds else "main" if "main" in kinds else None
        blocks: list[list[str]] = [[]]
        for node, text in self.order:
            if text is None:
                blocks.append([])
            elif not gone[node] and (root is None or within[node] == root or root == "main" and within[node] == "article"):
                blocks[-1].append(text)
        joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
        return " ".join(b for b in joined if b)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _subtree_key(host: str, h: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{h:x} {host}"))


def _count_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, tree, page) for the subtrees of pages, and (host, null, page) for each page."""
    for batch in batches:
        hosts, keys, pages = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py() or "")
            trees = set(page.hashes().values())
            hosts.extend([host] * (len(trees) + 1))
            keys.extend([_subtree_key(host, h) for h in trees] + [None])
            pages.extend([_signed(page.identity())] * (len(trees) + 1))
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(pages, pa.int64())], names=["host", "tree", "page"])


def templates(pages: DataFrame) -> DataFrame:
    """(tree): keys of the subtrees that are template, from rows (host, html)."""
    seen = pages.mapInArrow(_count_trees, "host string, tree long, page long").groupBy("host", "tree").agg(F.count_distinct("page").alias("n"))
    seen = stored(seen.where("tree is null or n >= 2"), "subtrees", 16)
    sizes = seen.where("tree is null").select("host", F.col("n").alias("pages"))
    least = F.greatest(F.lit(LEAST), F.least(F.lit(MANY), SHARE * F.col("pages")))
    return seen.where("tree is not null").join(sizes, "host").where(F.col("n") >= least).select("tree")


def _extractor(value):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(value.value.tolist()) if value is not None else None
        for batch in batches:
            texts = []
            own = batch.column(4).to_pylist() if known is None else None
            for k, (host, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                mine = known if known is not None else frozenset(own[k] or ())
                texts.append(Page(source.as_py() or "").text(lambda h, host=host, mine=mine: _subtree_key(host, h) in mine))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows


def _keyed_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, trees = [], []
        for k, (host, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
            own = {_subtree_key(host, h) for h in Page(source.as_py() or "").hashes().values()}
            at.extend([k] * len(own))
            trees.extend(own)
        rows = pa.array(at, pa.int64())
        yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(trees, pa.int64())], names=["key", "check", "tree"])


@contained
def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each input row.

    A null or empty html gives an empty text. A null url is a page of the empty host, and ids
    only pass through. Repeated rows and other pages of one text count as one page and fare
    alike. An empty table gives no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    host, _, _ = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    found = stored(templates(rows.select("host", "html")), "templates", 16)
    kind = dict(rows.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, text string, n_chars long"
    if found.count() <= BROADCAST_TREES:
        keys = found.toArrow().column("tree").to_numpy().astype(np.int64)
        return rows.mapInArrow(_extractor(spark.sparkContext.broadcast(keys)), schema)
    # Too many to broadcast: every page gets the keys of its own template subtrees by a join.
    hashes = {"key": F.xxhash64("host", "html"), "check": F.xxhash64(F.lit(3), "host", "html")}
    keyed = rows.select(hashes["key"].alias("key"), hashes["check"].alias("check"), "host", "html").mapInArrow(_keyed_trees, "key long, check long, tree long").distinct()
    mine = keyed.join(found, "tree").groupBy("key", "check").agg(F.collect_set("tree").alias("trees"))
    return rows.withColumns(hashes).join(mine, ["key", "check"], "left").select("page_id", "url", "host", "html", "trees").mapInArrow(_extractor(None), schema)
