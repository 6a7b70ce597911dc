"""Main text of web pages by wrapper induction.

Every page becomes a tree of block elements. All trees of a host are aligned from the top
down by the labels of their nodes (element, class, id and role names), as in one tree that
holds them all: what stands at one path is one node. Of each node the pages that have it
are counted, and of each block (path and text) the pages that show it. A block that at
least ``SHARE`` of the pages show that have the node around it, and ``LEAST`` pages, is
template. The node around it tells layouts of a host apart: a second layout does not dilute
the first. The main text of a page is all its blocks that are neither template nor in the
regions that are never article (menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments), which are known by their elements and by class,
id and role names. Nothing is taken by its size or share of a page.

All pages of a host count, however many or large they are; pages with the same blocks count
as one. A text on fewer than ``LEAST`` different pages is never template. Where a page has
nothing but template, all its blocks stay. Counts are summed by block, in the map tasks
first. Pages are read twice and not shuffled unless the wrappers are too many for Spark's
own limit on broadcasts. ``match`` aligns two trees exactly; the query doesn't need it.

Null or empty html gives an empty text. A null url is a host of its own. Repeated rows are
extracted each; extra columns are ignored. Unclosed and cut off markup is accepted.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches

#: A block is template if it is on so many different pages of a host at least, and on
#: such a share of those that have the node that it stands in.
LEAST = 3
SHARE = 0.6
DEPTH = 150

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
RAW = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no article text.
NEVER = set("aside button canvas datalist dialog embed footer form head iframe input map menu nav noscript object script select style svg template textarea title".split())
#: Words of class, id and role names of regions that hold no article text.
NAMES = set(
    "ad ads adbox advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related recommended respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "names", "items", "block", "skip", "up", "depth")

    def __init__(self, tag: str, names: str = "", up: Node | None = None, hidden: bool = False) -> None:
        self.tag, self.names, self.up, self.items = tag, names, up, []
        self.depth = up.depth + 1 if up is not None else 0
        self.block = tag in BLOCK
        self.skip = hidden or tag in NEVER or (names and tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(x.lower() for x in WORD.findall(names)))

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}"


_CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr"}), "th": ("td th", {"tr"}), "option": ("option", {"select"})}


def _close(at: Node, tags, stop) -> Node:
    """The parent of the nearest open element of these; ``at`` if there is none below a stop."""
    x = at
    while x.up is not None and x.tag not in stop:
        if x.tag in tags:
            return x.up
        x = x.up
    return at


_P_STOP = {"article", "body", "td", "th", "button", "object", "caption", "table"}


def parse(page: str) -> Node:
    root = at = Node("html")
    place, end = 0, len(page)
    while place < end:
        m = TOKEN.search(page, place)
        text = page[place : m.start() if m else end]
        if text:
            at.items.append(text)
        if m is None:
            break
        place = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("close"):
            if tag in ("html", "body"):
                continue
            x = at
            while x.up is not None and x.tag != tag and (tag in BLOCK or not x.block):
                x = x.up
            if x.tag == tag and x.up is not None:
                at = x.up
            continue
        names, hidden, attrs = "", False, m.group("attrs")
        if attrs and not attrs.isspace():
            found = {}
            for k, v in ATTR.findall(attrs):
                found.setdefault(k.lower(), v.strip("\"'"))
            names = " ".join(filter(None, (found.get("class"), found.get("id"), found.get("role"))))
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag == "html":
            root.names = names
            continue
        if tag == "body":
            at = Node("body", names, root)
            root.items.append(at)
            continue
        if tag in BLOCK:
            at = _close(at, ("p",), _P_STOP)
            if tag in HEADINGS:
                at = _close(at, HEADINGS, _P_STOP | {"div", "section"})
        if tag in _CLOSED_BY:
            tags, stop = _CLOSED_BY[tag]
            at = _close(at, tags.split(), stop)
        if tag in VOID:
            at.items.append(Node("hr") if tag == "hr" else " ")
            continue
        node = Node(tag, names, at, hidden)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, place)
            place = close.end() if close else end
            at.items.append(node)
            continue
        at.items.append(node)
        # below a depth that no page needs, elements stand beside one another
        if (not attrs.endswith("/") or tag in BLOCK) and node.depth < DEPTH:
            at = node
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(top: Node, in_article: bool = False):
    """(path below ``top``, text) of each block in page order, without regions that are never article."""
    out, held = [], []

    def flush(path):
        if held:
            if text := _clean(held):
                out.append((path, text))
            held.clear()

    def walk(node, path, inside, only_headings):
        for x in node.items:
            if isinstance(x, str):
                if not only_headings or node.tag in HEADINGS:
                    held.append(x)
                continue
            if x.skip:
                if x.block:
                    flush(path)
                continue
            header = x.tag == "header" or (x.block and x.tag not in HEADINGS and "header" in WORD.findall(x.names.lower()))
            if header and not inside:
                flush(path)
                continue
            if x.block:
                flush(path)
                mine = f"{path}/{x.label}"
                walk(x, mine, inside or x.tag in ("article", "main"), only_headings or header)
                flush(mine)
            elif only_headings and node.tag in HEADINGS:
                held.append(" ".join(t for _, t in blocks(x, True)))
            else:
                walk(x, path, inside, only_headings)

    walk(top, "", in_article or top.tag in ("article", "main"), False)
    flush("")
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _body(root: Node) -> Node:
    bodies = [x for x in root.items if isinstance(x, Node) and x.tag == "body"]
    return max(bodies, key=lambda b: len(b.items)) if bodies else root


def match(a, b) -> tuple[int, list]:
    """Simple tree matching: the size of the largest top-down, order-keeping match, and its pairs of nodes."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[3], b[3]
    score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    pairs = {}
    for i, p in enumerate(x, 1):
        row, up = score[i], score[i - 1]
        for j, q in enumerate(y, 1):
            best = max(up[j], row[j - 1])
            if p[0] == q[0]:
                pairs[i, j] = match(p, q)
                best = max(best, up[j - 1] + pairs[i, j][0])
            row[j] = best
    out, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            out += pairs[i, j][1]
            i, j = i - 1, j - 1
    return score[len(x)][len(y)] + 1, out


def _keys(name: str, found: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Of each block: a hash of its host, path and text, and one of its host and the node that it stands in."""
    out, nodes = [], {}
    for path, text in found:
        # numbers in names are those of a page
        path = DIGITS.sub("0", path)
        above = path.rpartition("/")[0]
        if above not in nodes:
            nodes[above] = _hash(f"{name}\0{above}")
        out.append((_hash(f"{name}\0{path}\0{text}"), nodes[above]))
    return out


def _nodes(name: str, found: list[tuple[str, str]]) -> set[int]:
    """Hashes of host and path of all nodes that hold a block at any depth."""
    held = set()
    for path in {DIGITS.sub("0", path) for path, _ in found}:
        above = path.rpartition("/")[0]
        while above not in held:
            held.add(above)
            above = above.rpartition("/")[0]
    return {_hash(f"{name}\0{path}") for path in held}


def extract(page: str, name: str = "", template: frozenset[int] = frozenset()) -> str:
    """All blocks but template; where nothing else is on the page, all blocks."""
    if not page:
        return ""
    found = blocks(_body(parse(page)))
    texts = [t for (_, t), (key, _) in zip(found, _keys(name, found)) if key not in template] if template else []
    return "\n".join(texts or [t for _, t in found])


def host(url_col):
    """The host of a URL, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, template: hashes of the blocks that are template there, from every page."""

    def count(batches):
        for batch in batches:
            hosts, keys, pages, kinds = [], [], [], []
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                seen = blocks(_body(parse(page))) if page else []
                if not seen:
                    continue
                found = _keys(name, seen)
                texts = sorted({k for k, _ in found})
                # pages that are copies of one another say nothing about what is template: they count as one
                copy = _hash(json.dumps(texts))
                for k, n in sorted(set(found)):
                    hosts.append(name), keys.append(k), pages.append(copy), kinds.append(n)
                for n in sorted(_nodes(name, seen)):
                    hosts.append(None), keys.append(n), pages.append(copy), kinds.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(pages, pa.int64()), pa.array(kinds, pa.int64())], ["host", "key", "page", "node"])

    rows = pages.select("host", "html").mapInArrow(count, "host string, key long, page long, node long").distinct()
    # first by page, so that a text of all pages is added up in the map tasks
    sums = scratch.put(rows.groupBy("host", "key", "node").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "support")
    held = sums.where("node is null").select(F.col("key").alias("node"), F.col("n").alias("pages"))
    texts = sums.where("node is not null").join(held, "node").where(F.col("n") >= SHARE * F.col("pages"))
    return scratch.put(texts.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("template")), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    spark = pages.sparkSession
    arrow_batches(spark, 200)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    learnt = wrappers(rows, Scratch(spark))

    def run(batches):
        known: dict[str, frozenset] = {}
        for batch in batches:
            out = []
            for page, name, template in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("template")):
                if name not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[name] = frozenset(template.as_py() or ())
                out.append(extract(page, name, known[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return rows.join(learnt, "host", "left").select("page_id", "url", "html", "host", "template").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
