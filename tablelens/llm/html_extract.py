"""Main text of web pages with a site style tree.

Every page is parsed into a small DOM. The pages of one host are merged into a style tree:
a node stands for all elements with one path of (tag, class, id), and holds, over the
host's distinct pages, the distribution of its children's layouts (presentation) and of its
texts (content). A node's importance is the entropy of these distributions, relative to the
largest possible; navigation, adverts and notices that a site repeats have hardly any, the
articles have much. Branches below `IMPORTANCE` are removed from each page of a host with at
least `PAGES` distinct pages. Pages are told apart by their content (the texts of the article
or main elements, else of the page, without noise), so copies of one article count once. An
article or main element and what is around it is never removed, and the branches inside it
only if they hold less than half of the page's text: the rest is the article itself.

What a page states itself comes first: an article or main element is the page's content,
and elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments by tag, role or class are removed everywhere. The counts are
grouped sums over (host, path, digest of a text); nothing of a host is gathered.

Defined results: null or empty html, and pages without text, give an empty text; a null
or unreadable url is a host of its own kind (empty); repeated rows are extracted one by
one; unclosed, stray and misnested tags are tolerated."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Importance below which a branch is removed.
IMPORTANCE = 0.1
#: Distinct pages of a host from which its style tree says something.
PAGES = 8
#: Removed branches up to this size are sent to all tasks; more are joined by host.
BROADCAST_BYTES = 8 << 20

# Fixed values of HTML: elements without an end, raw-text elements, elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that an opening of the key closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
DROP_TAGS = frozenset(
    "head script style noscript template nav aside footer form button select option textarea input iframe object embed svg canvas audio video dialog menu title xmp noembed noframes".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
DROP_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies "
    "pagination pager toolbar skip search copyright legal disclaimer".split()
)
#: Inside an article or main, whole class names of containers (and ids, of sections only those
#: of reader comments: other ids there are headings), and of any element but headings.
CONTAINERS = frozenset("div section ul ol dl table details figure fieldset center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENTS = frozenset("comment comments disqus disqus_thread respond replies".split())
ADVERTS = frozenset("ad ads advert advertisement adverts advertising adsense sponsored".split())
PARTS = DROP_WORDS - frozenset("header masthead banner notice notices search skip legal copyright disclaimer consent overlay reply".split()) | COMMENTS

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element: path in the style tree, whether the page itself calls it noise, its
    children (nodes and texts in order), whether it is or holds an article or main."""

    __slots__ = ("tag", "path", "noise", "main", "holds", "children", "key")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, key: str):
        self.tag, self.path, self.noise, self.main, self.key = tag, path, noise, main, key
        self.holds = False
        self.children: list = []


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _is_noise(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in DROP_TAGS or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in DROP_ROLES or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if in_main:
        classes, own = attrs.get("class", "").lower().split(), attrs.get("id", "").strip().lower()
        if tag in ("article", "main") or tag in HEADINGS:
            return False
        if tag in CONTAINERS and (not PARTS.isdisjoint(classes) or own in (COMMENTS if tag == "section" else PARTS)):
            return True
        return not ADVERTS.isdisjoint(classes)
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return tag not in ("html", "body", "article", "main") and not DROP_WORDS.isdisjoint(_WORDS.findall(named))


def parse(source: str) -> Node:
    """A tolerant DOM of a page."""
    root = Node("", "", False, False, "")
    stack, at, raw_end = [root], 0, None
    n = len(source)
    while at < n:
        if raw_end is not None:
            found = raw_end.search(source, at)
            if found is None:
                break
            at, raw_end = found.end(), None
            stack.pop()
            continue
        m = _TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE and any(x.tag in ENDS_P for x in stack[1:] if x.tag) and not any(x.tag == tag for x in stack[_block(stack) :]):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, {"article", "section", "div", "main", "td", "th", "li", "body", "blockquote"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag], {"table", "ul", "ol", "dl", "select"})
        attrs = _attributes(m[3])
        key = tag
        if "class" in attrs or "id" in attrs:
            key = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}".replace("/", "_")
        up = stack[-1]
        # formatting elements left open do not lengthen the paths below them
        path = up.path if tag in INLINE else f"{up.path}/{key}"
        main = up.main or tag in ("article", "main") or attrs.get("role") == "main"
        node = Node(tag, path, _is_noise(tag, attrs, up.main), main, key)
        up.children.append(node)
        if main and not up.main and not node.noise:
            node.holds = True
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in ENDS_P:
            continue
        stack.append(node)
        if tag in RAW:
            raw_end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I)
    return root


def _block(stack: list[Node]) -> int:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag not in INLINE:
            return k
    return 0


def _close(stack: list[Node], tags: set, scope: set) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def blocks(root: Node, removed=frozenset()) -> list[str]:
    """The texts of the page's blocks in order: its article or main elements, or
    the whole page if it has none, without noise and without the removed paths."""
    has_main = _any_main(root)
    whole = _blocks(root, has_main, frozenset())
    if not removed:
        return whole
    rest = _blocks(root, has_main, removed)
    if has_main and 2 * sum(map(len, rest)) <= sum(map(len, whole)):
        return whole
    return rest


def _blocks(root: Node, has_main: bool, removed: frozenset) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append(text)
        parts.clear()

    todo: list = [(root, 0)]
    while todo:
        item, step = todo.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if step == 1:  # behind an element
            if item.tag not in INLINE:
                flush()
            continue
        if item.noise or item.path in removed and item.tag not in INLINE and not item.holds:
            flush()
            continue
        if item.tag == "br":
            flush()
            continue
        if item.tag not in INLINE:
            flush()
        todo.append((item, 1))
        take = item.main or not has_main
        for child in reversed(item.children):
            if isinstance(child, str):
                if take:
                    todo.append((child, 0))
            else:
                todo.append((child, 0))
    flush()
    return out


def _any_main(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.main and not node.noise:
            return True
        if not node.noise:
            todo += [c for c in node.children if not isinstance(c, str)]
    return False


def styles(root: Node) -> tuple[int, list[tuple[str, int, int]]]:
    """The digest of a page's content, and (path, digest of the children's layout, digest of
    the texts) for each style node; elements with one path are taken together."""
    layout: dict[str, list] = {}
    texts: dict[str, list] = {}
    inside: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        if node.path:
            layout.setdefault(node.path, []).append(tuple(dict.fromkeys(c.key for c in node.children if not isinstance(c, str))))
            own = [t for c in node.children if isinstance(c, str) and (t := c.strip())]
            texts.setdefault(node.path, []).extend(own)
            if node.main:
                inside += own
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    content = inside or [t for own in texts.values() for t in own]
    return hash_text("\n".join(content)), [(p, hash_text(repr(layout[p])), hash_text("\n".join(texts[p]))) for p in layout]


def hash_text(text: str) -> int:
    """A 64-bit digest as a signed integer."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def host_of(url: Column) -> Column:
    """The host of an absolute url in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, importance) of the merged trees of all hosts."""
    schema = "host string, path string, page bigint, layout bigint, content bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, nodes = styles(parse(source))
                out += [(host, path, page, layout, text) for path, layout, text in nodes]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "page", "layout", "content"]
            )

    found = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html is not null and html != ''").mapInArrow(run, schema)
    distinct = found.distinct()  # equal contents of a host count once
    # entropy of both distributions from grouped counts: H = log n - sum(c log c) / n
    parts = []
    for name in ("layout", "content"):
        counted = distinct.groupBy("host", "path", name).agg(F.count("*").alias("c"))
        parts.append(
            counted.groupBy("host", "path").agg(
                F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s")
            ).withColumn(f"h_{name}", F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)).drop("s")
        )
    own = parts[0].join(parts[1].drop("n"), ["host", "path"]).select("host", "path", "n", F.greatest("h_layout", "h_content").alias("h"))
    # a branch is as important as the most important node in it
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    branches = own.select("host", F.explode(above).alias("path"), "h").groupBy("host", "path").agg(F.max("h").alias("importance"))
    return own.join(branches, ["host", "path"]).select("host", "path", F.col("n").alias("pages"), "importance")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", importance: float = IMPORTANCE, least_pages: int = PAGES) -> DataFrame:
    """Adds `text` to the pages (a clashing column is overwritten); html goes."""
    low = style_tree(pages, url_col, html_col).where((F.col("pages") >= least_pages) & (F.col("importance") < importance))
    # the few repeated branches of each host, as one list per host
    removed = cut(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("__removed")).withColumnRenamed("host", "__host"))
    size = removed.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(",", "__removed")) + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        removed = F.broadcast(removed)
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    joined = pages.drop("text").join(removed, host_of(F.col(url_col)) == F.col("__host"), "left")
    schema = T.StructType([*[f for f in pages.schema.fields if f.name in rest], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
            gone = batch.column(batch.schema.get_field_index("__removed")).to_pylist()
            texts = [" ".join(blocks(parse(s), frozenset(g or ()))) if s else "" for s, g in zip(sources, gone, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(texts, pa.string())], names=[*rest, "text"]
            )

    return joined.select(*rest, html_col, "__removed").mapInArrow(run, schema)
