"""HTML extraction by a site style tree: branches of little importance on a host's pages are removed."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, save, sized, small_batches

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = RAW | frozenset("head template svg math canvas object audio video select datalist button dialog".split())
CHROME = frozenset("nav footer aside form menu".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words that pages use in class, id and role to name what is not the article.
_ROLE = r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer\w*|masthead|topbar|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w+|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|respond|related|recommend\w*|widgets?|pagination|pager|toolbar|skip|search|contentinfo|navigation|complementary"
ROLE = re.compile(rf"(?:^|[\s_-])(?:{_ROLE})(?:$|[\s_-])", re.IGNORECASE)
#: Inside a main landmark only a whole name of an element that holds others says so.
ROLE_WHOLE = re.compile(rf"(?:^|\s)(?:{_ROLE})(?:$|\s)", re.IGNORECASE)
CONTAINERS = frozenset("div section ul ol dl table fieldset header hgroup details figure center dir".split())
#: A node of a host's style tree of less composite importance is removed with its branch.
LEAST_IMPORTANCE = 0.35
#: Weight of a node's own presentation for each child it has on average: composite = (1 - DAMPING^l) presentation + DAMPING^l content.
DAMPING = 0.9

# A quote opens a value only after '='; elsewhere in a tag it is a letter like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
#: Names that say how a page is laid out, not what an element is.
_ABSENT = re.compile(r"(?:no|has|with|without|hide)[-_]", re.IGNORECASE)
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_ROOT = 1


def _hash(s: str) -> int:
    b = s.encode("utf-8", "surrogatepass")
    return (zlib.crc32(b) << 31) ^ zlib.crc32(b[::-1], 7)


@dataclass
class Node:
    """An element of the page: the hash of its style path (elements with their class or id), its parent, and whether it is
    inside a main landmark, page chrome or hidden. kids: labels of its child elements and texts, in order."""

    tag: str
    path: int
    parent: Node | None
    main: bool = False
    chrome: bool = False
    hidden: bool = False
    kids: list[str] = field(default_factory=list)

    def line(self) -> list[int]:
        """Paths of this node and all above it."""
        out, at = [], self
        while at is not None:
            if not out or out[-1] != at.path:
                out.append(at.path)
            at = at.parent
        return out


@dataclass
class Block:
    """A run of inline text in a node; linked: its letters inside links."""

    node: Node
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _attributes(raw: str) -> tuple[str, bool]:
    """The words of class, id and role, and whether the element says it is hidden."""
    names, hidden = [], False
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            names += [w for w in value.split() if not _ABSENT.match(w)]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
            hidden = True
    return " ".join(names), hidden


def parsed(page: str) -> tuple[list[Block], list[Node]]:
    """The page's visible text blocks and its nodes, in order. Unclosed, misnested and cut-off markup is read as browsers
    read it: a new block closes an open paragraph, an end tag closes what is open inside it, and one that fits nothing is skipped."""
    out: list[Block] = []
    root = Node("", _ROOT, None)
    nodes, stack, opened = [root], [root], Counter()
    now: Block | None = None
    at, end, links = 0, len(page), 0

    def text(piece: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.hidden or not piece:
            return
        if now is None:
            if not piece.strip():
                return
            while top.tag in INLINE:
                top = top.parent
            now = Block(top)
            top.kids.append("#")
            out.append(now)
        now.text.append(piece)
        now.linked += len(piece) if links else 0

    def close(to: int) -> None:
        nonlocal now, links
        for x in stack[to:]:
            opened[x.tag] -= 1
            if x.tag == "a":
                links -= 1
            if x.tag not in INLINE:
                now = None
        del stack[to:]

    while at < end:
        cut = page.find("<", at)
        if cut < 0:
            text(page[at:])
            break
        if cut > at:
            text(page[at:cut])
        m = _TOKEN.match(page, cut)
        if m is None:
            text("<")
            at = cut + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            elif tag == "p":
                now = None
            continue
        if tag in CLOSES_P:
            if opened["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
        elif tag in SIBLINGS:
            mates, stops = SIBLINGS[tag]
            mates = mates.split()
            if any(opened[x] for x in mates):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in mates:
                        close(i)
                        break
                    if stack[i].tag in stops:
                        break
        if tag == "br":
            text(" ")
        if tag not in INLINE:
            now = None
        if tag in VOID:
            continue
        names, hidden = _attributes(m[3]) if m[3] and not m[3].isspace() else ("", False)
        up = stack[-1]
        if tag in INLINE:
            node = Node(tag, up.path, up, up.main, up.chrome, up.hidden or hidden)
        else:
            chrome = tag in CHROME or tag == "header" and not up.main
            if names and not chrome and tag not in ("html", "body", *MAIN):
                chrome = bool(ROLE_WHOLE.search(names) if up.main else ROLE.search(names)) and (tag in CONTAINERS or not up.main)
            label = tag + ("." + re.sub(r"\d+", "0", names) if names else "")
            hidden = up.hidden or hidden or tag in HIDDEN
            if not hidden:
                up.kids.append(label)
            node = Node(tag, _hash(f"{up.path}>{label}"), up, up.main or tag in MAIN, up.chrome or chrome, hidden)
            nodes.append(node)
        stack.append(node)
        opened[tag] += 1
        links += tag == "a"
        if tag in RAW and not m[3].rstrip().endswith("/") and (tag in ("textarea", "noscript", "title") or node.hidden):
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else end
    return [b for b in out if _flat(b)], [x for x in nodes if x.kids]


def _flat(b: Block) -> str:
    """Character references decoded, white space made one space, trimmed."""
    return " ".join(html.unescape("".join(b.text)).split())


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a page that is not hidden: host, the paths from the node up, the hash of its children's labels (0: it is
    a block), their number, the hash of a block's text, and the page's. A page is known by the text of its main landmark or,
    without one, by all its text, so copies of an article that differ outside of it count once."""
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("host", "line", "kids", "n", "text", "page")}
        for site, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, nodes = parsed(page or "")
            flats = [_flat(b) for b in found]
            own = [f for f, b in zip(flats, found, strict=True) if b.node.main] or flats
            key = _hash("\n".join(own))
            seen: set[tuple] = set()
            each = [(x.node.line(), 0, 0, _hash(f)) for x, f in zip(found, flats, strict=True)]
            each += [(x.line(), _hash(" ".join(x.kids)), len(x.kids), 0) for x in nodes]
            for line, kids, n, text in each:
                if (k := (line[0], kids, text)) not in seen:
                    seen.add(k)
                    for c, v in zip(rows.values(), (site, line, kids, n, text, key), strict=True):
                        c.append(v)
        kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, importance, m) of the nodes of each host's merged tree, on m different pages.

    Presentation importance of a node is the entropy, to the base m, of the sequences of children it has on the m pages.
    A content feature (a block's text) on n of the m pages has entropy log n / log m there; a block node's content importance
    is 1 less the mean entropy of its features' occurrences, and another node's is the mean of the block nodes below it by
    their occurrences. Composite importance is (1 - DAMPING^l) presentation + DAMPING^l content for a node of l children on
    average. A node on a single page has importance 1; pages with the same article count once. All nodes take part, also
    those in main landmarks and page chrome. Sums are partial before each exchange, so a host of any share of the pages is no
    hot spot.
    """
    small_batches(pages.sparkSession)
    seen = pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_features, "host string, line array<long>, kids long, n long, text long, page long")
    seen = save(seen, "nodes")
    blocks = seen.where("kids = 0").select("host", F.get("line", F.lit(0)).alias("path"), "line", "text", "page")
    pages_of = lambda df: df.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("m"))
    m = save(pages_of(seen.select("host", F.get("line", F.lit(0)).alias("path"), "page")), "m")
    feature = blocks.select("host", "path", "text", "page").distinct().groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    feature = feature.join(sized(m, 64), ["host", "path"]).groupBy("host", "path").agg(F.sum("n").alias("weight"), (1 - F.sum(F.col("n") * F.log("n") / base) / F.sum("n")).alias("content"))
    lines = blocks.select("host", "path", "line").distinct()
    above = save(feature.join(lines, ["host", "path"]).select("host", F.explode("line").alias("path"), "weight", "content"), "above")
    content = above.groupBy("host", "path").agg((F.sum(F.col("weight") * F.col("content")) / F.sum("weight")).alias("content"))
    styles = seen.where("kids <> 0").select("host", F.get("line", F.lit(0)).alias("path"), "kids", "n", "page").distinct()
    styles = styles.groupBy("host", "path", "kids").agg(F.count("*").alias("k"), F.max("n").alias("n")).join(sized(m, 64), ["host", "path"])
    style = styles.groupBy("host", "path").agg(
        (F.sum(F.col("k") * F.col("n")) / F.sum("k")).alias("children"),
        ((F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")) / F.max(base)).alias("presentation"),
    )
    share = F.pow(F.lit(DAMPING), F.coalesce("children", F.lit(0.0)))
    composite = (1 - share) * F.least(F.lit(1.0), F.coalesce("presentation", F.lit(0.0))) + share * F.col("content")
    out = content.join(style, ["host", "path"], "left").join(m, ["host", "path"])
    return save(out.select("host", "path", F.when(F.col("m") > 1, composite).otherwise(1.0).alias("importance"), "m"), "tree")


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The blocks of the article: those outside page chrome (importance 0) that are on no branch of
    low importance in the host's style tree (a branch is, if its top and all below are; so a block is if its own node is). In a main landmark the tree's finding holds if it leaves at least half of the landmark's text: else the
    host's articles are themselves much alike. A main landmark is the article if it holds at least as much text as
    the blocks outside of it, of which runs of two or more that are mostly link text are lists of links."""
    found = [b for b in parsed(page or "")[0] if not b.node.chrome]
    keep = [b.node.path not in low for b in found]
    size = [len(_flat(b)) for b in found]
    inside = [i for i, b in enumerate(found) if b.node.main]
    if 2 * sum(size[i] for i in inside if keep[i]) < sum(size[i] for i in inside):
        for i in inside:
            keep[i] = True
    linked = [2 * b.linked > sum(map(len, b.text)) and not b.node.main for b in found]
    for i, x in enumerate(linked):
        if x and (i and linked[i - 1] or i + 1 < len(linked) and linked[i + 1]):
            keep[i] = False
    chosen = [i for i in inside if keep[i]]
    outside = [i for i, b in enumerate(found) if keep[i] and not b.node.main]
    if sum(size[i] for i in chosen) < sum(size[i] for i in outside):
        chosen = sorted([*chosen, *outside])
    return "\n".join(_flat(found[i]) for i in chosen)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(p, frozenset(low or ())) for p, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


#: Of so many different pages at least, entropies say something.
LEAST_PAGES = 4


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html): the article's blocks, joined by line feeds.

    Null or empty html gives an empty text; a null url belongs to the host '' with others of its kind; rows that repeat an
    id or a page are rows like any other, and equal pages count once in the tree; pages of any length and depth are read
    whole; other columns are ignored; an empty table gives an empty table.
    """
    tree = style_tree(pages)
    low = save(tree.where(f"m >= {LEAST_PAGES} and importance < {LEAST_IMPORTANCE}").groupBy("host").agg(F.collect_set("path").alias("low")), "low")
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url").cast("string")).alias("host"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string"
    return own.join(sized(low, 4096), "host", "left").select("page_id", "url", "html", "low").mapInArrow(_extracted, schema)
