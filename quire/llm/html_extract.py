"""HTML extraction with a site style tree.

Pages of a host are merged into a tree whose nodes are the paths of elements (tag,
classes, id).  Over the distinct pages of the host a node has the entropy of its
presentation (the sequence of its children) and of its content (the text below
it), each divided by its largest value; what looks and reads the same on page
after page has little importance, and such branches are cut from every page of
the host, inside the article as well.  The blocks of a node are content nodes of their
own: one that reads the same on more than half of the host's pages goes.  The lists
here hold only what a page itself declares: elements that are never text (scripts, forms, media),
HTML's own elements and roles for what stands beside the text (nav, footer, aside and the like),
and the usual whole class names and ids of reader comments, adverts and notices, whose texts differ from
page to page, so that entropy cannot tell them from the article.  What is left of the article, or of
the body where there is none, is the main text.

The tree is two sums over (host, node, value) with partial sums on the map side;
copies of a page count once; what returns to the pages is one short list of nodes
for each host: broadcast if their measured size is within a bound, else by an outer
join that Spark splits where a host is large.

Edge cases: null and empty pages give an empty text; unclosed and misnested tags
close as in HTML; text outside any tag is kept; a node is judged when it is on
``min_pages`` distinct pages of its host, so a host with fewer has no tree; null urls are one host;
pages of any length and depth, in linear time; an empty table gives an empty result; added columns replace
those of the same name.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import checkpoint, join_checked, map_batches
from quire.llm.line_dedup import host_of

#: A node on at least so many distinct pages of its host is judged; below this importance it goes.
MIN_PAGES, LEAST_IMPORTANCE, CONTENT_SHARE = 8, 0.2, 0.8
#: A block on more than this share of its host's pages goes.
MAX_REPEATED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never text.
_DROP = frozenset(
    "head script style title noscript template iframe noembed noframes object applet embed svg canvas audio video map form button select "
    "textarea datalist nav footer aside dialog menu".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole class names and ids of adverts, notices and reader comments.
_DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner cookie cookies cookie-banner cookie-notice cookie-consent consent newsletter "
    "comment comments comment-list commentlist comment-section comments-section disqus disqus_thread respond sidebar breadcrumb breadcrumbs share "
    "social-share related related-posts related-articles pagination popup modal".split()
)
#: Of the article's own header only these stay.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the given kinds; the search stops at any of the third group.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children", "path")

    def __init__(self, tag: str, attributes: str, parent_path: int):
        self.tag, self.children = tag, []
        self.names, self.role, self.hidden, mark = frozenset(), "", False, tag
        if attributes and not attributes.isspace():
            found = {}
            for k, v in _ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), html.unescape(v.strip("\"'")))
            kind, own = found.get("class", ""), found.get("id", "")
            self.names = frozenset(f"{kind} {own}".lower().split())
            self.role, self.hidden = found.get("role", "").lower(), "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
            mark = f"{tag}.{'.'.join(sorted(kind.split()))}#{re.sub('[0-9]+', '0', own)}"
        self.path = _hash(f"{parent_path}/{mark}")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Start tags of blocks end an open p unless one of these is open inside it.
_KEEPS_P = ("button", "table", "td", "th")


class Open:
    """The open elements; where those of a tag, and the blocks, stand among them."""

    def __init__(self, root: Node):
        self.nodes, self.where, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCK:
            self.blocks.append(at)
        self.nodes.append(node)

    def close(self, at: int) -> None:
        """Ends the element at a place and all inside it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.where[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Where the innermost open element of these tags stands; 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.where.get(t))), default=0)

    def first_after(self, tags, at: int) -> int:
        """Where the outermost of these inside the place stands; 0 if there is none."""
        found = [own[k] for t in tags if (own := self.where.get(t)) and (k := bisect_right(own, at)) < len(own)]
        return min(found, default=0)


def parse(page: str) -> Node:
    """The element tree of a page; text nodes are strings.  Nesting is a stack, so depth costs no recursion."""
    root = Node("#root", "", 0)
    stack, at, end = Open(root), 0, page.rfind(">") + 1
    while True:
        token = _TOKEN.search(page, at, end) if at < end else None
        if token is None:
            rest = page[at:].partition("<!--")[0]  # no tag ends any more
            if rest:
                stack.nodes[-1].children.append(html.unescape(rest))
            return root
        if token.start() > at:
            stack.nodes[-1].children.append(html.unescape(page[at : token.start()]))
        at = token.end()
        if token[0].startswith("<!--") and not token[0].endswith("-->"):
            return root
        if token[1]:
            tag = token[1].lower()
            depth = stack.last((tag,))
            # an end tag of an inline element does not close blocks
            if depth and (tag in _BLOCK or not (stack.blocks and stack.blocks[-1] > depth)):
                stack.close(depth)
            continue
        tag, attributes = (token[2] or token[4] or "").lower(), token[3] or token[5] or ""
        if not tag:
            continue
        if tag in _BLOCK and (depth := stack.last(("p",))) > stack.last(_KEEPS_P):
            stack.close(depth)
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            if depth := stack.first_after(ends, stack.last(stops)):
                stack.close(depth)
        node = Node(tag, attributes, stack.nodes[-1].path)
        stack.nodes[-1].children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            node.children.append(page[at : stop.start()])
            at = stop.end()
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.push(node)


def walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes in page order: (node, True) where it starts, (node, False) where it ends, (text, True)."""
    stack: list = [(root, True)]
    while stack:
        node, starts = stack.pop()
        yield node, starts
        if starts and isinstance(node, Node):
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children))


def block_key(path: int, text: str) -> int:
    """What stands for a block of a node among the nodes."""
    return _hash(f"{path}={text}")


def style_values(page: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(path, hash of the children's tags, hash of the text below) for each path of the page, equal paths joined; and the
    keys of its blocks: elements with text of their own."""
    shapes: dict[int, list[str]] = {}
    texts: dict[int, list[int]] = {}
    keys: set[int] = set()
    below: list[list[int]] = []  # hashes of the texts and elements inside each open element
    for node, starts in walk(parse(page)):
        if isinstance(node, str):
            bare = " ".join(node.split())
            if bare:
                below[-1].append(_hash(bare))
        elif starts:
            shapes.setdefault(node.path, []).append(" ".join(c.tag for c in node.children if isinstance(c, Node)))
            below.append([])
        else:
            own = below.pop()
            if own:
                content = _hash(",".join(map(str, own)))
                texts.setdefault(node.path, []).append(content)
                if below:
                    below[-1].append(content)
                if node.tag in _BLOCK and any(isinstance(c, str) and not c.isspace() for c in node.children):
                    keys.add(block_key(node.path, str(content)))
    return [(p, _hash("|".join(s)), _hash(",".join(map(str, texts[p])))) for p, s in shapes.items() if p in texts], list(keys)


def contents(root: Node) -> dict[int, int]:
    """The hash of the text below each element, by identity, as ``style_values`` has it."""
    found: dict[int, int] = {}
    below: list[list[int]] = []
    for node, starts in walk(root):
        if isinstance(node, str):
            bare = " ".join(node.split())
            if bare:
                below[-1].append(_hash(bare))
        elif starts:
            below.append([])
        else:
            own = below.pop()
            if own:
                found[id(node)] = _hash(",".join(map(str, own)))
                if below:
                    below[-1].append(found[id(node)])
    return found


def importance(n: str = "n", logs: str = "logs"):
    """Entropy of a value over the pages of a node, as a share of its largest: sums of n and of n log n suffice."""
    total = F.sum(n)
    return (F.log(total) - F.sum(logs) / total) / F.log(total)


def low_nodes(pages: DataFrame, min_pages: int = MIN_PAGES, least: float = LEAST_IMPORTANCE, repeated: float = MAX_REPEATED) -> DataFrame:
    """``__host`` and ``__low``: the paths of its unimportant nodes and the keys of its repeated blocks."""
    adds = T.StructType(
        [T.StructField("copy", T.LongType()), T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("path", "shape", "text")])))]
        + [T.StructField("blocks", T.ArrayType(T.LongType()))]
    )

    def run(htmls) -> list:
        got = [x or "" for x in htmls.to_pylist()]
        values = [style_values(x) for x in got]
        return [[_hash(x) for x in got], [[dict(zip(("path", "shape", "text"), v)) for v in own] for own, _ in values], [keys for _, keys in values]]

    rows = map_batches(pages.select("__host", "html"), lambda: run, ["html"], adds).select("__host", "copy", "nodes", "blocks")
    # one row each for the values of a copy's nodes; a block's key is a node of the third kind
    kind = lambda k, path, value: F.struct(F.lit(k).alias("kind"), path.alias("path"), value.alias("value"))
    none = F.lit(0).cast("long")
    values = F.concat(
        F.transform("nodes", lambda x: kind(0, x["path"], x["shape"])), F.transform("nodes", lambda x: kind(1, x["path"], x["text"])),
        F.transform("blocks", lambda x: kind(2, x, none)), F.array(kind(3, none, none)),
    )
    distinct = rows.groupBy("__host", "copy").agg(F.first(values).alias("values"))
    counts = distinct.select("__host", F.inline("values")).groupBy("__host", "kind", "path", "value").agg(F.count("*").alias("n"))
    counts = checkpoint(counts.where((F.col("kind") != 2) | (F.col("n") >= min_pages)))
    judged = counts.where("kind < 2").withColumn("logs", F.col("n") * F.log("n")).groupBy("__host", "path", "kind").agg(F.sum("n").alias("pages"), importance().alias("h")).where(F.col("pages") >= min_pages)
    both = judged.groupBy("__host", "path").agg(F.sum(F.col("h") * F.when(F.col("kind") == 1, CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)).alias("importance"))
    size = counts.where("kind = 3").select("__host", F.col("n").alias("pages"))
    blocks = counts.where("kind = 2").join(size, "__host").where(F.col("n") > F.lit(repeated) * F.col("pages")).select("__host", "path")
    return both.where(F.col("importance") < least).select("__host", "path").unionByName(blocks).groupBy("__host").agg(F.collect_list("path").alias("__low"))


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """Text of the article (of the body, where there is none) without the branches that go; blocks joined by two newlines."""
    root = parse(page)
    content = contents(root) if low else {}

    def cut(node: Node, inside: bool, nested: bool) -> bool:
        if node.tag in _DROP or node.hidden or node.role in _DROP_ROLES:
            return True
        if node.tag in ("#root", "main", "body", "html") or node.tag == "article" and not nested:
            return False
        if node.names & _DROP_NAMES or not inside and node.tag == "header":
            return True
        return node.path in low or node.tag in _BLOCK and id(node) in content and block_key(node.path, str(content[id(node)])) in low

    def regions(whole: bool) -> str:
        """Text of the kept blocks; with ``whole`` all of the page is the article."""
        blocks: list[str] = []
        inline: list[str] = []
        state: list[tuple[bool, bool, bool]] = [(whole, False, False)]  # inside the text; inside its header; inside an article element
        skip = None

        def end_block() -> None:
            text = " ".join("".join(inline).split())
            inline.clear()
            if text:
                blocks.append(text)

        for node, starts in walk(root):
            if skip is not None:
                if node is skip and not starts:
                    skip = None
                continue
            inside, header, nested = state[-1]
            if isinstance(node, str):
                if inside and not header:
                    inline.append(node)
                continue
            if starts:
                if cut(node, inside and not whole, nested):
                    if node.tag in _BLOCK:
                        end_block()
                    skip = node
                    continue
                inside = inside or node.tag in ("article", "main") or node.role in ("main", "article")
                header = (header or inside and not whole and node.tag == "header") and node.tag not in _HEADINGS
                state.append((inside, header, nested or node.tag == "article"))
                if node.tag == "br":
                    inline.append(" ")
            else:
                state.pop()
            if node.tag in _BLOCK:
                end_block()
        end_block()
        return "\n\n".join(blocks)

    declared = any(isinstance(n, Node) and s and (n.tag in ("article", "main") or n.role == "main") for n, s in walk(root))
    return (regions(False) if declared else "") or regions(True)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, least: float = LEAST_IMPORTANCE, repeated: float = MAX_REPEATED) -> DataFrame:
    """``pages`` (url, html and more) with ``text`` and ``n_chars``."""
    hosted = pages.withColumn("__host", F.coalesce(host_of(F.col("url")), F.lit("")))
    low = checkpoint(low_nodes(hosted, min_pages, least, repeated))
    joined = join_checked(hosted, low, "__host", "left", F.octet_length("__host") + 8 * F.size("__low") + 16)
    adds = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(htmls, lows) -> list:
        texts = [main_text(h or "", frozenset(low or ())) for h, low in zip(htmls.to_pylist(), lows.to_pylist())]
        return [texts, [len(t) for t in texts]]

    return map_batches(joined, lambda: run, ["html", "__low"], adds).drop("__host", "__low")
