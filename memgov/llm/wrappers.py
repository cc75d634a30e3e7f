"""Main text of web pages by wrapper induction.

Pages of one host that are made of the same containers have one layout. Every page is aligned with the
largest page of its layout by simple tree matching, which finds the largest order-preserving match of two
trees, and counts are kept for every node over all pages: how many have it, and how many with the same text.
Text that nearly all of them repeat is template, what varies is a slot. The part of the tree whose slots hold
most of the text is where the layout keeps its content. Text in slots is content, text that the template
repeats is not, and neither are menus, notices, adverts, forms and the like, by the names of their elements.

A page is parsed once: its aligned tree is written, its counts with it, and the text is read off that tree
when the counts of all pages are known.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.session import cut_lineage

FEW_PAGES = 4  # pages that a layout needs for a wrapper of its own; rarer ones take that of the host's commonest layout
COPY = 0.8  # of the reference's text that a page has to repeat to count as its copy
SURE = 3  # pages that have to agree before text inside the article counts as template
OFTEN, AGREE = 0.5, 0.9  # share of a layout's pages that have a template node, and of those that have its text
SHARE = 0.6  # of the varying text that a child has to hold to be followed towards the content
BAND, CELLS = 64, 40_000  # children are matched within this many places of the diagonal at first, more while the table stays this small
NARROW = 64  # rows of a table below this length are filled one by one
HELD = 64  # layouts whose trees and counts a worker holds at once

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp"
                   " small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                     " header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr", "td", "th"),
            "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIERS = frozenset("article aside blockquote body button caption div footer form header html li main nav object section table td th"
                     " ul ol dl".split())
# Elements and names of elements that never hold main text.
ASIDE = frozenset("nav footer aside form script style noscript template iframe object svg math canvas button select textarea"
                  " input menu dialog head title audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay"
    r"|sidebar|side|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|footer|footnav|masthead|topbar|toolbar|comments?|commentlist|respond"
    r"|replies|reply|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|skip\w*)(?:$|[\s_-])")


class Node:
    __slots__ = ("tag", "name", "text", "kids", "shape", "size", "constant", "at", "chars")

    def __init__(self, tag: str, name: str = "", text: str = ""):
        self.tag, self.name, self.text, self.kids = tag, name, text, []
        self.shape, self.size, self.constant, self.at, self.chars = 0, 1, False, -1, -1


class _Builder(HTMLParser):
    """A tree from any input: missing end tags are supplied where HTML implies them, strays are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.depths = Counter()  # open elements by tag

    def _close(self, tags, barriers) -> None:
        if not any(self.depths[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.depths.subtract(n.tag for n in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), BARRIERS)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], ("table", "ul", "ol", "dl", "select", "body"))
        named = [v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")]
        if any(k == "hidden" for k, _ in attrs):
            named.append("skip-hidden")
        node = Node(tag, " ".join(named).lower())
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depths[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "circle", "rect", "use"):
            self.open.pop()
            self.depths[tag] -= 1

    def handle_endtag(self, tag):
        self._close((tag,), ("td", "th", "body", "html") if tag in INLINE or tag == "p" else ("html",))

    def handle_data(self, data):
        if data:
            kids = self.open[-1].kids
            if kids and kids[-1].tag == "#text":
                kids[-1].text += data
            else:
                kids.append(Node("#text", "", data))


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    settle(builder.root)
    return builder.root


def settle(root: Node) -> None:
    """Drop white space between elements; give every node its size and a hash of its shape."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.kids)
    for node in reversed(order):
        if node.kids:
            node.kids = [k for k in node.kids if k.tag != "#text" or k.text.strip() or any(x.tag in INLINE for x in node.kids)]
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = hash((node.tag, *(k.shape for k in node.kids)))


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest match of two trees with equal roots."""
    out: list[tuple[Node, Node]] = []
    memo: dict[tuple[int, int], int] = {}
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.tag != y.tag:
            continue
        out.append((x, y))
        stack.extend(_match_kids(x.kids, y.kids, memo))
    return out


def _same_ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many first and last children have the same shapes; matching them is never worse."""
    n, first = min(len(xs), len(ys)), 0
    while first < n and xs[first].shape == ys[first].shape:
        first += 1
    last = 0
    while last < n - first and xs[-1 - last].shape == ys[-1 - last].shape:
        last += 1
    return first, last


def _between(a: Node, b: Node) -> tuple[list[Node], list[Node], int]:
    """The children between the ends that have the same shapes, and the nodes of those ends."""
    first, last = _same_ends(a.kids, b.kids)
    same = sum(k.size for k in a.kids[:first]) + sum(k.size for k in a.kids[len(a.kids) - last:])
    return a.kids[first:len(a.kids) - last], b.kids[first:len(b.kids) - last], same


def _width(n: int) -> int:
    return max(BAND, CELLS // max(n, 1))


def _bands(n: int, m: int, wide: int) -> list[tuple[int, int]]:
    """First and last column of each row of the table of n by m children."""
    return [(max(0, i * m // max(n, 1) - wide), min(m, i * m // max(n, 1) + wide)) for i in range(n + 1)]


def _plain(a: Node, b: Node) -> int | None:
    """Matched nodes of two trees where no table is needed."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    return 1 if not a.kids or not b.kids else None


class _Table:
    """Nodes matched by the first i and the first j children. What lies left of the band is 0, what lies right its last value."""

    def __init__(self, xs: list[Node], ys: list[Node], memo: dict[tuple[int, int], int], wide: int):
        self.sizes = [list(itertools.accumulate((k.size for k in kids), initial=0)) for kids in (xs, ys)]
        self.bands = _bands(len(xs), len(ys), wide)
        if max(hi - lo for lo, hi in self.bands) < NARROW:
            self._fill(xs, ys, memo)
        else:
            self._fill_wide(xs, ys, memo)

    def _fill(self, xs, ys, memo) -> None:
        self.rows = [[0] * (self.bands[0][1] + 1)]
        for i, x in enumerate(xs, 1):
            lo, hi = self.bands[i]
            above, (start, end) = self.rows[-1], self.bands[i - 1]
            row, left = [], 0
            for j in range(lo, hi + 1):
                left = max(left, above[min(j, end) - start])
                if j:
                    y = ys[j - 1]
                    own = _plain(x, y)
                    own = memo[x.shape, y.shape] if own is None else own
                    if own:
                        left = max(left, own + (above[min(j - 1, end) - start] if j > start else 0))
                row.append(left)
            self.rows.append(row)

    def _fill_wide(self, xs, ys, memo) -> None:
        """The same, a row at a time."""
        kinds = {y.shape: y for y in ys}
        spots = {shape: k for k, shape in enumerate(kinds)}
        codes, known = np.array([spots[y.shape] for y in ys]), {}
        self.rows = [np.zeros(self.bands[0][1] + 1, np.int32)]
        for i, x in enumerate(xs, 1):
            if x.shape not in known:
                plain = [(y, _plain(x, y)) for y in kinds.values()]
                known[x.shape] = np.array([memo.get((x.shape, y.shape), 0) if own is None else own for y, own in plain], np.int32)
            lo, hi = self.bands[i]
            start, end = self.bands[i - 1]
            # The row above from the column before the first one here; what lies right of it is its last value.
            above = self.rows[-1]
            above = np.concatenate([np.zeros(max(0, start - lo + 1), np.int32), above[max(0, lo - 1 - start):], np.repeat(above[-1:], max(0, hi - end))])
            row = above[1:].copy()
            first = max(lo, 1)
            own = known[x.shape][codes[first - 1:hi]]
            row[first - lo:] = np.maximum(row[first - lo:], np.where(own > 0, above[first - lo:-1] + own, 0))
            self.rows.append(np.maximum.accumulate(row))

    def value(self, i: int, j: int) -> int:
        lo, hi = self.bands[i]
        return 0 if j < lo else int(self.rows[i][min(j, hi) - lo])

    def is_largest(self) -> bool:
        """Whether no match outside the band can be larger: before and after the first place outside it, no more
        than the fewer nodes of the two sides can match."""
        (before_x, before_y), m = self.sizes, len(self.sizes[1]) - 1
        found = self.value(len(before_x) - 1, m)
        last_lo = 0
        for i, (lo, hi) in enumerate(self.bands):
            for j in (*range(last_lo, lo), *range(hi + 1, min(hi + 2, m + 1))):
                if found < min(before_x[i], before_y[j]) + min(before_x[-1] - before_x[i], before_y[-1] - before_y[j]):
                    return False
            last_lo = lo
        return True


def _open_pairs(xs: list[Node], ys: list[Node], memo: dict[tuple[int, int], int], wide: int) -> list[tuple[Node, Node]]:
    """Pairs of children whose weight is not known yet, one of each pair of shapes, since weights follow from shapes:
    all in the band, or of any shapes where those are fewer."""
    bands, kinds = _bands(len(xs), len(ys), wide)[1:], [{k.shape: k for k in kids}.values() for kids in (xs, ys)]
    if len(kinds[0]) * len(kinds[1]) <= sum(hi - lo for lo, hi in bands):
        pairs = itertools.product(*kinds)
    else:
        pairs = ((x, y) for x, (lo, hi) in zip(xs, bands, strict=True) for y in ys[max(lo - 1, 0):hi])
    found = {(x.shape, y.shape): (x, y) for x, y in pairs if _plain(x, y) is None and (x.shape, y.shape) not in memo}
    return list(found.values())


def _weigh(pairs: list[tuple[Node, Node]], memo: dict[tuple[int, int], int]) -> None:
    """Weights of these pairs and of all that they need, children first, at any depth.

    A band grows until nothing outside it can be larger, at last to the whole table.
    """
    stack, widths = list(pairs), {}
    while stack:
        x, y = stack[-1]
        if (x.shape, y.shape) not in memo:
            xs, ys, same = _between(x, y)
            wide = widths.get((x.shape, y.shape), _width(len(xs)))
            first = _open_pairs(xs, ys, memo, wide)
            if first:
                stack.extend(first)
                continue
            table = _Table(xs, ys, memo, wide) if xs and ys else None
            if table is not None and not table.is_largest():
                widths[x.shape, y.shape] = 2 * wide
                continue
            memo[x.shape, y.shape] = 1 + same + (table.value(len(xs), len(ys)) if table is not None else 0)
        stack.pop()


def weight(a: Node, b: Node) -> int:
    """Matched nodes of two trees."""
    memo: dict[tuple[int, int], int] = {}
    own = _plain(a, b)
    if own is None:
        _weigh([(a, b)], memo)
        own = memo[a.shape, b.shape]
    return own


def _match_kids(xs: list[Node], ys: list[Node], memo: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    first, last = _same_ends(xs, ys)
    pairs = list(zip(xs[:first], ys[:first], strict=True))
    pairs += zip(xs[len(xs) - last:], ys[len(ys) - last:], strict=True)
    xs, ys = xs[first:len(xs) - last], ys[first:len(ys) - last]
    if xs and ys:
        wide, table = _width(len(xs)), None
        while table is None or not table.is_largest():
            _weigh(_open_pairs(xs, ys, memo, wide), memo)
            table = _Table(xs, ys, memo, wide)
            wide *= 2
        i, j = len(xs), len(ys)
        while i and j:
            here = table.value(i, j)
            if here == table.value(i - 1, j):
                i -= 1
            elif here == table.value(i, j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
    return pairs


def is_aside(node: Node, in_article: bool) -> bool:
    if node.tag in ASIDE or (node.tag == "header" and not in_article):
        return True
    if not node.name or node.tag in ("html", "body", "article", "main"):
        return False
    return any(w in ROLES for w in node.name.split()) or ASIDE_NAME.search(node.name) is not None


def text_nodes(root: Node):
    """(text node, whether it is in an article) outside elements that never hold main text."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        if node.tag == "#text":
            yield node, inside
        elif not is_aside(node, inside):
            stack.extend((k, inside) for k in reversed(node.kids))


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def packed(rows: list) -> bytes:
    return zlib.compress(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 1)


def skeleton(html: str) -> bytes:
    """A reference page for alignment: its tree in document order with a hash and the length in place of each text."""
    rows, stack = [], [(parse(html), 0)]
    while stack:
        node, depth = stack.pop()
        rows.append((depth, len(node.text.strip()), digest(node.text)) if node.tag == "#text" else (depth, node.tag, node.name))
        stack.extend((k, depth + 1) for k in reversed(node.kids))
    return packed(rows)


@functools.lru_cache(HELD)
def reference(data: bytes) -> tuple[Node, dict[int, int]]:
    """The tree of a skeleton with its nodes numbered, and the lengths of the texts outside what is never main text."""
    path: list[Node] = []
    for at, (depth, first, second) in enumerate(json.loads(zlib.decompress(data))):
        if isinstance(first, int):
            node = Node("#text", "", second)
            node.chars = first
        else:
            node = Node(first, second)
        node.at = at
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    settle(path[0])
    return path[0], {t.at: t.chars for t, _ in text_nodes(path[0])}


def align(html: str, wrapper: bytes) -> tuple[Node, list[int], list[int], bool]:
    """A page's tree with the numbers of the reference's nodes, its text nodes there, those with equal text, and if it is a copy.

    A text node whose text differs from the reference's has no number. Pages that repeat most of the
    reference's text are copies and tell nothing about the template.
    """
    root, lengths = reference(wrapper)
    total = sum(lengths.values())
    page = parse(html)
    seen, equal = [], []
    for x, y in match(root, page):
        if x.tag != "#text":
            y.at = x.at
            continue
        seen.append(x.at)
        if x.text == digest(y.text):
            y.at = x.at
            equal.append(x.at)
    copy = total > 0 and sum(lengths.get(i, 0) for i in equal) > COPY * total
    return page, seen, equal, copy


def template_of(wrapper: bytes, pages: int, seen: dict[int, int], equal: dict[int, int]) -> tuple[int, list[int]]:
    """The number of the element that holds the content, and those of the template's text nodes.

    `pages` have been aligned, so many of them have each node, and so many of those with the same text.
    """
    root, _ = reference(wrapper)
    constant, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        if node.tag == "#text":
            often = seen.get(node.at, 0)
            node.constant = (often >= max(SURE if inside else 1, OFTEN * pages) and equal.get(node.at, 0) >= AGREE * often)
            if node.constant:
                constant.append(node.at)
        stack.extend((k, inside) for k in node.kids)
    return content_of(root).at, constant


def content_of(root: Node) -> Node:
    """The element that holds the main text: an article or main element, else where the varying text is."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main") or "main" in node.name.split()
        order.append((node, inside))
        stack.extend((k, inside) for k in node.kids)
    mass: dict[int, int] = {}
    for node, inside in reversed(order):
        if node.tag == "#text":
            mass[id(node)] = 0 if node.constant else node.chars if node.chars >= 0 else len(node.text.strip())
        else:
            mass[id(node)] = sum(mass[id(k)] for k in node.kids if mass[id(k)] and not is_aside(k, inside))
    best, stack = None, [root]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main") or "main" in node.name.split():
            if best is None or mass[id(node)] > mass[id(best)]:
                best = node
        elif not is_aside(node, False):
            stack.extend(node.kids)
    if best is not None and mass[id(best)]:
        return best
    node = root
    while True:
        whole = mass[id(node)]
        following = [k for k in node.kids if k.kids and k.tag not in INLINE and k.tag != "p" and mass[id(k)] >= SHARE * whole > 0
                     and not is_aside(k, False)]
        if not following:
            return node
        node = following[0]


def blocks_of(content: Node) -> str:
    """Text of the blocks in page order: white space in one is a single space, one line each.

    A block is template only as a whole: one with any varying text is kept with its constant words.
    """
    blocks, current, varies = [], [], False

    def end():
        nonlocal varies
        text = " ".join("".join(current).split())
        if text and varies:
            blocks.append(text)
        current.clear()
        varies = False

    stack: list[tuple[Node | None, bool]] = [(content, True)]
    while stack:
        node, opening = stack.pop()
        if not opening:
            end()
        elif node.tag == "#text":
            current.append(node.text)
            varies = varies or not (node.constant or node.text.isspace())
        elif node.tag == "br":
            current.append(" ")
        elif node is content or not is_aside(node, True):
            if node.tag not in INLINE:
                end()
                stack.append((node, False))
            stack.extend((k, True) for k in reversed(node.kids))
    end()
    return "\n".join(blocks)


def extract(page: Node, spot: int | None, constant: frozenset[int]) -> str:
    """Main text of an aligned page. A wrapper that would leave nothing of an article is not followed."""
    content, articles, stack = None, False, [page]
    while stack:
        node = stack.pop()
        articles = articles or node.tag in ("article", "main")
        if node.tag == "#text":
            node.constant = node.at in constant
        elif spot is not None and node.at == spot:
            content = node
        stack.extend(node.kids)
    if content is None or (articles and content.tag not in ("article", "main")):
        content = content_of(page)
    text = blocks_of(content)
    if not text:
        for node, _ in text_nodes(content):
            node.constant = False
        text = blocks_of(content)
    return text


def dump(root: Node) -> bytes:
    """The tree in document order, without what never holds main text: depth, number, and tag and name or text of each node."""
    rows, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.tag == "#text":
            rows.append((depth, node.at, node.text))
        elif not is_aside(node, True) or "main" in node.name.split():
            rows.append((depth, node.at, node.tag, node.name))
            stack.extend((k, depth + 1) for k in reversed(node.kids))
    return packed(rows)


def load(data: bytes) -> Node:
    path: list[Node] = []
    for depth, at, *rest in json.loads(zlib.decompress(data)):
        node = Node("#text", "", rest[0]) if len(rest) == 1 else Node(*rest)
        node.at = at
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def host_of(url):
    """The host of a URL in lower case, null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def layout_of(html):
    """A hash of the containers that a page is made of, by tag, class, id and role without digits."""
    tags = F.regexp_extract_all(
        html, F.lit(r"(?i)<((?:article|aside|div|dl|footer|form|header|main|nav|ol|section|table|ul)(?=[\s>/])"
                    r"""(?:\s+(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'))*)"""), F.lit(1))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_replace(F.lower(t), "[0-9]+", "")))))


def layouts(pages: DataFrame) -> DataFrame:
    """(_host, _layout, _used, _wrapper): for each layout of a host the one whose wrapper it takes, and the skeleton of that one's reference.

    The reference is the page with the most tags. `pages` have host, layout and html.
    """
    some = pages.filter(F.col("host").isNotNull() & (F.col("html") != ""))
    tags = F.length("html") - F.length(F.replace(F.col("html"), F.lit("<"), F.lit("")))
    spot = F.xxhash64("html")
    stats = cut_lineage(some.groupBy("host", "layout").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct(tags.alias("tags"), spot.alias("spot"))).alias("best")), "layouts")
    commonest = stats.groupBy("host").agg(F.max(F.struct("n", "layout", "best")).alias("top")).withColumnRenamed("host", "_host")
    own = F.col("n") >= FEW_PAGES
    used = stats.join(commonest, F.col("host") == F.col("_host")).select(
        "_host", F.col("layout").alias("_layout"), F.when(own, F.col("layout")).otherwise(F.col("top.layout")).alias("_used"),
        F.when(own, F.col("best.spot")).otherwise(F.col("top.best.spot")).alias("_spot"))
    wanted = used.select("_host", "_used", "_spot").distinct()
    found = (some.withColumn("spot", spot).join(
        wanted, (F.col("host") == F.col("_host")) & (F.col("layout") == F.col("_used")) & (F.col("spot") == F.col("_spot")))
        .groupBy("_host", "_used").agg(F.min("html").alias("html")))

    def skeletons(batches):
        for batch in batches:
            made = pa.array([skeleton(html) for html in batch.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_host"), batch.column("_used"), made], ["_host", "_used", "_wrapper"])

    found = found.mapInArrow(skeletons, "_host string, _used long, _wrapper binary")
    return used.join(found, ["_host", "_used"]).select("_host", "_layout", "_used", "_wrapper")


ALIGNED = "page_id long, url string, host string, used long, tree binary, node int, seen long, equal long"


def aligned(pages: DataFrame, made: DataFrame) -> DataFrame:
    """Every page with its aligned tree; and, in rows without a tree, how often nodes of a layout were seen and equal.

    Node -1 counts the pages that were aligned and are no copies. Counts leave a task once per layout, or
    whenever it holds those of HELD layouts.
    """
    def run(batches):
        counts: dict[tuple[str, int], tuple[Counter, Counter]] = {}

        def counted():
            rows = [(host, used, node, n, equal[node]) for (host, used), (seen, equal) in counts.items() for node, n in seen.items()]
            counts.clear()
            return pa.RecordBatch.from_pylist(
                [{"host": h, "used": u, "node": k, "seen": n, "equal": e} for h, u, k, n, e in rows], schema=kind)

        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("used", pa.int64()), ("tree", pa.binary()),
                          ("node", pa.int32()), ("seen", pa.int64()), ("equal", pa.int64())])
        for batch in batches:
            trees = []
            for html, host, used, wrapper in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "_used", "_wrapper")), strict=True):
                if wrapper is None:
                    trees.append(dump(parse(html)))
                    continue
                page, seen, equal, copy = align(html, wrapper)
                trees.append(dump(page))
                if not copy:
                    if len(counts) >= HELD and (host, used) not in counts:
                        yield counted()
                    every, same = counts.setdefault((host, used), (Counter(), Counter()))
                    every.update([-1, *seen])
                    same.update(equal)
            none = [None] * len(trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), batch.column("_used"), pa.array(trees, pa.binary()),
                 pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], schema=kind)
        if counts:
            yield counted()

    # Both sides are plain tables: the planner splits layouts with very many pages.
    return (pages.join(made, (F.col("host") == F.col("_host")) & (F.col("layout") == F.col("_layout")), "left")
            .select("page_id", "url", "html", "host", "_used", "_wrapper").mapInArrow(run, ALIGNED))


def templates(found: DataFrame, made: DataFrame) -> DataFrame:
    """(_host, _used, spot, constant): where a layout's content is and which of its text nodes are template."""
    counts = (found.filter("tree is null").groupBy("host", "used", "node").agg(F.sum("seen").alias("seen"), F.sum("equal").alias("equal"))
              .groupBy("host", "used").agg(F.collect_list(F.struct("node", "seen", "equal")).alias("counts")))
    of = made.select("_host", "_used", "_wrapper").distinct()

    def run(batches):
        for batch in batches:
            spots, constants = [], []
            for wrapper, rows in zip(batch.column("_wrapper").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                seen = {r["node"]: r["seen"] for r in rows or ()}
                spot, constant = template_of(wrapper, seen.get(-1, 0), seen, {r["node"]: r["equal"] for r in rows or ()})
                spots.append(spot)
                constants.append(constant)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_host"), batch.column("_used"), pa.array(spots, pa.int32()), pa.array(constants, pa.list_(pa.int32()))],
                ["_host", "_used", "spot", "constant"])

    return (of.join(counts, (F.col("host") == F.col("_host")) & (F.col("used") == F.col("_used")), "left")
            .select("_host", "_used", "_wrapper", "counts").mapInArrow(run, "_host string, _used long, spot int, constant array<int>"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for every row.

    Null html counts as empty, pages without main text give an empty one. Pages without a host, and
    single pages of a host, go by the names of their elements alone. Rows with null or repeated ids come back
    as they are.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"host": host_of(F.col("url")), "layout": layout_of(F.col("html"))})
    made = cut_lineage(layouts(own), "wrappers")
    found = cut_lineage(aligned(own, made), "aligned-pages")
    known = cut_lineage(templates(found, made), "templates")

    def run(batches):
        for batch in batches:
            texts = [extract(load(tree), spot, frozenset(constant or ()))
                     for tree, spot, constant in zip(*(batch.column(c).to_pylist() for c in ("tree", "spot", "constant")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return (found.filter("tree is not null").join(known, (F.col("host") == F.col("_host")) & (F.col("used") == F.col("_used")), "left")
            .select("page_id", "url", "tree", "spot", "constant").mapInArrow(run, "page_id long, url string, text string, n_chars long"))
