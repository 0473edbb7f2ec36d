"""Main text of web pages by wrapper induction over same-host pages.

A page's tree is condensed: siblings with one label (tag and class) are one node, as a wrapper would repeat it. Per host the
page with the least page_id is the example; simple tree matching aligns every page's tree with it. Text that stays the
same at an aligned node on ``CONSTANT`` of the host's distinct pages (five at least) is template; copies of one article count
once. Nodes whose text varies are slots, and how much varying text outside links each slot holds over all pages of the host
decides where the content is: in the host's article elements, else its main element, else in the innermost node that holds
``SHARE`` of it, with the headings and paragraphs that stand beside that node. A page's content is what varies inside the
nodes that align with that region (all of the region, if nothing in it varies). Pages of hosts with fewer pages, and pages
whose layout has no such node, are judged alone: article, else main, else the innermost node with most text outside links.
Menus, page headers, footers, asides, notices, adverts, forms, scripts, styles and comments go by tag, role or class name
in any case; a header within an article is part of it, articles within an article are comments. An article's own name never
drops it, and names of or forms around what contains it don't if it outweighs the rest of the page.

Null and empty html gives an empty text. Pages without a host form one group of their own. Rows that repeat a page_id give
a row each. References are decoded once; white space within a block becomes one space and blocks are joined by line ends.
A start tag that never ends is text. Nothing recurses and the scan is linear, so deep, unclosed and long pages are only long.
An empty table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import saved, small_batches

CONSTANT, SHARE, PAGES, BROADCAST_BYTES = 0.8, 0.7, 5, 64_000_000
# Fixed tag and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg math button select textarea object embed canvas audio video dialog menu title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner complementary contentinfo search menu menubar dialog alert form".split())
#: Elements that hold running text rather than parts of a page.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl blockquote pre figure hr".split())
_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|promo(?!ted)\w*|"
    r"related(?!-work|_work)|replies|respond|share|sharing|sidebar|side-bar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s])",
    re.I,
)
#: Names that tell what an element has or lacks, such as with-sidebar, not what it is.
_MODIFIERS = re.compile(r"(?<![\w-])(?:with|without|has|no|not|is)[-_][\w-]+", re.I)
#: Within an article: names of its own heading, and of paragraphs.
_HEADINGS = re.compile(r"(?<![a-z])(?:header|masthead|banner)(?![a-z])", re.I)
_ASIDES = re.compile(r"(?<![a-z])(?:social|share|sharing)(?![a-z])", re.I)
#: Why a block is dropped: a form around it, a name, or a tag, role or hidden element.
FORM, NAME, HARD = 1, 2, 3
#: What may follow "<" in markup, up to the end of a tag's name.
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """A node of a condensed tree; number and last are its place in preorder and that of the last node below it."""

    __slots__ = ("by_label", "kids", "label", "last", "number", "up")

    def __init__(self, label: str, up: Node | None = None):
        self.label, self.up, self.kids, self.by_label, self.number, self.last = label, up, [], {}, 0, 0

    def child(self, label: str) -> Node:
        if label not in self.by_label:
            self.by_label[label] = Node(label, self)
            self.kids.append(self.by_label[label])
        return self.by_label[label]

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    def listed(self) -> list[Node]:
        """This node and all below in preorder, numbered."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            x.number = len(out)
            out.append(x)
            todo += reversed(x.kids)
        for x in reversed(out):
            x.last = x.kids[-1].last if x.kids else x.number
        return out


def shape(nodes: list[Node]) -> str:
    """A tree as lines of depth and label, in preorder."""
    depth, lines = {}, []
    for x in nodes:
        depth[x.number] = depth[x.up.number] + 1 if x.up is not None else 0
        lines.append(f"{depth[x.number]} {x.label}")
    return "\n".join(lines)


def from_shape(lines: str) -> list[Node]:
    at: list[Node] = []
    for line in lines.split("\n"):
        depth, label = line.split(" ", 1)
        del at[int(depth) :]
        at.append(at[-1].child(label) if at else Node(label))
    return at[0].listed()


@functools.lru_cache(4096)
def _attributes(tag: str, raw: str) -> tuple[str, int, int, bool]:
    """(label, why it is dropped, the same within an article, main) of a start tag; 0: it isn't dropped."""
    got = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}
    names = _MODIFIERS.sub("", got.get("class", "") + " " + got.get("id", ""))
    role = got.get("role", "").lower()
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    main = tag == "article" or got.get("itemprop") == "articleBody" or tag == "main" or role == "main"
    if hidden or (tag in DROPPED and tag != "form") or (role in ROLES and role != "form"):
        why = inner = HARD
    elif tag == "form" or role == "form":
        why = inner = FORM
    elif tag in ("html", "body") or main:
        why = inner = 0
    else:
        why = NAME if _NAMES.search(names) else 0
        own = _HEADINGS.sub("", names)
        own = _ASIDES.sub("", own) if tag in FLOW else own
        inner = NAME if why and _NAMES.search(own) else 0
    return tag + ("." + got["class"].split()[0] if got.get("class", "").split() else ""), why, inner, main


def _tags(page: str):
    """(text before, closing, name, attributes) of each tag, and at last (text, None, "", ""); comments and declarations have an empty name."""
    at, done = 0, len(page)
    while at < done:
        m = _OPEN.search(page, at)
        if m is None:
            break
        start = m.start()
        if m[0] == "<!--":
            stop = page.find("-->", m.end())
            yield page[at:start], False, "", ""
            at = stop + 3 if stop >= 0 else done
            continue
        end = _TAG_END.match(page, m.end()) if m[2] else None
        stop = end.end() if end else page.find(">", m.end()) + 1
        if not stop:
            break  # no tag ends from here on
        name = (m[2] or "").lower()
        yield page[at:start], bool(m[1]), name, page[m.end() : stop - 1]
        at = stop
        if name in RAW and not m[1]:
            inner = re.compile(f"</{name}", re.I).search(page, at)
            at = inner.start() if inner else done
    yield page[at:], None, "", ""


Block = tuple[Node, str, str, bool, float]


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The condensed tree in preorder, and the blocks in page order: (node, text, region, dropped, share of text in links); region is article, main or empty."""
    root = Node("#")
    # Open elements: tag, node, why dropped by what stands around an article and within it, region; and how many of each tag are open.
    stack: list[tuple[str, Node, int, int, str]] = [("#", root, 0, 0, "")]
    open_: dict[str, int] = {}
    blocks: list[tuple[Node, str, str, int, int, float]] = []
    parts: list[str] = []
    linked = [0, 0]

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                _, node, outer, inner, region = stack[-1]
                blocks.append((node, text, region, outer, inner, linked[1] / max(1, linked[0])))
            parts.clear()
            linked[0] = linked[1] = 0

    def close(tag: str, until: frozenset[str] | set[str] = frozenset()) -> None:
        if not open_.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                end_block()
                for x in stack[i:]:
                    open_[x[0]] -= 1
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    in_link = 0
    for text, closing, tag, raw in _tags(page):
        if text:
            parts.append(text)
            n = len(text.strip())
            linked[0] += n
            linked[1] += n * (in_link > 0)
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            continue
        if closing:
            close(tag)
            continue
        end_block()
        if tag in CLOSES_P:
            close("p", {"article", "section", "div", "td", "th", "li", "body", "table", "button"})
        if tag in SELF_CLOSING:
            for other in SELF_CLOSING[tag]:
                close(other, {"ul", "ol", "table", "dl", "select"})
        label, why, within, main = _attributes(tag, raw)
        _, node, outer, inner, region = stack[-1]
        node = node.child(label)
        if region != "article":
            outer = max(outer, why)
        elif tag == "article":
            inner = max(inner, NAME)  # articles in an article are its readers' comments
        elif tag != "header":
            inner = max(inner, within)
        if main and region != "article":
            region = "main" if tag == "main" or not label.startswith("article") and "articleBody" not in raw else "article"
        if tag not in VOID:
            stack.append((tag, node, outer, inner, region))
            open_[tag] = open_.get(tag, 0) + 1
    end_block()
    return root.listed(), _judged(blocks)


def _judged(blocks: list[tuple[Node, str, str, int, int, float]]) -> list[Block]:
    """The blocks with whether they are dropped.

    A name or a form around an article doesn't drop the article if it outweighs all that would be kept; nor do articles within it
    if it has nothing else, nor a form all of a page.
    """
    size = sum(len(b[1]) for b in blocks if not b[3] and not b[4])
    if not any(b[2] and not b[3] and not b[4] for b in blocks):
        for most in (0, NAME):
            inside = [b[2] == "article" and b[3] <= NAME and b[4] <= most for b in blocks]
            if sum(len(b[1]) for b, x in zip(blocks, inside, strict=True) if x) > size:
                return [(b[0], b[1], b[2], not x and bool(b[3] or b[4]), b[5]) for b, x in zip(blocks, inside, strict=True)]
    if not size:
        return [(b[0], b[1], b[2], b[3] > FORM or bool(b[4]), b[5]) for b in blocks]
    return [(b[0], b[1], b[2], bool(b[3] or b[4]), b[5]) for b in blocks]


def _heaviest(items: list[tuple[int, int, int]]) -> tuple[int, list[int]]:
    """Of (position, weight, key) in order, the subsequence of rising positions with most weight: its weight and keys."""
    if all(a[0] < b[0] for a, b in zip(items, items[1:], strict=False)):
        return sum(x[1] for x in items), [x[2] for x in items]
    # Ends of the best subsequences so far, by position with weights rising, too.
    ends: list[int] = []
    best: list[tuple[int, int]] = []
    before: list[int] = []
    for i, (position, weight, _) in enumerate(items):
        j = bisect.bisect_left(ends, position)
        total, link = (best[j - 1][0] + weight, best[j - 1][1]) if j else (weight, -1)
        before.append(link)
        k = j
        while k < len(ends) and best[k][0] <= total:
            k += 1
        ends[j:k], best[j:k] = [position], [(total, i)]
    keys, i = [], best[-1][1]
    while i >= 0:
        keys.append(items[i][2])
        i = before[i]
    return best[-1][0], keys


def match(a: list[Node], b: list[Node]) -> dict[int, int]:
    """Simple tree matching: the aligned nodes of two trees, by number. Siblings have distinct labels, so each pair of aligned nodes needs the heaviest common order of its children's labels only."""
    if a[0].label != b[0].label:
        return {}
    pairs, below = [(a[0], b[0])], []
    for x, y in pairs:  # grows while it is read
        mine = []
        for kid in x.kids:
            if (other := y.by_label.get(kid.label)) is not None:
                mine.append(len(pairs))
                pairs.append((kid, other))
        below.append(mine)
    weight, chosen = [1] * len(pairs), [[]] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        if below[i]:
            more, chosen[i] = _heaviest([(pairs[j][1].number, weight[j], j) for j in below[i]])
            weight[i] += more
    out, todo = {}, [0]
    while todo:
        i = todo.pop()
        out[pairs[i][0].number] = pairs[i][1].number
        todo += chosen[i]
    return out


def _held(nodes: list[Node], weights: dict[int, int]) -> list[int]:
    """The weight of each node and all below it."""
    held = [weights.get(x.number, 0) for x in nodes]
    for x in reversed(nodes[1:]):
        held[x.up.number] += held[x.number]
    return held


def _innermost(nodes: list[Node], held: list[int]) -> Node:
    node = nodes[0]
    while (inner := max((k for k in node.kids if k.tag not in FLOW), key=lambda k: held[k.number], default=None)) is not None and held[inner.number] >= SHARE * held[0]:
        node = inner
    return node


def content_region(nodes: list[Node], weights: dict[int, int]) -> list[Node]:
    """The topmost nodes of an example that hold a host's content, by the varying text of its slots."""
    held = _held(nodes, weights)
    if not held[0]:
        return []
    for tag in ("article", "main"):
        found: list[Node] = []
        for x in nodes:
            if x.tag == tag and held[x.number] and not (found and x.number <= found[-1].last):
                found.append(x)
        if found:
            return found
    node = _innermost(nodes, held)
    while node.up is not None and not weights.get(node.up.number) and all(k is node or not held[k.number] or k.tag in FLOW for k in node.up.kids):
        node = node.up
    return [node]


class Aligner:
    """A worker's examples, alignments and regions, remembered."""

    def __init__(self):
        self.examples: dict[str, list[Node]] = {}
        self.aligned: dict[tuple[str, str], dict[int, int]] = {}
        self.regions: dict[tuple[str, tuple], list[Node]] = {}

    def example(self, lines: str) -> list[Node]:
        if lines not in self.examples:
            if len(self.examples) > 500:
                self.examples = {}
            self.examples[lines] = from_shape(lines)
        return self.examples[lines]

    def align(self, tree: list[Node], example: str) -> dict[int, int]:
        key = (shape(tree), example)
        if key not in self.aligned:
            if len(self.aligned) > 2000:
                self.aligned = {}
            self.aligned[key] = match(tree, self.example(example))
        return self.aligned[key]

    def region(self, example: str, slots: tuple[tuple[int, int], ...]) -> list[Node]:
        key = (example, slots)
        if key not in self.regions:
            if len(self.regions) > 500:
                self.regions = {}
            self.regions[key] = content_region(self.example(example), dict(slots))
        return self.regions[key]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def _region(kept: list[Block]) -> list[Block]:
    """The blocks of the article, else of main, else none."""
    for region in ("article", "main"):
        if inside := [b for b in kept if b[2] == region]:
            return inside
    return []


def _identity(blocks: list[Block]) -> int:
    """A hash of a page's article or main text, or of all its text that isn't dropped; copies of one article share it."""
    kept = [b for b in blocks if not b[3]]
    return _hash("\n".join(b[1] for b in _region(kept) or kept))


def _example(batches):
    """host and the shape of the example's tree."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([shape(parse(page or "")[0]) for page in batch.column("html").to_pylist()], pa.string())], ["host", "example"])


def _aligned_texts(batches):
    """host, node, hash of each distinct block text of a page by the example's node, its characters outside links and dropped parts, and the page's identity; node -1 stands for the page."""
    aligner = Aligner()
    for batch in batches:
        rows: list[tuple[str, int, int, int, int]] = []
        for h, page, example in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("example").to_pylist(), strict=True):
            tree, blocks = parse(page or "")
            to = aligner.align(tree, example)
            identity = _identity(blocks)
            mine = {(-1, 0): 0}
            for node, text, _, dropped, linked in blocks:
                if node.number in to:
                    key = (to[node.number], _hash(text))
                    mine[key] = mine.get(key, 0) + (0 if dropped else round(len(text) * (1 - linked)))
            rows += [(h, n, x, c, identity) for (n, x), c in mine.items()]
        host, node, digest, chars, same = zip(*rows, strict=True) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(node, pa.int32()), pa.array(digest, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.int64())], ["host", "node", "digest", "chars", "same"])


def _alone(tree: list[Node], kept: list[Block]) -> list[Block]:
    """The content blocks of a page by itself."""
    if inside := _region(kept):
        return inside
    slots = [b for b in kept if b[4] < 0.6]
    weights: dict[int, int] = {}
    for b in slots:
        weights[b[0].number] = weights.get(b[0].number, 0) + len(b[1])
    regions = content_region(tree, weights)
    return [b for b in slots if any(r.number <= b[0].number <= r.last for r in regions)]


def main_text(page: str, aligner: Aligner, example: str | None = None, template: set[tuple[int, int]] = frozenset(), slots: tuple[tuple[int, int], ...] = ()) -> str:
    """The content blocks of a page; template holds (node of the example, text hash), slots (node of the example, varying characters)."""
    tree, blocks = parse(page)
    kept = [b for b in blocks if not b[3]]
    if not kept:
        return ""
    if example is None:
        return "\n".join(b[1] for b in _alone(tree, kept))
    to = aligner.align(tree, example)
    varying = [b for b in kept if (to.get(b[0].number, -1), _hash(b[1])) not in template]
    wanted = {r.number for r in aligner.region(example, slots)}
    regions = [x for x in tree if to.get(x.number) in wanted]

    def inside(some: list[Block]) -> list[Block]:
        return [b for b in some if any(r.number <= b[0].number <= r.last for r in regions)]

    semantic = any(r.tag in ("article", "main") for r in regions)
    found = inside(varying) or (inside(kept) if semantic else [])
    if not semantic:
        found = [b for b in found if b[4] < 0.6]
    return "\n".join(b[1] for b in found or _alone(tree, varying) or (_region(kept) if not regions else []))


def _extract(batches):
    aligner = Aligner()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("html", "example", "template", "slots"))
        text = [
            main_text(page or "", aligner, example, {(t["node"], t["digest"]) for t in template or ()}, tuple((s["node"], s["chars"]) for s in slots or ()))
            for page, example, template, slots in zip(*columns, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Of a host only the shape of its example, its template and its slots are sent to its pages; they are broadcast if they
    are at most ``BROADCAST_BYTES`` together, else joined by host, where both sides are plain shuffles that AQE can split.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("page_id"))
    hosts = saved(hosts.where(f"pages >= {PAGES} AND page_id IS NOT NULL").select("host", "page_id"))

    def few(frame: DataFrame, size: str) -> DataFrame:
        bytes_ = frame.agg(F.sum(F.expr(size))).first()[0] or 0
        return F.broadcast(frame) if bytes_ <= BROADCAST_BYTES else frame

    first = pages.join(few(hosts, "octet_length(host) + 16"), ["host", "page_id"]).groupBy("host").agg(F.max("html").alias("html"))
    examples = saved(first.mapInArrow(_example, "host string, example string"))
    seen = pages.select("host", "html").join(few(examples, "octet_length(host) + octet_length(example)"), "host").mapInArrow(_aligned_texts, "host string, node int, digest long, chars long, same long")
    counted = saved(seen.groupBy("host", "node", "digest").agg(F.count_distinct("same").alias("n"), F.sum("chars").alias("chars")))
    distinct = saved(counted.where(f"node = -1 AND n >= {PAGES}").select("host", F.col("n").alias("pages")))
    counted = counted.where("node >= 0").join(few(distinct, "octet_length(host) + 8"), "host").withColumn("constant", F.col("n") >= CONSTANT * F.col("pages"))
    # At most blocks / CONSTANT constant texts a host, no more than a page holds; and a slot a node of the example.
    template = counted.where("constant").groupBy("host").agg(F.collect_list(F.struct("node", "digest")).alias("template"))
    slots = counted.where("NOT constant AND chars > 0").groupBy("host", "node").agg(F.sum("chars").alias("chars")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "chars"))).alias("slots"))
    known = saved(examples.join(distinct, "host", "left_semi").join(template, "host", "left").join(slots, "host", "left"))
    known = few(known, "octet_length(host) + octet_length(example) + 16 * (coalesce(size(template), 0) + coalesce(size(slots), 0))")
    return pages.join(known, "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
