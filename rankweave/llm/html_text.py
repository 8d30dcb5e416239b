"""HTML extraction by wrapper induction.

The pages of a host share a template. Some pages of each host are its patterns (chosen by a hash of the id); the DOM tree of every page of the
host is aligned with them by simple tree matching. Pages whose containers don't align with a pattern's have another layout and say nothing about
it; pages that share most of its main text are copies and don't count, so an article that a host repeats isn't taken for template. A pattern's
node that aligns in nearly all pages is a template node; if its text is the same in nearly all of them, it is constant, else it is a slot. The
counts come from all pages of the host, summed in each task before they are shuffled.

Content slots are the template's ``article``, else ``main`` elements, else the lowest container that holds all main text of all pages; slots whose
text is mostly links are menus. A page's text is that of its nodes in content slots, without constant blocks at the slots' edges, slots of links, and elements whose
tag, role, class or id marks them as menu, header, footer, sidebar, notice, advert, form, script, style or reader comments. Pages of hosts with too
few pages, and pages of a layout that no pattern has, are judged by the same marks in their own tree alone (``article``, else ``main``, else ``body``).

Null html counts as empty and gives an empty text; a page without a host is judged by its own tree alone; repeated rows stay; unclosed and cut
markup is read as browsers do; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence, Set
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.shared import in_small_batches, table, written

PATTERNS = 2
WITNESSES = 4
SUPPORT = 0.8
COPY = 0.5
LIKE = 0.7
LINKS = 0.6
PARTS = 100
BROADCAST_BYTES = 8 << 20
NODE_BYTES = 64
PAGE_BATCH = 2 << 20

# Element names of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select article section div body main td".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas menu dialog label fieldset audio video".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promoted promotion recommended related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADERS = frozenset({"header", "topbar"})
PLAIN_NAMES = frozenset(
    "and area article banners bar block blocks bottom box btn button buttons card col column container content cta entry foot form global head icon icons inline inner item items left link links list main module outer page panel post posts primary right row secondary section sections site slot sticky the thread top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | {"p"}
INLINE = frozenset("a abbr b bdi bdo button cite code data del dfn em font i ins kbd label mark output q s samp small span strong sub sup time tt u var".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form center".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^"'>]+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; its parts are strings and nodes in order. ``nodes_of`` notes whether it stands in running text, and whether it holds the page's main element."""

    __slots__ = ("tag", "attributes", "parts", "place", "running", "holds")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.parts, self.place, self.running, self.holds = tag, attributes, [], -1, False, False

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]


def parse(page: str) -> Node:
    """The tree of a page; end tags that HTML lets out are put in, text stays undecoded."""
    root = Node("#", {})
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and name not in SCOPES and name not in BLOCK:
                    break
            continue
        rest = m[3] if m[2] else m[6]
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(rest)} if rest.strip("/ \t\r\n") else {}
        if name in CLOSES_P:
            _close(stack, {"p"}, SCOPES | {"button"})
        if name in SIBLINGS:
            _close(stack, SIBLINGS[name], {"ul", "ol", "dl", "select"} if name in ("li", "dt", "dd", "option") else {"table"})
        node = Node(name, attributes)
        stack[-1].parts.append(node)
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = (page.find(">", end.start()) + 1 or n) if end else n
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], names: set[str], within: frozenset | set) -> None:
    """Close the nearest open element of these names, up to the nearest one in ``within``."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in names:
            del stack[k:]
            return
        if stack[k].tag in within:
            return


def own_text(node: Node) -> str:
    parts = node.parts
    text = parts[0] if len(parts) == 1 and isinstance(parts[0], str) else " ".join(p for p in parts if isinstance(p, str))
    return " ".join((html.unescape(text) if "&" in text else text).split())


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attributes.get("role", "").lower() == "main"


def nodes_of(root: Node) -> tuple[list[Node], list[list[Node]]]:
    """All nodes in page order and the children of each; every node gets its place, and what ``is_beside`` asks of what is around and below it.

    Running text is what lies in ``pre``, or in a paragraph or heading that has words of its own. An element holds the main text if all main elements lie
    in it; on a page without any, if all articles and at least half of the page's text do.
    """
    out: list[Node] = []
    below: list[list[Node]] = []
    mains: list[Node] = []
    articles_of: list[Node] = []
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.place = len(out)
        out.append(node)
        tag, parts = node.tag, node.parts
        if tag == "article":
            articles_of.append(node)
        if tag == "main" or node.attributes and is_main(node):
            mains.append(node)
        children = [p for p in parts if isinstance(p, Node)] if len(parts) > 1 or parts and isinstance(parts[0], Node) else []
        below.append(children)
        if children:
            if node.running or tag == "pre" or tag in RUNNING and any(isinstance(p, str) and not p.isspace() for p in parts):
                for c in children:
                    c.running = True
            waiting += reversed(children)
    chosen = mains or articles_of
    if not chosen:
        return out, below
    above = [0] * len(out)
    for i, children in enumerate(below):
        for c in children:
            above[c.place] = i
    holders: set[int] | None = None
    for node in chosen:
        path, i = set(), above[node.place]
        while i > 0:
            path.add(i)
            i = above[i]
        holders = path if holders is None else holders & path
        if not holders:
            return out, below
    if holders and not mains:
        chars = [0 if n.tag in RAW else sum(len(p) for p in n.parts if isinstance(p, str)) for n in out]
        for i in range(len(out) - 1, 0, -1):
            chars[above[i]] += chars[i]
        holders = {i for i in holders if 2 * chars[i] >= chars[0]}
    for i in holders or ():
        out[i].holds = True
    return out, below


@dataclass
class Tree:
    """A page's nodes in page order: tags, children, own texts; whether a node lies in an element beside the main text; characters of main text in
    each subtree, and how many of them stand in links; characters of all text in each subtree."""

    nodes: list[Node]
    tags: list[str]
    children: list[list[int]]
    texts: list[str]
    beside: list[bool]
    chars: list[int]
    linked: list[int]
    whole: list[int]


def shape(root: Node) -> Tree:
    """The tree of a parsed page; scripts and styles are left without text."""
    nodes, below = nodes_of(root)
    n = len(nodes)
    texts = ["" if x.tag in ("script", "style") else own_text(x) for x in nodes]
    children = [[c.place for c in cs] for cs in below]
    beside, inside, link = [False] * n, [False] * n, [False] * n
    for i, x in enumerate(nodes):
        link[i] |= x.tag == "a"
        inside[i] |= x.tag in ("article", "main")
        for c in children[i]:
            inside[c], link[c] = inside[i], link[i]
            beside[c] = beside[i] or is_beside(nodes[c], inside[i] or nodes[c].tag in ("article", "main"))
    whole = list(map(len, texts))
    chars = [0 if beside[i] else whole[i] for i in range(n)]
    linked = [chars[i] if link[i] else 0 for i in range(n)]
    for i in range(n - 1, -1, -1):
        for c in children[i]:
            chars[i] += chars[c]
            linked[i] += linked[c]
            whole[i] += whole[c]
    return Tree(nodes, [x.tag for x in nodes], children, texts, beside, chars, linked, whole)


def _telling(tree: Tree, common: set[str]) -> list[bool]:
    """The nodes that can be template, hold template or be a slot: those with a text that both pages have, containers with a telling part of the
    page's text, and what lies above either."""
    kept = [False] * len(tree.tags)
    least = tree.whole[0] / PARTS
    for i in range(len(kept) - 1, -1, -1):
        kept[i] = tree.texts[i] in common or tree.tags[i] in CONTAINERS and tree.whole[i] >= least or any(kept[c] for c in tree.children[i])
    kept[0] = True
    return kept


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching of two trees with like roots: pairs of places. A pair of nodes with one tag weighs 1, half more if they have a text in
    common, and what the best order-keeping alignment of their children weighs. Like subtrees are weighed once, whatever their number."""
    common = set(a.texts) & set(b.texts) - {""}
    ids: dict[tuple, int] = {}
    tags: list[str] = []
    texts: list[str] = []
    parts: list[tuple[int, ...]] = []
    size: list[float] = []

    def shapes(tree: Tree) -> tuple[list[int], list[list[int]]]:
        kept = _telling(tree, common)
        below = [[c for c in cs if kept[c]] if kept[i] else [] for i, cs in enumerate(tree.children)]
        of = [-1] * len(kept)
        for i in range(len(kept) - 1, -1, -1):
            if kept[i]:
                text = tree.texts[i] if tree.texts[i] in common else ""
                key = (tree.tags[i], text, tuple(of[c] for c in below[i]))
                if (k := ids.get(key)) is None:
                    k = ids[key] = len(tags)
                    tags.append(key[0])
                    texts.append(text)
                    parts.append(key[2])
                    size.append(1 + 0.5 * bool(text) + sum(size[c] for c in key[2]))
                of[i] = k
        return of, below

    a_ids, a_below = shapes(a)
    b_ids, b_below = shapes(b)
    known: dict[tuple[int, int], float] = {}

    def weight(u: int, v: int) -> float:
        return size[u] if u == v else 0.0 if tags[u] != tags[v] else known[u, v]

    def weigh(u: int, v: int) -> None:
        """Make ``known`` hold the weight of two subtrees and of what lies below them."""
        waiting = [(u, v)]
        while waiting:
            u, v = waiting[-1]
            if u == v or tags[u] != tags[v] or (u, v) in known:
                waiting.pop()
                continue
            head, tail = like_ends(parts[u], parts[v])
            xs, ys = parts[u][head : len(parts[u]) - tail], parts[v][head : len(parts[v]) - tail]
            missing = [(x, y) for x in set(xs) for y in set(ys) if x != y and tags[x] == tags[y] and (x, y) not in known]
            if missing:
                waiting += missing
                continue
            row = [0.0] * (len(ys) + 1)
            for x in xs:
                row = next_row(row, [weight(x, y) for y in ys])
            ends = sum(size[x] for x in parts[u][:head]) + sum(size[x] for x in parts[u][len(parts[u]) - tail :])
            known[u, v] = 1 + 0.5 * (texts[u] == texts[v] != "") + row[-1] + ends
            waiting.pop()

    weigh(a_ids[0], b_ids[0])
    pairs, waiting = [], [(0, 0)]
    while waiting:
        i, j = waiting.pop()
        pairs.append((i, j))
        xs, ys = a_below[i], b_below[j]
        us, vs = [a_ids[x] for x in xs], [b_ids[y] for y in ys]
        head, tail = like_ends(us, vs)
        waiting += zip(xs[:head], ys[:head], strict=True)
        waiting += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
        waiting += [(xs[head + p], ys[head + q]) for p, q in align(us[head : len(us) - tail], vs[head : len(vs) - tail], weight)]
    return pairs


def like_ends(us: Sequence[int], vs: Sequence[int]) -> tuple[int, int]:
    """How many shapes two lists have alike at the start, and of the rest at the end. To align them costs nothing: no shape weighs more beside another than beside its like."""
    least = min(len(us), len(vs))
    head = 0
    while head < least and us[head] == vs[head]:
        head += 1
    tail = 0
    while tail < least - head and us[-1 - tail] == vs[-1 - tail]:
        tail += 1
    return head, tail


def next_row(above: list[float], weights: list[float]) -> list[float]:
    """The next row of an alignment's table."""
    row, best = [0.0], 0.0
    for j, w in enumerate(weights):
        best = max(best, above[j + 1], above[j] + w if w else 0.0)
        row.append(best)
    return row


def align(xs: Sequence[int], ys: Sequence[int], weight: Callable[[int, int], float]) -> list[tuple[int, int]]:
    """The order-keeping alignment of two lists that weighs most, as pairs of positions. One row of each block of the table is kept, and a block's
    rows are made again on the way back."""
    if not xs or not ys:
        return []
    block = math.isqrt(len(xs)) + 1
    row, kept = [0.0] * (len(ys) + 1), []
    for i, x in enumerate(xs):
        if i % block == 0:
            kept.append(row)
        row = next_row(row, [weight(x, y) for y in ys])
    out, j = [], len(ys)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for x in xs[k * block : (k + 1) * block]:
            rows.append(next_row(rows[-1], [weight(x, y) for y in ys]))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((k * block + i, j))
    return out


class Patterns:
    """The trees of patterns that a worker has met, up to ``BROADCAST_BYTES`` characters of pages, the oldest out first."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, Tree] = OrderedDict()
        self.chars = 0

    def __call__(self, page: str) -> Tree:
        tree = self.held.get(page)
        if tree is None:
            tree = self.held[page] = shape(parse(page))
            self.chars += len(page)
            while self.chars > BROADCAST_BYTES and len(self.held) > PATTERNS:
                self.chars -= len(self.held.popitem(last=False)[0])
        else:
            self.held.move_to_end(page)
        return tree


_pattern = Patterns()


def aligned(page: Tree, pattern: Tree) -> list[tuple[int, int]] | None:
    """The aligned nodes of a page and a pattern; None if the page has another layout: containers that don't align."""
    pairs = match(page, pattern)

    def telling(tree: Tree) -> int:
        return sum(t in CONTAINERS and w * PARTS >= tree.whole[0] for t, w in zip(tree.tags, tree.whole, strict=True))

    both = telling(page) + telling(pattern)
    held = sum(page.tags[i] in CONTAINERS and page.whole[i] * PARTS >= page.whole[0] and pattern.whole[j] * PARTS >= pattern.whole[0] for i, j in pairs)
    return pairs if 2 * held >= LIKE * both else None


def constant_nodes(page: Tree, pattern: Tree, pairs: list[tuple[int, int]]) -> set[int] | None:
    """Places of the pattern whose texts a page has alike; None if the page is a copy of it by its main text."""
    same = {j for i, j in pairs if page.texts[i] and page.texts[i] == pattern.texts[j]}
    main = pattern.chars[0]
    return None if main and sum(len(pattern.texts[j]) for j in same if not pattern.beside[j]) > COPY * main else same


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def patterns_of(pages: DataFrame) -> DataFrame:
    """(host, patterns): some pages of each host, chosen by a hash of the id."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("page_id"), "page_id", "html")
    some = pages.where("host <> '' and html is not null").select("host", "page_id", "html").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PATTERNS)
    return some.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "html"))).alias("held")).select("host", F.col("held.html").alias("patterns"))


def _beside(pages: DataFrame, side: DataFrame, n_bytes: int) -> DataFrame:
    """Join by host: by broadcast where the side's size, which was measured, allows it (``Patterns`` then holds all trees); else by a shuffle that splits hot
    hosts and brings the pages of a host one after the other."""
    return pages.join(F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side, "host", "left")


SEEN = "pattern int, node int, n long, same long, chars long, linked long"


def witness_counts(pages: DataFrame) -> DataFrame:
    """(host, pattern, node, n, same, chars, linked): how many pages have a node aligned with a pattern's node, how many have its text alike, and the
    characters of main text, and of links, that they hold there. Node 0 stands for the page: all pages of the pattern's layout beside copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = {}
        for batch in in_small_batches(batches, 1, PAGE_BATCH):
            for host, page, patterns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not patterns or not page:
                    continue
                tree = shape(parse(page))
                for k, pattern in enumerate(patterns):
                    other = _pattern(pattern)
                    pairs = aligned(tree, other)
                    same = None if pairs is None else constant_nodes(tree, other, pairs)
                    if same is None:
                        continue
                    for i, j in pairs:
                        if j == 0 or j in same or tree.tags[i] in CONTAINERS:
                            sums = counts.setdefault((host, k, j), [0, 0, 0, 0])
                            for f, value in enumerate((1, j in same, tree.chars[i], tree.linked[i])):
                                sums[f] += value
            if len(counts) > 100_000:
                yield _count_rows(counts)
                counts = {}
        if counts:
            yield _count_rows(counts)

    seen = pages.select("host", "html", "patterns").mapInArrow(run, f"host string, {SEEN}")
    return seen.groupBy("host", "pattern", "node").agg(*(F.sum(c).alias(c) for c in ("n", "same", "chars", "linked")))


def _count_rows(counts: dict[tuple, list[int]]) -> pa.RecordBatch:
    hosts, patterns, nodes = zip(*counts, strict=True)
    sums = [pa.array(c, pa.int64()) for c in zip(*counts.values(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(patterns, pa.int32()), pa.array(nodes, pa.int32()), *sums], ["host", "pattern", "node", "n", "same", "chars", "linked"])


def wrappers_of(counts: DataFrame) -> DataFrame:
    """(host, template): the template nodes of each host as (pattern, node, fixed, holds, links): whether the text is constant, whether the node
    holds all main text of all pages, and whether its text is mostly links."""
    pages = counts.where(f"node = 0 and n >= {WITNESSES}").select("host", "pattern", F.col("n").alias("pages"), F.col("chars").alias("all_chars"))
    nodes = counts.join(pages, ["host", "pattern"]).where(F.col("n") >= SUPPORT * F.col("pages"))
    fixed = F.col("same") >= SUPPORT * F.col("pages")
    holds = F.col("chars") >= F.col("all_chars")
    links = (F.col("chars") > 0) & (F.col("linked") > LINKS * F.col("chars"))
    return nodes.groupBy("host").agg(F.collect_list(F.struct("pattern", "node", fixed.alias("fixed"), holds.alias("holds"), links.alias("links"))).alias("template"))


def names_of(value: str) -> set[str]:
    """The names in a class or id that mark what an element is: of each word all parts, unless one of them is a word of its own (``share-price``)."""
    out: set[str] = set()
    for word in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        parts = {p for p in re.split(r"[_:\-\d]+", word) if len(p) > 1}
        if parts <= SKIPPED_NAMES | HEADERS | PLAIN_NAMES:
            out |= parts
    return out


def is_beside(node: Node, in_article: bool) -> bool:
    """Whether an element is marked as something other than main text. Names don't mark what holds the page's main element, and neither names, roles nor the
    tags of buttons and labels mark an inline element of running text: there they are words of a sentence or of a listing."""
    if node.running and node.tag in INLINE:
        return "hidden" in node.attributes or bool(HIDDEN.search(node.attributes.get("style", "")))
    if node.tag in SKIPPED and not (node.holds and node.tag == "form") or node.tag == "header" and not in_article:
        return True
    if not node.attributes:
        return False
    a = node.attributes
    if "hidden" in a or not node.holds and a.get("role", "").lower() in SKIPPED_ROLES or HIDDEN.search(a.get("style", "")):
        return True
    if node.holds or node.tag in ("html", "body", "main") or node.tag == "article" and "comment" not in f"{a.get('class', '')} {a.get('id', '')}".lower():
        return False
    names = names_of(f"{a.get('class', '')} {a.get('id', '')}")
    return bool(names & SKIPPED_NAMES) or not in_article and bool(names & HEADERS)


def articles(root: Node) -> list[Node]:
    """The elements that hold the main text: articles, else main elements, else the body or the whole."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        kind = "main" if is_main(node) else node.tag
        if node is not root and node.tag not in ("html", "body") and is_beside(node, kind in ("article", "main")):
            continue
        if kind in found:
            found[kind].append(node)
        if kind != "article":
            waiting += reversed(node.children())
    return found["article"] or found["main"] or found["body"] or [root]


def blocks(node: Node, template: set[int], in_article: bool, skipped: Set[int] = frozenset()) -> list[str]:
    """The texts of an element's blocks in page order, without ``skipped`` nodes and without the template at its edges.

    A block all of whose text is the own text of ``template`` nodes is constant. Constant blocks ahead of the first varying one and after the last go; those
    between varying ones are part of the text, and so are headings of an article ahead of a varying one.
    """
    out: list[tuple[str, bool, bool]] = []
    line: list[str] = []
    constant, heading = True, False

    def end() -> None:
        nonlocal constant, heading
        text = "".join(line)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        line.clear()
        if text:
            out.append((text, constant, heading))
        constant, heading = True, False

    waiting: list = [node]
    own = False
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            line.append(part)
            constant = constant and (own or not part.strip())
        elif part is None:
            end()
        elif isinstance(part, bool):
            own = part
        elif part is not node and (part.place in skipped or is_beside(part, in_article)):
            line.append(" ")
        else:
            if part.tag in BLOCK:
                end()
                waiting.append(None)
                heading = in_article and part.tag in HEADINGS
            elif part.tag in ("br", "img", "wbr"):
                line.append(" " if part.tag != "wbr" else "")
            waiting.append(own)
            own = part.place in template
            waiting += reversed(part.parts)
    end()
    varying = [i for i, (_, fixed, _) in enumerate(out) if not fixed]
    if not varying:
        return []
    return [text for i, (text, _, head) in enumerate(out[: varying[-1] + 1]) if i >= varying[0] or head]


@dataclass
class Wrapper:
    """What a pattern of a host tells: nodes of constant text, slots of main text, slots of links."""

    fixed: set[int]
    content: list[int]
    links: set[int]


def wrapper(pattern: Tree, template: list[dict]) -> Wrapper:
    """The content slots are the template's articles, else its main elements, else the lowest node that holds all main text of all pages."""
    found = sorted(t["node"] for t in template)
    content: list[int] = []
    for tag in ("article", "main"):
        content = content or [j for j in found if pattern.tags[j] == tag and not pattern.beside[j]]
    content = content or [j for j in sorted(t["node"] for t in template if t["holds"]) if pattern.tags[j] in CONTAINERS][-1:]
    return Wrapper({t["node"] for t in template if t["fixed"]}, content, {t["node"] for t in template if t["links"] and t["node"] not in content and not t["holds"]})


def slots(tree: Tree, pattern: Tree, of: Wrapper) -> tuple[list[int], set[int], set[int]] | None:
    """The page's nodes in content slots, of constant text, and in slots of links; None if the page hasn't the pattern's layout or its slots."""
    pairs = aligned(tree, pattern)
    if pairs is None:
        return None
    chosen = set(of.content)
    content = {i for i, j in pairs if j in chosen and not tree.beside[i]}
    if not content:
        return None
    tags = {tree.tags[i] for i in content}
    if tags & {"article", "main"}:
        # a slot can be filled more than once: its like beside it belongs to it
        for below in tree.children:
            if content.intersection(below):
                content.update(c for c in below if tree.tags[c] in tags and not tree.beside[c])
        if {a.place for a in articles(tree.nodes[0])} - content:
            return None
    fixed = {i for i, j in pairs if j in of.fixed and tree.texts[i] == pattern.texts[j]}
    return _topmost(tree, content), fixed, {i for i, j in pairs if j in of.links}


def _topmost(tree: Tree, places: set[int]) -> list[int]:
    """Of these nodes, those that lie in none of the others."""
    out, waiting = [], [0]
    while waiting:
        i = waiting.pop()
        if i in places:
            out.append(i)
        else:
            waiting += reversed(tree.children[i])
    return out


def main_text(page: str | None, patterns: list[str] | None = None, template: list[dict] | None = None) -> tuple[str, bool]:
    """The main text of a page, and whether a wrapper of its host gave it; ``template``: the template nodes of its host's ``patterns``."""
    if not page:
        return "", False
    root = parse(page)
    if patterns and template:
        tree = shape(root)
        for k, html_of in enumerate(patterns):
            of = [t for t in template if t["pattern"] == k]
            pattern = _pattern(html_of)
            if of and (found := slots(tree, pattern, wrapper(pattern, of))):
                content, fixed, links = found
                return "\n\n".join(t for i in content for t in blocks(tree.nodes[i], fixed, tree.tags[i] in ("article", "main"), links)), True
    else:
        nodes_of(root)
    return "\n\n".join(t for a in articles(root) for t in blocks(a, set(), a.tag in ("article", "main"))), False


def extract(page: str | None, patterns: list[str] | None = None, template: list[dict] | None = None) -> str:
    """The main text of a page."""
    return main_text(page, patterns, template)[0]


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, and whether a wrapper gave the text (by_wrapper)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    patterns = written(patterns_of(rows), "patterns")
    held = F.aggregate("patterns", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p))
    n_bytes = patterns.select(F.sum(held)).first()[0] or 0
    counts = written(witness_counts(_beside(rows, patterns, n_bytes)), "witness-counts")
    wrappers = patterns.join(wrappers_of(counts), "host")
    wrapped = written(wrappers, "wrappers")
    n_wrapped = wrapped.select(F.sum(held + NODE_BYTES * F.size("template"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, 2, PAGE_BATCH):
            page_id, url, *rest = batch.columns
            found = [main_text(*r) for r in zip(*(c.to_pylist() for c in rest), strict=True)]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([w for _, w in found])], ["page_id", "url", "text", "n_chars", "by_wrapper"])

    return _beside(rows, wrapped, n_wrapped).select("page_id", "url", "html", "patterns", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long, by_wrapper boolean")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
