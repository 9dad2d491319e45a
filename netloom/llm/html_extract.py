"""Main text of web pages by wrapper induction.

1. Every page becomes a tree of its block elements.  Siblings that follow each
   other with equal signatures (tag and classes) are folded to one repeated
   node; containers are only if they are built alike as well.  Pages of a host whose text lies on the same path are one layout; the
   layout's reference is the commonest folded tree of all its pages.
2. Every page of a layout is aligned to the reference by simple tree matching.
   Each text belongs to the nearest aligned container.  A text that more than
   half of the layout's pages hold there is constant: template, whatever the
   element is called.  Pages count once for each longest text, so copies of
   an article don't make it constant.  All other texts are slots.
3. The slots' characters are summed at their nodes over all pages of the
   layout.  The lowest container that holds most of them is where the layout
   keeps its articles.
4. A page's main text is what lies under that container, less the template.
   What is left to names is to tell slots apart that vary alike: elements that
   HTML itself marks as furniture (nav, footer, class="advert", a thread of
   comments) are no article.

All counts are over all pages and are summed by key on the executors; what is
gathered for a layout is its reference and its template, both no larger than
pages are.  Pages meet their wrapper in a join by layout, which Spark may split
where one layout has very many pages.

Defined cases: a null or empty html gives an empty text; a page whose layout
has fewer than ``LEAST_PAGES`` different pages is cut on its own tree, by the
share of text below each container; a tag that never ends drops the rest, as
browsers do; unclosed and misnested tags are closed where HTML's rules close
them; a null url belongs to the host ""; repeated rows are extracted alike; an
empty table gives an empty result; extra columns are ignored; nothing is
capped, and depth and length of pages are free.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import groupby

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import as_longs, as_text
from netloom.storage import stored

#: Element names of HTML, by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object audio video canvas".split())
FURNITURE = frozenset("nav footer aside form button select menu dialog head script style".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | frozenset("html body head title li dt dd tr td th thead tbody tfoot caption colgroup summary legend optgroup option".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
STRUCTURE = frozenset("html body main article section div center table tbody tr td".split())
CONTAINERS = frozenset("main article section div center table".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon sidebar aside rail ad ads advert adverts advertisement advertising
    adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    login share sharing social related recommended recommendations comment comments respond replies reply disqus widget pagination pager toolbar skip""".split()
)

#: Compound names: what they begin or end with.
FURNITURE_COMPOUND = re.compile(r"(comment(s|list|area|box|form|thread|section)|cookie|advert|adslot|adbox|sidebar|footer|navbar|newsletter|sponsor|breadcrumb|social|banner|siteheader|pageheader).*|.*(nav|menu|sidebar|footer|banner|comments)")

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Different pages that a wrapper needs.
LEAST_PAGES = 3
#: Pages of a layout from which on a text that most have is template even among
#: the articles.
SIZEABLE = 5


class Names(dict):
    """Attributes of a start tag -> (classes, whether a name or role marks furniture); a bounded cache."""

    def __missing__(self, attributes: str) -> tuple[str, bool, bool]:
        got = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        both = f"{got.get('class', '')} {got.get('id', '')}"
        parts = re.split(r"[^A-Za-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", both)) if both.strip() else ()
        named = any(p.lower() in FURNITURE_NAMES or FURNITURE_COMPOUND.fullmatch(p.lower()) is not None for p in parts)
        out = re.sub(r"[0-9]+", "0", ".".join(got.get("class", "").split())), named, got.get("role", "").lower() in FURNITURE_ROLES
        if len(self) > 20_000:
            self.clear()
        self[attributes] = out
        return out


NAMES = Names()


class Node:
    """A block element; ``kids`` are the block elements below it without others between."""

    __slots__ = ("chars", "first", "hidden", "key", "kids", "last", "linked", "links", "ref", "shape", "sign", "tag")

    def __init__(self, tag: str, classes: str = "", hidden: bool = False, first: int = 0):
        self.tag, self.sign, self.hidden, self.first, self.last = tag, f"{tag}.{classes}", hidden, first, first
        self.kids: list[Node] = []
        self.chars = self.linked = self.links = 0
        self.ref = -1


class Page:
    """nodes in page order, the root first; texts: (node, text) in page order.
    A node's descendants are nodes[node.first : node.last]."""

    def __init__(self, source: str):
        self.root = Node("#root")
        self.nodes, self.texts = [self.root], []
        self._read(source)
        self.root.last = len(self.nodes)
        self._weigh()

    def _read(self, source: str) -> None:
        nodes, held, find = self.nodes, [], source.find
        stack: list[tuple[str, Node | None, bool]] = [("#root", self.root, False)]  # tag, its block, whether an inline piece of furniture
        owners, open_, inline = [self.root], Counter(), 0

        def flush() -> None:
            if held:
                got = " ".join("".join(held).split())
                held.clear()
                if got:
                    self.texts.append((owners[-1], got))

        def text(raw: str) -> None:
            if raw and not inline:
                raw = entities.unescape(raw) if "&" in raw else raw
                held.append(raw)
                if open_["a"]:
                    owners[-1].linked += len(raw.strip())

        def pop(to: int) -> None:
            nonlocal inline
            while len(stack) > to:
                tag, block, furniture = stack.pop()
                open_[tag] -= 1
                inline -= furniture
                if block is not None:
                    flush()
                    owners.pop().last = len(nodes)

        def close(tags, stops) -> None:
            if not any(open_[t] for t in tags):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    pop(i)
                    return
                if stack[i][0] in stops:
                    return

        at, end = 0, len(source)
        while at < end:
            to = find("<", at)
            if to < 0:
                break
            if source.startswith("<!--", to):
                text(source[at:to])
                at = find("-->", to + 4)
                at = end if at < 0 else at + 3
                continue
            if source[to + 1 : to + 2] in ("!", "?"):
                text(source[at:to])
                at = find(">", to)
                at = end if at < 0 else at + 1
                continue
            m = TAG.match(source, to)
            if m is None:
                if source[to + 1 : to + 2].isascii() and re.match(r"/?[a-zA-Z]", source[to + 1 : to + 3]):
                    text(source[at:to])
                    at = end  # a tag that never ends
                    break
                text(source[at : to + 1])
                at = to + 1
                continue
            text(source[at:to])
            at, tag, attributes = m.end(), m[2].lower(), m[3]
            if m[1]:
                close((tag,), ("td", "th") if tag not in ("table", "tr", "tbody", "body", "html") else ())
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    shut = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end if shut is None else shut.end()
                continue
            if tag in CLOSES_P:
                close(("p",), ("table", "td", "button"))
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], STOPS.get(tag, ()))
            alone = tag in VOID or attributes.rstrip().endswith("/")
            if tag not in BLOCKS:
                if tag == "br":
                    text(" ")
                elif not alone:
                    _, named, role = NAMES[attributes] if attributes else ("", False, False)
                    furniture = tag in FURNITURE or named or role
                    inline += furniture
                    open_[tag] += 1
                    owners[-1].links += tag == "a"
                    stack.append((tag, None, furniture))
                continue
            flush()
            if alone:
                continue
            classes, named, role = NAMES[attributes] if attributes else ("", False, False)
            hidden = owners[-1].hidden or inline > 0 or tag in FURNITURE or role or named and tag not in ("html", "body", "main", "article") or tag == "header" and not (open_["article"] or open_["main"])
            block = Node(tag, classes, hidden, len(nodes))
            nodes.append(block)
            owners[-1].kids.append(block)
            owners.append(block)
            open_[tag] += 1
            stack.append((tag, block, False))
        if at < end:
            text(source[at:])
        pop(1)
        flush()

    def _weigh(self) -> None:
        """chars: text below a node that no name marks as furniture.  Lists of
        links weigh nothing: they point at content rather than hold it."""
        for node, text in self.texts:
            node.chars += len(text)
        for node in reversed(self.nodes):
            for c in node.kids:
                if not c.hidden:
                    node.chars, node.linked, node.links = node.chars + c.chars, node.linked + c.linked, node.links + c.links
            if node.links > 2 and 5 * node.linked >= 4 * node.chars:
                node.chars = node.linked = node.links = 0
            node.key = node.shape = hash(node.sign)
            if node.kids:
                node.key = hash((node.sign, *(c.key for c in node.kids)))
                node.shape = hash((node.sign, *(s for s, _ in groupby(c.shape for c in node.kids))))  # however often each is repeated

    def below(self, node: Node):
        return ((n, t) for n, t in self.texts if node.first <= n.first < node.last)


def parse(source: str) -> Node:
    """The root of a page's tree."""
    return Page(source).root


def descend(root: Node) -> tuple[Node, list[str]]:
    """The container that holds most of one page's text, and the way to it."""
    at, taken = root, []
    while True:
        if at.tag in ("article", "main") and at.chars:
            inner = [c for c in at.kids if c.tag == "article" and c.chars]
            if at.tag == "article" or len(inner) != 1:
                return at, taken
        inside = [c for c in at.kids if c.tag in STRUCTURE and not c.hidden and c.chars]
        named = [c for c in inside if c.tag in ("main", "article")]
        best = named[0] if len(named) == 1 else max(inside, key=lambda c: c.chars, default=None)
        if best is None or len(named) != 1 and best.chars < 0.6 * at.chars:
            return at, taken
        taken.append(best.sign)
        at = best


class Tree:
    """A folded node: ``members`` are the page nodes that it stands for."""

    __slots__ = ("id", "key", "kids", "members", "sign")

    def __init__(self, sign: str, members: list[Node]):
        self.sign, self.members, self.id = sign, members, -1
        self.kids: list[Tree] = []


def fold(root: Node) -> Tree:
    out = Tree(root.sign, [root])
    every = [out]
    for t in every:
        for n in t.members:
            for c in n.kids:
                last = t.kids[-1] if t.kids else None
                if last is not None and last.sign == c.sign and (c.tag not in CONTAINERS or last.members[0].shape == c.shape):
                    last.members.append(c)
                else:
                    t.kids.append(Tree(c.sign, [c]))
        every += t.kids
    keyed(every)
    return out


def keyed(trees: list[Tree]) -> None:
    """Keys of trees listed after their parents; equal trees have equal keys."""
    for t in reversed(trees):
        t.key = hash((t.sign, *(c.key for c in t.kids)))


def skeleton(tree: Tree) -> str:
    """Lines of depth and signature, in page order."""
    lines, todo = [], [(tree, 0)]
    while todo:
        t, depth = todo.pop()
        lines.append(f"{depth} {t.sign}")
        todo += ((c, depth + 1) for c in reversed(t.kids))
    return "\n".join(lines)


def unfold(lines: str) -> list[Tree]:
    """The nodes of a skeleton, in page order; ids are places in it."""
    out, open_ = [], []
    for i, line in enumerate(lines.split("\n")):
        depth, sign = line.split(" ", 1)
        t = Tree(sign, [])
        t.id = i
        del open_[int(depth) :]
        if open_:
            open_[-1].kids.append(t)
        open_.append(t)
        out.append(t)
    keyed(out)
    return out


def preorder(tree) -> list:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        out.append(t)
        todo += reversed(t.kids)
    return out


def tree_match(a, b) -> list[tuple]:
    """Simple tree matching: the largest top-down set of pairs of nodes with
    equal signatures that keeps the order of siblings.

    Equal subtrees at both ends of two lists of siblings belong together in
    some largest set, so only what lies between them is compared by table.
    """
    middle: dict[tuple[int, int], tuple] = {}  # (x, y) -> where their kids differ and the table of it

    def total(x, y) -> int:
        return middle[id(x), id(y)][3]

    def size(t) -> int:
        return len(preorder(t))

    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        key = id(x), id(y)
        if key in middle and not ready:
            continue
        if not ready:
            xs, ys, k = x.kids, y.kids, 0
            n = min(len(xs), len(ys))
            while k < n and xs[k].key == ys[k].key:
                k += 1
            e = 0
            while e < n - k and xs[-1 - e].key == ys[-1 - e].key:
                e += 1
            middle[key] = (k, e, None, 0)
            todo.append((x, y, True))
            todo += ((c, d, False) for c in xs[k : len(xs) - e] for d in ys[k : len(ys) - e] if c.sign == d.sign)
        else:
            k, e = middle[key][:2]
            xs, ys = x.kids[k : len(x.kids) - e], y.kids[k : len(y.kids) - e]
            score = [[0] * (len(ys) + 1)]
            for c in xs if ys else ():
                above, row = score[-1], [0]
                for j, d in enumerate(ys):
                    row.append(max(above[j + 1], row[j], above[j] + total(c, d) if c.sign == d.sign else 0))
                score.append(row)
            same = x.kids[:k] + x.kids[len(x.kids) - e :]
            middle[key] = (k, e, score, 1 + score[-1][-1] + sum(map(size, same)))
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        k, e, score, _ = middle[id(x), id(y)]
        for i, j in [(i, i) for i in range(k)] + [(-i, -i) for i in range(1, e + 1)]:
            pairs += zip(preorder(x.kids[i]), preorder(y.kids[j]), strict=True)
        xs, ys = x.kids[k : len(x.kids) - e], y.kids[k : len(y.kids) - e]
        i, j = len(xs) if ys else 0, len(ys)
        while i and j:
            c, d = xs[i - 1], ys[j - 1]
            if c.sign == d.sign and score[i][j] == score[i - 1][j - 1] + total(c, d):
                todo.append((c, d))
                i, j = i - 1, j - 1
            elif score[i][j] == score[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def align(page: Page, reference: Tree) -> None:
    """Give every node of the page the id of the nearest container that is
    aligned to one of the reference."""
    for x, y in tree_match(fold(page.root), reference):
        for n in x.members:
            if n.tag in STRUCTURE or n is page.root:
                n.ref = y.id
    for n in page.nodes:
        for c in n.kids:
            if c.ref < 0:
                c.ref = n.ref


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def hashed(text: str) -> int:
    return signed(xxhash.xxh64_intdigest(text))


def layout_of(page: Page) -> int:
    return hashed("\n".join(descend(page.root)[1]))


def mark(node: Node, text: str) -> int:
    return hashed(f"{node.tag} {text}")


def facts(page: Page) -> tuple[int, dict[tuple[int, int], tuple[int, bool]]]:
    """Of an aligned page: hash of its longest text, and (node, mark) ->
    (characters, whether a name marks it as furniture) of its texts."""
    longest = max((t for _, t in page.texts), key=lambda t: (len(t), t), default="")
    return hashed(longest), {(n.ref, mark(n, t)): (len(t), n.hidden) for n, t in page.texts}


class Wrapper:
    """What a layout's pages have in common.

    slots, fixed: characters of varying and of constant texts, summed over the
    layout's pages by reference node; template: (node, mark, sure) of constant
    texts.  Within the content only sure ones count as template: what two of three
    articles share may be a quotation, what most of many share is a notice.
    """

    def __init__(self, lines: str, slots: dict[int, int], fixed: dict[int, int], template: Iterable[tuple[int, int, bool]]):
        self.reference = unfold(lines)
        held = [slots.get(i, 0) for i in range(len(self.reference))]
        size = [1] * len(held)
        for t in reversed(self.reference):
            for c in t.kids:
                held[t.id] += held[c.id]
                size[t.id] += size[c.id]
        at = self.reference[0]
        while True:
            best = max((c for c in at.kids if c.sign.split(".", 1)[0] in STRUCTURE), key=lambda c: held[c.id], default=None)
            if best is None or held[best.id] < 0.6 * held[at.id] or not held[best.id]:
                break
            at = best
        self.content, self.usable = at.id, held[at.id] > 0
        inside = range(at.id, at.id + size[at.id])
        self.template = frozenset((ref, m) for ref, m, certain in template if certain or ref not in inside)
        if sum(fixed.get(i, 0) for i in inside) > held[at.id]:  # more constant than varying text in the articles: they are copies
            self.template = frozenset(x for x in self.template if x[0] not in inside)

    @classmethod
    def of(cls, packed: str) -> Wrapper:
        got = json.loads(packed)
        pairs = lambda k: {x["ref"]: x["chars"] for x in got.get(k) or ()}
        return cls(got["reference"], pairs("slots"), pairs("fixed"), ((x["ref"], x["mark"], x["sure"]) for x in got.get("template") or ()))


def induce(sources: list[str], least_pages: int = LEAST_PAGES) -> Wrapper | None:
    """Wrapper of pages of one layout in memory, as wrappers() makes it."""
    pages = [Page(s) for s in dict.fromkeys(sources)]
    if not pages:
        return None
    trees = Counter(skeleton(fold(p.root)) for p in pages)
    lines = max(trees.items(), key=lambda x: (x[1], -len(x[0]), x[0]))[0]
    first = {}
    for p in pages:
        align(p, unfold(lines)[0])
        lead, found = facts(p)
        first.setdefault(lead, found)
    if len(first) < least_pages:
        return None
    on = Counter(k for found in first.values() for k in found)
    slots, fixed, template = defaultdict(int), defaultdict(int), []
    for found in first.values():
        for (ref, m), (chars, furniture) in found.items():
            constant = 2 * on[ref, m] > len(first)
            if constant:
                template.append((ref, m, len(first) >= SIZEABLE))
            if not furniture:
                (fixed if constant else slots)[ref] += chars
    return Wrapper(lines, slots, fixed, template)


def extract(source: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of a page."""
    return cut(Page(source), wrapper) if isinstance(source, str) and source else ""


def cut(page: Page, wrapper: Wrapper | None) -> str:
    if wrapper is not None and wrapper.usable:
        align(page, wrapper.reference[0])
        inside = [n for n in page.nodes if n.ref == wrapper.content]
        if inside:
            spans, last = [], 0
            for n in inside:  # in page order; a node inside another one adds nothing
                if n.last > last:
                    spans.append((max(n.first, last), n.last))
                    last = n.last
            held = bytearray(len(page.nodes))
            for a, b in spans:
                held[a:b] = b"\1" * (b - a)
            return "\n".join(t for n, t in page.texts if held[n.first] and not n.hidden and (n.ref, mark(n, t)) not in wrapper.template)
    return "\n".join(t for n, t in page.below(descend(page.root)[0]) if not n.hidden)


class Wrappers(dict):
    """Packed wrapper -> Wrapper; a bounded cache."""

    def __missing__(self, packed: str) -> Wrapper:
        if len(self) > 1000:
            self.clear()
        self[packed] = made = Wrapper.of(packed)
        return made


class References(dict):
    """Skeleton -> its tree; a bounded cache."""

    def __missing__(self, lines: str) -> Tree:
        if len(self) > 1000:
            self.clear()
        self[lines] = made = unfold(lines)[0]
        return made


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id (as text), url, html, host, layout and folded tree, stored: pages
    are parsed once for all that depends on a page alone.  layout and tree are
    null without a html."""

    def run(batches):
        for pdf in batches:
            found = []
            for source in pdf["html"]:
                page = Page(source) if source else None
                found.append((layout_of(page), skeleton(fold(page.root))) if page else (None, None))
            layout = pd.Series([f[0] for f in found], dtype="Int64", index=pdf.index)
            yield pdf.assign(layout=layout, tree=pd.Series([f[1] for f in found], dtype=object, index=pdf.index))

    rows = pages.select(*as_text("page_id"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    return stored(rows.mapInPandas(run, "page_id string, url string, html string, host string, layout long, tree string"), "parsed", compression="zstd")


def references(rows: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, layout, reference: the commonest folded tree of every layout with
    enough pages among the parsed ``rows``, ties to the shortest."""
    n = rows.where("layout IS NOT NULL").groupBy("host", "layout", "tree").agg(F.count("*").alias("n"))
    best = n.groupBy("host", "layout").agg(F.max(F.struct("n", (-F.length("tree")).alias("shorter"), "tree")).alias("best"), F.sum("n").alias("pages"))
    return best.where(F.col("pages") >= least_pages).select("host", "layout", F.col("best.tree").alias("reference"))


def aligned(parsed_rows: DataFrame, known: DataFrame) -> DataFrame:
    """host, layout, texts(ref, mark, chars, furniture): one page for each
    longest text of a layout."""

    def run(batches):
        trees = References()
        for pdf in batches:
            rows = []
            for host, layout, source, lines in zip(*(pdf[c] for c in ("host", "layout", "html", "reference")), strict=True):
                page = Page(source)
                align(page, trees[lines])
                lead, found = facts(page)
                rows.append((host, layout, lead, hashed(source), [(ref, m, chars, f) for (ref, m), (chars, f) in found.items()]))
            yield pd.DataFrame(rows, columns=["host", "layout", "lead", "page", "texts"])

    rows = parsed_rows.select("host", "layout", "html").join(known, ["host", "layout"]).select("host", "layout", "html", "reference")
    read = rows.mapInPandas(run, "host string, layout long, lead long, page long, texts array<struct<ref:int,mark:long,chars:int,furniture:boolean>>")
    return read.groupBy("host", "layout", "lead").agg(F.min(F.struct("page", "texts")).alias("first")).select("host", "layout", "first.texts")


def wrappers(rows: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, layout, wrapper: from all pages of each layout of the parsed ``rows``."""
    known = stored(references(rows, least_pages), "references")
    read = stored(aligned(rows, known), "aligned")
    on = ["host", "layout"]
    sizes = stored(read.groupBy(on).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages), "layouts")
    one = read.select(*on, F.explode("texts").alias("t")).select(*on, "t.*")
    weight = lambda c: F.sum(F.when(F.col("furniture"), F.lit(0)).otherwise(F.col(c))).alias("chars")
    every = one.groupBy(*on, "ref").agg(weight("chars"))
    n = one.groupBy(*on, "ref", "mark").agg(F.count("*").alias("n"), F.max("chars").alias("each"), F.max("furniture").alias("furniture"))
    template = stored(n.where("n > 1").join(sizes, on).where("2 * n > pages").withColumn("sure", F.col("pages") >= SIZEABLE).withColumn("all_chars", F.col("n") * F.col("each")), "template")
    fixed = template.groupBy(*on, "ref").agg(weight("all_chars"))
    slots = every.join(fixed.withColumnRenamed("chars", "fixed"), [*on, "ref"], "left").select(*on, F.struct("ref", (F.coalesce("chars", F.lit(0)) - F.coalesce("fixed", F.lit(0))).alias("chars")).alias("x"))
    gather = lambda df, name: df.groupBy(on).agg(F.sort_array(F.collect_list("x")).alias(name))
    out = known.join(sizes, on)
    out = out.join(gather(slots, "slots"), on, "left").join(gather(fixed.select(*on, F.struct("ref", "chars").alias("x")), "fixed"), on, "left")
    out = out.join(gather(template.select(*on, F.struct("ref", "mark", "sure").alias("x")), "template"), on, "left")
    return out.select(*on, F.to_json(F.struct("reference", "slots", "fixed", "template")).alias("wrapper"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = parsed(pages)
    known = stored(wrappers(pages, least_pages), "wrappers")
    rows = pages.join(known, ["host", "layout"], "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        read = Wrappers()
        for pdf in batches:
            texts = [extract(source, read[w] if isinstance(w, str) else None) for source, w in zip(pdf["html"], pdf["wrapper"], strict=True)]
            yield pdf[["page_id", "url"]].assign(text=pd.Series(texts, dtype=object, index=pdf.index), n_chars=[len(t) for t in texts])

    return as_longs(rows.mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
