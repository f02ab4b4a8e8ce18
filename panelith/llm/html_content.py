"""Main text of web pages by wrapper induction: trees of a host's pages are aligned by simple tree matching, constant nodes become template, varying slots content.

A page's tree has a node for each distinct path of block elements, named by tag and classes; its id is a hash of its path, so trees, slots and
statistics are narrow rows however deep a page is. All trees of a host are merged into one wrapper, in rounds of bounded groups; then each
tree is matched with that wrapper on its own, which gives each node its slot. Over all pages of the host, a slot knows how often it is there, how
much of its text is the same on most pages, and how much is links. The wrapper's region of content is found from its root down: a
container is entered as long as it holds most of the host's varying text that isn't links.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import materialise, ship, spread_join, table

# HTML's element classes, and names that mark parts beside the content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html head hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style template noscript svg math canvas iframe object embed applet audio video select option button input textarea nav footer aside form dialog menu head title noembed noframes".split())
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "li"} | {"li", "dd", "dt"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl td th body html article section div".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion promoted related respond reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
#: Words that may stand beside such a name in a class or an id without changing what it says ("site-footer", "widget_area").
AROUND_NAMES = frozenset("area articles bar block bottom box button buttons col column container content fixed form global group holder icon icons inner item items left link links list main mobile outer page panel post posts primary right row secondary section site text title top unit wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<other>[!?][^>]*(?:>|\Z))|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")
#: Elements that may be entered on the way to the content; others, such as paragraphs and lists, are parts of it.
CONTAINERS = frozenset("html body main article section div center table tbody tr td fieldset".split())
MANY = 64  # kinds of classes that an element's children of one tag may have; more are rows of data and share a node
MIN_PAGES = 4
CONSTANT = 0.8
LINKED = 0.5  # a slot of which more is link text is a menu
MOST = 0.7  # of the varying text: what a container holds to be entered
GROUP = 64  # trees that are merged in a task
#: Up to this size the wrappers go to all executors; beyond that they are shuffled to the pages.
BROADCAST_BYTES = 32 << 20


@dataclass
class Block:
    """A run of text within one block element."""

    node: int  # in the page's tree
    text: str
    linked: int  # characters of it within links
    aside: bool  # in a part beside the content, by its elements
    main: bool  # in an article or main element


@dataclass
class Page:
    """A page's tree, as (parent, label) of each node after its parent, the root 0 first; and its blocks in order."""

    nodes: list[tuple[int, str]]
    blocks: list[Block]

    @cached_property
    def ids(self) -> list[int]:
        return ids_of(self.nodes)


@dataclass
class _Open:
    name: str
    label: str
    aside: bool
    main: bool
    node: int


def _beside(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_main:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "") in ASIDE_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if name in HEADINGS or in_main and name in INLINE or name in ("body", "html", "article", "main"):
        return False
    # Ids are often made of the words of a heading: within an article they say nothing, and elsewhere, as classes do, only if all of their words do.
    named = attrs.get("class", "") if in_main else f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return any(_names_aside(token, in_main) for token in named.lower().split())


@lru_cache(65536)
def _names_aside(token: str, in_main: bool) -> bool:
    words = re.findall(r"[^\W\d_]+", token)
    telling = [w for w in words if w in ASIDE_NAMES and not (in_main and w == "header")]  # an article's own header holds its title
    return bool(telling) and all(w in ASIDE_NAMES or w in AROUND_NAMES for w in words)


def parse(page: str | None) -> Page:
    """The tree and the text blocks of a page. Any input is taken: unclosed and misnested tags are closed as browsers do in the common cases, what isn't a tag is text."""
    page = page or ""
    out: list[Block] = []
    nodes: list[tuple[int, str]] = [(-1, "")]
    known: dict[tuple[int, str], int] = {}
    kinds: Counter[tuple[int, str]] = Counter()
    stack = [_Open("", "", False, False, 0)]
    text: list[str] = []
    linked = [0, 0]  # open links, and the place in text from which on it is link text

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            inside = _SPACE.sub(" ", entities.unescape("".join(t for t, link in zip(text, links, strict=True) if link))).strip()
            text.clear()
            links.clear()
            if joined:
                top = stack[-1]
                out.append(Block(top.node, joined, min(len(inside), len(joined)), top.aside, top.main))

    links: list[bool] = []

    def add(piece: str) -> None:
        text.append(piece)
        links.append(linked[0] > 0)

    def close(to: int) -> None:
        if any(o.label for o in stack[to:]):
            flush()
        linked[0] -= sum(o.name == "a" for o in stack[to:])
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if (name := m["tag"]) is not None:
            name = name.lower()
            if name == "br" or name == "hr":
                flush()
                continue
            if name in VOID:
                continue
            if name in ENDS_P or name in CLOSES:
                ends = CLOSES.get(name, ())
                for i in range(len(stack) - 1, 0, -1):
                    own = stack[i].name
                    if own == "p" and name in ENDS_P or own in ends:
                        close(i)
                        if own == "p":
                            continue
                    elif own in SCOPE:
                        break
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(m["attrs"])} if m["attrs"].strip(" /") else {}
            block = name in BLOCK or name in RAW or name in SKIPPED or name not in INLINE
            if block:
                flush()
            top = stack[-1]
            beside = _beside(name, attrs, top.main)
            if beside and not block:
                flush()
            label, node = "", top.node
            if block or beside:
                classes = ".".join(sorted(_NUMBER.sub("0", attrs.get("class", "")).split())) if block else ""
                label = f"{name}.{classes}" if classes else name
                if (top.node, label) not in known:
                    kinds[top.node, name] += 1
                    if kinds[top.node, name] > MANY:
                        label = name
                node = known.get((top.node, label), -1)
                if node < 0:
                    node = known[top.node, label] = len(nodes)
                    nodes.append((top.node, label))
            stack.append(_Open(name, label, top.aside or beside, top.main or name in ("article", "main") or attrs.get("role") in ("main", "article"), node))
            linked[0] += name == "a"
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                text.clear()
                links.clear()
                stack.pop()
        elif (name := m["end"]) is not None:
            name = name.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i].label and stack[i].name in BLOCK:
                    break
            else:
                if name == "p" or name == "br":
                    flush()
    flush()
    return Page(nodes, out)


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed % 2**64) - (1 << 63)


def ids_of(nodes: list[tuple[int, str]]) -> list[int]:
    """Each node's id: a hash of its path."""
    out: list[int] = []
    for parent, label in nodes:
        out.append(_hash(label, out[parent]) if parent >= 0 else 0)
    return out


def to_text(nodes: list[tuple[int, str]]) -> str:
    return "\n".join(f"{parent} {label}" for parent, label in nodes)


def from_text(text: str) -> list[tuple[int, str]]:
    return [(int(parent), label) for parent, _, label in (line.partition(" ") for line in text.split("\n"))]


def _children(nodes: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (parent, _) in enumerate(nodes):
        if parent >= 0:
            out[parent].append(i)
    return out


def match(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the largest weight of node pairs that keep tags, order and ancestors, and b's partner of each node of a.

    A pair counts 2, one with equal classes 3. Works from the deepest pairs up without recursion, so depth doesn't matter.
    """
    below_a, below_b = _children(a), _children(b)
    tag = lambda label: label.partition(".")[0]
    tags_a, tags_b = [tag(x) for _, x in a], [tag(x) for _, x in b]
    met = [(0, 0)]
    for i, j in met:  # grows while it is walked
        if below_a[i] and below_b[j]:
            by_tag: dict[str, list[int]] = {}
            for y in below_b[j]:
                by_tag.setdefault(tags_b[y], []).append(y)
            met += [(x, y) for x in below_a[i] for y in by_tag.get(tags_a[x], ())]
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(met):
        xs, ys = below_a[i], below_b[j]
        best = 0
        if xs and ys:
            rows = [[0] * (len(ys) + 1)]
            for x in xs:
                last, row = rows[-1], [0]
                for k, y in enumerate(ys):
                    w = weight.get((x, y))
                    top = last[k + 1] if last[k + 1] > row[k] else row[k]
                    row.append(last[k] + w if w is not None and last[k] + w > top else top)
                rows.append(row)
            tables[i, j] = rows
            best = rows[-1][-1]
        weight[i, j] = best + 2 + (a[i][1] == b[j][1])
    partner = {0: 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        rows = tables.get((i, j))
        if rows is None:
            continue
        m, n = len(below_a[i]), len(below_b[j])
        while m and n:
            if rows[m][n] == rows[m - 1][n]:
                m -= 1
            elif rows[m][n] == rows[m][n - 1]:
                n -= 1
            else:
                x, y = below_a[i][m - 1], below_b[j][n - 1]
                partner[x] = y
                todo.append((x, y))
                m, n = m - 1, n - 1
    return weight[0, 0], partner


def merge(trees: list[list[tuple[int, str]]]) -> list[tuple[int, str]]:
    """A wrapper of all trees, which come in order of weight: each is matched with the wrapper so far, and nodes without a partner join it below their parent's."""
    wrapper = list(trees[0])
    have = {(p, label): i for i, (p, label) in enumerate(wrapper)}
    for tree in trees[1:]:
        _, partner = match(tree, wrapper)
        for i, (parent, label) in enumerate(tree):
            if i not in partner:
                key = (partner[parent], label)
                if key not in have:
                    have[key] = len(wrapper)
                    wrapper.append(key)
                partner[i] = have[key]
    return wrapper


def slots_of(tree: list[tuple[int, str]], wrapper: list[tuple[int, str]]) -> list[int]:
    """The slot of each node of a tree: its partner in the wrapper, or its own place below its parent's if it has none."""
    _, partner = match(tree, wrapper)
    ids, out = ids_of(wrapper), []
    for i, (parent, label) in enumerate(tree):
        out.append(ids[partner[i]] if i in partner else _hash(label, out[parent]))
    return out


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


def copy_key(blocks: list[Block]) -> int:
    """Pages that agree in this are copies: a hash of the two longest texts in their article or main elements, or of all texts where there are none. Copies of a page count once, or what they share would pass for a template."""
    inside = sorted({b.text for b in blocks if b.main}, key=lambda t: (-len(t), t))[:2]
    return _hash("\n".join(inside or sorted({b.text for b in blocks})))


@dataclass
class Wrapper:
    """What extraction needs of a host: slots of trees, slots in the region of content, and what is template in them."""

    nodes: str  # the merged tree
    region: frozenset[int]
    titles: frozenset[int]  # varying first headings outside the region
    menus: frozenset[int]
    constant: frozenset[tuple[int, int]]  # (slot, text's hash)


@lru_cache(4096)
def _placed(tree: str, wrapper: str) -> tuple[int, ...]:
    return tuple(slots_of(from_text(tree), from_text(wrapper)))


@lru_cache(512)
def _loaded(data: bytes) -> Wrapper:
    return pickle.loads(data)


def region_of(wrapper: list[tuple[int, str]], mass: dict[int, int]) -> set[int]:
    """The slots of the subtree that holds the content: from the root on, the container below that holds MOST of the varying text is entered."""
    ids, below = ids_of(wrapper), _children(wrapper)
    total = [mass.get(i, 0) for i in ids]
    for i in range(len(wrapper) - 1, 0, -1):  # parents come first
        total[wrapper[i][0]] += total[i]
    at = 0
    while True:
        inside = [c for c in below[at] if wrapper[c][1].partition(".")[0] in CONTAINERS]
        best = max(inside, key=lambda c: (total[c], -c), default=None)
        if best is None or total[best] < MOST * total[0] or not total[best]:
            break
        at = best
    out, todo = set(), [at]
    while todo:
        n = todo.pop()
        out.add(ids[n])
        todo += below[n]
    return out


def extract(page: Page, wrapper: Wrapper | None, use_elements: bool = True) -> str:
    """The content of a page.

    With a wrapper, it decides first: blocks in its region (and varying first headings outside it) that are neither constant on the host's pages
    nor a menu's. Of these, parts that their elements mark as beside the content, such as readers' comments, are left out. A page that has nothing
    there, or no wrapper, is judged on its own: by its article or main element if one holds text, else by all parts that aren't marked so.
    use_elements: False keeps parts whatever their elements and names say; only which
    nodes are containers, that a first heading may be a title, and which pages are copies of an article still goes by elements.
    """
    own = [b for b in page.blocks if not (use_elements and b.aside)]
    if wrapper is not None and own:
        of = _placed(to_text(page.nodes), wrapper.nodes)
        kept = [b for b in page.blocks if of[b.node] not in wrapper.menus and (of[b.node] in wrapper.region or of[b.node] in wrapper.titles) and (of[b.node], _hash(b.text)) not in wrapper.constant]
        kept = [b for b in kept if not (use_elements and b.aside)]
        if any(of[b.node] in wrapper.region for b in kept):
            return " ".join(b.text for b in kept)
    if use_elements and any(b.main for b in own):
        own = [b for b in own if b.main]
    return " ".join(b.text for b in own)


def _outlines(pages: DataFrame, use_elements: bool) -> DataFrame:
    """(host, copy, tree, blocks) of each page with a host and text: blocks as (id of the node, hash of the text, characters, of these within links, of these in parts that their elements don't mark as beside the content)."""
    kind = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32()), ("open", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                rows = []
                for url, html in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    host = host_of(url)
                    page = parse(html) if host is not None else None
                    own = [x for x in page.blocks if not (use_elements and x.aside)] if page else []
                    if own:
                        ids = page.ids
                        blocks = [{"node": ids[x.node], "text": _hash(x.text), "chars": len(x.text), "linked": x.linked, "open": 0 if use_elements and x.aside else len(x.text)} for x in page.blocks]
                        rows.append((host, copy_key(own), to_text(page.nodes), blocks))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), kind), strict=True)], names=["host", "copy", "tree", "blocks"])

    schema = "host string, copy long, tree string, blocks array<struct<node:long,text:long,chars:int,linked:int,open:int>>"
    return pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


def _merged(kinds: DataFrame) -> DataFrame:
    """(host, wrapper) of kinds (host, tree, n): in each round, groups of some GROUP trees of a host are merged, until each host has one."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "tree"], ascending=[False, True])
        return pd.DataFrame([(key[0], to_text(merge([from_text(t) for t in rows.tree])), int(rows.n.sum()))], columns=["host", "tree", "n"])

    rounds = 0
    while True:
        sizes = kinds.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
        dealt = spread_join(kinds, sizes, ["host"], "tree").withColumn("part", F.pmod(F.xxhash64("tree", F.lit(rounds)), F.col("groups")))
        kinds = materialise(dealt.groupBy("host", "part").applyInPandas(run, "host string, tree string, n long"), "wrappers")
        rounds += 1
        if kinds.groupBy("host").count().filter("count > 1").isEmpty():
            return kinds.select("host", F.col("tree").alias("wrapper"))


def induce(pages: DataFrame, min_pages: int = MIN_PAGES, constant: float = CONSTANT, use_elements: bool = True) -> DataFrame:
    """(host, data) of hosts with at least min_pages pages that aren't copies of each other: a Wrapper each, pickled.

    A text is constant in a slot if at least min_pages such pages, and a share of at least `constant` of those that have the slot, hold
    it there; all blocks are judged so. Only where the region of content is goes by parts that aren't marked as beside it (all, without use_elements),
    since long comments would draw it outwards. Trees, texts and slots are counted with partial aggregation, so a hot host or a copied page is small before it is
    shuffled; a host's trees meet in bounded groups.
    """
    ship(pages.sparkSession)
    outlines = materialise(_outlines(pages, use_elements), "outlines")
    kinds = materialise(outlines.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")), "trees")
    wrappers = _merged(kinds)

    @F.pandas_udf("array<struct<node:long,slot:long>>")
    def moves(tree: pd.Series, wrapper: pd.Series) -> pd.Series:
        both = ((ids_of(from_text(t)), _placed(t, w)) for t, w in zip(tree, wrapper, strict=True))
        return pd.Series([[{"node": i, "slot": s} for i, s in zip(ids, slots, strict=True) if i != s] for ids, slots in both])

    blocks = outlines.select("host", "copy", F.xxhash64("tree").alias("key"), F.explode("blocks").alias("b")).select("host", "copy", "key", "b.*")
    # One row for each text that a page and its copies have in a node: then slots by the tree's alignment.
    texts = blocks.groupBy("host", "key", "node", "text", "copy").agg(F.first("chars").alias("chars"), F.first("linked").alias("linked"), F.max("open").alias("open"))
    moved = spread_join(kinds, wrappers, ["host"], "tree").select("host", F.xxhash64("tree").alias("key"), F.explode(moves("tree", "wrapper")).alias("s")).select("host", "key", "s.node", "s.slot")
    texts = texts.join(moved, ["host", "key", "node"], "left").select("host", F.coalesce("slot", "node").alias("slot"), "text", "copy", "chars", "linked", "open")
    texts = materialise(texts.groupBy("host", "slot", "text", "copy").agg(*[F.max(c).alias(c) for c in ("chars", "linked", "open")]), "texts")
    of_slot = texts.select("host", "slot", "copy").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"))
    counts = texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("chars", "linked", "open")])
    counts = spread_join(counts, of_slot, ["host", "slot"], "text")
    counts = counts.withColumn("fixed", (F.col("n") >= min_pages) & (F.col("n") >= constant * F.col("pages")))
    varying = F.sum(F.when(~F.col("fixed"), F.col("open")).otherwise(0)).alias("varying")
    stats = counts.groupBy("host", "slot").agg(varying, F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.collect_list(F.when(F.col("fixed"), F.col("text"))).alias("fixed"))
    enough = texts.select("host", "copy").distinct().groupBy("host").count().filter(F.col("count") >= min_pages).select("host")
    # A wrapper's slots are as many as its nodes: trees of a host differ in few.
    slim = stats.join(enough, "host").groupBy("host").agg(F.collect_list(F.struct("slot", "varying", "chars", "linked", "fixed")).alias("stats"))

    @F.pandas_udf("binary")
    def build(wrapper: pd.Series, stats: pd.Series) -> pd.Series:
        return pd.Series([pickle.dumps(_wrapper(w, list(s))) for w, s in zip(wrapper, stats, strict=True)])

    return materialise(wrappers.join(slim, "host").select("host", build("wrapper", "stats").alias("data")), "wrapper-data")


def _wrapper(tree: str, stats: list) -> Wrapper:
    nodes = from_text(tree)
    chars = {s["slot"]: s["chars"] for s in stats}
    menus = frozenset(s["slot"] for s in stats if s["linked"] > LINKED * s["chars"])
    mass = {s["slot"]: s["varying"] for s in stats if s["slot"] not in menus}
    region = region_of(nodes, mass)
    headings = {i for i, (_, label) in zip(ids_of(nodes), nodes, strict=True) if label.partition(".")[0] == "h1"}
    titles = {i for i in headings - region if 2 * mass.get(i, 0) > chars.get(i, 0)}
    return Wrapper(tree, frozenset(region), frozenset(titles), menus, frozenset((s["slot"], t) for s in stats for t in s["fixed"]))


def main_text(pages: DataFrame, use_wrappers: bool = True, use_elements: bool = True) -> DataFrame:
    """pages (with url and html) with text, the content of each page. use_wrappers: False judges each page on its own; use_elements: False leaves all to the wrappers.

    Blocks are joined by one space in page order, character references decoded, white space within a block turned into one space.
    Null or empty html gives an empty text; pages without a host, or of a host with few pages, are judged on their own; a column text that is there is replaced, others stay.
    Wrappers within a bound of bytes go to the pages, which stay where they are; beyond it both are shuffled, a hot host's pages over several tasks.
    """
    spark = pages.sparkSession
    ship(spark)
    rest = [c for c in pages.columns if c.lower() != "text"]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]).alias("row")
    rows = pages.select(packed, F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    unpacked = [F.col(f"row._{i}").alias(c) for i, c in enumerate(rest)]
    found = induce(pages, use_elements=use_elements) if use_wrappers else None
    if found is None or found.agg(F.coalesce(F.sum(F.length("data") + F.length("host")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: bytes(r["data"]) for r in found.collect()} if found is not None else {})

        @F.pandas_udf("string")
        def content(url: pd.Series, page: pd.Series) -> pd.Series:
            wrappers = [known.value.get(host_of(u)) for u in url]
            return pd.Series([extract(parse(p), None if w is None else _loaded(w), use_elements) for p, w in zip(page, wrappers, strict=True)], dtype=object)

        return rows.select(*unpacked, content("url", "html").alias("text"))

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    @F.pandas_udf("string")
    def joined_content(page: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([extract(parse(p), None if w is None else _loaded(bytes(w)), use_elements) for p, w in zip(page, data, strict=True)], dtype=object)

    met = spread_join(rows.withColumn("host", host("url")).withColumn("_by", F.xxhash64("html")), found, ["host"], "_by", 64, "left")
    return met.select(*unpacked, joined_content("html", "data").alias("text"))


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
