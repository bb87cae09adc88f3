"""Main text of web pages by minimum-cut labelling of their blocks.

A tokenizer of its own reads the whole page (raw text is skipped up to its end tag or, as in browsers, the page's end;
void and unclosed elements are handled, media elements without an end tag are empty) and yields text blocks with the
element around each. A linear classifier of link density, length, closing mark and tags, fitted by logistic regression
to the blocks that say what they are on a bounded sample of pages, gives a block its cost for each label; these are the
capacities of the block's edges to the terminals. Neighbouring blocks, the more the closer they are in the element tree,
are joined by smoothness edges. The minimum cut (max-flow by shortest augmenting paths) parts content from boilerplate.

A block in an element that says what it is (nav, footer, hidden, or inside an article a class that names a menu, notice,
advert, ... and nothing else) is boilerplate for certain and pulls at no neighbour. A block of an article or main costs
more to give up than all its smoothness edges together. Elsewhere, class and id words ("ad", "comments", ...) put their
element in doubt: a finite cost, which an article or main inside takes back. Work and memory are linear in a page's
length, however deep its elements are nested.

Defined results: null, empty and text-free pages give the empty text; broken markup never fails, an unclosed element
ends with its parent; repeated rows get equal texts; an empty table gives an empty result; further columns pass
through, those named text or n_chars are replaced; without pages that say what is content the classifier is the fixed
one that the fit starts from.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from prismcat.llm.common import read

# Element names of HTML.
RAW = frozenset("script style textarea title iframe".split())
#: Elements whose text is not shown or not the page's; a run of text goes on after those of the first kind.
ASIDE = frozenset("noscript template object svg canvas video audio annotation annotation-xml".split())
HIDDEN = ASIDE | frozenset("select datalist optgroup option head map".split())
#: Elements whose inside is a fallback: without an end tag of their own they are empty.
MEDIA = {name: re.compile(rf"<(/?){name}\b", re.I) for name in ("video", "audio", "canvas", "object", "iframe")}
#: Elements that may be closed by "/>", and so may any element inside them; those of PAGE_TAGS end them, but not inside INTEGRATION.
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
PAGE_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside header footer nav figure form".split()
)
MATH = frozenset("math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts none mstyle merror mpadded mphantom menclose mfenced maction".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
#: Elements that are boilerplate whatever stands around them.
PLAIN_BOILER = frozenset("nav aside footer form button fieldset menu dialog".split())
BLOCKED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Words of class and id attributes that name menus, sidebars, notices, adverts, forms, comments.
KIND_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer "
    "comment comments commentlist disqus reply replies respond share sharing social subscribe newsletter signup login cookie cookies consent gdpr notice notices notification popup modal overlay pagination pager".split()
)
#: And those that speak of boilerplate outside an article only.
BOILER_WORDS = KIND_WORDS | frozenset("banner aside foot masthead topbar toolbar header follow alert related recommended recommendations widget widgets paging copyright legal disclaimer search tags tagcloud skip".split())
#: Words that may stand beside a word of a kind without changing what it names.
QUALIFIERS = frozenset("bar box list lists container wrapper wrap section area block item items link links button buttons panel inner outer site page top bottom left right main primary secondary reader readers user users post entry article slot unit row column col sm md lg xl the and form forms text content thread policy".split())
CONTENT_WORDS = frozenset("article content main post story entry body text page prose maincontent articlebody".split())
ARTICLE_WORDS = frozenset("article post story entry".split())
#: First words of a class that tell what an element has, not what it is.
HAS_WORDS = frozenset("has have no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose id, too, may name a kind inside an article.
CONTAINERS = frozenset("div ul ol dl table".split())
TEXT_TAGS = frozenset("p h1 h2 h3 blockquote pre".split())
#: Capacities in thousandths. ARTICLE is above the sum of a block's smoothness edges, of which it has four at most.
DOUBTED, DOUBTED_MARKED = 1200, 1900
SURE, ARTICLE, SMOOTH_SAME, SMOOTH_NEAR, SMOOTH_FAR = 1_000_000, 10_000, 900, 500, 150

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_TAG = re.compile(r"</?[a-zA-Z!]")
#: An opening tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details figure figcaption menu".split())
_SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol dl form blockquote select datalist".split()) | ASIDE


class Element:
    """An open element: what it says about its text, and where its ancestors stand on the stack."""

    __slots__ = ("name", "state", "parent", "box", "depth", "in_content", "texty", "floor", "foreign", "scope")

    def __init__(self, name: str, state: int, parent: Element | None, at: int):
        self.name, self.state, self.parent = name, state, parent
        inline = name in INLINE
        #: the nearest element that is not inline, and its number of ancestors of that sort
        self.box: Element | None = (parent.box if parent else None) if inline else self
        self.depth = (parent.depth if parent else 0) + (not inline)
        self.in_content = name in ("article", "main") or (parent is not None and parent.in_content)
        self.texty = name in TEXT_TAGS or (parent is not None and parent.texty)
        #: places on the stack, -1 for none: nearest element that is not inline, of another namespace, of a scope
        self.floor = at if not inline else parent.floor if parent else -1
        self.foreign = at if name in FOREIGN or name in INTEGRATION else parent.foreign if parent else -1
        self.scope = at if name in _SCOPE else parent.scope if parent else -1


def _above(box: Element | None) -> Element | None:
    """The nearest element around a box that is not inline."""
    return box.parent.box if box is not None and box.parent is not None else None


class Block:
    """A run of text without a block boundary in it: pieces, characters inside links, and the element around it."""

    __slots__ = ("box", "state", "texty", "parts", "size", "linked", "text")

    def __init__(self, inside: Element | None):
        self.box = inside.box if inside else None
        self.state = inside.state if inside else NEUTRAL
        self.texty = inside is not None and inside.texty
        self.parts: list[str] = []
        self.size = self.linked = 0
        self.text = ""


#: What the elements around a block say: nothing, content, boilerplate, boilerplate by a word of a class or id.
NEUTRAL, CONTENT, BOILER, DOUBT = 0, 1, 2, 3


def _named(value: str) -> Iterator[tuple[list[str], bool]]:
    """The words of each name in a class or id, and whether they name a kind and nothing else."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        yield words, any(w in KIND_WORDS for w in words) and all(w in KIND_WORDS or w in QUALIFIERS for w in words)


def _state(name: str, attributes: str, parent: Element | None) -> int:
    """State of an element: boilerplate and doubt are inherited; article and main make content, but not in doubt inside another."""
    before, in_content = (parent.state, parent.in_content) if parent else (NEUTRAL, False)
    if before == BOILER or name in PLAIN_BOILER or name in HIDDEN:
        return BOILER
    if name == "header":
        return before if in_content else BOILER
    state = CONTENT if name in ("article", "main") and not (before == DOUBT and in_content) else before
    if not attributes or name in ("html", "body"):
        return state
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes):
        return BOILER
    doubt = False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in BLOCKED_ROLES:
            return BOILER
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return BOILER
        if key not in ("class", "id") or name in HEADINGS or name in INLINE or (key == "id" and name not in CONTAINERS and name not in ("article", "main", "section")):
            continue
        names = list(_named(value))
        words = {w for f, _ in names for w in f}
        if in_content:  # only a name that says nothing else
            if any(whole for _, whole in names) and not (key == "id" and name not in CONTAINERS):
                return BOILER
            continue
        against = {w for f, _ in names if f and f[0] not in HAS_WORDS for w in f} & BOILER_WORDS
        if against == {"header"} and words & ARTICLE_WORDS:
            against = set()  # an article's own heading
        if against and name not in ("p", "blockquote", "pre") or any(whole for _, whole in names):
            doubt = doubt or not (name in ("article", "main") and words & CONTENT_WORDS)
        elif state == NEUTRAL and words & CONTENT_WORDS:
            state = CONTENT
    return DOUBT if doubt else state


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # where on the stack the open elements of a name are
    at, n = 0, len(page)
    block: Block | None = None
    before: dict[Element, Block | None] = {}  # the block that goes on after an element of ASIDE

    def push(name: str, state: int) -> Element:
        stack.append(Element(name, state, stack[-1] if stack else None, len(stack)))
        places.setdefault(name, []).append(len(stack) - 1)
        return stack[-1]

    def cut(k: int) -> list[Element]:
        """Closes the elements from place k on."""
        gone = stack[k:]
        del stack[k:]
        for e in gone:
            places[e.name].pop()
        return gone

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def add(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(stack[-1] if stack else None)
            out.append(block)
        block.parts.append(text)
        block.size += len(text)
        if places.get("a"):
            block.linked += len(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] if m[2] else m[6] or ""
        if not closing and (name in PAGE_TAGS or name in RAW or attributes.endswith("/")):
            inner = stack[-1].foreign if stack else -1
            inside = inner >= 0 and stack[inner].name in FOREIGN
            if name in FOREIGN or (inner >= 0 and name not in PAGE_TAGS):
                if attributes.endswith("/"):
                    continue
            elif inside and name in PAGE_TAGS:
                block = before.get(stack[inner], block)
                cut(inner)
        if name in VOID:
            if name in ("br", "hr"):
                block = None
            continue
        if not closing:
            if name in MEDIA:
                own = MEDIA[name].search(page, at)
                if own is None or not own[1] and (name != "object" or attributes.endswith("/")):
                    continue
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                if end is None and name in ("textarea", "title"):
                    end = _TAG.search(page, at)  # without an end tag its text ends at the next one
                    at = end.start() if end else n
                else:
                    at = end.end() if end else n
                if name in ("textarea", "title"):
                    block = None
                continue
            if stack and stack[-1].name == "head" and name not in ("noscript", "template"):
                cut(len(stack) - 1)  # an element of the body ends the head
            if name == "body" and places.get("head"):
                cut(places["head"][0])
            goes_on = block
            if name not in INLINE:
                block = None
                k = max((last(c) for c in CLOSES.get(name, ())), default=-1)
                if name in _CLOSES_P:
                    k = max(k, last("p"))
                if k >= 0 and k >= (stack[-1].scope if stack else -1):
                    gone = cut(k)
                    if gone[0].name == "p":  # what it holds open goes on, at most three of a sort
                        kept: list[Element] = []
                        count: dict[tuple[str, int], int] = {}
                        for e in reversed(gone[1:]):
                            if e.name in INLINE and e.name not in MATH and count.setdefault((e.name, e.state), 0) < 3:
                                count[e.name, e.state] += 1
                                kept.append(e)
                        for e in reversed(kept):
                            push(e.name, e.state)
            parent = stack[-1] if stack else None
            state = _state(name, attributes, parent)
            if not attributes.rstrip().endswith("/") or name not in ("path",):
                if state != (parent.state if parent else NEUTRAL):
                    block = None
                own = push(name, state)
                if name in ASIDE:
                    before[own] = goes_on
            continue
        k = last(name)
        if k >= 0 and (name not in INLINE or name == "math" or k > stack[-1].floor):
            gone = cut(k)
            if any(e.name not in INLINE for e in gone) or (stack[-1].state if stack else NEUTRAL) != gone[-1].state:
                block = before.get(gone[0])
        elif k < 0 and name == "p":
            block = None
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


#: Features of a block: a constant, its length, link density, a closing mark after ten words, a tag of running text.
FEATURES = 5
#: The classifier that the fit starts from and, by RIDGE, stays near: log-odds of content.
START = np.asarray([-0.5, 4.0, -6.0, 1.0, 0.75])
RIDGE = 4.0
#: The fit reads at most so many pages, and so many characters of them.
PAGES, CHARACTERS = 300, 6_000_000


def features(block: Block) -> list[float]:
    size = len(block.text)
    closed = size >= 20 and block.text[-1:] in ".!?…\"”»" and block.text.count(" ") >= 9
    return [1.0, min(1.0, math.log1p(size) / 6), min(1.0, block.linked / max(1, block.size)), float(closed), float(block.texty)]


def fit_costs(pages: Iterable[str | None]) -> np.ndarray:
    """Weights of the classifier, from the blocks that say what they are: those of an article or main, and those that are boilerplate for certain."""
    x: list[list[float]] = []
    y: list[float] = []
    for page in pages:
        for b in blocks_of(page or ""):
            if b.state == BOILER or (b.state == CONTENT and b.box is not None and b.box.in_content):
                x.append(features(b))
                y.append(float(b.state == CONTENT))
    w = START.copy()
    if not 0 < sum(y) < len(y):
        return w
    a, t = np.asarray(x), np.asarray(y)
    weight = np.where(t == 1, 0.5 / t.sum(), 0.5 / (len(t) - t.sum())) * min(len(t), 1000)  # both labels count alike
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (t - p)) - RIDGE * (w - START)
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(FEATURES), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 6)


def costs(block: Block, marked: bool, weights: np.ndarray = START) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content). marked: the page says somewhere what is content."""
    if block.state == BOILER:
        return 0, SURE
    if block.state == CONTENT:
        return (ARTICLE if block.box is not None and block.box.in_content else 1250), 0
    score = 400 * float(np.dot(weights, features(block))) + (-300 if marked else 50)
    if block.state == DOUBT:
        score -= DOUBTED_MARKED if marked else DOUBTED
    score = round(max(-3000.0, min(3000.0, score)))
    return max(0, score), max(0, -score)


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True where a node stays with the source in a minimum cut. edges: (a, b, capacity both ways).

    Shortest augmenting paths level by level; what a terminal edge pair has in common is routed at once.
    """
    n = len(source)
    left, right = [0] * n, [0] * n
    for i in range(n):
        direct = min(source[i], sink[i])
        left[i], right[i] = source[i] - direct, sink[i] - direct
    graph: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, c in edges:
        graph[a].append(len(to))
        to.append(b)
        room.append(c)
        graph[b].append(len(to))
        to.append(a)
        room.append(c)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] > 0)
        for i in queue:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            if right[i] > 0:
                ends = True
            for e in graph[i]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not ends:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while left[start] > 0 and level[start] == 0:
                path: list[int] = []
                i = start
                while True:
                    if right[i] > 0:
                        flow = min([left[start], right[i], *[room[e] for e in path]])
                        left[start] -= flow
                        right[i] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while at[i] < len(graph[i]):
                        e = graph[i][at[i]]
                        if room[e] > 0 and level[to[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    if at[i] < len(graph[i]):
                        path.append(e)
                        i = to[e]
                    elif path:
                        i = to[path.pop() ^ 1]
                        at[i] += 1
                    else:
                        level[start] = n + 1
                        break
                if level[start] != 0:
                    break


def smoothness(a: Block, b: Block) -> int:
    """Capacity between neighbouring blocks: the more, the closer their elements are."""
    if a.box is b.box:
        return SMOOTH_SAME
    up, over = _above(a.box), _above(b.box)
    near = up is b.box or over is a.box or up is over or (up is not None and _above(up) is b.box) or (over is not None and _above(over) is a.box)
    return SMOOTH_NEAR if near else SMOOTH_FAR


def label_blocks(blocks: list[Block], weights: np.ndarray = START) -> list[bool]:
    """True for content. Next blocks are joined, and blocks of the same parent with the next one of that parent; a block that is boilerplate for certain is joined with none."""
    if not blocks:
        return []
    marked = any(b.state == CONTENT for b in blocks)
    pairs = [costs(b, marked, weights) for b in blocks]
    edges: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.state == BOILER:
            continue
        if k and blocks[k - 1].state != BOILER:
            edges.append((k - 1, k, smoothness(blocks[k - 1], b)))
        parent = id(_above(b.box))
        if last.get(parent, k) < k - 1:
            edges.append((last[parent], k, SMOOTH_NEAR))
        last[parent] = k
    return minimum_cut([c for c, _ in pairs], [c for _, c in pairs], edges)


def main_text(page: str | None, weights: np.ndarray = START) -> str:
    """The article's text: content blocks in page order, joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = label_blocks(blocks, weights)
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def classifier(pages: DataFrame, column: str = "html") -> np.ndarray:
    """fit_costs on a bounded sample: the first pages by hash, as far as they are not too long."""
    short = pages.select(F.col(column).alias("h"), F.xxhash64(column).alias("k")).where(F.length("h") <= CHARACTERS // PAGES)
    keys = [r["k"] for r in short.select("k").distinct().orderBy("k").limit(PAGES).collect()]  # hashes alone, so tasks send little
    if not keys:
        return START.copy()
    chosen = short.where(F.col("k") <= keys[-1]).groupBy("k").agg(F.min("h").alias("h"))  # copies of a page count once
    return fit_costs(r["h"] for r in chosen.orderBy("k").collect())


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html column, with text and n_chars; no shuffle of pages."""
    weights = classifier(pages, column)
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", column)]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(p, weights) for p in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*[f"`{n}`" for n in [*names, column]]).mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
