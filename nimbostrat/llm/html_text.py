"""Main text of web pages by minimum-cut labelling.

A page's text blocks and the elements around them form a graph.  A linear
classifier over tags, names, link density and length gives each block a cost
for either label, its capacity from the source or to the sink.  Neighbouring
blocks are joined by an edge, and each block to the element that holds it, each
element to its parent; cutting such an edge costs its capacity.  The blocks on
the source side of a minimum cut are the article.

A class or id speaks for a side bar, an advert or the like only by whole names:
``page-with-sidebar`` and ``no-ads`` say what is absent or beside, and inside an
article ``related-work`` is a topic, as its other word isn't one of such parts. Names,
and tags and roles of forms and boxes, say nothing where the element holds the page's
article or heading, or most of its prose while none stands elsewhere: such an element
wraps the content.  On a page without an article or a named content, blocks that
follow the first heading count as likely content.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbostrat.llm.common import bound_batches, fresh, strings

# HTML element kinds and the names that tell a block's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object head title select option textarea button canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table tbody thead tfoot dl article section div main aside nav footer header form body".split())
APART = frozenset("nav footer aside menu address".split())
# Tags and roles of forms and boxes, which may wrap a whole page.
BOXES = frozenset("form fieldset dialog details".split())
BOX_ROLES = frozenset("form search dialog alertdialog".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
APART_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discuss "
    "disqus feedback foot footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination "
    "popup privacy promo promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags "
    "toolbar topbar warning widget".split()
)
MAIN_NAMES = frozenset("article articlebody body content entry main page post story text".split())
# Words that go along with the names of such parts.
COMPANIONS = frozenset(
    "area article articles author bar block blocks body bottom box button buttons container content data desktop entries entry feed follow form global group head heading icon icons inner item items left link links "
    "list lists main media mobile module more news outer page panel post posts primary right row secondary section site slot stories story text title top unit wrap wrapper".split()
)
PROSE = frozenset("p h1 h2 h3 blockquote pre".split())
# Words that make a name speak of its surroundings or its state, not of its role.
QUALIFIERS = frozenset("no not non without with has have is hide hidden show open opened closed enabled disabled allow allowed layout grid col cols row".split())
#: Share of the page's prose beyond which a name alone doesn't set an element apart.
MOST = 0.6

# The classifier's weights, and the capacities of the edges.
W_APART, W_ARTICLE, W_NAME, W_MAIN, W_LINKS, W_LENGTH, W_TAG, W_BELOW, BIAS = -9.0, 4.0, -8.0, 2.0, -4.0, 0.6, 0.7, 1.8, -1.6
NEXT, HOLDS, NESTED = 1.0, 0.5, 0.3

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = frozenset("class id role style hidden aria-hidden".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+")


def attributes_of(written: str) -> dict[str, str]:
    """The attributes of a tag that tell something, by name; of equal names the first, as browsers take it."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(written):
        if (name := name.lower()) in _TELLING:
            found.setdefault(name, references.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return found


def named(value: str, prose: bool, strict: bool = False) -> float:
    """What class or id names say: the strongest of the names that tell a role.

    prose: the element is a paragraph or heading, where a name like
    ``social-history`` tells a topic; there all words of a name must agree. strict: the
    element stands where topics have names too; words that don't go along with parts of a page make a topic.
    """
    apart = main = False
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & QUALIFIERS:
            continue
        telling = words & APART_NAMES
        apart |= bool(telling) and (words <= APART_NAMES if prose else words <= APART_NAMES | COMPANIONS or not strict)
        main |= bool(words & MAIN_NAMES) and not telling
    return W_NAME if apart else W_MAIN if main else 0.0


class Element:
    __slots__ = ("tag", "parent", "own", "name", "box", "article", "seen", "link", "number", "prose", "heads")

    def __init__(self, tag: str, parent: Element | None, attributes: str, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.link = tag == "a" or bool(parent and parent.link)
        self.seen = not (parent and not parent.seen) and tag not in UNSEEN
        self.own = self.name = self.box = 0.0  # evidence of tag, role and style; of names; of forms and boxes
        self.prose = 0  # unlinked characters below
        if tag in APART and not (tag == "address" and self.article) or tag == "header" and not self.article:
            self.own += W_APART
        elif tag in BOXES:
            self.box += W_APART
        elif tag in ("article", "main"):
            self.own += W_ARTICLE
        told = attributes_of(attributes) if attributes else {}
        if tag not in ("html", "body"):
            for name in ("class", "id"):
                said = named(told.get(name, ""), tag in PROSE, self.article or tag == "section")
                self.name = min(self.name, said) if self.name < 0 or said < 0 else max(self.name, said)
        roles = set(told.get("role", "").lower().split())
        if roles & APART_ROLES:
            if roles & BOX_ROLES:
                self.box += W_APART
            else:
                self.own += W_APART
        elif roles & {"main", "article"}:
            self.own += W_ARTICLE
        if "hidden" in told and told["hidden"].lower() != "until-found" or told.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", told.get("style", ""), re.I):
            self.own += W_APART
        # holds an article, a heading or what is named as content
        self.heads = tag in ("article", "main", "h1") or self.name > 0 or self.own > 0


class Block:
    __slots__ = ("text", "holder", "linked", "score", "depth_change")

    def __init__(self, text: str, holder: Element, linked: int, depth_change: int):
        self.text, self.holder, self.linked, self.depth_change, self.score = text, holder, min(linked, len(text)), depth_change, 0.0


def score(blocks: list[Block], heads: bool, marked: bool) -> None:
    """Sets each block's score: the evidence around it, its links, its length, its tag and its place.

    heads: whether the page has an article, a first-level heading or an element named as content;
    marked: whether it has one of these besides headings.
    """
    whole = 0
    for block in blocks:
        prose = len(block.text) - block.linked
        whole += prose
        element = block.holder
        while element is not None:
            element.prose += prose
            element = element.parent
    bias: dict[int, float] = {}

    def around(element: Element) -> float:
        chain = []
        while element is not None and element.number not in bias:
            chain.append(element)
            element = element.parent
        total = bias[element.number] if element is not None else 0.0
        for e in reversed(chain):
            wraps = e.heads or not heads and e.prose > MOST * whole
            total += e.own + (e.name if e.name > 0 or not wraps else 0.0) + (0.0 if wraps else e.box)
            bias[e.number] = total
        return total

    below = False
    for block in blocks:
        below |= block.holder.tag == "h1" and not marked
        block.score = W_BELOW * below + BIAS + around(block.holder) + W_LINKS * block.linked / max(len(block.text), 1) + W_LENGTH * math.log2(1 + len(block.text) / 8)
        if block.holder.tag in PROSE:
            block.score += W_TAG


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed and stray tags are tolerated."""
    root = here = Element("#root", None, "", 0)
    stack, found, parts, linked, holder, moves, number = [root], [], [], 0, root, 0, 0
    open_: Counter[str] = Counter()  # open elements by tag, so that a stray end tag costs no search
    heads = marked = False

    def close(upto: int) -> None:
        for e in stack[upto:]:
            open_[e.tag] -= 1
        del stack[upto:]

    def flush() -> None:
        nonlocal parts, linked, moves
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, holder, linked, moves))
                moves = 0
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, holder
        if raw and here.seen:
            if not parts or not any(p.strip() for p in parts):
                holder = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if here.link:
                linked += len(text)

    at = 0
    while match := _TOKEN.search(page, at):
        add(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
            moves += 1
        if match[1]:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
                here = stack[-1]
            continue
        if tag in BLOCK and open_["p"]:
            # a block element ends an open paragraph, unless a container lies between
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[k].tag in CLOSES[tag]:
                close(k)
                if tag != "tr":
                    break
            elif stack[k].tag in SCOPES:
                break
        here = stack[-1]
        if tag == "br":
            add(" ")
        if tag in VOID or match[3].endswith("/"):
            continue
        number += 1
        here = Element(tag, here, match[3], number)
        stack.append(here)
        open_[tag] += 1
        if here.heads:
            marked |= tag != "h1"
            heads, above = True, here.parent
            while above is not None and not above.heads:
                above.heads, above = True, above.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    add(page[at:])
    flush()
    score(found, heads, marked)
    return found


def minimum_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Source side of a minimum cut.

    gain: per node, the capacity from the source less that to the sink. A node
    whose gain outweighs all its edges is on its own side in some minimum cut;
    such nodes are settled first and passed on to their neighbours. What is
    left goes through augmenting paths, component by component.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    gain, side, weight = list(gain), [None] * n, [sum(d.values()) for d in near]
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is not None or abs(gain[k]) < weight[k] - 1e-12:
            continue
        side[k] = gain[k] > 0
        for j, c in near[k].items():
            if side[j] is None:
                gain[j] += c if side[k] else -c
                weight[j] -= c
                queue.append(j)
    seen = [s is not None for s in side]
    for start in range(n):
        if seen[start]:
            continue
        seen[start], part = True, [start]
        for k in part:
            for j in near[k]:
                if not seen[j]:
                    seen[j] = True
                    part.append(j)
        _augment(part, gain, {k: {j: c for j, c in near[k].items() if side[j] is None} for k in part}, side)
    return [bool(s) for s in side]


def _augment(part: list[int], gain: list[float], left: dict[int, dict[int, float]], side: list) -> None:
    """Shortest augmenting paths between nodes of positive and of negative gain."""
    supply = {k: gain[k] for k in part}
    while True:
        back = {k: None for k in part if supply[k] > 1e-9}
        queue, end = deque(back), None
        while queue and end is None:
            k = queue.popleft()
            for j, c in left[k].items():
                if c > 1e-9 and j not in back:
                    back[j] = k
                    if supply[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            for k in part:
                side[k] = k in back
            return
        flow, k = -supply[end], end
        while back[k] is not None:
            flow, k = min(flow, left[back[k]][k]), back[k]
        flow = min(flow, supply[k])
        supply[k] -= flow
        supply[end] += flow
        k = end
        while (p := back[k]) is not None:
            left[p][k] -= flow
            left[k][p] = left[k].get(p, 0.0) + flow
            k = p


def main_text(page: str) -> str:
    """The article's blocks, one to a line; empty if the page has none."""
    blocks = blocks_of(page)
    gain, edges, index = [b.score for b in blocks], {}, {}
    for k, block in enumerate(blocks):
        if k:
            edges[k - 1, k] = NEXT / max(block.depth_change, 1)
        below, element, capacity = k, block.holder, HOLDS
        while element is not None:
            known = element.number in index
            if not known:
                index[element.number] = len(gain)
                gain.append(0.0)
            above = index[element.number]
            edges[below, above] = capacity
            if known:
                break
            below, element, capacity = above, element.parent, NESTED
    chosen = minimum_cut(gain, edges)
    return "\n".join(b.text for k, b in enumerate(blocks) if chosen[k])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``.

    pages: any table with a string column named by ``html``; columns named like
    the results are replaced, others pass through. A null or empty page gives an
    empty text of 0 characters. Repeated rows are extracted one by one; nothing
    is cut short.
    """
    bound_batches(pages.sparkSession)
    body = fresh("html")
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    given = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias(body))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != body]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in strings(batch.column(body)).to_pylist()]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return given.mapInArrow(run, ", ".join([*fields, "text string", "n_chars bigint"]))
