"""Main text of web pages by minimum-cut labelling.

A page's markup is cut into text blocks. A linear classifier scores each block for content against
boilerplate; the score becomes the capacity to the source (content) or to the sink (boilerplate).
Blocks that follow each other, and blocks next to each other under one parent, are tied by smoothness
edges, stronger the more of their DOM path they share and the more alike their elements are. The minimum
cut is the labelling of least total cost; the blocks that remain with the source are the main text. So a
short line or a heading that says little for itself goes with the paragraphs it stands among.

The evidence is graded. What HTML's own elements and roles say weighs most. A class or id speaks by its
words: some mean boilerplate wherever they stand (comments, newsletter), others only as a whole name
(notice, related) and hardly at all as part of a longer one inside an article (section-header,
related-work), or with another such word there (cookie-notice, but not cookies). A name that says what is not or also
there (no-sidebar, has-modal, with-cookies) says nothing, nor does any name of html and body. An element that holds
half of what the page's articles say, or, where there is no article, ``MOSTLY`` of the page's text, is the page's frame:
its name, and a form around it, count nothing (comments excepted where no article is). Length, closing punctuation, share of links and the block's own element add to that.

Before flows are pushed, every block whose own capacity is at least that of all its edges is labelled
at once (no minimum cut can say otherwise, ties go to the block's own side) and its edges turn into
capacities of its neighbours; max-flow decides about the rest, component by component.

Null, empty or tag-less html: its text, if any, as one block, judged like any other. Very long pages
are read whole, in time that grows with their length, however deep they nest. Broken markup never fails:
unclosed elements end with their parent, stray end tags are passed over, a quote that is never closed is
plain, an unclosed script or style ends at the next tag, and other unseen elements that are never closed
hide nothing. Repeated rows are each extracted; other columns pass through where asked. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orrery.llm import common

#: What HTML means by its elements.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style template noscript title textarea svg math canvas iframe object audio video head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside blockquote body div dl footer form header main menu nav ol section select table td th ul".split())

#: Code, whose end is not looked for among its text.
CODE_TAGS = frozenset(("script", "style"))

#: The classifier: what an element on a block's path says of it, the strongest of each sign counting once.
TAG_SCORE = {"article": 3.0, "main": 2.5, "nav": -9.0, "menu": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "dialog": -9.0, "button": -9.0, "select": -9.0, "fieldset": -9.0}
ROLE_SCORE = {"main": 2.5, "article": 3.0, "navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "menu": -9.0, "menubar": -9.0, "dialog": -9.0, "alert": -9.0}
GOOD_NAMES = frozenset("article content post entry story main body text".split())
#: Words of class names and ids that mean boilerplate wherever they stand in one.
BAD_ANYWHERE = re.compile(r"advert\w*|adsense|sponsor\w*|navbar|breadcrumbs?|pagination|pager|gdpr|popup|newsletter|subscribe|subscription|signup|login|comments|commentlist|disqus|trending|recommend(?:ed|ations)?")
#: The same, but an article may be about it: inside one a name of this word alone is weighed, and in a longer name it takes another bad word.
BAD_TOPIC = re.compile(r"promo|promos|promotions?|sidebar|masthead|topbar|cookies?|consent|modal")
#: Words that turn a name round: it is about what the element has, has not, or does.
TURNS = frozenset("no not non has have with without open opened closed none off".split())
#: Names of what readers say.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: And as a name of their own, or as part of one outside an article.
BAD_ALONE = frozenset("ad ads banner nav navigation menu menus side aside footer toolbar header notice notices alert warning overlay share sharing social related widget widgets comment respond reply replies copyright legal disclaimer search form tags skip".split())
#: Of these, those that an article has of its own.
OWN_PARTS = frozenset("header footer side legal form".split())
NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
GOOD_NAME, BAD_NAME, BAD_PART, BAD_TOPIC_INSIDE, BAD_PART_INSIDE = 1.5, -9.0, -5.0, -3.5, -1.0
#: Share of a page's text that makes an element its frame where no article is.
MOSTLY = 0.6
#: And what the block itself says.
BIAS, PER_LOG_WORD, PER_LINK_SHARE, STOPPED = -1.8, 0.45, -3.0, 0.5
OWN_TAG = {"p": 0.8, "h1": 0.8, "h2": 0.4, "h3": 0.4, "pre": 0.8, "blockquote": 0.6, "li": -0.2}
STOPS = tuple(".!?:;\u2026\u3002\uff01\uff1f\"'\u201d\u2019\u00bb)")
#: Smoothness: between blocks that follow each other, and next to each other under one parent, if alike and if not.
ADJACENT, ALIKE, UNLIKE = 0.5, 1.2, 0.5

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Block:
    text: str
    link_chars: int
    depth: int  # sectioning elements above it
    shared: int  # how many of them it has in common with the block before
    parent: int  # number of the innermost
    tag: str
    good: float
    bad: float

    def score(self) -> float:
        words = self.text.count(" ") + 1
        share = min(1.0, self.link_chars / len(self.text))
        stop = STOPPED if self.text.endswith(STOPS) else 0.0
        return BIAS + self.good + self.bad + PER_LOG_WORD * log2(1 + words) + PER_LINK_SHARE * share + stop + OWN_TAG.get(self.tag, 0.0)


@lru_cache(10_000)
def word_score(name: str, inside: bool) -> tuple[float, float, bool]:
    """(for content, against it, about readers' words) from one class name or id; inside: of an article or main."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    good = GOOD_NAME if GOOD_NAMES.intersection(words) else 0.0
    if TURNS.intersection(words):
        return good, 0.0, False
    readers = bool(READERS.intersection(words))
    if any(map(BAD_ANYWHERE.fullmatch, words)):
        return 0.0, BAD_NAME, readers
    topic = [w for w in words if BAD_TOPIC.fullmatch(w)]
    bad = BAD_ALONE.intersection(words)
    if topic:
        if not inside or bad or len(topic) > 1:
            return 0.0, BAD_NAME, readers
        return 0.0, BAD_TOPIC_INSIDE if len(words) == 1 else BAD_PART_INSIDE, False
    if not bad:
        return good, 0.0, False
    if inside and (len(words) > 1 or bad <= OWN_PARTS):
        return 0.0, BAD_PART_INSIDE, False
    return 0.0, BAD_NAME if len(words) == 1 else BAD_PART, readers


@dataclass
class Element:
    parent: int
    good: float
    bad: float  # by what it is
    named: float  # by what it is called
    readers: bool
    article: bool  # an article or main that no name speaks against
    chars: int = 0  # of text below it
    said: int = 0  # of these, inside such an article


def element_of(parent: int, tag: str, attributes: str, inside: bool) -> Element:
    """What an element's tag, role, classes and id say."""
    s = TAG_SCORE.get(tag, 0.0)
    e = Element(parent, max(s, 0.0), min(s, 0.0), 0.0, False, False)
    if tag == "form":
        e.bad, e.named = 0.0, e.bad
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "role":
                s = ROLE_SCORE.get(value.lower(), 0.0)
                e.good, e.bad = max(e.good, s), min(e.bad, s)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                e.bad = min(e.bad, BAD_NAME)
            elif name in ("class", "id") and tag not in ("html", "body"):
                for x in value.split():
                    g, s, readers = word_score(x[:80], inside)
                    e.good, e.named, e.readers = max(e.good, g), min(e.named, s), e.readers or readers
    e.article = tag in ("article", "main") and e.bad > BAD_PART and e.named > BAD_PART
    return e


def judged(blocks: list[Block], at: list[int], elements: list[Element]) -> None:
    """Gives each block what its elements say, the strongest of each sign once; at: each block's element. Parents stand before their children."""
    within = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        within[i] = within[e.parent] or e.article
    for b, i in zip(blocks, at, strict=True):
        elements[i].chars += len(b.text)
        elements[i].said += len(b.text) * within[i]
    for e in elements[:0:-1]:
        elements[e.parent].chars += e.chars
        elements[e.parent].said += e.said
    chars, said = elements[0].chars, elements[0].said
    for e in elements[1:]:
        frame = 2 * e.said >= said if said else e.chars >= MOSTLY * chars and not e.readers
        above = elements[e.parent]
        e.good, e.bad = max(e.good, above.good), min(e.bad, above.bad, 0.0 if frame else e.named)
    for b, i in zip(blocks, at, strict=True):
        b.good, b.bad = elements[i].good, elements[i].bad


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(from, to, name, is an end tag, attributes) of each tag; comments and the like have no name. Skips what ``send`` tells."""
    at, end, quotes = 0, len(html), True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            to = html.find("-->", start + 4)
            at = to + 3 if to >= 0 else end
            skip = yield start, at, "", False, ""
        elif html[start + 1 : start + 2] in ("!", "?"):
            to = html.find(">", start)
            at = to + 1 if to >= 0 else end
            skip = yield start, at, "", False, ""
        elif m := TAG_NAME.match(html, start + 1):
            i = m.end()
            while quotes and (q := STOP.search(html, i)):
                if q[0] == ">":
                    break
                i = html.find(q[0], q.end()) + 1
                if not i:
                    quotes = False
            else:
                quotes = False  # no tag ends after this one's quotes; they are plain from here on
            to = q.start() if quotes else html.find(">", m.end())
            if to < 0:
                return
            at = to + 1
            skip = yield start, at, m[2].lower(), bool(m[1]), html[m.end() : to]
        elif html[start + 1 : start + 2] == "/":
            to = html.find(">", start)
            at = to + 1 if to >= 0 else end
            skip = yield start, at, "", False, ""
        else:
            at, skip = start + 1, None
        if skip is not None:
            at = max(at, skip)
            yield at, at, "", False, ""


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in page order; script, style, head and the like give none."""
    out: list[Block] = []
    # element: tag, number, inside a link
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    elements, at_of = [Element(0, 0.0, 0.0, 0.0, False, False)], []
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
    boxes, scopes = [0], [0]  # places of the open block and sectioning elements
    text: list[str] = []
    links = numbered = at = 0
    shared = 0  # the least number of sectioning elements open since the last block
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links, shared
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                top = stack[boxes[-1]]
                out.append(Block(said, links, len(scopes) - 1, shared, stack[scopes[-1]][1], top[0], 0.0, 0.0))
                at_of.append(top[1])
                shared = len(scopes) - 1
            text.clear()
        links = 0

    def end(place: int) -> None:
        """Ends the open elements from ``place`` on."""
        nonlocal shared
        while len(stack) > place:
            tag = stack.pop()[0]
            where[tag].pop()
            if boxes[-1] == len(stack):
                boxes.pop()
            if scopes[-1] == len(stack):
                scopes.pop()
        shared = min(shared, len(scopes) - 1)

    def close(tags: tuple[str, ...]) -> None:
        """Ends the nearest open element of these, if none that bounds it stands between."""
        place = max((where[t][-1] for t in tags if where[t]), default=0)
        if place and scopes[-1] <= place:
            end(place)

    def said(upto: int) -> None:
        nonlocal links
        if upto > at:
            text.append(html[at:upto])
            if stack[-1][2]:
                links += len(html[at:upto].strip())

    tags = tags_of(html)
    for start, to, tag, is_end, attributes in tags:
        said(start)
        at = to
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if is_end:
            if where[tag]:
                end(where[tag][-1])
            continue
        if tag in UNSEEN_TAGS:
            if tag == "head" or attributes.endswith("/") or tag in unclosed:
                continue
            done = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if done:
                at = done.end()
            else:
                unclosed.add(tag)
                if tag in CODE_TAGS:
                    at = max(at, html.find("<", at))
            tags.send(at)
            continue
        if tag in CLOSES_P:
            close(("p",))
        if tag in SAME_CLOSES:
            close(SAME_CLOSES[tag])
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        numbered += 1
        inside = bool(where["article"] or where["main"])
        above = stack[-1]
        elements.append(element_of(above[1], tag, attributes, inside))
        if tag == "header" and not inside:
            elements[-1].bad = -9.0
        where[tag].append(len(stack))
        if tag in BLOCK_TAGS:
            boxes.append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append((tag, numbered, above[2] or tag == "a"))
    said(len(html))
    flush()
    judged(out, at_of, elements)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity)."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            out.append((j - 1, j, ADJACENT * (1 + b.shared) / (1 + max(blocks[j - 1].depth, b.depth))))
        if b.parent in last:
            a = blocks[last[b.parent]]
            out.append((last[b.parent], j, ALIKE if (a.tag, a.good, a.bad) == (b.tag, b.good, b.bad) else UNLIKE))
        last[b.parent] = j
    return out


def components_of(nodes: list[int], near: list[dict[int, float]]) -> Iterator[list[int]]:
    left = set(nodes)
    while left:
        found, n = [left.pop()], 0
        while n < len(found):
            more = [j for j in near[found[n]] if j in left]
            left.difference_update(more)
            found += more
            n += 1
        yield found


def max_flow_side(nodes: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that remain with the source: blocking flows on level graphs until the sink is cut off."""
    source, sink = -1, -2
    flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if s[i] > 0:
            flow[source][i], flow[i][source] = s[i], 0.0
        else:
            flow[i][sink], flow[sink][i] = -s[i], 0.0
    while True:
        level, wave = {source: 0}, [source]
        while wave and sink not in level:
            nxt = []
            for i in wave:
                for j, c in flow[i].items():
                    if c > 1e-12 and j not in level:
                        level[j] = level[i] + 1
                        nxt.append(j)
            wave = nxt
        if sink not in level:
            return level.keys() - {source}
        ways = {i: iter(list(flow[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    flow[a][b] -= least
                    flow[b][a] += least
                    if not cut and flow[a][b] <= 1e-12:
                        cut = k + 1
                del path[cut:]
                continue
            for j in ways[i]:
                if level.get(j) == level[i] + 1 and flow[i][j] > 1e-12:
                    path.append(j)
                    break
            else:
                path.pop()


def source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut: terminal capacity |score| to the source if positive, else to the sink."""
    n = len(scores)
    s = list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(s[i]) >= sum(near[i].values()):
            side[i] = s[i] > 0
            for j, c in near[i].items():
                s[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for part in components_of([i for i in range(n) if side[i] is None], near):
        kept = max_flow_side(part, s, near)
        for i in part:
            side[i] = i in kept
    return [bool(x) for x in side]


def labelled(blocks: list[Block]) -> list[bool]:
    return source_side([b.score() for b in blocks], edges_of(blocks))


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    kept = labelled(blocks)
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extracted(pages: DataFrame, passing: tuple[str, ...], html: str = "html", name: str = "text") -> DataFrame:
    """The columns ``passing`` and ``name``: the main text of each page."""
    common.text_batches(pages.sparkSession)
    keep = [c for c in passing if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([main_text(x) for x in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], found], [*b.schema.names[1:], name])

    schema = StructType([*pages.select(*keep).schema.fields, StructField(name, StringType())])
    return pages.select(F.col(html).alias("_html_to_read"), *keep).mapInArrow(run, schema)


def op8_min_cut_text(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extracted(pages, ("page_id", "url")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_min_cut_text": op8_min_cut_text}
ORACLE_SQL = {}
