"""Main-text extraction by tag-path ratios.

A page is read once into text nodes, one for each block, each with its root-to-leaf tag path. Text length (outside links) and
punctuation are aggregated per path and divided by the path's nodes; both ratios are smoothed along the page and fused by
multiplication, and the paths that reach a share of the deviation are content. Parts that are by tag or role no part of an
article are never read; names like `ad` or `comments`, and places outside a marked article, only weigh a path's ratios down.

What the threshold selects is the text. Inside the element that holds it, short blocks of text elements (headings, items, cells,
paragraphs) and sentences stay as well, and so do the headings just before it; link lists and other short strings go.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubila.llm.common import map_arrow

ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: What a path's ratios are multiplied by if a name on it, or its place outside the marked article, speaks against it.
AGAINST = 0.05

# Elements of the HTML standard by their content model.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section article main body html td th nav aside footer header form blockquote".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre article main".split())
WHOLE = frozenset("#root html body".split())
# Elements and roles that the standard keeps apart from an article's text.
AWAY_TAGS = frozenset("nav footer aside form menu dialog head button select svg canvas object audio video map fieldset".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN_TAGS = frozenset(("article", "main"))
# Names that speak against a part, and parts of names that say nothing. A name counts if it has one of the first and
# else only ones of either list, so `ad-box` and `cookie-notice` do, `related-work` and `has-sidebar` don't.
AWAY_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer foot masthead topbar cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations comment comments commentlist disqus replies toolbar pagination pager copyright disclaimer skip search".split()
)
PLAIN_NAMES = frozenset("area bar block body bottom box button buttons container content entry form group header holder icons id inner item items left link links list main message module outer page panel posts post right row section site slot text thread title top unit user widget widgets wrap wrapper".split())


@dataclass(slots=True)
class Element:
    """parent and holder (the nearest element that isn't inline, itself included) are places in the page's elements."""

    tag: str
    parent: int
    holder: int
    path: int
    away: bool
    linked: bool


@dataclass(slots=True)
class TextNode:
    """A block: its holder's place, its path, its texts, characters outside links and in them, and punctuation outside them."""

    element: int
    path: int
    parts: list[str]
    size: int = 0
    linked: int = 0
    marks: int = 0


@dataclass(slots=True)
class Page:
    """against[path]: whether a name on the path speaks against it; inside[path]: whether it lies in a marked article."""

    elements: list[Element] = field(default_factory=list)
    nodes: list[TextNode] = field(default_factory=list)
    against: list[bool] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def speaks_against(names: str) -> bool:
    """Whether one of a class or id attribute's names marks a part that isn't the article's."""
    for name in names.split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if parts & AWAY_NAMES and parts <= AWAY_NAMES | PLAIN_NAMES:
            return True
    return False


class _Tags:
    """The tags of a page one by one, in time linear in its length whatever is left unclosed."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True

    def end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose attributes begin at a place, or -1.

        A quote hides a `>` only right after `=`. Where quotes never close, they count as ordinary characters from there on.
        """
        source, place = self.source, at
        while self.quotes and (m := TAG_STOP.search(source, place)):
            if m[0] == ">":
                return m.start()
            place = m.end()
            back = m.start() - 1
            while back >= at and source[back].isspace():
                back -= 1
            if back >= at and source[back] == "=":
                place = source.find(m[0], place) + 1
                if not place:
                    break
        self.quotes = False
        return source.find(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str, str]]:
        """(start, end, name with `/` for an end tag, attributes) of each tag; comments and declarations have no name."""
        source, at, no_end = self.source, 0, False
        while (start := source.find("<", at)) >= 0:
            following = source[start + 1 : start + 2]
            if following in ("!", "?"):
                if source.startswith("<!--", start):
                    stop, size = source.find("-->", start + 4), 3
                elif source.startswith("<![CDATA[", start):
                    stop, size = source.find("]]>", start + 9), 3
                else:
                    stop, size = -1 if no_end else source.find(">", start), 1
                    if stop < 0:
                        no_end, at = True, start + 1
                        continue
                at = stop + size if stop >= 0 else len(source)
                yield start, at, "", ""
                continue
            m = None if no_end else TAG_NAME.match(source, start + 1)
            stop = self.end(m.end()) if m else -1
            if stop < 0:
                no_end = no_end or m is not None
                at = start + 1
                continue
            at = stop + 1
            name = ("/" if following == "/" else "") + m[1].lower()
            yield start, at, name, source[m.end() : stop]
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                yield at, (at := close.end() if close else len(source)), "", ""


def parse(source: str) -> Page:
    """Elements and text nodes of a page, forgiving like a browser: open paragraphs and items end where the next begins.

    Paths are numbered, so memory grows with the page, not with its depth.
    """
    page = Page([Element("#root", -1, 0, 0, False, False)], [], [False], [False])
    elements, numbers = page.elements, {}
    stack = [0]
    places: dict[str, list[int]] = {}
    scopes, lists, block, last, at = [0], [0], 0, -1, 0

    def text(upto: int) -> None:
        nonlocal last
        own = elements[stack[-1]]
        if upto <= at or own.away:
            return
        raw = source[at:upto]
        if not raw.strip():
            if last == block and page.nodes:
                page.nodes[-1].parts.append(" ")
            return
        value = entities.unescape(raw)
        if last != block:
            page.nodes.append(TextNode(own.holder, own.path, []))
            last = block
        node, size = page.nodes[-1], len(" ".join(value.split()))
        node.parts.append(value)
        if own.linked:
            node.linked += size
        else:
            node.size += size
            node.marks += len(PUNCTUATION.findall(value))

    def pop_to(size: int) -> None:
        while len(stack) > size:
            tag = elements[stack.pop()].tag
            places[tag].pop()
            if tag in SCOPES:
                scopes.pop()
            if tag in LISTS:
                lists.pop()

    def close(tags: tuple[str, ...], barrier: int) -> None:
        open_at = max((places[t][-1] for t in tags if places.get(t)), default=-1)
        if open_at > barrier:
            pop_to(open_at)

    for start, end, name, raw in _Tags(source):
        text(start)
        at = end
        if not name:
            continue
        if name[0] == "/":
            if places.get(name[1:]):
                pop_to(places[name[1:]][-1])
            block += name[1:] not in INLINE
            continue
        if name not in INLINE:
            block += 1
        elif name == "br" and last == block:
            page.nodes[-1].parts.append(" ")
        if name in VOID or name in RAW:
            continue
        if name in CLOSES_P:
            close(("p",), scopes[-1])
        if name in SAME_KIND:
            close(SAME_KIND[name], lists[-1])
        above, attributes = elements[stack[-1]], _attributes(raw)
        role = attributes.get("role", "").lower()
        named = speaks_against(attributes.get("class", "")) or speaks_against(attributes.get("id", ""))
        away = above.away or name in AWAY_TAGS or role in AWAY_ROLES or (name == "header" and not page.inside[above.path])
        away = away or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", attributes.get("style", "").lower())
        path = above.path
        if name not in INLINE or named:
            named = named and name not in ("html", "body", "article", "main")
            key = (path, name, named)
            if key not in numbers:
                numbers[key] = len(page.against)
                page.against.append(page.against[path] or named)
                page.inside.append(page.inside[path] or name in MAIN_TAGS or role == "main")
            path = numbers[key]
        place = len(elements)
        elements.append(Element(name, stack[-1], above.holder if name in INLINE else place, path, away, above.linked or name == "a"))
        if not raw.rstrip().endswith("/") or name not in ("svg", "path"):
            places.setdefault(name, []).append(len(stack))
            if name in SCOPES:
                scopes.append(len(stack))
            if name in LISTS:
                lists.append(len(stack))
            stack.append(place)
    text(len(source))
    return page


def _smooth(values: list[float]) -> list[float]:
    """Each value with its neighbours at weights 1, 2, 1."""
    n = len(values)
    return [(values[max(0, i - 1)] + 2 * values[i] + values[min(n - 1, i + 1)]) / 4 for i in range(n)]


def path_weights(page: Page, nodes: list[TextNode]) -> dict[int, float]:
    """For each path 1, or AGAINST for a name against it and again for lying outside the marked article.

    Places count only if the marked article holds at least half of the text that no name speaks against.
    """
    held, rest = 0, 0
    for n in nodes:
        if page.inside[n.path]:
            held += n.size
        elif not page.against[n.path]:
            rest += n.size
    marked = held > 0 and held >= rest
    return {n.path: (AGAINST if page.against[n.path] else 1.0) * (AGAINST if marked and not page.inside[n.path] else 1.0) for n in nodes}


def content_nodes(page: Page, nodes: list[TextNode], share: float = 0.5) -> list[TextNode]:
    """The nodes of the paths whose fused ratio, and its mean after smoothing, reach `share` of the smoothed ratios' deviation.

    Smoothing alone would lift a short string that stands between long texts.
    """
    if not nodes:
        return []
    total: dict[int, list[float]] = {}
    for n in nodes:
        own = total.setdefault(n.path, [0, 0, 0])
        own[0] += n.size
        own[1] += n.marks
        own[2] += 1
    weight = path_weights(page, nodes)
    ratio = {p: (weight[p] * size / k, weight[p] * (marks + 1) / k) for p, (size, marks, k) in total.items()}
    lengths, marks = (_smooth([ratio[n.path][i] for n in nodes]) for i in (0, 1))
    fused = [a * math.sqrt(b) for a, b in zip(lengths, marks, strict=True)]
    mean = sum(fused) / len(fused)
    cut = share * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    means = dict.fromkeys(total, 0.0)
    for n, f in zip(nodes, fused, strict=True):
        means[n.path] += weight[n.path] * f / total[n.path][2]
    own = {p: weight[p] * a * math.sqrt(b) for p, (a, b) in ratio.items()}
    return [n for n in nodes if min(means[n.path], own[n.path]) >= cut * (1 - 1e-9)]


def _above(page: Page, element: int) -> list[int]:
    """The element and those around it, outwards."""
    out = []
    while element >= 0:
        out.append(element)
        element = page.elements[element].parent
    return out


def article_root(page: Page, content: list[TextNode]) -> int:
    """The marked article around all content, else the deepest element that holds all of it and isn't itself a text element."""
    common = _above(page, content[0].element)
    depth = {k: i for i, k in enumerate(common)}
    low = 0
    for element in {n.element for n in content}:
        while element not in depth:
            element = page.elements[element].parent
        low = max(low, depth[element])
    marked = [k for k in common[low:] if page.elements[k].tag in MAIN_TAGS]
    if marked:
        return marked[0]
    return next(k for k in common[low:] if page.elements[k].tag not in TEXT_TAGS)


def kept_nodes(page: Page, nodes: list[TextNode], share: float = 0.5) -> list[TextNode]:
    """The content nodes, and what belongs to them: short text blocks of the element around them, and headings before them."""
    content = content_nodes(page, nodes, share)
    if not content:
        return []
    chosen, root = set(map(id, content)), article_root(page, content)
    within = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        within[k] = k == root or (e.parent >= 0 and within[e.parent])
    whole = page.elements[root].tag in WHOLE
    places = [i for i, n in enumerate(nodes) if id(n) in chosen]
    weight = path_weights(page, nodes)
    lists: dict[int, list[int]] = {}
    for n in nodes:
        own = lists.setdefault(page.elements[n.element].parent, [0, 0])
        own[0] += n.linked
        own[1] += n.linked + n.size
    out = []
    for i, n in enumerate(nodes):
        if id(n) not in chosen:
            tag, around = page.elements[n.element].tag, lists[page.elements[n.element].parent]
            links = tag not in HEADINGS and (2 * n.linked > n.linked + n.size or (tag not in ("p", "pre", "blockquote") and 2 * around[0] > around[1]))
            textual = tag in TEXT_TAGS or (whole and tag in WHOLE) or n.marks > 0
            between = places[0] < i < places[-1] if whole else within[n.element]
            if weight[n.path] < max(weight.values()) or links or not textual or not between:
                continue
        out.append((i, n))
    if page.elements[root].tag not in MAIN_TAGS:
        headings, next_to = [], True
        for i in range(out[0][0] - 1, -1, -1):
            n = nodes[i]
            if page.elements[n.element].tag not in HEADINGS or weight[n.path] < max(weight.values()):
                next_to = False
            elif next_to or (not headings and page.elements[n.element].tag == "h1"):
                headings.append((i, n))
        out = headings[::-1] + out
    return [n for _, n in out]


def extract_blocks(source: str | None, share: float = 0.5) -> list[str]:
    """The article's blocks in page order."""
    page = parse(source or "")
    texts = (" ".join("".join(n.parts).split()) for n in kept_nodes(page, page.nodes, share))
    return [t for t in texts if t]


def extract_main_text(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Per row of pages: page_id, url, text (blocks joined by two line feeds), n_chars, blocks (array).

    Null and empty html, and pages without any text of their own, give an empty text. Nothing is cut; repeated rows give
    repeated results; other columns are left out.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                blocks = [extract_blocks(s, share) for s in part.column(2).to_pylist()]
                texts = ["\n\n".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "text", "n_chars", "blocks"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return map_arrow(pages.select(*columns), extract, "page_id long, url string, text string, n_chars long, blocks array<string>")
