"""Main text of web pages by tag-path ratios.

1. read      A page becomes blocks: runs of text between block-level tags, each below an element,
             with the path of block elements from the root to it (tags, and the class and id of
             elements that lay out a page).
2. ratios    All blocks of one path are one group. The page gives each path two ratios, text
             length and punctuation marks per block, both without the text of links, and the
             share of its text that is linked.
3. smooth    Along the page both ratios are averaged with those of the neighbouring blocks.
4. fuse      A path's ratios, its own and the smoothed ones, become one score, less by the share of
             links. The outline weighs in: paths through article or main count more, paths
             through elements that call themselves boilerplate (by tag, role, class, id or a copyright
             sign) less. A name is passed over where its element holds a main, all articles
             or more than half of the page's text.
5. threshold Paths of at least half of the mean score, by text, are content; their blocks choose the
             element that is the article: the marked article or main that they are in, or else the
             smallest element that holds four fifths of their text, with what stands around it
             in a parent that holds no menu and no boilerplate.
6. collect   The article's blocks, in page order, but for those that are not content and lie in
             an element that calls itself boilerplate, in a list or part that is mostly links, or, where the
             article is the whole page, in a part of the page before the first or after the last
             content. A first-level heading right before the article belongs to it.

Edge cases: null and empty pages, and pages without content (nothing but links, say), give the empty text;
unclosed and stray tags are mended as browsers do for blocks; text outside any tag is a block of
its own; pages are read whole, in time and memory proportional to their length; paths of equal
scores are all content or all not, and of elements that hold equal text the first is taken; repeated
rows are extracted each by itself; an empty table gives an empty one; other columns are kept, except
those named like an output column, which are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fathomark.llm.packing import sized_batches

# Elements of HTML by how they lay out text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title canvas audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
#: An opening tag ends an open element of the same group, up to the nearest of the bounds.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements that lay out a page, and lists.
PARTS = frozenset("html body main article section div header footer nav aside form fieldset table tbody tr td th center details dialog menu".split())
LISTS = frozenset("ul ol dl menu dir table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN_TAGS = frozenset("nav aside footer header form button menu dialog".split())
PLAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
PLAIN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, the names of what readers write, which may well be most of a page.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that leave a name's meaning as it is ("left-sidebar"); any other makes it vague ("search-for-meaning").
NEUTRAL_NAMES = frozenset("article area bar block body bottom box center col column container content entry global group holder inner item items layout left list main module outer page pane panel post posts primary right row secondary section site top wrap wrapper zone".split())

#: What the outline multiplies a score by, for each element of the path.
MARKED, PLAIN, VAGUE = 4.0, 0.1, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_DIGIT = re.compile(r"\d")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPACES = re.compile(r"[\s]+")
_COPYRIGHT = re.compile(r"©|\(c\) ?\d|copyright\b|all rights reserved", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int  # the number of its path
    hidden: bool = False
    plain: bool = False  # calls itself boilerplate
    named: bool = False  # does so by a name or role, which may be passed over
    comments: bool = False
    vague: bool = False
    marked: bool = False  # article or main


@dataclass(slots=True)
class Block:
    element: int
    text: str
    linked: int

    @property
    def own(self) -> int:
        return len(self.text) - self.linked


@dataclass(slots=True)
class Page:
    """Elements in the order in which they open (the first is the page itself), and blocks in page order."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0)])
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def opened(self, tag: str, attributes: str, parent: int) -> int:
        e = Element(tag, parent, 0, plain=tag in PLAIN_TAGS and tag != "form", named=tag == "form", marked=tag in ("article", "main"))
        label = tag
        for m in _ATTRIBUTE.finditer(attributes) if attributes and tag not in ("html", "body") else ():
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if tag in PARTS:
                    label += "." + "-".join(w for w in _WORD.findall(value) if not _DIGIT.search(w))
                for words in map(_WORD.findall, value.split() if tag != "main" else ()):
                    hits = PLAIN_NAMES.intersection(words)
                    if hits and all(w in hits or w in NEUTRAL_NAMES or _DIGIT.search(w) or len(w) == 1 for w in words):
                        e.named, e.comments = True, e.comments or not COMMENT_NAMES.isdisjoint(hits)
                    elif hits:
                        e.vague = True
            elif name == "role":
                e.named |= value in PLAIN_ROLES
                e.marked |= value == "main"
            else:
                e.hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
        e.path = self.paths.setdefault((self.elements[parent].path, label), len(self.paths) + 1)
        e.hidden |= self.elements[parent].hidden
        self.elements.append(e)
        return len(self.elements) - 1

    def below(self, flags: Iterable[bool]) -> list[bool]:
        """Whether each element, or one that it is in, has the flag."""
        out = list(flags)
        for x, e in enumerate(self.elements[1:], 1):
            out[x] |= out[e.parent]
        return out

    def inside(self, flags: Iterable[bool]) -> list[bool]:
        """Whether each element is in another one that has the flag."""
        out = self.below(flags)
        return [False, *(out[e.parent] for e in self.elements[1:])]

    def sums(self, values: list[int]) -> list[int]:
        """For each element the sum over the blocks in it, of a value for each block."""
        total = [0] * len(self.elements)
        for b, v in zip(self.blocks, values, strict=True):
            total[b.element] += v
        for x in range(len(total) - 1, 0, -1):
            total[self.elements[x].parent] += total[x]
        return total


def read_page(text: str) -> Page:
    page, parts = Page(), []
    stack, loose, links, in_link = [0], 0, False, False

    def flush() -> None:
        nonlocal loose, links
        if parts:
            own = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if own and not page.elements[stack[-1]].hidden:
                page.blocks.append(Block(stack[-1], own, max(0, len(own) - loose) if links else 0))
            parts.clear()
        loose, links = 0, in_link

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    tag_at = lambda k: page.elements[stack[k]].tag
    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        piece = text[at : m.start() if m else size]
        if piece:
            parts.append(piece)
            # blanks between links are theirs
            loose += 0 if in_link else len(piece.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(text, at).end()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
                links |= in_link
            elif tag == "br":
                parts.append(" ")
            continue
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if tag_at(k) == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if tag_at(k) == "p":
                    close(k)
                    break
                if tag_at(k) in CLOSES_P:
                    break
        if tag in ENDS:
            same, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if tag_at(k) in bounds:
                    break
                if tag_at(k) in same:
                    close(k)
                    break
        stack.append(page.opened(tag, attributes, stack[-1]))
    flush()
    return page


def judge_names(page: Page) -> None:
    """Names and roles make elements boilerplate, but for those that hold what the page is about."""
    elements = page.elements
    if any(e.tag == "header" and e.plain for e in elements):
        # the header of an article itself, with its title
        heads = page.sums([int(elements[b.element].tag in HEADINGS) for b in page.blocks])
        for e, n, marked in zip(elements, heads, page.inside(e.marked for e in elements), strict=True):
            e.plain &= not (e.tag == "header" and n and marked)
    if not any(e.named for e in elements):
        return
    plain, named = page.below(e.plain for e in elements), page.below(e.named for e in elements)
    own = [0 if plain[b.element] else b.own for b in page.blocks]
    text = page.sums(own)
    left = sum(n for b, n in zip(page.blocks, own, strict=True) if not named[b.element])
    # outermost articles with text of their own, by the elements that hold them
    nested = page.inside(e.tag == "article" for e in elements)
    tops = [x for x, e in enumerate(elements) if e.tag == "article" and text[x] and not plain[x] and not nested[x]]
    holds, sizes, main = [0] * len(elements), [0] * len(elements), [False] * len(elements)
    for x in tops:
        y, clear = elements[x].parent, not elements[x].named
        while y >= 0:
            holds[y] += 1
            sizes[y] += text[x] if clear else 0
            clear &= not elements[y].named
            y = elements[y].parent
    for x in range(len(elements) - 1, 0, -1):
        e = elements[x]
        main[e.parent] |= main[x] or (e.marked and e.tag != "article" and text[x] > 0)
    over = [False] * len(elements)
    for x, e in enumerate(elements):
        if e.named:
            whole = holds[x] > 0 and holds[x] == len(tops)
            over[x] = main[x] or whole and (left == 0 if e.comments else sizes[x] >= left) or not e.comments and 2 * text[x] > text[0]
    for x in range(len(elements) - 1, 0, -1):
        # a wrapper around one passed over holds the same main, articles or text
        if over[x] and not elements[elements[x].parent].comments:
            over[elements[x].parent] = True
    for x, e in enumerate(elements):
        e.plain |= e.named and not over[x]


def smoothed(values: list[float], radius: int = 1) -> list[float]:
    weight = [math.exp(-(k * k) / 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[j - i + radius], values[j]) for j in range(max(0, i - radius), min(len(values), i + radius + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_blocks(page: Page, factor: float = 0.5) -> list[bool]:
    """Whether the path of each block is content: its fused score is at least factor times the mean over the text."""
    elements, blocks = page.elements, page.blocks
    path = [elements[b.element].path for b in blocks]
    marks = [len(_MARKS.findall(b.text)) * b.own / len(b.text) for b in blocks]

    def by_path(values: list[float]) -> list[float]:
        """The mean over all blocks of its path, for each block."""
        total: dict[int, list[float]] = {}
        for p, v in zip(path, values, strict=True):
            t = total.setdefault(p, [0.0, 0.0])
            t[0] += v
            t[1] += 1
        return [total[p][0] / total[p][1] for p in path]

    outline, nested = [1.0] * len(elements), page.inside(e.marked for e in elements)
    for x, e in enumerate(elements[1:], 1):
        outline[x] = outline[e.parent] * (MARKED if e.marked and not nested[x] else 1.0) * (PLAIN if e.plain else VAGUE if e.vague else 1.0)
    length, points = by_path([float(b.own) for b in blocks]), by_path(marks)
    free = by_path([b.own / len(b.text) for b in blocks])
    fused = lambda n, m: math.sqrt(n * (1 + m))
    near = map(fused, smoothed(length), smoothed(points))
    score = by_path([f * math.sqrt(fused(n, m) * s) * outline[b.element] * (PLAIN if _COPYRIGHT.match(b.text) else 1.0) for b, n, m, f, s in zip(blocks, length, points, free, near, strict=True)])
    # text in boilerplate counts for less in the mean, too
    weight = [b.own * min(1.0, outline[b.element]) ** 2 for b in blocks]
    mean = sum(s * w for s, w in zip(score, weight, strict=True)) / sum(weight) if any(weight) else 0.0
    return [s > 0 and s >= factor * mean for s in score]


def choose_element(page: Page, content: list[bool]) -> tuple[list[int], bool]:
    """The elements that are the article (more than one only if several are marked), and whether what lies around content may be no article's."""
    elements, blocks = page.elements, page.blocks
    mass = page.sums([b.own if c else 0 for b, c in zip(blocks, content, strict=True)])
    nested = page.inside(e.marked for e in elements)
    marked = [x for x, e in enumerate(elements) if e.marked and mass[x] and not nested[x]]
    if marked:
        best = max(marked, key=lambda x: (mass[x], -x))
        if 5 * mass[best] < 4 * sum(mass[x] for x in marked):
            return marked, False
        within = page.inside(x == best for x in range(len(elements)))
        inner = [x for x, e in enumerate(elements) if e.tag == "article" and within[x] and 5 * mass[x] >= 4 * mass[best]]
        return [inner[-1] if inner else best], False
    children: list[list[int]] = [[] for _ in elements]
    for x, e in enumerate(elements[1:], 1):
        children[e.parent].append(x)
    at = 0
    while True:
        best = max((x for x in children[at] if elements[x].tag in PARTS), key=lambda x: (mass[x], -x), default=None)
        if best is None or 5 * mass[best] < 4 * mass[at]:
            break
        at = best
    text, own = page.sums([len(b.text) for b in blocks]), page.sums([b.own for b in blocks])
    foreign = page.sums([int(_COPYRIGHT.match(b.text) is not None) for b in blocks])

    def clean(x: int) -> bool:
        """No part of it is boilerplate, a copyright line, or mostly links."""
        return not any(text[y] and not mass[y] and (elements[y].plain or foreign[y] or 2 * own[y] <= text[y]) for y in children[x])

    while at > 0 and elements[up := elements[at].parent].tag not in ("", "html", "body") and clean(up) and 2 * own[at] > own[up] and not elements[up].plain:
        at = up
    return [at], elements[at].tag in ("", "html", "body") or not clean(at)


def collect(page: Page, content: list[bool]) -> list[int]:
    """The places of the article's blocks."""
    elements, blocks = page.elements, page.blocks
    if not any(content):
        return []
    chosen, strict = choose_element(page, content)
    marked = elements[chosen[0]].marked
    held = page.sums([int(c) for c in content])
    text, own = page.sums([len(b.text) for b in blocks]), page.sums([b.own for b in blocks])
    heads = page.sums([int(elements[b.element].tag == "h1") for b in blocks])
    tops = frozenset(chosen)
    inside, boilerplate = page.below(x in tops for x in range(len(elements))), page.below(e.plain for e in elements)
    plain, bare = [False] * len(elements), [-1] * len(elements)
    for x, e in enumerate(elements[1:], 1):
        if inside[e.parent]:
            plain[x] = plain[e.parent] or e.plain
            # the outermost element around a block, below the article, that holds no content
            bare[x] = bare[e.parent] if bare[e.parent] >= 0 else x if not held[x] else -1
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)

    def belongs(i: int) -> bool:
        x = blocks[i].element
        if not inside[x] or content[i] or plain[x]:
            return inside[x] and content[i]
        if marked or bare[x] < 0:
            return True
        y = bare[x]
        if elements[y].tag in PARTS | LISTS and 2 * own[y] <= text[y] or _COPYRIGHT.match(blocks[i].text):
            return False
        return not strict or elements[y].tag not in PARTS or elements[y].parent not in tops or first < i < last or heads[y] > 0

    out = [i for i in range(len(blocks)) if belongs(i)]
    if out and not any(elements[blocks[i].element].tag == "h1" for i in out):
        for i in range(out[0] - 1, -1, -1):
            if boilerplate[blocks[i].element] or 2 * blocks[i].own <= len(blocks[i].text):
                break
            if elements[blocks[i].element].tag == "h1":
                return [*range(i, out[0]), *out]
    return out


def main_text(text: str | None, factor: float = 0.5) -> str:
    page = read_page(text or "")
    judge_names(page)
    return "\n\n".join(page.blocks[i].text for i in collect(page, content_blocks(page, factor)))


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
BATCH_BYTES = 8 << 20


def extract(pages: DataFrame, *, page: str = "html", factor: float = 0.5) -> DataFrame:
    """All rows of pages, with text and n_chars; the page itself is dropped."""
    kept = [f for f in pages.schema if f.name not in (*OUT.names, page)]
    schema = T.StructType([*kept, *OUT])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, BATCH_BYTES):
            text = [main_text(h, factor) for h in batch.column(page).to_pylist()]
            made = {"text": text, "n_chars": [len(t) for t in text]}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name) for f in arrow], schema=arrow)

    return pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{page}`")).mapInArrow(run, schema)
