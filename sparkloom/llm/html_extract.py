"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of
the blocks before and after it, whether prose stands before and after it in what holds it, and what its surroundings
say (element and class names). A small decision tree, trained on the labelled pages in `html_labels`, keeps a block or
not.

A class name or id marks an element only as a whole: each of its words must be a word for such elements or one of
layout, so `sidebar-left` marks and `privacy-law` does not. An id of one heading, or within an article of a mere topic
(`privacy`, `navigation`), is an anchor and marks nothing. Names count only where they can be meant for the element:
never on html, body and main, not on the page's main article (the largest one that nothing marks, or else the
largest), not on what merely wraps that article, that is, where the article has half of the wrapper's words or more,
and not on an element that holds half or more of its article's words outside links and comments. Only what is
named for comments may be longer than the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scratch import bound_batches
from sparkloom.llm.html_labels import PAGES

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^<>]*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"<]*\"|'[^'<]*'|[^<>\"'])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content HTML reads as raw text, to the end of the page where they are not closed.
RAW = frozenset("script style textarea title iframe noframes".split())
#: Other elements whose content is not text of the page, if they are closed.
SKIP = frozenset("noscript template svg select button object canvas audio video datalist".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Headings.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold other blocks and so say what a block belongs to.
HOLDS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header hgroup main menu nav ol search section table ul".split())
#: Elements whose blocks are rarely the main text.
APART = frozenset("aside dialog fieldset footer form menu nav search".split())
#: Roles of such elements.
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that class names and ids of such elements are made of; a heuristic.
APART_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright discussion disqus footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola tags teaser toc toolbar topbar warning widget widgets".split()
)
#: Of these, words for what readers write, which may be longer than the article; and words that are topics as well.
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
TOPIC_NAMES = frozenset("advertising alert announcement consent cookies copyright discussion legal login menu menus navigation notice notification privacy promotion search share sharing social tags warning widget widgets".split())
#: Words of layout that may stand beside them; a heuristic.
LAYOUT_NAMES = frozenset("area article bar block bottom box button buttons column container entry fixed form holder inline inner js left link links list module outer page panel post primary right row secondary section side site slot sticky text thread top wrap wrapper zone".split())
#: Words at the beginning of a class name that say something about another element.
_ABOUT = frozenset("has no not with without".split())
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "apart_element", "apart_name", "in_article", "page_has_article", "page_header", "heading", "list_item", "prose_before", "prose_after")
#: Words from which a block with few links is prose.
PROSE_WORDS = 12


@dataclass
class Block:
    text: str
    words: int
    linked: int
    apart: bool
    named: bool
    article: bool
    header: bool
    heading: bool
    item: bool
    holder: int = 0
    keep: bool = False


def _mark(token: str, is_id: bool, in_article: bool) -> int:
    """What a class name or id says of its element: 0 nothing, 1 that it is apart, 2 that readers wrote it."""
    own = [w.lower() for w in _NAME.findall(token)]
    if not own or own[0] in _ABOUT or any(w not in APART_NAMES and w not in LAYOUT_NAMES for w in own):
        return 0
    if is_id and in_article and all(w in TOPIC_NAMES or w in LAYOUT_NAMES for w in own):
        return 0
    return 2 if any(w in COMMENT_NAMES for w in own) else int(any(w in APART_NAMES for w in own))


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """What class names and id say of an element (see _mark), and whether role or visibility set it apart."""
    named, apart = 0, "hidden" in attributes.lower().split()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if not (name == "id" and tag in HEADINGS):
                named = max([named, *(_mark(token, name == "id", in_article) for token in value.split())])
        elif name == "role" and value.lower() in APART_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            apart = True
    return named, apart


def _parts(m: re.Match) -> tuple[bool, str, str]:
    """Whether a tag closes, its name in lower case ('' for a comment), its attributes."""
    closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
    return bool(closing), (tag or "").lower(), attributes or ""


def _ends(page: str) -> dict[int, int]:
    """Where each closed element of SKIP ends, by the end of its opening tag. One pass over the page."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIP}
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        closing, tag, attributes = _parts(m)
        whole = attributes.rstrip().endswith("/")
        if tag in SKIP:
            if not closing and not whole:
                opened[tag].append(at)
            elif closing and opened[tag]:
                found[opened[tag].pop()] = at
        elif (tag in RAW or tag == "xmp") and not closing and not whole:
            svg = bool(opened["svg"])  # within svg such elements are not raw
            stop = re.compile(rf"</(?:{tag}|svg)\s*>" if svg else rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.start() if stop else at if svg else len(page)
    return found


@dataclass(slots=True)
class Range:
    """Blocks of an element: from `start` to before `stop`. Of an article or main: whether its own name marks it,
    and the outermost element around it that a name marks. Of a named element in an article: the article, the named
    element around it, whether it or one around it is named for comments, and whether its name hides its blocks."""

    start: int
    stop: int | None = None
    own: bool = False
    outer: Range | None = None
    main: bool = False
    article: Range | None = None
    up: Range | None = None
    comments: bool = False
    hides: bool = False


@dataclass(slots=True, frozen=True)
class State:
    """What surrounds a block. named: the outermost element whose name sets it apart. article: the outermost
    article, or main where no article is. inner: the innermost element within that one that a name marks. deep:
    within an article. holder: the number of the element that holds the block."""

    apart: bool = False
    named: Range | None = None
    article: Range | None = None
    inner: Range | None = None
    deep: bool = False
    header: bool = False
    keep: bool = False
    holder: int = 0


def _settle(out: list[Block], states: list[State], articles: list[Range], named: list[Range]) -> None:
    """Whether the names around each block set it apart. `named` has elements in articles, outer ones first."""
    total = np.r_[0, np.cumsum([b.words for b in out])]
    plain = np.r_[0, np.cumsum([0 if s.inner is not None and s.inner.comments else b.words - b.linked for b, s in zip(out, states, strict=True)])]

    def words(r: Range, total: np.ndarray = total) -> int:
        return int(total[len(out) if r.stop is None else r.stop] - total[r.start])

    for r in named:
        r.hides = r.comments or 2 * words(r, plain) < words(r.article, plain) or r.up is not None and r.up.hides
    main = max((r for r in articles if not r.main), key=lambda r: (r.outer is None, words(r) / (1 + r.own)), default=None)
    for b, s in zip(out, states, strict=True):
        a = s.article
        if a is None:
            b.named = s.named is not None
        elif a.main or a is main:
            b.named = s.inner is not None and s.inner.hides or a.outer is not None and words(a.outer) > 2 * words(a)
        else:
            b.named = s.inner is not None and s.inner.hides or a.own or a.outer is not None


def blocks(page: str) -> list[Block]:
    """The text blocks of a whole page in order. `data-keep` marks the labelled ones; features ignore it."""
    out: list[Block] = []
    states: list[State] = []
    articles: list[Range] = []
    within: list[Range] = []  # named elements of articles
    opened: dict[str, int] = dict.fromkeys(HOLDS, 0)  # of the elements in the stack
    holders = 0
    stack: list[tuple[str, State, list[Range]]] = []  # element, what it gives its blocks, ranges that end with it
    text: list[str] = []
    linked: list[str] = []
    state, link, leaf, keep = State(), False, "", False

    def end() -> None:
        nonlocal keep
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            n = whole.count(" ") + 1
            heading = leaf in HEADINGS
            out.append(Block(whole, n, min(n, len("".join(linked).split())), state.apart, False, state.article is not None, state.header, heading, leaf == "li", state.holder, keep or state.keep))
            states.append(state)
        text.clear()
        linked.clear()
        keep = False

    at, size, ends = 0, len(page), None
    while at < size:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            text.append(piece)
            if link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = _parts(m)
        if not tag:
            continue
        opens, literal = not closing and not attributes.rstrip().endswith("/"), ""
        if opens and (tag in RAW or tag == "xmp"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "xmp":  # shown as it is
                literal = html.escape(page[at : stop.start() if stop else size])
            at = stop.end() if stop and tag != "xmp" else stop.start() if stop else size
        if tag in RAW:
            continue
        if tag in SKIP:
            if opens:
                ends = _ends(page) if ends is None else ends
                at = ends.get(at, at)
        elif tag == "a":
            link = not closing
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK:
            end()
            link, leaf = False, "" if closing else tag
            if closing:
                while opened.get(tag):  # what it closes goes, so all closing tags together are one pass over the stack
                    name, _, ranges = stack.pop()
                    opened[name] -= 1
                    for r in ranges:
                        r.stop = len(out)
                    if name == tag:
                        break
            else:
                keep = "data-keep" in attributes
                around = stack[-1][1] if stack else State()
                named, apart = _marks(tag, attributes, around.article is not None) if "=" in attributes or "hidden" in attributes else (0, False)
                ranges = []
                first, inside, article, deep = around.named, around.inner, around.article, around.deep
                if tag == "article" and not deep or tag == "main" and article is None:
                    article, inside, deep = Range(len(out), None, bool(named) and tag == "article", first, tag == "main"), None, tag == "article"
                    articles.append(article)
                    ranges.append(article)
                elif named and tag not in ("body", "main"):
                    if article is not None:
                        inside = Range(len(out), article=article, up=inside, comments=named == 2 or inside is not None and inside.comments)
                        within.append(inside)
                        ranges.append(inside)
                    if first is None:
                        first = Range(len(out))
                        ranges.append(first)
                holders += tag in HOLDS
                own = State(around.apart or apart or tag in APART, first, article, inside, deep, around.header or tag == "header" and article is None, around.keep or keep, holders if tag in HOLDS else around.holder)
                if tag in HOLDS:
                    stack.append((tag, own, ranges))
                    opened[tag] += 1
                elif tag != "body":  # a block of its own, such as <p class="ad">
                    for r in ranges:
                        r.stop = len(out) + 1
                    state = own
                    text.append(literal)
                    continue
            text.append(literal)
            state = stack[-1][1] if stack else State()
    end()
    _settle(out, states, articles, within)
    return out


def features(found: list[Block]) -> np.ndarray:
    has = any(b.article for b in found)
    own = [(b.words, b.linked / b.words) for b in found]
    pad = [(0, 0.0), *own, (0, 0.0)]
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.words - b.linked >= PROSE_WORDS and 4 * b.linked < b.words:
            first.setdefault(b.holder, i)
            last[b.holder] = i
    sides = [(first.get(b.holder, i) < i, last.get(b.holder, i) > i) for i, b in enumerate(found)]
    return np.array([[*own[i], *pad[i], *pad[i + 2], b.apart, b.named, b.article, has, b.header, b.heading, b.item, *sides[i]] for i, b in enumerate(found)], float).reshape(-1, len(FEATURES))


@dataclass
class Node:
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    keep: bool = False

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(rows), self.keep)
        high = rows[:, self.feature] > self.at
        return np.where(high, self.high.predict(rows), self.low.predict(rows)) if len(rows) else high


def grow(rows: np.ndarray, keep: np.ndarray, depth: int = 10) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest cut."""
    best = (keep.mean() * (1 - keep.mean()) * len(keep) - 1e-9, -1, 0.0)
    if depth and best[0] > 0:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                high = rows[:, f] > cut
                cost = sum(p.mean() * (1 - p.mean()) * len(p) for p in (keep[high], keep[~high]))
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(cut))
    if best[1] < 0:
        return Node(keep=bool(keep.mean() >= 0.5))
    high = rows[:, best[1]] > best[2]
    return Node(best[1], best[2], grow(rows[~high], keep[~high], depth - 1), grow(rows[high], keep[high], depth - 1))


@cache
def tree() -> Node:
    """The tree that the labelled pages teach."""
    found = [blocks(p) for p in PAGES]
    return grow(np.concatenate([features(b) for b in found]), np.array([x.keep for b in found for x in b], float))


def main_text(page: str | None, model: Node) -> str:
    """Kept blocks joined by two line feeds; nothing for a null page."""
    found = blocks(page) if page else []
    kept = model.predict(features(found)) if found else []
    return "\n\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def _extract(model: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(p.as_py(), model) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string())], [*batch.schema.names[:-1], "x"])

    return run


def extract_text(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """`carry` columns and the main text of every row, from its whole page.

    Character references are decoded, white space inside a block is one space, blocks are joined by two line
    feeds in page order. An element such as button or video that is never closed hides nothing after it; math
    is text, and xmp is text as it is written. A null, empty or wholly boilerplate page has the text ''. Rows that repeat give equal
    rows; other columns, of any name, are not looked at. Empty table: empty result. One pass, no shuffle."""
    bound_batches(pages.sparkSession)
    inner = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(html_col).alias("h"))
    fields = ", ".join(f"c{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(carry)))
    return inner.mapInArrow(_extract(tree()), f"{fields}, x string").toDF(*carry, "text")
