"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by itself, by link density, length and
stop-word density, as good, bad, or one of two ambiguous kinds; the second lets ambiguous short blocks inherit the label of
their nearest decided neighbours. What a page says of its blocks is a feature of the first pass:

- Menus, sidebars, footers, forms and what is hidden (by tag or role) is bad, and so is what has such a class or id,
  unless nothing on the page would be left that is good or ambiguous: then the names round the longest block don't count.
- If a page marks its article, blocks outside it are bad, and those inside it are bad by density only where they are
  a menu (a run of links); its own header, and names that say they are the article's header, are no page header.
- Blocks that such marks or a menu made bad are no neighbours that the second pass asks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in is was it for on are as with his they at be this from have or by had not but what all were we when your can said there use an each which she do how their if will "
    "le la les de des du et un une est que qui dans pour sur pas avec au aux ce par plus se ne son sont ou mais nous vous elle il en "
    "der die das und ist von den dem ein eine einer zu mit nicht auf sich des im für an als auch es werden aus er hat dass sie nach bei um "
    "el los las del y una en por con para su al lo como más pero sus este ha me si sin sobre entre cuando muy".split()
)
#: Elements whose content is never text.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "head", "select", "datalist", "audio", "video")
#: Elements that hold no part of an article.
BAD_TAGS = frozenset("nav header footer aside form menu button dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of a class or id that name something else than the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert "
    "sidebar side nav navbar navigation menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond responses discussion discussions talkback feedback guestbook "
    "related recommended share sharing social newsletter subscribe subscription signup login popup modal overlay search pagination pager widget widgets tagcloud".split()
)
#: With one of these in the name, a header is the article's own.
OWN = frozenset("article post entry story content".split())
#: Elements that no class or id makes bad, and words before one that tell of something in an element, not of itself.
WHOLE = frozenset("html body main article".split())
STATES = frozenset("has have with no without hide show is".split())
BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option legend caption title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False  # by tag or role
    inside: bool = False  # of the marked article
    heading: bool = False
    text: str = ""
    label: str = ""
    marked: bool = False  # bad, but not by its densities


def _bad_name(value: str) -> bool:
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        bad = BAD_NAMES.intersection(parts)
        if bad == {"header"} and not OWN.isdisjoint(parts):
            continue
        if bad and not (len(parts) > 1 and parts[0] in STATES):
            return True
    return False


def _marked_bad(tag: str, attributes: str) -> int:
    """0: not bad, 1: bad by its class or id only, 2: bad in any case."""
    if tag in BAD_TAGS:
        return 2
    named = 0
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name in ("class", "id") and tag not in WHOLE and _bad_name(value):
            named = 1
        if name == "role" and value.strip().lower() in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return named


class _Open:
    """The open elements: tag, marked bad (1 by name, 2 in any case), and for those bad by name the block that they begin with."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.where: dict[str, list[int]] = {}

    def push(self, tag: str, marked: int, begin: int) -> None:
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, marked, begin))

    def pop(self) -> tuple[str, int, int]:
        top = self.stack.pop()
        self.where[top[0]].pop()
        return top

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost of these tags, -1 if none is open."""
        return max((at[-1] for t in tags if (at := self.where.get(t))), default=-1)


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ARTICLES = ("article", "main")
#: What an element's begin closes, and the elements that it doesn't reach beyond.
IMPLIED = {"p": ("p",), "li": ("li",), "option": ("option",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}
HOLDERS = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body")


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a page in order, those without text left out, and the elements with a bad name, as ranges of blocks. One pass over the page, whatever its nesting."""
    found: list[Block] = []
    named: list[tuple[int, int]] = []
    opened = _Open()
    bad = article = heading = 0
    links = bad_link = False
    now = Block()

    def flush() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split())
        if text:
            now.text = text
            found.append(now)
        now = Block(bad=bad > 0, inside=article > 0, heading=heading > 0)

    def close(at: int) -> bool:
        """Closes the elements from the place on; whether one of them was marked."""
        nonlocal bad, article, heading
        if any(marked for _, marked, _ in opened.stack[at:]):
            flush()
        changed = False
        while len(opened.stack) > at:
            tag, marked, begin = opened.pop()
            changed |= marked > 0
            bad -= marked == 2
            article -= tag in ARTICLES
            heading -= tag in HEADINGS
            if marked == 1 and begin < len(found):
                named.append((begin, len(found)))
        return changed

    def add(text: str) -> None:
        if text:
            now.parts.append(text)
            if links:
                now.linked += len(" ".join(html.unescape(text).split()))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if tag in BLOCK or tag == "head":
                flush()
            if not attributes.endswith("/"):
                ends = re.compile(rf"</{tag}[\s/>]|<body[\s>]" if tag == "head" else rf"</{tag}[\s/>]", re.I).search(page, at)
                at = ends.start() if ends else end
            add(" ")
            continue
        if tag == "a":
            links = not closing
            if bad_link:  # it ends here, and a link ends at the next
                bad -= 1
                flush()
            bad_link = not closing and _marked_bad(tag, attributes) > 0
            if bad_link:
                bad += 1
                flush()
            continue
        if tag == "br" or tag in VOID and tag != "hr":
            add(" ")
            continue
        block = tag in BLOCK
        links = links and not block
        if closing:
            at_tag = opened.last((tag,))
            if at_tag >= 0 and close(at_tag) or block:
                flush()
            continue
        marked = _marked_bad(tag, attributes)
        if tag == "header" and article:
            marked = 0
        if block:
            if tag in IMPLIED:
                if (own := opened.last(IMPLIED[tag])) > opened.last(HOLDERS):
                    close(own)
            elif opened.stack and opened.stack[-1][0] == "p":
                close(len(opened.stack) - 1)
        if tag in VOID:
            flush()
            continue
        if block or marked:
            flush()
            opened.push(tag, marked, len(found))
            bad += marked == 2
            article += tag in ARTICLES
            heading += tag in HEADINGS
            now = Block(bad=bad > 0, inside=article > 0, heading=heading > 0)
    flush()
    close(0)
    return found, named


#: Links in a row that make a menu.
MENU = 3
#: The share of stop words under which a page's language has no list here.
UNKNOWN = 0.02


def extract(page: str | None, length_low: int = 70, length_high: int = 200, stop_low: float = 0.12, stop_high: float = 0.18, link_high: float = 0.35) -> str:
    """The main text of a page: its good blocks, joined by spaces; empty if there are none.

    The densities of stop words are low for the sake of short lists, about fifty words a language. A page in which hardly any word is on
    a list is in another language: its blocks are told apart by length and links.
    """
    found, named = blocks(page or "")
    in_named = _covered(named, len(found))
    if not _knows(found, length_low, link_high):
        stop_low = stop_high = 0.0
    kinds = [_kind(b, length_low, length_high, stop_low, stop_high, link_high) for b in found]
    usable = [i for i, b in enumerate(found) if not b.bad]
    usable = [i for i in usable if found[i].inside] or usable
    if not any(kinds[i] != "bad" and not in_named[i] for i in usable):
        longest = max((i for i in usable if kinds[i] != "bad"), key=lambda i: len(found[i].text), default=None)
        if longest is not None:  # names round the longest block don't count
            in_named = _covered(((a, z) for a, z in named if not a <= longest < z), len(found))
    marked = any(found[i].inside and not in_named[i] for i in usable)
    runs = [list(g) for _, g in groupby(range(len(found)), key=lambda i: found[i].linked >= 0.9 * len(found[i].text))]
    menu = {i for g in runs if len(g) >= MENU and found[g[0]].linked for i in g if found[i].linked >= 0.9 * len(found[i].text)}
    for i, b in enumerate(found):
        b.marked = b.bad or in_named[i] > 0 or marked and not b.inside
        if b.marked:
            b.label = "bad"
        elif not b.inside:
            b.label = kinds[i]
        elif i in menu:
            b.label, b.marked = "bad", True
        else:  # an article's block isn't bad for links in its text or words in another language
            b.label = {"bad": "short" if b.linked > link_high * len(b.text) else "near-good"}.get(kinds[i], kinds[i])
    if not any(b.label == "good" for b in found):  # what comes nearest is the text then
        for b in found:
            b.label = "good" if b.label == "near-good" else b.label
    _inherit(found, "near-good", lambda b, near, both: "bad" if both == {"bad"} and not b.inside else "good")
    _inherit(found, "short", lambda b, near, both: _short(b, near, marked))
    return " ".join(b.text for b in found if b.label == "good")


def _covered(ranges: Iterable[tuple[int, int]], n: int) -> list[int]:
    """In how many of the ranges each of n blocks lies."""
    steps = [0] * (n + 1)
    for begin, end in ranges:
        steps[begin] += 1
        steps[end] -= 1
    return list(accumulate(steps))[:n]


def _knows(found: list[Block], length_low: int, link_high: float) -> bool:
    """Whether the lists know the language of a page's longer blocks without links: else stop words tell nothing, and length and links decide."""
    words = [w for b in found if not b.bad and len(b.text) >= length_low and b.linked <= link_high * len(b.text) for w in WORD.findall(b.text)]
    return sum(w.lower() in STOP_WORDS for w in words) >= UNKNOWN * len(words)


def _kind(b: Block, length_low: int, length_high: int, stop_low: float, stop_high: float, link_high: float) -> str:
    """The first pass: a block's label by its densities alone."""
    n = len(b.text)
    if b.linked > link_high * n:
        return "bad"
    if n < length_low:
        return "bad" if b.linked and not b.inside else "short"
    words = WORD.findall(b.text)
    stops = sum(w.lower() in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= stop_high:
        return "good" if n > length_high else "near-good"
    return "near-good" if stops >= stop_low else "bad"


def _short(block: Block, near: set[str], marked: bool) -> str:
    if len(near) == 1:
        return min(near)
    if not near:  # nothing on the page is decided
        return "bad" if block.linked and not block.inside else "good"
    # as near to good as to bad text
    return "good" if block.heading or marked or block.text[-1] in ".!?:\"" else "bad"


def _inherit(found: list[Block], kind: str, decide: Callable[[Block, set[str], set[str]], str]) -> None:
    """Labels the blocks of an ambiguous kind by the labels of their nearest decided neighbours and of those on both sides."""
    before: list[tuple[int, str] | None] = []
    last = None
    # in a marked article, only its own blocks that no mark decided are asked
    decides = lambda b: b.label in ("good", "bad") and not (b.marked and article)
    article = any(b.inside and not b.marked for b in found)
    for i, b in enumerate(found):
        last = (i, b.label) if decides(b) else last
        before.append(last)
    last, new = None, []
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if decides(b):
            last = (i, b.label)
        elif b.label == kind:
            sides = [(abs(i - at), label) for at, label in filter(None, (before[i], last))]
            least = min((d for d, _ in sides), default=0)
            new.append((i, decide(b, {label for d, label in sides if d == least}, {label for _, label in sides})))
    for i, label in new:
        found[i].label = label


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    pages: page_id, url, html; other columns are ignored. A null or empty html has an empty text. Text outside any
    tag counts as a block. Repeated rows each return; no rows give no rows. A task holds one batch of pages.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return batched(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
