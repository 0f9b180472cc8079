"""Main text of web pages by two passes of block rules.

A page falls into blocks at its block-level tags.  Some blocks are settled by
where they stand: menus, footers, asides, adverts, forms, notices, comments, known
by tag, role, or the words of their class and id.  Of the others, if the page marks an
article (or else a main part), only that counts.

First pass: stop-word density, length and link density call a block content or
boilerplate, or leave it open.  Second pass: open blocks, the short ones and those
with few stop words, take the label of the nearest decided neighbour.  A marked article needs no stop words to be
content, as the page itself vouches for it.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from veil.llm.rows import extended, fresh, mapped, whole_text

#: Characters from which a block is not short, and up to which a claim of rights is no content.
SHORT, LONG = 70, 200
#: Share of characters in links above which a block is boilerplate: in a marked article, and elsewhere.
LINKED_IN_ARTICLE, LINKED = 0.5, 0.33
#: Share of stop words from which a block is content, and below which it is boilerplate.
STOPPED, UNSTOPPED = 0.2, 0.08

STOP_WORDS = frozenset("""
    a about after all also an and any are as at be been but by can for from had has have he her his how i if in into is
    it its more no not of on one or our she so than that the their them there they this to up was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für
    hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn wie
    wir wird zu zum zur über
    au aussi avec aux car ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous
    on ont ou où par pas plus pour qu que qui sa se ses si son sont sur tout très un une vous à été
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no
    nos o para pero por porque que se ser si sin sobre son su sus también un una uno y ya yo
""".split())

#: Elements whose content is raw text, none of it shown as prose.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset("""
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary
    table tbody td tfoot th thead tr ul
""".split())
#: Never part of a main text, whatever is in them; and parts of a page that may wrap an article by mistake or by habit.
OUT = frozenset("""
    aside audio button canvas datalist dialog footer label legend menu noscript object optgroup option select svg template
    video
""".split())
AROUND = frozenset("form header nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or an id.
COMMENTS = frozenset("comment comments commentlist commentary disqus replies respond".split())
HINTS = frozenset("""
    ad ads adsbygoogle adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs consent cookie
    cookies disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification
    overlay pager pagination paywall popup promo promotion recommended related share sharing sidebar signup skip social
    sponsor sponsored subscribe subscription toolbar topbar widget
""".split())
#: A layout that has or lacks such a part is not the part itself.
LAYOUT = frozenset("has no with without".split())

_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_MARK = re.compile(
    rf"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)(>|\Z)|</[^>]*+(?:>|\Z)",
    re.DOTALL)
_NAMED = re.compile(r"""([^\s/>=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.IGNORECASE)

#: How surely a place is outside the main text; of the header of an article its headings count.
NONE, TITLE, SOFT, HARD = range(4)
PAGE, MAIN, ARTICLE = 0, 1, 2


@dataclass(slots=True)
class Place:
    """Where text stands: how surely outside the main text, in which part of the page, in a link, in a heading."""

    out: int = NONE
    part: int = PAGE
    link: bool = False
    heading: bool = False


@dataclass(slots=True)
class Block:
    out: bool = True
    part: int = PAGE
    heading: bool = False
    linked: int = 0
    pieces: list[str] = field(default_factory=list)
    text: str = ""


def _hinted(attributes: dict[str, str], part: int) -> int:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none", attributes.get("style", "")):
        return HARD
    words = [w.lower() for w in _NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")]
    if not COMMENTS.isdisjoint(words):
        return HARD
    for before, word in zip(["", *words], words, strict=False):
        if (word in HINTS or (word == "header" and part == PAGE)) and before not in LAYOUT:
            return SOFT
    return SOFT if attributes.get("role") in ROLES else NONE


def _entered(tag: str, raw_attributes: str, place: Place) -> Place:
    """The place inside an element."""
    attributes = {}
    if raw_attributes:
        for m in _NAMED.finditer(raw_attributes):
            attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if "hidden" in raw_attributes.lower().split():
            attributes["hidden"] = ""
    out, part = place.out, place.part
    hint = _hinted(attributes, part) if attributes and tag not in ("html", "body") else NONE
    main = tag == "main" or attributes.get("role") == "main"
    article = tag == "article" or attributes.get("itemprop") == "articleBody"
    if (main or article) and out < HARD and part < ARTICLE:
        part = ARTICLE if article else MAIN
        out = HARD if hint == HARD else NONE
    elif tag in OUT:
        out = HARD
    else:
        around = NONE if tag not in AROUND else TITLE if tag == "header" and part != PAGE else SOFT
        out = max(NONE if out == TITLE and tag in HEADINGS else out, hint, around)
    return Place(out, part, place.link or tag == "a", place.heading or tag in HEADINGS)


#: What a start tag closes, and where the search for it ends.
_CLOSED = {tag: (frozenset(closed.split()), frozenset(within.split())) for tag, closed, within in (
    ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr", "table"),
    ("td", "td th", "tr table"), ("th", "td th", "tr table"))}
_P_CLOSERS = BLOCKS - frozenset("body caption frameset head html legend option optgroup select tbody td tfoot th thead tr".split())
_P_WITHIN = frozenset("table td th caption object template button html".split())


class _Reader:
    """One page read tag by tag: the open elements, and the blocks so far."""

    def __init__(self):
        self.open: list[tuple[str, Place]] = []
        self.counts: dict[str, int] = {}
        self.place = Place()
        self.block = Block()
        self.blocks: list[Block] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.block.pieces).split())
        if text:
            self.block.text = text
            self.blocks.append(self.block)
            self.block = Block()
        elif self.block.pieces:
            self.block = Block()

    def text(self, raw: str) -> None:
        shown = references.unescape(raw) if "&" in raw else raw
        place, block = self.place, self.block
        if shown.isspace():
            block.pieces.append(" ")
            return
        if place.out:
            if not block.out:
                return  # an advert within a paragraph
        elif block.out:
            block.pieces = []
            block.out = False
        block.part, block.heading = max(block.part, place.part), block.heading or place.heading
        if place.link:
            block.linked += len("".join(shown.split()))
        block.pieces.append(shown)

    def pop(self, depth: int) -> None:
        for tag, _ in self.open[depth:]:
            self.counts[tag] -= 1
        self.place = self.open[depth][1]
        del self.open[depth:]

    def close(self, tags, within) -> None:
        """Close the innermost of ``tags``, unless one of ``within`` is around the present place first."""
        if not any(self.counts.get(t) for t in tags):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.open[depth][0]
            if tag in tags:
                self.pop(depth)
                return
            if tag in within:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_block()
            if tag in _P_CLOSERS:
                self.close(("p",), _P_WITHIN)
            if tag in _CLOSED:
                self.close(*_CLOSED[tag])
        elif tag == "br":
            self.block.pieces.append(" ")
        if tag in VOID:
            return
        inside = _entered(tag, attributes, self.place)
        # Inline elements that change nothing are not kept, unless an end tag could be taken for another's.
        if tag in BLOCKS or inside != self.place or self.counts.get(tag):
            self.open.append((tag, self.place))
            self.counts[tag] = self.counts.get(tag, 0) + 1
            self.place = inside

    def end(self, tag: str) -> None:
        if tag == "br":
            self.block.pieces.append(" ")
        elif tag in BLOCKS:
            self.end_block()
            self.close(HEADINGS if tag in HEADINGS else (tag,), ())
        else:
            self.close((tag,), BLOCKS)


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in their order, with white space as single blanks and character references decoded."""
    reader, at = _Reader(), 0
    while True:
        mark = _MARK.search(page, at)
        if not mark:
            break
        if mark.start() > at:
            reader.text(page[at:mark.start()])
        at = mark.end()
        if mark[1] and mark[3]:
            tag = mark[1].lower()
            if page[mark.start() + 1] == "/":
                reader.end(tag)
            else:
                reader.start(tag, mark[2])
                if tag in RAW:
                    ended = _RAW_END[tag].search(page, at)
                    at = ended.start() if ended else len(page)
    if at < len(page):
        reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def _first_pass(block: Block) -> bool | None:
    size = len(block.text)
    linked = block.linked / max(1, len(block.text.replace(" ", "")))
    if block.part != PAGE:
        if linked > LINKED_IN_ARTICLE and not block.heading:
            return False
        return True if size >= SHORT else None
    if linked > LINKED or (_RIGHTS.search(block.text) and size < LONG):
        return False
    if size < SHORT or block.heading:
        return None
    words = _WORD.findall(block.text.lower())
    stopped = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stopped >= STOPPED:
        return True
    return False if stopped < UNSTOPPED else None


def label(blocks: list[Block]) -> list[bool]:
    """Which of the blocks are content; they are of one part of the page."""
    decided = [_first_pass(b) for b in blocks]
    none = (len(blocks) + 1, None)

    def nearest(order) -> list[tuple[int, bool | None]]:
        """(distance, label) of the nearest decided block that came before in the order."""
        out, last = {}, None
        for i in order:
            out[i] = none if last is None else (abs(i - last), decided[last])
            if decided[i] is not None:
                last = i
        return [out[i] for i in range(len(blocks))]

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    out = []
    for block, own, (back, earlier), (ahead, later) in zip(blocks, decided, before, after, strict=True):
        marked = block.part != PAGE
        if own is not None:
            out.append(own)
        elif earlier is None and later is None:
            out.append(marked)
        elif block.heading and later is not None:
            out.append(later)  # a heading belongs to what it stands above
        elif back == ahead and earlier != later:
            out.append(marked)
        else:
            out.append(earlier if back < ahead or later is None else later)
    return out


def extract(page: str) -> str:
    """The main text: content blocks in the order of the page, one in a line."""
    blocks = [b for b in read_blocks(page) if not b.out]
    part = max((b.part for b in blocks), default=PAGE)
    chosen = [b for b in blocks if b.part == part]
    return "\n".join(b.text for b, content in zip(chosen, label(chosen), strict=True) if content)


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All rows with the main text of their page.

    Null and empty pages, and pages without content, have an empty text.  Whole
    pages are read; markup that is cut off or badly nested ends what it can end.
    Repeated rows get equal texts, empty tables stay empty, and a name that is
    taken gets an underscore.
    """
    def run(batches):
        for batch in batches:
            texts = [extract(page) for page in batch.column(batch.num_columns - 1).to_pylist()]
            yield extended(batch, 1, [pa.array(texts, pa.string())])

    name, = fresh(pages, out)
    return mapped(pages, [whole_text(html)], run, {name: "string"})
