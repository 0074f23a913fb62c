"""Main text of web pages by two-pass block rules.

A page is read once by a tag scanner into blocks (runs of text between block-level
tags) with their length, link density, stop-word density and the containers they are in.

Pass 1 decides every block by rules: inside menus, headers, footers, sidebars, notices,
adverts, forms or comments it is bad; mostly links is bad; on a page with an article
element, what is outside it is bad; long text with enough stop words is good (inside an
article long text without links needs none); the rest is ambiguous (short, or neither).

Pass 2 gives an ambiguous block the label of its nearest decided neighbour inside its own
container group (article or page); of two as near, good wins when both sides agree or the
block is inside an article; without any decided neighbour a block inside an article is
good, any other bad.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import prepare, rows

# fixed values: common function words of the languages covered
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on are this at from or an not have has but they you his her she he we their will which
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
le la les de des et un une du en est que qui dans pour par sur au pas plus avec ce il elle ne se sont ou mais son aux cette
el los las y que en un una por con para su se no del al lo como más pero sus o este si ha son entre
""".split())

# fixed values: elements by what they do to text
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
SILENT = frozenset("script style noscript template svg math canvas iframe object textarea select title head audio video".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# fixed values: what a start tag ends by itself, and the open elements beyond which it ends nothing
_CELL, _SECTION = ("td", "th", "tr"), ("td", "th", "tr", "thead", "tbody", "tfoot")
_BEYOND_ITEM = tuple(sorted((BLOCKS | FURNITURE) - {"address", "div", "p", "dt", "dd", "li"}))
IMPLIED = {"td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (_CELL, ("table",)), "thead": (_SECTION, ("table",)),
           "tbody": (_SECTION, ("table",)), "tfoot": (_SECTION, ("table",)), "dt": (("dt", "dd"), _BEYOND_ITEM), "dd": (("dt", "dd"), _BEYOND_ITEM),
           "li": (("li",), _BEYOND_ITEM)}
#: words of a class or id that name page furniture
FURNITURE_NAMES = frozenset("""ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notification alert sidebar aside comment comments disqus reply replies menu nav navbar navigation breadcrumb breadcrumbs footer header masthead
share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar widget skip""".split())
#: first words by which a class tells of furniture elsewhere, or of none: has-sidebar, no-ads
ELSEWHERE = frozenset("has have with without no not non is hide hidden show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: silent elements that may hold other elements: left open they hide nothing
MEDIA = frozenset("video audio canvas object svg math select iframe".split())

SHORT, LONG = 70, 200
LINKS_BAD, STOP_LOW, STOP_HIGH = 0.4, 0.20, 0.30

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                      |<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S | re.X)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD_BREAK = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("article", "bad", "links", "parts", "text")

    def __init__(self, article: bool, bad: bool):
        self.article, self.bad = article, bad
        self.parts: list[str] = []
        self.links = 0


def _named_furniture(value: str, inside_header: bool) -> bool:
    """Whether a token of a class or id names furniture; ``entry-header`` of an article's own header does not."""
    for token in value.split():
        words = [w.lower() for w in _WORD_BREAK.split(token) if w]
        if words and words[0] not in ELSEWHERE and any(w in FURNITURE_NAMES and not (inside_header and w in ("header", "footer")) for w in words):
            return True
    return False


def _furniture(tag: str, attributes: str, article: bool) -> int:
    """0: none; 1: by its class or id, which an article inside overrules; 2: by what the element is."""
    if tag in FURNITURE or tag == "header" and not article:
        return 2
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    named = 0
    for name, a, b, c in _NAMES.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in FURNITURE_ROLES:
            return 2
        if name in ("class", "id") and tag not in HEADINGS and tag not in ("html", "body", "article", "main") and _named_furniture(value, tag == "header"):
            named = 1
    return named


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, in an article, in furniture (see _furniture)
    places: dict[str, list[int]] = {}  # where in the stack every name is open
    current: Block | None = None
    links = 0
    at, n = 0, len(page)

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            article, bad = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            current = Block(article, bad > 0)
            out.append(current)
        current.parts.append(piece)
        if links:
            current.links += len(piece)

    def close(k: int) -> None:
        for name, _, _ in stack[k:]:
            places[name].pop()
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(entities.unescape(page[at:]))
            break
        if lt > at:
            text(entities.unescape(page[at:lt]))
        m = _TAG.match(page, lt)
        if not m:  # a bare "<" is text
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = 0
            elif tag in BLOCKS or tag in FURNITURE:
                current = None
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in SILENT:
            current = None if tag in BLOCKS else current
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            if end is None and tag in MEDIA:
                continue
            if tag == "head":  # no text of it counts, but it may be left open
                end = end or re.compile(r"<body\b", re.I).search(page, at)
                at = (end.end() if end and end[0].startswith("</") else end.start() if end else n)
            else:
                at = end.end() if end else n
            continue
        if tag == "a":
            links = int("href" in m[3].lower())  # a start tag ends an open link; an anchor without a target is none
        elif tag == "br":
            text(" ") if current is not None else None
        elif tag in BLOCKS or tag in FURNITURE:
            current = None
        if tag not in VOID and (tag in BLOCKS or tag in FURNITURE or tag in ("span", "main", "section")):
            if tag in IMPLIED:
                ends, beyond = IMPLIED[tag]
                limit = max((places[x][-1] for x in beyond if places.get(x)), default=-1)
                inner = [places[x][-1] for x in ends if places.get(x) and places[x][-1] > limit]
                if inner:
                    close(min(inner))
            elif tag in ("p", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            article, bad = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if tag in ("article", "main") and bad == 1:
                bad = 0
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, article or tag in ("article", "main"), max(bad, _furniture(tag, m[3], article))))
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text]


def labels(page: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    has_article = any(b.article and not b.bad for b in page)
    first: list[bool | None] = []
    for b in page:
        size = len(b.text)
        linked = b.links / max(1, size)
        if b.bad or has_article and not b.article or linked > LINKS_BAD and not b.article:
            first.append(False)
        elif size < SHORT:
            first.append(None)
        elif b.article:
            first.append(True)
        else:
            words = b.text.lower().split()
            stop = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))
            first.append(True if stop >= STOP_HIGH or size > LONG and stop >= STOP_LOW else False if stop < STOP_LOW / 2 else None)
    out: list[bool] = []
    before: list[int | None] = []
    last: dict[bool, int] = {}
    group = [b.article for b in page]
    # what a container decided says nothing about an article's own short lines
    decided = [f is not None and not (b.bad and b.article) for f, b in zip(first, page, strict=True)]
    for i in range(len(page)):
        before.append(last.get(group[i]))
        if decided[i]:
            last[group[i]] = i
    last = {}
    after: list[int | None] = [None] * len(page)
    for i in range(len(page) - 1, -1, -1):
        after[i] = last.get(group[i])
        if decided[i]:
            last[group[i]] = i
    for i, f in enumerate(first):
        if f is not None:
            out.append(f)
            continue
        near = sorted((abs(j - i), j) for j in (before[i], after[i]) if j is not None)
        if not near:
            out.append(group[i])
        elif len(near) == 2 and near[0][0] == near[1][0]:
            sides = [bool(first[j]) for _, j in near]
            out.append(all(sides) or any(sides) and group[i])
        else:
            out.append(bool(first[near[0][1]]))
    return out


def main_text(page: str | None) -> str:
    """Main-text blocks of a page with an empty line between them; empty for a null or empty page."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows(batches):
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row.

    A null or empty page has an empty text; ids and urls are carried as they are,
    null and repeated ones too; other columns are ignored; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(_extractor, "page_id bigint, url string, text string, n_chars bigint"))
