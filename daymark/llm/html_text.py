"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line's length is its text outside
links. Lengths are summed over sliding windows of lines; where a window rises above the threshold
is a surge point, where it falls back is a dive point, and all text from the first surge point to
the last dive point and its window is the body.

Elements that never belong to an article (menus, headers, footers, asides, forms, scripts and what
class, id or role call an advert, notice, sidebar or comment) are left out beforehand, so they add
no length. Where the body lies in an ``article`` or ``main`` element, all of that element's lines
are kept: short paragraphs at its ends fall below the threshold but belong to it.

Defined results: null, empty and text-free pages give an empty text; unclosed elements end with
their parent; pages that pass the threshold nowhere give their longest window, the first of equal
ones; repeated rows are extracted each. The work is in proportion to the page, however deep or
long it is and whatever it leaves open.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from daymark.llm.words import add_columns

#: Lines in a window.
WINDOW = 3
#: Characters in a window that make a surge.
SURGE = 60
#: An element named like furniture that holds this share of the page's text is none.
BULK_SHARE = 0.7

_RAW = re.compile(r"<!--|<!\[CDATA\[|\]\]>"
                  r"|<(script|style|noscript|template|svg|math|title|head)(?=[\s/>])", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I)
         for name in "script style noscript template svg math title".split()}
#: The end tag of ``head`` may be left out: then the first element of a body ends it.
_ENDS["head"] = re.compile(
    r"</head\s*>|(?=<(?:body|article|main|header|nav|div|section|p|h[1-6]|ul|ol|table|form|footer"
    r"|aside)(?=[\s/>]))", re.I)
#: These take the rest of the page where they are not closed; the others are then left open.
_TO_THE_END = frozenset(("script", "style", "head"))
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
_NAMES = frozenset(("class", "id", "role", "aria-label"))
_ATTRIBUTE = re.compile(
    r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset(
    "nav header footer aside form menu button select textarea option iframe object dialog "
    "fieldset canvas audio video".split())
BODY = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article blockquote body center dd details dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary "
    "table tbody tfoot thead tr ul aside caption".split())
#: Words that name page furniture in class, id and role.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr "
    "header login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promoted recommended related reply replies respond search share "
    "sharing sidebar sidebars social sponsor sponsored subscribe subscription tags toolbar "
    "topbar widget widgets contentinfo complementary alert".split())
#: Words that go with those above in the names of boxes, and say nothing of what is in them.
PLAIN = frozenset(
    "area articles bar block bottom box button buttons center col column container content "
    "feed form full group head holder icons inner item items large layer left line link links "
    "list main media mobile more page panel post posts right row section site slot small stories "
    "title top unit wrap wrapper zone".split())
_PIECES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(attributes: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
            for m in _ATTRIBUTE.finditer(attributes)]


@functools.lru_cache(4096)
def is_furniture(attributes: str, in_body: bool = False) -> bool:
    """Whether class, id, role or label hold a word for furniture.

    Inside an ``article`` or ``main`` a part of the text may be named so too ("related-work", or
    an anchor "share"): there an id does not count, and a class only if it has no other words
    than those and plain ones.
    """
    for name, value in _attributes(attributes):
        if name not in _NAMES or (in_body and name == "id"):
            continue
        whole = [value] if not in_body or name != "class" else value.split()
        for token in whole:
            words = _PIECES.findall(_CAMEL.sub(" ", token).lower())
            if FURNITURE.intersection(words) and (
                    not in_body or name != "class"
                    or all(w in FURNITURE or w in PLAIN for w in words)):
                return True
    return False


def is_hidden(attributes: str) -> bool:
    """Whether the element has the attribute ``hidden``, or is not displayed or read out."""
    return bool(attributes) and any(
        (name == "hidden" and value.lower() != "until-found")
        or (name == "aria-hidden" and value.strip().lower() == "true")
        or (name == "style" and _UNSEEN.search(value) is not None)
        for name, value in _attributes(attributes))


def without_raw(page: str) -> str:
    """The page without comments and the elements whose content is no text, in one pass."""
    kept, at, nowhere = [], 0, set()
    for_next: dict[str, re.Match | None] = {}
    while (m := _RAW.search(page, at)) is not None:
        name, start = (m[1] or "").lower(), m.end()
        if not name:
            kept += [page[at:m.start()], " "]
            if m[0] == "<!--":
                end = page.find("-->", start)
                at = len(page) if end < 0 else end + 3
            else:
                at = start
            continue
        opened = page.find(">", start)
        if opened < 0:
            break
        if name not in nowhere and (
                name not in for_next or for_next[name].start() < opened + 1):
            found = _ENDS[name].search(page, opened + 1)
            if found is None:
                nowhere.add(name)
            else:
                for_next[name] = found
        if name in nowhere and name not in _TO_THE_END:
            kept.append(page[at:opened + 1])
            at = opened + 1
            continue
        kept += [page[at:m.start()], " "]
        at = len(page) if name in nowhere else for_next[name].end()
    return "".join([*kept, page[at:]])


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, number of the body element or 0) of every block.

    An element named like furniture goes unless it is ``article`` or ``main``, holds one, or, on a
    page without either, holds the bulk of the text itself.
    """
    lines, parent, holding = _blocks(without_raw(page))
    total = sum(line[1] for line in lines)
    own, left = [0] * len(parent), [0] * len(parent)
    for _, size, _, k in lines:
        if k >= 0:
            own[k] += size
    bodies = any(line[2] for line in lines)
    # Innermost first: an element is judged by what its own furniture leaves of it.
    gone = [False] * len(parent)
    for k in range(len(parent) - 1, -1, -1):
        left[k] += own[k]
        gone[k] = k not in holding and (bodies or left[k] < BULK_SHARE * total or not left[k])
        if parent[k] >= 0 and not gone[k]:
            left[parent[k]] += left[k]
    for k, up in enumerate(parent):
        gone[k] = gone[k] or (up >= 0 and gone[up])
    return [line[:3] for line in lines if line[3] < 0 or not gone[line[3]]]


class _Open(NamedTuple):
    """An open element: what holds inside it, and the places of open paragraphs and list items."""

    name: str
    skip: bool       # left out
    body: int        # number of the body element around, or 0
    furniture: int   # number of the innermost element named like furniture, or -1
    links: int       # open links
    paragraph: int   # place of an open p with no block in between, or -1
    item: int        # place of an open li with no list in between, or -1


_PAGE = _Open("", False, 0, -1, 0, -1, -1)
_INLINE = frozenset(("p", "b", "i", "em", "strong", "span", "a"))


def _blocks(page: str) -> tuple[list[tuple[str, int, int, int]], list[int], set[int]]:
    """The blocks with the innermost furniture-named element around them; the one around each such
    element, or -1; and those that hold an ``article`` or ``main``."""
    lines: list[tuple[str, int, int, int]] = []
    parent: list[int] = []
    holding: set[int] = set()
    stack: list[_Open] = []
    open_names: Counter = Counter()
    parts: list[str] = []
    linked = bodies = 0
    now = _PAGE

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, max(0, len(text) - linked), now.body, now.furniture))
            parts, linked = [], 0

    def text_of(piece: str):
        nonlocal linked
        if piece and not now.skip:
            parts.append(piece)
            if now.links:
                linked += len(piece.strip())

    def close(place: int):
        nonlocal now
        while len(stack) > place:
            open_names[stack.pop().name] -= 1
        now = stack[-1] if stack else _PAGE

    at, last = 0, page.rfind(">")
    for m in _TAG.finditer(page, 0, last + 1):
        text_of(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name, attributes = m[1] == "/", m[2].lower(), m[3]
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th") and not now.skip:
            parts.append(" ")
        if closing:
            if open_names[name] > 0:
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                close(place)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in BLOCK and now.name in _INLINE and now.paragraph >= 0:
            close(now.paragraph)  # a block ends an open paragraph and what is still open in it
        if name == "li" and now.item >= 0:
            close(now.item)
        skip = now.skip or name in NOISE or is_hidden(attributes)
        body, furniture, place = now.body, now.furniture, len(stack)
        if name in BODY and not skip:
            bodies += 1
            body = body or bodies
            up = furniture
            while up >= 0 and up not in holding:
                holding.add(up)
                up = parent[up]
        elif not skip and name not in ("html", "body") and is_furniture(attributes, body > 0):
            flush()
            parent.append(furniture)
            furniture = len(parent) - 1
        now = _Open(
            name, skip, body, furniture, now.links + (name == "a"),
            place if name == "p" else -1 if name in BLOCK else now.paragraph,
            place if name == "li" else -1 if name in ("ul", "ol") else now.item)
        stack.append(now)
        open_names[name] += 1
    text_of(page[at:])
    flush()
    return lines, parent, holding


def body_range(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The line range [start, end) from the first surge to the last dive point."""
    n = len(lengths)
    if not n:
        return []
    sums = [sum(lengths[i:i + window]) for i in range(n)]
    parts: list[tuple[int, int]] = []
    start = None
    for i, total in enumerate([*sums, 0]):
        if total >= surge and start is None:
            start = i
        elif total < surge and start is not None:
            parts.append((start, min(n, i)))
            start = None
    if not parts:
        best = max(range(n), key=lambda i: sums[i])
        return [(best, min(n, best + window))] if sums[best] else []
    return [(parts[0][0], parts[-1][1])]


def main_text(page: str | None) -> str:
    """The blocks of the page's article, one a line."""
    if not page:
        return ""
    lines = page_lines(page)
    lengths = [line[1] for line in lines]
    kept = body_range(lengths)
    chosen = set()
    for start, end in kept:
        while start < end and not lengths[start]:
            start += 1
        # The short paragraphs that end the body are in the window of its dive point.
        last = min(len(lines), end + WINDOW)
        while end < last and lengths[end]:
            end += 1
        chosen.update(range(start, end))
    named = {lines[i][2] for i in chosen if lines[i][2] and lengths[i]}
    if named:
        chosen = {i for i, line in enumerate(lines) if line[2] in named}
    return "\n".join(lines[i][0] for i in sorted(chosen))


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""

    def start():
        def compute(pages_):
            texts = [main_text(p) for p in pages_]
            return texts, [len(t) for t in texts]
        return compute

    return add_columns(pages, [html_column], {"text": "string", "n_chars": "bigint"}, start,
                       drop=[html_column])
