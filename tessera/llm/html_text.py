"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides each block on
its own: containers that are never content (menus, footers, adverts,
comments, ...) and link-heavy blocks are boilerplate; long or stop-word-rich
blocks are content; the rest is undecided. Containers that only look like
boilerplate (a form, words such as ``search`` or ``sidebar`` in a class) are
marked, and their mark falls where they wrap the page's content. On a page
whose words show none of the languages with stop words, length and links alone
decide. Pass 2 gives an undecided block the label of its nearest decided
neighbours in the same region (an article, a main element, or the page outside
of them); where nothing of the page was decided to be content, all undecided
blocks are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import replace_columns
from tessera.llm.quality import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]|<")
_ATTR_END = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACES = re.compile(r"\s+")
#: Elements whose content is not text of the page.
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp".split())
SKIP = frozenset("svg math select option button canvas object audio video map datalist head".split())
#: Elements that hold boilerplate, whatever they say, and those that may also wrap a whole page.
BOILER = frozenset("nav footer aside dialog menu menuitem address".split())
WRAPPER = frozenset("form fieldset search".split())
REGION = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a block.
INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr input").split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(names.split())})(?:$|[\s_-])", re.I)


#: Words (whole ones) of class, id and role values of block containers: those that are never content,
_NEVER = _words(r"""ad ads advert\w* adsense adslot sponsor\w* promo\w* teaser\w* related recommend\w* trending comment\w* disqus\w* replies
                cookie\w* consent gdpr notice\w* popup paywall newsletter subscribe subscription signup login share sharing social\w*
                breadcrumb\w* pagination pager skip\w*""")
#: those of parts of the layout, which may also name what wraps the page,
_LAYOUT = _words(r"""menu\w* nav navbar navigation sidebar\w* sidenav footer footnav masthead toolbar modal dialog overlay register widget\w*
                 contentinfo complementary aside""")
#: and those that a section of an article may have as well.
_VOTE = _words(r"banner alert reply responses respond discussion copyright legal disclaimer search\w* tags taglist")
#: The words that count on an article or main element.
_NOT_ARTICLE = _words(r"ad ads advert\w* sponsor\w* promo\w* related recommend\w* teaser\w* comment\w* replies reply")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|articlebody|entry-content|post-content|main-content|story\w*|main)(?:$|[\s_-])", re.I)
#: Pass 1: limits of stop-word share, length (characters) and link share.
STOP_HIGH, STOP_LOW, LENGTH_LOW, LENGTH_HIGH, LINK_HIGH = 0.30, 0.12, 70, 200, 0.33


@dataclass
class Block:
    text: str
    links: int
    region: int
    heading: bool
    boiler: bool
    anchors: int = 0
    marks: tuple = ()
    label: str = ""


@dataclass
class Mark:
    """A container that may be boilerplate: in which region it lies, whether
    it wraps one, and whether content inside clears it."""

    region: int
    vote: bool
    wraps: bool = False


@dataclass
class _Open:
    tag: str
    boiler: bool
    region: int
    block: bool
    marks: tuple = ()


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name (of equal names the first counts)."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        if name:
            out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _hides(values: dict[str, str]) -> bool:
    return (values.get("hidden", "until-found").lower() != "until-found" or values.get("aria-hidden", "").lower() == "true"
            or bool(_NO_DISPLAY.search(values.get("style", ""))))


#: Attributes whose words are hints.
_HINTS = ("class", "id", "role", "itemprop", "aria-label")


def blocks(html: str) -> tuple[list[Block], list[Mark]]:
    """Blocks of a page, in order: text with references decoded and white
    space collapsed, characters in links, the region it lies in (0: none);
    and the containers that may be boilerplate."""
    out: list[Block] = []
    marks: list[Mark] = []
    stack = [_Open("", False, 0, True)]
    text: list[str] = []
    links = anchors = regions = in_link = breaks = 0

    def flush() -> None:
        nonlocal links, anchors
        joined = _SPACES.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if joined:
            top = stack[-1]
            out.append(Block(joined, links, top.region, any(o.tag in HEADING for o in stack[-4:]), top.boiler, anchors,
                             top.marks))
        links, anchors = 0, in_link

    def leave(depth: int) -> None:
        nonlocal in_link
        for o in stack[depth:]:
            in_link -= o.tag == "a"
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        start = m.start() if m else n
        if start > at:
            piece = html[at:start]
            if stack[-1].tag not in SKIP:
                text.append(piece)
                if not piece.isspace():
                    breaks = 0
                    if in_link:
                        links += len(_SPACES.sub(" ", unescape(piece)).strip())
        if not m:
            break
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = html.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        if m[0] == "<":
            text.append("<")
            at = m.end()
            continue
        tag = m[2].lower()
        close = _ATTR_END.match(html, m.end())
        end = close.end() if close else (html.find(">", m.end()) + 1 or n)
        attrs = html[m.end():end - 1]
        at = end
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag not in INLINE:
                flush()
            if depth:
                if any(o.boiler != stack[depth - 1].boiler or o.region != stack[depth - 1].region for o in stack[depth:]):
                    flush()  # what a marked inline element held is a block of its own
                leave(depth)
            continue
        if tag in RAW and not attrs.endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = found.end() if found else n
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            # a block element ends an open paragraph
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].block), 0)
            if depth and stack[depth].tag in ("p", *HEADING) and tag not in VOID:
                leave(depth)
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                lists = ("ul", "ol", "dl", "table", "menu")
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in (*same, *lists)), 0)
                if depth and stack[depth].tag in same:
                    leave(depth)
        if tag in VOID or attrs.endswith("/"):
            continue
        top = stack[-1]
        boiler, own, region = top.boiler or tag in BOILER, top.marks, top.region
        if tag not in INLINE and tag not in HEADING and tag not in ("html", "body"):
            values = _attributes(attrs) if attrs else {}
            # a single paragraph or item is marked by its class alone
            names = _HINTS if tag not in ("p", "li", "td", "th", "dd", "dt") else ("class", "role")
            hints = " ".join(_CAMEL.sub("-", values[h]) for h in names if values.get(h))
            article = tag in REGION
            good = article or bool(hints and _GOOD.search(hints))
            boiler = boiler or _hides(values) or (tag == "header" and not region)
            boiler = boiler or bool(hints) and bool((_NOT_ARTICLE if article else _NEVER).search(hints))
            if good and not boiler and not region:
                regions += 1
                region = regions
                if article:
                    for k in own:
                        marks[k].wraps = True
            elif not boiler and not article:
                vote = bool(hints and _VOTE.search(hints))
                if vote or tag in WRAPPER or hints and _LAYOUT.search(hints):
                    own = (*own, len(marks))
                    marks.append(Mark(region, vote and tag not in WRAPPER and not _LAYOUT.search(hints)))
        elif attrs and tag not in ("html", "body") and _MAY_HIDE.search(attrs):
            boiler = boiler or _hides(_attributes(attrs))
        if boiler != top.boiler and tag in INLINE:
            flush()
        if tag == "a":
            in_link += 1
            anchors += 1
        stack.append(_Open(tag, boiler, region, tag not in INLINE, own))
    flush()
    return out, marks


def _clear(found: list[Block], marks: list[Mark], sure: list[bool]) -> None:
    """Makes the blocks boilerplate that lie in a marked container, unless it
    wraps the page's content: the only article, or more than half of the text
    outside links of its region (a vote: any block that is content by itself)."""
    if not marks:
        return
    plain = any(b.region and not b.boiler and not any(marks[k].region == 0 for k in b.marks) for b in found)
    total: dict[int, int] = {}
    own = [0] * len(marks)
    content = [False] * len(marks)
    for b, good in zip(found, sure):
        if not b.boiler:
            size = max(len(b.text) - b.links, 0)
            total[b.region] = total.get(b.region, 0) + size
            for k in b.marks:
                content[k] |= good
                if marks[k].region == b.region:
                    own[k] += size
    bad = [not (m.wraps and not plain or m.vote and m.region and content[k] or content[k] and 2 * own[k] > total.get(m.region, 0))
           for k, m in enumerate(marks)]
    for b in found:
        b.boiler = b.boiler or any(bad[k] for k in b.marks)


def classify(found: list[Block], marks: list[Mark] = ()) -> list[Block]:
    """Labels ``good`` or ``bad`` for all blocks, in two passes."""
    counts = []
    for b in found:
        words = b.text.lower().split()
        counts.append((sum(w.strip(".,;:!?\"'()") in _STOP for w in words), len(words)))
    sure = [not b.boiler and len(b.text) >= LENGTH_LOW and b.links <= LINK_HIGH * len(b.text) for b in found]
    _clear(found, marks, sure)
    regions = {b.region for b in found if b.region and not b.boiler}
    own = [c for b, c in zip(found, counts) if not b.boiler and b.links <= LINK_HIGH * len(b.text)]
    known = sum(c[0] for c in own) >= STOP_LOW * sum(c[1] for c in own)  # a language with stop words
    for b, (stops, size) in zip(found, counts):
        n = len(b.text)
        stop = stops / max(size, 1)
        # in a marked region only rows of links are menus, and only a short line of rights is one
        menu = b.links > LINK_HIGH * n and (not b.region or b.anchors >= 3 and b.links > 0.8 * n)
        if b.boiler or menu or b.text.startswith("©") and (not b.region or n < LENGTH_LOW):
            b.label = "bad"
        elif regions and not b.region:
            b.label = "bad"  # the page marks its content, and this is not in it
        elif n >= LENGTH_HIGH and stop >= STOP_LOW or n >= LENGTH_LOW and stop >= STOP_HIGH and not b.links:
            b.label = "good"
        elif not known and (n >= LENGTH_HIGH or n >= LENGTH_LOW and not b.links):
            b.label = "good"
        elif n >= LENGTH_HIGH and not b.region and stop < STOP_LOW / 2:
            b.label = "bad"
    if not any(b.label == "good" for b in found):
        for b in found:
            b.label = b.label or "good"
    for region in {b.region for b in found}:
        own = [b for b in found if b.region == region]
        decided = [(i, b.label) for i, b in enumerate(own) if b.label]
        k = 0
        for i, b in enumerate(own):
            if b.label:
                continue
            while k < len(decided) and decided[k][0] < i:
                k += 1
            near = [decided[j] for j in (k - 1, k) if 0 <= j < len(decided)]
            # in a marked region only blocks without text of their own (links, notices) are bad: they do not spread
            if region:
                near = [x for x in near if x[1] == "good"] or [(i, "good")]
            if not near:
                near = [(i, "bad")]
            least = min(abs(j - i) for j, _ in near)
            labels = {label for j, label in near if abs(j - i) == least}
            if b.heading and len(near) > 1:
                labels = {near[-1][1]}  # a heading belongs to what follows
            b.label = "good" if "good" in labels else "bad"
    return found


def main_text(html: str) -> str:
    """The page's content blocks, joined by newlines."""
    return "\n".join(b.text for b in classify(*blocks(html)) if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if none) and ``n_chars``
    (its code points).

    Null html: empty. Malformed markup never fails: open elements end with
    their parent, an unclosed comment, script or tag with the page. Rows
    repeat as in the input; an empty table gives no rows; input columns
    ``text`` and ``n_chars`` are replaced. One page at a time is in memory
    besides its Arrow batch; time is linear in the page.
    """
    @F.pandas_udf("string")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    out = replace_columns(pages, {"text": content(F.coalesce(F.col(f"`{html}`"), F.lit("")))})
    return replace_columns(out, {"n_chars": F.length("text").cast("long")})
