"""HTML extraction by line-block distribution.

A page becomes a sequence of lines, one for each block element. Markup, scripts, comments and known page furniture are
stripped; furniture leaves a run of empty lines behind. Text lengths are summed over sliding windows of ``WINDOW``
lines. A segment begins at a surge point (a window with text after one without) and ends at the dive point (the next
window without any). The text of the segments that belong to the story is the main text.

A line counts with the characters that stand outside its links. Where ``article`` or ``main`` holds half of the largest segment or more, it marks the
content, and lines elsewhere count as empty; other marks, as of teasers beside a story, decide nothing. The largest segment's innermost element (not the page's
body) is the story's: all its text stays, as furniture inside an article cuts it into segments of any size. Elsewhere a segment is strong with a window of ``MIN_PEAK`` characters
and ``PEAK_SHARE`` of the highest window; what stands between the first and the last strong segment stays, what stands before or after them goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.base import map_batches, pick

WINDOW = 3
MIN_PEAK = 80
PEAK_SHARE = 0.2
STORY_SHARE = 0.8

# Element names and the words of class, id and role attributes that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside form button dialog menu select datalist fieldset head title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert comment comments disqus respond replies sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead social share "
    "sharing related recommended newsletter subscribe subscription popup modal overlay widget widgets pagination pager login signup search toolbar "
    "contentinfo complementary skip copyright".split()
)
HEADER_WORDS = frozenset("header topbar".split())
#: A class of its own among these names a page's frame, whatever else stands beside it; a class that begins with one of the last says what the frame has.
FRAME_CLASSES = frozenset("page main layout site content article post".split())
MODIFIERS = frozenset("has with no without is not".split())

#: Elements whose words never belong to a text, and those among them whose content is no markup.
SKIPPED = frozenset("script style noscript template textarea svg iframe canvas object math audio video".split())
#: Elements of prose: their name marks furniture only where each of its words does.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption caption li dt dd td th tr span a b i em strong u s small big sub sup mark code abbr cite q time font ins del label".split())
#: Blocks that hold lines rather than other blocks.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd figcaption caption td th tr summary address option legend".split())

_ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
_PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|iframe|noscript|template)(?![\w:-])" + _ATTRIBUTES + r"(?<!/)>.*?</\1(?![\w:-])[^>]*+>"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-z][^\s/>]*+)" + _ATTRIBUTES + r">"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)>"
    r"|[^<]++|<",
    re.S | re.I,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _is_furniture(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_content):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    unwanted = FURNITURE_WORDS if in_content else FURNITURE_WORDS | HEADER_WORDS
    names = [name for marks in _MARKS.finditer(attributes) for name in (marks[1] or marks[2] or marks[3] or "").lower().split()]
    if FRAME_CLASSES.intersection(names):
        return False
    split = [_WORDS.findall(name) for name in names]
    if tag in PROSE:
        return any(words and unwanted.issuperset(words) for words in split)
    return any(words and words[0] not in MODIFIERS and not unwanted.isdisjoint(words) for words in split)


class Line(NamedTuple):
    """A line's text, its characters outside links, whether it stands inside marked content, and its element's number (-1: the page)."""

    text: str
    weight: int
    marked: bool
    element: int


GAP = [Line("", 0, False, -1)] * WINDOW


def page_lines(page: str) -> tuple[list[Line], list[tuple[int, str]]]:
    """The lines, where furniture gives empty ones, and for each element that holds blocks the one around it (-1: the page) and its tag."""
    lines: list[Line] = []
    parts: list[str] = []
    around: list[tuple[int, str]] = []
    linked = 0
    stack: list[tuple[str, bool, bool, int]] = []  # open elements; whether furniture, whether skipped, the element around
    skipped = contents = links = 0
    element = -1

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                lines.append(Line(text, max(len(text) - linked, 0), contents > 0, element))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal skipped, contents, links, element
        while len(stack) > to:
            name, furniture, hidden, outer = stack.pop()
            contents -= name in CONTENT
            links -= name == "a"
            skipped -= hidden
            element = outer
            if furniture:
                lines.extend(GAP)

    for piece in _PIECES.finditer(page):
        whole = piece[0]
        if whole[0] != "<" or whole == "<":
            if not skipped:
                text = html.unescape(whole) if "&" in whole else whole
                parts.append(text)
                if links:
                    linked += len(" ".join(text.split()))
            continue
        tag = piece[4] or piece[7]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), piece[3] or piece[6], piece[5] or piece[8] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag == "body":
            close(0)
        elif tag in ("p", "li", "a", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        hidden = tag in SKIPPED or _is_furniture(tag, attributes, contents > 0)
        furniture = hidden and tag in BLOCK
        if furniture:
            flush()
            lines.extend(GAP)
        stack.append((tag, furniture, hidden, element))
        if tag in BLOCK and tag not in LINES and tag not in ("html", "body"):
            around.append((element, tag))
            element = len(around) - 1
        skipped += hidden
        contents += tag in CONTENT
        links += tag == "a"
    flush()
    return lines, around


def _segments(weights: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, peak) of each segment."""
    total, windows = sum(weights[: WINDOW - 1]), []
    for i in range(len(weights)):  # the window that ends WINDOW - 1 lines further on
        total += weights[i + WINDOW - 1] if i + WINDOW - 1 < len(weights) else 0
        windows.append(total)
        total -= weights[i]
    segments, surge = [], None
    for i, size in enumerate([*windows, 0]):
        if size and surge is None:
            surge = i
        elif not size and surge is not None:
            segments.append((surge, i, max(windows[surge:i])))
            surge = None
    return segments


def _story(lines: list[Line], weights: list[int], around: list[tuple[int, str]], first: int, dive: int) -> set[int]:
    """The innermost element that holds ``STORY_SHARE`` of a segment, or what is around it where it is a section, with all elements inside it; none if that is the page."""
    held: dict[int, int] = {}
    for i in range(first, min(dive, len(lines))):
        if weights[i]:
            held[lines[i].element] = held.get(lines[i].element, 0) + weights[i]
    enough = STORY_SHARE * sum(held.values())
    for element in range(len(around) - 1, -1, -1):  # an element's number is above that of the one around it
        if held.get(element, 0) >= enough:
            while around[element][1] == "section" and around[element][0] >= 0:
                element = around[element][0]
            inside = {element}
            for i in range(element + 1, len(around)):
                if around[i][0] in inside:
                    inside.add(i)
            return inside
        if element in held:
            held[around[element][0]] = held.get(around[element][0], 0) + held[element]
    return set()


def line_block_text(lines: list[Line], around: list[tuple[int, str]]) -> str:
    """The story's text, blocks joined by an empty line."""
    weights = [line.weight for line in lines]
    segments = _segments(weights)
    if not segments:  # nothing but links
        return ""
    size = lambda x: sum(weights[x[0] : x[1]])
    first, dive, _ = max(segments, key=size)
    if 2 * sum(weights[i] for i in range(first, min(dive, len(lines))) if lines[i].marked) >= size((first, dive)):
        weights = [line.weight if line.marked else 0 for line in lines]
        segments = _segments(weights)
        first, dive, _ = max(segments, key=size)
    marked = any(line.marked and weight for line, weight in zip(lines, weights, strict=True)) and all(line.marked or not weight for line, weight in zip(lines, weights, strict=True))
    story = _story(lines, weights, around, first, dive)
    highest = max(peak for _, _, peak in segments)
    strong = [x for x in segments if x[2] >= min(highest, max(MIN_PEAK, PEAK_SHARE * highest))]
    reach = range(strong[0][0], strong[-1][1])
    kept = [i for i, line in enumerate(lines) if line.text and (line.element in story or (weights[i] and i in reach))]
    # Lines of links in marked content or between two kept ones stay; those at the ends are menus.
    solid = [i for i in kept if weights[i]]
    return "\n\n".join(lines[i].text for i in kept if lines[i].marked or (not marked and (weights[i] or solid[0] < i < solid[-1])))


def extract(page: str | None) -> str:
    """The main text of a page; empty for a null or empty page."""
    return line_block_text(*page_lines(page)) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of ``pages``.

    A null or empty page, or one without text outside its furniture, gives an empty text. Repeated rows each give a row,
    an empty table gives none, null ids and addresses stay null, and further columns are ignored, whatever their names.
    A page is handled whole within one task, in a single pass over it.
    """
    chosen = pick(pages, page_id=id_col, url=url_col, html=html_col)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = [extract(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(chosen.dtypes)
    return map_batches(chosen, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
