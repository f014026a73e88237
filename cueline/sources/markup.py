"""A table function that reads transcripts out of nested markup, one page at a time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import functions as F

# The elements that hold a transcript, the classes of its parts, and where else it may stand.
SEGMENT = "ytd-transcript-segment-renderer"
FORMATTED = "yt-formatted-string"
TIME_CLASSES = {"segment-timestamp", "cue-time"}
TEXT_CLASS = "segment-text"
PANEL, PANEL_ID = "ytd-engagement-panel-section-list-renderer", "engagement-panel-transcript"
RENDERER = "ytd-transcript-renderer"
LABEL = "Transcript"
ITEM_CLASSES = ("cue", "segment")
# Elements without content, and those whose content is not markup.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?+""")
_LEADING = re.compile(r"\s*(\d+(?::\d+){1,2})")


def _end_of_tag(html: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, outside of quoted values; -1 if there is none."""
    while True:
        stop = _STOP.search(html, at)
        if stop is None or stop[0] == ">":
            return -1 if stop is None else stop.start()
        closed = html.find(stop[0][-1], stop.end())
        # a quote that is never closed is a character like any other; no later one of its kind exists
        at = closed + 1 if closed >= 0 else stop.end()


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes as written) of a page in order; kinds are text, open and close.

    Comments, declarations, scripts and styles are left out.  Each character is
    looked at a bounded number of times, whatever is left unclosed.
    """
    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", html[at:mark], ""
        if mark == size:
            return
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("/", mark + 1)
        name = _NAME.match(html, mark + 1 + closing)
        if name is None and not closing and html[mark + 1 : mark + 2] not in ("!", "?"):
            yield "text", "<", ""
            at = mark + 1
            continue
        end = _end_of_tag(html, name.end()) if name else html.find(">", mark)
        if end < 0:  # a tag that never ends
            return
        at = end + 1
        if name is None:
            continue
        tag = name[0].lower()
        yield "close" if closing else "open", tag, html[name.end() : end]
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            if end is None:
                return
            at = end.start()


class _Element:
    """An open or closed element of interest: where its text starts and ends, and what it is."""

    __slots__ = ("containers", "end", "is_item", "parent", "start", "text", "time")

    def __init__(self, start: int, parent: _Element | None, is_item: bool, containers: int) -> None:
        self.start, self.end, self.parent, self.is_item, self.containers = start, None, parent, is_item, containers
        self.time = self.text = None


def _leading_time(whole: str, e: _Element) -> tuple[str, str]:
    """The time that the text of an element starts with, and the rest; empty without one."""
    time = _LEADING.match(whole, e.start, e.end)
    return (time[1], whole[time.end() : e.end].strip()) if time else ("", "")


def read_transcript(html: str) -> list[tuple[str, str]]:
    """(time, text) of each segment of a page.

    A segment's parts are the first elements in it with the classes of a time and
    a text, else the time that its text starts with and the rest.  Without any full segment, the containers
    are tried in order: the first element of each kind, and in it what carries the
    class of an item.  Of items in one another only the innermost that starts with a time counts.
    Elements left open end where their parent ends, or with the page; a segment, ``li`` or
    ``p`` also ends where another of its kind begins.  Attribute values are taken as written.
    """
    pieces: list[str] = []
    n_chars = 0
    stack: list[tuple[str, list[_Element], int, bool]] = []  # tag, its elements, the container it opens, whether it is a cue
    opened: Counter[str] = Counter()
    segments: list[_Element] = []
    items: list[_Element] = []
    in_segments: list[_Element] = []  # at most one
    in_items: list[_Element] = []
    inside = met = cues = 0

    def leave() -> None:
        nonlocal inside, cues
        tag, made, container, is_cue = stack.pop()
        opened[tag] -= 1
        inside &= ~container
        cues -= is_cue
        for e in made:
            e.end = n_chars
            for open_ones in (in_segments, in_items):
                if open_ones and open_ones[-1] is e:
                    open_ones.pop()

    def close(tag: str) -> None:
        if opened[tag]:  # a stray end tag costs nothing
            while stack[-1][0] != tag:
                leave()
            leave()

    for kind, name, rest in tokens(html):
        if kind == "text":
            pieces.append(unescape(name))
            n_chars += len(pieces[-1])
        elif kind == "close":
            close(name)
        elif name not in VOID:
            if name == SEGMENT or stack and stack[-1][0] == name and name in ("li", "p"):
                close(name)
            given = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(rest))}  # the first of a name counts
            written = given.get("class", "")
            classes, made = set(written.split()), []
            if name == SEGMENT:
                made.append(_Element(n_chars, None, False, 0))
                segments.append(made[-1])
                in_segments.append(made[-1])
            elif in_segments:
                owner = in_segments[-1]
                if owner.time is None and (classes & TIME_CLASSES or SEGMENT in classes and given.get("slot") == "timestamp"):
                    owner.time = _Element(n_chars, None, False, 0)
                    made.append(owner.time)
                elif owner.text is None and (TEXT_CLASS in classes or name == FORMATTED and (SEGMENT in classes or cues)):
                    owner.text = _Element(n_chars, None, False, 0)
                    made.append(owner.text)
            if inside and any(c in written for c in ITEM_CLASSES):
                made.append(_Element(n_chars, in_items[-1] if in_items else None, True, inside))
                items.append(made[-1])
                in_items.append(made[-1])
            new = 0
            for bit, held in enumerate((name == PANEL and given.get("target-id") == PANEL_ID, name == RENDERER, LABEL in given.get("aria-label", ""))):
                if held and not met >> bit & 1:  # the first of its kind
                    new |= 1 << bit
            met |= new
            inside |= new
            is_cue = "cue" in classes
            cues += is_cue
            stack.append((name, made, new, is_cue))
            opened[name] += 1
    while stack:
        leave()

    whole = "".join(pieces)
    found = []
    for s in segments:
        if s.time is None or s.text is None:
            found.append(_leading_time(whole, s))
        else:
            found.append((whole[s.time.start : s.time.end].strip(), whole[s.text.start : s.text.end].strip()))
    found = [(time, text) for time, text in found if time and text]
    if found:
        return found
    rows: list[tuple[int, tuple[str, str]]] = []
    holding: set[int] = set()
    for e in reversed(items):  # what is inside comes before what holds it
        row = ("", "") if id(e) in holding else _leading_time(whole, e)
        if row[1]:
            rows.append((e.containers, row))
        if e.parent is not None and (row[1] or id(e) in holding):
            holding.add(id(e.parent))
    for bit in range(3):
        chosen = [row for containers, row in reversed(rows) if containers >> bit & 1]
        if chosen:
            return chosen
    return []


@F.udtf(returnType="idx int, time string, text string", useArrow=True)
class TranscriptRows:
    """``transcript_rows(html)``: the segments of a page, numbered from 0; none for a null or empty page.

    With ``true`` as a second argument a page without segments gives one row of nulls, as an outer
    join would, which Spark has not for functions of this kind.
    In SQL, once registered: ``SELECT url, r.* FROM pages, LATERAL transcript_rows(html) r``.
    """

    def eval(self, html: str | None, always: bool = False) -> Iterator[tuple[int | None, str | None, str | None]]:
        rows = read_transcript(html or "")
        for idx, (time, text) in enumerate(rows):
            yield idx, time, text
        if always and not rows:
            yield None, None, None
