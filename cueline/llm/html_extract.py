"""Main text of web pages: site templates are found by subtrees that recur on a host.

Every page is parsed to elements, and Spark counts three hashes of them for each
host, over pages with distinct bodies (copies of a page count as one page):

*slot*: the element's name, class, id and role and those of its ancestors.  A
container that is there once a page and holds at least ``OWN_SHARE`` of the words
of the pages that have it, with no such container inside, carries the pages' own text.

*shape*: the slot with the shapes of the children, without any text.  A subtree
whose shape recurs on ``LEAST_PAGES`` pages outside of the own text is deleted, so
that a menu or an advert goes although its words change from page to page.

*content*: the shape and all text.  A subtree that recurs with its words is deleted
outside of the own text, and inside of it where it is a container such as a box.

What is no article by its element or role (menus, footers, adverts, forms, scripts,
comments of readers and the like) always goes.  On hosts with fewer than ``LEAST_PAGES``
distinct pages nothing can recur: there, and only there, class and id are also compared
with a list of words.  Text that is neither named so nor recurs stays, wherever it is.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col, columns, spare

#: A subtree is a template's if it stands on so many pages of its host, however many pages the host has.
LEAST_PAGES = 3
#: A container holds a page's own text from this share of its words on; a lighter one that recurs doesn't.
OWN_SHARE = 0.2
#: Templates of all hosts are broadcast up to so many hashes (of 8 bytes); beyond, pages are dealt by host.
BROADCAST_HASHES = 1 << 20
#: Elements' rows are handed on after the page that fills so many.
ROWS_TOGETHER = 20_000
#: A host's pages are dealt to so many parts where templates are not broadcast.
HOST_SALTS = 64

# Names of HTML elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = (PARAGRAPH - {"li", "dd", "td"}) | frozenset("a b em i span strong time".split())
DROPPED = frozenset(
    "nav footer aside form script style noscript iframe template head title button select textarea input dialog svg "
    "canvas object embed menu".split()
)
ARTICLE = frozenset("article main".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class and id that name no article, for hosts with too few pages to show a template.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|disqus|"
    r"sharing|social|related|recommended|widget|pagination|pager|toolbar)(?:$|[\s_-])"
)
# readers' comments have no element of their own.  A whole word of a container's class or id names them; a
# word that only has "comment" or "reply" in it, or stands on a paragraph, does not.
_COMMENTS = re.compile(
    r"(?:^|\s)(?:(?:[a-z]+[_-])*(?:comments?|replies|respond|disqus)(?:[_-](?:lists?|section|area|threads?|items?|body|form|content|container|wrapper|box|block|\d+))*|reply)(?:$|\s)"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element: what it is called, what is in it, whether its name drops it, and whether it says that it is an article."""

    __slots__ = ("tag", "sign", "children", "dropped", "named", "article", "header")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.sign, self.children = tag, tag, []
        self.article = tag in ARTICLE
        self.dropped = tag in DROPPED
        self.header = tag == "header"
        self.named = False
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            role = found.get("role", "").lower()
            # numbers in a class or id tell posts apart, not elements
            self.sign = f"{tag} {role} {_DIGITS.sub('0', ' '.join(sorted(names.split())))}" if names.strip() or role else tag
            if tag not in TEXTUAL and _COMMENTS.search(names):  # articles of readers are no articles
                self.article, self.dropped = False, True
            self.article = self.article or role == "main" or found.get("itemprop", "").lower() == "articlebody"
            if not self.article and tag not in ("html", "body"):
                hidden = "hidden" in found or found.get("aria-hidden") == "true"
                hidden = hidden or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
                self.dropped = bool(self.dropped or role in DROPPED_ROLES or hidden)
                self.named = bool(_NAMED.search(names))


def parse(html: str | None) -> Node:
    """The element tree of a page; unclosed, unopened and cut-off elements are mended as browsers do."""
    root = Node("#root")
    stack, at, text = [root], 0, html or ""
    # where elements of each tag, articles, and blocks that end no paragraph are open: no search walks the stack
    places: dict[str, list[int]] = {}
    article, block = places.setdefault("#article", []), places.setdefault("#block", [])

    def kinds(tag: str) -> list[list[int]]:
        of = [places.setdefault(tag, [])]
        return of + [article] * (tag in ARTICLE) + [block] * (tag in BLOCK and tag != "p")

    def close(k: int) -> None:
        while len(stack) > k:
            for of in kinds(stack.pop().tag):
                of.pop()

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < len(text):
        m = _TOKEN.search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            stack[-1].children.append(text[at:end])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            k = innermost((tag,))
            if k and (tag in ARTICLE or tag in ("body", "html") or k >= innermost(("#article",))):
                close(k)
            continue
        if tag in BLOCK:
            closes, within = _CLOSES.get(tag, (set(), set()))
            k = innermost(("p", *closes))
            if k and k > innermost(within if closes else ("#block",)):
                close(k)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(text, at)
            at = ended.end() if ended else len(text)
        elif tag not in VOID and not attributes.endswith("/"):
            for of in kinds(tag):
                of.append(len(stack))
            stack.append(node)
    return root


def _hash(*parts: int | str) -> int:
    """64 bits, signed, of some numbers and texts."""
    h = xxhash.xxh64()
    for p in parts:
        h.update(p.to_bytes(8, "little", signed=True) if isinstance(p, int) else p.encode("utf-8", "surrogatepass") + b"\0")
    n = h.intdigest()
    return n - (1 << 64) if n >= 1 << 63 else n


@dataclass
class Seen:
    """What is known of one element: its hashes, its own words (those of dropped elements aside), and where it is."""

    slot: int
    parent: int  # the slot above
    inside: bool  # of an article
    shape: int = 0
    content: int = 0
    words: int = 0


def survey(root: Node) -> dict[int, Seen]:
    """``Seen`` of each element by its id(), children first; dropped elements and what they hold are left out."""
    out: dict[int, Seen] = {}
    # (element, slot above, inside of an article, ready)
    pending: list[tuple[Node, int, bool, bool]] = [(root, 0, False, False)]
    while pending:
        node, above, inside, ready = pending.pop()
        if not ready:
            slot = _hash(above, node.sign)
            out[id(node)] = Seen(slot, above, inside)
            pending.append((node, above, inside, True))
            within = inside or node.article
            pending.extend((c, slot, within, False) for c in node.children if isinstance(c, Node) and not _gone(c, within))
            continue
        seen = out.pop(id(node))
        shapes, contents = [seen.slot], [seen.slot]
        for c in node.children:
            if isinstance(c, str):
                said = " ".join(c.split())
                if said:
                    contents.append(said)
                    seen.words += said.count(" ") + 1
            elif id(c) in out:
                own = out[id(c)]
                seen.words += own.words
                contents.append(own.content)
                if shapes[-1] != own.shape:  # lists of any length have one shape
                    shapes.append(own.shape)
        seen.shape, seen.content = _hash(*shapes), _hash(*contents)
        out[id(node)] = seen
    return out


def _gone(node: Node, inside: bool) -> bool:
    """Dropped by its element or role; a header inside an article holds its title."""
    return node.dropped or (node.header and not inside)


def _body(root: Node, seen: dict[int, Seen]) -> int:
    """A page's body: the content of the smallest subtree with over half of the words of its articles (or of the page)."""
    tops, pending = [], [root]
    while pending:
        node = pending.pop()
        for c in reversed(node.children):
            if isinstance(c, Node) and id(c) in seen:
                (tops if c.article and seen[id(c)].words else pending).append(c)
    tops = tops or [root]
    half = sum(seen[id(n)].words for n in tops) / 2
    key, node = _hash(*[seen[id(n)].content for n in tops]), None
    heavy = lambda nodes: next((c for c in nodes if isinstance(c, Node) and id(c) in seen and seen[id(c)].words > half), None)
    while node := heavy(tops if node is None else node.children):
        key = seen[id(node)].content
    return key


SLOT, SHAPE, CONTENT = 0, 1, 2


def facts(html: str | None) -> tuple[int, list[tuple[int, int, int, int, int, bool]]]:
    """A page's body, and its distinct (kind, hash, slot above, words, times, container) that templates are told by."""
    root = parse(html)
    seen = survey(root)
    found: dict[tuple[int, int], list] = {}
    # a second walk in any order: elements are looked up by id
    pending: list[Node] = [root]
    while pending:
        node = pending.pop()
        s = seen[id(node)]
        pending.extend(c for c in node.children if isinstance(c, Node) and id(c) in seen)
        if not s.words and node is not root:
            continue
        container = node.tag in BLOCK and node.tag not in PARAGRAPH
        kinds = [(SLOT, s.slot, s.parent)] if container or node is root else []
        if _place(node):
            if not s.inside and node.tag not in HEADING:
                kinds.append((SHAPE, s.shape, s.slot))
            if not s.inside or container:
                kinds.append((CONTENT, s.content, s.slot))
        for kind, key, above in kinds:
            row = found.setdefault((kind, key), [above, 0, 0, container])
            row[1] += s.words
            row[2] += 1
    return _body(root, seen), [(kind, key, *row) for (kind, key), row in found.items()]


def _place(node: Node) -> bool:
    """Whether an element could be a template's: the article and what frames the page stay."""
    return not node.article and node.tag not in ("#root", "html", "body")


@dataclass
class Template:
    """What is known of a host: shapes and contents that recur, and the slots of its own text; or that it has too few pages."""

    shapes: frozenset[int] = frozenset()
    contents: frozenset[int] = frozenset()
    own: frozenset[int] = frozenset()
    few: bool = True


def main_text(html: str | None, template: Template | None = None) -> str:
    """The blocks of the page's own text joined by line breaks.

    A subtree with more than half of the page's words doesn't go for its words or
    its name, only for a shape that carries no text of its own on the host.
    """
    template = template or Template()
    root = parse(html)
    seen = survey(root)
    most = seen[id(root)].words / 2
    blocks, run = [], []

    def flush() -> None:
        words = "".join(run).split()
        run.clear()
        if words:
            blocks.append(" ".join(words))

    pending: list[tuple] = [(root, False)]
    while pending:
        what, own = pending.pop()
        if what is None:
            flush()
        elif isinstance(what, str):
            run.append(entities.unescape(what))
        elif id(what) in seen:
            s = seen[id(what)]
            if _place(what):
                recurs = s.words <= most and s.content in template.contents
                if template.few:
                    gone = what.named and s.words <= most
                elif s.inside or own:
                    gone = recurs and what.tag in BLOCK and what.tag not in PARAGRAPH
                else:
                    gone = recurs or (s.shape in template.shapes and what.tag not in HEADING)
                if gone:
                    continue
            if what.tag in ("br", "img"):
                run.append(" ")
            if what.tag in BLOCK:
                flush()
                pending.append((None, own))
            within = own or s.inside or what.article or s.slot in template.own
            pending.extend((c, within) for c in reversed(what.children))
    flush()
    return "\n".join(blocks)


_FACTS = "host string, body long, kind int, key long, above long, words long, page_words long, times long, container boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FACTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns_ = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds)], names=names)

    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0), batch.column(1)):
            body, found = facts(page.as_py())
            all_words = max((row[3] for row in found if row[0] == SLOT), default=0)
            rows.extend((host.as_py(), body, kind, key, above, words, all_words, times, container) for kind, key, above, words, times, container in found)
            if len(rows) >= ROWS_TOGETHER:
                yield made(rows)
                rows = []
        yield made(rows)


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, own_share: float = OWN_SHARE) -> DataFrame:
    """(host, n_pages, shapes, contents, own) of (host, html): one row for each host with at least ``least_pages`` distinct bodies.

    All counts are sums over distinct bodies, combined before they are shuffled, so
    a host of any size, or a page copied any number of times, is no task's whole work.
    """
    each = pages.mapInArrow(_rows, _FACTS).groupBy("host", "kind", "key", "above", "container", "body").agg(
        F.max("words").alias("words"), F.max("page_words").alias("page_words"), F.max("times").alias("times")
    )
    seen = checkpoint(
        each.groupBy("host", "kind", "key", "above", "container")
        .agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("page_words").alias("page_words"), F.sum("times").alias("times"))
        .where((F.col("kind") == SLOT) | (F.col("n") >= least_pages))
    )
    # from here on there are rows for elements of hosts, not of pages
    slots = seen.where(F.col("kind") == SLOT)
    hosts = slots.where((F.col("above") == 0) & (F.col("n") >= least_pages)).select("host", F.col("n").alias("n_pages"))
    heavy = slots.where(F.col("container") & (F.col("words") >= own_share * F.col("page_words")) & (2 * F.col("times") <= 3 * F.col("n")))
    own = heavy.join(heavy.select("host", F.col("above").alias("key")).distinct(), ["host", "key"], "left_anti").select("host", "key")
    light = seen.where((F.col("kind") == SHAPE) & (F.col("words") < own_share * F.col("page_words")))
    # what lies in an own slot is looked at by content alone, so shapes there do no harm
    keys = (
        own.select("host", F.lit("own").alias("what"), "key")
        .unionByName(light.select("host", F.lit("shapes").alias("what"), "key"))
        .unionByName(seen.where(F.col("kind") == CONTENT).select("host", F.lit("contents").alias("what"), "key"))
    )
    sets = keys.groupBy("host").agg(*[F.collect_set(F.when(F.col("what") == w, F.col("key"))).alias(w) for w in ("shapes", "contents", "own")])
    nothing = F.array().cast("array<bigint>")
    return hosts.join(sets, "host", "left").select("host", "n_pages", *[F.coalesce(w, nothing).alias(w) for w in ("shapes", "contents", "own")])


def _set(values: object) -> frozenset[int]:
    return frozenset(np.asarray(values).tolist())


def extract(
    pages: DataFrame, least_pages: int = LEAST_PAGES, own_share: float = OWN_SHARE, broadcast_hashes: int = BROADCAST_HASHES
) -> DataFrame:
    """Add text (empty if none) and n_chars to each page; further columns are kept, whatever their names, and those two replaced.

    Input: url, html, and any further columns.  A null or empty html is an empty
    page.  Pages without a url, or with one that names no host, are one host, the
    empty one.  Repeated rows, and all pages of a host with one body, count as one
    page for the templates; each gets its text.  Ties do not arise: counts are
    exact.  Pages of any length are read whole, in a time that grows with their length; a task holds one page's
    elements, and up to ``ROWS_TOGETHER`` rows of those before, at a time.  An empty table gives an empty table.

    Templates are broadcast, once for each worker, where they are measured to
    hold at most ``broadcast_hashes`` hashes; pages then stay where they are.  Beyond
    that, pages are dealt by host and a salt, and a host's template goes to each salt.
    """
    host_, template_, salt_ = spare(pages, "host", "template", "salt")
    host = F.lower(F.regexp_extract(F.coalesce(col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = checkpoint(templates(pages.select(host.alias("host"), "html"), least_pages, own_share))
    size = known.agg(F.coalesce(F.sum(F.size("shapes") + F.size("contents") + F.size("own") + 16), F.lit(0))).first()[0]
    if size <= broadcast_hashes:
        # bounded: as many hashes, once for each Python worker
        held = pages.sparkSession.sparkContext.broadcast({
            r["host"]: tuple(np.array(r[w], np.int64) for w in ("shapes", "contents", "own")) for r in known.toLocalIterator()
        })

        @F.pandas_udf("string")
        def text_of(html: pd.Series, hosts: pd.Series) -> pd.Series:
            made: dict[str, Template | None] = {}
            out = []
            for page, name in zip(html, hosts):
                if name not in made:
                    found = held.value.get(name)
                    made[name] = None if found is None else Template(*map(_set, found), False)
                out.append(main_text(page, made[name]))
            return pd.Series(out, dtype=object)

        both, text = pages, text_of(col("html"), host)
    else:
        packed = known.select(F.col("host").alias(host_), F.struct("shapes", "contents", "own").alias(template_))
        salted = pages.withColumn(host_, host).withColumn(salt_, F.pmod(F.xxhash64("html"), F.lit(HOST_SALTS)))
        every = packed.withColumn(salt_, F.explode(F.expr(f"sequence(0L, {HOST_SALTS - 1}L)")))
        both = salted.join(every, [host_, salt_], "left")

        @F.pandas_udf("string")
        def text_by(html: pd.Series, found: pd.DataFrame) -> pd.Series:
            made: dict[tuple, Template] = {}
            out = []
            for page, shapes, contents, own in zip(html, found["shapes"], found["contents"], found["own"]):
                if shapes is None:
                    out.append(main_text(page))
                    continue
                key = (shapes.tobytes(), contents.tobytes(), own.tobytes())
                if key not in made:
                    made[key] = Template(_set(shapes), _set(contents), _set(own), False)
                out.append(main_text(page, made[key]))
            return pd.Series(out, dtype=object)

        text = text_by(col("html"), F.col(template_))

    return both.select(*columns(pages, {"text", "n_chars"}), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
