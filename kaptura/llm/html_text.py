"""Main text of web pages by paths that a host's pages agree on.

1. Every page's elements are scored as containers: characters of text in blocks directly below
   them or in their inline elements, less what stands in links, with a bonus for ``article`` and
   ``main``. The page votes for the generalised path (tags and classes, digits taken out) of its
   best container, with the container's score.
2. Votes are summed by host and path in Spark, partly within each task, and each host's path of
   most votes wins (of equal ones the first in order).
3. Every page is read again: its text is that of the elements at its host's winning path, or of
   its own best container if it has none there.

Scripts, styles, comments, form fields and the like count for nothing in either pass. Navigation,
forms, asides, headers and footers, and blocks that a whole word of their class, id or role marks, are
under suspicion only: what the page's largest ``article`` or ``main`` stands in is cleared, if that has a quarter of the text, and so is what
holds half of the page's text and few links, but for sections of comments; a paragraph, heading or item
is out by its mark only as an advert or a notice, or if links are half of it; an inline element only
as an advert, and never in preformatted text or code. Time and memory grow with a page's length only, whatever its depth and
however many of its tags are not closed: paths are hashes of the path above and one step more, and
open elements are found by their tag. A tag ends at the first ">" outside quotes; where none
follows, quotes don't count from there on, and without any ">" there is no more markup.

A null or empty page has an empty text; without any container the body's
text that isn't boilerplate is taken; unclosed and misnested tags are closed as they must be. Rows
with one page_id are read each on its own; a null url is a host of its own.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import stored

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_END_OR_QUOTE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_NEW_WORD = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript svg iframe object canvas math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("button select option textarea input dialog menu head title".split()) | RAW
#: Elements that are out unless the rest of the page clears them; of the second kind none is cleared by what it holds.
SUSPECT, ALWAYS_OUT = frozenset("nav header footer aside form".split()), frozenset("nav header footer aside".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd".split())
#: Words of a class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright dialog disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Marks that hold for inline elements and for paragraphs, too, and those of sections that nothing clears.
ADVERTS = frozenset("ad ads advert advertisement advertising adverts sponsor sponsored promo promoted promotion".split())
NOTICES = ADVERTS | frozenset("banner consent cookie cookies newsletter notice notices popup subscribe subscription".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Words that say where and what a part is, not what it is about; with other words a mark says nothing.
NEUTRAL = frozenset("area bar block body bottom box center col column container content global group holder inline inner item left list main middle mobile outer page panel primary right row secondary section side site slot small sticky the theme thread top unit wrap wrapper".split())
#: With one of these words beside it, "header" is the article's own.
OWN_HEADER = frozenset("article content entry post story".split())
#: What may stand in a page's head; anything else ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: Containers of the article itself are never boilerplate by their class.
ARTICLE = frozenset("article main body html".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end when another of the group begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEADING = re.compile(r"h[1-6]\Z")


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def marks(token: str) -> set[str]:
    """The marks that a class, id or role consists of, with neutral words; none if there are others."""
    words = set(_WORD.findall(_NEW_WORD.sub(" ", token).lower()))
    found = words & MARKS
    if "header" in found and not OWN_HEADER.isdisjoint(words):
        found.discard("header")
    return found if found and words <= MARKS | NEUTRAL else set()


def marked(attributes: str) -> tuple[str, set[str]]:
    """The classes in general form, and the marks among the class, the id and the role."""
    classes, found = "", set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "class":
            classes = ".".join(sorted(_DIGITS.sub("#", x) for x in value.lower().split()))
        for token in value.split():
            found |= marks(token)
    return classes, found


def top(worth: dict[int, float]) -> int:
    """The element of most worth, of equal ones the first."""
    return max(worth, key=lambda e: (worth[e], -e))


class Stack:
    """Open elements, and where the last of each tag and the last block stand."""

    def __init__(self):
        self.open: list[tuple[int, str, bool]] = [(-1, "", False)]  # element, tag, boilerplate
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = [0]

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def push(self, element: int, tag: str, junk: bool) -> None:
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((element, tag, junk))

    def close(self, to: int) -> None:
        while to and len(self.open) > to:
            _, tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()


class Page:
    """Blocks of text of a page, each with the elements that hold it."""

    def __init__(self, html: str):
        self.paths: list[int] = []  # hash of each element's generalised path
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.suspects: dict[int, set[str]] = {}  # elements under suspicion, and their marks
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        if self.suspects:
            self._clear()

    @staticmethod
    def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
        """start, end, closing, tag, attributes of each tag; comments and the like have no tag.

        Whoever reads may send a place further on to go on from.
        """
        at, quotes, last = 0, True, html.rfind(">")
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
                yield start, at, False, "", ""
                continue
            if html[start + 1 : start + 2] in ("!", "?"):
                end = html.find(">", start)
                at = end + 1 if end >= 0 else len(html)
                yield start, at, False, "", ""
                continue
            name = _NAME.match(html, start + 1) if start < last else None
            if not name:
                at = start + 1
                continue
            end = -1
            if quotes:
                place = name.end()
                while m := _END_OR_QUOTE.search(html, place):
                    if m.group() == ">":
                        end = m.start()
                        break
                    closed = html.find(m.group(), m.end())
                    if closed < 0:
                        break
                    place = closed + 1
                quotes = end >= 0
            if end < 0:
                end = html.find(">", name.end())
            if end < 0:
                at = start + 1
                continue
            at = (yield start, end + 1, bool(name.group(1)), name.group(2).lower(), html[name.end() : end]) or end + 1

    def _read(self, html: str) -> None:
        stack = Stack()
        block: list[str] = []
        links = at = 0

        def end_block():
            nonlocal links
            if block:
                text = " ".join("".join(block).split())
                if text:
                    self.blocks.append((stack.open[stack.blocks[-1]][0], text, min(links, len(text))))
                block.clear()
            links = 0

        def words(text: str):
            nonlocal links
            if text and not stack.open[-1][2]:
                text = unescape(text)
                block.append(text)
                if stack.places["a"]:
                    links += len(text)

        tags = self._tags(html)
        found = next(tags, None)
        while found:
            start, end, closing, tag, attributes = found
            words(html[at:start])
            at = end
            if tag in RAW and not closing:
                close = _raw_end(tag).search(html, at)
                at = close.end() if close else len(html)
            elif tag:
                self._tag(stack, tag, closing, attributes, end_block, block)
            try:
                found = tags.send(at) if tag else next(tags)
            except StopIteration:
                break
        words(html[at:])
        end_block()

    def _tag(self, stack: Stack, tag: str, closing: bool, attributes: str, end_block: Callable[[], None], block: list[str]) -> None:
        inline = tag in INLINE
        if closing:
            if not inline:
                end_block()
            found = stack.last(tag)
            # An inline end tag doesn't close blocks around it.
            if not inline or stack.blocks[-1] <= found:
                stack.close(found)
            return
        if tag not in HEAD:
            stack.close(stack.places["head"][0] if stack.places["head"] else 0)
        if tag in VOID:
            if tag in ("br", "hr"):
                block.append(" ")
            if tag == "hr":
                end_block()
            return
        if not inline:
            end_block()
            if tag in CLOSES_P:
                stack.close(stack.last("p"))
            if tag in SIBLINGS:
                other = stack.last(*SIBLINGS[tag])
                if other > stack.last(*STOPS[tag]):
                    stack.close(other)
        parent, _, outer = stack.open[-1]
        classes, found = marked(attributes) if attributes else ("", set())
        if inline:
            advert = not ADVERTS.isdisjoint(found) and not (stack.places["pre"] or stack.places["code"])
            stack.push(parent, tag, outer or advert)
            return
        junk = outer or tag in BOILERPLATE
        inside_article = tag == "header" and bool(stack.places["article"])
        if tag not in ARTICLE and (found or tag in SUSPECT and not inside_article):
            self.suspects[len(self.paths)] = found
        step = f"{self.paths[parent] if parent >= 0 else 0}/{tag}" + ("." + classes if classes else "")
        self.paths.append(xxhash.xxh64_intdigest(step) >> 1)
        self.parents.append(parent)
        self.tags.append(tag)
        stack.push(len(self.paths) - 1, tag, junk)

    def _clear(self) -> None:
        """Takes the blocks out of suspects that nothing clears."""
        n = len(self.paths)
        size, links = [0] * n, [0] * n
        for e, text, linked in self.blocks:
            if e >= 0:
                size[e] += len(text)
                links[e] += linked
        for e in range(n - 1, -1, -1):
            if (parent := self.parents[e]) >= 0:
                size[parent] += size[e]
                links[parent] += links[e]
        whole = sum(len(text) for _, text, _ in self.blocks)
        cleared = set()
        main = max((e for e in range(n) if self.tags[e] in ("article", "main") and size[e]), key=lambda e: (size[e], -e), default=-1)
        while main >= 0 and 4 * size[main] > whole:
            cleared.add(main)
            main = self.parents[main]
        out = [False] * n
        for e in range(n):
            found = self.suspects.get(e)
            out[e] = self.parents[e] >= 0 and out[self.parents[e]]
            if found is None or out[e]:
                continue
            few_links = 2 * links[e] < size[e]
            if self.tags[e] in LEAVES:
                out[e] = not (NOTICES.isdisjoint(found) and few_links)
            elif self.tags[e] in ALWAYS_OUT or not COMMENTS.isdisjoint(found):
                out[e] = True
            else:
                out[e] = e not in cleared and not (few_links and 2 * size[e] > whole)
        self.blocks = [b for b in self.blocks if b[0] < 0 or not out[b[0]]]

    def scores(self) -> dict[int, float]:
        """A block's worth goes to its element's parent, and half of it to the one above."""
        worth: dict[int, float] = defaultdict(float)
        for element, text, links in self.blocks:
            value = len(text) - 2.0 * links
            if element < 0:
                continue
            leaf = self.tags[element] == "p" or HEADING.match(self.tags[element]) or self.tags[element] in ("li", "blockquote", "pre", "td", "dd")
            near = self.parents[element] if leaf and self.parents[element] >= 0 else element
            worth[near] += value
            above = self.parents[near]
            if above >= 0:
                worth[above] += value / 2
        for e in worth:
            if self.tags[e] in ("article", "main"):
                worth[e] = worth[e] * 2 + 1
        return worth

    def best(self) -> int | None:
        worth = self.scores()
        return top(worth) if worth else None

    def below(self, roots: set[int]) -> str:
        inside: dict[int, bool] = {-1: False}
        for e, parent in enumerate(self.parents):
            inside[e] = e in roots or inside[parent]
        return " ".join(text for e, text, _ in self.blocks if inside[e])

    def text(self, path: int | None) -> str:
        """Text at ``path``, else of the best container, else of the whole page."""
        roots = {e for e, p in enumerate(self.paths) if p == path} if path is not None else set()
        if roots:
            found = self.below(roots)
            if found:
                return found
        best = self.best()
        if best is None:
            return " ".join(t for _, t, _ in self.blocks)
        return self.below({best})


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path of most votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int], float] = defaultdict(float)
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html) if html else None
                worth = page.scores() if page else {}
                if worth:
                    best = top(worth)
                    votes[host, page.paths[best]] += worth[best]
            hosts, paths = zip(*votes, strict=True) if votes else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array([round(v * 2) for v in votes.values()], pa.int64())], names=["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path long, votes long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct((-F.col("votes")).alias("v"), "path")).alias("path"))


def extract_text(pages: DataFrame, few_hosts: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    winning = stored(host_paths(pages), "host-paths").select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    small = winning.limit(few_hosts + 1).count() <= few_hosts
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_of"))
    joined = rows.join(F.broadcast(winning) if small else winning, F.col("_of") == F.col("_host"), "left").select("page_id", "url", "html", "_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(html).text(path) if html else "" for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return joined.mapInArrow(read, schema)
