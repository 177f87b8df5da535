"""Main text of web pages: a tolerant tokeniser of markup, blocks of text with their density of words and links, and the run of blocks that is worth most.

The tokeniser goes over a page once. What isn't a tag is text; unclosed quotes, tags, comments and elements end where they can; scripts and styles are skipped. Tags that
lay out blocks part the text. A block is worth its words outside links, less twice those in links, less ``FIXED``; blocks in navigation, footers, asides
and forms, or in elements whose class or id says so, are worth nothing but a loss, and those in an article element get ``BONUS``. The main text is the consecutive run of blocks
of the greatest total (the earliest of equal ones), without its boilerplate blocks.

Defined results: null, empty and textless pages have an empty text; a page whose every block is worth less than nothing keeps its longest block that isn't
boilerplate, if any.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.workers import ship

FIXED = 6.0
BONUS = 8.0
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe svg math".split())
ZONES = frozenset("nav footer aside form menu select button dialog".split())
GOOD = frozenset("article main".split())
HINT = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|menu|nav\w*|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|widget)(?=$|[\s_-])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): text (value: decoded), open and close (name in lower case, value: attributes as written)."""
    at, n = 0, len(page)
    held: list[str] = []
    lost: set[str] = set()  # quotes that don't occur any more

    def text():
        out = html.unescape("".join(held))
        held.clear()
        return "text", "", out

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            held.append(page[at:])
            break
        held.append(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", mark):
            end = page.find("]]>", mark + 9)
            held.append(html.escape(page[mark + 9: n if end < 0 else end], quote=False))
            at = n if end < 0 else end + 3
            continue
        if page[mark + 1: mark + 2] in ("!", "?"):
            end = page.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", mark)
        name = _NAME.match(page, mark + 1 + closing)
        if not name:
            if closing and mark + 2 < n:  # not a tag: browsers drop it as a comment
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            else:
                held.append("<")
                at = mark + 1
            continue
        end = name.end()
        while True:  # to the > that is in no quotes
            stop = _STOP.search(page, end)
            if not stop:
                end = n
                break
            end = stop.end()
            if stop[0] == ">":
                break
            if stop[0] not in lost:
                other = page.find(stop[0], end)
                if other < 0:
                    lost.add(stop[0])
                else:
                    end = other + 1
        tag = name[0].lower()
        if held and any(held):
            yield text()
        held.clear()
        yield ("close" if closing else "open"), tag, page[name.end(): end - 1 if page[end - 1: end] == ">" else end]
        at = end
        if not closing and tag in RAW:
            over = re.compile(rf"(?i)</{tag}(?=[\s/>]|$)").search(page, at)
            at = over.start() if over else n
    if any(held):
        yield text()


@dataclass
class Block:
    """Words of a block, how many are in links, and whether boilerplate or an article surrounds it."""

    text: str
    n_words: int
    n_linked: int
    boilerplate: bool
    inside: bool

    @property
    def worth(self) -> float:
        if self.boilerplate:
            return -FIXED - self.n_words / 4
        return self.n_words - 3.0 * self.n_linked - FIXED + BONUS * self.inside


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    title: str = ""
    parts: list[tuple[str, bool]] = field(default_factory=list)
    stack: list[tuple[str, bool, bool]] = field(default_factory=list)  # name, boilerplate, article
    links: int = 0

    def flush(self) -> None:
        whole = "".join(t for t, _ in self.parts)
        words = whole.split()
        if words:
            linked = sum(len(t.split()) for t, link in self.parts if link)
            if any(name == "title" for name, _, _ in self.stack):
                self.title = self.title or " ".join(words)
            elif not any(name == "head" for name, _, _ in self.stack):
                self.blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), any(b for _, b, _ in self.stack), any(g for _, _, g in self.stack)))
        self.parts = []

    def take(self, kind: str, name: str, value: str) -> None:
        if kind == "text":
            self.parts.append((value, self.links > 0))
        elif name == "a":
            self.links = int(kind == "open")  # links don't nest
        elif name in ("br", "wbr", "img", "input"):
            self.parts.append((" ", False))
        elif name in BLOCKS:
            self.flush()
            self.links = 0
            if kind == "open":
                if name == "body":
                    self.stack = [x for x in self.stack if x[0] not in ("head", "title")]
                if name not in ("p", "hr", "li", "td", "th", "tr", "option", "dd", "dt"):
                    said = " ".join("".join(x) for x in _ATTRIBUTE.findall(value))
                    self.stack.append((name, name in ZONES or bool(HINT.search(said)), name in GOOD))
            else:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == name:
                        del self.stack[i:]
                        break


def blocks(page: str) -> tuple[str, list[Block]]:
    """(title, blocks of text) of a page."""
    reader = _Reader()
    for token in tokens(page):
        reader.take(*token)
    reader.flush()
    return reader.title, reader.blocks


def best_run(worth: list[float]) -> tuple[int, int]:
    """The consecutive run of the greatest total above 0, as (first, end); the earliest of equal ones."""
    top, run, total, first = 0.0, (0, 0), 0.0, 0
    for i, w in enumerate(worth):
        if total <= 0:
            total, first = 0.0, i
        total += w
        if total > top:
            top, run = total, (first, i + 1)
    return run


def main_text(page: str | None) -> tuple[str, int, int, str]:
    """(title, blocks, kept blocks, main text with a line a block)."""
    title, found = blocks(page or "")
    a, b = best_run([x.worth for x in found])
    kept = [x for x in found[a:b] if not x.boilerplate]
    if not kept:
        kept = sorted((x for x in found if not x.boilerplate), key=lambda x: -x.n_words)[:1]
    return title, len(found), len(kept), "\n".join(x.text for x in kept)


def page_texts(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, title, n_blocks, n_kept and text of every page. Row by row, no shuffle."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = list(zip(*(main_text(p) for p in batch.column(1).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(got, (pa.string(), pa.int32(), pa.int32(), pa.string())))], [key, "title", "n_blocks", "n_kept", "text"])

    return pages.select(key, F.col(source).cast("string")).mapInArrow(run, f"`{key}` {kind}, title string, n_blocks int, n_kept int, text string")
