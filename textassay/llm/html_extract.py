"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text under one block element, each with its
root-to-leaf tag path (containers are told apart by their class, as they are in the
page's own style sheet; no name has a meaning here). Of each path the length of its
text outside links and its punctuation marks are summed. The two ratios to the number
of blocks are fused (geometric mean) and smoothed over the blocks in page order, and a
path's score is the mean of its blocks times its share of the page's text. Paths under
article or main, elements made for content, count ``CONTENT`` or ``CONTENTS`` times.

Paths that score at least ``THRESHOLD`` of the best path are selected. The content node
is the lowest element that holds all their blocks, or the article or main around it;
headings, lists, quotations, links and short paragraphs in it come along; bare text in a
box of its own comes along if its ratio is like that of the content.

Elements take no part if their name says that they are not content (nav, footer, aside,
script, ...), if they are hidden, or if they are forms, page headers, articles inside an
article (comments, by the standard) or have a role for such parts; but not if they hold
most of the text of articles or, for the latter, much of the page's prose.

Every step is linear in the page's length, whatever the nesting.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Element names of the HTML standard, by role in this operator.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
EMBEDDED = frozenset("svg math object canvas video audio".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote address figure figcaption table thead tbody tfoot tr td th caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_CONTENT = frozenset("nav footer aside menu dialog button select head".split())
SELDOM_CONTENT = frozenset("form fieldset".split())
SELDOM_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table menu select section article main".split())

#: Levels that an end tag which is left out reaches up.
REACH = 32
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_GAP = re.compile(r"[\s/]*")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_MARKS = re.compile(r"[.,;:!?、。，！？…]")

#: Share of the best path's score that a path needs.
THRESHOLD = 0.4
#: Weights of the previous, own and next block in smoothing.
KERNEL = (0.25, 0.5, 0.25)
#: What a score counts under the page's only article or main, and under any of several.
CONTENT, CONTENTS = 64.0, 8.0
#: Share of the content's mean ratio from which bare text in a box inside the content is content.
LIKE = 0.75
#: Share of the page's prose from which a form or header is the page.
MUCH = 1 / 3


class Page:
    """Elements in the order they open (a parent before its children) and blocks in page order."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.path, self.kind = ["#root"], [-1], [0], [0]
        self.blocks: list[tuple[str, int, int, int]] = []  # text, element, its characters outside links, its marks there
        self._paths: dict[tuple[int, str], int] = {}
        self._open: list[_Open] = [_Open(0, "#root", False, False)]
        self._count: dict[str, int] = {}
        self._parts: list[tuple[str, bool]] = []
        self._read(page)
        self._flush()

    def _text(self, chunk: str) -> None:
        if chunk:
            top = self._open[-1]
            self._parts.append((_html.unescape(chunk) if "&" in chunk else chunk, top.linked or top.links > 0))

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(c for c, _ in self._parts).split())
            if text:
                plain = text if not any(x for _, x in self._parts) else " ".join("".join(" " if x else c for c, x in self._parts).split())
                self.blocks.append((text, self._open[-1].number, len(plain), len(_MARKS.findall(plain))))
            self._parts.clear()

    def _close(self, depth: int) -> None:
        self._flush()
        for e in self._open[depth:]:
            self._count[e.tag] -= 1
        del self._open[depth:]

    def _start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if self._open[-1].tag == "head":
            self._close(len(self._open) - 1)
        top = self._open[-1]
        if tag in INLINE:
            if tag == "a":
                self._end(tag)
            top.inline.append(tag)
            top.held[tag] = top.held.get(tag, 0) + 1
            top.links += tag == "a"
            return
        if top.tag == "p":
            self._close(len(self._open) - 1)
        ends = CLOSES.get(tag, ())
        if any(self._count.get(t) for t in ends):
            for depth in range(len(self._open) - 1, max(0, len(self._open) - 1 - REACH), -1):
                if self._open[depth].tag in ends:
                    self._close(depth)
                    break
                if self._open[depth].tag in SCOPES:
                    break
        self._flush()
        top, number = self._open[-1], len(self.tag)
        named = next((v for k, v in attributes if k == "class"), "") if tag not in TEXT_BLOCKS else ""
        label = (self.path[top.number], f"{tag}.{named}" if named else tag)
        self.tag.append(tag)
        self.parent.append(top.number)
        self.path.append(self._paths.setdefault(label, len(self._paths) + 1))
        self.kind.append(_kind(tag, attributes, top.content))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._open.append(_Open(number, tag, top.linked or top.links > 0, top.content or tag in ("article", "main")))

    def _end(self, tag: str) -> None:
        top = self._open[-1]
        if tag in INLINE:
            while top.held.get(tag):
                last = top.inline.pop()
                top.held[last] -= 1
                top.links -= last == "a"
                if last == tag:
                    break
        elif self._count.get(tag):
            depth = len(self._open) - 1
            while self._open[depth].tag != tag:
                depth -= 1
            self._close(depth)

    def _read(self, page: str) -> None:
        at, last, endless = 0, page.rfind(">"), set()
        while True:
            lt = page.find("<", at)
            comment = lt >= 0 and page.startswith("<!--", lt)
            if lt < 0 or (lt > last and not comment):
                self._text(page[at:])
                return
            self._text(page[at:lt])
            follows = page[lt + 1]
            if comment:
                short = 1 if page.startswith(">", lt + 4) else 2 if page.startswith("->", lt + 4) else 0
                end = page.find("-->", lt + 4)
                at = lt + 4 + short if short else len(page) if end < 0 else end + 3
            elif follows in "!?" or (follows == "/" and not _NAME.match(page, lt + 2)):
                at = page.find(">", lt) + 1
            elif follows == "/":
                self._end(_NAME.match(page, lt + 2)[0].lower())
                at = page.find(">", lt) + 1
            elif name := _NAME.match(page, lt + 1):
                pos, attributes = name.end(), []
                while m := _ATTR.match(page, pos):
                    attributes.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
                    pos = m.end()
                pos = _GAP.match(page, pos).end()
                if pos >= len(page):  # a tag without an end is text
                    self._text(page[lt:])
                    return
                at, tag = pos + 1, name[0].lower()
                if tag == "br":
                    self._parts.append(("\n", False))
                elif tag in VOID:
                    if tag not in INLINE:
                        self._flush()
                elif tag in RAW or tag in EMBEDDED:
                    if page[pos - 1] != "/" and tag not in endless:
                        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                        if end:
                            at = end.end()
                        elif tag in RAW:
                            return
                        else:
                            endless.add(tag)
                else:
                    self._start(tag, attributes)
            else:
                self._text("<")
                at = lt + 1


class _Open:
    """An open block element, and the inline elements that are open in it."""

    __slots__ = ("content", "held", "inline", "linked", "links", "number", "tag")

    def __init__(self, number: int, tag: str, linked: bool, content: bool) -> None:
        self.number, self.tag, self.linked, self.content = number, tag, linked, content
        self.inline: list[str] = []
        self.held: dict[str, int] = {}
        self.links = 0


def _kind(tag: str, attributes: list[tuple[str, str]], content: bool) -> int:
    """3 for hidden elements, 2 for those that are never content, 1 for those that seldom are, or else 0."""
    kind = 2 if tag in NEVER_CONTENT else int(tag in SELDOM_CONTENT or (tag == "header" and not content) or (tag == "article" and content))
    for key, value in attributes:
        if (key == "hidden" and tag not in ("html", "body")) or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            return 3
        if key == "role" and value.lower() in SELDOM_ROLES and tag not in ("html", "body", "main", "article"):
            kind = max(kind, 1)
    return kind


def _summed(page: Page, of: list[int]) -> list[int]:
    """What an element and all below it hold, from what each holds itself."""
    out = list(of)
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e]
    return out


def _content_blocks(page: Page) -> list[int]:
    """Numbers of the blocks that do not stand in furniture."""
    n = len(page.tag)
    text, prose = [0] * n, [0] * n
    for t, e, _, _ in page.blocks:
        text[e] += len(t)
        prose[e] += len(t) if page.tag[e] in TEXT_BLOCKS else 0
    hidden = [False] * n
    for e in range(1, n):
        hidden[e] = hidden[page.parent[e]] or page.kind[e] == 3
    visible = lambda held: _summed(page, [0 if hidden[e] else held[e] for e in range(n)])
    mass, said = visible(text), visible(prose)
    articles = [0] * n  # text of the articles below an element
    for e in range(n - 1, 0, -1):
        articles[page.parent[e]] += mass[e] if page.tag[e] in ("article", "main") else articles[e]
    bad, free = [False] * n, [False] * n
    for e in range(1, n):
        free[e] = free[page.parent[e]] or page.kind[e] >= 2
    page_prose = sum(prose[e] for e in range(n) if not free[e])
    for e in range(1, n):
        holds = 2 * articles[e] > articles[0] > 0
        is_page = page.kind[e] == 1 and said[e] > MUCH * page_prose
        bad[e] = bad[page.parent[e]] or page.kind[e] == 3 or (page.kind[e] > 0 and not holds and not is_page)
    return [k for k, b in enumerate(page.blocks) if not bad[b[1]]]


def path_scores(page: Page, blocks: list[int]) -> dict[int, float]:
    """Score of each path of these blocks."""
    sums: dict[int, list[int]] = {}
    for k in blocks:
        _, e, chars, marks = page.blocks[k]
        s = sums.setdefault(page.path[e], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + 1, s[1] + chars, s[2] + marks
    fused = {p: ((chars / n) * (1 + marks / n)) ** 0.5 for p, (n, chars, marks) in sums.items()}
    own = [fused[page.path[page.blocks[k][1]]] for k in blocks]
    smooth: dict[int, float] = {}
    for i, k in enumerate(blocks):
        near = [(w, own[i + d]) for d, w in zip((-1, 0, 1), KERNEL, strict=True) if 0 <= i + d < len(own)]
        p = page.path[page.blocks[k][1]]
        smooth[p] = smooth.get(p, 0.0) + sum(w * x for w, x in near) / sum(w for w, _ in near)
    every = sum(s[1] for s in sums.values())
    inside = _nearest(page, ("article", "main"))
    under = {page.path[page.blocks[k][1]] for k in blocks if inside[page.blocks[k][1]] >= 0}
    outermost = list(inside)
    for e in range(1, len(outermost)):
        if outermost[page.parent[e]] >= 0:
            outermost[e] = outermost[page.parent[e]]
    weight = CONTENT if len({outermost[page.blocks[k][1]] for k in blocks} - {-1}) == 1 else CONTENTS
    return {p: smooth[p] / n * (chars / every) * (weight if p in under else 1.0) if chars else 0.0 for p, (n, chars, _) in sums.items()}


def _nearest(page: Page, tags: tuple[str, ...]) -> list[int]:
    """The nearest element of these names around or at each element, or -1."""
    out = [-1] * len(page.tag)
    for e in range(1, len(out)):
        out[e] = e if page.tag[e] in tags else out[page.parent[e]]
    return out


def _kept(page: Page, blocks: list[int], score: dict[int, float]) -> list[int]:
    """The selected blocks, and those that come along."""
    best = max(score.values(), default=0.0)
    article, main = _nearest(page, ("article",)), _nearest(page, ("main",))
    around = lambda e: article[e] if article[e] >= 0 else main[e]
    if best <= 0:  # nothing but links: those of an article
        return [k for k in blocks if around(page.blocks[k][1]) >= 0]
    picked = {k for k in blocks if score[page.path[page.blocks[k][1]]] >= THRESHOLD * best}
    n = len(page.tag)
    held = [0] * n
    for k in picked:
        held[page.blocks[k][1]] += 1
    held = _summed(page, held)
    lowest = max(e for e in range(n) if held[e] == len(picked))
    while page.tag[lowest] in TEXT_BLOCKS:
        lowest = page.parent[lowest]
    nodes = {around(lowest)} if around(lowest) >= 0 else {around(page.blocks[k][1]) for k in picked} - {-1}
    whole = page.tag[lowest] not in ("#root", "html", "body")
    inside, holder = [False] * n, [0] * n  # holder: the nearest element that is not one of text
    for e in range(1, n):
        inside[e] = inside[page.parent[e]] or e in nodes or (not nodes and whole and e == lowest)
        holder[e] = holder[page.parent[e]] if page.tag[e] in TEXT_BLOCKS else e
    mean = sum(_ratio(page.blocks[k]) for k in picked) / len(picked)
    in_text = [False] * n
    for e in range(1, n):
        in_text[e] = in_text[page.parent[e]] or page.tag[e] in TEXT_BLOCKS
    written = 2 * sum(len(page.blocks[k][0]) for k in picked if in_text[page.blocks[k][1]]) >= sum(len(page.blocks[k][0]) for k in picked)

    def along(k: int) -> bool:
        """Text elements that stand straight in an element around the content: a title or opening, or all if it has no element of its own."""
        e = page.blocks[k][1]
        if nodes or page.tag[e] not in TEXT_BLOCKS:
            return False
        if whole:
            return held[holder[e]] == len(picked) and (page.tag[e] in HEADINGS or _ratio(page.blocks[k]) >= THRESHOLD * mean)
        return held[holder[e]] > 0

    def box(k: int) -> bool:
        """Bare text in a container of its own, where content stands in text elements, and shorter or with fewer marks: an advert."""
        e = page.blocks[k][1]
        return written and not in_text[e] and held[e] == 0 and _ratio(page.blocks[k]) < LIKE * mean

    return [k for k in blocks if k in picked or (inside[page.blocks[k][1]] and not box(k)) or along(k)]


def _ratio(block: tuple[str, int, int, int]) -> float:
    return (block[2] * (1 + block[3])) ** 0.5


def main_text(page: str | None) -> str:
    """The page's content blocks, joined in page order by one space."""
    if not page:
        return ""
    read = Page(page)
    blocks = _content_blocks(read)
    return " ".join(read.blocks[k][0] for k in _kept(read, blocks, path_scores(read, blocks))) if blocks else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty if none) and ``n_chars`` in place of any columns of these names.

    A null or empty page has the text ``''`` and 0 characters. Repeated rows each
    keep their own result; other columns pass through unseen.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    out = pages.withColumn("text", run.asNondeterministic()(F.coalesce(F.col(html), F.lit(""))))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
