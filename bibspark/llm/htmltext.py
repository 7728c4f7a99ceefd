"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Containers that can't hold the article (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts) leave an empty line. Lengths of text outside links are
summed over a sliding window of lines. A dive point is where a window holds no such text: a menu without a mark, or a
hole; a surge point is where the sums rise again, to the level that the page's own lines set. All between the first
surge and the last dive is kept, and text beside it that only a hole smaller than a window parts from it. At both ends
of that range, lines of bare containers (no paragraph, heading, list or table cell) go as long as their windows stay
below the level of a surge.

Marks are hints. A container is known by its element, or by a class, id or role that consists of listed words only:
"comment-list" is one, "share-price" or "with-sidebar" is none. It is cut only if it holds at most half of the
article's text (of the page's, where no article is marked); menus, footers and asides are cut in any case, adverts and
comments unless they hold the marked article. An article
or main element bounds the search if its lines hold more text than any stretch of lines outside it; a page's teaser
doesn't. Inside, dive points are found in the same way, but any text surges.

What may be lost: an unmarked page's text beside a hole of a window or more that never surges; a list of links only, of
three lines or more, unless text follows within the article; a heading outside the article element. What may be kept:
unmarked notices or comments that stand between or beside paragraphs.

Defined results: null and empty pages have an empty text. Unclosed elements end with their parent, unclosed pages
with the input; a page is read whole, whatever its length. White space within a block becomes one space; blocks are
joined by a line feed. Repeated rows and null ids or urls give a row each; other columns pass by.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups

#: Elements without text of the page, those that stand in a line, and those that make lines.
EMBEDDED = frozenset("button select option iframe object svg canvas".split())
UNSEEN = EMBEDDED | frozenset("template noscript head".split())
#: Elements that can't hold the article whatever they hold, and those that mostly don't.
BESIDE = frozenset("nav footer aside menu dialog".split())
FORMS = frozenset("header form".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements whose lines are text, however short, and those that end one of their own kind.
SOLID = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())
ENDS_OWN = frozenset("p li dd dt td th tr option".split())
#: Words of a class, id or role that mark a container as no part of the article.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
FOREIGN = frozenset("ad ads advert adverts advertisement advertising cookie cookies gdpr sponsor sponsored".split())
MARKS = (
    COMMENTS
    | FOREIGN
    | frozenset(
        "breadcrumb breadcrumbs footer masthead menu menubar modal nav navbar navigation newsletter "
        "pager pagination popup promo related share sharing sidebar social subscribe subscription complementary contentinfo consent".split()
    )
)
#: Words that do so outside an article; within it they stand for parts of the text as well.
OUTSIDE = frozenset("alert banner copyright disclaimer header login notice notices promoted promotion search signup skip toolbar widget".split())
#: Words that may stand beside one in a name.
AROUND = frozenset("area bar block bottom box container global group inner item items left link links list main outer page panel primary right secondary section site slot top unit user wrap wrapper form".split())
LEVEL = {"main": 1, "article": 2}
#: Lines in a window, and the least sum of lengths of a surge.
WIDTH, SURGE = 3, 40
#: The part of the page's highest window sum that a surge has to reach.
SHARE = 0.125

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")


def named(token: str, inside: bool) -> bool:
    """Whether all words of a class, id or role are listed, and one of them marks a container."""
    words = _PARTS.findall(token)
    marks = MARKS if inside else MARKS | OUTSIDE
    return any(w in marks for w in words) and all(w in marks or w in AROUND for w in words)


#: Kinds of containers: none, one that is cut if it holds less than half of the text, adverts and comments, which stay
#: only for a marked article, and one that is always cut.
NONE, MARKED, ADVERT, COMMENT, APART = range(5)


def container(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """The kind of an element, and whether it is hidden. Within an article, its own header is text."""
    kind = APART if tag in BESIDE else MARKED if tag in FORMS and not (tag == "header" and inside) else NONE
    hidden = False
    for m in _NAMES.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value))
        if kind < COMMENT and tag not in FORMS and name in ("class", "id", "role") and tag not in SOLID:
            for token in value.split():
                if named(token, inside):
                    words = COMMENTS.intersection(_PARTS.findall(token)), FOREIGN.intersection(_PARTS.findall(token))
                    kind = max(kind, COMMENT if words[0] else ADVERT if words[1] else MARKED)
    return kind, hidden


@dataclass
class Page:
    """Lines of a page in order: text, length outside links, whether the element is one of text, the level of the element
    around it (2 in an article, 1 in main), and its innermost container; and kind and parent of each container."""

    text: list[str] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)
    solid: list[bool] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    box: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=lambda: [NONE])
    parents: list[int] = field(default_factory=lambda: [-1])


def lines(page: str) -> Page:
    """The lines of a page."""
    out = Page()
    part: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements, with cut, box and level around them
    cut = box = level = at = 0
    link = solid = False
    plain = 0

    def end_line() -> None:
        nonlocal plain
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                out.text.append(text)
                out.plain.append(min(plain, len(text)))
                out.solid.append(solid)
                out.level.append(level)
                out.box.append(box)
        plain = 0

    def close(k: int) -> None:
        nonlocal cut, box, level, solid
        _, cut, box, level = stack[k]
        del stack[k:]
        solid = bool(stack) and stack[-1][0] in SOLID

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not cut:
            part.append(page[at:stop])
            if not link:
                plain += len(page[at:stop].strip())
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag == "a":
            link = not m[1] and "href" in m[3].lower()
        if m[1]:  # an end tag
            if tag == "br" and not cut:
                part.append(" ")
            if tag in VOID:
                continue
            if tag in INLINE or tag in EMBEDDED:
                for k in range(len(stack) - 1, -1, -1) if cut else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in EMBEDDED:
                        break
                continue
            if not cut:
                end_line()
            link = False  # a link that is not closed ends with its parent
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
            at = over.end() if over else n
            continue
        if tag in VOID:
            if tag == "br" and not cut:
                part.append(" ")
            elif tag == "hr" and not cut:
                end_line()
            continue
        empty = m[3].rstrip().endswith("/")
        if tag in INLINE or tag in EMBEDDED:
            if not empty and (tag in EMBEDDED or m[3] and container(tag, m[3], True)[1]):
                stack.append((tag, cut, box, level))
                cut += 1
            continue
        if not cut:
            end_line()
        if tag in ENDS_OWN and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
            link = False
        stack.append((tag, cut, box, level))
        solid = tag in SOLID
        if cut or tag in UNSEEN:
            cut += 1
            continue
        kind, hidden = container(tag, m[3], level == LEVEL["article"]) if tag not in ("html", "body") else (NONE, False)
        if kind or hidden:
            out.kinds.append(max(kind, MARKED))
            out.parents.append(box)
            box = len(out.kinds) - 1
        if tag in LEVEL and kind == NONE:
            level = max(level, LEVEL[tag])
    if not cut:
        end_line()
    return out


def without_containers(page: Page) -> tuple[list[str], list[int], list[bool], list[int]]:
    """Text, plain length, solidity and level of the lines that are left, and an empty line for each container cut out."""
    kinds, parents = page.kinds, page.parents
    comment, apart = [False], [False]  # of each container or one around it
    for k in range(1, len(kinds)):
        comment.append(kinds[k] == COMMENT or comment[parents[k]])
        apart.append(kinds[k] == APART or apart[parents[k]])
    rows = range(len(page.text))
    seen = [not apart[b] for b in page.box]
    inside = [bool(v) and s for v, s in zip(page.level, seen, strict=True)]
    if any(i and not comment[b] for i, b in zip(inside, page.box, strict=True)):  # articles in comments are comments
        inside = [i and not comment[b] for i, b in zip(inside, page.box, strict=True)]
    marked = any(inside)
    counted = inside if marked else seen
    held = [0] * len(kinds)
    for i in rows:
        held[page.box[i]] += len(page.text[i]) if counted[i] else 0
    for k in range(len(kinds) - 1, 0, -1):
        held[parents[k]] += held[k]
    cut_by = [0]  # the outermost container around that is cut, or 0
    for k in range(1, len(kinds)):
        around = cut_by[parents[k]]
        always = kinds[k] == APART or kinds[k] in (ADVERT, COMMENT) and not marked
        cut_by.append(around or (k if always or 2 * held[k] <= held[0] else 0))
    text, plain, solid, level, before = [], [], [], [], 0
    for i in rows:
        by = cut_by[page.box[i]]
        if by and by == before:
            continue
        before = by
        text.append("" if by else page.text[i])
        plain.append(0 if by else page.plain[i])
        solid.append(not by and page.solid[i])
        level.append(page.level[i])
    return text, plain, solid, level


def stretches(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines without an empty one."""
    out, start = [], None
    for i, n in enumerate([*lengths, 0]):
        if n and start is None:
            start = i
        elif not n and start is not None:
            out.append((start, i))
            start = None
    return out


def ends(sums: list[int], solid: list[bool], a: int, b: int, width: int, surge: int) -> tuple[int, int]:
    """Lines a to b without those at both ends whose windows stay below a surge and that are no text by their element."""

    def first(at: list[int]) -> int:
        for k in range(len(at)):
            window = at[k : k + width]
            if sum(sums[i] for i in window) >= surge:
                return next((k + j for j, i in enumerate(window) if solid[i] or sums[i] >= surge), k)
            if solid[at[k]]:
                return k
        return 0

    rows = list(range(a, b))
    return a + first(rows), b - first(rows[::-1])


def regions(lengths: list[int], plain: list[int] | None = None, solid: list[bool] | None = None, width: int = WIDTH, surge: int = SURGE, share: float = SHARE, marked: bool = False) -> list[tuple[int, int]]:
    """Ranges of lines from a surge point to a dive point. `width` lines of a stretch without text outside links (plain)
    are a dive; what is left of a stretch is a run. Runs with a window sum of the level (`surge`, or `share` of the page's
    highest sum if that is more) are text, and so are all lines between two of them, and a run with a sum of `surge` or a
    solid line beside text that fewer than `width` empty lines part from it. A page whose sums all stay below the level
    has one region, its largest stretch. In a marked article any run is text."""
    whole = stretches(lengths)
    sums = [n if plain is None or plain[i] else 0 for i, n in enumerate(lengths)]
    runs: list[tuple[int, int]] = []
    for a, b in whole:
        keep = [1] * (b - a)
        for i in range(a, b - width + 1):
            if not any(sums[i : i + width]):
                keep[i - a : i - a + width] = [0] * width
        runs += [(a + c, a + d) for c, d in stretches(keep)]
    if not runs:
        return whole if marked or not whole else [max(whole, key=lambda s: sum(lengths[s[0] : s[1]]))]
    peaks = [max(sum(sums[i : min(i + width, b)]) for i in range(a, b)) for a, b in runs]
    level = max(surge, max(peaks) * share)
    text = [k for k, n in enumerate(peaks) if marked or n >= level]
    if not text:
        return [max(runs, key=lambda s: (sum(sums[s[0] : s[1]]), sum(lengths[s[0] : s[1]])))]

    def beside(k: int) -> bool:
        """Whether only a small hole parts run k from run k + 1."""
        a, b = runs[k][1], runs[k + 1][0]
        return b - a < width and not any(lengths[a:b])

    def some(k: int) -> bool:
        return peaks[k] >= surge or solid is not None and any(s and n for s, n in zip(solid[runs[k][0] : runs[k][1]], sums[runs[k][0] : runs[k][1]], strict=True))

    first, last = text[0], text[-1]
    while first and some(first - 1) and beside(first - 1):
        first -= 1
    while last + 1 < len(runs) and some(last + 1) and beside(last):
        last += 1
    start, stop = runs[first][0], runs[last][1]
    if solid is not None and not marked:
        start, stop = ends(sums, solid, start, stop, width, surge)
    return [(start + a, start + b) for a, b in stretches(lengths[start:stop])]


def bounds(plain: list[int], lengths: list[int], level: list[int]) -> int:
    """The least level of the lines to search: that of articles or of main, if they hold more text than any stretch of lines
    outside, or 0."""
    for least in (2, 1):
        inside = sum(n for n, v in zip(lengths, level, strict=True) if v >= least)
        outside = [n if v < least else 0 for n, v in zip(lengths, level, strict=True)]
        if inside and inside >= max((sum(plain[a:b]) for a, b in stretches(outside)), default=0):
            return least
    return 0


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    text, plain, solid, level = without_containers(lines(page))
    lengths = list(map(len, text))
    least = bounds(plain, lengths, level)
    lengths = [n if v >= least else 0 for n, v in zip(lengths, level, strict=True)]
    return "\n".join(t for a, b in regions(lengths, plain, solid, marked=least > 0) for t in text[a:b])


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every row, repeated rows included. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in groups(batch.column(2), 4_000_000):
                part = batch.slice(a, b - a)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
