"""Main text of web pages by line-block distribution: lines of text between the points where text surges and dives."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_arrow

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title|xmp"
MEDIA = frozenset("svg object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend summary".split())
HOLDERS = frozenset("ul ol dl table select menu".split())
SCOPES = HOLDERS | frozenset(ENDS_ITSELF)
#: Elements that hold no part of an article, and those of them that may still hold it whole.
DROPPED = frozenset("aside button dialog fieldset footer form head input label menu nav search select".split())
WRAPS = frozenset("dialog fieldset form header label search".split())
# Elements whose names are not looked at, as they are a text's own parts.
OWN = frozenset("html body p h1 h2 h3 h4 h5 h6 pre blockquote b strong i em u code q cite mark small sub sup td th tr tbody thead".split())
# Words of class, id and role names that mark what is not the article.
NOT_ARTICLE = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot advertorial banner bio breadcrumb breadcrumbs byline cc comment comments commentlist consent contentinfo cookie cookies copyright disqus feedback footer footnav form gdpr header hidden login masthead menu menubar modal more nav navbar navigation newsletter notice notices notification overlay pager paging pagination paywall popup promo promoted promotion recommend recommended related replies reply respond responses search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud tags toolbar tooltip widget widgets".split())
# Those of them that may stand on an element that holds the article, and words beside them that only say where or what kind of box it is.
LAYOUT = frozenset("form header hidden login modal overlay paywall popup search subscription widget widgets".split())
BESIDE = frozenset("area bar block bottom box col column container cont fixed form global holder inner item items left level link links list main major minor module outer page panel post posts primary reader readers right rail row secondary section site slot story stories thread top unit user users view window wrap wrapper".split())

#: Attributes of a tag: a quote counts only behind an equals sign, and only where its end is near or no tag begins before it; END ends a tag that the page leaves open.
REST, END = r"(?:[^>\"'=]++|=\s*+(?:\"(?:[^\"]{0,9999}+|[^\"<]*+)\"|'(?:[^']{0,9999}+|[^'<]*+)')?+|[\"'])*+", ">"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>]){REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<[!?][^>]*+>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{REST})>",
    re.S | re.I,
)
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"(?<![\w-])(?:hidden(?=[\s/>]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
# Headings of what readers wrote, and dates and times as they stand beside a name.
READERS = re.compile(
    r"\W*(?:\d[\d.,]*\s+(?:responses?|replies|thoughts)|(?:\d[\d.,]*\s+)?(?:(?:reader|user|all|latest|leave a|post a|add a|write a)\s+)?(?:comments?|reply|kommentare?|commentaires?|comentarios?))\b(?:\s+on\b.*|[\s:()\d]*)",
    re.I,
)
DATED = re.compile(
    r"\d{4}-\d\d?-\d\d?|\b\d\d?[./]\d\d?[./]\d{2,4}|\b\d\d?:\d\d\b|\b\d+\s+\w+\s+ago\b|\b(?:vor|hace|il y a)\s+\d+|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,4}", re.I
)
#: Characters of a line that gives a reader's name or a date.
BRIEF = 80
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Lines in a window, text that a window needs to surge, and text at which it has dived.
WINDOW, SURGE, GROUND = 3, 80, 20


def _named(rest: str) -> str:
    """The word for which a tag's class, id and role names mark it as no article, else nothing.

    A name counts whole: all its words must be such words or only say where the box stands, so
    `site-header` and `comment-list` count, `article-header`, `with-sidebar` and `search-history` do not.
    """
    if UNSEEN.search(rest):
        return "unseen"
    for m in NAMED.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORDS.findall(name)]
            marks = [w for w in words if w in NOT_ARTICLE]
            if marks and all(w in NOT_ARTICLE or w in BESIDE for w in words):
                return marks[0]
    return ""


@dataclass
class Box:
    """An element that may hold no part of the article: what holds it, whether it may wrap the article, and what it holds."""

    above: int
    wraps: bool
    article: bool
    text: int = 0
    marked: bool = False


@dataclass
class Line:
    """A block of text, or an empty line: its characters outside links, the article it is in (0: none) and its innermost box."""

    text: str
    own: int = 0
    article: int = 0
    box: int = -1


@dataclass
class Element:
    """A block element: the one that holds it, its name and class, the places of its first line and of the one behind its last, and whether a title or marked article is in it."""

    above: int
    shape: tuple[str, str]
    first: int
    last: int = 0
    titled: bool = False


def scan(page: str) -> tuple[list[Line], list[Box], list[Element]]:
    """The page's blocks in order, its boxes and its block elements. The work grows with the page, however its tags are nested."""
    lines: list[Line] = []
    elements: list[Element] = []
    nested: list[int] = []  # open block elements
    skip, open_media = 0, set()
    boxes: list[Box] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, its box or -1, places below it of a block and of a list, table or part of one
    open_: Counter = Counter()
    inside: list[int] = []  # open articles
    held: list[int] = []  # open boxes
    around: dict[int, tuple[list[str], int]] = {}  # what was read of a block when a box within a line began
    parts: list[str] = []
    linked = articles = 0

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, max(0, len(text) - linked), inside[0] if inside else 0, held[-1] if held else -1))
        parts, linked = [], 0

    def pop() -> str:
        nonlocal parts, linked
        name, box, _, _ = stack[-1]
        if name in BLOCK or box >= 0:
            close_block()
        stack.pop()
        open_[name] -= 1
        if name in BLOCK:
            e = elements[nested.pop()]
            e.last = len(lines)
            if e.titled and e.above >= 0:
                elements[e.above].titled = True
        if box >= 0:
            held.pop()
            lines.append(Line("", box=box))
            parts, linked = around.pop(box, ([], 0))
        if name in ("article", "main"):
            inside.pop()
        return name

    at = 0
    for m in TOKEN.finditer(page + END):
        if m.start() < skip:  # in a picture or film
            at = max(skip, m.end())
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if open_["a"]:
                linked += len(" ".join(html.unescape(piece).split()))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCK:
                close_block()
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if name in BLOCK:
            if name in ENDS_P and open_["p"]:  # an open paragraph ends here, with what is open in it
                k = len(stack) - 1 if stack[-1][0] in BLOCK else stack[-1][2]
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            for ended in ENDS_ITSELF.get(name, ()):
                if open_[ended]:
                    k = len(stack) - 1 if stack[-1][0] in SCOPES else stack[-1][3]
                    while k >= 0 and stack[k][0] != ended and stack[k][0] not in HOLDERS:
                        k = stack[k][3]
                    if k >= 0 and stack[k][0] == ended:
                        while len(stack) > k:
                            pop()
            close_block()
        elif name == "br":
            parts.append(" ")
        if name in MEDIA and not m["rest"].endswith("/"):
            end = None if name in open_media else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                at = skip = end.end()
            else:  # none that follows is closed either, and what stands behind it is the page's
                open_media.add(name)
            continue
        if name in VOID or m["rest"].endswith("/") and name not in BLOCK:
            continue
        outermost = name in ("article", "main") and not inside
        word = "" if name in OWN or name == "main" and outermost else _named(m["rest"])
        tag = name in DROPPED or name == "header" and not inside
        box = -1
        if tag or word:
            box = len(boxes)
            if name in BLOCK:
                close_block()
            else:  # the line goes on behind it
                around[box] = parts, linked
                parts, linked = [], 0
            boxes.append(Box(held[-1] if held else -1, not outermost and (name in WRAPS if tag else word in LAYOUT), outermost))
            held.append(box)
        if name in ("article", "main"):
            articles += outermost
            inside.append(inside[0] if inside else articles)
            if box < 0 and held:
                boxes[held[-1]].marked = True
        if name in BLOCK:
            named = NAMED.search(m["rest"])
            elements.append(Element(nested[-1] if nested else -1, (name, (named[1] or named[2] or named[3] or "") if named else ""), len(lines), titled=name in ("h1", "article", "main", "body")))
            nested.append(len(elements) - 1)
        below = len(stack) - 1
        block, scope = (below if not stack or stack[-1][0] in kinds else stack[-1][k] for kinds, k in ((BLOCK, 2), (SCOPES, 3)))
        stack.append((name, box, block, scope))
        open_[name] += 1
    if at < len(page):
        parts.append(page[at:])
    while stack:
        pop()
    close_block()
    return lines, boxes, elements


def readers(lines: list[Line], elements: list[Element]) -> np.ndarray:
    """Whether each line is a reader's: of an element that begins with such a heading, or of several of one shape that a brief dated line is in.

    Elements that hold a title, or an article by its tag, are none. A page of nothing else has no readers.
    """
    full = np.array([bool(x.text) for x in lines], bool)
    brief = np.array([0 < len(x.text) <= BRIEF and bool(DATED.search(x.text)) for x in lines], bool)
    heads = np.array([0 < len(x.text) <= BRIEF and bool(READERS.fullmatch(x.text)) for x in lines], bool)
    out = np.zeros(len(lines), bool)
    if not brief.any() and not heads.any():
        return out
    dated = np.concatenate([[0], np.cumsum(brief)])
    after = np.concatenate([[0], np.cumsum(full)])
    firsts = np.append(np.flatnonzero(full), len(lines))
    first_full = firsts[np.searchsorted(firsts, np.arange(len(lines) + 1))]
    shapes: dict[tuple, list[Element]] = {}
    for e in elements:
        if e.last > e.first and not e.titled and after[e.last] - after[e.first] > 1:
            if heads[first_full[e.first]] if first_full[e.first] < e.last else False:
                out[e.first : e.last] = True
            shapes.setdefault((e.above, e.shape), []).append(e)
    for (above, _), alike in shapes.items():
        told = [e for e in alike if dated[e.last] > dated[e.first]]
        if len(alike) > 1 and 3 * len(told) >= 2 * len(alike):
            own = [x for e in alike for x in range(e.first, e.last)]
            out[own] = True
            rest = [x for x in range(elements[above].first, elements[above].last) if full[x] and not out[x]] if above >= 0 and not elements[above].titled else []
            if all(len(lines[x].text) <= BRIEF for x in rest):  # the heading of the list, and what leads on from it
                out[rest] = True
    kept = sum(x.own for x, reader in zip(lines, out, strict=True) if not reader)
    return out if kept > SURGE else np.zeros(len(lines), bool)


def weighed(lines: list[Line], boxes: list[Box], reader: np.ndarray, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, article, open) of each line. A line of a box that holds no part of the article, or of a reader, weighs nothing, and is not open.

    A line outside the article weighs its characters outside links, if these are half of it; in an `article`
    or `main` all its characters and GROUND + 1 more, as even a short line belongs to it. A box that may wrap
    the article is none where it holds a marked one or more than half of the page's text. Not names: the
    names of outermost articles do not count.
    """
    for line in lines:
        if line.box >= 0:
            boxes[line.box].text += line.own
    for box in reversed(boxes):  # what a box holds stands after it
        if box.above >= 0:
            boxes[box.above].text += box.text
            boxes[box.above].marked |= box.marked
    whole = sum(line.own for line in lines)
    shut: list[bool] = []
    for box in boxes:
        left_out = not (box.wraps and (box.marked or 2 * box.text > whole)) and (names or not box.article)
        shut.append(left_out or box.above >= 0 and shut[box.above])
    weight, article, open_ = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
    for k, line in enumerate(lines):
        if line.text and not reader[k] and not (line.box >= 0 and shut[line.box]):
            open_[k] = True
            article[k] = line.article
            weight[k] = len(line.text) + GROUND + 1 if line.article else line.own if 2 * line.own >= len(line.text) else 0
    return weight, article, open_


def stretches(weight: np.ndarray, surge: int, ground: int) -> list[tuple[int, int]]:
    """(first line, last line) of each stretch of lines: runs of windows with more text than the ground in which some window surges.

    Text begins where the sum of a window of lines leaves the ground on its way above `surge`, and ends where
    it is back there.
    """
    n = len(weight)
    if not n or not weight.any():
        return []
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))  # sums[i + k]: the windows that hold line i
    up = np.concatenate([[False], sums > ground, [False]])
    edge = np.flatnonzero(up[1:] != up[:-1])
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # windows a to b - 1, window j holds the lines j - WINDOW + 1 to j
        if sums[a:b].max() > surge:
            held = np.flatnonzero(weight[max(0, a - WINDOW + 1) : min(n, b)]) + max(0, a - WINDOW + 1)
            out.append((int(held[0]), int(held[-1])))
    return out


def _found(weight: np.ndarray, article: np.ndarray, open_: np.ndarray, share: float) -> list[int]:
    """Open lines of the stretches that are kept. Those of each article and those around are scanned apart: its boundary is one of every stretch."""
    if not weight.any():
        return []
    fullest = int(np.convolve(weight, np.ones(WINDOW, np.int64)).max())
    surge = min(SURGE, fullest // 2)
    found: list[tuple[int, list[int]]] = []
    inside = np.flatnonzero((article > 0) & (weight > 0))  # what is left out inside an article parts nothing
    for keep in np.split(inside, np.flatnonzero(np.diff(article[inside])) + 1) if len(inside) else []:
        found += [(int(weight[keep[a : b + 1]].sum()), keep[a : b + 1].tolist()) for a, b in stretches(weight[keep], surge, min(GROUND, surge))]
    plain = np.where(article > 0, 0, weight)  # around an article junk stands: there a dive is any fall below the surge
    around = SURGE if len(inside) else surge
    for a, b in stretches(plain, around, around):
        found.append((int(plain[a : b + 1].sum()), [i for i in range(a, b + 1) if open_[i] and not article[i]]))
    heaviest = max((n for n, _ in found), default=0)
    return sorted(i for n, r in found if n >= share * heaviest for i in r)


def main_text(page: str | None, share: float = 0.2) -> str:
    """Main text of a whole page, its blocks joined by line ends; empty if it has none.

    A window of lines slides over the page, and the weights of its lines are summed. Text begins where the
    sum surges above a threshold (SURGE, or half of the fullest window, if that is less) and ends where it
    dives: below GROUND inside an `article` or `main`, below the threshold around it. Of the stretches of
    text those with at least `share` of the heaviest one's weight are kept. Where the text around has more
    characters than what is marked, the mark adds no weight and is a boundary only. Where names alone left nothing, those of
    outermost articles do not count.
    """
    lines, boxes, elements = scan(page or "")
    reader = readers(lines, elements)
    weight, article, open_ = weighed(lines, boxes, reader)
    if not weight.any() and boxes:
        for box in boxes:
            box.text = 0
        weight, article, open_ = weighed(lines, boxes, reader, names=False)
    marked = article > 0
    # An article with the page's title in it is the article, whatever stands beside it.
    titled = any(e.shape[0] == "h1" and any(article[k] for k in range(e.first, e.last)) for e in elements)
    if marked.any() and not titled:
        plain = np.where(marked, 0, weight)
        around = sum(int(plain[a : b + 1].sum()) for a, b in stretches(plain, SURGE, SURGE))
        if around > int((weight[marked] - GROUND - 1).sum()):
            weight = np.where(marked, [line.own if 2 * line.own >= len(line.text) else 0 for line in lines], weight)
    return "\n".join(lines[i].text for i in _found(weight, article, open_, share))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    pages has page_id, url and html; other columns are ignored. Null and empty html, and pages without an
    article's text, give an empty text and 0; a very long page is read whole, in time that grows with its
    length; of stretches that tie in weight all are kept; null ids and urls stay null; repeated rows each
    get a row; no pages give no rows.
    """
    return run_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), _extract, "page_id long, url string, text string, n_chars long")
