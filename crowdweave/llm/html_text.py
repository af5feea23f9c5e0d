"""Main text of web pages by line-block distribution (operator 7).

Markup is stripped into lines, one per block element. Lines of menus, headers, footers, sidebars, notices, adverts,
forms, scripts and reader comments count as empty, as does link text. The length of a line block is the sum over
``WINDOW`` lines; a surge is a line where the block length rises to ``SURGE``, a dive where it falls to nothing, and the
lines between a surge and its dive are kept.

The distribution is taken over every page, marked or not. A page that marks its article (article, main) is cut at the
marks instead of at surge and dive, unless the distribution finds ``DOUBT`` times as much text outside the marks: then
the marked parts are cards beside the text, and the surges outside them are kept.

Furniture is told by element names and by class, id and role: a whole name, or one that starts with a known word
(``nav-main``) or joins it to a place (``page-footer``); ``has-sidebar`` or ``post-header`` are none. An element that
holds the longest marked article, or on a page without marks more than half of the text, is never furniture by its name.

Defined results: null and empty pages give an empty text; an element of page furniture that is never closed hides
nothing but its own tag, but an open script, style, title or text area hides the rest, as in browsers; a page of any
length is read whole, in one pass; repeated rows give repeated results; extra columns are ignored; an empty table stays
empty.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.llm.common import whole_text

WINDOW = 3
SURGE = 86
#: Text outside the marks, over text inside, at which marks are not believed.
DOUBT = 2
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S
)
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed".split())
_FURNITURE = frozenset("head nav header footer aside form menu dialog button select fieldset datalist figure-controls".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_MAIN = frozenset(["article", "main"])
#: Elements whose content browsers read as text up to the closing tag; others may be empty ("<svg/>").
_OPEN_ENDED = frozenset("script style textarea title xmp".split())
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HINTED = frozenset(
    "ad ads advert advertisement adverts adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert "
    "popup modal overlay sidebar sidenav aside widget widgets nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "topbar footer bottombar comment comments commentlist disqus respond share sharing social related recommended newsletter "
    "subscribe signup login search complementary contentinfo dialog pagination pager toc skip".split()
)
_PLACES = frozenset("site page main top bottom left right global primary secondary user reader cookie social side".split())
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hinted_name(name: str) -> bool:
    if name in _HINTED:
        return True
    first, *rest = re.split(r"[-_]+", name)
    return bool(rest) and (first in _HINTED or (first in _PLACES and rest[-1] in _HINTED))


def _hinted(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
        if name in ("class", "id", "role") and any(map(_hinted_name, value.lower().split())):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's lines: text, characters outside links, whether it is furniture, whether it lies in an article."""
    tags = []
    for m in _TOKEN.finditer(page):
        name = (m[2] or m[6] or "").lower()
        tags.append((m.start(), m.end(), name, bool(m[1] or m[5]), m[3] or "", bool(m[4])))
    # the closing tag of every element, by a stack for each name
    close: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    raw_until = ""
    before = [0]  # characters of text before each tag
    for k, (start, end, name, ends, _, closed) in enumerate(tags):
        before.append(before[-1] + (0 if raw_until else max(0, (tags[k + 1][0] if k + 1 < len(tags) else len(page)) - end)))
        if raw_until and not (ends and name == raw_until):
            continue
        raw_until = ""
        if not name or name in _VOID or (closed and name in _RAW and name not in _OPEN_ENDED):
            continue
        if ends:
            if stacks.get(name):
                close[stacks[name].pop()] = k
        else:
            stacks.setdefault(name, []).append(k)
            if name in _RAW:
                raw_until = name

    def length(k: int) -> int:
        return before[close[k]] - before[k] if k in close else 0

    marked = max((k for k, x in enumerate(tags) if x[2] in _MAIN and k in close and not x[3]), key=length, default=-1)

    def holds_the_text(k: int) -> bool:
        return k < marked < close.get(k, -1) if marked >= 0 else 2 * length(k) > before[-1]

    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    linked = 0
    skip_to = main_to = link_to = -1
    at = 0

    def flush(furniture: bool, main: bool) -> None:
        nonlocal linked
        words = " ".join(html.unescape("".join(text)).split())
        if words or furniture:
            lines.append((words, max(0, len(words) - linked), furniture, main))
        text.clear()
        linked = 0

    for k, (start, end, name, ends, attributes, closed) in enumerate(tags):
        if k > skip_to and at < start:
            text.append(page[at:start])
            if k <= link_to:
                linked += start - at
        at = max(at, end)
        if k <= skip_to:
            continue
        if not name:
            continue
        if name not in _INLINE:
            flush(False, k <= main_to)
        if ends or (closed and name in _RAW and name not in _OPEN_ENDED):
            continue
        hinted = name == "form" or (name not in _MAIN and name not in ("html", "body") and _hinted(attributes))
        if name in _RAW or (name in _FURNITURE and name != "form") or (hinted and not holds_the_text(k)):
            if k in close:
                flush(False, k <= main_to)
                skip_to = close[k]
                flush(True, False)
                at = tags[skip_to][1]
            elif name in _OPEN_ENDED:
                break
        elif name in _MAIN and k > main_to:
            main_to = close.get(k, len(tags))
        elif name == "a" and k > link_to:
            link_to = close.get(k, -1)
    else:
        if at < len(page):
            text.append(page[at:])
        flush(False, len(tags) <= main_to)
        return lines
    flush(False, False)
    return lines


def surges(size: list[int]) -> list[bool]:
    """Which lines lie between a surge and its dive, given the lines' lengths."""
    block = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    kept = [False] * len(size)
    inside = False
    for i, length in enumerate(block):
        inside = length >= SURGE or (inside and length > 0)
        kept[i] = inside
    return kept


def main_text(page: str) -> str:
    lines = lines_of(page)
    usable = [bool(words) and not out for words, _, out, _ in lines]
    kept = surges([x[1] if use else 0 for use, x in zip(usable, lines, strict=True)])
    marked = sum(len(x[0]) for use, x in zip(usable, lines, strict=True) if use and x[3])
    beside = sum(x[1] for use, keep, x in zip(usable, kept, lines, strict=True) if use and keep and not x[3])
    if marked and beside < DOUBT * marked:
        kept = [x[3] for x in lines]
    elif marked:
        kept = [keep and not x[3] for keep, x in zip(kept, lines, strict=True)]
    return "\n".join(x[0] for use, keep, x in zip(usable, kept, lines, strict=True) if use and keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            names=[*batch.schema.names[:2], "text", "n_chars"],
        )


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No shuffle."""
    rows = pages.select(F.col(id_column), F.col(url_column), whole_text(html_column).alias("_html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    return rows.mapInArrow(_extract, f"{id_column} {kinds[0]}, {url_column} {kinds[1]}, text string, n_chars long")
