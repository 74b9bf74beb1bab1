"""HTML extraction by two-pass block rules.

Markup is cut into blocks of text. First pass: link density, a copyright sign at the start, length and stop-word density
make a block boilerplate or content; short and doubtful ones stay open. Where the page's text is in no language of the
stop-word list (or not in Latin letters), length and links alone decide. Second pass: an open block takes the label of
the nearest decided neighbours; where these disagree at equal distance a heading goes with what follows, and anything
else, or where there are none, is content inside an <article> or <main> element and boilerplate outside, unless nothing
on the page is content. Neighbours are sought inside the same element first.

Elements that are no article text by their name (scripts, buttons, ...) are dropped. Containers that usually hold none
(menus, footers, sidebars, forms, by name or by the words of class, id and role) are judged by what they hold: one that
has most of the page's content, while no <article> or <main> has text outside such containers, is layout and does not
count, if it holds such an element or two long content blocks or there is no other text; one marked by a vague part of a longer word ("search-engine-history") counts only if it has no long
content block. Blocks in the others are boilerplate.

Character references are decoded, white space inside a block becomes one space, blocks join by \\n; nothing is cut and
pages of any length are read whole. Null, empty or text-less pages give an empty text. Broken markup never fails:
unclosed elements end with their parents, an unfinished tag at the end is dropped. Repeated rows each get their text;
other columns are kept as they are.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

SHORT, LONG, LINKS, DENSE, SPARSE = 60, 180, 0.4, 0.25, 0.08

# HTML element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}
NO_TEXT = frozenset("head script style noscript iframe template svg math object canvas audio video select datalist button textarea label dialog map".split())
FURNITURE = frozenset("fieldset form nav aside footer header menu".split())
CONTENT = frozenset(["article", "main"])
#: Words of class, id and role values that mark what is not article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tagcloud toolbar toc widget widgets contentinfo complementary search alert".split()
)
#: Of these, what readers write.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Of these, what begins other words too.
VAGUE = frozenset("alert banner header notice notices related reply respond search share sharing social toc".split())
#: First parts of a word that say what a layout has or lacks.
ABOUT = frozenset("has have no non not with without is hide hides show".split())
#: Frequent words of four languages.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so such than that the their them then there these they this to up "
    "was we were what when which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bis das dem den der des die durch ein eine einem einen einer er es für hat ich im ist ihr mit nach nicht noch nur oder sich sie sind so um und vom von vor war wie wir zu zum zur "
    "al como con del desde donde el ella ellos entre era esta este fue ha hay la las lo los más muy no o para pero por que se ser si sin sobre su sus también tiene una uno y ya".split()
)

_MARKUP = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[a-z]+|\d+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LETTERS = re.compile(r"[^\W\d_]")
_BEYOND = re.compile("[\u0250-\U0010ffff]")
_COPYRIGHT = re.compile(r"\W{0,3}(?:©|\(c\)\s|copyright\b)", re.I)


class Block:
    __slots__ = ("text", "linked", "region", "label", "heading", "boxes")

    def __init__(self, text: str, linked: int, region: int, label: int | None, heading: bool, boxes: tuple):
        self.text, self.linked, self.region, self.label, self.heading, self.boxes = text, linked, region, label, heading, boxes


class Box:
    """A container that usually holds no article text; weak if only the first part of a longer word says so."""

    __slots__ = ("weak", "readers")

    def __init__(self, weak: bool, readers: bool):
        self.weak, self.readers = weak, readers


def _mark(attributes: str) -> Box | None:
    if "=" not in attributes:
        return None
    weak = None
    for groups in _MARKED.findall(attributes):
        for word in "".join(groups).lower().split():
            parts = _PARTS.findall(word)
            if not parts or len(parts) > 1 and parts[0] in ABOUT:
                continue
            found = MARKS.intersection(parts)
            if found:
                box = Box(found <= VAGUE and parts[-1] not in MARKS and len(parts) > 2, not READERS.isdisjoint(found))
                if not box.weak:
                    return box
                weak = box
    return weak


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order, without those of dropped elements; region 0 is outside <article> and <main>."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, tuple]] = []  # name, dropped, region, boxes
    parts: list[str] = []
    linked = anchors = regions = 0
    dropped, region, breaks, boxes = False, 0, 0, ()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text and not dropped:
            out.append(Block(text, linked, region, None, any(x[0] in HEADINGS for x in stack), boxes))
        parts.clear()
        linked = 0

    def leave(keep: int) -> None:
        nonlocal dropped, region, boxes, anchors
        del stack[keep:]
        dropped, region, boxes = stack[-1][1:] if stack else (False, 0, ())
        anchors = sum(x[0] == "a" for x in stack)

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if not text.isspace():
                breaks = 0
            if anchors:
                linked += len("".join(text.split()))

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name, attributes = m[2].lower(), m[3]
        if not attributes.endswith(">"):
            break
        if m[1]:
            if name == "p" or name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
                if stack[k][0] in ("table", "article", "main") and name not in ("article", "main", "body", "html", "div", "section"):
                    break
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            same = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, (name,))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same:
                    leave(k)
                    break
                if stack[k][0] in ("ul", "ol", "menu", "table", "dl", "select", *(["tr"] if name in ("td", "th") else [])):
                    break
        if name in VOID or attributes.endswith("/>") and name not in BLOCKS:
            continue
        if name == "a":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        dropped = dropped or name in NO_TEXT or bool(_HIDDEN.search(attributes))
        box = None if name in ("body", "html", "article", "main") else _mark(attributes)
        # a heading group inside the article is part of it
        if name in FURNITURE and not (name == "header" and region and not box):
            box = Box(False, bool(box and box.readers))
        if box:
            boxes = (*boxes, box)
        if name in CONTENT and not dropped:
            regions += 1
            region = regions
        stack.append((name, dropped, region, boxes))
        anchors += name == "a"
    flush()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    hits = 0
    for word in words:
        hits += word in STOP_WORDS or not word.isalnum() and _EDGE.sub("", word) in STOP_WORDS
    return hits / len(words)


def _latin(text: str) -> bool:
    """Whether at least half of the letters are Latin."""
    beyond = sum(c.isalpha() for c in _BEYOND.findall(text))
    return not beyond or len(_LETTERS.findall(text)) >= 2 * beyond


def first_pass(blocks: list[Block]) -> list[int | None]:
    """1 (content), 0 (boilerplate) or None (open) by each block's own text."""
    densities = [stop_density(b.text) if len(b.text) >= SHORT and _latin(b.text) else None for b in blocks]
    known = any(d is not None and d >= SPARSE for d in densities)  # the page is in a language of the list
    out: list[int | None] = []
    for b, density in zip(blocks, densities, strict=True):
        size, label = len(b.text), None
        if b.linked > LINKS * (size - b.text.count(" ")) or not b.region and _COPYRIGHT.match(b.text):
            label = 0
        elif density is None and size >= SHORT // 2 and not _latin(b.text):
            label = 1
        elif density is not None and not known:
            label = 1 if size >= LONG else None
        elif density is not None:
            if density >= DENSE or size >= LONG and density >= SPARSE:
                label = 1
            elif size >= LONG and not b.region and density < SPARSE:
                label = 0
        out.append(label)
    return out


def furniture(blocks: list[Block], first: list[int | None]) -> set[Box]:
    """The boxes that count: those which do not hold the page's content."""
    held: dict[Box, int] = {}
    long_ones: dict[Box, int] = {}
    regions: set[Box] = set()
    total = 0
    others = [b for b, label in zip(blocks, first, strict=True) if not b.boxes and label != 0]
    free = any(b.region for b in others)
    for b, label in zip(blocks, first, strict=True):
        size = len(b.text) if label == 1 else 0
        total += size
        for box in b.boxes:
            held[box], long_ones[box] = held.get(box, 0) + size, long_ones.get(box, 0) + (size >= LONG)
            if b.region:
                regions.add(box)

    def layout(box: Box) -> bool:
        if box.weak and long_ones[box]:
            return True
        if free or not held[box] or others and box not in regions and long_ones[box] < 2:
            return False
        return held[box] == total if box.readers else 2 * held[box] > total

    return {box for box in held if not layout(box)}


def classify(blocks: list[Block]) -> None:
    """Sets every label to 1 (content) or 0."""
    first = first_pass(blocks)
    shut = furniture(blocks, first)
    first = [0 if not shut.isdisjoint(b.boxes) else label for b, label in zip(blocks, first, strict=True)]
    # beside an article that has content, what is short takes its label from its neighbours
    if any(label == 1 and b.region for b, label in zip(blocks, first, strict=True)):
        first = [None if label == 1 and not b.region and len(b.text) < LONG else label for b, label in zip(blocks, first, strict=True)]
    nothing = 1 not in first
    for b, label in zip(blocks, first, strict=True):
        b.label = label
    n = len(blocks)
    before: list[tuple[int, int] | None] = [None] * n
    after: list[tuple[int, int] | None] = [None] * n
    for target, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, int]] = {}
        for place, i in enumerate(order):
            target[i] = (place - last[blocks[i].region][0], last[blocks[i].region][1]) if blocks[i].region in last else None
            # inside an article only its text speaks for its neighbours, not the boxes set into it
            if first[i] is not None and not (blocks[i].region and first[i] == 0):
                last[blocks[i].region] = (place, first[i])
    for i, b in enumerate(blocks):
        if b.label is None:
            near = [x for x in (before[i], after[i]) if x]
            if not near or len(near) == 2 and near[0][0] == near[1][0] and near[0][1] != near[1][1]:
                b.label = near[1][1] if b.heading and len(near) == 2 else int(b.region > 0 or nothing)
            else:
                b.label = int(nothing or min(near)[1])


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without the html column and with the main text, in place of any column of that name."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() == text_col.lower() and c != html_col])

    def run(batches):
        for batch in batches:
            k = batch.schema.names.index(html_col)
            rest = [i for i in range(batch.num_columns) if i != k]
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pa.array([main_text(x.as_py()) for x in part.column(k)], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], texts], [*[part.schema.names[i] for i in rest], text_col])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in pages.schema if f.name != html_col] + [T.StructField(text_col, T.StringType())])
    return pages.mapInArrow(lean(run), schema)
