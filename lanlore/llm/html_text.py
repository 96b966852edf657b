"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass weighs every block by itself: its length, link density and
stop-word density make it good, bad or neither, and where it stands adds to that. Menus, footers, forms and the like are
out by element or role, and so is what a class or id calls a sidebar, notice, advert or comment, unless that holds most of
the page's text (a name on a wrapper tells its layout, not what it is). Where good text stands mostly inside an article or
main element, blocks inside it gain and blocks outside it lose. What weighs enough is decided, short blocks and long ones
with few stop words stay open. The second pass gives open blocks the label of the nearest decided neighbour; where both
sides are as near and differ, headings follow what comes next and other blocks are left out. Long ones are kept if the
nearest on either side is. On a page with hardly any listed stop word, length and link density alone decide. On a page
without a block that is surely main text, all open ones are kept.

Scripts, styles and other raw elements never become text. Character references are decoded, white space within a block
becomes one space, blocks are joined by a line break in page order; nothing else is dropped or cut.

Defined results: a null or empty page has an empty text. Unclosed and stray tags are tolerated: a block-level tag ends
the block before it, an end tag closes all that was opened inside. Of the raw elements only script, style, textarea and
title take the rest of the page if they are not closed; of others just the tag is skipped. `main` replaces a column of that name.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import without

# Elements of HTML by their role here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "button", "object", "canvas", "video", "audio"}
SWALLOWING = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figure", "footer", "form",
    "head", "header", "html", "li", "main", "menu", "nav", "ol", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BLOCKS = CONTAINERS | {"caption", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "option", "p", "pre", "summary"}
OUTSIDE = {"aside", "dialog", "fieldset", "footer", "form", "head", "menu", "nav"}
INSIDE = {"article", "main"}
ROLES_OUT = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
NAMES_OUT = {
    "ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "promoted", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "topbar", "widget",
}
# Parts of a class name that tell a state or a layout, not what an element is; elements that names never put out.
NAME_STATES = {"has", "is", "no", "with", "without", "open", "closed", "opened", "hide", "hidden", "show", "left", "right", "single", "js"}
NEVER_BY_NAME = {"body", "h1", "h2", "h3", "h4", "h5", "h6", "html"}
STOP_WORDS = set(
    """a about an and are as at be been but by for from had has have he her his i if in into is it its not of on or our she so than that the their them then there these they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous par pas plus pour qu que qui sa se ses son sur une vous
    aber als auch auf aus bei bin das dass dem den der des die durch ein eine einen einer es für hat ich im ist mit nach nicht noch oder sich sie sind so um und uns von vor war wie zu zum zur
    al como con cuando del desde donde el ella entre era es esta este hay lo los más muy o para pero por porque qué ser si sin sobre su sus también un y ya""".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
#: Share of stop words in the long blocks of a page under which its language is taken to be none of the listed ones.
STOP_HARDLY = 0.05
LINKS_HIGH = 0.2
MOSTLY_LINKS = 0.5
#: Weights of the first pass: a good block, one with many links, one that is mostly links, and standing inside or outside the article.
GOOD, LINKED, ALL_LINKS, INSIDE_ARTICLE, OUTSIDE_ARTICLE = 2.0, -2.0, -4.0, 1.5, -3.0
DECIDED = 1.0

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>?|<[!?/][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _named_out(names: str) -> bool:
    """Whether a class or id calls its element something beside the main text: by its first or last part, unless it tells a state."""
    for name in names.split():
        parts = _NAME.findall(name)
        if parts and (parts[0] in NAMES_OUT or parts[-1] in NAMES_OUT) and not NAME_STATES & {*parts}:
            return True
    return False


def _placed(tag: str, attributes: str, within: str) -> tuple[str, bool]:
    """Where an element's content belongs: "out", "in", or as `within`, its parent's place; and whether a name puts it out."""
    if within == "out" or tag in OUTSIDE:
        return "out", False
    named = False
    if attributes:
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
        bare = _ATTRIBUTE.sub("", attributes).lower().split()
        if found.get("role") in ROLES_OUT or "hidden" in bare or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return "out", False
        named = tag not in NEVER_BY_NAME and _named_out(f"{found.get('class', '')} {found.get('id', '')}")
        if found.get("role") in ("main", "article"):
            return "in", named
    if tag == "header" and within != "in":
        return "out", False
    return "in" if tag in INSIDE else within, named


def _raw_ends(html: str, name: str) -> dict[int, int]:
    """Where each closed element `name` ends, by where it starts; an end tag closes the last one open."""
    ends, opened = {}, []
    for tag in re.finditer(rf"<(/?){name}(?![\w:-])[^>]*>?", html, re.I):
        if not tag[1]:
            if not tag[0].rstrip(">").rstrip().endswith("/"):
                opened.append(tag.start())
        elif opened:
            ends[opened.pop()] = tag.end()
    return ends


Block = tuple[str, int, str, bool, int]


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """(text, characters in links, place, heading, name) of each block with text, in page order.

    A block's name is the number of the innermost element around it that a name puts out, 0 if there is none; the second
    list has the name around each name.
    """
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, str, int]] = []
    opened: dict[str, int] = {}
    around = [0]
    own, own_name, heading, linked, in_link, breaks = "", 0, False, 0, 0, 0

    def end_block() -> None:
        nonlocal parts, linked, in_link, breaks, heading, own, own_name
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, linked, own or (stack[-1][1] if stack else ""), heading, own_name or (stack[-1][2] if stack else 0)))
        parts, linked, in_link, breaks, heading, own, own_name = [], 0, 0, 0, False, "", 0

    at, size = 0, len(html)
    raw_ends: dict[str, dict[int, int]] = {}
    while at < size:
        mark = html.find("<", at)
        tag = _TAG.match(html, mark) if mark >= 0 else None
        end = mark if tag else size if mark < 0 else mark + 1  # a lone < is text
        if end > at:
            piece = html[at:end]
            parts.append(piece)
            if in_link:
                linked += len(_SPACE.sub(" ", unescape(piece)).strip())
            if breaks and not piece.isspace():
                breaks = 0
        at = end
        if not tag:
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = tag[1] == "/"
        if name in RAW and not closing:
            if not tag[3].rstrip().endswith("/"):
                if name in SWALLOWING:
                    close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else size
                else:
                    if name not in raw_ends:
                        raw_ends[name] = _raw_ends(html, name)
                    at = raw_ends[name].get(mark, at)
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                keep = own, own_name, heading
                end_block()
                own, own_name, heading = keep
        elif name in BLOCKS:
            end_block()
            if closing:
                while opened.get(name):
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                continue
            if name == "body":
                stack.clear()
                opened.clear()
            within, name_around = stack[-1][1:] if stack else ("", 0)
            place, named = _placed(name, tag[3], within)
            if named:
                around.append(name_around)
                name_around = len(around) - 1
            if name in CONTAINERS:
                stack.append((name, place, name_around))
                opened[name] = opened.get(name, 0) + 1
            else:
                own, own_name, heading = place, name_around if named else 0, name[0] == "h" and name != "hr"
    end_block()
    return out, around


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _out_by_name(blocks: list[Block], around: list[int]) -> set[int]:
    """The names that hold: those around no more than half of the page's text, with all that is inside them."""
    text = [0] * len(around)
    for body, linked, place, _, name in blocks:
        if place != "out":
            text[name] += max(len(body) - linked, 0)
    total = sum(text)
    for name in range(len(around) - 1, 0, -1):  # inner names come after outer ones
        text[around[name]] += text[name]
    out: set[int] = set()
    for name in range(1, len(around)):
        if around[name] in out or 2 * text[name] <= total:
            out.add(name)
    return out


def labels_of(blocks: list[Block], around: list[int]) -> list[bool]:
    """Which blocks are main text."""
    named = _out_by_name(blocks, around)
    out = [place == "out" or name in named for _, _, place, _, name in blocks]
    found = {i: _stops(b[0]) for i, b in enumerate(blocks) if not out[i] and len(b[0]) >= LENGTH_LOW and b[1] <= LINKS_HIGH * len(b[0])}
    unlisted = sum(s for s, _ in found.values()) < STOP_HARDLY * sum(n for _, n in found.values())

    def good(i: int) -> bool:
        size, (stops, words) = len(blocks[i][0]), found[i]
        if unlisted:
            return size >= LENGTH_HIGH
        return stops >= (STOP_LOW if size >= LENGTH_HIGH else STOP_HIGH) * max(words, 1)

    surely = {i for i in found if good(i)}
    inside = sum(len(blocks[i][0]) for i in surely if blocks[i][2] == "in")
    outside = sum(len(blocks[i][0]) for i in surely) - inside
    # without good text at all, an article still tells where the text is
    by_article = any(b[2] == "in" for b in blocks) and inside >= outside
    decided: list[bool | None] = []
    for i, (text, linked, place, _, _) in enumerate(blocks):
        if out[i]:
            decided.append(False)
            continue
        links = linked / len(text)
        weight = GOOD if i in surely else ALL_LINKS if links >= MOSTLY_LINKS else LINKED if links > LINKS_HIGH or (linked and len(text) < LENGTH_LOW) else 0.0
        if by_article:
            weight += INSIDE_ARTICLE if place == "in" else OUTSIDE_ARTICLE
        decided.append(True if weight >= DECIDED else False if weight <= -DECIDED else None)
    if not any(decided):  # nothing is surely main text: what is not surely something else is
        return [d is None for d in decided]
    before, after = [], []
    for side, order in ((before, range(len(decided))), (after, range(len(decided) - 1, -1, -1))):
        last = None
        for i in order:
            last = i if decided[i] is not None else last
            side.append(last)
    after.reverse()
    labels = []
    for i, d in enumerate(decided):
        if d is None:
            b, a = before[i], after[i]
            if b is None or a is None:
                d = decided[a if b is None else b]
            elif i in found:
                d = decided[b] or decided[a]
            elif decided[b] == decided[a]:
                d = decided[b]
            elif i - b != a - i:
                d = decided[b if i - b < a - i else a]
            else:
                d = blocks[i][3] and decided[a]
        labels.append(bool(d))
    return labels


def text_of(html: str) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    blocks, around = blocks_of(html)
    kept = [b[0] for b, good in zip(blocks, labels_of(blocks, around)) if good]
    return "\n".join(kept), len(blocks), len(kept)


def main_text(html: Column | str) -> Column:
    """(text, n_blocks, n_kept) of a page."""
    kind = pa.struct([("text", pa.string()), ("n_blocks", pa.int64()), ("n_kept", pa.int64())])

    @F.arrow_udf("struct<text: string, n_blocks: bigint, n_kept: bigint>")
    def extract(pages: pa.Array) -> pa.Array:
        found = [text_of(p.as_py() or "") for p in pages]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(kind)], fields=list(kind))

    return extract(html)


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with `main`."""
    return without(pages, "main").withColumn("main", main_text(html))
