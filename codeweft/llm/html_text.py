"""Main text of HTML pages by tree scoring.

Paragraphs pass points for length and commas to the elements around them, half as many with each step up; points are
discounted by link density, and far more for elements that are named like menus, adverts, comments and the like. The best
container and its good siblings are kept. Inside them a name alone drops nothing that stands among paragraphs: what goes are
elements that work as menus, forms, adverts or reader comments, by their links, controls, repeated parts or place.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import map_texts

# Names of elements and of their usual roles and classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
_CONTROLS = frozenset("input textarea select button".split())
_PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
_BLOCK = _PARAGRAPH | frozenset("html body main article section div header footer nav aside ul ol dl table thead tbody tfoot tr form fieldset figure details dialog menu hr center hgroup".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = frozenset("html body main article section div ul ol dl table td th blockquote aside nav header footer form".split())
_BARRIER = frozenset("td th table article body".split())
_DROPPED = frozenset("nav header footer aside button dialog menu head input template svg object select canvas audio video".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar "
    "side menu menus nav navbar navigation navigate breadcrumb breadcrumbs share sharing social related recommended recommendations comment comments reply replies respond disqus "
    "footer header masthead widget pagination pager login signup search toolbar topbar skip alert toast".split()
)
_ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription popup modal overlay toast".split())
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NEVER = frozenset("html body main article".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute after white space and slashes: a name, and a value in quotes that close, in quotes that don't, or without.
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)|))?)")
#: How far an element's points go: as they are; named like one that is left out, in part or altogether.
_CLEAN, _NAMED_IN_PART, _NAMED = 1.0, 0.3, 0.1
#: An element is small under this share of the best container, full of links beyond this one. Links of a menu have fewer
#: characters than this on average, and a paragraph that shows that the article goes on has as many at least.
_SMALL, _LINKS, _LABEL, _LINE = 0.4, 0.3, 20, 25
#: What the name of an element says: by its class an advert or reader comments, or reader comments in part or by its id.
_ADVERT, _COMMENT, _LIKE_COMMENT = 1, 2, 4


def _doubt(tag: str, attributes: list[tuple[str, str]]) -> float:
    """0: never the article. Else the share of its points that an element of this name and class passes on."""
    if tag in _DROPPED:
        return 0.0
    worth = _NAMED if tag in ("form", "fieldset") else _CLEAN
    if tag in _NEVER:
        return worth
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
            return 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 0.0
        if name in ("class", "id"):
            for word in value.split():
                if word in _NAMES:
                    worth = min(worth, _NAMED)
                elif not _NAMES.isdisjoint(re.split(r"[^a-z0-9]+", word)):
                    worth = min(worth, _NAMED_IN_PART)
    return worth


def _kind(attributes: list[tuple[str, str]]) -> int:
    """What class and id say of an element's use."""
    kind = 0
    for name, value in attributes:
        if name in ("class", "id"):
            for word in value.split():
                kind |= _ADVERT * (name == "class" and word in _ADVERTS) | _COMMENT * (name == "class" and word in _COMMENTS)
                kind |= _LIKE_COMMENT * (not _COMMENTS.isdisjoint(re.split(r"[^a-z0-9]+", word)))
    return kind


class _Page:
    """Elements in page order, each after its parent, and blocks of text with the element they are in.

    The page is read once: a tag that doesn't end takes the rest, and what is open is known by name, so that a closing tag
    without its opening one costs nothing.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.worth, self.dropped = [""], [-1], [_CLEAN], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.links, self.kinds, self.controls = [0], [0], [0]
        self.stack = [0]
        # Places in the stack of what is open, by name; of blocks; of what end tags and implied ends don't reach beyond.
        self.open: dict[str, list[int]] = defaultdict(list)
        self.open_blocks, self.barriers, self.scopes, self.row_scopes = [0], [0], [0], [0]
        self._text: list[str] = []
        self._linked = self._holder = 0
        self._begun = False
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        whole = " ".join("".join(self._text).split())
        if whole:
            self.blocks.append((self._holder, whole, self._linked))
        self._text.clear()
        self._linked, self._begun = 0, False

    def _add(self, piece: str) -> None:
        if self.dropped[self.stack[-1]]:
            return
        if not self._begun:
            self._holder = self.stack[self.open_blocks[-1]]
            self._begun = bool(piece.strip())
        self._text.append(piece)
        if self.links[self.stack[-1]]:
            self._linked += len(" ".join(piece.split()))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            start = html.find("<", at)
            if start < 0:
                start = end
            if start > at:
                self._add(unescape(html[at:start]))
            if start == end:
                return
            following = html[start + 1 : start + 2]
            if following == "!" or following == "?":
                if html.startswith("<!--", start):
                    stop, size = html.find("-->", start + 4), 3
                elif html.startswith("<![CDATA[", start):
                    stop, size = html.find("]]>", start + 9), 3
                else:
                    stop, size = html.find(">", start), 1
                at = end if stop < 0 else stop + size
            elif following == "/":
                name = _NAME.match(html, start + 2)
                stop = html.find(">", start + 2)
                at = end if stop < 0 else stop + 1
                if name and stop >= 0:
                    self._end(name.group().lower())
            elif name := _NAME.match(html, start + 1):
                tag, at, attributes = name.group().lower(), name.end(), []
                while True:
                    m = _ATTRIBUTE.match(html, at)
                    if not m or m.end() == at or m.end() >= end and not m.group(1):
                        return  # the page ends inside a tag
                    at = m.end()
                    if m.group(1):
                        break
                    attributes.append((m.group(2).lower(), (m.group(3) or m.group(4) or m.group(5) or "").lower()))
                if tag in _CONTROLS:
                    self.controls[self.stack[-1]] += 1
                if tag in _RAW:
                    last = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                    if tag == "xmp":  # shown as it stands
                        self._start("pre", attributes)
                        self._add(html[at : last.start() if last else end])
                        self._end("pre")
                    at = last.end() if last else end
                    continue
                self._start(tag, attributes)
                if html[at - 2] == "/" and (self.open["svg"] or self.open["math"]):  # only there an element can end itself
                    self._end(tag)
            else:
                self._add("<")
                at = start + 1

    def _start(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if tag in _BLOCK:
            self._flush()
            self._close({"p"}, tag)
        if tag in _CLOSES:
            self._close(_CLOSES[tag], tag)
        if tag in _VOID:
            if tag != "wbr":
                self._add(" ")
            return
        parent, place = self.stack[-1], len(self.stack)
        heading = tag[:1] == "h" and tag[1:].isdigit() and self._in_article_header()
        worth = 0.0 if tag == "label" and self.open["form"] else _doubt(tag, attributes)
        self.kinds.append(_kind(attributes))
        self.controls.append(0)
        self.stack.append(len(self.tags))
        self.tags.append(tag)
        self.parents.append(parent)
        self.links.append(self.links[parent] + (tag == "a"))
        self.worth.append(worth)
        self.dropped.append((self.dropped[parent] and not heading) or not worth)
        self.open[tag].append(place)
        for names, places in ((_BLOCK, self.open_blocks), (_BARRIER, self.barriers), (_SCOPE, self.scopes)):
            if tag in names:
                places.append(place)
        if tag in _SCOPE and tag not in ("td", "th"):
            self.row_scopes.append(place)

    def _pop(self, place: int) -> None:
        """Close everything from this place of the stack on."""
        if self.open_blocks[-1] >= place:
            self._flush()
        for k in range(len(self.stack) - 1, place - 1, -1):
            self.open[self.tags[self.stack[k]]].pop()
        del self.stack[place:]
        for places in (self.open_blocks, self.barriers, self.scopes, self.row_scopes):
            while places[-1] >= place:
                places.pop()

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._add(" ")
        places = self.open.get(tag)
        if places and (tag in _SCOPE or places[-1] >= self.barriers[-1]):
            self._pop(places[-1])

    def _close(self, tags: set[str], tag: str) -> None:
        place = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if place and place >= (self.row_scopes if tag == "tr" else self.scopes)[-1]:
            self._pop(place)

    def _in_article_header(self) -> bool:
        """A heading in a header that is dropped only for being one, inside an article."""
        if not self.open.get("header"):
            return False
        place = self.open["header"][-1]
        inside = any(self.open.get(t) and self.open[t][0] < place for t in ("article", "main"))
        return inside and not self.dropped[self.stack[place - 1]]


def main_text(html: str) -> str:
    """Blocks of the article in page order, white space made single, joined by line breaks; empty if there is no text."""
    page = _Page(html)
    if not page.blocks:
        return ""
    size = len(page.tags)
    points, chars, linked, anchors, controls, commenting = (np.zeros(size) for _ in range(6))
    controls[:], commenting[:] = page.controls, [bool(k & (_COMMENT | _LIKE_COMMENT)) for k in page.kinds]
    trust = np.array(page.worth)
    for node in range(1, size):
        trust[node] = min(trust[node], trust[page.parents[node]]) if not page.dropped[page.parents[node]] else trust[node]
    for element, text, links in page.blocks:
        worth = (text.count(",") + min(len(text) / 100, 3) + (1 if len(text) >= _LINE else 0.1)) * trust[element]
        chars[element] += len(text)
        linked[element] += links
        node = page.parents[element] if page.tags[element] in _PARAGRAPH and element else element
        while node >= 0 and worth > 1e-3:
            points[node] += worth
            node, worth = page.parents[node], worth / 2
    for node in range(size - 1, 0, -1):
        anchors[node] += page.tags[node] == "a"
        for total in (chars, linked, anchors, controls, commenting):
            total[page.parents[node]] += total[node]
    density = np.minimum(1, linked / np.maximum(chars, 1))
    final = points * (1 - density)
    best = int(final.argmax())
    article = best
    while article > 0 and page.tags[article] != "article":
        article = page.parents[article]
    best = article if article > 0 else best
    around, node = {0}, best
    while node > 0:
        around.add(node)
        node = page.parents[node]
    if any(page.kinds[node] & (_ADVERT | _COMMENT) or (page.tags[node] == "form" and controls[best]) for node in around) and article <= 0:
        return ""  # a page of nothing but an advert, comments or a form
    kept = np.zeros(size, dtype=bool)
    kept[best] = True
    for node in range(1, size):
        if best and page.parents[node] == page.parents[best] and node != best and not page.dropped[node] and page.worth[node] == _CLEAN and not page.kinds[node] and page.tags[best] != "body":
            title = page.tags[best] != "article" and (page.tags[node] in ("h1", "h2") or (page.tags[node] in _PARAGRAPH and chars[node] > 80))
            kept[node] = (title or final[node] >= max(1.0, 0.2 * final[best])) and density[node] < 0.25
        kept[node] |= kept[page.parents[node]]
    gone = _set_apart(page, best, around, kept, chars, density, controls, commenting)
    listed = np.array([t in ("ul", "ol") for t in page.tags]) & (density >= 0.75) & (anchors >= 2)
    menu = listed & (linked < _LABEL * anchors)
    rescued = np.array([not d for d in page.dropped])
    for node in range(1, size):
        up = page.parents[node]
        menu[node] |= menu[up]
        gone[node] |= gone[up] and not (page.dropped[up] and rescued[node])
    return "\n".join(text for element, text, _ in page.blocks if kept[element] and not menu[element] and not gone[element])


def _set_apart(page: _Page, best: int, around: set[int], kept: np.ndarray, chars: np.ndarray, density: np.ndarray, controls: np.ndarray, commenting: np.ndarray) -> np.ndarray:
    """Elements inside what is kept that aren't of the article, though not by their tags.

    Only elements with a name of the kind are looked at, and never one around the best container. They go if they are full of
    links, hold controls or hold several comments; if they are small and of the class of an advert, or of one of several comments;
    and if they stand before the first or after the last paragraph of the article and are small, or of the class of comments.
    Headings and paragraphs go only with the class of an advert.
    """
    size = len(page.tags)
    named = np.array([w < _CLEAN or k > 0 for w, k in zip(page.worth, page.kinds, strict=True)]) & kept
    for node in around:
        named[node] = False
    gone = np.zeros(size, dtype=bool)
    if not named.any():
        return gone
    below = named.copy()
    for node in range(1, size):
        below[node] |= below[page.parents[node]]
    beside = np.zeros(size)  # comments with one parent: a lone element of such a class among paragraphs is a part of the text
    np.add.at(beside, np.maximum(page.parents, 0), [bool(k & _COMMENT) for k in page.kinds])
    plain = [element for element, text, _ in page.blocks if kept[element] and not below[element] and len(text) >= _LINE]
    first, last = (min(plain), max(plain)) if plain else (size, -1)
    for node in np.flatnonzero(named):
        tag, kind, small = page.tags[node], page.kinds[node], chars[node] < _SMALL * chars[best]
        if tag in _PARAGRAPH:
            gone[node] = small and bool(kind & _ADVERT)
        elif tag in ("form", "fieldset"):
            gone[node] = True
        else:
            inside = commenting[node] - bool(kind & (_COMMENT | _LIKE_COMMENT))
            functional = density[node] > _LINKS or controls[node] > 0 or (kind & (_COMMENT | _LIKE_COMMENT) and inside >= 2)
            edge = node < first or node > last
            classed = kind & _ADVERT or (kind & _COMMENT and beside[page.parents[node]] >= 2)
            gone[node] = functional or (small and (classed or edge)) or (edge and kind & _COMMENT)
    return gone


def extract_text(pages: DataFrame, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `out`: the main text of each whole page; null and empty pages, and pages without text, have an empty one.

    An existing column of that name is replaced; repeated rows are read each; an empty table stays empty. The time for a page
    grows with its length, however broken it is.
    """
    return map_texts(pages, html, [(out, T.StringType())], lambda texts: [[main_text(t) for t in texts]], keep)


def page_texts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages: extract_text() tells what null, empty and broken pages and
    repeated rows give; an empty table gives none; other columns are not read."""
    return extract_text(pages.select("page_id", "url", "html"), keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
