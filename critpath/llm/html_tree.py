"""A forgiving HTML reader: a tree of block elements with their text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_NAME_END, _QUOTE_OR_END = re.compile(r"[\s/>]"), re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-testid|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PIECE = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Elements by the HTML standard: without an end tag, with unparsed content, and those that run within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img input".split())
#: Elements whose content is never text of a page.
SILENT = frozenset("script style template noscript head title iframe object svg canvas select textarea button datalist xmp noembed noframes audio video map".split())
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


@dataclass
class Node:
    tag: str
    tokens: list[str]
    parent: Node | None
    order: int
    depth: int
    children: list[Node] = field(default_factory=list)
    #: (order of the piece on the page, text)
    texts: list[tuple[int, str]] = field(default_factory=list)
    link_chars: int = 0
    inputs: int = 0
    tags: int = 1


def tokens_of(attributes: str) -> list[str]:
    """Lower-case letter runs of the attributes that name an element's purpose."""
    return [p.lower() for m in _ATTRIBUTE.finditer(attributes) for p in _PIECE.findall(m[2] or m[3] or m[4] or m[1])]


class _Ahead:
    """The place of the next match of a pattern; asked at rising places, it reads no character twice."""

    def __init__(self, pattern: re.Pattern, source: str):
        self.pattern, self.source, self.low, self.at = pattern, source, 0, -1

    def of(self, place: int) -> int:
        if not self.low <= place <= self.at:
            m = self.pattern.search(self.source, place)
            self.low, self.at = place, m.start() if m else len(self.source)
        return self.at


class _Tags:
    """Finds tags from left to right in linear time, whatever quotes or tags are never closed."""

    def __init__(self, source: str):
        self.source, self.names, self.starts = source, _Ahead(_NAME_END, source), _Ahead(_QUOTE_OR_END, source)
        self.ends: dict[int, int] = {}  # opening quote within a tag: the tag's end, -1 without one

    def end(self, place: int) -> int:
        """The first > from place on that is not within quotes, -1 if there is none."""
        at, passed = self.starts.of(place), []
        found = -1
        while at < len(self.source):
            if self.source[at] == ">":
                found = at
                break
            if at in self.ends:
                found = self.ends[at]
                break
            passed.append(at)
            close = self.source.find(self.source[at], at + 1)
            if close < 0:
                break
            m = _QUOTE_OR_END.search(self.source, close + 1)
            at = m.start() if m else len(self.source)
        for quote in passed:
            self.ends[quote] = found
        return found

    def at(self, place: int) -> tuple[int, str, str, bool] | None:
        """Of a tag, comment or declaration that begins at place: its end, name, attributes and whether it is an end tag; else None."""
        source = self.source
        after = source[place + 1 : place + 2]
        if after and after in "!?":
            for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(mark, place):
                    end = source.find(close, place + len(mark))
                    return (len(source) if end < 0 else end + len(close)), "", "", False
            end = source.find(">", place)
            return None if end < 0 else (end + 1, "", "", False)
        closing = after == "/"
        begin = place + 1 + closing
        first = source[begin : begin + 1]
        if not (first.isascii() and first.isalpha()):
            return None
        stop = self.names.of(begin)
        end = self.end(stop)
        return None if end < 0 else (end + 1, source[begin:stop].lower(), source[stop:end], closing)


def parse(page: str | None) -> Node:
    """The tree of a page's block elements; text of inline elements belongs to the block around them."""
    root = Node("#page", [], None, 0, 0)
    block, stack, pos, order, links, silent = root, [], 0, 0, 0, 0
    opened: Counter[str] = Counter()  # names on the stack
    source = page or ""

    def put(text: str, entities: bool = True) -> None:
        nonlocal order
        if text and not silent:
            text = html.unescape(text) if entities and "&" in text else text
            order += 1
            block.texts.append((order, text))
            if links:
                block.link_chars += len(text.strip())

    def pop() -> None:
        nonlocal block, links, silent
        tag, node = stack.pop()
        opened[tag] -= 1
        if node is not None:
            block = node.parent
        if tag == "a":
            links -= 1
        if tag in SILENT:
            silent -= 1

    tags, at = _Tags(source), 0
    while (at := source.find("<", at)) >= 0:
        if (found := tags.at(at)) is None:
            at += 1
            continue
        put(source[pos:at])
        pos, tag, attributes, closing = found
        at = pos
        if not tag:
            continue
        if closing:
            if tag == "br" or tag == "p" and not opened["p"]:
                put(" ")
            elif opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            block.inputs += tag == "input"
            if tag in ("br", "hr", "img", "input", "wbr"):
                put("" if tag == "wbr" else " ")
            continue
        closes = _ENDS.get(tag, frozenset())
        if tag in _CLOSE_P and opened["p"]:
            closes = closes | {"p"}
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                t, node = stack[k]
                if t in closes:
                    while len(stack) > k:
                        pop()
                    break
                if node is not None and t not in ("tr", "tbody", "thead", "tfoot") and t != "p":
                    break
        node = None
        if tag not in INLINE or tag == "ins" and attributes.strip():  # with attributes, ins is a common advert slot
            order += 1
            node = Node(tag, tokens_of(attributes) if attributes else [], block, order, block.depth + 1)
            block.children.append(node)
            block = node
        else:
            block.tags += 1
        stack.append((tag, node))
        opened[tag] += 1
        links += tag == "a"
        silent += tag in SILENT
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
            at = pos = end.end() if end else len(source)
            pop()
    put(source[pos:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out
