"""A forgiving HTML reader: a page as a tree of blocks, with runs of plain sibling blocks folded."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

# How HTML treats these elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
# Blocks that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "option": {"select"}}
DEPTH = 120  # deeper elements are read as part of the element at this depth, but for those asked for

_TAG = re.compile(r"""<!--|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


@dataclass
class Node:
    """A block: its tag, class/id/role text, child blocks, and own text if it has no child blocks."""
    tag: str
    key: str = ""
    children: list[Node] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)  # of a folded run: one text per block

    @property
    def name(self) -> tuple[str, str]:
        return self.tag, self.key


class _Open:
    def __init__(self, tag: str, key: str):
        self.node, self.tag, self.buffer = Node(tag, key), tag, []

    def flush(self) -> None:
        """Text gathered so far becomes an anonymous block."""
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.node.children.append(Node("#text", texts=[text]))


def parse(page: str | None, decides: Callable[[str, str], bool] = lambda tag, key: False) -> Node:
    """The tree of a page; elements that ``decides`` names by tag and key are kept at any depth.

    One such element within another adds nothing below ``DEPTH``, which bounds the depth of the tree.
    """
    page = page or ""
    kept = 0  # of the open elements, those beyond the depth
    stack = [_Open("#page", "")]
    swallowed: dict[str, int] = {}

    def close(count: int) -> None:
        nonlocal kept
        for _ in range(count):
            kept -= len(stack) > DEPTH
            done = stack.pop()
            done.flush()
            node = done.node
            if len(node.children) == 1 and node.children[0].tag == "#text":
                node.texts, node.children = node.children[0].texts, []
            parent = stack[-1]
            parent.flush()
            if node.texts or node.children:
                parent.node.children.append(node)

    def close_to(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for up, item in enumerate(reversed(stack[1:]), 1):
            if item.tag in tags:
                close(up)
                return
            if item.tag in stop:
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!?]", rest)  # a tag that the page's end cuts off
            stack[-1].buffer.append(html.unescape(rest[:cut.start()] if cut else rest))
            break
        stack[-1].buffer.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if swallowed.get(tag):
                swallowed[tag] -= 1
            elif tag not in INLINE:
                close_to({tag}, frozenset())
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?![a-zA-Z])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                stack[-1].buffer.append(" ")
            continue
        if tag in BLOCKS:
            close_to({"p"}, BLOCKS - {"p"})
        if tag in CLOSED_BY:
            close_to(CLOSED_BY[tag], SCOPES[tag])
        stack[-1].flush()
        found = _ATTRIBUTE.findall(m[3])
        key = " ".join(sorted(v.strip("\"'").lower() for _, v in found))
        if len(stack) >= DEPTH:
            if kept >= 2 or not decides(tag, key):
                swallowed[tag] = swallowed.get(tag, 0) + 1
                continue
            kept += 1
        stack.append(_Open(tag, key))
    close(len(stack) - 1)
    stack[0].flush()
    return _folded(stack[0].node)


def _folded(root: Node) -> Node:
    """Runs of siblings of one name without inner blocks become one node with a text for each."""
    todo = [root]
    while todo:
        node = todo.pop()
        out: list[Node] = []
        for child in node.children:
            if out and not child.children and not out[-1].children and child.name == out[-1].name:
                out[-1].texts += child.texts
            else:
                out.append(child)
                if child.children:
                    todo.append(child)
        node.children = out
    return root
