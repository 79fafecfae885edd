"""A small element tree for one page, with the few selector forms that profiles use.

Selectors: ``tag``, ``.class``, ``#id``, ``[attr]`` and their chains, descendants (blank) and
children (``>``).  An end tag closes up to its nearest open start tag, or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_PART = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)\]|(\*)")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip: set[int]) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif id(item) not in skip and item.tag not in _HIDDEN:
                stack.extend(reversed(item.children))

    def text(self, skip: set[int] = frozenset()) -> str:
        """Strings stripped and joined by one blank; subtrees in ``skip`` left out."""
        return " ".join(s for s in (part.strip() for part in self.strings(skip)) if s)

    def select(self, selector: str) -> Iterator[Node]:
        steps = selector.replace(">", " > ").split()
        return (node for node in self.walk() if _matches(node, steps))


def _fits(node: Node, step: str) -> bool:
    for kind, name, attribute, _ in _PART.findall(step):
        if kind == "." and name not in node.attrs.get("class", "").split():
            return False
        if kind == "#" and node.attrs.get("id") != name:
            return False
        if attribute and attribute not in node.attrs:
            return False
        if not kind and name and node.tag != name.lower():
            return False
    return True


def _matches(node: Node | None, steps: list[str]) -> bool:
    if node is None or not _fits(node, steps[-1]):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if rest[-1] == ">":
        return _matches(node.parent, rest[:-1])
    above = node.parent
    while above is not None:
        if _matches(above, rest):
            return True
        above = above.parent
    return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.joined = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.children.append(node)
        self.joined = False
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        node = self.here
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        if self.joined:
            self.here.children[-1] += data
        else:
            self.here.children.append(data)
            self.joined = True

    def handle_comment(self, data: str) -> None:
        self.joined = False

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def first(root: Node, selector: str) -> Node | None:
    return next(root.select(selector), None)


def content(root: Node, selectors: list[str], strip: list[str], floor: int) -> tuple[str | None, list[str]]:
    """Text of the first selector that holds at least ``floor`` characters, and what fell short."""
    short: list[str] = []
    for selector in selectors:
        node = first(root, selector)
        if node is None:
            continue
        skip = {id(hit) for pattern in strip for hit in node.select(pattern)}
        text = node.text(skip)
        if len(text) >= floor:
            return text, short
        short.append(f"{selector!r} matched but held only {len(text)} chars")
    return None, short
