"""A small HTML tree on the standard library's parser: void elements, end tags that pop to their nearest open match, no implied end tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SELECTOR = re.compile(r'(?P<tag>[a-z][a-z0-9]*)?(?:\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:="(?P<value>[^"]*)")?\])?')


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> str:
        return " ".join(self.attrs.get("class", "").split()).lower()

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *names: str, where: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.walk() if (not names or n.name in names) and (where is None or where(n))]

    def first(self, *names: str, where: Callable[[Node], bool] | None = None) -> Node | None:
        return next((n for n in self.walk() if (not names or n.name in names) and (where is None or where(n))), None)

    def above(self, *names: str) -> Node | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def strings(self) -> Iterator[str]:
        """Texts below, those of scripts and styles only if the node is one itself."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.name not in ("script", "style", "template"):
                stack.extend(reversed(item.children))

    def text(self, between: str = " ") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def next_siblings(self) -> Iterator[Node]:
        if self.parent is not None:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            yield from (c for c in self.parent.children[at + 1 :] if isinstance(c, Node))

    def following(self) -> Node | None:
        """The next element in document order."""
        node: Node | None = next((c for c in self.children if isinstance(c, Node)), None)
        at = self
        while node is None and at is not None:
            node = next(at.next_siblings(), None)
            at = at.parent
        return node

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def attached_to(self, root: Node) -> bool:
        node: Node | None = self
        while node is not None and node is not root:
            node = node.parent
        return node is root

    def select(self, selector: str) -> list[Node]:
        """`tag`, `.class`, `#id`, `[attr]` or `[attr="value"]`."""
        m = SELECTOR.fullmatch(selector)
        if m is None:
            raise ValueError(f"unsupported selector: {selector}")

        def fits(n: Node) -> bool:
            return (m["tag"] is None or n.name == m["tag"]) and (m["cls"] is None or m["cls"] in n.attrs.get("class", "").split()) and (m["id"] is None or n.attrs.get("id") == m["id"]) and (m["attr"] is None or (m["attr"] in n.attrs and (m["value"] is None or n.attrs[m["attr"]] == m["value"])))

        return self.all(where=fits)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own[k] = v or ""
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while self.at is not self.root:
            name, self.at = self.at.name, self.at.parent
            self.open[name] -= 1
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
