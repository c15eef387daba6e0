"""A small element tree of a page, for what regular expressions can't nest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements without an end, and those whose text isn't shown.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """The elements below, in the order of the page, without recursion: pages nest deeply."""
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Element):
                yield child
                open_.append(iter(child.children))

    def strings(self) -> Iterator[str]:
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in HIDDEN:
                open_.append(iter(child.children))

    def text(self, sep: str = " ") -> str:
        """The shown strings, each trimmed, without empty ones."""
        return sep.join(s for s in map(str.strip, self.strings()) if s)

    def all(self, test: Callable[[Element], bool]) -> Iterator[Element]:
        return (e for e in self.walk() if test(e))

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next(self.all(test), None)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inside(self, test: Callable[[Element], bool]) -> bool:
        at = self.parent
        while at is not None:
            if test(at):
                return True
            at = at.parent
        return False


class _Builder(HTMLParser):
    """An end tag closes the nearest open element of its name, and is dropped without one; a
    paragraph ends where the next one begins."""

    def __init__(self):
        super().__init__()
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self._close("p", within=("article", "div", "main", "section", "td", "li", "blockquote", "body"))
        element = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag: str, within: tuple[str, ...] = ()):
        at = self.at
        while at.parent is not None and at.tag != tag:
            if at.tag in within:
                return
            at = at.parent
        if at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
