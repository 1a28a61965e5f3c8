"""A small element tree over the standard HTML parser, with the selectors that page parsers need."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same group.
ENDS = {"li": ("li",), "p": ("p",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",), "dt": ("dl",), "dd": ("dl",)}


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, skip: tuple[str, ...] = ()) -> str:
        out = []
        for c in self.children:
            if isinstance(c, str):
                out.append(c)
            elif not any(c.matches(s) for s in skip):
                out.append(c.text(skip))
        return "".join(out)

    def line(self, skip: tuple[str, ...] = ()) -> str:
        return " ".join(self.text(skip).split())

    def matches(self, simple: str) -> bool:
        tag, classes, ident, attribute = _simple(simple)
        if tag and tag != self.tag:
            return False
        own = (self.attrs.get("class") or "").split()
        return all(c in own for c in classes) and (not ident or self.attrs.get("id") == ident) and (not attribute or (attribute[0] in self.attrs and (attribute[1] is None or self.attrs[attribute[0]] == attribute[1])))

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, selector: str) -> list[Node]:
        """Descendants by a chain of simple selectors; `>` asks for a child."""
        found = [self]
        steps = selector.replace(">", " > ").split()
        child = False
        for s in steps:
            if s == ">":
                child = True
                continue
            seen, out = set(), []
            for n in found:
                for d in (c for c in n.children if isinstance(c, Node)) if child else n.walk():
                    if id(d) not in seen and d.matches(s):
                        seen.add(id(d))
                        out.append(d)
            found, child = out, False
        return found

    def first(self, selector: str) -> Node | None:
        got = self.all(selector)
        return got[0] if got else None

    def next(self) -> Node | None:
        kin = [c for c in self.parent.children if isinstance(c, Node)]
        at = kin.index(self) + 1
        return kin[at] if at < len(kin) else None


@lru_cache(maxsize=512)
def _simple(s: str):
    m = re.fullmatch(r"([a-z0-9]*)((?:\.[\w-]+)*)(?:#([\w-]+))?((?:\.[\w-]+)*)(?:\[([\w:-]+)(?:=\"?([^\]\"]*)\"?)?\])?", s)
    if not m:
        raise ValueError(f"not a simple selector: {s}")
    classes = tuple(x for x in (m[2] + m[4]).split(".") if x)
    return m[1], classes, m[3], (m[5], m[6]) if m[5] else None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            n = self.now
            while n.parent is not None and n.tag not in SCOPE.get(tag, ("div", "td", "li", "section")):
                if n.tag in ENDS[tag]:
                    self.now = n.parent
                    break
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        n = self.now
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.now = n.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
