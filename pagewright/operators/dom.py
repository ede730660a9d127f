"""A page as a small mutable tree; only what has to be rewritten in document order works on it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

#: Elements without content, and those that end an open one of the same name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())


class Node:
    """An element, a text or a comment.  Identity, not content, tells nodes apart."""

    __slots__ = ("attrs", "children", "index", "kind", "parent", "tag", "text")

    def __init__(self, kind: str, tag: str | None = None, attrs: dict[str, str] | None = None, text: str = ""):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.index = -1

    def append(self, node: Node) -> Node:
        node.parent = self
        self.children.append(node)
        return node

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, as they are when reached."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> list[Node]:
        """All elements below this one."""
        return [n for n in self.walk() if n.kind == "element" and n is not self]

    def texts(self) -> list[Node]:
        return [n for n in self.walk() if n.kind == "text"]

    def content(self) -> str:
        return "".join(n.text for n in self.texts())

    def place(self) -> int:
        return next(k for k, n in enumerate(self.parent.children) if n is self)

    def remove(self) -> None:
        del self.parent.children[self.place()]
        self.parent = None

    def replace(self, text: str) -> None:
        new = Node("text", text=text)
        new.parent = self.parent
        self.parent.children[self.place()] = new
        self.parent = None

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def html(self) -> str:
        out, todo = [], [self]
        while todo:  # nodes, and the end tags of those that are open
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.kind == "text":
                out.append(node.text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif node.kind == "comment":
                out.append(f"<!--{node.text}-->")
            else:
                if node.kind == "element":
                    attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
                    out.append(f"<{node.tag}{attrs}>")
                if node.tag not in VOID:
                    todo += [f"</{node.tag}>"] * (node.kind == "element")
                    todo.extend(reversed(node.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING and self.open[-1].tag == tag:
            self.open.pop()
        node = self.open[-1].append(Node("element", tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.kind == "text":
            last.text += data
        else:
            self.open[-1].append(Node("text", text=data))

    def handle_comment(self, data):
        self.open[-1].append(Node("comment", text=data))


def parse(html: str | None) -> Node:
    """The tree of a page: void elements close themselves, an end tag closes up to the nearest open element of its
    name, stray ones are ignored, and p, li and the like end an open one of the same name.  Elements are numbered
    in document order."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    for k, node in enumerate(builder.root.elements()):
        node.index = k
    return builder.root


def body(root: Node) -> Node:
    return next((n for n in root.elements() if n.tag == "body"), root)


# ------------------------------------------------------------------- selectors

_PART = re.compile(r"([.#]?)((?:[\w-]|[^\x00-\x7f])+|\*)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


def _simple(text: str) -> Callable[[Node], bool]:
    tests = []
    for sign, name, attr, value in _PART.findall(text):
        if attr:
            tests.append(lambda n, a=attr, v=value: a in n.attrs and (not v or n.attrs[a] == v))
        elif sign == ".":
            tests.append(lambda n, c=name: c in n.attrs.get("class", "").split())
        elif sign == "#":
            tests.append(lambda n, c=name: n.attrs.get("id") == c)
        elif name != "*":
            tests.append(lambda n, c=name.lower(): n.tag == c)
    return lambda n: n.kind == "element" and all(t(n) for t in tests)


def specificity(selector: str) -> tuple[int, int, int]:
    """How many ids, classes or attributes, and names a selector has."""
    parts = [p for step in re.sub(r"[>+~]", " ", selector).split() for p in _PART.findall(step)]
    return sum(p[0] == "#" for p in parts), sum(p[0] == "." or bool(p[2]) for p in parts), sum(not p[0] and not p[2] and p[1] != "*" for p in parts)


def matcher(selector: str) -> Callable[[Node], bool]:
    """Selectors of tag, .class, #id, *, [attribute], combined by blanks (below) or > (child), listed by commas."""
    choices = []
    for choice in selector.split(","):
        steps = re.sub(r"\s*>\s*", " > ", choice.strip()).split()
        parts, child = [], False
        for step in steps:
            if step == ">":
                child = True
                continue
            parts.append((_simple(step), child))
            child = False
        choices.append(parts)

    def fits(node: Node, parts: list, at: int) -> bool:
        test, child = parts[at]
        if not test(node):
            return False
        if at == 0:
            return True
        for up in node.ancestors():
            if fits(up, parts, at - 1):
                return True
            if child:
                return False
        return False

    return lambda node: any(parts and fits(node, parts, len(parts) - 1) for parts in choices)


def select(root: Node, selector: str) -> list[Node]:
    test = matcher(selector)
    return [n for n in root.elements() if test(n)]


# --------------------------------------------------------------------- places


def path(node: Node) -> list[str]:
    """Names from the top, with a number where several siblings share one."""
    out = []
    while node.parent is not None:
        same = [c for c in node.parent.children if c.kind == "element" and c.tag == node.tag]
        out.append(node.tag + (f"[{next(k for k, c in enumerate(same, 1) if c is node)}]" if len(same) > 1 else ""))
        node = node.parent
    return out[::-1]


def distance(a: list[str], b: list[str]) -> int:
    """Steps between two paths: 0 for the same, 1 for siblings, one more for each level of difference."""
    if a == b:
        return 0
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), max(0, min(len(a), len(b)) - 1))
    return len(a) + len(b) - 2 * same - 1


def common_parent(nodes: list[Node]) -> Node | None:
    """The lowest node above all of these."""
    shared = None
    for n in nodes:
        own = list(n.ancestors())
        shared = own if shared is None else [x for x in shared if any(x is y for y in own)]
    return shared[0] if shared else None
