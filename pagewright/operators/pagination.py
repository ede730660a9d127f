"""Candidates for the next page's button; clicking is left to whoever fetches pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from . import dom
from .dom import Node

#: The number words from which larger ones are put together.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(n: int) -> str:
    """English words of a number below a million."""
    if n < 20:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{ONES[n % 10]}" if n % 10 else "")
    rest = f" and {number_words(n % 100)}" if n % 100 else ""
    if n < 1000:
        return f"{ONES[n // 100]} hundred{rest}"
    if n >= 1_000_000:
        return str(n)
    rest = (", " if n % 1000 >= 100 else " and ") + number_words(n % 1000) if n % 1000 else ""
    return f"{number_words(n // 1000)} thousand{rest}"


def page_numbers(current: int, most: int) -> list[int]:
    return list(range(max(1, current - 2), min(most, current + 2) + 1))


def names(text: str, n: int) -> bool:
    """Whether a text is exactly this number, in digits or words (with or without a hyphen)."""
    text, spelled = text.strip().lower(), number_words(n)
    return text in (str(n), spelled, spelled.replace("-", " "), spelled.replace("-", ""))


def clickable(node: Node, tags: Sequence[str]) -> Node:
    """The node or its nearest ancestor within five steps that can be clicked; else the node."""
    up = node
    for _ in range(6):
        if up is None or up.kind != "element":
            break
        if up.tag in tags:
            return up
        up = up.parent
    return node


def buttons(root: Node, n: int, tags: Sequence[str], after: int = -1) -> list[Node]:
    """What to click for a page number, below the last block only; a script's text is none."""
    found = [clickable(t.parent, tags) for t in root.texts() if t.parent is not None and t.parent.kind == "element" and names(t.text, n)]
    return [b for b in found if b.index > after and b.tag != "script"]


def blank(root: Node, blocks: Sequence[int]) -> None:
    """Empties the elements with these numbers, so that nothing in a block is taken for a button."""
    gone = set(blocks)
    for node in root.elements():
        if node.index in gone:
            node.children = []


def selector(node: Node) -> list[str]:
    """Steps from the top: name and classes, those that begin with a digit without it."""
    steps = [n for n in (node, *node.ancestors()) if n.kind == "element"][::-1]
    return [n.tag + "".join("." + re.sub(r"^\d", "", c) for c in n.attrs.get("class", "").split() if re.sub(r"^\d", "", c)) for n in steps]


def pager(root: Node, current: int, most: int, tags: Sequence[str], after: int = -1, block_parent: Node | None = None, max_distance: int = 6, classes: Sequence[str] = (), levels: int = 3) -> Node | None:
    """The button of the next page: one near a button of this page, in a pager by its classes (whole words in any
    case) if any is, nearest to the blocks' parent."""
    own = {n: buttons(root, n, tags, after) for n in page_numbers(current, most)}
    nexts = own.get(current + 1, [])
    here = [dom.path(b) for b in own.get(current, [])]
    near = [b for b in nexts if any(dom.distance(dom.path(b), p) <= max_distance for p in here)]
    marked = [b for b in near if any(re.search(rf"\b{c}\b", " > ".join(selector(b)[-levels:]), re.IGNORECASE) for c in classes)]
    near = marked or near
    if not near:
        return None
    if block_parent is None:
        return near[0]
    goal = dom.path(block_parent)
    return min(near, key=lambda b: min(998, dom.distance(dom.path(b), goal)))


def view_more(root: Node, aliases: Sequence[str], tags: Sequence[str]) -> list[Node]:
    tests = [re.compile(a, re.IGNORECASE) for a in aliases]
    return [clickable(t.parent, tags) for t in root.texts() if t.parent is not None and any(p.search(t.text) for p in tests)]
