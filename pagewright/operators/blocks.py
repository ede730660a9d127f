"""Repeated blocks: the parts of a page that each describe one record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..rules import Rule
from . import dom
from .dom import Node
from .tagging import Tagged


@dataclass
class Block:
    node: Node
    values: dict[str, list[str]]
    group: int = -1
    parent: Node | None = None

    @property
    def alias(self) -> str | None:
        return next(iter(self.values.get("alias", [])), None)


class Finder:
    def __init__(self, tagged: Tagged, rules: Sequence[Rule], max_tag_distance: int = 2):
        self.tagged, self.rules, self.most = tagged, rules, max_tag_distance
        self.required = {r.name for r in rules if r.required}
        self.anti = {r.name for r in rules if r.has("anti_attribute")}
        self.main, self.other = tagged.counts(), tagged.counts(fallback=True)

    def labels(self, node: Node) -> set[str]:
        return {*self.main.get(node.index, ()), *self.other.get(node.index, ())} if node.kind == "element" else set()

    def complete(self, node: Node) -> bool:
        return node.kind == "element" and self.required <= self.labels(node)

    def inner(self, node: Node) -> list[Node]:
        """Children that are left once what holds no label is cut off."""
        return [c for c in node.children if self.labels(c)]

    def candidates(self) -> list[Node]:
        """The deepest nodes with all required labels, breadth first; the root if no child of it has them."""
        out, todo = [], [self.tagged.root]
        while todo:
            node = todo.pop(0)
            full = [c for c in self.inner(node) if self.complete(c)]
            todo += full
            if not full:
                out.append(node)
        return out

    def value_lists(self, *nodes: Node) -> dict[str, list[str]]:
        """Of these nodes together: main values, else fallback ones, else the default."""
        out = {}
        for r in self.rules:
            found = [v for n in nodes for v in self.tagged.values(n, r.name)] or [v for n in nodes for v in self.tagged.values(n, r.name, fallback=True)]
            out[r.name] = found or ([r.default] if r.default is not None else [])
        return out

    def alias(self, node: Node) -> str | None:
        found = self.tagged.values(node, "alias") or self.tagged.values(node, "alias", fallback=True)
        return found[0] if found else None

    def moved_up(self, node: Node) -> Node:
        """The highest node around a block that still holds no other record."""
        while node.parent is not None and node.tag != "body":
            for other in self.inner(node.parent):
                if other is not node and self.complete(other) and self.alias(other) not in (None, self.alias(node)):
                    return node
            node = node.parent
        return node

    def blocks(self, absorb: bool = False) -> list[Block]:
        """Blocks of a page; with ``absorb`` the first one takes in what stands beside it."""
        found = self.candidates()
        if len(found) > 1:
            found = [self.moved_up(n) for n in found]
        parts = [[n] for n in found]
        if absorb and parts:
            parts[0] += self.beside(found[0], found)
        parts = [p for p in parts if not any(self.anti & set(self.main.get(n.index, ())) for n in p)]
        return [Block(p[0], self.value_lists(*p)) for p in parts]

    def beside(self, node: Node, all_: list[Node]) -> list[Node]:
        """The elements next to a block that neither are nor hold a block."""
        others = node.parent.children if node.parent is not None else []
        return [o for o in others if o.kind == "element" and not any(o is b or any(o is up for up in b.ancestors()) for b in all_)]

    def whole(self) -> Block:
        """The record read from the whole page."""
        return Block(self.tagged.root, self.value_lists(self.tagged.root))

    def largest_group(self, blocks: Sequence[Block]) -> list[Block]:
        """Around each block not yet in a group, all blocks within the distance; the first of the largest groups."""
        if not blocks:
            return []
        paths, groups = [dom.path(b.node) for b in blocks], []
        grouped: set[int] = set()
        for a in range(len(blocks)):
            if a not in grouped:
                near = [b for b in range(len(blocks)) if dom.distance(paths[a], paths[b]) <= self.most]
                grouped.update(near)
                groups.append(near)
        best = max(groups, key=len)
        parent = dom.common_parent([blocks[k].node for k in best]) or blocks[best[0]].node
        for k in best:
            blocks[k].group, blocks[k].parent = groups.index(best), parent
        return [blocks[k] for k in best]

    def first_aliases(self, blocks: Sequence[Block]) -> list[Block]:
        seen, out = set(), []
        for b in blocks:
            if b.alias not in seen:
                seen.add(b.alias)
                out.append(b)
        return out

    def records(self, known: Sequence[str] = ()) -> list[Block]:
        """Blocks, one for each alias, of the largest group, that aren't known."""
        return [b for b in self.largest_group(self.first_aliases(self.blocks())) if b.alias not in set(known)]
