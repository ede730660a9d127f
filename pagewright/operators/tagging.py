"""Value tagging on the tree: rules in order, placeholders in place of values, one hit for each value found."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from ..rules import Rule
from .dom import Node

PLACEHOLDER = re.compile(r"\$[A-Z_]+\$")


@dataclass
class Hit:
    node: Node
    label: str
    value: str
    fallback: bool


@dataclass
class Tagged:
    """A page with its hits in the order they were found."""

    root: Node
    hits: list[Hit] = field(default_factory=list)

    def values(self, node: Node, label: str, fallback: bool = False) -> list[str]:
        """The values under a label anywhere below a node, in document order."""
        own = [h for h in self.hits if h.label == label and h.fallback == fallback]
        return [h.value for n in node.walk() for h in own if h.node is n]

    def counts(self, fallback: bool = False) -> dict[int, dict[str, int]]:
        """For each element number, the labels of its subtree; in one pass up from each hit."""
        out: dict[int, dict[str, int]] = {}
        for h in self.hits:
            if h.fallback == fallback:
                for n in (h.node, *h.node.ancestors()):
                    if n.kind == "element":
                        labels = out.setdefault(n.index, {})
                        labels[h.label] = labels.get(h.label, 0) + 1
        return out


def _pattern(text: str, rule: Rule) -> re.Pattern:
    return re.compile(text, re.IGNORECASE if rule.has("ignore_case") else 0)


def _kept(found: str, rule: Rule) -> str:
    """What stands before the rule's filter, stripped; unchanged where the filter finds nothing."""
    if rule.has("filtered") and rule.filter_regex and (cut := _pattern(rule.filter_regex, rule).search(found)):
        return found[: cut.start()].strip()
    return found


def labelled(tagged: Tagged, text: Node, at: int, rule: Rule, most: int) -> bool:
    """Whether the rule's label stands before this place, below an ancestor no more than ``most`` steps up.

    Of an element's attribute the place is the element's, and the first step the element.
    """
    label, spots = f"${rule.name.upper()}_LABEL$", None
    up = text.parent if text.kind == "text" else text
    for _ in range(most + 1):
        if up is None:
            return False
        for other in up.texts():
            if label not in other.text:
                continue
            if other is text:
                if other.text.index(label) < at:
                    return True
                continue
            spots = spots or {id(n): k for k, n in enumerate(tagged.root.walk())}
            if spots[id(other)] < spots[id(text)]:
                return True
        up = up.parent
    return False


def _record(tagged: Tagged, node: Node, rule: Rule, value: str) -> None:
    if rule.name.endswith("_label"):
        return
    if rule.has("aggregate"):
        for mark in PLACEHOLDER.findall(value):
            for h in [h for h in tagged.hits if h.node is node and h.label == mark[1:-1].lower() and h.value]:
                value = value.replace(mark, h.value)
    tagged.hits.append(Hit(node, rule.name, (rule.prefix or "") + value, rule.has("fallback")))


def _texts(tagged: Tagged, rule: Rule, pattern: re.Pattern, most: int) -> list[str]:
    out = []
    for text in tagged.root.texts():
        if rule.has("exclusive") and _pattern(rf"\b{re.escape(rule.name)}\b", rule).search(text.text):
            continue
        found = pattern.search(text.text)
        if not found or not (value := _kept(found[0], rule)):
            continue
        if rule.has("labeled") and not labelled(tagged, text, found.start(), rule, most):
            continue
        text.text = text.text[: found.start()] + rule.placeholder + text.text[found.start() + len(value) :]
        _record(tagged, text.parent, rule, value)
        out.append(value)
    return out


def _attributes(tagged: Tagged, rule: Rule, pattern: re.Pattern, most: int) -> list[str]:
    if not rule.attribute_regex:
        return []
    out, names = [], re.compile(rule.attribute_regex)
    for node in tagged.root.elements():
        for name, value in node.attrs.items():
            if names.search(name) and (found := pattern.search(value)) and (hit := _kept(found[0], rule)):
                if rule.has("labeled") and not labelled(tagged, node, 0, rule, most):
                    continue
                node.attrs[name] = value.replace(hit, rule.placeholder).strip()
                _record(tagged, node, rule, hit)
                out.append(hit)
    return out


def _examples(tagged: Tagged, rule: Rule, most: int, attributes: bool) -> None:
    for example in rule.ordered_examples():
        pattern = _pattern(rf"\b{re.escape(example)}\b", rule)
        if attributes:
            _attributes(tagged, rule, pattern, most)
        else:
            _texts(tagged, rule, pattern, most)


def apply(tagged: Tagged, rule: Rule, most: int) -> None:
    """Labels, then examples in texts and attributes, then the pattern in texts and attributes."""
    if (label := rule.label_rule()) is not None:
        _examples(tagged, label, most, attributes=False)
    for attributes in (False, True):
        if rule.has("example_driven") and rule.has("attribute" if attributes else "text"):
            _examples(tagged, rule, most, attributes)
    if rule.has("regex_driven") and rule.regex:
        pattern = _pattern(rule.regex, rule)
        for attributes in (False, True):
            if rule.has("attribute" if attributes else "text"):
                found = _attributes(tagged, rule, pattern, most) if attributes else _texts(tagged, rule, pattern, most)
                if rule.has("replace_similar") and found:
                    similar = replace(rule, examples=tuple(dict.fromkeys(found)), tags=rule.tags & {"ignore_case", "exclusive", "attribute", "text", "fallback"})
                    _examples(tagged, similar, most, attributes)


def tag(root: Node, rules: Iterable[Rule], max_label_distance: int = 3) -> Tagged:
    tagged = Tagged(root)
    for rule in rules:
        apply(tagged, rule, max_label_distance)
    return tagged


def with_tables(rules: Sequence[Rule], tables: dict[str, Sequence[str]]) -> list[Rule]:
    """Rules whose examples come from tables, with those tables' values."""
    return [r.with_table(tables.get(r.source or r.name, r.examples)) for r in rules]
