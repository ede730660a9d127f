"""Page cleaning: a fixed order of steps on the tree, each of which can be left out by name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from . import dom
from .dom import Node

BLANK = re.compile(r"[\s\x00]+")
DECLARATION = re.compile(r"""(?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\))+""")
IMPORTANT = re.compile(r"!\s*important", re.IGNORECASE)
QUOTED_URL = re.compile(r"url\([\"'](.*?)[\"']\)")


@dataclass(frozen=True)
class Settings:
    invisible_tag_regex: Sequence[str] = ()
    excluded_tags: Sequence[str] = ()
    whitelisted_attributes: Sequence[str] | None = None
    flattened_tags: Sequence[str] = ()
    flattened_special_strings: Sequence[str] = ()
    redundant_punctuation_marks: Sequence[str] = ()
    punctuation_marks: Sequence[str] = ()
    empty_tags: Sequence[str] = ()
    ignored_cleaning_steps: Sequence[str] = ()


def inline_css(root: Node, s: Settings) -> None:
    """Declarations of style elements go into the style attribute of what their selectors match.

    Of one property the declaration that counts is the important one, then the
    inline one, then that of the more specific selector, then the later one.  Rules
    inside others (media queries and the like) and other at-rules don't apply.
    """
    found: dict[int, tuple[Node, list[tuple[tuple, str]]]] = {}
    order = 0
    for sheet in [n for n in root.elements() if n.tag == "style"]:
        for selectors, declarations in plain_rules(re.sub(r"(?s)/\*.*?\*/", "", sheet.content())):
            for selector in selectors.split(","):
                order += 1
                for node in dom.select(root, selector.strip()) if selector.strip() else ():
                    own = found.setdefault(id(node), (node, []))[1]
                    own += [((dom.specificity(selector), order), d) for d in DECLARATION.findall(declarations) if d.strip()]
    for node, own in found.values():
        own += [(((9, 9, 9), order + 1), d) for d in DECLARATION.findall(node.attrs.get("style", "")) if d.strip()]
        chosen: dict[str, str] = {}
        for important in (False, True):
            for _, d in sorted(own, key=lambda x: x[0]):
                if bool(IMPORTANT.search(d)) == important:
                    name = d.split(":", 1)[0].strip().lower()
                    chosen.pop(name, None)
                    chosen[name] = d.strip()
        node.attrs["style"] = "; ".join(chosen.values())


def plain_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of a sheet's outermost rules that are no at-rules."""
    out, depth, start, head = [], 0, 0, ""
    for m in re.finditer(r"[{}]", sheet):
        if m[0] == "{":
            if depth == 0:
                head, start = sheet[start : m.start()].rsplit(";", 1)[-1].strip(), m.end()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                if head and not head.startswith("@"):
                    out.append((head, sheet[start : m.start()]))
                start = m.end()
    return out


def inline_images(root: Node, s: Settings) -> None:
    for node in root.elements():
        if "background" in node.attrs.get("style", "") and (url := QUOTED_URL.search(node.attrs["style"])):
            node.append(Node("element", "img", {"src": url[1]}))


def remove_comments(root: Node, s: Settings) -> None:
    for node in [n for n in root.walk() if n.kind == "comment"]:
        node.remove()


def remove_invisible_tags(root: Node, s: Settings) -> None:
    tests = [re.compile(x) for x in s.invisible_tag_regex]
    for node in root.elements():
        if "hidden" in node.attrs or ("style" in node.attrs and any(t.search(node.attrs["style"]) for t in tests)):
            if any(up is root for up in node.ancestors()):
                node.remove()


def remove_excluded_tags(root: Node, s: Settings) -> None:
    """A line break keeps the words around them apart."""
    for selector in s.excluded_tags:
        for node in dom.select(root, selector):
            if any(up is root for up in node.ancestors()):
                node.replace("\n")


def remove_non_whitelisted_attributes(root: Node, s: Settings) -> None:
    if s.whitelisted_attributes is not None:
        for node in root.elements():
            node.attrs = {k: v for k, v in node.attrs.items() if k in s.whitelisted_attributes}


def joined(a: str, b: str) -> str:
    return " ".join(x.strip() for x in (a, b) if x)


def flatten(node: Node) -> None:
    """A node becomes its text, joined with the texts beside it by one blank."""
    parent = node.parent
    if parent is None:
        return
    at, text = node.place(), node.content().strip()
    if at + 1 < len(parent.children) and parent.children[at + 1].kind == "text":
        text = joined(text, parent.children[at + 1].text)
        parent.children[at + 1].remove()
    if at and parent.children[at - 1].kind == "text":
        text = joined(parent.children[at - 1].text, text)
        parent.children[at - 1].remove()
    if text:
        node.replace(text)
    else:
        node.remove()


def flatten_text(root: Node, s: Settings) -> None:
    for selector in s.flattened_tags:
        for node in dom.select(root, selector):
            if node.parent is not None and all(n.tag in s.flattened_tags for n in node.elements()):
                flatten(node)


def flatten_special_strings(root: Node, s: Settings) -> None:
    for special in s.flattened_special_strings:
        for text in [t for t in root.texts() if t.text == special]:
            if text.parent is not None and text.parent.parent is not None:
                for child in list(text.parent.parent.children):
                    if child.parent is not None:
                        flatten(child)


def _rewrite(root: Node, pattern: re.Pattern, by: str) -> None:
    for t in root.texts():
        t.text = pattern.sub(lambda m: by, t.text)


def remove_redundant_punctuation(root: Node, s: Settings) -> None:
    for mark in s.redundant_punctuation_marks:
        _rewrite(root, re.compile(rf"\s*{re.escape(mark)}\s*"), " ")


def remove_punctuation_whitespace(root: Node, s: Settings) -> None:
    for mark in s.punctuation_marks:
        _rewrite(root, re.compile(rf"\s+{re.escape(mark)}"), mark)


def remove_duplicate_whitespace(root: Node, s: Settings) -> None:
    _rewrite(root, BLANK, " ")


def remove_empty_tags(root: Node, s: Settings) -> None:
    """Elements without anything but blanks, from the bottom up; some names may stay empty."""
    todo = root.elements()[::-1]
    while todo:
        again = []
        for node in todo:
            filled = any(c.kind != "text" or c.text.strip() for c in node.children)
            if node.parent is not None and node is not root and not filled and node.tag not in s.empty_tags:
                if node.parent.kind == "element":
                    again.append(node.parent)
                flatten(node)
        todo = again


STEPS = (
    inline_css,
    inline_images,
    remove_comments,
    remove_invisible_tags,
    remove_excluded_tags,
    remove_non_whitelisted_attributes,
    flatten_text,
    flatten_special_strings,
    remove_redundant_punctuation,
    remove_punctuation_whitespace,
    remove_duplicate_whitespace,
    remove_empty_tags,
)


def clean(root: Node, s: Settings) -> Node:
    """All steps in order; after the style sheets are applied only the body counts."""
    for step in STEPS:
        if step.__name__ not in s.ignored_cleaning_steps:
            step(root, s)
        if step is inline_css:
            root = dom.body(root)
    return root
