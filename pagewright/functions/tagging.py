"""Value tagging on text columns: rules applied one after another, first hit of each rule and example."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import Rule


def word_pattern(example: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + rf"\b\Q{example}\E\b"


def filtered(found: Column, pattern: str | None) -> Column:
    """What stands before the filter, stripped; unchanged where the filter finds nothing."""
    if pattern is None:
        return found
    return F.when(found.rlike(pattern), F.trim(F.regexp_replace(found, f"(?:{pattern})(?s:.*)", ""))).otherwise(found)


def replace_first(text: Column, pattern: str, label: str, filter_pattern: str | None = None, after: str | None = None) -> Column:
    """The first hit (what the filter leaves of it) becomes the label; without a hit, or without ``after`` before it,
    the text stays."""
    at, hit = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
    found = filtered(hit, filter_pattern)
    out = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(label), F.substr(text, at + F.length(found)))
    ok = (at > 0) & (found != "")
    if after is not None:
        ok &= (F.instr(text, after) > 0) & (F.instr(text, after) < at)
    return F.when(ok, out).otherwise(text)


def found_first(text: Column, pattern: str, filter_pattern: str | None = None) -> Column:
    """The value that ``replace_first`` takes out, or null."""
    hit = filtered(F.regexp_extract(text, pattern, 0), filter_pattern)
    return F.when((F.regexp_instr(text, F.lit(pattern)) > 0) & (hit != ""), hit)


def apply_rule(text: Column, rule: Rule) -> Column:
    """A rule's label pass, examples, then pattern; ``exclusive`` leaves texts with the rule's name alone.

    A text knows no other nodes: the label of a ``labeled`` rule has to stand before the value in the same text.
    """
    if not rule.has("text"):
        return text
    before, flag = text, "(?iu)" if rule.has("ignore_case") else ""
    cut = flag + rule.filter_regex if rule.has("filtered") and rule.filter_regex else None
    after = f"${rule.name.upper()}_LABEL$" if rule.has("labeled") else None
    if (label := rule.label_rule()) is not None:
        text = apply_rule(text, label)
    if rule.has("example_driven"):
        for example in rule.ordered_examples():
            text = replace_first(text, word_pattern(example, rule.has("ignore_case")), rule.placeholder, cut, after)
    if rule.has("regex_driven") and rule.regex:
        text = replace_first(text, flag + rule.regex, rule.placeholder, cut, after)
    if rule.has("exclusive"):
        text = F.when(before.rlike(flag + rf"\b{re.escape(rule.name)}\b"), before).otherwise(text)
    return text


def tag_text(text: Column, rules: Sequence[Rule]) -> Column:
    """All rules in order: later ones see the placeholders of earlier ones."""
    return reduce(apply_rule, rules, text)


def tag_attributes(attributes: Column, rule: Rule) -> Column:
    """In attributes whose name matches, every occurrence of each found value becomes the label."""
    if not rule.has("attribute") or not rule.attribute_regex:
        return attributes
    flag = "(?iu)" if rule.has("ignore_case") else ""
    patterns = [word_pattern(e, rule.has("ignore_case")) for e in rule.ordered_examples()] if rule.has("example_driven") else []
    patterns += [flag + rule.regex] if rule.has("regex_driven") and rule.regex else []

    def one(name: Column, value: Column) -> Column:
        out = value
        for p in patterns:
            hit = found_first(out, p, flag + rule.filter_regex if rule.has("filtered") and rule.filter_regex else None)
            out = F.when(hit.isNotNull(), F.trim(F.replace(out, hit, F.lit(rule.placeholder)))).otherwise(out)
        return F.when(name.rlike(rule.attribute_regex), out).otherwise(value)

    return F.transform_values(attributes, one)
