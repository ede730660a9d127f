"""Attribute rules: what to look for on a page and how to read it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

#: The words with which a rule states how it works.
TAGS = (
    "labeled",
    "example_driven",
    "regex_driven",
    "text",
    "attribute",
    "table_sourced",
    "reorder_examples",
    "exclusive",
    "filtered",
    "ignore_case",
    "label_ignore_case",
    "replace_similar",
    "fallback",
    "aggregate",
    "anti_attribute",
    "translated",
)


@dataclass(frozen=True)
class Rule:
    """``examples`` or ``regex`` find values in texts or attributes; ``type`` says how they are read."""

    name: str
    type: str = "text"
    tags: frozenset[str] = frozenset()
    regex: str | None = None
    attribute_regex: str | None = None
    filter_regex: str | None = None
    prefix: str | None = None
    source: str | None = None
    examples: Sequence[str] = ()
    labels: Sequence[str] = ()
    translations: Mapping[str, str] = field(default_factory=dict)
    conversions: Sequence[tuple[str, float]] = ()
    constraints: Mapping[str, object] | None = None
    default: str | None = None
    required: bool = False

    def __post_init__(self):
        object.__setattr__(self, "tags", frozenset(self.tags))
        if unknown := self.tags - set(TAGS):
            raise ValueError(f"unknown rule tags {sorted(unknown)}")

    def has(self, tag: str) -> bool:
        return tag in self.tags

    @property
    def placeholder(self) -> str:
        return f"${self.name.upper()}$"

    def ordered_examples(self) -> list[str]:
        """No nulls; longest first if the rule asks for it."""
        own = [e for e in self.examples if e]
        return sorted(own, key=len, reverse=True) if self.has("reorder_examples") else own

    def label_rule(self) -> Rule | None:
        """The rule that marks this rule's labels before its values are looked for."""
        if not (self.has("labeled") and self.labels):
            return None
        tags = {"example_driven", "text"} | ({"ignore_case"} if self.has("label_ignore_case") else set())
        return Rule(f"{self.name}_label", tags=tags, examples=self.labels, attribute_regex=self.attribute_regex)

    def with_table(self, values: Sequence[str]) -> Rule:
        """A rule whose examples come from its source table."""
        return replace(self, examples=tuple(values)) if self.has("table_sourced") else self
