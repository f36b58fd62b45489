"""Matching rules: conditions combined by & and |, kept as an OR of AND-blocks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

JS, ED = "JS", "ED"


@dataclass(frozen=True)
class Condition:
    """Token Jaccard similarity >= threshold (JS) or edit distance <= threshold (ED) of an attribute, or of one on each side."""

    left: str
    kind: str
    threshold: float
    right: str

    def __post_init__(self) -> None:
        if self.kind not in (JS, ED):
            raise ValueError(f"unknown similarity {self.kind!r}: it must be JS or ED")
        if self.kind == JS and not 0 < self.threshold <= 1:
            raise ValueError("a Jaccard threshold must be above 0 and at most 1")
        if self.kind == ED and self.threshold < 0:
            raise ValueError("an edit distance can't be negative")

    @property
    def edits(self) -> int:
        return int(self.threshold)


@dataclass(frozen=True)
class Rule:
    """An OR of AND-blocks. ``a & b`` and ``a | b`` combine rules to any depth; & distributes over |."""

    blocks: tuple[tuple[Condition, ...], ...]

    def __and__(self, other: Rule) -> Rule:
        return Rule(tuple(dict.fromkeys(tuple(dict.fromkeys(a + b)) for a in self.blocks for b in other.blocks)))

    def __or__(self, other: Rule) -> Rule:
        return Rule(tuple(dict.fromkeys(self.blocks + other.blocks)))

    @property
    def conditions(self) -> list[Condition]:
        """The distinct conditions in order of appearance."""
        return list(dict.fromkeys(c for b in self.blocks for c in b))


def js(left: str, threshold: float, right: str | None = None) -> Rule:
    """Jaccard similarity of the token sets is at least ``threshold``; ``right`` names the other table's attribute if it differs."""
    return Rule(((Condition(left, JS, float(threshold), right or left),),))


def ed(left: str, threshold: float, right: str | None = None) -> Rule:
    """The edit distance of the normalised texts is at most ``threshold``."""
    return Rule(((Condition(left, ED, float(threshold), right or left),),))


def any_of(rules: Iterable[Rule]) -> Rule:
    out = Rule(())
    for r in rules:
        out = out | r
    return out


def all_of(rules: Iterable[Rule]) -> Rule:
    out = Rule(((),))
    for r in rules:
        out = out & r
    return out


def from_tuples(blocks: Iterable[Iterable[tuple]]) -> Rule:
    """From blocks of (left, right, kind, threshold), the form of rules between two tables."""
    return any_of(all_of(Rule(((Condition(a, kind, float(t), b),),)) for a, b, kind, t in block) for block in blocks)


def parse_rule(text: str) -> Rule:
    """From text: conditions ``attribute|kind|threshold`` joined by commas; AND-blocks are separated by semicolons."""

    def condition(part: str) -> Rule:
        name, kind, threshold = (x.strip() for x in part.split("|"))
        return Rule(((Condition(name, kind.upper(), float(threshold), name),),))

    return any_of(all_of(condition(c) for c in block.split(",")) for block in text.split(";"))


def from_rows(rows: Iterable) -> Rule:
    """From rows (and_block, attr_name, rule_type, threshold) of one rule."""
    blocks: dict = {}
    for r in rows:
        blocks.setdefault(r["and_block"], []).append((r["attr_name"], r["attr_name"], r["rule_type"].upper(), r["threshold"]))
    return from_tuples(blocks[k] for k in sorted(blocks))
