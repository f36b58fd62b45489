"""Which condition of an AND-block generates its candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.statistics import gram_entropy, token_entropy
from samewise.plans.rules import JS, Condition, Rule

#: Jaccard conditions always come before edit distances; then by the statistic named, ascending or descending.
ORDERS = ("threshold_desc", "threshold_asc", "entropy_desc", "entropy_asc", "block_size_asc", "block_size_desc")


def _mean_block(c: Condition, frame: DataFrame, q: int) -> float:
    """Postings for each distinct token or q-gram: what a look-up costs."""
    from samewise.functions.text import qgrams

    items = F.col("tokens") if c.kind == JS else F.transform(qgrams(F.col("value"), q), lambda g: g["gram"])
    row = frame.select(F.explode(items).alias("x")).agg(F.count("*").alias("n"), F.approx_count_distinct("x").alias("d")).first()
    return row["n"] / max(row["d"], 1)


def _entropy(c: Condition, frame: DataFrame, q: int) -> float:
    row = (token_entropy(frame, F.col("tokens")) if c.kind == JS else gram_entropy(frame, F.col("value"), q)).first()
    return row["entropy"] or 0.0


def order_blocks(rule: Rule, order: str, frame: Callable[[Condition], DataFrame], q: int = 2) -> Rule:
    """The rule with the conditions of each block in the order in which they should be tried; its meaning stays the same.

    Statistics are single-row aggregates, taken only if a block has several conditions and the order needs them.
    """
    name, _, direction = order.rpartition("_")
    several = {c for b in rule.blocks if len(b) > 1 for c in b}
    value = {c: {"threshold": lambda c: c.threshold, "entropy": lambda c: _entropy(c, frame(c), q), "block_size": lambda c: _mean_block(c, frame(c), q)}[name](c) for c in several}

    def key(c: Condition) -> tuple:
        v = value[c]
        if name == "threshold" and c.kind != JS:
            v = -v  # the fewer edits, the stricter
        return c.kind != JS, -v if direction == "desc" else v

    return Rule(tuple(tuple(sorted(b, key=key)) if len(b) > 1 else b for b in rule.blocks))
