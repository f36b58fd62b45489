"""Matching records as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from samewise.operators.rule_join import Side, join_sides
from samewise.plans.rules import Rule


def match_stream(stream: DataFrame, reference: DataFrame, rule: Rule, id1: str, id2: str, sink: Callable[[DataFrame, int], None], checkpoint_location: str, missing: str = "condition_false", q: int = 2, **trigger) -> StreamingQuery:
    """Joins each micro-batch of ``stream`` with ``reference`` by ``rule`` and hands (id1, id2) and the batch number to ``sink``.

    The reference is normalised, tokenised and written once, when the stream starts; what is written of a batch is deleted
    after it, so that a sink must use its pairs before it returns. A batch is repeated whole after a failure, so a sink that
    replaces by batch number gives each pair exactly once.
    """
    right = Side(reference, id2, rule.conditions, "right", missing)

    def batch(df: DataFrame, number: int) -> None:
        left = Side(df, id1, rule.conditions, "left", missing)
        try:
            sink(join_sides(left, right, rule, False, q=q), number)
        finally:
            left.free()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
