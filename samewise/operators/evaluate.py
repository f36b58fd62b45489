"""Match quality against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unordered(pairs: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """Distinct pairs with the smaller id first."""
    return pairs.where(F.col(id1).isNotNull() & F.col(id2).isNotNull()).select(F.least(id1, id2).alias("id1"), F.greatest(id1, id2).alias("id2")).distinct()


def pairs_quality(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (candidates, truth, found, pc, pq): pairs completeness found/truth and pairs quality found/candidates.

    Both frames are (id1, id2); repeats and order don't count. A ratio with nothing below is null.
    """
    marks = unordered(candidates).withColumn("c", F.lit(1)).withColumn("t", F.lit(0)).unionByName(unordered(truth).withColumn("c", F.lit(0)).withColumn("t", F.lit(1)))
    pairs = marks.groupBy("id1", "id2").agg(F.max("c").alias("c"), F.max("t").alias("t"))
    sums = pairs.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in (("c", "candidates"), ("t", "truth"), (F.col("c") * F.col("t"), "found"))))
    return sums.withColumns({"pc": F.try_divide("found", "truth"), "pq": F.try_divide("found", "candidates")})


def translate_pairs(pairs: DataFrame, left_ids: DataFrame, right_ids: DataFrame) -> DataFrame:
    """External pairs (id1, id2) in internal ids, by two maps (external, internal); pairs with an unknown side are dropped."""
    a = left_ids.select(F.col("external").alias("id1"), F.col("internal").alias("a"))
    b = right_ids.select(F.col("external").alias("id2"), F.col("internal").alias("b"))
    return pairs.join(a, "id1").join(b, "id2").select(F.col("a").alias("id1"), F.col("b").alias("id2"))
