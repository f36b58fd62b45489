"""Statistics of tokens, q-grams and prefix indexes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import normalize, qgrams, tokens
from samewise.plans.rules import JS, Rule


def ranked(counts: DataFrame, item: str, count: str) -> DataFrame:
    """The counts with ``rank``, 0 for the rarest, ties by item.

    The order is global, but no task sees more than its range: rows are range-partitioned, numbered within partitions, and
    offset by the sizes of the partitions before, of which there are as many as partitions.
    """
    parts = counts.repartitionByRange(F.col(count), F.col(item)).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part").orderBy(count, item)
    numbered = parts.withColumn("__row", F.row_number().over(within))
    sizes = numbered.groupBy("__part").agg(F.max("__row").alias("__size"), F.min(F.struct(count, item)).alias("__first"))
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select(F.col("__part"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return numbered.join(F.broadcast(offsets), "__part").withColumn("rank", (F.col("__row") - 1 + F.col("__before")).cast("long")).drop("__part", "__row", "__before")


def entropy(items: DataFrame, *by: str) -> DataFrame:
    """One row with ``entropy``: Shannon's, base 2, of the distribution of the distinct values of ``by``; null without rows.

    Counted once with partial aggregation; sum(p log2 p) follows from the sums of n log2 n and of n.
    """
    counts = items.groupBy(*by).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select((F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def token_entropy(frame: DataFrame, tokens: Column) -> DataFrame:
    """Entropy of the tokens of all records."""
    return entropy(frame.select(F.explode(tokens).alias("token")), "token")


def gram_entropy(frame: DataFrame, value: Column, q: int) -> DataFrame:
    """Entropy of the positional q-grams, that is of pairs (gram, position)."""
    grams = frame.select(value.alias("v")).select(F.explode(qgrams(F.col("v"), q)).alias("g"))
    return entropy(grams.select("g.gram", "g.pos"), "gram", "pos")


def block_statistics(postings: DataFrame, key: str) -> DataFrame:
    """One row (blocks, postings, mean_size, largest) over the blocks of at least two postings."""
    sizes = postings.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"))


def condition_counts(df: DataFrame, rule: Rule, q: int = 2) -> DataFrame:
    """(kind, attr, item, n): occurrences of the tokens (JS, counted once a record) and q-grams (ED) of every attribute of a rule, in one pass."""

    def cell(name: str, kind: str) -> Column:
        value = normalize(F.col(f"`{name}`").cast("string"))
        items = tokens(value) if kind == JS else F.transform(qgrams(value, q), lambda g: g["gram"])
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("attr"), x.alias("item")))

    cells = [cell(*key) for key in dict.fromkeys((c.left, c.kind) for c in rule.conditions)]
    rows = df.select(F.explode(F.flatten(F.array(*cells))).alias("x")).select("x.*")
    return rows.groupBy("kind", "attr", "item").agg(F.count("*").alias("n"))


def attribute_clusters(df: DataFrame, id_col: str, least: float = 0.3) -> list[tuple[list[str], float]]:
    """Clusters of attributes whose vocabularies are alike, each with the entropy of its tokens.

    Attributes are linked to the most similar one (ties: the first by name) if the Jaccard similarity of their token sets is at least
    ``least``; linked ones form a cluster, others are clusters of their own. Attributes without a token are left out. Tokens
    are reduced to the set of attributes that have them; only counts by such sets, of columns, come to the driver.
    """
    names = sorted(c for c in df.columns if c != id_col)
    if not names:
        return []

    def cell(k: int) -> Column:
        own = F.coalesce(tokens(normalize(F.col(f"`{names[k]}`").cast("string"))), F.array().cast("array<string>"))
        return F.transform(own, lambda t: F.struct(F.lit(k).alias("a"), t.alias("t")))

    cells = [cell(k) for k in range(len(names))]
    counted = df.select(F.explode(F.flatten(F.array(*cells))).alias("x")).select("x.*").groupBy("a", "t").agg(F.count("*").alias("n"))
    sets = counted.groupBy("t").agg(F.array_sort(F.collect_set("a")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()  # sets of columns
    size = {(a, b): sum(r["n"] for r in sets if a in r["s"] and b in r["s"]) for a in range(len(names)) for b in range(len(names))}
    alike = lambda a, b: size[a, b] / max(size[a, a] + size[b, b] - size[a, b], 1)
    group = {a: a for a in range(len(names)) if size[a, a]}
    for a in list(group):
        best = max((b for b in group if b != a), key=lambda b: (alike(a, b), -b), default=None)
        if best is not None and alike(a, best) >= least:
            old, new = max(group[a], group[best]), min(group[a], group[best])
            group = {x: new if g == old else g for x, g in group.items()}
    of = F.element_at(F.create_map(*(F.lit(x) for pair in group.items() for x in pair)), F.col("a")) if group else F.lit(0)
    counts = counted.groupBy(of.alias("g"), "t").agg(F.sum("n").alias("n")).groupBy("g").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    rows = counts.collect()  # a row a cluster
    return [([names[a] for a in group if group[a] == r["g"]], math.log2(r["t"]) - r["s"] / r["t"]) for r in sorted(rows, key=lambda r: r["g"])]
