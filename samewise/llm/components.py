"""Pairwise matches to groups: deterministic Borůvka hooking on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.session import checkpoint, counted, forget


def undirected(pairs: DataFrame, id1: str, id2: str) -> DataFrame:
    """Distinct edges (lo, hi), lo < hi. Null sides and loops link nothing."""
    a, b = F.col(id1), F.col(id2)
    return pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def connected_components(pairs: DataFrame, id1: str = "id1", id2: str = "id2") -> DataFrame:
    """(rec_id, group_id) of every record with an edge to another; group_id is the smallest id of its component.

    Each round, every vertex hooks onto its smallest neighbour, which is the other end of its smallest outgoing edge when
    edges are ordered by (smaller end, larger end). That order is total, so the only cycles are pairs that chose one edge,
    and the smaller vertex of that edge is the smallest of its tree: it is the root. After one step
    ``min(parent, grandparent)`` every vertex but the roots points to a smaller one, so pointer doubling ends after
    log(depth) joins. Edges are relabelled by root and deduplicated; at most half of the vertices are left for the next
    round. The rounds' maps, each at most half of the one before, are composed from the last back to the first.

    Nothing but counts comes to the driver. Minima are combined before the shuffle, so a hub costs no large group; joins
    on hub keys are left to adaptive skew splitting, as one side has one row a key. Lineage is cut in the shared
    checkpoint folder after each step. Null ids, loops, both orders and repeats are allowed; an empty table gives an empty result.
    """
    every = F.count("*")
    edges = checkpoint(undirected(pairs, id1, id2), n=every)
    rounds: list[DataFrame] = []
    while counted(edges)["n"]:
        ends = F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")), F.struct(F.col("hi").alias("x"), F.col("lo").alias("y"))))
        hook = checkpoint(edges.select(ends.alias("e")).groupBy(F.col("e.x").alias("x")).agg(F.min("e.y").alias("p")))
        tree, moved = hook, True
        while moved:
            above = tree.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            # the first step cuts the cycles of two; after it, a parent's parent is never larger
            up = F.least("p", "pp")
            joined = tree.select("x", "p").hint("merge").join(above, "p")
            step = checkpoint(joined.select("x", up.alias("p"), (F.col("p") != up).alias("moved")), n=F.count_if("moved"))
            moved = tree is hook or counted(step)["n"] > 0
            forget(tree)
            tree = step
        rounds.append(tree)
        to = lambda end: tree.select(F.col("x").alias(end), F.col("p").alias(f"{end}_root"))
        ended = edges.hint("merge").join(to("lo"), "lo").hint("merge").join(to("hi"), "hi")
        relabelled = checkpoint(undirected(ended, "lo_root", "hi_root"), n=every)
        forget(edges)
        edges = relabelled
    if not rounds:
        return edges.select(F.col("lo").alias("rec_id"), F.col("hi").alias("group_id"))
    label = rounds.pop().select("x", "p")
    while rounds:
        top = label.select(F.col("x").alias("p"), F.col("p").alias("root"))
        label = rounds.pop().hint("merge").join(top, "p", "left").select("x", F.coalesce("root", "p").alias("p"))
    return label.select(F.col("x").alias("rec_id"), F.col("p").alias("group_id"))
