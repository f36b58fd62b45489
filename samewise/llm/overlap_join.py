"""All similar pairs of set-valued records: the size-aware overlap join."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.sketch import bucket, frequency_sketch, mix
from samewise.session import checkpoint, map_arrow

EPS = 1e-9
U = np.uint64


def overlap_needed(a: int, b: int, t: float) -> int:
    """The least number of common items of sets of sizes a and b with Jaccard >= t."""
    return math.ceil(t / (1 + t) * (a + b) - EPS)


def subset_sizes(n: int, t: float) -> list[int]:
    """The overlaps that a set of size n may need with the sets of any size it can be similar to."""
    partners = range(max(1, math.ceil(n * t - EPS)), math.floor(n / t + EPS) + 1)
    return sorted({c for m in partners if (c := overlap_needed(n, m, t)) <= min(n, m)})


def size_boundary(t: float, most_subsets: int) -> int:
    """The largest size up to which every set has at most ``most_subsets`` threshold-sized subsets in all."""
    n = 0
    while n < 64 and sum(math.comb(n + 1, c) for c in subset_sizes(n + 1, t)) <= most_subsets:
        n += 1
    return n


@lru_cache(maxsize=256)
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), c)), np.int64).reshape(-1, c)


def _small_keys(flat: np.ndarray, sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, key, needed overlap) of every threshold-sized subset of every set."""
    begins = np.cumsum(sizes) - sizes
    recs, keys, needs = [], [], []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        items = mix(flat[begins[at][:, None] + np.arange(n)])
        for c in subset_sizes(int(n), t):
            sub = items[:, _subsets(int(n), c)].sum(axis=2, dtype=U)
            recs.append(np.repeat(at, sub.shape[1]))
            keys.append(mix(sub + U(c)).ravel())
            needs.append(np.full(sub.size, c, np.int32))
    if not recs:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int32)
    return np.concatenate(recs), np.concatenate(keys), np.concatenate(needs)


def _list_keys(flat: np.ndarray, sizes: np.ndarray, t: float, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, item) of the inverted lists to be scanned for each set: its rarest items, as many as similarity can't do without."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, sketch[bucket(flat)], owner))
    place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]
    prefix = sizes - np.ceil(sizes * t - EPS).astype(np.int64) + 1
    keep = order[place < prefix[owner]]
    return owner[keep], flat[keep]


def similar_pairs(sets: DataFrame, threshold: float, most_subsets: int = 128) -> DataFrame:
    """(id1, id2, overlap), id1 < id2, of all pairs of ``sets`` (id, items array<string>, distinct, not empty) with Jaccard >= threshold.

    Up to the size boundary, where a set has at most ``most_subsets`` of them, two sets are candidates if they share a
    subset of exactly the size that their overlap must reach. A set beyond the boundary scans the inverted lists of its
    rarest items, as many as it can't be similar without, in an order of frequency from a sketch of fixed size. Both are
    exact; all candidates are verified on the items. Ids must be unique and of a type with an order.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    t, spark = threshold, sets.sparkSession
    bound = size_boundary(t, most_subsets)
    kind = sets.schema["id"].dataType.simpleString()
    hashed = sets.select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(hashed.select(F.explode("hashes").alias("h")), F.col("h")))

    def parts(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield part.column(0), part.column(1).flatten().to_numpy().view(U), sizes

    def small(batches):
        for ids, flat, sizes in parts(batches):
            at, key, need = _small_keys(flat, sizes, t)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.array(need)], names=["key", "id", "n", "need"])

    def lists(batches):
        for ids, flat, sizes in parts(batches):
            at, key = _list_keys(flat, sizes, t, sketch.value)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(at)), pa.array(sizes[at].astype(np.int32))], names=["key", "id", "n"])

    def side(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("key", *(F.col(c).alias(f"{c}{k}") for c in rows.columns if c != "key"))

    tiny = map_arrow(hashed.where(F.size("hashes") <= bound), small, f"key long, id {kind}, n int, need int")
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n1") + F.col("n2")) - F.lit(EPS))
    by_subset = side(tiny, 1).hint("merge").join(side(tiny, 2), "key").where((F.col("id1") < F.col("id2")) & (F.col("need1") == F.col("need2")) & (F.col("need1") == need)).select("id1", "id2")
    postings = map_arrow(hashed.where(F.size("hashes") >= math.ceil((bound + 1) * t - EPS)), lists, f"key long, id {kind}, n int")
    fits = (F.col("n1") >= F.col("n2") * t - EPS) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("id1") < F.col("id2"))))
    by_list = side(postings, 1).hint("merge").join(side(postings.where(F.col("n") > bound), 2), "key").where(fits).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    candidates = by_subset.unionByName(by_list).distinct()
    one = sets.select(F.col("id").alias("id1"), F.col("items").alias("i1"))
    two = sets.select(F.col("id").alias("id2"), F.col("items").alias("i2"))
    both = candidates.hint("merge").join(one, "id1").hint("merge").join(two, "id2").withColumn("overlap", F.size(F.array_intersect("i1", "i2")))
    return both.where(F.col("overlap") >= F.lit(t) * (F.size("i1") + F.size("i2") - F.col("overlap")) - EPS).select("id1", "id2", "overlap")


def record_sets(rows: DataFrame, id_col: str, item: Column) -> tuple[DataFrame, DataFrame]:
    """The distinct item sets (id, items), id being the smallest record with the set, and (rec_id, rep) of all records.

    rows: one item a row; null and blank items and null ids are ignored, repeats count once.
    """
    items = rows.select(F.col(id_col).alias("rec_id"), item.alias("item")).where("rec_id is not null and item is not null and item != ''").distinct()
    sets = items.groupBy("rec_id").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("h", F.md5(F.concat_ws("\n", "items")))
    sets = checkpoint(sets)
    reps = sets.groupBy("h").agg(F.min("rec_id").alias("rep"))
    members = checkpoint(sets.hint("merge").join(reps, "h").select("rec_id", "rep", "items"))
    return members.where("rec_id = rep").select(F.col("rep").alias("id"), "items"), members.select("rec_id", "rep")


def similar_records(rows: DataFrame, id_col: str, item: Column, threshold: float, expand_copies: bool = True) -> DataFrame:
    """(id1, id2), id1 < id2, of all records whose distinct items reach the threshold; see similar_pairs.

    Without ``expand_copies`` pairs are given between the smallest records of each distinct set only, to be used with the
    membership that record_sets returns: their number does not grow with the square of a group of copies.
    """
    sets, members = record_sets(rows, id_col, item)
    pairs = similar_pairs(sets, threshold).select("id1", "id2")
    if not expand_copies:
        return pairs
    one = members.select(F.col("rec_id").alias("a"), F.col("rep").alias("id1"))
    two = members.select(F.col("rec_id").alias("b"), F.col("rep").alias("id2"))
    across = pairs.hint("merge").join(one, "id1").hint("merge").join(two, "id2").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))
    within = one.hint("merge").join(two, F.col("id1") == F.col("id2")).where("a < b").select(F.col("a").alias("id1"), F.col("b").alias("id2"))
    return across.unionByName(within)
