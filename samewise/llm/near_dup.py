"""Groups of records whose word sets are similar: universe-partition pigeonhole with one-deletion neighbourhoods."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.components import connected_components
from samewise.functions.sketch import bucket, counts_batch, mix, summed
from samewise.session import checkpoint, map_arrow

EPS = 1e-9
U = np.uint64


class Scheme:
    """The size bands of a Jaccard threshold, and how the universe of words is partitioned in each.

    Sets of sizes s <= l with J >= t differ by at most H(s, l) = (1-t)/(1+t) (s+l) words. Band k holds the larger sets of
    sizes [lo_k, hi_k]; for it the universe is hashed into m_k segments. By the pigeonhole principle, if thresholds v_i in
    {-1, 0, 1} have sum(v_i + 1) >= H + 1, some segment i of the two sets differs by at most v_i words. More segments than
    the least number (``slack``) leave each record a choice of the cheapest.
    """

    def __init__(self, threshold: float, slack: float = 1.3) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.t, self.slack = threshold, slack

    def bands(self, largest: int) -> np.ndarray:
        """The smallest size of each band, up to one that is above ``largest``."""
        lows = [1]
        while lows[-1] <= largest:
            lows.append(max(lows[-1] + 1, math.floor(lows[-1] / self.t + EPS) + 1))
        return np.array(lows, np.int64)

    def differ(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return np.floor((1 - self.t) / (1 + self.t) * (small + large) + EPS).astype(np.int64)

    def segments(self, high: np.ndarray) -> np.ndarray:
        most = self.differ(high, high)
        return np.maximum(1, np.ceil((most + 1) / 2 * self.slack).astype(np.int64))

    def differ_column(self, a: Column, b: Column) -> Column:
        return F.floor(F.lit((1 - self.t) / (1 + self.t)) * (a + b) + F.lit(EPS))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, count times."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def signatures(flat: np.ndarray, sizes: np.ndarray, scheme: Scheme, role: str, sketch: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(record, key) rows of a batch of sets. flat: hashes of all words, set after set; none of the sets is empty.

    role "index": for each band in which the set may be the smaller of a pair, each segment's exact key and the key
    without each one of its words. role "probe": for the set's own band, the keys that the cheapest allocation of
    thresholds asks for, by the frequencies in ``sketch``.
    """
    lows = scheme.bands(math.floor(int(sizes.max()) / scheme.t + EPS) + 1)
    highs = np.append(lows[1:] - 1, lows[-1] * 2)
    own = np.searchsorted(lows, sizes, side="right") - 1
    last = own if role == "probe" else np.searchsorted(lows, np.floor(sizes / scheme.t + EPS).astype(np.int64), side="right") - 1
    # one instance for each record and band
    times = last - own + 1
    rec = np.repeat(np.arange(len(sizes)), times)
    band = _ranges(own, times)
    m = scheme.segments(highs)[band]
    n = sizes[rec]
    begins = (np.cumsum(sizes) - sizes)[rec]
    word = flat[_ranges(begins, n)]
    inst = np.repeat(np.arange(len(rec)), n)
    seg_at = np.cumsum(m) - m
    segment = seg_at[inst] + (mix(word ^ U(0x5851F42D4C957F2D)) % m[inst].astype(U)).astype(np.int64)
    seg_inst = np.repeat(np.arange(len(rec)), m)
    seed = mix((band[seg_inst].astype(U) << U(32)) + (np.arange(len(seg_inst)) - seg_at[seg_inst]).astype(U) + U(1))
    value = mix(word)
    total = np.zeros(len(seg_inst), U)
    np.add.at(total, segment, value)
    exact = mix(total + seed)
    fewer = mix(total[segment] - value + seed[segment])
    whole, cut = exact, mix(exact ^ U(1))  # the key of a segment as it is; the key of a segment from which a word was taken
    if role == "index":
        return rec[np.concatenate([seg_inst, inst])], np.concatenate([whole, mix(fewer ^ U(1))])
    c0 = sketch[bucket(whole)].astype(np.float64)
    more = sketch[bucket(cut)].astype(np.float64)
    np.add.at(more, segment, sketch[bucket(fewer)].astype(np.float64))
    both = more < c0
    mean = (c0 + more) / 2
    price = np.concatenate([np.where(both, mean, c0), np.where(both, mean, more)])
    owner = np.concatenate([seg_inst, seg_inst])
    second = np.arange(len(price)) >= len(seg_inst)
    order = np.lexsort((second, price, owner))
    heads = np.cumsum(2 * m) - 2 * m
    place = np.arange(len(order)) - heads[owner[order]]
    need = scheme.differ(n, n) + 1
    taken = order[place < need[owner[order]]]
    zero, one = np.zeros(len(seg_inst), bool), np.zeros(len(seg_inst), bool)
    zero[taken[taken < len(seg_inst)]] = True
    one[taken[taken >= len(seg_inst)] - len(seg_inst)] = True
    zero |= one
    deep = one[segment]
    return rec[np.concatenate([seg_inst[zero], seg_inst[one], inst[deep]])], np.concatenate([whole[zero], cut[one], fewer[deep]])


def images(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The two words of a 128-bit exclusive-or image of each set; images of two sets differ in no more bits than the sets in members."""
    place = mix(flat ^ U(0x2545F4914F6CDD1D)) & U(127)
    bit, begins = U(1) << (place & U(63)), np.cumsum(sizes) - sizes
    return [np.bitwise_xor.reduceat(np.where((place < 64) == low, bit, U(0)), begins) for low in (True, False)]


def signature_rows(sets: DataFrame, scheme: Scheme, role: str, sketch: np.ndarray | None = None) -> DataFrame:
    """(key, id, n, parity, parity2) from (id, hashes array<long>); the parities are a 128-bit exclusive-or image of the set.

    The images of two sets differ in no more bits than the sets in members. Role "count" gives rows (b, n) for the
    frequency sketch of the index keys instead, so that these needn't leave the workers to be counted.
    """
    shared = None if sketch is None else sets.sparkSession.sparkContext.broadcast(sketch)
    kind = sets.schema["id"].dataType.simpleString()

    def parts(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):  # bounds the memory of a step
                part = batch.slice(a, 2048)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield part.column(0), part.column(1).flatten().to_numpy().view(U), sizes

    def count(batches):
        yield counts_batch(signatures(flat, sizes, scheme, "index", None)[1] for _, flat, sizes in parts(batches))

    def run(batches):
        for ids, flat, sizes in parts(batches):
            at, key = signatures(flat, sizes, scheme, role, None if shared is None else shared.value)
            columns = [pa.array(key.view(np.int64)), ids.take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), *(pa.array(x[at].view(np.int64)) for x in images(flat, sizes))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "parity", "parity2"])

    if role == "count":
        return map_arrow(sets.select("id", "hashes"), count, "b int, n long")
    return map_arrow(sets.select("id", "hashes"), run, f"key long, id {kind}, n int, parity long, parity2 long")


def image_distance() -> Column:
    """The bits in which the images of both sides of a join of signature rows differ."""
    return F.bit_count(F.col("parity_1").bitwiseXOR(F.col("parity_2"))) + F.bit_count(F.col("parity2_1").bitwiseXOR(F.col("parity2_2")))


def similar_set_pairs(sets: DataFrame, threshold: float, slack: float = 1.3, label: str = "id") -> DataFrame:
    """(id1, id2), the smaller ``label`` first, of all pairs of ``sets`` (id, items array<string>, distinct and not empty) with Jaccard >= threshold.

    Nothing is dropped: the pigeonhole condition is necessary for similarity and every candidate is verified on the
    items. Costs come from a frequency sketch of fixed size. Ids (long) must be unique; labels need not be.
    """
    scheme = Scheme(threshold, slack)
    hashed = sets.select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    index = signature_rows(hashed, scheme, "index")
    sketch = summed(signature_rows(hashed, scheme, "count"))
    side = lambda rows, k: rows.select("key", *(F.col(c).alias(f"{c}{k}") for c in ("id", "n", "parity", "parity2")))
    a, b = side(index, "_1"), side(signature_rows(hashed, scheme, "probe", sketch), "_2")
    smaller = (F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("id_1") < F.col("id_2")))
    close = image_distance() <= scheme.differ_column(F.col("n_1"), F.col("n_2"))
    # exploded rows, whose size Spark can't estimate: joined by sorting, never broadcast
    near = a.hint("merge").join(b, "key").where(smaller & (F.col("n_1") >= F.col("n_2") * threshold - EPS) & close)
    candidates = near.select(F.col("id_1").alias("id1"), F.col("id_2").alias("id2")).distinct()
    one = sets.select(F.col("id").alias("id1"), F.col("items").alias("i1"), F.col(label).alias("a"))
    two = sets.select(F.col("id").alias("id2"), F.col("items").alias("i2"), F.col(label).alias("b"))
    common = F.size(F.array_intersect("i1", "i2"))
    verified = candidates.hint("merge").join(one, "id1").hint("merge").join(two, "id2").withColumn("o", common).where(F.col("o") >= F.lit(threshold) * (F.size("i1") + F.size("i2") - F.col("o")) - EPS)
    return verified.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))


def set_classes(df: DataFrame, id_col: str, items: Column) -> tuple[DataFrame, DataFrame]:
    """The distinct non-empty sets (id, rep, items), rep being the smallest record id of each, and (rec_id, rep) of all records."""
    rows = df.select(F.col(id_col).alias("rec_id"), items.alias("items")).where(F.col("rec_id").isNotNull() & (F.size("items") > 0)).withColumn("h", F.md5(F.concat_ws("\n", "items")))
    rows = checkpoint(rows)  # read twice, tokenised once
    # the serial numbers are fixed by the checkpoint; a record id would not do, as one id may come with several contents
    reps = checkpoint(rows.groupBy("h").agg(F.min("rec_id").alias("rep"), F.first("items").alias("items")).withColumn("id", F.monotonically_increasing_id()))
    return reps.select("id", "rep", "items"), rows.select("rec_id", "h").hint("merge").join(reps.select("h", "rep"), "h").select("rec_id", "rep")


def near_duplicate_groups(df: DataFrame, id_col: str, items: Column, threshold: float) -> DataFrame:
    """(id_col, group_id) of every record linked to another by Jaccard >= threshold of its items, directly or over others.

    items: an array<string> Column of distinct items in a fixed order; a record without any is similar to nothing. Exact
    copies become one representative before anything is paired. A repeated id is one record, whatever its contents, and
    links them. group_id is the smallest id reachable. Rows with a null id are ignored; an empty table gives an empty result.
    """
    sets, members = set_classes(df, id_col, items)
    pairs = similar_set_pairs(sets, threshold, label="rep").select("id1", "id2")
    links = pairs.unionByName(members.select(F.col("rec_id").alias("id1"), F.col("rep").alias("id2")))
    return connected_components(links).select(F.col("rec_id").alias(id_col), "group_id")
