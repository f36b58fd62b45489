"""Matching profiles of several sources without a common key.

Attributes become fixed bit vectors of q-grams, close pairs are found exactly by multi-index Hamming hashing, and their
field-weighted Dice scores become calibrated confidences, without labels: as a source has at most one profile of a thing,
close pairs within one source are known to be different.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.near_dup import image_distance, images, signatures
from samewise.llm.profile_fields import AUTHOR_BITS, COLUMNS, SCHEMA, TITLE_BITS, VENUE_CODES, field_columns
from samewise.functions.sketch import BUCKETS, counts_batch, frequency_sketch, mix, summed
from samewise.session import checkpoint, forget, map_arrow

U = np.uint64
#: Words of the packed vectors.
T_WORDS, A_WORDS = TITLE_BITS // 64, AUTHOR_BITS // 64
#: A venue's code tells something if at most this share of the venues has it.
TELLING = 0.1


class HammingScheme:
    """Multi-index Hamming hashing: vectors within ``radius`` agree, but for ``v_i`` bits, in some of ``chunks`` chunks of the bit order.

    v_i is -1, 0 or 1, sum(v_i + 1) = radius + 1; each probe allocates them where buckets are small. The interface is that of
    the near-duplicate Scheme, with one band of all sizes.
    """

    t = 1.0

    def __init__(self, radius: int, chunks: int) -> None:
        if 2 * chunks < radius + 1:
            raise ValueError("too few chunks for the radius")
        self.radius, self.chunks = radius, chunks

    def bands(self, largest: int) -> np.ndarray:
        return np.array([0, 1 << 40], np.int64)

    def differ(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return np.full(np.shape(small), self.radius, np.int64)

    def segments(self, high: np.ndarray) -> np.ndarray:
        return np.full(np.shape(high), self.chunks, np.int64)


def vector_rows(rows: DataFrame, words: list[str], scheme: HammingScheme, role: str, sketch: np.ndarray | None = None) -> DataFrame:
    """(key, id, src, n, parity, parity2): the keys of each vector (long columns ``words``) that has a bit, and a 128-bit image of it.

    Role "count" gives rows (b, n) for the frequency sketch of the index keys instead.
    """
    shared = None if sketch is None else rows.sparkSession.sparkContext.broadcast(sketch)
    kind = rows.schema["id"].dataType.simpleString()

    def parts(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):  # bounds the memory of a step
                part = batch.slice(a, 2048)
                packed = np.stack([part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(words))], axis=1)
                row, bit = np.nonzero(np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little"))
                sizes = np.bincount(row, minlength=len(packed))
                some = np.flatnonzero(sizes)
                if len(some):
                    yield part, some, mix(bit.astype(U) + U(1)), sizes[some]

    def count(batches):
        yield counts_batch(signatures(flat, sizes, scheme, "index", None)[1] for *_, flat, sizes in parts(batches))

    def run(batches):
        for part, some, flat, sizes in parts(batches):
            at, key = signatures(flat, sizes, scheme, role, None if shared is None else shared.value)
            take = pa.array(some[at])
            columns = [pa.array(key.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(sizes[at].astype(np.int32)), *(pa.array(x[at].view(np.int64)) for x in images(flat, sizes))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "src", "n", "parity", "parity2"])

    if role == "count":
        return map_arrow(rows.select("id", "src", *words), count, "b int, n long")
    return map_arrow(rows.select("id", "src", *words), run, f"key long, id {kind}, src int, n int, parity long, parity2 long")


def hamming_pairs(rows: DataFrame, words: list[str], scheme: HammingScheme, within: Column) -> DataFrame:
    """(id1, id2), distinct, of all pairs whose vectors differ by at most the radius: of different sources, the first from the
    one with the smaller number; and of one source, the smaller id first, if ``within`` holds for either of them.

    rows: id, src (int) and the vectors' 64-bit words. No such pair is missed; a few that are further apart are left for
    the comparison. Keys are exploded rows whose size Spark can't estimate, so they are joined by sorting, never broadcast.
    """
    index = vector_rows(rows, words, scheme, "index")
    sketch = summed(vector_rows(rows, words, scheme, "count"))
    # a profile of the first source meets others only as an index row; it asks for partners within its source alone
    asking = rows.withColumn("src", F.when(within, -1 - F.col("src")).otherwise(F.col("src"))).where(F.col("src") != 0)
    probe = vector_rows(asking, words, scheme, "probe", sketch)
    side = lambda r, k: r.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "src", "n", "parity", "parity2")))
    own = F.when(F.col("src_2") < 0, -1 - F.col("src_2")).otherwise(F.col("src_2"))
    same = F.col("src_1") == own
    wanted = (F.col("src_1") < own) | (same & (F.col("src_2") < 0) & (F.col("id_1") != F.col("id_2")))
    close = (F.abs(F.col("n_1") - F.col("n_2")) <= scheme.radius) & (image_distance() <= scheme.radius)
    found = side(index, 1).hint("merge").join(side(probe, 2), "key").where(wanted & close)
    flip = same & (F.col("id_1") > F.col("id_2"))
    return found.select(F.when(flip, F.col("id_2")).otherwise(F.col("id_1")).alias("id1"), F.when(flip, F.col("id_1")).otherwise(F.col("id_2")).alias("id2")).distinct()


def profile_rows(profiles: DataFrame, id_col: str, source_col: str, attributes_col: str) -> DataFrame:
    """One row of comparable fields a profile; of rows with one id the smallest by source and content."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *field_columns(batch.column(2))], names=["id", *COLUMNS])

    kind = profiles.schema[id_col].dataType.simpleString()
    content = F.transform(F.coalesce(F.col(attributes_col), F.array()), lambda a: F.struct(a["attr_key"].alias("attr_key"), a["attr_value"].alias("attr_value")))
    rows = profiles.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(F.col(source_col).cast("string").alias("ds"), content.alias("a")).alias("c"))
    rows = rows.groupBy("id").agg(F.min("c").alias("c")).select("id", "c.ds", "c.a")
    return map_arrow(rows, run, f"id {kind}, {SCHEMA}")


def marked(rows: DataFrame, sources: int) -> DataFrame:
    """The rows with ``common`` and ``rare`` words instead of words, and the bits of the telling venue codes (v0..v10) instead of codes.

    A word is common if more profiles have it than one thing and a variant of it can have in all sources, by a frequency
    sketch of fixed size (allowing for the mean load of its buckets). A venue code is telling if few venues have it.
    """
    spark, n = rows.sparkSession, VENUE_CODES // 64 + 1
    words = frequency_sketch(rows.select(F.explode(F.array_distinct("words")).alias("w")), F.col("w"))
    codes = np.zeros(VENUE_CODES)
    for r in rows.select(F.explode("venue").alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect():  # at most a row a code
        codes[r["v"]] = r["n"]
    venues = rows.where(F.size("venue") > 0).count()
    telling = spark.sparkContext.broadcast(codes <= max(TELLING * venues, 1.0))
    common = spark.sparkContext.broadcast(words > 2 * sources + 4 * words.mean())
    keep = [c for c in rows.columns if c not in ("words", "venue")]

    def lists(column, mask):
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(sizes)), sizes)[mask]
        counts = np.bincount(own, minlength=len(sizes))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), column.flatten().filter(pa.array(mask)))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(len(keep))
            often = common.value[w.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % BUCKETS]
            v = batch.column(len(keep) + 1)
            code = v.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(batch.num_rows), v.value_lengths().to_numpy(zero_copy_only=False))
            use = telling.value[code]
            grid = np.zeros((batch.num_rows, n * 64), np.uint8)
            grid[own[use], code[use]] = 1
            packed = np.packbits(grid, axis=1, bitorder="little").view(np.int64).reshape(batch.num_rows, n)
            columns = [*(batch.column(k) for k in range(len(keep))), lists(w, often), lists(w, ~often), *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(n))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "common", "rare", *(f"v{k}" for k in range(n))])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows.select(*keep, "words", "venue"), run, f"{kinds}, common array<int>, rare array<int>, " + ", ".join(f"v{k} long" for k in range(n)))


#: Levels of agreement of each field; each combination is a pattern, so their number is bounded whatever the data.
#: title: Dice in twentieths (21: no title); authors: share of the shorter list in tenths (11: none); place: year and venue
#: together; page: unknown, other, same; extra: common words in one title only, 0 to 3 (4: a title is cut); number: numerals
#: of the titles, none, same, other (3: a title is cut).
LEVELS = {"title": 22, "authors": 12, "place": 24, "page": 3, "extra": 5, "number": 4}
#: Levels that say that a value is missing: they weigh nothing.
SILENT = {"title": 21, "authors": 11, "place": 0, "page": 0}
#: Scores are calibrated in bins of this width, from -SPAN to SPAN.
WIDTH, SPAN = 0.5, 40.0


def compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (id1, id2) with ds1, ds2 and the levels of agreement of each field."""
    n = VENUE_CODES // 64 + 1
    side = lambda k: rows.select(*(F.col(c).alias(f"{c}_{k}" if c != "id" else f"id{k}") for c in rows.columns))
    both = pairs.hint("merge").join(side(1), "id1").hint("merge").join(side(2), "id2")
    total = lambda words: sum(words[1:], words[0])
    bits = lambda c, size, k: total([F.bit_count(F.col(f"{c}{w}_{k}")) for w in range(size)])
    shared = lambda c, size: total([F.bit_count(F.col(f"{c}{w}_1").bitwiseAND(F.col(f"{c}{w}_2"))) for w in range(size)])
    sizes = {f"{c}n_{k}": bits(c, size, k) for c, size in (("t", T_WORDS), ("a", A_WORDS), ("v", n)) for k in (1, 2)}
    both = both.withColumns(sizes | {f"{c}c": shared(c, size) for c, size in (("t", T_WORDS), ("a", A_WORDS), ("v", n))})
    cut = F.col("cut_1") | F.col("cut_2")
    least = lambda c: F.least(f"{c}n_1", f"{c}n_2")
    title = F.when(least("t") > 0, F.when(cut, F.col("tc") / least("t")).otherwise(2 * F.col("tc") / (F.col("tn_1") + F.col("tn_2"))))
    authors = F.when(least("a") > 0, F.col("ac") / least("a"))
    gap = F.abs(F.col("year_1") - F.col("year_2"))
    year = F.when((F.col("year_1") == 0) | (F.col("year_2") == 0), 0).when(gap <= 2, gap + 1).when(gap <= 5, 4).otherwise(5)
    venue = F.when(least("v") == 0, 0).when(F.col("vc") == 0, 1).when(F.col("vc") < least("v"), 2).otherwise(3)
    page = F.when((F.col("page_1") < 0) | (F.col("page_2") < 0), 0).when(F.col("page_1") == F.col("page_2"), 2).otherwise(1)
    # a common word of one title only counts, but not if it may be what another, perhaps misspelt, word of the other stands for
    only = lambda c, a, b: F.size(F.array_except(f"{c}_{a}", f"{c}_{b}"))
    alone = lambda a, b: F.greatest(F.lit(0), only("common", a, b) - only("common", b, a) - only("rare", b, a))
    extra = F.when(cut, 4).otherwise(F.least(F.lit(3), alone(1, 2) + alone(2, 1)))
    none = (F.size("numbers_1") == 0) & (F.size("numbers_2") == 0)
    number = F.when(cut, 3).when(none, 0).when(F.col("numbers_1") == F.col("numbers_2"), 1).otherwise(2)
    level = lambda c, n: F.least(F.lit(n), F.floor(c * n + F.lit(1e-9)))
    levels = {"title": F.coalesce(level(title, 20), F.lit(21)), "authors": F.coalesce(level(authors, 10), F.lit(11)), "place": year * 4 + venue, "page": page, "extra": extra, "number": number}
    return both.select("id1", "id2", F.col("ds_1").alias("ds1"), F.col("ds_2").alias("ds2"), F.coalesce(title, F.lit(0.0)).alias("title_dice"), F.coalesce(authors, F.lit(0.0)).alias("author_dice"), *(c.cast("int").alias(n) for n, c in levels.items()))


@dataclass
class Model:
    """Log shares of the levels of each field by class, the log shares of the classes, and the confidence of each bin of scores.

    The classes are matches, variants (alike in title and authors, but different things) and unrelated pairs.
    """

    shares: dict[str, np.ndarray] = field(default_factory=lambda: {n: np.zeros((3, k)) for n, k in LEVELS.items()})
    classes: np.ndarray = field(default_factory=lambda: np.zeros(3))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(int(2 * SPAN / WIDTH)))

    def logs(self, patterns: np.ndarray) -> np.ndarray:
        """[3, patterns]: the log of the share of each class and pattern."""
        return self.classes[:, None] + sum(self.shares[n][:, patterns[:, k]] for k, n in enumerate(LEVELS))

    def scores(self, patterns: np.ndarray) -> np.ndarray:
        """The log odds of a match."""
        match, *others = self.logs(patterns)
        return match - np.logaddexp(*others)

    def bins(self, patterns: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((self.scores(patterns) + SPAN) / WIDTH), 0, len(self.curve) - 1).astype(np.int64)

    def score(self) -> Column:
        def log(c: int) -> Column:
            look = [F.get(F.array(*(F.lit(float(x)) for x in w[c])), F.col(n)) for n, w in self.shares.items()]
            return sum(look, F.lit(float(self.classes[c])))

        a, b = log(1), log(2)
        return log(0) - F.greatest(a, b) - F.log1p(F.exp(-F.abs(a - b)))

    def confidence(self, score: Column) -> Column:
        bin_ = F.greatest(F.lit(0), F.least(F.lit(len(self.curve) - 1), F.floor((score + SPAN) / WIDTH)))
        return F.get(F.array(*(F.lit(float(x)) for x in self.curve)), bin_.cast("int"))


def rising(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, u in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([v, u, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else y


def fit_weights(patterns: np.ndarray, across: np.ndarray, within: np.ndarray, ratio: float = 0.0, steps: int = 200) -> Model:
    """The shares of the levels in each class, and of the classes, by expectation maximisation over patterns.

    patterns: [patterns, fields] levels; across: pairs of different sources with each, matches or not; within: pairs of one
    source, all of them different, of which there are ``ratio`` times as many across sources. The first step takes pairs
    that agree in title and authors for matches, less the different ones of that kind expected at each level, and those of
    one source for variants; all others count for matches with a tenth, but with no more than a tenth of those that agree in
    all, as unrelated pairs grow with the square of the profiles and matches don't. A missing value weighs nothing.
    """
    col = {n: patterns[:, k] for k, n in enumerate(LEVELS)}
    alike = (col["title"] >= 16) & (col["title"] < 21) & (col["authors"] >= 7)
    few = 0.1 * min(1.0, across[alike].sum() / max(across[~alike].sum(), 1.0))
    cross = np.stack([np.where(alike, 0.9, few), np.where(alike, 0.1, 0.0), np.where(alike, 0.0, 1 - few)])
    same = np.stack([np.zeros(len(alike)), alike, ~alike])
    model, different = Model(), within * max(ratio, 1.0)
    for step in range(steps):
        counts = across * cross
        # as many different pairs of each kind are expected across sources as there are within, times the ratio
        sizes = np.maximum(counts.sum(axis=1), (different * same).sum(axis=1)) + 1
        model.classes = np.log(sizes / sizes.sum())
        counts = counts + different * same
        for n, size in LEVELS.items():
            heard = col[n] != SILENT.get(n, -1)
            levels = np.stack([np.bincount(col[n][heard], c[heard], size) for c in counts])
            if step == 0:
                levels[0] = np.maximum(levels[0] - np.bincount(col[n][heard], (different * same[1])[heard], size), 0)
            if n in ("title", "authors"):
                levels = np.stack([np.convolve(x, [0.25, 0.5, 0.25], "same") for x in levels])
            logs = np.log(levels + 0.5) - np.log((levels + 0.5).sum(axis=1, keepdims=True))
            if n in SILENT:
                logs[:, SILENT[n]] = 0.0
            model.shares[n] = logs
        before, logs = cross, model.logs(patterns)
        cross = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
        same = np.concatenate([np.zeros((1, len(alike))), np.exp(logs[1:] - np.logaddexp(logs[1], logs[2]))])
        if np.abs(cross - before).max(initial=0.0) < 1e-6:
            break
    return model


def match_rate(across: np.ndarray, within: np.ndarray, ratio: float) -> np.ndarray:
    """The share of matches among the pairs across sources: what is left when the different pairs are taken away, of which
    there are ``ratio`` times as many as of one source."""
    return np.clip(1 - ratio * within / np.maximum(across, 1e-9), 0, 1)


def calibrate(scored: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ratio: float) -> np.ndarray:
    """The confidence of each bin of scores: its share of matches by match_rate, made to rise with the score.

    scored: (bins, across, within) of patterns. The probability that the scores themselves stand for counts as half a pair
    in each bin, so that a bin without pairs has that.
    """
    size = int(2 * SPAN / WIDTH)
    c, w = (sum(np.bincount(at, n, size) for at, n in ((s[0], s[k]) for s in scored)) for k in (1, 2))
    prior = 1 / (1 + np.exp(-((np.arange(size) + 0.5) * WIDTH - SPAN)))
    return np.clip(rising((c * match_rate(c, w, ratio) + 0.5 * prior) / (c + 0.5), c + 0.5), 0.001, 0.999)


def candidate_pairs(rows: DataFrame, within: Column, radius: int, title_radius: int) -> DataFrame:
    """(id1, id2) of the profiles that are compared; see match_profiles and hamming_pairs."""
    t, a = [f"t{k}" for k in range(T_WORDS // 2)], [f"a{k}" for k in range(A_WORDS // 2)]
    both = hamming_pairs(rows, t + a, HammingScheme(radius, (radius + 2) // 2), within)
    titles = hamming_pairs(rows, t, HammingScheme(title_radius, (title_radius + 2) // 2), within)
    # a profile without a title is looked up by its authors
    names = F.xxhash64(*(f"a{k}" for k in range(A_WORDS)))
    named = rows.where(" or ".join(f"a{k} != 0" for k in range(A_WORDS)))
    side = lambda r, k: r.select(names.alias("key"), F.col("id").alias(f"id_{k}"), F.col("src").alias(f"src_{k}"))
    bare = named.where(" and ".join(f"t{k} = 0" for k in range(T_WORDS)))
    found = side(named, 1).hint("merge").join(side(bare, 2), "key").where("src_1 != src_2")
    first = F.col("src_1") < F.col("src_2")
    untitled = found.select(F.when(first, F.col("id_1")).otherwise(F.col("id_2")).alias("id1"), F.when(first, F.col("id_2")).otherwise(F.col("id_1")).alias("id2"))
    return both.unionByName(titles).unionByName(untitled).distinct()


def scored_pairs(profiles: DataFrame, id_col: str, source_col: str, attributes_col: str, radius: int, title_radius: int, most_known: int) -> tuple[DataFrame, Model, dict]:
    """The compared pairs across sources with ``score`` and ``confidence``, the model, and the counts of held-out pairs."""
    raw = checkpoint(profile_rows(profiles, id_col, source_col, attributes_col))
    counts = {r["ds"]: r["n"] for r in raw.groupBy("ds").agg(F.count("*").alias("n")).collect()}  # a row a source
    names, n = sorted(counts), sum(counts.values())
    number = F.element_at(F.create_map(*(F.lit(x) for k, s in enumerate(names) for x in (s, k))), F.col("ds")) if names else F.lit(0)
    rows = checkpoint(marked(raw.withColumn("src", number), len(names)))
    forget(raw)
    chosen = min(1.0, most_known / max(n, 1))
    lot = lambda seed, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1_000_000))
    candidates = candidate_pairs(rows, lot(5, "id") < int(1_000_000 * chosen), radius, title_radius)
    pairs = checkpoint(compared(candidates, rows.drop("src")))
    forget(rows)
    fields = list(LEVELS)
    known, half = (F.col("ds1") == F.col("ds2")).alias("known"), (lot(9, "id1", "id2") < 500_000).alias("half")
    found = pairs.groupBy(*fields, known, half).agg(F.count("*").alias("n")).collect()  # a row a pattern
    patterns, of = np.unique(np.array([[r[f] for f in fields] for r in found], np.int64).reshape(-1, len(fields)), axis=0, return_inverse=True)
    tally = np.zeros((2, 2, len(patterns)))
    for r, k in zip(found, np.ravel(of), strict=True):
        tally[int(r["known"]), int(r["half"]), k] += r["n"]
    sizes = np.array(list(counts.values()), float)
    cross = (sizes.sum() ** 2 - (sizes**2).sum()) / 2
    same = ((sizes * (sizes - 1) - sizes * (1 - chosen) * np.maximum(sizes * (1 - chosen) - 1, 0)) / 2).sum()
    ratio = float(cross / same) if same > 0 else 0.0
    # each half is scored with the weights of the other; the curve of all these held-out scores goes with the weights of all
    halves = [fit_weights(patterns, *tally[:, k], ratio) for k in (0, 1)]
    model = fit_weights(patterns, *tally.sum(axis=1), ratio)
    model.curve = calibrate([(halves[1 - k].bins(patterns), *tally[:, k]) for k in (0, 1)], ratio)
    held = {"patterns": patterns, "half": halves[0], "fitted": tally[:, 0], "across": tally[0, 1], "within": tally[1, 1], "ratio": ratio}
    scored = pairs.where("ds1 != ds2").withColumn("score", model.score())
    return scored.withColumn("confidence", model.confidence(F.col("score"))), model, held


def match_profiles(profiles: DataFrame, id_col: str = "id", source_col: str = "dataset", attributes_col: str = "attributes", radius: int = 14, title_radius: int = 7, least: float = 0.5, most_known: int = 20_000) -> DataFrame:
    """(id1, id2, confidence), id1 < id2: profiles of different sources that stand for the same thing.

    Candidates are the pairs for which half of the bits of title and surnames together differ by at most ``radius``, or half
    of the title's by at most ``title_radius``; a profile without a title is compared with those that have the same
    surnames. All other fields, the year too, only weigh. Weights are fitted, and scores calibrated on pairs that are held
    out, with the pairs of one source as known different ones; at most about ``most_known`` profiles ask for partners in
    their own source. As a source has at most one profile of a thing, a pair is kept if neither side
    has a better partner in the other's source, and if its confidence is at least ``least``. Profiles without title and
    authors, null ids and null sources match nothing; an id delivered again counts once. Sources are few: their names are
    read to the driver.
    """
    scored, _, _ = scored_pairs(profiles, id_col, source_col, attributes_col, radius, title_radius, most_known)
    order = [F.desc("score"), F.desc("title_dice"), F.desc("author_dice")]
    one = Window.partitionBy("id1", "ds2").orderBy(*order, "id2")
    two = Window.partitionBy("id2", "ds1").orderBy(*order, "id1")
    best = scored.where(F.col("confidence") >= least).withColumn("a", F.row_number().over(one)).where("a = 1").withColumn("b", F.row_number().over(two)).where("b = 1")
    return best.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "confidence")


def reliability(profiles: DataFrame, id_col: str = "id", source_col: str = "dataset", attributes_col: str = "attributes", radius: int = 14, title_radius: int = 7, most_known: int = 20_000) -> DataFrame:
    """(decile, pairs, mean_confidence, match_rate): the confidences against the share of matches among pairs held out.

    The curve of confidences is fitted on the half of the pairs that the weights are fitted on, and compared with the
    other half, whose share of matches is estimated by match_rate. One row for each tenth of confidence that has pairs.
    """
    _, _, held = scored_pairs(profiles, id_col, source_col, attributes_col, radius, title_radius, most_known)
    bins = held["half"].bins(held["patterns"])
    sure = calibrate([(bins, *held["fitted"])], held["ratio"])[bins]
    decile = np.minimum((sure * 10).astype(int), 9)
    rows = []
    for k in range(10):
        at = decile == k
        c, w = held["across"][at].sum(), held["within"][at].sum()
        if c:
            rows.append((k, int(c), float((held["across"][at] * sure[at]).sum() / c), float(match_rate(c, w, held["ratio"]))))
    return profiles.sparkSession.createDataFrame(rows, "decile int, pairs long, mean_confidence double, match_rate double")
