"""Candidate pairs of one condition: prefix-filtered equi-joins on tokens and q-grams.

All frames have a column ``id`` (any type with an order). ``left`` and ``right`` may be the same frame; then ``self_join``
keeps each unordered pair once, the smaller id first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import filters
from samewise.functions.sketch import as_classes, class_of, frequency_sketch
from samewise.functions.text import numbered_repeats, qgrams
from samewise.session import checkpoint


def token_frequency(frames: list[DataFrame], tokens: str = "tokens") -> DataFrame:
    """(token, df): in how many records of all frames each token is."""
    rows = frames[0].select(F.explode(tokens).alias("token"))
    for f in frames[1:]:
        rows = rows.unionByName(f.select(F.explode(tokens).alias("token")))
    return rows.groupBy("token").agg(F.count("*").alias("df"))


def ordered_tokens(frame: DataFrame, frequency: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(id, n, ranked): the tokens of each record, rarest first, ties by token."""
    rows = frame.select("id", F.explode(tokens).alias("token")).hint("merge").join(frequency, "token")
    ranked = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    return ranked.select("id", F.size("r").alias("n"), F.transform("r", lambda x: x["token"]).alias("ranked"))


def js_postings(ranked: DataFrame, t: float) -> DataFrame:
    """(token, id, pos, n) of the prefix of each record; positions from 1."""
    prefix = F.slice("ranked", F.lit(1), filters.js_prefix_length(F.col("n"), t))
    return ranked.select("id", "n", F.posexplode(prefix).alias("pos", "token")).select("token", "id", (F.col("pos") + 1).alias("pos"), "n")


def _sides(left: DataFrame, right: DataFrame, on: list[str], self_join: bool, extra: Column) -> DataFrame:
    a = left.select(*on, *(F.col(c).alias(f"{c}1") for c in left.columns if c not in on))
    b = right.select(*on, *(F.col(c).alias(f"{c}2") for c in right.columns if c not in on))
    # keys are exploded rows, whose size Spark can't estimate: joined by sorting, never broadcast
    return a.hint("merge").join(b, on).where((F.col("id1") < F.col("id2")) & extra if self_join else extra)


def rarest_first(tokens: Column, classes: Column) -> Column:
    """The tokens, rarest first by the classes of a frequency sketch, ties by token; any fixed order gives the same pairs."""
    pairs = F.array_sort(F.transform(tokens, lambda t: F.struct(class_of(classes, t).alias("f"), t.alias("t"))))
    return F.transform(pairs, lambda x: x["t"])


def token_classes(frames: list[DataFrame], columns: list[list[str]]) -> Column:
    """The sketch of all tokens of the named columns of the frames, in one aggregation a frame's rows are counted in before they move."""
    rows = [f.select(F.explode(F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in names)))).alias("t")) for f, names in zip(frames, columns, strict=True)]
    return as_classes(frequency_sketch(reduce(DataFrame.unionByName, rows), F.xxhash64("t")))


def js_candidates(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str, float]], self_join: bool, dedup: bool = False) -> list[DataFrame]:
    """(id1, id2) that may reach each condition (left tokens, right tokens, threshold): prefix, length and position filters
    over one inverted index of the prefixes of all conditions, and a filter by 128-bit images of the sets.

    Tokens are put in order inside their row, by a frequency sketch of fixed size, so that only prefixes are shuffled. Each
    condition's postings have its number in their key. With ``dedup`` postings carry their prefixes, and a pair is given
    by its last common token only, so that no pairs are grouped.
    """
    classes = token_classes([left] if self_join else [left, right], [[c[0] for c in conditions]] if self_join else [[c[0] for c in conditions], [c[1] for c in conditions]])

    def postings(frame: DataFrame, side: int) -> DataFrame:
        cells = []
        for k, c in enumerate(conditions):
            n = F.size(c[side])
            prefix = F.slice(rarest_first(F.col(c[side]), classes), F.lit(1), F.when(n > 0, filters.js_prefix_length(n, c[2])).otherwise(0))
            images = [F.coalesce(filters.set_image(F.col(c[side]), h), F.lit(0)).alias(f"image{h}_") for h in (0, 1)]
            cells.append(F.struct(F.lit(k).alias("c"), n.alias("n"), *images, F.coalesce(prefix, F.array().cast("array<string>")).alias("prefix")))
        rows = frame.select("id", F.explode(F.array(*cells)).alias("x")).select("id", "x.*")
        if dedup:
            return rows.select("id", "n", "image0_", "image1_", "prefix", "c", F.explode("prefix").alias("token"))
        return rows.select("id", "n", "image0_", "image1_", "c", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)

    def by_condition(test) -> Column:
        out = F.lit(False)
        for k, c in enumerate(conditions):
            out = F.when(F.col("c") == k, test(c[2])).otherwise(out)
        return out

    a = postings(left, 0)
    b = a if self_join and all(c[0] == c[1] for c in conditions) else postings(right, 1)
    n1, n2 = F.col("n1"), F.col("n2")
    apart = sum((F.bit_count(F.col(f"image{h}_1").bitwiseXOR(F.col(f"image{h}_2"))) for h in (0, 1)), F.lit(0))
    pairs = _sides(a, b, ["c", "token"], self_join, by_condition(lambda t: filters.js_length(n1, n2, t) & filters.js_image(apart, n1, n2, t)))
    if dedup:
        both = F.array_intersect("prefix1", "prefix2")
        place = lambda k: F.array_position(f"prefix{k}", F.col("token"))
        pairs = pairs.where(F.col("token") == F.element_at(both, -1))
        found = pairs.where(by_condition(lambda t: filters.js_position(F.size(both), place(1), place(2), n1, n2, t)))
    else:
        merged = pairs.groupBy("c", "id1", "id2", "n1", "n2").agg(F.count("*").alias("common"), F.max("pos1").alias("p1"), F.max("pos2").alias("p2"))
        found = merged.where(by_condition(lambda t: filters.js_position(F.col("common"), F.col("p1"), F.col("p2"), n1, n2, t)))
    if len(conditions) == 1:
        return [found.select("id1", "id2")]
    return [found.where(F.col("c") == k).select("id1", "id2") for k in range(len(conditions))]


def gram_frequency(frames: list[DataFrame], q: int, value: str = "value") -> DataFrame:
    """(gram, tf): occurrences of each q-gram in all frames."""
    rows = [f.select(F.explode(qgrams(F.col(value), q)).alias("g")).select("g.gram") for f in frames]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("gram").agg(F.count("*").alias("tf"))


def ordered_grams(frame: DataFrame, frequency: DataFrame, q: int, value: str = "value") -> DataFrame:
    """(id, n, ranked array<struct<tf, gram, pos>>): the positional q-grams of each record, rarest first, ties by gram and position."""
    rows = frame.select("id", F.explode(qgrams(F.col(value), q)).alias("g")).select("id", "g.gram", "g.pos").hint("merge").join(frequency, "gram")
    ranked = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tf", "gram", "pos"))).alias("ranked"))
    return ranked.select("id", F.size("ranked").alias("n"), "ranked")


def ed_postings(ranked: DataFrame, k: int, q: int) -> DataFrame:
    """(gram, id, pos, sorted_pos, n) of the first q k + 1 grams of each record."""
    rows = ranked.select("id", "n", F.posexplode(F.slice("ranked", 1, filters.ed_prefix_length(k, q))).alias("sorted_pos", "g"))
    return rows.select("g.gram", "id", "g.pos", "sorted_pos", "n")


def deletions(value: Column, k: int) -> Column:
    """The text and all that is left of it when up to k characters are taken out. Texts with edit distance <= k share one of these."""
    out = F.array(value)
    for _ in range(k):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.concat(F.array(s), F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substr(s, i + 1)))))))
    return out


def deletion_bound(k: int, most_keys: int) -> int:
    """The largest length up to which a text has at most ``most_keys`` such rests."""
    n = 0
    while n < 10_000 and sum(math.comb(n + 1, i) for i in range(k + 1)) <= most_keys:
        n += 1
    return n


def ed_candidates(left: DataFrame, right: DataFrame, k: int, self_join: bool, q: int = 2, most_keys: int = 256) -> DataFrame:
    """(id1, id2) with edit distance <= k, from (id, value).

    Which way a pair is found depends on its lengths, so that none is costly. Both up to the length at which a text has
    ``most_keys`` rests after up to k deletions: by a common rest. Else, if both have more than q k q-grams, by one of the
    q k + 1 rarest of each at positions at most k apart; if the shorter has not, but has more than k characters, the same
    with single characters for q-grams. A pair with a text of at most k characters is left only where k is 5 or more and
    nearly all such texts match: it is found by its lengths. Keys carry the text, so that a pair is verified where it is found,
    before anything is shuffled or deduplicated.
    """
    bound = deletion_bound(k, most_keys)
    size = F.length("value")
    near = (F.abs(F.length("value1") - F.length("value2")) <= k) & filters.ed_reached(F.col("value1"), F.col("value2"), k)
    longer, shorter = F.greatest(F.length("value1"), F.length("value2")), F.least(F.length("value1"), F.length("value2"))

    def joined(keys, on: str, extra: Column) -> DataFrame:
        a = keys(left)
        return _sides(a, a if self_join else keys(right), [on], self_join, extra & near).select("id1", "id2")

    def by_gram(q: int, least: int, most: int | None) -> DataFrame:
        """Pairs whose longer text is beyond the bound and whose shorter one has least to most characters."""
        use = lambda f: f.where(size >= max(least, bound - k + 1, 1))
        frequency = gram_frequency([use(left)] if self_join else [use(left), use(right)], q)

        def keys(frame: DataFrame) -> DataFrame:
            return ed_postings(ordered_grams(use(frame), frequency, q), k, q).drop("sorted_pos").hint("merge").join(use(frame).select("id", "value"), "id")

        fits = (F.abs(F.col("pos1") - F.col("pos2")) <= k) & (F.abs(F.col("n1") - F.col("n2")) <= k) & (longer > bound)
        return joined(keys, "gram", fits if most is None else fits & (shorter <= most))

    enough = q * k + q  # the length of a text with q k + 1 q-grams
    out = [joined(lambda f: f.where(size.between(1, bound)).select(F.explode(deletions(F.col("value"), k)).alias("rest"), "id", "value"), "rest", F.lit(True)), by_gram(q, enough, None)]
    if bound - k + 1 < enough:
        out.append(by_gram(1, k + 1, enough - 1))
    if bound < 2 * k:
        tiny = lambda f: f.where(size.between(1, 2 * k)).select("id", "value", F.explode(F.sequence(size, size + k)).alias("reach"))
        out.append(joined(tiny, "reach", (shorter <= k) & (longer > bound) & (F.col("reach") == longer)))
    return reduce(DataFrame.unionByName, out).distinct()


def ed_gram_candidates(left: DataFrame, right: DataFrame, k: int, self_join: bool, q: int = 2) -> DataFrame:
    """(id1, id2, common): pairs that the q-grams of both texts don't tell to be further apart than k, from (id, value).

    Texts need more than q k q-grams. Their lengths differ by at most k, and they have enough common q-grams (``common``,
    repeats counted as often as both have them). Not yet verified.

    Equal texts are compared once. Such sets of grams differ in at most 2 q k members: of the q k + 1 segments that grams are
    hashed into, one is the same in both or, but for the first, has one member more in one of them. These are the keys; 128-bit
    images of the sets tell most other pairs apart where they are found.
    """
    segments = q * k + 1

    def side(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = F.greatest(F.length("value") - (q - 1), F.lit(1))
        rows = frame.where((F.length("value") > 0) & (n > q * k)).select("id", "value").distinct()
        grams = numbered_repeats(F.transform(qgrams(F.col("value"), q), lambda g: g["gram"]))
        # a number of partitions, as texts are few bytes that take long
        contents = rows.select("value").distinct().repartition(frame.sparkSession.sparkContext.defaultParallelism).select("value", n.alias("n"), grams.alias("grams"))
        contents = checkpoint(contents.withColumn("c", F.monotonically_increasing_id()))  # which fixes the serial numbers
        return contents, rows.hint("merge").join(contents.select("c", "value"), "value").select("id", "c")

    def keys(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The keys of whole segments, and of segments without each one of their grams."""
        images = [filters.set_image(F.col("grams"), h).alias(f"image{h}_") for h in (0, 1)]
        rows = contents.select("c", "n", *images, F.transform("grams", lambda g: F.xxhash64(g)).alias("h"))
        of = lambda x: F.pmod(x, F.lit(segments))
        total = lambda s: F.aggregate(F.filter("h", lambda x: of(x) == s), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
        rows = rows.withColumn("sums", F.array(*(total(s) for s in range(segments))))
        kept = ["c", "n", "image0_", "image1_"]
        whole = rows.select(*kept, F.posexplode("sums").alias("s", "x")).select(F.xxhash64("s", "x").alias("key"), *kept)
        cut = rows.select(*kept, "sums", F.explode(F.filter("h", lambda x: of(x) > 0)).alias("x")).withColumn("s", of(F.col("x")).cast("int"))
        return whole, cut.select(F.xxhash64("s", F.get("sums", F.col("s")).bitwiseXOR(F.col("x"))).alias("key"), *kept)

    a, members1 = side(left)
    b, members2 = (a, members1) if self_join else side(right)
    apart = sum((F.bit_count(F.col(f"image{h}_1").bitwiseXOR(F.col(f"image{h}_2"))) for h in (0, 1)), F.lit(0))
    gap = F.abs(F.col("n1") - F.col("n2"))

    def found(one: DataFrame, two: DataFrame, ordered: bool = False) -> DataFrame:
        near = (gap <= k) & (apart <= 2 * q * k - gap)
        x = one.select("key", *(F.col(c).alias(f"{c}1") for c in one.columns if c != "key"))
        y = two.select("key", *(F.col(c).alias(f"{c}2") for c in two.columns if c != "key"))
        return x.hint("merge").join(y, "key").where(near & (F.col("c1") < F.col("c2")) if ordered else near).select("c1", "c2")

    (whole1, cut1), (whole2, cut2) = keys(a), keys(b)
    if self_join:
        crossed = found(whole1, cut2).where("c1 != c2").select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"))
        pairs = found(whole1, whole2, True).unionByName(crossed).distinct()
    else:
        pairs = found(whole1, whole2).unionByName(found(whole1, cut2)).unionByName(found(cut1, whole2)).distinct()
    one, two = (f.select(F.col("c").alias(f"c{j}"), F.col("n").alias(f"n{j}"), F.col("grams").alias(f"g{j}")) for j, f in ((1, a), (2, b)))
    both = pairs.hint("merge").join(one, "c1").hint("merge").join(two, "c2").withColumn("common", F.size(F.array_intersect("g1", "g2")))
    both = both.where((gap <= k) & filters.ed_common(F.col("common"), F.col("n1"), F.col("n2"), k, q)).select("c1", "c2", "common")
    if self_join:
        both = both.unionByName(a.select(F.col("c").alias("c1"), F.col("c").alias("c2"), F.col("n").alias("common")))
    m1, m2 = (m.select(F.col("c").alias(f"c{j}"), F.col("id").alias(f"id{j}")) for j, m in ((1, members1), (2, members2)))
    every = both.hint("merge").join(m1, "c1").hint("merge").join(m2, "c2")
    if self_join:
        every = every.where((F.col("c1") != F.col("c2")) | (F.col("id1") < F.col("id2"))).where("id1 != id2").select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "common")
    return every.select("id1", "id2", "common")
