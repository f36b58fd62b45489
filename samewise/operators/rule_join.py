"""Joins by matching rules: exactly the pairs of records that satisfy an OR of ANDs of similarity conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.functions import filters
from samewise.functions.text import normalize, tokens
from samewise.operators.candidates import ed_candidates, js_candidates
from samewise.operators.evaluate import unordered
from samewise.operators.statistics import attribute_clusters
from samewise.plans.planner import ORDERS, order_blocks
from samewise.plans.rules import ED, JS, Condition, Rule
from samewise.session import checkpoint, counted, forget

STRATEGIES = ("graph", "chain", "chain_dedup")

#: Records of one content that go together, and rows of the second table that alternate in the result: a multiple of 8, which bit-packed pages repeat by whole bytes.
SLICE, BLOCK = 1 << 12, 1 << 8
#: Rows of the result that are worth a task of their own.
TASK_ROWS = 1 << 20


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as the text that is compared: arrays joined by blanks after trimming their elements, all else cast to string."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType):
        return normalize(F.concat_ws(" ", F.transform(c.cast("array<string>"), lambda x: F.trim(x))))
    return normalize(c.cast("string"))


class Side:
    """One table, prepared for a rule: (id, key) of its records and one row of normalised values and tokens for each distinct content.

    The columns in ``tokenized`` are arrays whose elements are tokens as they are; nulls and empty texts aren't.
    """

    def __init__(self, df: DataFrame, id_col: str, conditions: list[Condition], side: str, missing: str, tokenized: tuple[str, ...] = ()) -> None:
        names = list(dict.fromkeys(getattr(c, side) for c in conditions))
        self.place = {n: k for k, n in enumerate(names)}
        self.side = side
        kinds = {(getattr(c, side), c.kind) for c in conditions}
        if any((n, ED) in kinds for n in tokenized):
            raise ValueError("tokens have no edit distance")

        def value(n: str) -> Column:
            if n not in tokenized:
                return F.nullif(as_text(df, n), F.lit(""))
            own = F.array_sort(F.array_distinct(F.filter(F.col(f"`{n}`").cast("array<string>"), lambda t: t.isNotNull() & (t != ""))))
            return F.when(F.size(own) > 0, own)

        def token_set(n: str) -> Column:
            return F.col(f"v{self.place[n]}") if n in tokenized else tokens(F.col(f"v{self.place[n]}"))

        rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("rec"), *(value(n).alias(f"v{k}") for k, n in enumerate(names)))
        if missing == "drop_record":
            for n, k in self.place.items():
                rows = rows.where(F.col(f"v{k}").isNotNull())
                if (n, JS) in kinds:
                    rows = rows.where(F.size(token_set(n)) > 0)
        v = [f"v{k}" for k in range(len(names))]
        # written, so that the input is read and normalised once
        keyed = checkpoint(rows.withColumn("key", F.md5(F.to_json(F.struct(*v), {"ignoreNullFields": "false"}))))
        contents = keyed.groupBy("key").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in v)).withColumn("id", F.monotonically_increasing_id())
        kept = [f"v{k}" for n, k in self.place.items() if (n, ED) in kinds]
        # written, which also fixes the serial numbers; pairs of these are much smaller than pairs of keys
        self.contents = checkpoint(contents.select("id", "key", "n", *kept, *(token_set(n).alias(f"t{k}") for n, k in self.place.items() if (n, JS) in kinds)))

        self.written = keyed
        self.keyed = keyed.select("rec", "key")

    @property
    def members(self) -> DataFrame:
        """(rec, id): the content of each record."""
        return self.keyed.hint("merge").join(self.contents.select("key", "id"), "key").select("rec", "id")

    def numbered_members(self) -> DataFrame:
        """(rec, id, nr): as ``members``, with the records of each content numbered from 0."""
        own = self.keyed.withColumn("nr", F.row_number().over(Window.partitionBy("key").orderBy("rec")) - 1)
        return own.hint("merge").join(self.contents.select("key", "id"), "key").select("rec", "id", "nr")

    def unique(self) -> bool:
        """No record id comes twice."""
        return self.keyed.groupBy("rec").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def free(self) -> None:
        """Deletes what was written; frames that read it are no longer of use."""
        forget(self.contents, self.written)

    def frame(self, c: Condition) -> DataFrame:
        """(id, tokens) or (id, value) of the contents that have a value."""
        k = self.place[getattr(c, self.side)]
        if c.kind == JS:
            return self.contents.select("id", F.col(f"t{k}").alias("tokens")).where(F.size("tokens") > 0)
        return self.contents.select("id", F.col(f"v{k}").alias("value")).where(F.col("value").isNotNull())

    def columns(self, number: int) -> DataFrame:
        return self.contents.select(F.col("id").alias(f"id{number}"), *(F.col(c).alias(f"{c}_{number}") for c in self.contents.columns if c not in ("id", "key")))


def rule_column(rule: Rule, left: Side, right: Side) -> Column:
    """The rule over the joined contents of both sides; a condition on a missing value is false. Jaccard comes before edit distance."""

    def one(c: Condition) -> Column:
        a, b = left.place[c.left], right.place[c.right]
        if c.kind == JS:
            x, y = F.col(f"t{a}_1"), F.col(f"t{b}_2")
            test = filters.js_reached(F.size(F.array_intersect(x, y)), F.size(x), F.size(y), c.threshold)
        else:
            test = filters.ed_reached(F.col(f"v{a}_1"), F.col(f"v{b}_2"), c.edits)
        return F.coalesce(test, F.lit(False))

    blocks = (reduce(lambda p, q: p & q, map(one, sorted(b, key=lambda c: c.kind == ED))) for b in rule.blocks)
    return reduce(lambda p, q: p | q, blocks)


def condition_candidates(conditions: list[Condition], left: Side, right: Side, self_join: bool, q: int, dedup: bool = False) -> dict[Condition, DataFrame]:
    """(id1, id2) of contents for each condition. All Jaccard conditions have one index and are read in one pass."""
    js = [c for c in conditions if c.kind == JS]
    out = {}
    if js:
        places = [(f"t{left.place[c.left]}", f"t{right.place[c.right]}", c.threshold) for c in js]
        out = dict(zip(js, js_candidates(left.contents, right.contents, places, self_join, dedup), strict=True))
    return out | {c: ed_candidates(left.frame(c), right.frame(c), c.edits, self_join, q) for c in conditions if c.kind == ED}


def candidate_pairs(rule: Rule, left: Side, right: Side, self_join: bool, strategy: str, order: str, q: int) -> DataFrame:
    """(id1, id2) of contents, distinct. "graph": the first condition of each block; "chain": what all of a block's conditions admit."""
    if strategy == "graph":
        firsts = [block[0] for block in order_blocks(rule, order, lambda c: left.frame(c), q).blocks]
        out = list(condition_candidates(list(dict.fromkeys(firsts)), left, right, self_join, q).values())
    else:
        every = condition_candidates(rule.conditions, left, right, self_join, q, strategy == "chain_dedup")
        out = [reduce(DataFrame.intersect, [every[c] for c in block]) for block in rule.blocks]
    return out[0].distinct() if len(out) == 1 else reduce(DataFrame.unionByName, out).distinct()


def join_with_rules(df: DataFrame, rule: Rule, id1: str, df2: DataFrame | None = None, id2: str | None = None, output: str = "ids", missing: str = "condition_false", strategy: str = "graph", order: str = "threshold_desc", q: int = 2, tokenized: tuple[str, ...] = (), tokenized2: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of records that satisfy ``rule``: within ``df`` (smaller id first), or between ``df`` and ``df2``.

    output: "ids" gives (id1, id2); "rows" attaches both rows, their columns prefixed left_ and right_; "classes" gives
    (class1, class2) between distinct contents, whose number does not grow with copies, to be used with ``members``.
    missing: "condition_false", or "drop_record" to leave out records that lack any attribute of the rule. Contents are
    compared once however many records share them; ids need not be unique, and keep their type. Null ids are ignored;
    an empty table gives an empty result. The columns ``tokenized`` (and ``tokenized2`` of df2) are arrays of tokens, which
    are taken as they are.
    """
    if strategy not in STRATEGIES or order not in ORDERS or output not in ("ids", "rows", "classes") or missing not in ("condition_false", "drop_record"):
        raise ValueError("unknown strategy, order, output or missing")
    if not rule.blocks or not all(rule.blocks):
        raise ValueError("the rule has no condition")
    self_join = df2 is None
    if self_join and any(c.left != c.right for c in rule.conditions):
        raise ValueError("a rule within one table compares an attribute with itself")
    left = Side(df, id1, rule.conditions, "left", missing, tokenized)
    right = left if self_join else Side(df2, id2 or id1, rule.conditions, "right", missing, tokenized2)
    other, key2 = (df, id1) if self_join else (df2, id2 or id1)
    one = df.select(*(F.col(f"`{c}`").alias(f"left_{c}") for c in df.columns))
    two = other.select(*(F.col(f"`{c}`").alias(f"right_{c}") for c in other.columns))
    if output == "rows" and not self_join and left.unique() and right.unique():
        return rows_by_content(similar_contents(left, right, rule, self_join, strategy, order, q, ("n_1", "n_2")), left, right, one, f"left_{id1}", two, f"right_{key2}")
    pairs = join_sides(left, right, rule, self_join, output == "classes", strategy, order, q)
    if output in ("ids", "classes"):
        return pairs
    both = pairs.hint("merge").join(one, pairs["id1"] == one[f"left_{id1}"]).hint("merge").join(two, pairs["id2"] == two[f"right_{key2}"])
    return both.drop("id1", "id2")


def rows_by_content(found: DataFrame, left: Side, right: Side, one: DataFrame, key1: str, two: DataFrame, key2: str) -> DataFrame:
    """The rows of ``one`` with those of ``two`` for the pairs of contents ``found`` (id1, id2, n_1, n_2); ids are unique.

    Pairs of records are written nowhere before the result. Its rows grow with the square of the copies, so the copies of
    both contents are cut into slices, and each pair of slices is joined by itself: no task has all of a frequent content, and
    a row is shuffled once for every SLICE rows of the result that it is in. Within these, BLOCK rows of ``two`` are repeated for each
    row of ``one``, so that both sides of the result are runs or short periods, of which a Parquet file keeps little.
    """
    slices = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / SLICE).cast("int")))
    size = lambda n, k: F.least(F.lit(SLICE), F.col(n) - F.col(k) * SLICE)
    cut = found.withColumn("s1", slices("n_1")).withColumn("s2", slices("n_2")).withColumn("rows", size("n_1", "s1") * size("n_2", "s2"))
    # written, which also fixes the serial numbers
    units = checkpoint(cut.select(F.monotonically_increasing_id().alias("unit"), "id1", "s1", "id2", "s2", "rows"), n=F.count(F.lit(1)), rows=F.sum("rows"))
    a = left.numbered_members().select(F.col("rec").alias("rec1"), F.col("id").alias("id1"), F.floor(F.col("nr") / SLICE).cast("int").alias("s1"))
    b = right.numbered_members().select(F.col("rec").alias("rec2"), F.col("id").alias("id2"), F.floor(F.col("nr") / SLICE).cast("int").alias("s2"), F.floor(F.col("nr") / BLOCK).cast("int").alias("block"))
    rows = one.hint("merge").join(a, one[key1] == a["rec1"]).hint("merge").join(units.select("id1", "s1", "unit"), ["id1", "s1"]).select("unit", *one.columns)
    members = two.hint("merge").join(b, two[key2] == b["rec2"]).groupBy("id2", "s2", "block").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in two.columns))).alias("members"))
    blocks = members.hint("merge").join(units.select("id2", "s2", "unit"), ["id2", "s2"]).select("unit", "members")
    tasks = min(counted(units)["n"], (counted(units)["rows"] or 0) // TASK_ROWS)
    if tasks > int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # the shuffled bytes, from which Spark would choose, don't tell how many rows come of them
        rows, blocks = rows.repartition(tasks, "unit"), blocks.repartition(tasks, "unit")
    # the first side of a merge join is read once, the rows of the second are kept and repeated for each block
    return blocks.hint("merge").join(rows, "unit").select(*(F.col(f"`{c}`") for c in one.columns), F.inline("members"))


def similar_contents(left: Side, right: Side, rule: Rule, self_join: bool, strategy: str, order: str, q: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(id1, id2) of the contents of two prepared sides that satisfy the rule, distinct, with the columns ``more`` of both."""
    candidates = candidate_pairs(rule, left, right, self_join, strategy, order, q)
    return candidates.hint("merge").join(left.columns(1), "id1").hint("merge").join(right.columns(2), "id2").where(rule_column(rule, left, right)).select("id1", "id2", *more)


def join_sides(left: Side, right: Side, rule: Rule, self_join: bool, classes: bool = False, strategy: str = "graph", order: str = "threshold_desc", q: int = 2) -> DataFrame:
    """The pairs of two prepared sides (the same one for a self-join) as join_with_rules gives them, of records or of classes."""
    found = similar_contents(left, right, rule, self_join, strategy, order, q)
    if classes:
        keys = lambda s, k: s.contents.select(F.col("id").alias(f"id{k}"), F.col("key").alias(f"class{k}"))
        return found.hint("merge").join(keys(left, 1), "id1").hint("merge").join(keys(right, 2), "id2").select("class1", "class2")
    a = left.members.select(F.col("rec").alias("a"), F.col("id").alias("id1"))
    b = right.members.select(F.col("rec").alias("b"), F.col("id").alias("id2"))
    if not self_join:
        return found.hint("merge").join(a, "id1").hint("merge").join(b, "id2").select(F.col("a").alias("id1"), F.col("b").alias("id2")).distinct()
    across = found.hint("merge").join(a, "id1").hint("merge").join(b, "id2").where("a != b").select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"))
    # copies satisfy the rule if their content satisfies it with itself: one row a content, no join
    itself = left.contents.select(F.col("id").alias("id1"), *(F.col(c).alias(f"{c}_{k}") for c in left.contents.columns if c not in ("id", "key") for k in (1, 2)))
    same = itself.where(rule_column(rule, left, right)).select("id1")
    copies = same.hint("merge").join(a, "id1").hint("merge").join(b, F.col("id1") == F.col("id2")).where("a < b").select(F.col("a").alias("id1"), F.col("b").alias("id2"))
    return across.unionByName(copies).distinct()


def members(df: DataFrame, rule: Rule, id_col: str, side: str = "left", missing: str = "condition_false", tokenized: tuple[str, ...] = ()) -> DataFrame:
    """(rec, key): the class of each record, as output="classes" names it."""
    return Side(df, id_col, rule.conditions, side, missing, tokenized).keyed


def all_conditions_hold(pair_sets: list[DataFrame]) -> DataFrame:
    """(id1, id2) of the pairs that every one of the pair sets has: united, counted, kept if there are as many as sets."""
    rows = [p.select("id1", "id2").distinct() for p in pair_sets]
    return reduce(DataFrame.unionByName, rows).groupBy("id1", "id2").agg(F.count("*").alias("n")).where(F.col("n") == len(rows)).select("id1", "id2")


def clustered_join(df: DataFrame, id_col: str, clusters: list[tuple[list[str], float]] | None, least: float, strategy: str = "graph") -> DataFrame:
    """Jaccard pairs over clusters of attributes, each (attributes, entropy): the threshold falls as a cluster's entropy rises.

    Without ``clusters`` they are those of attribute_clusters; clusters without entropy say nothing and are left out.
    A cluster's text joins its attributes; its threshold is min(1, least * highest entropy / own). Pairs of all clusters are united.
    """
    from samewise.plans.rules import js

    clusters = [(names, e) for names, e in (attribute_clusters(df, id_col) if clusters is None else clusters) if e > 0]
    if not clusters:
        return df.select(F.col(f"`{id_col}`").alias("id1"), F.col(f"`{id_col}`").alias("id2")).limit(0)
    highest = max(e for _, e in clusters)
    out = []
    for names, e in clusters:
        text = F.concat_ws(" ", *(F.col(f"`{n}`").cast("string") for n in names))
        out.append(join_with_rules(df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")), js("text", min(1.0, least * highest / e)), "id", strategy=strategy))
    return reduce(DataFrame.unionByName, out).distinct()


def minhash_candidates(df: DataFrame, id_col: str, text_col: str, threshold: float, tables: int = 16, features: int = 1 << 18, among: DataFrame | None = None) -> DataFrame:
    """(id1, id2) of the pairs whose hashed token sets have a Jaccard similarity of at least ``threshold`` and whose MinHash
    signatures agree in one of ``tables`` hashes: approximate blocking.

    The similarity comes first, by a rule on the hashed sets: a single hash agrees for so many dissimilar pairs that listing
    these grows with the square of the records. With ``among``, pairs (id1, id2) of ids in either order, the result is exactly
    those of all candidates that are among them: each is tested by itself, and no others are looked for. ``among``
    is read twice.
    """
    from pyspark.ml.feature import HashingTF, MinHashLSH
    from pyspark.ml.functions import vector_to_array

    from samewise.plans.rules import js

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    if among is not None:
        pairs = unordered(among).where("id1 < id2")
        texts = texts.hint("merge").join(pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct().hint("merge"), "id", "left_semi")
    rows = texts.select("id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    # written first: filters that Spark infers from the hashing would else run on records without tokens, which it refuses
    hashed = checkpoint(HashingTF(numFeatures=features, binary=True, inputCol="tokens", outputCol="features").transform(rows).select("id", "features"))
    model = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=tables, seed=7).fit(hashed)
    places = F.from_json(F.to_json(F.struct("features")), "features struct<indices: array<int>>")["features"]["indices"].alias("places")
    signature = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("long")).alias("h")
    agree = F.exists(F.zip_with("h1", "h2", lambda a, b: a == b), lambda x: x)
    if among is not None:
        sets = model.transform(hashed).select("id", signature, places)
        one, two = (sets.select(F.col("id").alias(f"id{k}"), F.col("h").alias(f"h{k}"), F.col("places").alias(f"p{k}")) for k in (1, 2))
        both = pairs.hint("merge").join(one, "id1").hint("merge").join(two, "id2")
        similar = filters.js_reached(F.size(F.array_intersect("p1", "p2")), F.size("p1"), F.size("p2"), threshold)
        # ids that repeat have several sets, of which one pair must be similar and one agree
        return both.groupBy("id1", "id2").agg(F.max(similar).alias("similar"), F.max(agree).alias("agree")).where("similar and agree").select("id1", "id2")
    pairs = join_with_rules(hashed.select("id", places), js("places", threshold), "id", tokenized=("places",))
    signed = model.transform(hashed).select("id", signature).distinct()
    one, two = (signed.select(F.col("id").alias(f"id{k}"), F.col("h").alias(f"h{k}")) for k in (1, 2))
    both = pairs.hint("merge").join(one, "id1").hint("merge").join(two, "id2")
    return both.where(agree).select("id1", "id2").distinct()
