"""Rule joins against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from samewise.functions.text import qgrams, tokens
from samewise.operators.rule_join import clustered_join, join_with_rules, members
from samewise.plans.planner import ORDERS
from samewise.plans.rules import ed, js


def toks(s):
    return {w for w in re.split(r"[^A-Za-z0-9]", (s or "").strip().lower()) if w and w.isascii()}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def holds(rule, a, b):
    def one(c):
        x, y = a[c.left], b[c.right]
        if c.kind == "JS":
            x, y = toks(x), toks(y)
            return bool(x & y) and len(x & y) / len(x | y) >= c.threshold - 1e-9
        x, y = ((v or "").strip().lower() for v in (x, y))
        return bool(x) and bool(y) and lev(x, y) <= c.threshold

    return any(all(map(one, block)) for block in rule.blocks)


def brute(rule, left, right=None):
    if right is None:
        return {(a["id"], b["id"]) for a, b in itertools.combinations(sorted(left, key=lambda r: r["id"]), 2) if holds(rule, a, b)}
    return {(a["id"], b["id"]) for a in left for b in right if holds(rule, a, b)}


def data(n, seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["red", "blue", "tree", "car", "sun", "x1", "the"])
    short = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))
    return [{"id": i, "t": rnd.choice([None, "", "  ", "é_"]) if rnd.random() < 0.1 else " ".join(word() for _ in range(rnd.randint(1, 6))), "s": None if rnd.random() < 0.05 else short()} for i in range(n)]


RULES = [
    js("t", 0.5), js("t", 1.0), ed("s", 0), ed("s", 1), ed("s", 3), js("t", 0.6) & ed("s", 2), js("t", 0.9) | ed("s", 1),
    (js("t", 0.6) & ed("s", 3)) | (js("t", 0.9) & js("t", 0.4)) | ed("s", 0) & js("t", 0.3),
]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_self_join(spark, k):
    rows = data(70, k)
    df = spark.createDataFrame(rows, "id long, t string, s string")
    got = [tuple(r) for r in join_with_rules(df, RULES[k], "id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(RULES[k], rows)


@pytest.mark.parametrize("strategy", ["chain", "chain_dedup"])
def test_strategies(spark, strategy):
    rows = data(60, 11)
    df = spark.createDataFrame(rows, "id long, t string, s string")
    assert {tuple(r) for r in join_with_rules(df, RULES[-1], "id", strategy=strategy).collect()} == brute(RULES[-1], rows)


@pytest.mark.parametrize("order", ORDERS)
def test_orders(spark, order):
    rows = data(40, 12)
    df = spark.createDataFrame(rows, "id long, t string, s string")
    assert {tuple(r) for r in join_with_rules(df, RULES[5], "id", order=order).collect()} == brute(RULES[5], rows)


def test_two_tables_same_ids_and_cross_attributes(spark):
    left, right = data(40, 1), data(40, 2)
    rule = js("t", 0.5, "u") & ed("s", 3, "v")
    a = spark.createDataFrame(left, "id long, t string, s string")
    b = spark.createDataFrame([{"id": r["id"], "u": r["t"], "v": r["s"]} for r in right], "id long, u string, v string")
    want = brute(rule, left, [{"id": r["id"], "u": r["t"], "v": r["s"]} for r in right])
    assert want and {tuple(r) for r in join_with_rules(a, rule, "id", b, "id").collect()} == want


def test_missing_modes(spark):
    rows = [(1, "a b", None), (2, "a b", None), (3, "a b", "xy"), (4, "a b", "xy")]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    rule = js("t", 1.0) | ed("s", 0)
    assert len(join_with_rules(df, rule, "id").collect()) == 6
    assert {tuple(r) for r in join_with_rules(df, rule, "id", missing="drop_record").collect()} == {(3, 4)}


def test_documented_cases(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "aaabaaab"), (4, "ababaaab")], "id long, s string")
    assert {tuple(r) for r in join_with_rules(df, ed("s", 2), "id").collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in join_with_rules(df, ed("s", 1), "id").collect()} == {(3, 4)}
    many = [f"w{k}" for k in range(100)]
    df = spark.createDataFrame([(1, " ".join(many)), (2, " ".join(many[45:])), *((9 + k, many[45 + k % 55]) for k in range(110))], "id long, t string")
    assert (1, 2) in {tuple(r) for r in join_with_rules(df, js("t", 0.55), "id").collect()}
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d")], "id long, t string")
    assert join_with_rules(df, js("t", 0.8), "id").count() == 1


def test_rows_clashing_names_empty_and_types(spark):
    df = spark.createDataFrame([("x", ["Big  ", "tree"], 1), ("y", ["big tree"], 1), ("z", None, 1)], "id1 string, a array<string>, id2 int")
    rows = join_with_rules(df, js("a", 1.0) & ed("id2", 0), "id1", output="rows").collect()
    assert [(r["left_id1"], r["right_id1"], r["left_id2"]) for r in rows] == [("x", "y", 1)]
    assert join_with_rules(df.limit(0), js("a", 0.5), "id1").count() == 0
    assert join_with_rules(df, ed("a", 0), "id1", df.limit(0), "id1").count() == 0


def test_copies_stay_few_in_classes(spark):
    df = spark.range(50).select("id", F.when(F.col("id") < 40, "same text here").otherwise("same text here now").alias("t"))
    assert join_with_rules(df, js("t", 0.7), "id").count() == 50 * 49 // 2
    assert join_with_rules(df, js("t", 0.7), "id", output="classes").count() == 1
    assert members(df, js("t", 0.7), "id").select("key").distinct().count() == 2


def test_clustered(spark):
    df = spark.createDataFrame([(1, "a b", "c d"), (2, "a b", "x y"), (3, "q", "c d")], "id long, t string, u string")
    assert {tuple(r) for r in clustered_join(df, "id", [(["t"], 2.0), (["u"], 1.0)], 0.5).collect()} == {(1, 2), (1, 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a_b--c é1 A",), ("",), (None,), ("a",)], "s string")
    rows = df.select(tokens(F.col("s")), qgrams(F.col("s"), 2)).collect()
    assert set(rows[0][0]) == {"a", "b", "c", "1"} and rows[1][0] == [] and rows[2][0] is None
    assert rows[1][1] == [] and rows[2][1] is None and [tuple(g) for g in rows[3][1]] == [("a", 0)]


def test_two_table_rows_reads_whole_tables(spark, tmp_path):
    from samewise.queries.rules import two_table_rows

    rows = [(1, "red tree", "a", 1), (2, "tree red", "b", 20), (3, "red tree", "c", 50), (4, "blue", "d", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = two_table_rows(spark, str(tmp_path)).select("left_p_partkey", "left_p_brand", "right_p_partkey").collect()
    assert {tuple(r) for r in got} == {(1, "a", 1), (1, "a", 2), (1, "a", 3), (2, "b", 1), (2, "b", 2), (2, "b", 3), (3, "c", 1), (3, "c", 2), (3, "c", 3), (4, "d", 4)}
    assert len(got) == 10


def test_film_queries_keep_accents(spark, tmp_path):
    from samewise.queries import rules as r

    people, cast = ["Zoë Àb", "Zoë Àb", "Bo 2", None], ["ann lee, jo", "ann lee, jo", "jo", " "]
    titles = ["Amélie runs far", "Amèlie runs far", "Amélie runs", "red tree house", "red tree hous€", "日本 one two", "日木 one two", None, "Amélie runs far", "red tree house"]
    films = [{"doc_id": i, "id": i, "title": t, "director": people[k % 4], "cast_list": cast[k % 3]} for i, (k, t) in enumerate(itertools.product(range(4), titles))]
    spark.createDataFrame(films, "doc_id long, title string, director string, cast_list string").write.parquet(str(tmp_path / "films.parquet"))
    conditions = [("r2", b, c.left, c.kind, float(c.threshold)) for b, block in enumerate(r.FILM_RULE.blocks) for c in block]
    spark.createDataFrame(conditions, "rule_id string, and_block int, attr_name string, rule_type string, threshold double").write.parquet(str(tmp_path / "rules.parquet"))
    whole = [f for f in films if all(toks(f[c]) for c in ("title", "director", "cast_list"))]
    want = {"rule_missing_drop": brute(r.FILM_RULE, whole), "rule_same_attribute": brute(js("title", 0.6) & ed("title", 4), films)}
    names = ["rule_dnf", "rule_from_table", "rule_text_form", "rule_missing_drop", "rule_same_attribute", "chain_strategy", "dedup_strategy", "ordered_by_entropy", "ordered_by_block_size"]
    assert any(not films[a]["title"].isascii() for a, _ in want["rule_missing_drop"])
    for name in names:
        got = [tuple(x) for x in getattr(r, name)(spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want.get(name, brute(r.FILM_RULE, films)), name
    index = {(x["id"], x["gram"], x["pos"]) for x in r.ed_prefix_index(spark, str(tmp_path)).collect()}
    grams = lambda v: [(v[i : i + 2], i) for i in range(max(len(v) - 1, 1))]
    df = {}
    for f in films:
        for g, _ in grams((f["director"] or "").lower()):
            df[g] = df.get(g, 0) + 1
    assert index == {(f["id"], g, i) for f in films if f["director"] for g, i in sorted(grams(f["director"].lower()), key=lambda x: (df[x[0]], *x))[:5]}


def test_edit_distance_of_all_lengths(spark):
    from samewise.operators.candidates import deletion_bound, ed_candidates, ed_gram_candidates

    assert deletion_bound(1, 256) == 255 and deletion_bound(2, 256) == 22
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abc") for _ in range(n)) for n in (1, 2, 4, 6, 8, 11, 14, 18, 25)]

    def edited(t, n):
        for _ in range(n):
            k = rnd.randrange(len(t) + 1)
            t = rnd.choice([t[:k] + rnd.choice("abc") + t[k:], t[:k] + t[k + 1 :], t[:k] + rnd.choice("abc") + t[k + 1 :]])
        return t

    texts = sorted({t for b in base for n in range(4) for t in [edited(b, n)] if t})
    df = spark.createDataFrame(list(enumerate(texts)), "id long, value string")
    for k, q, most in ((1, 2, 3), (2, 2, 20), (3, 3, 10), (5, 2, 256)):
        got = [tuple(r) for r in ed_candidates(df, df, k, True, q, most).collect()]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if lev(a, b) <= k}, (k, q, most)
    near = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if lev(a, b) <= 1 and min(len(a), len(b)) > 3}
    plan = ed_gram_candidates(df, df, 1, True, 2)
    assert near <= {tuple(r)[:2] for r in plan.collect()} and "BroadcastHashJoin" not in plan._jdf.queryExecution().toString()


def test_common_grams_are_counted_exactly(spark):
    from collections import Counter

    from samewise.operators.candidates import ed_gram_candidates

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14))) for _ in range(60)] + ["a quiet harbour of men", "a quiet harbor of men", "the quiet harbour of men", "a quiet harbour of men", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, value string")
    other = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts[20:])], "id long, value string")
    for k, q in ((1, 2), (2, 2), (1, 3), (0, 2)):
        bags = [Counter([t[i : i + q] for i in range(max(len(t) - q + 1, 1))]) if t else Counter() for t in texts]

        def common(a, b):
            n, c = [sum(x.values()) for x in (a, b)], sum((a & b).values())
            return c if min(n) > q * k and abs(n[0] - n[1]) <= k and c >= max(n) - q * k else None

        plan = ed_gram_candidates(df, df, k, True, q)
        got = [tuple(r) for r in plan.collect()]
        want = {(i, j, c) for i, j in itertools.combinations(range(len(texts)), 2) for c in [common(bags[i], bags[j])] if c is not None}
        assert len(got) == len(set(got)) and set(got) == want, (k, q)
        # pairs that share one gram are too many to be written
        assert "SortMergeJoin [gram" not in plan._jdf.queryExecution().toString()
        want = {(i, 1000 + j - 20, c) for i in range(len(texts)) for j in range(20, len(texts)) for c in [common(bags[i], bags[j])] if c is not None}
        assert {tuple(r) for r in ed_gram_candidates(df, other, k, False, q).collect()} == want


def test_minhash_lists_no_dissimilar_pairs(spark):
    from samewise.operators.rule_join import minhash_candidates

    rnd = random.Random(5)
    texts = [" ".join(rnd.sample([f"w{k}" for k in range(12)], rnd.randint(6, 12))) for _ in range(40)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts), (None, "w1 w2")], "id long, t string")
    found = minhash_candidates(df, "id", "t", 0.7)
    sets = [toks(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "hashValue" not in found._jdf.queryExecution().toString()  # no join on single hashes


def test_minhash_among_given_pairs_is_that_of_all_candidates(spark):
    from samewise.operators.rule_join import minhash_candidates

    rnd = random.Random(9)
    texts = [" ".join(rnd.sample([f"w{k}" for k in range(12)], rnd.randint(6, 12))) for _ in range(40)] + ["", None]
    rows = [*enumerate(texts), (3, texts[7]), (5, texts[9]), (None, texts[0])]
    df = spark.createDataFrame(rows, "id long, t string")
    given = [(i, j) if rnd.random() < 0.5 else (j, i) for i, j in itertools.combinations(range(len(texts)), 2) if rnd.random() < 0.5]
    among = spark.createDataFrame([*given, given[0], (4, 4), (1, None), (1, 99)], "id1 long, id2 long")
    kept = {(min(p), max(p)) for p in given}
    for threshold, tables, features in ((0.6, 1, 1 << 18), (0.7, 2, 8)):  # few hashes miss similar pairs, few features make others similar
        every = {tuple(r) for r in minhash_candidates(df, "id", "t", threshold, tables, features).collect()}
        got = [tuple(r) for r in minhash_candidates(df, "id", "t", threshold, tables, features, among).collect()]
        assert len(got) == len(set(got)) and set(got) == every & kept and set() < set(got) < every


def test_recall_needs_one_similarity_join(spark, tmp_path, monkeypatch):
    from samewise.operators import rule_join
    from samewise.queries.rules import lsh_recall

    rnd = random.Random(2)
    texts = [" ".join(rnd.sample([f"w{k}" for k in range(12)], rnd.randint(6, 12))) for _ in range(40)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, plot string")
    df.unionByName(df.limit(5)).write.parquet(str(tmp_path / "films.parquet"))
    joins, join = [], rule_join.similar_contents
    monkeypatch.setattr(rule_join, "similar_contents", lambda *a: joins.append(a) or join(*a))
    sets = [toks(t) for t in texts]
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert [tuple(r) for r in lsh_recall(spark, str(tmp_path)).collect()] == [(len(want), True)] and want
    assert len(joins) == 1
    empty = tmp_path / "empty"
    df.limit(0).write.parquet(str(empty / "films.parquet"))
    assert [tuple(r) for r in lsh_recall(spark, str(empty)).collect()] == [(0, True)]


def test_rows_of_two_tables_are_joined_by_content(spark, monkeypatch):
    from samewise.operators import rule_join

    df = spark.createDataFrame([(1, "red box"), (2, "red box"), (3, "blue jar"), (None, "red box")], "id long, t string")
    other = spark.createDataFrame([(7, "box red"), (8, "red box"), (9, None)], "key long, s string")
    monkeypatch.setattr(rule_join, "join_sides", None)  # it makes pairs of records distinct, which writes them
    rows = join_with_rules(df, js("t", 0.6, "s"), "id", other, "key", output="rows")
    assert rows.columns == ["left_id", "left_t", "right_key", "right_s"]
    assert sorted(tuple(r) for r in rows.collect()) == [(i, "red box", k, t) for i in (1, 2) for k, t in ((7, "box red"), (8, "red box"))]
    twice = other.unionByName(other)
    monkeypatch.undo()
    assert join_with_rules(df, js("t", 0.6, "s"), "id", twice, "key", output="rows").count() == 8


def test_rows_of_frequent_contents_stay_small_and_are_spread(spark, tmp_path, monkeypatch):
    from samewise.operators import rule_join

    df = spark.range(300).selectExpr("id", "'red box' t")
    other = spark.range(4001).selectExpr("id * 7 key", "'box red' s")
    rows = lambda: join_with_rules(df, js("t", 0.6, "s"), "id", other, "key", output="rows")
    rows().write.parquet(str(tmp_path / "rows"))
    written = spark.read.parquet(str(tmp_path / "rows"))
    assert written.count() == written.distinct().count() == 300 * 4001 and {tuple(r) for r in written.select("left_t", "right_s").distinct().collect()} == {("red box", "box red")}
    assert sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet")) < 0.4 * 300 * 4001
    monkeypatch.setattr(rule_join, "SLICE", 256)
    monkeypatch.setattr(rule_join, "TASK_ROWS", 1 << 14)
    tasks = [r["count"] for r in rows().groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 300 * 4001 and len(tasks) > 4 and max(tasks) < 300 * 4001 / 3


@pytest.mark.parametrize("piece", [(1, 1), (2, 1), (8, 4)])
def test_slices_of_contents_meet_once(spark, monkeypatch, piece):
    from samewise.operators import rule_join

    monkeypatch.setattr(rule_join, "SLICE", piece[0])
    monkeypatch.setattr(rule_join, "BLOCK", piece[1])
    monkeypatch.setattr(rule_join, "TASK_ROWS", 8)
    texts = ["red box", "box red", "red box", "red tree", "blue", "", None, "red box x1"]
    left, right = ([{"id": i, "t": texts[(i * i + k) % len(texts)], "b": None if i % 3 else f"b{i}"} for i in range(n)] for k, n in ((0, 45), (3, 37)))
    one, two = (spark.createDataFrame([tuple(r.values()) for r in x], "id long, t string, b string") for x in (left, right))
    got = [tuple(r) for r in join_with_rules(one, js("t", 0.6), "id", two, "id", output="rows").collect()]
    want = {(*left[a].values(), *right[b].values()) for a, b in brute(js("t", 0.6), left, right)}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert join_with_rules(one, js("t", 0.6), "id", two.limit(0), "id", output="rows").collect() == []


def test_tokenized_columns_and_two_edit_distances(spark):
    df = spark.createDataFrame([(1, ["New York", "x", None, ""], "abc", "k1"), (2, ["x", "New York", "x"], "abd", "k1"), (3, ["New", "York", "x"], "abc", "k9x"), (4, [], None, "k1"), (5, None, "abe", "k2")], "id long, t array<string>, s string, u string")
    pairs = join_with_rules(df, js("t", 1.0), "id", tokenized=("t",))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)] and "BroadcastHashJoin" not in pairs._jdf.queryExecution().toString()
    assert {tuple(r) for r in join_with_rules(df, ed("s", 1) & ed("u", 1), "id").collect()} == {(1, 2), (1, 5), (2, 5)}
    with pytest.raises(ValueError):
        join_with_rules(df, ed("t", 1), "id", tokenized=("t",))


def test_clusters_are_found(spark):
    df = spark.createDataFrame([(1, "a b", "b a", "q"), (2, "a b", "a c", "r"), (3, "z", "c", "q")], "id long, t string, u string, w string")
    assert (1, 2) in {tuple(r) for r in clustered_join(df, "id", None, 0.3).collect()}
    assert clustered_join(df.limit(0), "id", None, 0.3).count() == 0
