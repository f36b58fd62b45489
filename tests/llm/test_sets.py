"""Set similarity, components and term statistics against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from samewise.functions.text import word_set, words
from samewise.llm.components import connected_components
from samewise.llm.near_dup import near_duplicate_groups, similar_set_pairs
from samewise.llm.overlap_join import overlap_needed, record_sets, similar_pairs, similar_records, size_boundary, subset_sizes
from samewise.llm.term_stats import term_bitmaps, term_statistics


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def families(n, seed, vocabulary, size):
    """Sets, many of which are edited copies of others."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            s = set(rnd.choice(out))
            for _ in range(rnd.randint(0, 4)):
                s.discard(rnd.choice(sorted(s))) if rnd.random() < 0.5 and len(s) > 1 else s.add(f"w{rnd.randrange(vocabulary)}")
        else:
            s = {f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(rnd.randint(1, size))}
        out.append(s)
    return out


@pytest.mark.parametrize(("t", "vocabulary", "size"), [(0.7, 60, 30), (0.8, 25, 12), (0.5, 40, 20), (0.95, 30, 70), (1.0, 8, 4)])
def test_similar_set_pairs(spark, t, vocabulary, size):
    sets = [s for s in {frozenset(x) for x in families(250, int(t * 100), vocabulary, size)}]
    df = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "id long, items array<string>")
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= t - 1e-9}
    assert {tuple(r) for r in similar_set_pairs(df, t).collect()} == want
    assert {tuple(r)[:2] for r in similar_pairs(df, t).collect()} == want


@pytest.mark.parametrize("most", [1, 30, 5000])
def test_size_boundary_changes_nothing(spark, most):
    sets = [s for s in {frozenset(x) for x in families(200, 5, 25, 14)}]
    df = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "id long, items array<string>")
    want = {(i, j, len(sets[i] & sets[j])) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= 0.6 - 1e-9}
    assert {tuple(r) for r in similar_pairs(df, 0.6, most).collect()} == want


def test_overlaps():
    assert overlap_needed(4, 5, 0.8) == 4 and subset_sizes(5, 1.0) == [5]
    assert size_boundary(0.6, 0) == 0 and 4 < size_boundary(0.6, 128) < 12


def test_near_duplicate_groups(spark):
    texts = [" ".join(sorted(s)) for s in families(200, 9, 50, 25)]
    rows = [(k % 190, t.upper() if k % 3 else t + " --- é") for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, " .. "), (None, texts[0]), *((600 + k, "same words here") for k in range(40))]
    df = spark.createDataFrame(rows, "rep long, items string").repartition(3)
    got = {r[0]: r[1] for r in near_duplicate_groups(df, "rep", word_set(F.col("items")), 0.7).collect()}
    sets = [(i, set(t.lower().replace("é", "").replace("-", "").split())) for i, t in rows if i is not None and t and t.strip(" .")]
    want = groups([(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and jaccard(x, y) >= 0.7 - 1e-9])
    assert got == want
    assert near_duplicate_groups(df.limit(0), "rep", word_set(F.col("items")), 0.7).count() == 0


def test_similar_records_and_classes(spark):
    sets = families(120, 21, 25, 10) + [{"a", "b", "c"}] * 12
    rows = [(k, x.upper() + " ") for k, s in enumerate(sets) for x in sorted(s)] * 2 + [(3, None), (4, " "), (None, "w1"), (900, "")]
    df = spark.createDataFrame(rows, "id long, rep string").repartition(4)
    item = F.lower(F.trim("rep"))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(set(sets[i]), set(sets[j])) >= 0.6 - 1e-9}
    got = [tuple(r) for r in similar_records(df, "id", item, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r[0]: r[1] for r in record_sets(df, "id", item)[1].collect()}
    few = {tuple(r) for r in similar_records(df, "id", item, 0.6, expand_copies=False).collect()}
    assert {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if classes[i] == classes[j] or tuple(sorted((classes[i], classes[j]))) in few} == want
    assert similar_records(df.limit(0), "id", item, 0.6).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 400)] + [(1000, k) for k in range(1001, 1400)] + [(rnd.randrange(2000, 3000), rnd.randrange(2000, 3000)) for _ in range(600)]
    chain = list(range(5000, 5200))
    rnd.shuffle(chain)
    edges += list(itertools.pairwise(chain))
    rows = edges + [(b, a) for a, b in edges[:200]] + edges[:50] + [(7, 7), (None, 8), (9, None)]
    df = spark.createDataFrame(rows, "p long, x long").repartition(3)
    got = {r["rec_id"]: r["group_id"] for r in connected_components(df, "p", "x").collect()}
    assert got == groups([(a, b) for a, b in edges if a != b])
    assert connected_components(df.limit(0), "p", "x").count() == 0
    assert {tuple(r) for r in connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "id1 string, id2 string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_terms(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(300), 70000, 70001]), rnd.choice(["a", "b", None]), rnd.choice([None, "", "x y", "Hot hot z", f"rare{rnd.randrange(200)} x"])) for _ in range(4000)]
    rows += [(i, "a", "dense") for i in range(65536, 65536 + 6000)] * 2 + [(2**40, "a", "far")]
    df = spark.createDataFrame(rows, "term long, attr string, records string").repartition(6)
    got = {(r["attr"], r["term"]): (r["occurrences"], r["records"], r["of_records"], r["is_rare"], r["is_common"]) for r in term_statistics(df, "term", F.col("attr"), words(F.col("records"))).collect()}
    count, ids, of = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for i, a, v in rows:
        if i is not None:
            for w in (v or "").lower().split():
                count[a, w] += 1
                ids[a, w].add(i)
                of[a].add(i)
    assert got == {k: (n, len(ids[k]), len(of[k[0]]), len(ids[k]) <= 2, len(ids[k]) > 0.1 * len(of[k[0]])) for k, n in count.items()}
    boxes = term_bitmaps(spark.createDataFrame([("a", "t", i) for i in range(5000)] + [("a", "u", 5)], "attr string, term string, id long").repartition(3)).collect()
    assert {(r["term"], r["records"], len(r["bitmap"])) for r in boxes} == {("t", 5000, 8192), ("u", 1, 2)}
    assert term_statistics(df.limit(0), "term", F.col("attr"), words(F.col("records"))).count() == 0
