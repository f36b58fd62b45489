"""Profile matching: parts, exactness of the candidates, calibration, and held-out accuracy on invented profiles."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samewise.llm.entity_match import LEVELS, HammingScheme, calibrate, candidate_pairs, fit_weights, hamming_pairs, match_profiles, match_rate, reliability
from samewise.llm.profile_fields import COLUMNS, citation_parts, field_columns, numbers, numerals, surnames, venue_codes, word_hashes, years

SHAPE = pa.list_(pa.struct([("attr_key", pa.string()), ("attr_value", pa.string())]))


def test_parts():
    texts = pa.array(["L. Kra, Zad, K.. drif - fast cache estimation of data. J. Simi Res., 2017 pp. 271-282", "A B. one two three. , 1989 pp. 5-6", "Ra D. unified wrapper of .... Proc. ISTRS, Spring 1995", "no form at all", "", "A. Bo, C. two words here. n.a., 2018 pp. 417-428"])
    parts = [list(x) for x in zip(*(v.to_pylist() for v in citation_parts(texts).values()))]
    assert parts[0] == ["drif - fast cache estimation of data", "L. Kra, Zad, K", "J. Simi Res", " 2017", "271"]
    assert parts[1] == ["one two three", "A B", "", " 1989", "5"] and parts[2][:3] == ["unified wrapper of …", "Ra D", "Proc. ISTRS"]
    assert parts[3] == ["no form at all", "", "", "", ""] and parts[4] == [""] * 5
    assert parts[5] == ["two words here", "A. Bo, C", "n.a", " 2018", "417"]
    assert surnames(pa.array(["trefaziku, pavam and n. driveronu and s. sikro; et al.", "vatri, drote, stimo, g., p. brar, nakra ledra", ""])).to_pylist() == ["trefaziku driveronu sikro", "vatri stimo brar ledra", ""]
    assert years(pa.array(["Spring '99", "2003-06", "20031", "", "in 2014."])).tolist() == [1999, 2003, 0, 0, 2014]
    assert numbers(pa.array(["271-282", "", "p 5"])).tolist() == [271, -1, 5]
    assert numerals(word_hashes(pa.array(["part ii of 12", "", "iv"]))).to_pylist() == [[2, 12], [], [4]]
    code = lambda s: {chr(97 + c // 26) + chr(97 + c % 26) for c in venue_codes(pa.array([s]))[0].as_py()}
    assert code("Symposium on Graph Systems") == {"sy", "on", "gr"} and code("Proc. ISGRS") == {"pr", "is", "sg", "gr", "rs"}


def test_field_columns():
    rows = [[("Title ", "MÃ¡x  Flow"), ("authors", "A. Bo and Ci Do"), ("year", "n.a."), ("date", "1999")], None, [], [(None, "x"), ("title", None), ("venue", "?")], [("citation", "A. Bo. max flow. J. Net, 1999 pp. 3-9"), ("name", "max flow…")]]
    column = pa.array([None if r is None else [{"attr_key": k, "attr_value": v} for k, v in r] for r in rows], SHAPE)
    got = dict(zip(COLUMNS[1:], field_columns(column), strict=True))
    assert got["year"].to_pylist() == [1999, 0, 0, 0, 1999] and got["page"].to_pylist() == [-1, -1, -1, -1, 3] and got["cut"].to_pylist() == [False] * 4 + [True]
    for c in [c for c in COLUMNS if c[0] == "t"]:
        t = got[c].to_pylist()
        assert t[0] == t[4] and t[1] == t[2] == t[3] == 0
    later = dict(zip(COLUMNS[1:], field_columns(column.slice(3)), strict=True))
    assert all(later[c].to_pylist() == got[c].to_pylist()[3:] for c in later)
    assert all(len(x) == 0 for x in field_columns(column.slice(0, 0)))


@pytest.mark.parametrize(("radius", "chunks"), [(0, 1), (5, 3), (10, 7), (20, 14)])
def test_hamming_is_exact(spark, radius, chunks):
    rnd = random.Random(radius)
    base = [set(rnd.sample(range(128), rnd.randint(3, 50))) for _ in range(30)]
    sets = [s for b in base for s in (b, b ^ set(rnd.sample(range(128), rnd.randint(0, 24))))] + [set()]
    word = lambda s, k: int(np.uint64(sum(1 << (b - 64 * k) for b in s if b // 64 == k)).view(np.int64))
    rows = [(k, rnd.randrange(3), s) for k, s in enumerate(sets)]
    df = spark.createDataFrame([(k, src, word(s, 0), word(s, 1)) for k, src, s in rows], "id long, src int, b0 long, b1 long")
    pairs = hamming_pairs(df, ["b0", "b1"], HammingScheme(radius, chunks), F.col("id") % 2 == 0)
    got = [tuple(r) for r in pairs.collect()]
    near = lambda a, b: a[2] and b[2] and len(a[2] ^ b[2]) <= radius
    want = {(a[0], b[0]) for a, b in itertools.permutations(rows, 2) if near(a, b) and (a[1] < b[1] or a[1] == b[1] and a[0] < b[0] and (a[0] % 2 == 0 or b[0] % 2 == 0))}
    src = {r[0]: r[1] for r in rows}
    assert want <= set(got) and len(got) == len(set(got)) and all(src[a] <= src[b] for a, b in got)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().toString()


def _pairs(n, share, seed):
    """Patterns and whether they match; different pairs differ mostly in place and number."""
    rnd = np.random.RandomState(seed)
    match = rnd.rand(n) < share
    cols = {k: rnd.randint(0, size, n) for k, size in LEVELS.items()}
    cols["title"] = np.where(match, rnd.randint(15, 21, n), rnd.randint(12, 21, n))
    cols["authors"] = np.where(match, rnd.randint(7, 12, n), rnd.randint(5, 12, n))
    cols["place"] = np.where(match, rnd.choice([0, 4, 7, 7, 7, 11], n), rnd.choice([0, 5, 13, 17, 21, 21], n))
    return np.stack([cols[k] for k in LEVELS], axis=1), match


def test_weights_and_calibration():
    cross, match = _pairs(6000, 0.6, 1)
    same, _ = _pairs(1200, 0.0, 2)
    patterns, at = np.unique(np.concatenate([cross, same]), axis=0, return_inverse=True)
    across, within = np.bincount(at[:6000], minlength=len(patterns)), np.bincount(at[6000:], minlength=len(patterns))
    ratio = (~match).sum() / 1200
    model = fit_weights(patterns, across.astype(float), within.astype(float), ratio)
    place = model.shares["place"]
    assert place[0][7] - place[1][7] > 2 and place[1][21] - place[0][21] > 2
    model.curve = calibrate([(model.bins(patterns), across, within)], ratio)
    held, true = _pairs(6000, 0.6, 3)
    sure = model.curve[model.bins(held)]
    for low in np.arange(0, 1, 0.25):
        part = (sure >= low) & (sure < low + 0.25)
        assert part.sum() < 100 or abs(sure[part].mean() - true[part].mean()) < 0.12
    assert ((sure > 0.5) == true).mean() > 0.95
    assert match_rate(np.array([10.0, 0.0]), np.array([2.0, 0.0]), 2.0).tolist() == [0.6, 1.0]
    assert np.isfinite(fit_weights(np.zeros((0, len(LEVELS)), int), np.zeros(0), np.zeros(0)).classes).all()


def test_weights_among_many_unrelated_pairs():
    """Unrelated pairs grow with the square of the profiles; matches are still told from them."""
    rnd = np.random.RandomState(4)
    cols = {k: np.zeros(4000, int) for k in LEVELS}
    match = np.arange(4000) < 1000
    cols["title"] = np.where(match, rnd.randint(16, 21, 4000), rnd.randint(12, 19, 4000))
    cols["authors"] = np.where(match, rnd.randint(8, 11, 4000), rnd.randint(0, 3, 4000))
    cols["place"] = np.where(match, rnd.choice([4, 7], 4000), rnd.choice([4, 5, 9, 13, 17, 21], 4000))
    cols["extra"] = np.where(match, rnd.randint(0, 2, 4000), rnd.randint(0, 4, 4000))
    patterns, at = np.unique(np.stack([cols[k] for k in LEVELS], axis=1), axis=0, return_inverse=True)
    matches, others = (np.bincount(np.ravel(at)[x], minlength=len(patterns)).astype(float) for x in (match, ~match))
    for times in (1, 100, 10_000):
        score = fit_weights(patterns, matches + times * others, 0.01 * times * others, 100.0).scores(patterns)
        assert matches[score > 0].sum() > 950 and others[score > 0].sum() < 30, times


def test_match(spark):
    rnd = random.Random(8)
    syllable = lambda n: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(n))
    topics = ["graph", "cache", "index", "query", "stream", "join"]

    def typo(t):
        k = rnd.randrange(len(t))
        return t[:k] + rnd.choice("abc") + t[k + 1 :] if rnd.random() < 0.5 else t

    rows, truth = [], set()
    for k in range(150):
        title = f"{syllable(4)}: {rnd.choice(topics)} {rnd.choice(topics)} for {syllable(3)} data"
        names = [(syllable(2).title(), syllable(3).title()) for _ in range(rnd.randint(1, 3))]
        year, topic = rnd.randint(1980, 2020), rnd.choice(topics)
        if rnd.random() < 0.7:
            rows.append((k, "a", [("title", typo(title)), ("authors", "; ".join(f"{a} {b}" for a, b in names)), ("venue", f"Journal of {topic} Research"), ("year", str(year))]))
        if rnd.random() < 0.7:
            rows.append((1000 + k, "b", [*(("author", f"{b}, {a[0]}.") for a, b in names), ("title", typo(title).upper()), ("journal", f"J. {topic[:4]} Res."), ("year", str(year) if rnd.random() < 0.8 else "")]))
        if rnd.random() < 0.2:
            rows.append((2000 + k, "b", [*(("author", f"{b}, {a[0]}.") for a, b in names), ("title", title), ("journal", "J. Othe Res."), ("year", str(year + 5))]))
        have = {r[0] for r in rows}
        if {k, 1000 + k} <= have:
            truth.add((k, 1000 + k))
    rows += [(5000, "a", None), (5001, "b", []), (None, "a", [("title", "x y")]), (5002, None, [("title", "x y")]), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "id long, ds string, title array<struct<attr_key: string, attr_value: string>>").repartition(3)
    got = match_profiles(df, "id", "ds", "title").collect()
    found = {(r["id1"], r["id2"]) for r in got}
    assert len(found & truth) / len(truth) > 0.95 and len(found & truth) / len(found) > 0.95
    for least in (0.5, 0.9):
        assert all(least <= r["confidence"] <= 1 for r in match_profiles(df, "id", "ds", "title", least=least).collect())
    assert match_profiles(df.limit(0), "id", "ds", "title").count() == 0
    assert reliability(df.limit(0), "id", "ds", "title").count() == 0
    table = reliability(df, "id", "ds", "title").collect()
    assert table and all(0 <= r["mean_confidence"] <= 1 and 0 <= r["match_rate"] <= 1 and r["pairs"] > 0 for r in table)


def test_untitled_profiles_are_compared(spark):
    cols = [*(f"t{k}" for k in range(8)), *(f"a{k}" for k in range(4))]
    rows = [(1, 0, *([5] * 8), *([9] * 4)), (2, 1, *([0] * 8), *([9] * 4)), (3, 1, *([0] * 8), *([0] * 4)), (4, 0, *([0] * 12))]
    df = spark.createDataFrame(rows, "id long, src int, " + ", ".join(f"{c} long" for c in cols))
    assert [tuple(r) for r in candidate_pairs(df, F.lit(False), 4, 2).collect()] == [(1, 2)]


def test_one_row_an_id(spark):
    a = [{"attr_key": "title", "attr_value": "fast graph cache of kroduvan data"}, {"attr_key": "by", "attr_value": "Bo Skedra"}]
    b = [{"attr_key": "title", "attr_value": "zzz"}]
    shape = "id string, dataset string, attributes array<struct<attr_key: string, attr_value: string>>"
    rows = [("x", "m", a), ("x", "m", b), ("y", "n", a)] + [(f"o{k}", "mn"[k % 2], [{"attr_key": "title", "attr_value": f"other {k} thing {k * 7919} of {k * 31}"}]) for k in range(20)]
    for seed in range(2):
        df = spark.createDataFrame(rows[:: 1 - 2 * seed], shape).repartition(3)
        assert ("x", "y") in {(r["id1"], r["id2"]) for r in match_profiles(df, least=0.0).collect()}
