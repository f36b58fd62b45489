"""Tokenizer, mixing and reading levels."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.llm import bpe
from samewise.llm.mixing import mix_report, mix_sources, token_targets
from samewise.llm.reading_level import reading_levels, spoken_words, train_levels
from samewise.llm.tokenize import BYTE_BPE_50K, TOKENIZERS, count_tokens, decode_ids, encode_texts

PATH = os.path.join(TOKENIZERS, BYTE_BPE_50K)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def mine(texts):
    ids, counts, where = bpe.vocabulary(PATH).encode(texts, offsets=True)
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)], [where[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


HARD = ["", " ", "\n", "it's 'S 're x'll''ve", "  's", "a 'd", "<|endoftext|>", "a" * 300, "no" * 400, " " * 200 + "x", "!?" * 90, "ab1 2é日😀​﻿", "\r\n\r\n 1", "퟿\U00013460 x", "'" * 60, "x  \n\n  "]


def test_hard_texts(reference):
    ids, starts = mine(HARD)
    assert ids == reference(HARD)
    vocab = bpe.vocabulary(PATH)
    for text, i, at in zip(HARD, ids, starts, strict=True):
        raw = text.encode()
        assert vocab.decode(i) == raw
        assert [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)][: len(at)], strict=True)] == [vocab.bytes_of[x] for x in i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab1 \n\t'stmdrevl!.-éß日")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_random_texts(reference, texts):
    assert mine(texts)[0] == reference(texts)


def test_long_texts_are_cut_where_nothing_changes(reference, monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice(["word ", "it's ", "  ", "\n", "x1", "- ", "日本 "]) for _ in range(3000))
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    import pyarrow as pa

    rows = [(a, b, ids.tolist(), c.tolist(), w.tolist()) for a, b, ids, c, w in bpe.encode_column(pa.array([text, None, "a b", text]), PATH, True)]
    want = reference([text, "", "a b", text])
    assert [x for r in rows for x in r[2]] == [x for w in want for x in w] and [c for r in rows for c in r[3]] == list(map(len, want))
    starts = [x for r in rows for x in r[4]]
    assert starts[: len(want[0])] == np.concatenate([[0], np.cumsum([len(bpe.vocabulary(PATH).bytes_of[i]) for i in want[0]])[:-1]]).tolist()


def test_encode_frame(spark, reference):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*HARD, None])], "ids long, text string")
    got = {r["ids0"]: r["ids"] for r in encode_texts(df.withColumnRenamed("ids", "ids0"), "ids0").collect()}
    assert got == dict(enumerate([*reference(HARD), []]))
    back = decode_ids(encode_texts(df.withColumnRenamed("ids", "n"), "n")).collect()
    assert {r["n"]: r["text"] for r in back} == dict(enumerate([*HARD, ""]))
    assert {r[0]: r[1] for r in count_tokens(df, ["ids"]).collect()} == {k: len(v) for k, v in got.items()}
    assert encode_texts(df.limit(0), "ids").count() == 0


def test_token_targets():
    out = token_targets({"a": 1000, "b": 10, "z": 0}, {"a": 0.5, "b": 0.4, "z": 0.1}, {"a": 1, "b": 5, "z": 9})
    assert out["b"] == pytest.approx(50) and out["a"] == pytest.approx(62.5) and out["z"] == 0
    out = token_targets({"a": 1000, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 5}, 800)
    assert out == {"a": 750.0, "b": 50.0}
    assert token_targets({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(k, s, rnd.choice([0, 5, 50, rnd.randint(1, 3000)])) for k, s in enumerate(rnd.choices(["big", "mid", "small", "other", None], [60, 25, 5, 8, 2], k=4000))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(4)
    goal = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 2), ("small", 0.2, 3), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, goal)
    got = mix.collect()
    assert {r["source"] for r in got} == {"big", "mid", "small"} and len(got) == sum(s in ("big", "mid", "small") for _, s, _ in rows)
    cap = {"big": 1, "mid": 2, "small": 3}
    assert all(0 <= r["copies"] <= cap[r["source"]] and abs(r["copies"] - r["rate"]) < 1 + 1e-9 for r in got)
    report = {r["source"]: r for r in mix_report(mix, goal).collect()}
    for s, share in (("big", 0.3), ("mid", 0.4), ("small", 0.2)):
        assert report[s]["actual_share"] == pytest.approx(share / 0.9, abs=2e-3)
    assert report["none"]["actual_share"] == 0 and report["small"]["most_repeats"] == 3
    fixed = {r["source"]: r for r in mix_report(mix_sources(docs, goal, total=1e12), goal).collect()}
    assert all(fixed[s]["mean_repeats"] == pytest.approx(cap[s]) for s in cap)
    assert mix_sources(docs.limit(0), goal).count() == 0 and mix_sources(docs, goal.limit(0)).count() == 0


CUES = "1\n00:00:01,000 --> 00:00:02,000 X1:063\n{\\an8}<i>The cat</i> is\n\n2\n00:00:03,000 --> 00:00:04,000\nANNA: big. [door\ncreaks] Go\n\n3\n0:04 --> 0:05\n# la la #\n\n4\n♪ na na\nna ♪\n\n5\n9 --> 10\nRipped by X for y.example\n\n6\n1 --> 2\n(glass shatters\n\n7\n(you) 日本"


def test_spoken_words():
    bucket, sentence, doc = spoken_words([CUES, "", "The cat"])
    assert doc.tolist() == [0] * 7 + [2] * 2 and bucket[:2].tolist() == bucket[-2:].tolist()
    assert len(set(sentence[:4])) == 1 and sentence[4] != sentence[3]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_cues_of_notes_only_leave_the_spoken_ones(end):
    after = "1\n00:00:01,000 --> 00:00:02,000\nThe cat is big.\n\n2\n00:00:03,000 --> 00:00:04,000\n♪ ♪\n\n3\n0:05 --> 0:06\n- ♪ ♪\n\n4\n0:07 --> 0:08\nGo now"
    before, song = "1\n0:01 --> 0:02\n♪ ♪\n\n2\n0:03 --> 0:04\nRun", "1\n0:01 --> 0:02\n♪ la la\nla na ♪\n\n2\n0:03 --> 0:04\n♪ ♪\nla la\n♪ ♪\n\n3\n0:05 --> 0:06\n#\nla la\n#"
    texts = [t.replace("\n", end) for t in ("Sit", before, after, "Hello", song, "[door\ncreaks] Go")]
    bucket, sentence, doc = spoken_words(texts)
    assert np.bincount(doc, minlength=6).tolist() == [1, 1, 6, 1, 0, 1]
    words = spoken_words(["Sit", "Run", "The cat is big. Go now", "Hello", "", "Go"])
    assert bucket.tolist() == words[0].tolist() and sentence.tolist() == words[1].tolist()


def test_levels(spark):
    rnd = random.Random(5)
    easy, hard, foreign = "cat dog sun big red".split(), "ontology epistemic heuristic normative axiom".split(), "le chien rouge est grand".split()
    common = "the of is and".split()

    def text(words, n=12):
        return "\n".join(" ".join(rnd.choice(words + (common if words is not foreign else [])) for _ in range(8)) + "." for _ in range(n))

    kinds = [rnd.choice([1, 4, 0]) for _ in range(300)]
    rows = [(k, text({1: easy, 4: hard, 0: foreign}[v]), "fr" if v == 0 else rnd.choice(["en", None])) for k, v in enumerate(kinds)]
    rows += [(1000, text(hard, 6) + "\n" + text(easy, 3), "fr"), (1001, None, "en"), (1002, "", None), (1003, "1 2 3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level string").repartition(3)
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(kinds) if v and k % 3 == 0], "doc_id long, reading_level int")
    model = train_levels(docs, labels, F.col("level") == "fr")
    got = {r["doc_id"]: r for r in reading_levels(docs, model).collect()}
    held_out = [k for k, v in enumerate(kinds) if k % 3]
    assert np.mean([got[k]["level"] == (kinds[k] or None) for k in held_out]) > 0.98
    assert got[1000]["level"] == 4 and got[1000]["level_words"][1] > 10
    assert all(got[k]["level"] is None and got[k]["n_words"] == 0 for k in (1001, 1002, 1003))
    assert reading_levels(docs.limit(0), model).count() == 0
