"""Wide tables and posting stretches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from samewise.operators.posting_runs import key_counts, posting_runs
from samewise.operators.wide import Attribute, nested_to_rows, read_date, read_number, unreadable_cells, wide_table

DATES = {
    "2019-07-17": (2019, 7, 17), " 2011-03-21": (2011, 3, 21), "2009/02/13": (2009, 2, 13), "23.07.2010": (2010, 7, 23), "03/07/2009": (2009, 7, 3), "20180616": (2018, 6, 16),
    "2005-05-07T00:00:00Z": (2005, 5, 7), "3 Dec 2014": (2014, 12, 3), "Jun 28, 2007": (2007, 6, 28), "16th of October 2001": (2001, 10, 16), "Sept. 5, 2003": (2003, 9, 5), "２０１９-0７-17": (2019, 7, 17),
    "31 Apr 2017": None, "2019-06": None, "2010": None, "tba": None, "20021131": None, "2019-13-01": None, "29.02.2001": None, "2019-07/17": None, "99999999999": None, "May 2019": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "s string").select("s", read_date(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in rows} == {k: v and datetime.date(*v) for k, v in DATES.items()}


@pytest.mark.parametrize(("text", "want"), [("c1995", 1995), ("(1983)", 1983), ("１９９４", 1994), ("2018/2019", None), ("20124", None), ("19??", None), ("٢٠٠١", 2001), ("0" * 30 + "1999", 1999), ("9" * 40, None), ("", None), (None, None)])
def test_years(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(read_number(1900, 2030)(F.col("s"))).first()[0] == want


ROWS = [
    (1, "Year ", "199x", 1), (1, "year", "1998", 2), (1, "year", "unknown", 3), (1, "author", "B", 1), (1, "author", "A", 2), (1, "author", "B", 2),
    (2, "year", "tba", 1), (2, " YEAR", "  ", 2), (3, "other", "1999", 1), (3, None, "2000", 1), (4, "year", None, 1), (None, "year", "2000", 1), (2, "year", "tba", 1),
]
SPEC = [Attribute("year", read_number(1900, 2030)), Attribute("author", "list"), Attribute("title")]


def test_wide(spark):
    df = spark.createDataFrame(ROWS, "cells long, k string, value string, pos int")
    got = {r[0]: tuple(r)[1:] for r in wide_table(df, "cells", "k", "value", SPEC, ("pos",)).collect()}
    assert got == {1: (1998, ["A", "B"], None), 2: (None, [], None), 3: (None, [], None), 4: (None, [], None)}
    assert {tuple(r) for r in unreadable_cells(df, "cells", "k", "value", SPEC, ("pos",)).collect()} == {(2, "year")}
    assert wide_table(df.limit(0), "cells", "k", "value", SPEC).count() == 0


def test_wide_keeps_further_attributes(spark):
    df = spark.createDataFrame([*ROWS, (1, "Other", "x", 1), (1, "other ", "y", 1), (1, "z", " ", 1)], "cells long, k string, value string, pos int")
    wide = wide_table(df, "cells", "k", "value", SPEC, ("pos",), "others")
    assert {r[0]: r["others"] for r in wide.collect()} == {1: {"other": ["x", "y"]}, 2: {}, 3: {"other": ["1999"]}, 4: {}}
    assert [tuple(r) for r in wide.drop("others").orderBy("cells").collect()] == [tuple(r) for r in wide_table(df, "cells", "k", "value", SPEC, ("pos",)).orderBy("cells").collect()]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert set(x.split("(")[1].split("#")[0] for x in plan.split("\n") if "Exchange hashpartitioning" in x) == {"entity"}
    assert wide_table(df.limit(0), "cells", "k", "value", SPEC, ("pos",), "others").count() == 0


def test_wide_queries_keep_every_attribute(spark, tmp_path):
    from samewise.queries.records import p4_nested, p4_wide

    keys = ["title", "number", "cite-label", "publtype", "url", "note", "sub", "crossref", "note-type", "sup", "ee", "cdrom", "month", "tt"]
    rows = spark.createDataFrame([(1, k, f"v {k}") for k in keys], "profile_id long, attr_key string, attr_value string")
    rows.withColumns({c: F.current_timestamp() for c in ("updated_at", "loaded_at")}).write.parquet(str(tmp_path / "key_values.parquet"))
    got = p4_wide(spark, str(tmp_path)).first().asDict()
    assert all(got[k.replace("-", "_")] == f"v {k}" for k in keys[:-1]) and got["others"] == "tt=v tt"
    keys = ["venue", "booktitle", "journal", "publtype", "title-bibtex", "name", "in", "date", "citation"]
    nested = [(1, [*((k, f"v {k}") for k in keys), ("author", "B"), ("author", "A"), ("authors", "C, D"), ("by", "E"), ("tt", "F")])]
    spark.createDataFrame(nested, "id long, attributes array<struct<attr_key: string, attr_value: string>>").write.parquet(str(tmp_path / "profiles.parquet"))
    got = p4_nested(spark, str(tmp_path)).first().asDict()
    assert all(got[k.replace("-", "_")] == f"v {k}" for k in keys) and got["others"] == "tt=F"
    assert (got["author"], got["n_authors"], got["authors"], got["by"]) == ("A|B", 2, "C, D", "E")


def test_wide_has_one_shuffle(spark):
    df = spark.createDataFrame(ROWS, "id long, k string, v string, u int")
    plan = wide_table(df, "id", "k", "v", SPEC, ("u",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and set(x.split("(")[1].split("#")[0] for x in plan.split("\n") if "Exchange hashpartitioning" in x) == {"entity"}


def test_nested(spark):
    df = spark.createDataFrame([(1, [("a", "x"), ("a", "y")]), (2, []), (3, None)], "id long, attrs array<struct<attr_key: string, attr_value: string>>")
    assert sorted(tuple(r) for r in nested_to_rows(df, "id", "attrs").collect()) == [(1, "a", "x"), (1, "a", "y")]


def brute_runs(rows):
    out, by = set(), {}
    for k, d in rows:
        if k is not None and d is not None:
            by.setdefault(k, set()).add(d)
    for k, ds in by.items():
        for d in ds:
            if d - 1 not in ds:
                e = d
                while e + 1 in ds:
                    e += 1
                out.add((k, d, e, e - d + 1))
    return out


def test_runs(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", "", None]), rnd.choice([None, *range(65000, 66500), *range(-300, 300), 255, 256, 2**40, 2**40 + 1])) for _ in range(6000)]
    rows += [("long", d) for d in range(65536 * 2 - 700, 65536 * 2 + 900)] * 2
    df = spark.createDataFrame(rows, "first_doc string, n long").repartition(5)
    want = brute_runs(rows)
    assert {tuple(r) for r in posting_runs(df, "first_doc", "n").collect()} == want
    assert {tuple(r) for r in posting_runs(df, "first_doc", "n", 5).collect()} == {w for w in want if w[3] >= 5}
    counts = {r[0]: (r[1], r[2]) for r in key_counts(df, "first_doc", "n").collect()}
    for k in {k for k, d in rows if k is not None and d is not None}:
        ds = [d for x, d in rows if x == k and d is not None]
        assert counts[k] == (len(ds), len(set(ds)))
    assert posting_runs(df.limit(0), "first_doc", "n").count() == 0


def test_queries_are_complete():
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and {"p4_found", "p7_found", "js_self_join"} <= set(names)


def test_library_does_without_the_optional_folder():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "samewise"
    for f in root.rglob("*.py"):
        if (root / "llm") not in f.parents:
            assert not re.search(r"(from|import)\s+samewise\.llm", f.read_text()), f
