from pyspark.sql import functions as F

from samewise.operators.evaluate import pairs_quality, translate_pairs
from samewise.operators.statistics import attribute_clusters, block_statistics, condition_counts, ranked, token_entropy
from samewise.plans.rules import ed, js
from samewise.sources.io import extract_field, numbered, read_csv, read_lines, read_profiles, read_records, record_text, to_attributes, write_pairs
from samewise.streaming.matching import match_stream


def test_csv_lines_and_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;t\n1; "q"\n2;"a ""b"";c"\n3;  \n')
    rows = read_csv(spark, str(tmp_path / "a.csv"), ";", trim=True).collect()
    assert [r["t"] for r in rows][1:] == ['a "b";c', None]
    (tmp_path / "l.txt").write_text("one\ntwo\n\nthree\n")
    assert [tuple(r) for r in read_lines(spark, str(tmp_path / "l.txt")).orderBy("id").collect()] == [(0, "one"), (1, "two"), (2, ""), (3, "three")]
    pairs = spark.createDataFrame([(1, 2)], "id1 long, id2 long")
    write_pairs(pairs, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out")).collect()] == [("1", "2")]
    write_pairs(pairs, str(tmp_path / "pq"), "parquet")
    assert read_records(spark, str(tmp_path / "pq"), "parquet").count() == 1


def test_attributes(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"], "x|y", 3.5, None)], "id long, l array<string>, s string, n double, z string")
    assert {tuple(r)[1:] for r in to_attributes(df, "id", "|").collect()} == {("l", "a"), ("l", "b"), ("s", "x"), ("s", "y"), ("n", "3.5")}
    rows = to_attributes(df, "id")
    assert {tuple(r)[1:] for r in rows.collect()} == {("l", "a"), ("l", "b"), ("s", "x|y"), ("n", "3.5")}
    assert extract_field(rows, "l").first()["value"] == "a b" and extract_field(rows, "z").count() == 0
    assert record_text(df.drop("l"), "id").first()["text"] == "x|y 3.5"


def test_field_values_reads_any_notation_of_the_name(spark, tmp_path):
    from samewise.queries.rules import field_values

    rows = [(1, "author", "B"), (1, " Author", "A"), (1, "AUTHOR ", "B"), (2, "author\t", "C"), (3, "authors", "D"), (4, "author", None), (5, None, "E"), (6, "Author", " ")]
    spark.createDataFrame(rows, "profile_id long, attr_key string, attr_value string").write.parquet(str(tmp_path / "key_values.parquet"))
    assert {tuple(r) for r in field_values(spark, str(tmp_path)).collect()} == {(1, "a b"), (2, "c")}


def test_attribute_queries_read_every_column(spark, tmp_path):
    from samewise.queries.rules import all_attributes_text, attribute_rows

    spark.createDataFrame([(7, "S", 3, -1.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "red tree", "B#1", "TIN", 5, 9.25), (2, None, "B#2", None, 6, None)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert {tuple(r) for r in attribute_rows(spark, str(tmp_path)).collect()} == {(7, "s_name", "S"), (7, "s_nationkey", "3"), (7, "s_acctbal", "-1.5")}
    assert {tuple(r) for r in all_attributes_text(spark, str(tmp_path)).collect()} == {(1, "red tree B#1 TIN 5 9.25"), (2, "B#2 6")}


def test_ranks_and_entropy(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("n"), F.col("id").cast("string").alias("token"))
    got = [r["rank"] for r in ranked(df, "token", "n").orderBy("n", "token").collect()]
    assert got == list(range(1000))
    assert [r["id"] for r in numbered(spark.range(100).select(F.col("id").alias("x")), "x", 5).orderBy("x").collect()] == list(range(5, 105))
    t = spark.createDataFrame([(["a", "b"],), (["a", "b"],)], "tokens array<string>")
    assert abs(token_entropy(t, F.col("tokens")).first()[0] - 1.0) < 1e-12
    assert token_entropy(t.limit(0), F.col("tokens")).first()[0] is None
    assert tuple(block_statistics(t.select(F.explode("tokens").alias("t")), "t").first()) == (2, 4, 2.0, 2)


def test_quality_and_remap(spark):
    p = lambda rows: spark.createDataFrame(rows, "id1 long, id2 long")
    r = pairs_quality(p([(1, 2), (2, 1), (3, 4)]), p([(1, 2), (5, 6), (7, 8)])).first()
    assert (r["candidates"], r["truth"], r["found"], r["pc"], r["pq"]) == (2, 3, 1, 1 / 3, 0.5)
    assert pairs_quality(p([]), p([])).first()["pc"] is None
    ids = spark.createDataFrame([(1, "a"), (2, "b")], "external long, internal string")
    assert [tuple(r) for r in translate_pairs(p([(1, 2), (1, 9)]), ids, ids).collect()] == [("a", "b")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "red tree"), (2, "blue")], "id long, t string").write.parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([(7, "tree red"), (8, "bleu")], "id long, t string")
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    got = []
    q = match_stream(stream, ref, js("t", 1.0) | ed("t", 2), "id", "id", lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert set(got) == {(1, 7), (2, 8)}
    q = match_stream(stream, ref.limit(0), js("t", 1.0), "id", "id", lambda df, n: got.append(df.count()), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert got[-1] == 0


def test_command_line(spark, tmp_path):
    from samewise.__main__ import main as run

    (tmp_path / "a.csv").write_text("key;t;n\n1;red tree;abc\n2;tree red;abd\n3;blue;xyz\n")
    (tmp_path / "b.csv").write_text("k;t;n\n9;red tree;abc\n")
    run([str(tmp_path / "a.csv"), "key", "t|JS|1.0,n|ED|1", str(tmp_path / "o"), "--separator", ";"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "o")).collect()] == [("1", "2")]
    run([str(tmp_path / "a.csv"), "key", "t|JS|1;n|ED|0", str(tmp_path / "p"), "--separator", ";", "--other", str(tmp_path / "b.csv"), "--other-id", "k", "--strategy", "chain"])
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "p")).collect()} == {("1", "9"), ("2", "9")}


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(900)]
    for name, part in (("a.txt", lines[:3]), ("b.txt", lines[3:800]), ("c.txt", []), ("d.txt", lines[800:])):
        (tmp_path / name).write_text("".join(f"{x}\n" for x in part))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("2000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted(tuple(r) for r in read_lines(spark, str(tmp_path), 5).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == [(k + 5, x) for k, x in enumerate(lines)]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key;t;n\nb ;red|tree;1\na;;2\n")
    rows = read_profiles(spark, str(tmp_path / "a.csv"), "key", 3, ";", inner_separator="|").orderBy("id").collect()
    assert [(r["id"], r["original_id"], [tuple(a) for a in r["attributes"]]) for r in rows] == [(3, "a", [("n", "2")]), (4, "b", [("t", "red"), ("t", "tree"), ("n", "1")])]
    (tmp_path / "b.csv").write_text('k,t\n1,"two\nlines"\n2,x\n')
    assert read_csv(spark, str(tmp_path / "b.csv"), multi_line=True).count() == 2
    (tmp_path / "c.csv").write_text("k,t\n")
    assert read_profiles(spark, str(tmp_path / "c.csv"), "k").count() == 0 and read_profiles(spark, str(tmp_path / "a.csv"), separator=";").count() == 2


def test_counts_and_clusters_of_attributes(spark):
    df = spark.createDataFrame([(1, "Red tree", "tree red", "x1", None), (2, "blue tree", "tree", "x2", None), (3, None, "blue", "x1", None)], "id long, a string, b string, c string, d string")
    got = {tuple(r) for r in condition_counts(df, js("a", 0.5) & ed("c", 1)).collect()}
    assert got == {("JS", "a", "tree", 2), ("JS", "a", "red", 1), ("JS", "a", "blue", 1), ("ED", "c", "x1", 2), ("ED", "c", "x2", 1)}
    clusters = attribute_clusters(df, "id", 0.5)
    assert [names for names, _ in clusters] == [["a", "b"], ["c"]] and abs(clusters[1][1] - 0.9182958) < 1e-6
    assert attribute_clusters(df.limit(0), "id") == []
