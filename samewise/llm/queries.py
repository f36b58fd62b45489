"""The queries of this folder's operators, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import normalize, strip, word_set, words
from samewise.llm.components import connected_components
from samewise.llm.entity_match import match_profiles, reliability
from samewise.llm.mixing import mix_report, mix_sources
from samewise.llm.near_dup import near_duplicate_groups
from samewise.llm.overlap_join import record_sets, similar_pairs, similar_records
from samewise.llm.reading_level import reading_levels, train_levels
from samewise.llm.term_stats import term_statistics
from samewise.llm.tokenize import count_tokens, decode_ids, encode_texts
from samewise.queries.tables import rule_threshold, table

TERM_KEYS = ("title", "author", "booktitle", "journal", "publisher")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(table(spark, d, "films"), "doc_id", word_set(F.col("plot")), rule_threshold(spark, d, "r1", "plot"))


def _terms(spark: SparkSession, d: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    rows = table(spark, d, "key_values").withColumn("k", F.lower(strip(F.col("attr_key"))))
    return term_statistics(rows if keys is None else rows.where(F.col("k").isin(*keys)), "profile_id", F.col("k"), words(F.col("attr_value")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return _terms(spark, d, TERM_KEYS).select(F.col("attr").alias("attr_key"), "term", F.explode(marks).alias("mark"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("attr").alias("attr_key"), "term", "occurrences", "records", "of_records", "is_rare", "is_common")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_records(table(spark, d, "js_index"), "doc_id", normalize(strip(F.col("term"))), rule_threshold(spark, d, "r3", "term"))
    return pairs.select(F.col("id1").alias("doc_id1"), F.col("id2").alias("doc_id2"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    sets, members = record_sets(table(spark, d, "js_index"), "doc_id", normalize(strip(F.col("term"))))
    pairs = similar_pairs(sets, rule_threshold(spark, d, "r3", "term"))
    links = pairs.select(F.explode(F.array("id1", "id2")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    return members.join(links, "rep", "left").select(F.col("rec_id").alias("doc_id"), F.col("rep").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_linked_classes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(table(spark, d, "match_pairs"), "id1", "id2")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = decode_ids(encode_texts(table(spark, d, "documents"), offsets=True))
    last = F.get("starts", F.size("starts") - 1)
    return coded.select("doc_id", F.md5("text").alias("text_md5"), F.octet_length("text").alias("n_bytes"), F.coalesce(last < F.octet_length("text"), F.lit(True)).alias("offsets_within"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    names = [r["source"] for r in targets.select("source").distinct().collect()]
    wanted = table(spark, d, "documents").where(F.col("source").isin(*names))
    return mix_sources(count_tokens(wanted, ["doc_id", "source"]), targets), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].select("doc_id", "source", "n_tokens", "rate", "copies")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(*_mix(spark, d))


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Each source: its cap, whether no document is used more often, and whether it misses its target by no more than its largest document."""
    report = p9_report(spark, d)
    near = F.abs(F.coalesce("miss_tokens", F.lit(0.0))) <= F.col("largest_tokens")
    return report.select("source", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), near.alias("near_target"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    lang = F.lower(strip(F.col("lang")))
    other = lang.isNotNull() & ~lang.startswith("en") & ~lang.isin("", "und", "unknown", "mul")
    return reading_levels(documents, train_levels(documents, table(spark, d, "level_labels"), other))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where((F.col("n_words") > 0) & (F.get("level_words", F.lit(4)) * 2 > F.col("n_words"))).select("doc_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level", "confidence", "n_words")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return match_profiles(table(spark, d, "profiles")).select("id1", "id2")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return match_profiles(table(spark, d, "profiles"))


def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    return reliability(table(spark, d, "profiles"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_terms, p3_found, p3_classes, p5_found, p6_found, p6_matches, p6_reliability, p8_ids, p8_round_trip, p9_mix, p9_report, p9_bounds, p10_found, p10_levels)}

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_OCCURRENCES = f"""select profile_id, lower(trim(attr_key)) k, unnest({_WORDS.format('attr_value')}) term from key_values where profile_id is not null"""
_STATS = f"""with o as ({_OCCURRENCES}), n as (select k, count(distinct profile_id) of_records from o group by 1)
 select o.k attr_key, term, count(*) occurrences, count(distinct profile_id) records, any_value(of_records) of_records,
 count(distinct profile_id) <= 2 is_rare, count(distinct profile_id) > 0.1 * any_value(of_records) is_common from o join n on o.k is not distinct from n.k group by 1, 2"""
_SETS = """s as (select doc_id, list_sort(list(distinct lower(trim(term)))) items from js_index where trim(term) <> '' and doc_id is not null group by 1)"""
_SHARED = """i as (select doc_id, unnest(items) x, len(items) n from s),
 p as (select a.doc_id doc_id1, b.doc_id doc_id2 from i a join i b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2, a.n, b.n having count(*) >= {0} * (a.n + b.n - count(*)) - 1e-9)"""


def _grouped(edges: str, names: tuple[str, str]) -> str:
    """Groups of the edges (a, b) by the transitive closure."""
    return f"""with recursive e as ({edges}), u as (select a x, b y from e union select b, a from e),
 t(x, y) as (select x, y from u union select t.x, u.y from t join u on t.y = u.x) select x {names[0]}, min(least(x, y)) {names[1]} from t group by x"""


ORACLE = {
    "p1_found": _grouped(f"""select distinct a.doc_id a, b.doc_id b from (select doc_id, x, len(ws) n from (select distinct doc_id, list_distinct({_WORDS.format('plot')}) ws from films) , unnest(ws) t(x)) a
 join (select doc_id, x, len(ws) n from (select distinct doc_id, list_distinct({_WORDS.format('plot')}) ws from films), unnest(ws) t(x)) b on a.x = b.x and a.doc_id < b.doc_id
 group by a.doc_id, b.doc_id, a.n, b.n having count(*) >= (select threshold from rules where rule_id = 'r1') * (a.n + b.n - count(*)) - 1e-9""", ("doc_id", "group_id")),
    "p2_found": f"""select attr_key, term, mark from (select * from ({_STATS}) where attr_key in {TERM_KEYS}), (values ('rare'), ('common')) m(mark)
 where (mark = 'rare' and is_rare) or (mark = 'common' and is_common)""",
    "p2_terms": _STATS,
    "p3_found": f"with {_SETS}, {_SHARED.format("(select threshold from rules where rule_id = 'r3')")} select * from p",
    "p3_classes": f"""with {_SETS}, {_SHARED.format("(select threshold from rules where rule_id = 'r3')")},
 c as (select doc_id, min(doc_id) over (partition by items) class_id from s),
 l as (select x class_id, count(distinct y) n from (select a.class_id x, b.class_id y from p join c a on a.doc_id = doc_id1 join c b on b.doc_id = doc_id2
  union select b.class_id, a.class_id from p join c a on a.doc_id = doc_id1 join c b on b.doc_id = doc_id2) where x <> y group by 1)
 select doc_id, class_id, coalesce(n, 0) n_linked_classes from c left join l using (class_id)""",
    "p5_found": _grouped("select distinct id1 a, id2 b from match_pairs where id1 <> id2", ("rec_id", "group_id")),
    "p9_bounds": "select source, max_repeats, true within_cap, true near_target from mix_targets",
    "p8_round_trip": "select doc_id, md5(coalesce(text, '')) text_md5, cast(strlen(coalesce(text, '')) as int) n_bytes, true offsets_within from documents",
}
