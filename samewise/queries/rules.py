"""Queries of the rule joins and their parts, and the SQL that gives the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.text import normalize, qgrams, strip, tokens, word_set
from samewise.operators.candidates import ed_gram_candidates, ed_postings, gram_frequency, js_postings, ordered_grams, ordered_tokens, token_frequency
from samewise.operators.evaluate import pairs_quality, translate_pairs
from samewise.operators.rule_join import Side, all_conditions_hold, clustered_join, join_sides, join_with_rules, members, minhash_candidates
from samewise.operators.statistics import block_statistics, condition_counts, gram_entropy, ranked, token_entropy
from samewise.plans.rules import Rule, ed, from_rows, from_tuples, js, parse_rule
from samewise.queries.tables import table
from samewise.session import checkpoint, scratch_path
from samewise.sources.io import extract_field, numbered, read_lines, read_profiles, record_text, to_attributes, write_pairs

Q = 2


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _films(spark: SparkSession, d: str) -> DataFrame:
    """One row a film: rows delivered again have the same content."""
    return table(spark, d, "films").dropDuplicates(["doc_id"])


def _tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), tokens(normalize(F.col(text))).alias("tokens"))


def _values(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), normalize(F.col(text)).alias("value"))


# --- parts


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("tokens"))


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return token_frequency([_tokens(_documents(spark, d), "doc_id", "text")])


def token_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(token_df(spark, d), "token", "df")


def qgram_list(spark: SparkSession, d: str) -> DataFrame:
    return _values(table(spark, d, "customer"), "c_custkey", "c_name").select("id", F.explode(qgrams(F.col("value"), Q)).alias("g")).select("id", "g.gram", "g.pos")


def qgram_df(spark: SparkSession, d: str) -> DataFrame:
    return gram_frequency([_values(table(spark, d, "part"), "p_partkey", "p_name")], Q)


def js_prefix_index(spark: SparkSession, d: str) -> DataFrame:
    frame = _tokens(_films(spark, d), "doc_id", "plot")
    return js_postings(ordered_tokens(frame, token_frequency([frame])), 0.8).select("token", "id", "pos", "n")


def ed_prefix_index(spark: SparkSession, d: str) -> DataFrame:
    frame = _values(_films(spark, d), "doc_id", "director")
    return ed_postings(ordered_grams(frame, gram_frequency([frame], Q), Q), 2, Q).select("gram", "id", "pos", (F.col("sorted_pos") + 1).alias("sorted_pos"), "n")


def block_stats(spark: SparkSession, d: str) -> DataFrame:
    return block_statistics(js_prefix_index(spark, d), "token").select("blocks", "postings", F.round("mean_size", 9).alias("mean_size"), "largest")


def entropy_js(spark: SparkSession, d: str) -> DataFrame:
    return token_entropy(_tokens(table(spark, d, "part"), "p_partkey", "p_name"), F.col("tokens")).select(F.round("entropy", 6).alias("entropy"))


def entropy_ed(spark: SparkSession, d: str) -> DataFrame:
    return gram_entropy(table(spark, d, "part"), normalize(F.col("p_name")), Q).select(F.round("entropy", 6).alias("entropy"))


def attribute_rows(spark: SparkSession, d: str) -> DataFrame:
    return to_attributes(table(spark, d, "supplier"), "s_suppkey")


def field_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "key_values").select(F.col("profile_id").alias("id"), F.lower(strip(F.col("attr_key"))).alias("attr_key"), "attr_value")
    return extract_field(rows.where("attr_key = 'author'").distinct(), "author")


def all_attributes_text(spark: SparkSession, d: str) -> DataFrame:
    return record_text(table(spark, d, "part"), "p_partkey")


# --- joins


def js_self_join(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), js("plot", 0.7), "doc_id")


def js_self_join_low(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), js("title", 0.5), "doc_id")


def ed_self_join(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(table(spark, d, "customer"), ed("c_name", 1), "c_custkey", q=3)


def ed_self_join_short(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(table(spark, d, "nation"), ed("n_name", 3), "n_nationkey")


FILM_RULE = (js("title", 0.8) & js("director", 0.7)) | (js("cast_list", 0.7) & ed("title", 2))


def rule_and(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), js("title", 0.5) & js("director", 0.5) & js("cast_list", 0.3), "doc_id")


def rule_or(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), js("plot", 0.8) | js("director", 0.9) & js("writer", 0.9), "doc_id")


def rule_dnf(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), FILM_RULE, "doc_id")


def rule_from_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rules").where("rule_id = 'r2'").collect()  # a rule's conditions, a fixed few
    return join_with_rules(_films(spark, d), from_rows(rows), "doc_id")


def rule_text_form(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), parse_rule("title|JS|0.8,director|JS|0.7;cast_list|JS|0.7,title|ED|2"), "doc_id")


def rule_missing_drop(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), FILM_RULE, "doc_id", missing="drop_record")


def rule_same_attribute(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), js("title", 0.6) & ed("title", 4), "doc_id")


def join_rows(spark: SparkSession, d: str) -> DataFrame:
    films = _films(spark, d).select("doc_id", "title", "plot", "release_year")
    return join_with_rules(films, js("plot", 0.7), "doc_id", output="rows")


def two_table_join(spark: SparkSession, d: str) -> DataFrame:
    films = _films(spark, d).select("doc_id", "title", "director")
    names = films.select(F.col("doc_id").alias("film"), F.col("title").alias("name"), F.col("director").alias("person"))
    rule = from_tuples([[("title", "name", "JS", 0.6), ("director", "person", "JS", 0.5)]])
    return join_with_rules(films, rule, "doc_id", names, "film")


def two_table_cross_attr(spark: SparkSession, d: str) -> DataFrame:
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    return join_with_rules(supplier, ed("s_name", 8, "c_name") & js("s_name", 0.3, "c_name"), "s_suppkey", customer, "c_custkey", q=3)


def two_table_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    other = table(spark, d, "part").select("p_partkey", "p_name")
    return join_with_rules(part, js("p_name", 0.6), "p_partkey", other, "p_partkey", output="rows")


def _chain(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return join_with_rules(_films(spark, d), FILM_RULE, "doc_id", strategy=strategy)


def chain_strategy(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, "chain")


def dedup_strategy(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d, "chain_dedup")


def ordered_by_entropy(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), FILM_RULE, "doc_id", order="entropy_desc")


def ordered_by_block_size(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(_films(spark, d), FILM_RULE, "doc_id", order="block_size_asc")


def _sets(spark: SparkSession, d: str) -> list[DataFrame]:
    films = _films(spark, d)
    return [join_with_rules(films, rule, "doc_id") for rule in (js("title", 0.5), js("director", 0.5), js("cast_list", 0.3))]


def all_conditions_group(spark: SparkSession, d: str) -> DataFrame:
    return all_conditions_hold(_sets(spark, d))


def pairs_intersect(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.intersect, _sets(spark, d))


def pairs_union(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _sets(spark, d)[:2]).distinct()


def pairs_except(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _sets(spark, d)
    return a.exceptAll(b)


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return clustered_join(_films(spark, d), "doc_id", [(["title", "director"], 8.0), (["plot"], 10.0)], 0.6)


def pc_pq(spark: SparkSession, d: str) -> DataFrame:
    films = _films(spark, d)
    found = join_with_rules(films, js("plot", 0.8), "doc_id")
    truth = join_with_rules(films, js("plot", 0.6), "doc_id")
    return pairs_quality(found, truth).select("candidates", "truth", "found", F.round("pc", 9).alias("pc"), F.round("pq", 9).alias("pq"))


def truth_remap(spark: SparkSession, d: str) -> DataFrame:
    films = _films(spark, d)
    ids = films.where("imdbid is not null").groupBy(F.col("imdbid").alias("external")).agg(F.min("doc_id").alias("internal"))
    pairs = table(spark, d, "documents").where("imdbid is not null").select(F.col("imdbid").alias("id1"), F.col("imdbid").alias("id2")).distinct()
    return translate_pairs(pairs, ids, ids)


def ed_count_filter(spark: SparkSession, d: str) -> DataFrame:
    frame = _values(_films(spark, d), "doc_id", "title")
    return ed_gram_candidates(frame, frame, 2, True, Q)


def ed_and(spark: SparkSession, d: str) -> DataFrame:
    return join_with_rules(table(spark, d, "customer"), ed("c_name", 1) & ed("c_mktsegment", 2), "c_custkey", q=3)


def pretokenized_join(spark: SparkSession, d: str) -> DataFrame:
    films = _films(spark, d).select("doc_id", tokens(normalize(F.col("plot"))).alias("plot"))
    return join_with_rules(films, js("plot", 0.7), "doc_id", tokenized=("plot",))


def js_classes(spark: SparkSession, d: str) -> DataFrame:
    """Links of classes of equal titles, and how many films each side has."""
    films = _films(spark, d)
    links = join_with_rules(films, js("title", 0.5), "doc_id", output="classes")
    sizes = members(films, js("title", 0.5), "doc_id").groupBy("key").agg(F.min("rec").alias("first"), F.count("*").alias("n"))
    side = lambda k: sizes.select(F.col("key").alias(f"class{k}"), F.col("first").alias(f"first{k}"), F.col("n").alias(f"n{k}"))
    both = links.hint("merge").join(side(1), "class1").hint("merge").join(side(2), "class2")
    flip = F.col("first1") > F.col("first2")
    pick = lambda c, a, b: F.when(flip, F.col(f"{c}{b}")).otherwise(F.col(f"{c}{a}"))
    return both.select(pick("first", 1, 2).alias("first1"), pick("first", 2, 1).alias("first2"), pick("n", 1, 2).alias("n1"), pick("n", 2, 1).alias("n2"))


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return condition_counts(_films(spark, d), js("title", 0.8) & js("director", 0.7) | ed("release_year", 1))


def csv_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as CSV, read as profiles, one attribute a row."""
    path = scratch_path(spark)
    table(spark, d, "part").write.csv(path, header=True, quote='"', escape='"')
    return read_profiles(spark, path, "p_partkey", 5).select("id", "original_id", F.explode("attributes").alias("a")).select("id", "original_id", "a.attr_key", "a.attr_value")


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts written as lines, in several files, and numbered as they are read."""
    path = scratch_path(spark)
    table(spark, d, "part").repartitionByRange(7, "p_partkey").sortWithinPartitions("p_partkey").select("p_name").write.text(path)
    return read_lines(spark, path)


def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return numbered(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 10)


def written_pairs(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark)
    write_pairs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id1"), F.col("s_nationkey").alias("id2")), path)
    return spark.read.csv(path, schema="id1 long, id2 long")


def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    """The number of similar pairs, and whether MinHash candidates hold at least nine tenths of them."""
    films, rule = _films(spark, d), js("plot", 0.8)
    side = Side(films, "doc_id", rule.conditions, "left", "condition_false")
    truth = checkpoint(join_sides(side, side, rule, True))
    side.free()
    # only candidates among the similar pairs count here, so that the others need not be found
    quality = pairs_quality(minhash_candidates(films, "doc_id", "plot", 0.7, among=truth), truth)
    return quality.select("truth", (F.coalesce("pc", F.lit(1.0)) >= 0.9).alias("reached"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return minhash_candidates(_films(spark, d), "doc_id", "plot", 0.7)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, token_df, token_rank, qgram_list, qgram_df, js_prefix_index, ed_prefix_index, block_stats, entropy_js, entropy_ed, attribute_rows, field_values,
        all_attributes_text, js_self_join, js_self_join_low, ed_self_join, ed_self_join_short, rule_and, rule_or, rule_dnf, rule_from_table, rule_text_form,
        rule_missing_drop, rule_same_attribute, join_rows, two_table_join, two_table_cross_attr, two_table_rows, chain_strategy, dedup_strategy, ordered_by_entropy,
        ordered_by_block_size, all_conditions_group, pairs_intersect, pairs_union, pairs_except, clustered, pc_pq, truth_remap, lsh_candidates, lsh_recall, ed_count_filter, ed_and, pretokenized_join,
        js_classes, rule_counts, csv_profiles, text_lines, numbered_rows, written_pairs,
    )
}


def _t(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(trim({c})), '[^a-z0-9]'), lambda x: length(x) > 0))"


_F = "(select doc_id, any_value(title) title, any_value(director) director, any_value(writer) writer, any_value(cast_list) cast_list, any_value(plot) plot, any_value(release_year) release_year from films group by 1)"
_AF = rf"(select * from {_F} where title is null or regexp_full_match(title, '[\x01-\x7f]*'))"
_GRAMS = "(select {id} id, {v} v, unnest(generate_series(1, greatest(length({v}) - 1, 1))) i from {t} where length({v}) > 0)"


def _js(name: str, source: str, key: str, attr: str, t: float) -> str:
    """CTEs: pairs (id1, id2) with Jaccard >= t, by counting shared tokens."""
    return f"""{name}_i as (select {key} id, unnest({_t(attr)}) x, len({_t(attr)}) n from {source}),
 {name} as (select a.id id1, b.id id2 from {name}_i a join {name}_i b on a.x = b.x and a.id < b.id group by 1, 2, a.n, b.n having count(*) >= {t} * (a.n + b.n - count(*)) - 1e-9)"""


def _ed(name: str, source: str, key: str, attr: str, k: int) -> str:
    return f"""{name}_v as (select {key} id, lower(trim({attr})) v from {source} where trim({attr}) <> ''),
 {name} as (select a.id id1, b.id id2 from {name}_v a join {name}_v b on a.id < b.id and abs(length(a.v) - length(b.v)) <= {k} where levenshtein(a.v, b.v) <= {k})"""


_DNF = f"""with {_js('a', _AF, 'doc_id', 'title', 0.8)}, {_js('b', _AF, 'doc_id', 'director', 0.7)}, {_js('c', _AF, 'doc_id', 'cast_list', 0.7)}, {_ed('e', _AF, 'doc_id', 'title', 2)}
 (select * from a intersect select * from b) union (select * from c intersect select * from e)"""
_DROP = f"(select * from {_AF} where len({_t('title')}) > 0 and len({_t('director')}) > 0 and len({_t('cast_list')}) > 0)"
_SETS = f"with {_js('a', _F, 'doc_id', 'title', 0.5)}, {_js('b', _F, 'doc_id', 'director', 0.5)}, {_js('c', _F, 'doc_id', 'cast_list', 0.3)} "
_INDEX = f"""i as (select doc_id id, unnest({_t('plot')}) token, len({_t('plot')}) n from {_F}), f as (select token, count(*) df from i group by 1),
 x as (select token, id, row_number() over (partition by id order by df, token) pos, n from i join f using (token)),
 p as (select token, id, cast(pos as int) pos, cast(n as int) n from x where pos <= n - ceil(n * 0.8 - 1e-9) + 1)"""
_DOC = f"(select doc_id id, unnest({_t('text')}) token from documents)"
_DIRECTORS = f"(select doc_id, lower(trim(director)) v from {_F} where regexp_full_match(lower(trim(director)), '[a-z .,]+'))"

ORACLE = {
    "tokenize": f"select doc_id, array_to_string(list_sort({_t('text')}), ' ') tokens from documents",
    "token_df": f"select token, count(*) df from {_DOC} group by 1",
    "token_rank": f"select token, df, row_number() over (order by df, token) - 1 rank from (select token, count(*) df from {_DOC} group by 1)",
    "qgram_list": f"select id, substr(v, i, 2) gram, cast(i - 1 as int) pos from {_GRAMS.format(id='c_custkey', v='lower(trim(c_name))', t='customer')}",
    "qgram_df": f"select substr(v, i, 2) gram, count(*) tf from {_GRAMS.format(id='p_partkey', v='lower(trim(p_name))', t='part')} group by 1",
    "js_prefix_index": f"with {_INDEX} select * from p",
    "ed_prefix_index": f"""with g as (select id, substr(v, i, 2) gram, cast(i - 1 as int) pos from {_GRAMS.format(id='doc_id', v='v', t=_DIRECTORS)}), f as (select gram, count(*) tf from g group by 1)
 select gram, id, pos, cast(sorted_pos as int) sorted_pos, cast(n as int) n from (select gram, id, pos, row_number() over (partition by id order by tf, gram, pos) sorted_pos, count(*) over (partition by id) n from g join f using (gram)) where sorted_pos <= 5""",
    "block_stats": f"with {_INDEX} select count(*) blocks, cast(sum(c) as bigint) postings, round(avg(c), 9) mean_size, max(c) largest from (select count(*) c from p group by token having count(*) > 1)",
    "entropy_js": f"with c as (select count(*) n from (select unnest({_t('p_name')}) x from part) group by x), s as (select sum(n) t from c) select round(-sum(n / t * log2(n / t)), 6) entropy from c, s",
    "entropy_ed": f"with c as (select count(*) n from {_GRAMS.format(id='p_partkey', v='lower(trim(p_name))', t='part')} group by substr(v, i, 2), i), s as (select sum(n) t from c) select round(-sum(n / t * log2(n / t)), 6) entropy from c, s",
    "attribute_rows": " union all ".join(f"select s_suppkey id, '{c}' attr_key, cast({c} as varchar) attr_value from supplier where {c} is not null" for c in ("s_name", "s_nationkey", "s_acctbal")),
    "field_values": """select * from (select profile_id id, lower(string_agg(attr_value, ' ' order by attr_value)) "value" from (select distinct profile_id, attr_value from key_values where lower(trim(attr_key)) = 'author' and attr_value is not null) group by 1) where trim("value") <> ''""",
    "all_attributes_text": "select p_partkey id, concat_ws(' ', p_name, p_brand, p_type, cast(p_size as varchar), cast(p_retailprice as varchar)) \"text\" from part",
    "js_self_join": f"with {_js('a', _F, 'doc_id', 'plot', 0.7)} select * from a",
    "js_self_join_low": f"with {_js('a', _F, 'doc_id', 'title', 0.5)} select * from a",
    "ed_self_join": f"with {_ed('a', 'customer', 'c_custkey', 'c_name', 1)} select * from a",
    "ed_self_join_short": f"with {_ed('a', 'nation', 'n_nationkey', 'n_name', 3)} select * from a",
    "rule_and": _SETS + "select * from a intersect select * from b intersect select * from c",
    "rule_or": f"with {_js('a', _F, 'doc_id', 'plot', 0.8)}, {_js('b', _F, 'doc_id', 'director', 0.9)}, {_js('c', _F, 'doc_id', 'writer', 0.9)} select * from a union (select * from b intersect select * from c)",
    **dict.fromkeys(("rule_dnf", "rule_from_table", "rule_text_form", "chain_strategy", "dedup_strategy", "ordered_by_entropy", "ordered_by_block_size"), _DNF),
    "rule_missing_drop": _DNF.replace(_AF, _DROP),
    "rule_same_attribute": f"with {_js('a', _AF, 'doc_id', 'title', 0.6)}, {_ed('e', _AF, 'doc_id', 'title', 4)} select * from a intersect select * from e",
    "join_rows": f"""with {_js('a', _F, 'doc_id', 'plot', 0.7)} select x.doc_id left_doc_id, x.title left_title, x.plot left_plot, x.release_year left_release_year,
 y.doc_id right_doc_id, y.title right_title, y.plot right_plot, y.release_year right_release_year from a join {_F} x on x.doc_id = id1 join {_F} y on y.doc_id = id2""",
    "two_table_join": f"with {_js('a', _F, 'doc_id', 'title', 0.6).replace('a.id < b.id', 'true')}, {_js('b', _F, 'doc_id', 'director', 0.5).replace('a.id < b.id', 'true')} select * from a intersect select * from b",
    "two_table_cross_attr": f"""with l as (select s_suppkey id, lower(trim(s_name)) v, unnest({_t('s_name')}) x, len({_t('s_name')}) n from supplier), r as (select c_custkey id, lower(trim(c_name)) v, unnest({_t('c_name')}) x, len({_t('c_name')}) n from customer)
 select l.id id1, r.id id2 from l join r on l.x = r.x group by l.id, r.id, l.v, r.v, l.n, r.n having count(*) >= 0.3 * (l.n + r.n - count(*)) - 1e-9 and levenshtein(l.v, r.v) <= 8""",
    "two_table_rows": f"""with l as (select p_partkey k, p_name, p_brand, unnest({_t('p_name')}) x, len({_t('p_name')}) n from part), r as (select p_partkey k, p_name, unnest({_t('p_name')}) x, len({_t('p_name')}) n from part)
 select l.k left_p_partkey, l.p_name left_p_name, l.p_brand left_p_brand, r.k right_p_partkey, r.p_name right_p_name from l join r on l.x = r.x group by all, l.n, r.n having count(*) >= 0.6 * (l.n + r.n - count(*)) - 1e-9""".replace("group by all, l.n, r.n", "group by l.k, l.p_name, l.p_brand, r.k, r.p_name, l.n, r.n"),
    "all_conditions_group": _SETS + "select * from a intersect select * from b intersect select * from c",
    "pairs_intersect": _SETS + "select * from a intersect select * from b intersect select * from c",
    "pairs_union": _SETS + "select * from a union select * from b",
    "pairs_except": _SETS + "select * from a except select * from b",
    "clustered": f"with {_js('a', _F, 'doc_id', 'concat_ws(chr(32), title, director)', 0.75)}, {_js('b', _F, 'doc_id', 'plot', 0.6)} select * from a union select * from b",
    "pc_pq": f"""with {_js('a', _F, 'doc_id', 'plot', 0.8)}, {_js('b', _F, 'doc_id', 'plot', 0.6)}, c as (select (select count(*) from a) candidates, (select count(*) from b) truth, (select count(*) from (select * from a intersect select * from b)) found)
 select candidates, truth, found, round(found / truth, 9) pc, round(found / candidates, 9) pq from c""",
    "truth_remap": "with m as (select imdbid, min(doc_id) i from films where imdbid is not null group by 1) select m.i id1, m.i id2 from (select distinct imdbid from documents where imdbid is not null) join m using (imdbid)",
    "lsh_recall": f"with {_js('a', _F, 'doc_id', 'plot', 0.8)} select count(*) truth, true reached from a",
    "ed_count_filter": f"""with g as (select id, substr(v, i, 2) x, i, count(*) over (partition by id) n from {_GRAMS.format(id='doc_id', v='v', t=f"(select doc_id, lower(trim(title)) v from {_F})")}),
 r as (select id, x, n, row_number() over (partition by id, x order by i) k from g where n > 4)
 select a.id id1, b.id id2, cast(count(*) as int) common from r a join r b on a.x = b.x and a.k = b.k and a.id < b.id and abs(a.n - b.n) <= 2 group by a.id, b.id, a.n, b.n having count(*) >= greatest(a.n, b.n) - 4""",
    "ed_and": f"with {_ed('a', 'customer', 'c_custkey', 'c_name', 1)}, {_ed('b', 'customer', 'c_custkey', 'c_mktsegment', 2)} select a.* from a join b using (id1, id2)",
    "pretokenized_join": f"with {_js('a', _F, 'doc_id', 'plot', 0.7)} select * from a",
    "js_classes": f"""with c as (select min(doc_id) f, count(*) n, lower(trim(title)) v from {_F} where title is not null group by 3), {_js('a', "(select f doc_id, v title from c)", 'doc_id', 'title', 0.5)}
 select id1 first1, id2 first2, x.n n1, y.n n2 from a join c x on x.f = id1 join c y on y.f = id2""",
    "rule_counts": f"""select kind, attr, item, count(*) n from (select 'JS' kind, 'title' attr, unnest({_t('title')}) item from {_F} union all select 'JS', 'director', unnest({_t('director')}) from {_F}
 union all select 'ED', 'release_year', substr(v, i, 2) from {_GRAMS.format(id='doc_id', v='v', t=f"(select doc_id, lower(trim(release_year)) v from {_F})")}) group by 1, 2, 3""",
    "csv_profiles": "with p as (select *, row_number() over (order by cast(p_partkey as varchar)) + 4 id from part) "
    + " union all ".join(f"select id, cast(p_partkey as varchar) original_id, '{c}' attr_key, cast({c} as varchar) attr_value from p where {c} is not null" for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "text_lines": "select row_number() over (order by p_partkey) - 1 id, p_name \"text\" from part",
    "numbered_rows": "select c_custkey, c_name, row_number() over (order by c_custkey) + 9 id from customer",
    "written_pairs": "select cast(s_suppkey as bigint) id1, cast(s_nationkey as bigint) id2 from supplier",
}
