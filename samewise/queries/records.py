"""Queries of the record operators: wide tables and posting stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators.posting_runs import key_counts, posting_runs
from samewise.operators.wide import Attribute, nested_to_rows, read_date, read_number, unreadable_cells, wide_table
from samewise.queries.tables import table

YEAR, VOLUME, MDATE = Attribute("year", read_number(1900, 2030)), Attribute("volume", read_number(1, 999)), Attribute("mdate", read_date)
TYPED = [YEAR, VOLUME, MDATE]
PUBLICATION = [Attribute("title"), Attribute("author", "list"), Attribute("booktitle"), Attribute("journal"), Attribute("publisher"), Attribute("pages"), YEAR, VOLUME, MDATE, Attribute("cite", "list"), Attribute("editor", "list")]
RARE = [Attribute(c) for c in ("number", "cite-label", "publtype", "url", "note", "sub", "crossref", "note-type", "sup", "ee", "cdrom", "month")]
NESTED_LISTS = [Attribute(c, "list") for c in ("author", "authors", "by")]  # dblp, acm, citations
NESTED_TEXTS = [Attribute(c) for c in ("venue", "booktitle", "journal", "publtype", "title-bibtex", "name", "in", "date", "citation")]
VERSIONS = ("updated_at", "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unreadable_cells(table(spark, d, "key_values"), "profile_id", "attr_key", "attr_value", TYPED, VERSIONS)


def _columns(attributes: list[Attribute]) -> list[Column]:
    return [F.col(f"`{a.name}`").alias(a.name.replace("-", "_")) for a in attributes]


def _joined(others: str) -> Column:
    """A map of further attributes as text, so that it can be compared: ``name=value;value|name=value``."""
    return F.array_join(F.transform(F.map_entries(others), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))), "|").alias(others)


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = wide_table(table(spark, d, "key_values"), "profile_id", "attr_key", "attr_value", PUBLICATION + RARE, VERSIONS, "others")
    lists = [F.array_join(c, "|").alias(f"{c}s") for c in ("author", "cite", "editor")]
    return wide.select("profile_id", "title", "booktitle", "journal", "publisher", "pages", "year", "volume", "mdate", *lists, *_columns(RARE), _joined("others"))


def p4_nested(spark: SparkSession, d: str) -> DataFrame:
    """n_authors counts the values of ``author``, which dblp has; acm and citations name theirs in one value, ``authors`` and ``by``."""
    rows = nested_to_rows(table(spark, d, "profiles").dropDuplicates(["id"]), "id", "attributes")
    wide = wide_table(rows, "id", "attr_key", "attr_value", [YEAR, Attribute("title"), Attribute("pages"), *NESTED_LISTS, *NESTED_TEXTS], others="others")
    return wide.select("id", "year", "title", F.size("author").alias("n_authors"), "pages", *(F.array_join(a.name, "|").alias(a.name) for a in NESTED_LISTS), *_columns(NESTED_TEXTS), _joined("others"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qgram_index").where("qgram_pos >= 0")
    return posting_runs(rows, "gram", "doc_id", 12).select("gram", F.col("first_doc").alias("doc_id"))


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return posting_runs(table(spark, d, "qgram_index").where("qgram_pos >= 0"), "gram", "doc_id")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return key_counts(table(spark, d, "qgram_index").where("qgram_pos >= 0"), "gram", "doc_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_wide, p4_nested, p7_found, p7_runs, p7_counts)}

_DIGITS = "translate(attr_value, '０１２３４５６７８９', '0123456789')"
_NUMBERS = f"regexp_extract_all({_DIGITS}, '[0-9]+')"
_READ = f"""
 select profile_id, lower(trim(attr_key)) k, attr_value v, updated_at u, loaded_at l,
  case when lower(trim(attr_key)) = 'year' and len({_NUMBERS}) = 1 and try_cast({_NUMBERS}[1] as bigint) between 1900 and 2030 then cast(try_cast({_NUMBERS}[1] as bigint) as int)
       when lower(trim(attr_key)) = 'volume' and len({_NUMBERS}) = 1 and try_cast({_NUMBERS}[1] as bigint) between 1 and 999 then cast(try_cast({_NUMBERS}[1] as bigint) as int) end n,
  case when lower(trim(attr_key)) = 'mdate' then cast(try_strptime(trim({_DIGITS}),
    ['%Y-%m-%d', '%Y/%m/%d', '%d.%m.%Y', '%d/%m/%Y', '%Y%m%d', '%Y-%m-%dT%H:%M:%SZ', '%d %b %Y', '%b %d, %Y']) as date) end m
 from key_values where profile_id is not null and trim(attr_value) <> ''"""
_NEWEST = "max_by({0}, struct_pack(u, l, v)) filter ({1})"
_TEXTS = ", ".join(f"{_NEWEST.format('v', f'k = {c!r}')} {c}" for c in ("title", "booktitle", "journal", "publisher", "pages"))
_RARE = [(a.name, '"' + a.name.replace("-", "_") + '"') for a in RARE]
_RARE_TEXTS = ", ".join(f"{_NEWEST.format('v', f'k = {c!r}')} {name}" for c, name in _RARE)
_KNOWN = ", ".join(repr(a.name) for a in PUBLICATION + RARE)
_NESTED_LISTS = ", ".join(f"coalesce(string_agg(v, '|' order by v) filter (k = '{a.name}'), '') \"{a.name}\"" for a in NESTED_LISTS)
_NESTED_TEXTS = ", ".join(f"max(v) filter (k = '{a.name}') \"{a.name.replace('-', '_')}\"" for a in NESTED_TEXTS)
_NESTED_KNOWN = ", ".join(repr(c) for c in ["year", "title", "pages", *(a.name for a in NESTED_LISTS + NESTED_TEXTS)])
_LISTS = ", ".join(f"coalesce(string_agg(v, '|' order by u, l, v) filter (k = '{c}'), '') {c}s" for c in ("author", "cite", "editor"))
_SETS = "select gram, doc_id from qgram_index where gram is not null and doc_id is not null and qgram_pos >= 0"
_RUNS = f"""select gram, min(doc_id) first_doc, max(doc_id) last_doc, count(*) n_docs from (
 select gram, doc_id, doc_id - row_number() over (partition by gram order by doc_id) g from (select distinct * from ({_SETS}))) group by gram, g"""

ORACLE = {
    "p4_found": f"""select profile_id, k attr_key from ({_READ}) where k in ('year', 'volume', 'mdate')
 group by all having count(n) = 0 and count(m) = 0""",
    "p4_wide": f"""with r as (select profile_id, k, v, max(u) u, max(l) l, any_value(n) n, any_value(m) m from ({_READ}) group by all),
 w as (select profile_id, {_TEXTS}, {_NEWEST.format('n', "k = 'year' and n is not null")} "year", {_NEWEST.format('n', "k = 'volume' and n is not null")} volume,
 {_NEWEST.format('m', 'm is not null')} mdate, {_LISTS}, {_RARE_TEXTS} from r group by 1),
 o as (select profile_id, string_agg(k || '=' || vs, '|' order by k) others from (select profile_id, k, string_agg(v, ';' order by u, l, v) vs from r where k is not null and k not in ({_KNOWN}) group by 1, 2) group by 1)
 select e.profile_id, title, booktitle, journal, publisher, pages, "year", volume, mdate, coalesce(authors, '') authors, coalesce(cites, '') cites, coalesce(editors, '') editors, {", ".join(name for _, name in _RARE)}, coalesce(others, '') others
 from (select distinct profile_id from key_values where profile_id is not null) e left join w using (profile_id) left join o using (profile_id)""",
    "p4_nested": f"""with r as (select distinct id, lower(trim(a.attr_key)) k, a.attr_value v from (select id, unnest(attributes) a from (select id, any_value(attributes) attributes from profiles group by id))),
 x as (select id, k, case when trim(v) <> '' then v end v, regexp_extract_all(v, '[0-9]+') d from r),
 o as (select id, string_agg(k || '=' || vs, '|' order by k) others from (select id, k, string_agg(v, ';' order by v) vs from x where v is not null and k not in ({_NESTED_KNOWN}) group by 1, 2) group by 1)
 select y.*, coalesce(others, '') others from (select id, max_by(cast(try_cast(d[1] as bigint) as int), v) filter (k = 'year' and len(d) = 1 and try_cast(d[1] as bigint) between 1900 and 2030) "year",
 max(v) filter (k = 'title') title, cast(count(v) filter (k = 'author') as int) n_authors, max(v) filter (k = 'pages') pages, {_NESTED_LISTS}, {_NESTED_TEXTS} from x group by id) y left join o using (id)""",
    "p7_found": f"select gram, first_doc doc_id from ({_RUNS}) where n_docs >= 12",
    "p7_runs": _RUNS,
    "p7_counts": f"select gram, count(*) n_rows, count(distinct doc_id) n_docs from ({_SETS}) group by gram",
}
