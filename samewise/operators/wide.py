"""Entity, attribute, value rows to one typed row an entity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.text import ascii_digits, is_blank, strip

# The English month names.
MONTHS = "january february march april may june july august september october november december".split()


def read_number(low: int, high: int) -> Callable[[Column], Column]:
    """Reads a text that holds exactly one run of digits (of any script) with a value from low to high, whatever surrounds it."""

    def read(v: Column) -> Column:
        runs = F.regexp_extract_all(ascii_digits(v), F.lit("[0-9]+"), F.lit(0))
        bare = F.regexp_replace(F.get(runs, F.lit(0)), "^0+(?=[0-9])", "")
        number = F.when((F.size(runs) == 1) & (F.length(bare) <= 18), bare).try_cast("long")
        return F.when(number.between(low, high), number).cast("int")

    return read


def read_date(v: Column) -> Column:
    """Reads a full, existing calendar day; null for anything else.

    Numbers only: the year stands first or last, and the day precedes the month if it is last; separated by one of - / .;
    a time may follow. English month names, whole or by their first letters, may stand
    before or after the day, or between the year and the day. Eight digits in a row are year, month, day.
    """
    text = F.lower(strip(ascii_digits(v)))
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    def numeric(pattern: str, y: int, m: int, d: int) -> Column:
        return F.when(text.rlike(pattern), iso(*(F.regexp_extract(text, pattern, k) for k in (y, m, d))))

    after = r"(?:[t\s]\s*[0-9]{1,2}:.*)?$"
    parts = [
        numeric(r"^([0-9]{4})\s*([-/.])\s*([0-9]{1,2})\s*\2\s*([0-9]{1,2})\.?" + after, 1, 3, 4),
        numeric(r"^([0-9]{1,2})\s*([-/.])\s*([0-9]{1,2})\s*\2\s*([0-9]{4})" + after, 4, 3, 1),
        numeric("^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3),
    ]
    name = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r"|sept)\.?"
    numbers = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS) for x in (m[:3], str(k + 1))))
    day = "([0-9]{1,2})(?:st|nd|rd|th)?\\.?"
    for pattern, (y, m, d) in (
        (rf"^{day}[\s-]*(?:of\s+)?{name}[\s,-]*([0-9]{{4}}){after}", (3, 2, 1)),
        (rf"^{name}[\s-]*{day}[\s,-]+([0-9]{{4}}){after}", (3, 1, 2)),
        (rf"^([0-9]{{4}})[\s,-]*{name}[\s-]*{day}{after}", (1, 2, 3)),
    ):
        month = F.element_at(numbers, F.substring(F.regexp_extract(text, pattern, m), 1, 3))
        parts.append(F.when(text.rlike(pattern), iso(F.regexp_extract(text, pattern, y), month, F.regexp_extract(text, pattern, d))))
    return F.coalesce(*parts)


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table. kind: "list" (all distinct values), "text" (the latest), or a reader of the latest readable value."""

    name: str
    kind: str | Callable[[Column], Column] = "text"


def attribute_grid(rows: DataFrame, entity: str, attr: str, value: str, attributes: list[Attribute], versions: tuple[str, ...] = (), others: bool = False) -> DataFrame:
    """(entity, cells): for each entity an array with one cell an attribute, in the order of ``attributes``.

    A cell is the array of the distinct non-blank values, oldest first by the columns ``versions`` and then by value;
    it is null where there is none. Attribute names are compared stripped and lower-cased. Every non-null entity of
    ``rows`` has a row, even one without any known attribute.

    One shuffle, on the entity: values are reduced to distinct ones, the grid of entities and attributes is completed and
    left-joined to them (on the entity, with the position as a further condition, so that the partitioning serves the
    join) and collected where they are. A cell is as long as the distinct values of its entity under its attribute.

    With ``others``, a third column ``others`` maps every further non-null attribute name of the entity to such an array.
    """
    place = {a.name.strip().lower(): k for k, a in enumerate(attributes)}
    position = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
    stamps = [F.col(v).alias(f"v{k}") for k, v in enumerate(versions)]
    name = F.lower(strip(F.col(attr)))
    pos = F.element_at(position, name)
    named = ["name"] if others else []  # further attributes share the last position
    if others:
        pos = F.when(name.isNotNull(), F.coalesce(pos, F.lit(len(attributes))))
        stamps.append(name.alias("name"))
    flat = rows.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), pos.alias("pos"), F.when(~is_blank(F.col(value)), F.col(value)).alias("value"), *stamps)
    flat = flat.repartition("entity")
    latest = [F.max(f"v{k}").alias(f"v{k}") for k in range(len(versions))]
    kept = flat.where("pos is not null and value is not null").groupBy("entity", "pos", *named, "value").agg(*latest, F.lit(1).alias("one"))
    order = [*(f"v{k}" for k in range(len(versions))), "value", *named]
    found = [F.col("found")[c].alias(c) for c in ("value", *named)]
    values = kept.groupBy("entity", "pos").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("found")).select(F.col("entity").alias("e"), F.col("pos").alias("at"), *found)
    grid = flat.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, range(len(attributes) + others)))).alias("pos"))
    cells = grid.join(values, (F.col("entity") == F.col("e")) & (F.col("pos") - F.col("at") == 0), "left")
    ordered = cells.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", "value", *named))).alias("found"))
    cells = F.transform("found", lambda c: c["value"])
    if not others:
        return ordered.select("entity", cells.alias("cells"))
    last = F.get("found", F.lit(len(attributes)))
    pairs = F.arrays_zip(last["name"].alias("k"), last["value"].alias("v"))
    of = lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
    rest = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(last["name"])), lambda k: F.struct(k.alias("key"), of(k).alias("value"))))
    return ordered.select("entity", cells.alias("cells"), F.coalesce(rest, F.create_map().cast("map<string,array<string>>")).alias("others"))


def cell_value(cell: Column, kind: str | Callable[[Column], Column]) -> Column:
    """The typed value of a cell; a reader gives the latest value that it can read."""
    if kind == "list":
        return F.coalesce(cell, F.array().cast("array<string>"))
    if kind == "text":
        return F.get(F.reverse(cell), F.lit(0))
    return F.get(F.filter(F.transform(F.reverse(cell), kind), lambda x: x.isNotNull()), F.lit(0))


def wide_table(rows: DataFrame, entity: str, attr: str, value: str, attributes: list[Attribute], versions: tuple[str, ...] = (), others: str | None = None) -> DataFrame:
    """One row an entity with a typed column for each attribute; see attribute_grid and Attribute.

    A scalar cell without a readable value is null, a list cell without values empty. An empty table gives an empty result.
    ``others`` names a last column: a map of all attribute names without a column to their distinct values.
    """
    grid = attribute_grid(rows, entity, attr, value, attributes, versions, others is not None)
    rest = [] if others is None else [F.col("others").alias(others)]
    return grid.select(F.col("entity").alias(entity), *(cell_value(F.get("cells", F.lit(k)), a.kind).alias(a.name) for k, a in enumerate(attributes)), *rest)


def unreadable_cells(rows: DataFrame, entity: str, attr: str, value: str, attributes: list[Attribute], versions: tuple[str, ...] = ()) -> DataFrame:
    """(entity, attr) of the cells of the wide table that stay empty although there is a non-blank value."""
    grid = attribute_grid(rows, entity, attr, value, attributes, versions)
    bad = F.array(*(F.when(F.get("cells", F.lit(k)).isNotNull() & cell_value(F.get("cells", F.lit(k)), a.kind).isNull(), F.lit(a.name)) for k, a in enumerate(attributes)))
    return grid.select(F.col("entity").alias(entity), F.explode(F.array_compact(bad)).alias(attr))


def nested_to_rows(profiles: DataFrame, entity: str, attributes: str) -> DataFrame:
    """(entity, attr_key, attr_value) rows of a column array<struct<attr_key, attr_value>>; null and empty arrays give none."""
    return profiles.select(entity, F.explode(attributes).alias("a")).select(entity, "a.attr_key", "a.attr_value")
