"""Text as Column expressions: normal forms, tokens, words and q-grams. All of them stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Trimmed, lower-cased, trimmed again; an array of values is joined by blanks after each is trimmed."""
    return F.trim(F.lower(F.trim(c)))


def strip(c: Column) -> Column:
    """Without white space of any kind (not only blanks) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | (strip(c) == "")


def tokens(c: Column) -> Column:
    r"""The set of tokens of a text: split at every character outside ASCII ``[A-Za-z0-9]``, the underscore too, lower-cased.

    Null gives null, a text without a token an empty array.
    """
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[\W_]"), lambda x: F.length(x) > 0))


def words(c: Column) -> Column:
    """The maximal runs of a-z and 0-9 of the lower-cased text, in order, repeats kept; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_set(c: Column) -> Column:
    """The distinct words of a text, sorted."""
    return F.array_sort(F.array_distinct(words(c)))


def qgrams(c: Column, q: int) -> Column:
    """Overlapping q-grams with their 0-based positions, array<struct<gram, pos>>, without padding.

    A text shorter than q is its own only gram; an empty text has none; repeated grams are kept; null gives null.
    """
    if q < 1:
        raise ValueError("q must be at least 1")
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - F.lit(q - 1), F.lit(1))), lambda i: F.struct(F.substr(c, i, F.lit(q)).alias("gram"), (i - F.lit(1)).cast("int").alias("pos")))
    return F.when(c.isNull(), F.lit(None)).when(F.length(c) == 0, F.slice(at, 1, 0)).otherwise(at)


def numbered_repeats(items: Column) -> Column:
    """A list of texts as a set: each with the number of its repeat, so that intersections count repeats."""
    return F.transform(items, lambda x, i: F.concat_ws("\u0001", x, F.size(F.filter(F.slice(items, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    every = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(every), "".join(str(unicodedata.digit(c)) for c in every)


def ascii_digits(c: Column) -> Column:
    """With the digits of every script as 0-9."""
    source, target = _digits()
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, source, target)).otherwise(c)
