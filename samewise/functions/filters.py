"""The bounds by which pairs are told to be dissimilar before they are compared. Necessary conditions, all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def js_prefix_length(n: Column, t: float) -> Column:
    """How many of a set's n tokens, in any fixed order, must include one that is shared."""
    return (n - F.ceil(n * F.lit(t) - F.lit(EPS)) + 1).cast("int")


def js_length(n1: Column, n2: Column, t: float) -> Column:
    """The smaller set has at least the share t of the larger one's size."""
    return F.least(n1, n2) >= F.greatest(n1, n2) * F.lit(t) - F.lit(EPS)


def js_overlap(n1: Column, n2: Column, t: float) -> Column:
    """The number of common tokens that a Jaccard similarity of t takes."""
    return F.ceil(F.lit(t / (1 + t)) * (n1 + n2) - F.lit(EPS))


def js_position(common: Column, p1: Column, p2: Column, n1: Column, n2: Column, t: float) -> Column:
    """What is common up to the positions p1, p2 (from 1) of the last common prefix token, and all behind it, may suffice."""
    return common + F.least(n1 - p1, n2 - p2) >= js_overlap(n1, n2, t)


def set_image(items: Column, half: int) -> Column:
    """One of the two words (half 0 or 1) of a 128-bit exclusive-or image of a set of texts."""
    spot = F.transform(items, lambda x: F.pmod(F.xxhash64(x), F.lit(128)).cast("int"))
    # the functions take one argument each: a second one would be the index of the element
    own = F.transform(F.filter(spot, lambda b: F.floor(b / 64) == half), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b % 64))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def js_image(distance: Column, n1: Column, n2: Column, t: float) -> Column:
    """The images of two sets differ in no more bits than the sets in members, of which there are few at a similarity of t."""
    return distance <= n1 + n2 - 2 * js_overlap(n1, n2, t)


def js_reached(common: Column, n1: Column, n2: Column, t: float) -> Column:
    """The Jaccard similarity is at least t; sets without tokens are similar to nothing."""
    return (common > 0) & (common >= F.lit(t) * (n1 + n2 - common) - F.lit(EPS))


def ed_prefix_length(k: int, q: int) -> int:
    """How many of a text's q-grams, in any fixed order, must include one that is shared if there are so many."""
    return q * k + 1


def ed_common(common: Column, n1: Column, n2: Column, k: int, q: int) -> Column:
    """k edits change at most q k of a text's q-grams, so that all others are common."""
    return common >= F.greatest(n1, n2) - q * k


def ed_reached(a: Column, b: Column, k: int) -> Column:
    """The edit distance in characters is at most k; given up as soon as it is above."""
    return F.levenshtein(a, b, k) >= 0
