"""The comparable fields of profiles whose attributes have names and habits of their own, read batch by batch in Arrow and numpy.

No text is handled by itself except one that was decoded with a wrong encoding; all else are kernels over whole columns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from samewise.functions.sketch import mix

U = np.uint64
#: Bits of the vector of a title's and of the surnames' 2-grams.
TITLE_BITS, AUTHOR_BITS = 512, 256
#: Two-letter codes of venues: 26 times 26.
VENUE_CODES = 676

# What the sources call the same attribute; a whole citation holds all of them.
FIELDS = {
    "title": ["title", "title-bibtex", "name"],
    "authors": ["authors", "author", "by"],
    "venue": ["venue", "booktitle", "journal", "in"],
    "year": ["year", "date"],
    "pages": ["pages"],
    "citation": ["citation"],
}
NAMES = [name for names in FIELDS.values() for name in names]
FIELD_OF = np.array([k for k, names in enumerate(FIELDS.values()) for _ in names], np.int64)
TITLE, AUTHORS, VENUE, YEAR, PAGES, CITATION = range(6)
# Words that stand for a missing value, without their punctuation.
MISSING = ["", "na", "none", "null", "unknown"]

YEAR_PATTERN = r"(?:^|[^0-9])(?P<long>[0-9]{4})(?:[^0-9]|$)|'(?P<short>[0-9]{2})(?:[^0-9]|$)"
# authors. title. venue: the title is the last part of several words that another part follows; parts of up to five
# letters before the last one are abbreviations of the venue
CITATION_PATTERN = r"^(?P<authors>.*)\.\s+(?P<title>[^.]*[^.\s]\s+[^.\s][^.]*)\.\s(?P<venue>(?:[^\s.]{1,5}\.\s+)*(?:[^.]|\.[^\s.])*)\.?\s*$"
PAGES_AT_END = r"[,\s]+[pP][pP]?\.?\s*(?P<first>[0-9]+)\s*-+\s*[0-9]+\s*$"
YEAR_AT_END = r",(?P<tail>[^,]*[0-9][^,]*|\s*)$"

SCHEMA = ", ".join(["ds string", *(f"t{k} long" for k in range(TITLE_BITS // 64)), *(f"a{k} long" for k in range(AUTHOR_BITS // 64)), "words array<int>", "numbers array<int>", "venue array<int>", "year int", "page long", "cut boolean"])
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def _set_right(text: str) -> str:
    """A text that was decoded with the wrong encoding, even twice."""
    for _ in range(3):
        if "Ã" not in text and "Â" not in text:
            break
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            break
    return text


def plain(values: pa.Array) -> pa.Array:
    """Wrong encodings set right, compatibility forms and accents resolved; the case stays."""
    wrong = pc.match_substring_regex(values, "[ÂÃ]")
    if pc.any(wrong).as_py():
        values = pc.replace_with_mask(values, wrong, pa.array([_set_right(v) for v in values.filter(wrong).to_pylist()], pa.string()))
    return pc.replace_substring_regex(pc.utf8_normalize(values, form="NFKD"), r"\p{M}+", "")


def missing(values: pa.Array) -> np.ndarray:
    """Blank, a word for "missing", or no more than one letter or digit."""
    bare = pc.replace_substring_regex(pc.utf8_lower(values), r"[^\pL\pN]+", "")
    return pc.or_(pc.is_in(bare, pa.array(MISSING)), pc.less(pc.utf8_length(bare), 2)).to_numpy(zero_copy_only=False)


def years(values: pa.Array) -> np.ndarray:
    """A year of four digits, or of two after an apostrophe; 0 if there is none."""
    found = pc.extract_regex(values, YEAR_PATTERN)
    read = lambda part: pc.fill_null(pc.cast(pc.if_else(pc.equal(part, ""), None, part), pa.int32()), -1).to_numpy(zero_copy_only=False)
    long, short = (read(pc.struct_field(found, name)) for name in ("long", "short"))
    return np.where(long >= 0, long, np.where(short >= 0, np.where(short > 40, 1900, 2000) + short, 0)).astype(np.int32)


def numbers(values: pa.Array) -> np.ndarray:
    """The first number of at most nine digits; -1 if there is none."""
    found = pc.struct_field(pc.extract_regex(values, r"(?:^|[^0-9])(?P<n>[0-9]{1,9})(?:[^0-9]|$)"), "n")
    return pc.fill_null(pc.cast(found, pa.int64()), -1).to_numpy(zero_copy_only=False)


def citation_parts(texts: pa.Array) -> dict[int, pa.Array]:
    """Title, authors, venue, year and pages of citations ``authors. title. venue, year pp. pages``; what is missing is empty.

    A text of another form is its own title. Three and more dots mark a title that is cut.
    """
    none = lambda c: pc.fill_null(c, "")
    texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, r"\.{3,}\s*", "…. "), r"\.\.", ".")
    pages = none(pc.struct_field(pc.extract_regex(texts, PAGES_AT_END), "first"))
    texts = pc.replace_substring_regex(texts, PAGES_AT_END, "")
    year = none(pc.struct_field(pc.extract_regex(texts, YEAR_AT_END), "tail"))
    body = pc.replace_substring_regex(texts, YEAR_AT_END, "")
    parts = pc.extract_regex(body, CITATION_PATTERN)
    of = lambda name: none(pc.struct_field(parts, name))
    return {TITLE: pc.if_else(pc.is_valid(parts), of("title"), body), AUTHORS: of("authors"), VENUE: of("venue"), YEAR: year, PAGES: pages}


def surnames(names: pa.Array) -> pa.Array:
    """The surnames, separated by blanks, of lists of lower-cased names in either order, with initials or whole given names.

    Names are parted at ``;``, ``&``, ``,`` and "and". Of a part of several words the last one is the surname; a part of one
    word is a surname, and the given name or initial after its comma is left out. "et al." is no name.
    """
    sub = pc.replace_substring_regex
    t = sub(names, r"\bet\s+al\b\.?", "")
    t = sub(t, r"\s+and\s+|[;&,]", ")(")
    t = pc.binary_join_element_wise("(", t, ")", "")
    t = sub(sub(t, r"[\s.]+", " "), "[^a-z0-9() ]", "")
    t = sub(sub(t, r" *([()]) *", r"\1"), r"\(\)", "")
    t = sub(t, r"\(([a-z0-9]+)\)\([a-z0-9]+\)", r"(\1)")
    return pc.utf8_trim_whitespace(sub(sub(t, r"\((?:[a-z0-9]+ )*([a-z0-9]+)\)", r"\1 "), r"[()]", " "))


def _bytes(texts: pa.Array, end: str) -> np.ndarray:
    joined = pc.binary_join_element_wise(" ", texts, end, "")
    joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
    begin, stop = np.frombuffer(joined.buffers()[1], np.int32)[[joined.offset, joined.offset + len(joined)]]
    return np.frombuffer(joined.buffers()[2], np.uint8)[begin:stop]


def gram_bits(texts: pa.Array, bits: int) -> np.ndarray:
    """[texts, bits / 64] words: the bit of each 2-gram of each word of texts of ``a-z``, ``0-9`` and single blanks, word ends being blanks."""
    b = _bytes(texts, " \n")
    row = np.cumsum(b == 10) - (b == 10)
    two = (b[:-1] != 10) & (b[1:] != 10) & ((b[:-1] != 32) | (b[1:] != 32))
    code = b[:-1].astype(np.int64) * 256 + b[1:]
    place = (mix(np.arange(1 << 16, dtype=U) + U(1)) % U(bits)).astype(np.int64)
    grid = np.zeros((len(texts), bits), np.uint8)
    grid[row[:-1][two], place[code[two]]] = 1
    return np.packbits(grid, axis=1, bitorder="little").view(U).reshape(len(texts), bits // 64)


def word_hashes(texts: pa.Array) -> pa.ListArray:
    """The hash (int) of each word of each text, words being parted by blanks."""
    b = _bytes(texts, " \n")
    inside = (b != 32) & (b != 10)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    starts = np.flatnonzero(head)
    row = (np.cumsum(b == 10) - (b == 10))[starts]
    at = np.flatnonzero(inside)
    word = np.cumsum(head)[at] - 1
    value = mix(b[at].astype(U) * U(0x9E3779B97F4A7C15) + (at - starts[word]).astype(U)) if len(at) else np.empty(0, U)
    total = np.add.reduceat(value, np.flatnonzero(head[at])) if len(at) else value
    counts = np.bincount(row, minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array((mix(total) >> U(33)).astype(np.int32)))


@lru_cache(maxsize=1)
def _numerals() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the numerals of 1 to 20, Arabic and Roman, in order, and their values."""
    roman = [t + u for t in ("", "x") for u in ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]]
    hashes = word_hashes(pa.array([*map(str, range(1, 21)), *roman])).flatten().to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.tile(np.arange(1, 21), 2)[order]


def numerals(words: pa.ListArray) -> pa.ListArray:
    """The values of the words that are numerals of 1 to 20, sorted."""
    known, value = _numerals()
    flat = words.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = np.flatnonzero(known[at] == flat)
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))[hit]
    found = value[at[hit]]
    order = np.lexsort((found, row))
    counts = np.bincount(row, minlength=len(words))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(found[order].astype(np.int32)))


def venue_codes(texts: pa.Array) -> pa.ListArray:
    """Codes of the first two letters of each word, and of all neighbouring letters of a word of three to six capitals (an acronym)."""
    b = _bytes(texts, " \n")
    upper, lower = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122)
    letter = upper | lower
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    starts = np.flatnonzero(head)
    word = np.cumsum(head) - 1
    size = np.bincount(word[letter], minlength=len(starts)) if len(starts) else np.empty(0, np.int64)
    capitals = np.bincount(word[upper], minlength=len(starts)) if len(starts) else size
    acronym = (capitals == size) & (size >= 3) & (size <= 6)
    at = np.flatnonzero(letter[:-1] & letter[1:])
    at = at[head[at] | acronym[word[at]]]
    small = (b | 32).astype(np.int64) - 97
    row = (np.cumsum(b == 10) - (b == 10))[at]
    pairs = np.unique(row * VENUE_CODES + small[at] * 26 + small[at + 1])
    counts = np.bincount(pairs // VENUE_CODES, minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array((pairs % VENUE_CODES).astype(np.int32)))


def _first(parents: np.ndarray, rows: int) -> np.ndarray:
    """The place of the first entry of each row, -1 where there is none; parents rise."""
    out = np.full(rows, -1, np.int64)
    who, where = np.unique(parents, return_index=True)
    out[who] = where
    return out


def field_columns(attributes: pa.ListArray) -> list[pa.Array]:
    """The columns of SCHEMA but ``ds``, of a list column of (attr_key, attr_value) structs; null lists, keys and values say nothing."""
    rows = len(attributes)
    parent = pc.list_parent_indices(attributes).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = attributes.flatten()
    key, value = pc.struct_field(flat, 0), pc.struct_field(flat, 1)
    code = pc.fill_null(pc.index_in(pc.utf8_lower(pc.utf8_trim_whitespace(key)), pa.array(NAMES)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    field = np.where(code >= 0, FIELD_OF[code], -1)
    value = plain(pc.fill_null(value, ""))
    field[missing(value)] = -1

    def entries(k: int) -> tuple[np.ndarray, pa.Array]:
        at = np.flatnonzero(field == k)
        return parent[at], value.take(pa.array(at))

    who, citations = entries(CITATION)
    cited = citation_parts(citations)
    extra = {}
    for k, texts in cited.items():
        use = ~missing(texts) if k != PAGES else pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        extra[k] = (who[use], texts.filter(pa.array(use)))

    def merged(k: int) -> tuple[np.ndarray, pa.Array]:
        """Entries under the field's own names, and those of a citation where there are none."""
        a, texts = entries(k)
        b, more = extra[k]
        new = ~np.isin(b, a)
        both, every = np.concatenate([a, b[new]]), pa.concat_arrays([texts, more.filter(pa.array(new))])
        order = np.argsort(both, kind="stable")
        return both[order], every.take(pa.array(order))

    def first_text(k: int) -> pa.Array:
        a, texts = merged(k)
        at = _first(a, rows)
        return pc.fill_null(texts.take(pa.array(at, mask=at < 0)), "") if len(texts) else pa.array([""] * rows, pa.string())

    title = pc.utf8_lower(first_text(TITLE))
    cut = pc.match_substring_regex(title, "(?:\\.\\.|…)[\\s.]*$")
    title = pc.utf8_trim_whitespace(pc.replace_substring_regex(title, "[^a-z0-9]+", " "))
    a, names = merged(AUTHORS)
    bounds = np.searchsorted(a, np.arange(rows + 1))
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.utf8_lower(names))
    people = surnames(pc.binary_join(lists, ";"))
    a, texts = merged(YEAR)
    read = years(texts)
    at = _first(a[read > 0], rows)
    year = np.where(at >= 0, read[read > 0][at] if (read > 0).any() else 0, 0).astype(np.int32)
    a, texts = merged(PAGES)
    read = numbers(texts)
    at = _first(a[read >= 0], rows)
    page = np.where(at >= 0, read[read >= 0][at] if (read >= 0).any() else -1, -1)
    words = [pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for w in (gram_bits(title, TITLE_BITS), gram_bits(people, AUTHOR_BITS)) for k in range(w.shape[1])]
    hashes = word_hashes(title)
    return [*words, hashes, numerals(hashes), venue_codes(first_text(VENUE)), pa.array(year), pa.array(page), cut]
