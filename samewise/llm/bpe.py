"""Byte-level BPE over Arrow batches: numpy pre-tokenisation, dictionary-encoded slices, cached and batched pair merging.

No regular expression runs over the text. Every character gets a class by table look-up, and whether a token begins at
a character follows from the transition function of its class. For all classes of this vocabulary's pattern that
function is constant but for what the neighbouring character decides, so the associative scan over transition functions
("the last constant function wins") has depth one: it is a comparison of the class array with itself shifted by one.
Only an apostrophe that begins a token opens a state of its own (the contractions), settled by one look ahead.

The slices between boundaries are dictionary-encoded by Arrow, so that each distinct slice of a batch is looked up
once; slices never seen by this worker are merged together, all in the same numpy rounds.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, WHITE, SPACE, NONE = 0, 1, 2, 3, 4, 5

#: Characters handled at once, to bound a worker's memory; a longer text is cut where a token boundary is certain.
CHUNK_CHARS = 1 << 20
#: Distinct slices kept by a worker; when there are more, the cache starts anew.
CACHE_SLICES = 1 << 18
#: Slices of more bytes than this are merged with a heap instead of in batched rounds.
LONG_SLICE = 48


# Letters and numbers that Unicode 16 added, which the tokenizer's pattern knows and Python's tables may not.
UNICODE_16 = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER), (0x10D40, 0x10D49, NUMBER),
    (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER), (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER),
    (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER), (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER),
    (0x116D0, 0x116E3, NUMBER), (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER), (0x1CCF0, 0x1CCF9, NUMBER),
    (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point, from Unicode's general categories and white-space property."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.zeros(0x110000, np.uint8)
    table[:0x40000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]  # there are none beyond
    for a, b, kind in UNICODE_16:
        table[a : b + 1] = kind
    table[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = WHITE
    table[0x20] = SPACE
    return table


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. cp: code points of all texts, one after another; first: offsets at which a text begins."""
    n = len(cp)
    cls = class_table()[cp]
    before = np.empty(n, np.uint8)
    before[1:] = cls[:-1]
    before[first] = NONE
    white = cls >= WHITE
    after_white = (before == WHITE) | (before == SPACE)
    # a visible character begins a token after another class or after white space other than " ", which belongs to it
    start = ~white & (cls != before) & (before != SPACE)
    # white space begins a token where a run begins, and at the last character of a run with something visible behind it
    visible_next = np.zeros(n, bool)
    visible_next[:-1] = ~white[1:] & (before[1:] != NONE)
    start |= white & (~after_white | visible_next)
    apostrophes = np.flatnonzero((cp == 39) & start)
    if len(apostrophes):
        ends = np.empty(len(first), np.int64)
        ends[:-1], ends[-1] = first[1:], n
        end = ends[np.searchsorted(first, apostrophes, side="right") - 1]
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one = np.where(apostrophes + 1 < end, padded[apostrophes + 1], 0)
        two = np.where(apostrophes + 2 < end, padded[apostrophes + 2], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for mask, size in ((short, 2), (long & ~short, 3)):
            at = apostrophes[mask]
            for k in range(1, size):
                start[at + k] = False
            rest = at + size
            start[rest[rest < end[mask]]] = True
    start[first] = True
    return start


class Vocabulary:
    """Merges and ids of a byte-level BPE in the JSON format of public tokenizers."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        rows = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            rows.append((vocab[a] << 20 | vocab[b], rank, vocab[a + b]))
        rows.sort()
        table = np.array(rows, np.int64)
        self.keys, self.ranks, self.merged = (np.ascontiguousarray(table[:, k]) for k in range(3))
        self.pair = {int(k): (int(r), int(m)) for k, r, m in table}
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if all(c in byte_of for c in s)}
        self.index: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.index.clear()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.offsets = [0]

    @cached_property
    def pieces(self) -> pa.Array:
        """The bytes of each id."""
        return pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.binary())

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes_of[int(i)] for i in ids)

    def _rank(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], 1 << 40), self.merged[at]

    def merge_batch(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each slice, flat, and their numbers. In each round every slice has its best pair merged, wherever it occurs."""
        sizes = np.fromiter(map(len, slices), np.int64, len(slices))
        ids = self.byte_id[np.frombuffer(b"".join(slices), np.uint8)]
        own = np.repeat(np.arange(len(slices)), sizes)
        active = np.ones(len(ids), bool)
        done_ids, done_own = [], []
        while len(ids):
            same = np.zeros(len(ids), bool)
            same[:-1] = own[1:] == own[:-1]
            following = np.empty_like(ids)
            following[:-1], following[-1] = ids[1:], 0
            rank, merged = self._rank((ids << 20) | following)
            rank[~same] = 1 << 40
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            spread = np.repeat(best, np.diff(np.append(heads, len(ids))))
            active = spread < 1 << 40
            if not active.all():
                done_ids.append(ids[~active])
                done_own.append(own[~active])
                ids, own, rank, merged, spread = ids[active], own[active], rank[active], merged[active], spread[active]
                if not len(ids):
                    break
            take = rank == spread
            # of overlapping pairs (a run of the same id) every second one is merged, from the left
            at = np.flatnonzero(take)
            fresh = np.concatenate([[True], np.diff(at) > 1])
            begin = np.maximum.accumulate(np.where(fresh, at, -1))
            at = at[((at - begin) & 1) == 0]
            ids[at] = merged[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, own = ids[keep], own[keep]
        ids, own = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_ids, done_own))
        order = np.argsort(own, kind="stable")
        return ids[order].astype(np.int32), np.bincount(own, minlength=len(slices))

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one long slice, by a heap of pairs over a linked list: n log n in its length."""
        ids = [int(self.byte_id[b]) for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (hit := self.pair.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def _add(self, slices: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        base = len(self.offsets) - 1
        self.offsets.extend((np.cumsum(sizes) + self.used).tolist())
        self.used += len(ids)
        self.index.update(zip(slices, range(base, base + len(slices)), strict=True))

    def lookup(self, slices: list[bytes]) -> np.ndarray:
        """The cache index of each of the distinct slices, merging those that are new."""
        new = [s for s in slices if s not in self.index]
        if len(self.index) + len(new) > CACHE_SLICES and self.index:
            self.reset()
            new = slices
        short = [s for s in new if len(s) <= LONG_SLICE]
        if short:
            self._add(short, *self.merge_batch(short))
        for s in new:
            if len(s) > LONG_SLICE:
                ids = np.array(self.merge_long(s), np.int32)
                self._add([s], ids, np.array([len(ids)]))
        return np.fromiter(map(self.index.__getitem__, slices), np.int64, len(slices))

    def encode(self, texts: list[str], offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Flat ids of all texts, the number of ids of each, and, if asked for, the byte offset in its text at which each id begins."""
        none = np.empty(0, np.int32)
        if not any(texts):
            return none, np.zeros(len(texts), np.int64), none if offsets else None
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        cp = np.frombuffer(raw, np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        first = begins[lengths > 0]
        starts = np.flatnonzero(token_starts(cp, first))
        data = "".join(texts).encode("utf-8", "surrogatepass")
        if len(data) == len(cp):
            at = starts
        else:
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            place = np.cumsum(width, dtype=np.int64) - width
            at = place[starts]
        bounds = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        cached = self.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        table = np.array(self.offsets, np.int64)
        size = table[cached + 1] - table[cached]
        total = np.cumsum(size)
        out = self.flat[np.repeat(table[cached] - (total - size), size) + np.arange(total[-1])]
        owner = np.searchsorted(first, starts, side="right") - 1
        counts = np.zeros(len(texts), np.int64)
        counts[lengths > 0] = np.bincount(owner, weights=size, minlength=len(first)).astype(np.int64)
        if not offsets:
            return out, counts, None
        widths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            widths[i] = len(b)
        w = widths[out]
        within = np.cumsum(w) - w
        heads = np.cumsum(counts) - counts
        base = np.zeros(len(texts), np.int64)
        base[counts > 0] = within[heads[counts > 0]]
        return out, counts, (within - np.repeat(base, counts)).astype(np.int32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary, with its cache, for each worker process."""
    return Vocabulary(path)


def certain_cuts(text: str, most: int) -> list[str]:
    """A text in parts of about ``most`` characters, cut only before a single blank between visible characters."""
    parts, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = -1
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at
    parts.append(text[begin:])
    return parts


def encode_column(column: pa.Array, path: str, offsets: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Encodes a string column in chunks: (first row, end row, flat ids, ids of each row, offsets). Null counts as empty."""
    vocab = vocabulary(path)
    row, n = 0, len(column)
    while row < n:
        texts, owner, chars, begin = [], [], 0, row
        while row < n and (chars < CHUNK_CHARS or row == begin):
            text = column[row].as_py() or ""
            parts = certain_cuts(text, CHUNK_CHARS) if len(text) > 2 * CHUNK_CHARS else [text]
            texts += parts
            owner += [row - begin] * len(parts)
            chars += len(text)
            row += 1
        if len(texts) == row - begin:
            yield begin, row, *vocab.encode(texts, offsets)
            continue
        done, at = [], np.zeros(row - begin, np.int64)
        counts = np.zeros(row - begin, np.int64)
        for text, o in zip(texts, owner, strict=True):  # a very long text: one part at a time
            ids, c, where = vocab.encode([text], offsets)
            done.append((ids, None if where is None else where + at[o]))
            counts[o] += c[0]
            at[o] += len(text.encode("utf-8", "surrogatepass"))
        yield begin, row, np.concatenate([d[0] for d in done]), counts, np.concatenate([d[1] for d in done]).astype(np.int32) if offsets else None
