"""Reading level of subtitle texts: smoothed unigram language models per level, over what is spoken."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.bpe import LETTER, NUMBER, OTHER, class_table
from samewise.functions.sketch import mix
from samewise.session import map_arrow

U = np.uint64
#: Buckets that words are hashed into. It bounds the model: 4 bytes for each bucket and class.
BUCKETS = 1 << 18
#: Characters handled at once.
CHUNK_CHARS = 1 << 20
#: Class 0 is any text that isn't English; 1 to 4 are the reading levels.
CLASSES = 5

# Phrases by which cues that advertise or credit are known, besides links and framed lines.
ADVERTS = [
    "ripped by", "synced by", "subtitles by", "subtitled by", "captions paid", "captioned by", "subtitles downloaded", "downloaded from", "rate this subtitle",
    "advertise your product", "become a vip", "bet now", "with code", "visit our", "support us",
]
ADVERT = re.compile(r"https?:|www\.|\.(?:com|net|org|example)\b|\. example\b|-= | =-|" + "|".join(ADVERTS))

# Characters of no width, as byte order marks.
INVISIBLE = [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF]
BRACKETS = [("<", ">"), ("{", "}"), ("[", "]"), ("(", ")")]


def spoken_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, sentence, text) of every spoken word of the texts; sentences are numbered through all texts.

    Words are runs of letters, a character of a script without blanks being a word of its own; so cue numbers hold none, nor
    do times of any notation (lines with an arrow are left out). A cue is a series of lines that show something besides numbers and times, even
    if it is only notes. Left out are what stands in angle, curly, square or round
    brackets (to the end of the cue if they aren't closed), cues with a note or beginning with # or * (songs, sounds), cues
    that advertise, and a word right before a colon (a speaker's name).
    """
    lowered = [t.lower() for t in texts]
    text = "\n\n".join(lowered) + "\n\n"
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(texts)) + 2
    first = np.cumsum(lengths) - lengths
    n = len(cp)
    kind = class_table()[np.minimum(cp, 0x10FFFF)]
    letter = kind == LETTER
    newline = (cp == 10) | (cp == 13)
    newline[:-1] &= (cp[:-1] != 13) | (cp[1:] != 10)  # CR LF ends one line
    line = np.cumsum(newline) - newline
    # a line of the cue itself has letters or signs; one with an arrow holds times and positions, one of digits and their punctuation a number
    mark = (kind == OTHER) & (cp > 32) & ~np.isin(cp, INVISIBLE)
    has_mark, has_digit, has_text, timed = np.zeros((4, line[-1] + 1), bool)
    has_mark[line[mark]] = True
    has_digit[line[kind == NUMBER]] = True
    has_text[line[letter | mark & ~np.isin(cp, [ord(c) for c in ".,:;-"])]] = True
    has_text |= has_mark & ~has_digit
    timed[line[:-1][(cp[:-1] == 45) & (cp[1:] == 62)]] = True
    has_text &= ~timed
    # cue number of each line: a new one begins after a line without text
    begins = has_text.copy()
    begins[1:] &= ~has_text[:-1]
    cue = np.cumsum(begins)[line]
    bad = np.zeros(cue[-1] + 1, bool)
    place = np.arange(n)
    inside = np.zeros(n, bool)
    for opener, closer in BRACKETS:
        if opener in text:
            opened = np.maximum.accumulate(np.where(cp == ord(opener), place, -1))
            closed = np.maximum.accumulate(np.where(cp == ord(closer), place, -1))
            inside |= (opened > closed) & (cue[opened] == cue)
    keep = letter & ~inside & ~timed[line]
    # the first visible character of each cue, dashes and brackets aside
    visible = np.flatnonzero(has_text[line] & ~inside & (cp > 32) & ~np.isin(cp, [ord(c) for c in "->}])"]))
    cue_first = np.full(len(bad), n, np.int64)
    np.minimum.at(cue_first, cue[visible], visible)
    notes = np.flatnonzero(((cp == 0x266A) | (cp == 0x266B)) & has_text[line])
    bad[cue[notes]] = True
    starts = cue_first[cue_first < n]
    sung = starts[(cp[starts] == 35) | (cp[starts] == 42)]
    bad[cue[sung]] = True
    for m in ADVERT.finditer(text):
        bad[cue[m.start()]] = True
    keep &= ~bad[cue]
    single = keep & (cp >= 0x3040)
    head = keep.copy()
    head[1:] &= ~keep[:-1] | single[1:] | single[:-1]
    words = np.flatnonzero(head)
    if not len(words):
        none = np.empty(0, np.int64)
        return none, none, none
    letters = np.flatnonzero(keep)
    own = np.cumsum(head)[letters] - 1
    starts_of = words[own]
    value = mix(cp[letters].astype(U) * U(0x9E3779B97F4A7C15) + (letters - starts_of).astype(U))
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    bucket = (mix(np.add.reduceat(value, edges)) & U(BUCKETS - 1)).astype(np.int64)
    last = letters[np.append(edges[1:], len(letters)) - 1]
    named = cp[last + 1] == 58
    ends = ((cp == 46) | (cp == 63) | (cp == 33) | (cp == 0x3002)) & ~bad[cue]
    doc = np.searchsorted(first, words, side="right") - 1
    stop = np.cumsum(ends)[words]
    new = np.ones(len(words), bool)
    new[1:] = (stop[1:] != stop[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    use = ~named
    return bucket[use], sentence[use], doc[use]


def _chunks(column: pa.Array):
    row, n = 0, len(column)
    while row < n:
        begin, texts, chars = row, [], 0
        while row < n and (chars < CHUNK_CHARS or row == begin):
            texts.append(column[row].as_py() or "")
            chars += len(texts[-1])
            row += 1
        yield begin, row, texts


@dataclass
class LevelModel:
    """Log probabilities of word buckets by class, float32 [BUCKETS, CLASSES]."""

    table: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray, weight: float = 0.1) -> LevelModel:
        """Counts [CLASSES, BUCKETS], each class mixed with the mean of all: a word that no class knows tells nothing."""
        share = (counts + 1e-9) / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        every = share.mean(axis=0, keepdims=True) + 1e-9
        return cls(np.ascontiguousarray(np.log((1 - weight) * share + weight * every).T.astype(np.float32)))

    def words_by_class(self, texts: list[str], least_prior: float = 0.02) -> np.ndarray:
        """[texts, CLASSES]: the number of spoken words in sentences of each class.

        A sentence has the class of the highest posterior: first with equal priors, then with the shares that the classes
        have in its text by the first step.
        """
        bucket, sentence, doc = spoken_words(texts)
        out = np.zeros((len(texts), CLASSES))
        if not len(bucket):
            return out
        heads = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        score = np.add.reduceat(self.table[bucket], heads, axis=0)
        size, of = np.diff(np.append(heads, len(bucket))), doc[heads]
        prior = np.zeros((len(of), CLASSES))
        for _ in range(2):
            out[:] = 0
            np.add.at(out, (of, np.argmax(score + prior, axis=1)), size)
            prior = np.log((out / np.maximum(out.sum(axis=1, keepdims=True), 1) + least_prior)[of])
        return out


def train_levels(documents: DataFrame, labels: DataFrame, other: Column, id_col: str = "doc_id", text_col: str = "text", level_col: str = "reading_level", most_labels: int = 20_000, most_other: int = 20_000) -> LevelModel:
    """Unigram models of the labelled levels, and one of what isn't English, from the documents for which ``other`` holds.

    Fitting uses at most ``most_labels`` labels and about ``most_other`` of the other documents, chosen by a hash of the
    id; these bounds, and BUCKETS, bound what is broadcast and what comes to the driver. Wrong labels only blur the models.
    """
    some = labels.where(f"{id_col} is not null and {level_col} between 1 and {CLASSES - 1}").select(F.col(id_col).alias("__label_id"), F.col(level_col).cast("int").alias("__level"))
    some = some.dropDuplicates(["__label_id"]).orderBy(F.xxhash64("__label_id"), "__label_id").limit(most_labels)
    total = documents.where(other).count()
    chosen = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_other / max(total, 1)))
    joined = documents.join(F.broadcast(some), F.col(id_col) == F.col("__label_id"), "left")
    rows = joined.select(F.coalesce("__level", F.when(other & chosen, 0)).alias("c"), F.col(text_col).alias("text")).where("c is not null and text is not null")

    def count(batches):
        counts = np.zeros((CLASSES, BUCKETS), np.int64)
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for a, b, texts in _chunks(batch.column(1)):
                bucket, _, doc = spoken_words(texts)
                np.add.at(counts, (kinds[a:b][doc], bucket), 1)
        c, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[c, b])], names=["c", "b", "n"])

    found = map_arrow(rows, count, "c int, b int, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((CLASSES, BUCKETS))
    counts[found["c"].to_numpy(np.int64), found["b"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return LevelModel.from_counts(counts)


def reading_levels(documents: DataFrame, model: LevelModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, level, confidence, n_words, level_words) of each document.

    level_words counts the spoken words in sentences of each class, 0 being any language but English; level is the level
    with most words, null if there are no words or most are not English; confidence is the level's share of all words.
    Null, empty and wordless texts have a null level and 0 words. One pass, without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.table)
    kind = documents.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for a, b, texts in _chunks(batch.column(1)):
                words = LevelModel(shared.value).words_by_class(texts).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, CLASSES), pa.int32()), pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "level_words"])

    out = map_arrow(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), score, f"id {kind}, level_words array<long>")
    total = F.aggregate("level_words", F.lit(0).cast("long"), lambda a, x: a + x)
    best = F.array_max(F.slice("level_words", 2, CLASSES - 1))
    english = (total > 0) & (F.get("level_words", F.lit(0)) * 2 < total)
    level = F.when(english, F.array_position(F.slice("level_words", 2, CLASSES - 1), best).cast("int"))
    return out.select(F.col("id").alias(id_col), level.alias("level"), F.when(english, best / total).alias("confidence"), total.alias("n_words"), "level_words")
