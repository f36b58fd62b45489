"""Posting lists reduced to stretches of neighbouring documents, where a few keys hold most rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.session import map_arrow

#: Documents of an accumulator block: four 64-bit words.
BLOCK = 256
#: Blocks that are reduced in one place: the unit into which a hot key is split.
SPAN = 256
#: Rows of an input split that are gathered before they are scattered.
FLUSH_ROWS = 1 << 18

U = np.uint64


def posting_blocks(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, block, w0..w3, n) of every input split: bit d of block b is set if document 256 b + d has the key; n counts rows.

    Splits are equal pieces of the input whatever their keys. In each, keys and blocks are dictionary-encoded and the rows
    scattered into a dense array of accumulators, so that what is shuffled of a hot key are blocks, not rows. Null keys and
    documents are ignored.
    """

    def scatter(batches):
        held, rows = [], 0

        def flush():
            keys, docs = (c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns)
            coded = keys.dictionary_encode()
            d = docs.to_numpy()
            blocks, block = np.unique(d >> 8, return_inverse=True)
            cells, cell = np.unique(coded.indices.to_numpy().astype(np.int64) * len(blocks) + block, return_inverse=True)
            acc = np.zeros(len(cells) * 4, U)
            np.bitwise_or.at(acc, cell * 4 + ((d & 255) >> 6), U(1) << (d & 63).astype(U))
            words = acc.reshape(-1, 4).view(np.int64)
            columns = [coded.dictionary.take(pa.array(cells // len(blocks))), pa.array(blocks[cells % len(blocks)]), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)), pa.array(np.bincount(cell))]
            return pa.RecordBatch.from_arrays(columns, names=["key", "block", "w0", "w1", "w2", "w3", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    rows = df.select(F.col(key).alias("key"), F.col(doc).cast("long").alias("doc")).where("key is not null and doc is not null")
    return map_arrow(rows, scatter, "key string, block long, w0 long, w1 long, w2 long, w3 long, n long")


def posting_runs(df: DataFrame, key: str, doc: str, min_length: int = 1) -> DataFrame:
    """(key, first_doc, last_doc, n_docs) of each maximal stretch d, d+1, ... of documents that all have the key.

    Repeated rows count once; null keys and documents are ignored; an empty table gives an empty result. Only stretches of
    at least ``min_length`` documents are given. Blocks of all splits are united for each (key, span of 65,536 documents),
    never for a whole key; only stretches that touch an end of a span (at most two a span) meet in one place for a key.
    """
    names = ["key", "first_doc", "last_doc", "edge"]

    def runs(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode().indices.to_numpy()
            block = batch.column(1).to_numpy()
            words = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)
            joined = np.zeros(len(block), bool)
            joined[1:] = (code[1:] == code[:-1]) & (block[1:] == block[:-1] + 1) & (block[1:] % SPAN != 0)
            flat = bits.ravel()
            before, after = np.zeros_like(flat), np.zeros_like(flat)
            before[1:], after[:-1] = flat[:-1], flat[1:]
            heads, tails = np.arange(len(block)) * BLOCK, np.arange(len(block)) * BLOCK + BLOCK - 1
            before[heads] &= joined
            after[tails] &= np.append(joined[1:], False)
            begin, end = np.flatnonzero(flat & ~before), np.flatnonzero(flat & ~after)
            row = begin // BLOCK
            first = block[row] * BLOCK + begin % BLOCK
            last = block[end // BLOCK] * BLOCK + end % BLOCK
            # a stretch may go on in another span or batch
            span = BLOCK * SPAN
            edge = (first % span == 0) | (last % span == span - 1) | (begin == 0) | (end == len(flat) - 1)
            keep = edge | (last - first + 1 >= min_length)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(first[keep]), pa.array(last[keep]), pa.array(edge[keep])], names=names)

    spans = posting_blocks(df, key, doc).withColumn("span", F.floor(F.col("block") / SPAN)).repartition("key", "span")
    united = spans.groupBy("key", "span", "block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)))
    ordered = united.sortWithinPartitions("key", "span", "block").select("key", "block", "w0", "w1", "w2", "w3")
    found = map_arrow(ordered, runs, "key string, first_doc long, last_doc long, edge boolean")
    order = Window.partitionBy("key").orderBy("first_doc")
    edges = found.where("edge").withColumn("new", F.coalesce(F.col("first_doc") != F.lag("last_doc").over(order) + 1, F.lit(True)).cast("long"))
    stitched = edges.withColumn("island", F.sum("new").over(order)).groupBy("key", "island").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    every = found.where(~F.col("edge")).select("key", "first_doc", "last_doc").unionByName(stitched.select("key", "first_doc", "last_doc"))
    out = every.withColumn("n_docs", F.col("last_doc") - F.col("first_doc") + 1).where(F.col("n_docs") >= min_length)
    return out.select(F.col("key").alias(key), "first_doc", "last_doc", "n_docs")


def key_counts(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, n_rows, n_docs): rows and distinct documents of each key, from the same blocks; nulls are ignored."""
    blocks = posting_blocks(df, key, doc).groupBy("key", "block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)), F.sum("n").alias("n"))
    docs = sum((F.bit_count(f"w{k}") for k in range(4)), F.lit(0))
    return blocks.groupBy("key").agg(F.sum("n").alias("n_rows"), F.sum(docs).cast("long").alias("n_docs")).withColumnRenamed("key", key)
