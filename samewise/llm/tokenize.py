"""Encoding of a text column with a public tokenizer, and back."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.bpe import encode_column, vocabulary
from samewise.session import map_arrow, ship_file, ship_package, shipped

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.json"


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K, offsets: bool = False) -> DataFrame:
    """One row per input row: the id column, ``ids`` (array<int>) and, if asked for, ``starts`` (the byte at which each id begins).

    Empty and null texts give an empty list; a blank text is encoded as it is; strings of special tokens are ordinary
    text. Rows are neither moved nor joined: the plan is scan, map, result. The file comes from ``folder`` on
    the driver's machine, and goes to executors that don't have it.
    """
    path = os.path.join(folder, name)
    ship_file(df.sparkSession, path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, ids, counts, where in encode_column(batch.column(1), shipped(path), offsets):
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, where) if x is not None]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["id", "ids", "starts"][: 1 + len(lists)])

    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>" + ", starts array<int>" * offsets)
    return out.withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (long) of each row; the ids themselves never leave the worker."""
    path = os.path.join(folder, name)
    ship_file(df.sparkSession, path)
    schema = ", ".join(f"c{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))

    def run(batches):
        for batch in batches:
            for a, b, _, counts, _ in encode_column(batch.column(len(keep)), shipped(path)):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), pa.array(counts, pa.int64())], names=[*(f"c{k}" for k in range(len(keep))), "n_tokens"])

    out = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), F.col(text_col).alias("text"))
    out = map_arrow(out, run, f"{schema}, n_tokens long")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "n_tokens")


def decode_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "text", folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> DataFrame:
    """The input with the text that the ids stand for; an empty list gives an empty text."""
    path = os.path.join(folder, name)
    ship_file(df.sparkSession, path)
    ship_package(df.sparkSession)

    def text(ids: Column) -> Column:
        @F.arrow_udf("string")
        def decode(lists: pa.Array) -> pa.Array:
            pieces = vocabulary(shipped(path)).pieces
            flat = lists.flatten()
            counts = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, pieces.take(flat)), b"")
            try:
                text = joined.cast(pa.string())
            except pa.ArrowInvalid:  # ids that were cut within a character
                text = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
            return pc.if_else(lists.is_valid(), text, None)

        return decode(ids)

    return df.withColumn(out_col, text(F.col(ids_col)))
