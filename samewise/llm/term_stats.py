"""Frequency of every term by attribute: compressed record bitmaps in a vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.session import map_arrow

#: A container holds the low 16 bits of the record ids that share their high bits: at most 8 KB as a bitmap.
CONTAINER_BITS = 1 << 16
#: From this many ids on, a container is a bitmap; below, a sorted array of 16-bit numbers.
DENSE = 4096
#: Rows a worker gathers before it builds containers.
FLUSH_ROWS = 1 << 18


def _containers(keys: list[pa.Array], group: np.ndarray, low: np.ndarray, occurrences: np.ndarray) -> pa.RecordBatch:
    """One row a group with its container. group: the group of each (distinct within it, sorted) low id; keys: key columns, one row a group."""
    n = len(occurrences)
    sizes = np.bincount(group, minlength=n)
    flat = low.astype("<u2")
    dense = np.flatnonzero(sizes >= DENSE)
    ends = np.cumsum(sizes)
    if len(dense):
        parts, widths, at = [], sizes * 2, 0
        for g in dense:
            begin = ends[g] - sizes[g]
            bits = np.zeros(CONTAINER_BITS, np.uint8)
            bits[flat[begin : ends[g]]] = 1
            parts += [flat[at:begin].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
            widths[g], at = CONTAINER_BITS // 8, ends[g]
        data = b"".join([*parts, flat[at:].tobytes()])
    else:
        widths, data = sizes * 2, flat.tobytes()
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([*keys, pa.array(occurrences.astype(np.int64)), pa.array(sizes.astype(np.int64)), blobs], names=NAMES)


NAMES = ["attr", "term", "container", "occurrences", "records", "bitmap"]


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are, -1 for null."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _decode(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, low id) of all containers in a binary column."""
    width = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64)
    dense = width == CONTAINER_BITS // 8
    sparse = blobs.filter(pa.array(~dense))
    low = np.frombuffer(b"".join(sparse.to_pylist()), "<u2").astype(np.int64)
    row = np.repeat(np.flatnonzero(~dense), width[~dense] // 2)
    rows, lows = [row], [low]
    for r in np.flatnonzero(dense):
        at = np.flatnonzero(np.unpackbits(np.frombuffer(blobs[r].as_py(), np.uint8), bitorder="little"))
        rows.append(np.full(len(at), r))
        lows.append(at)
    return np.concatenate(rows), np.concatenate(lows)


def _union(table: pa.Table) -> pa.RecordBatch:
    """Neighbouring rows of one key become one: bitmaps by union, occurrences by sum. The rows are sorted by key."""
    cols = [c.chunk(0) for c in table.combine_chunks().columns]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in cols[:3]:
        code = _codes(c)
        new[1:] |= code[1:] != code[:-1]
    heads = np.flatnonzero(new)
    own = np.cumsum(new) - 1
    row, low = _decode(cols[5])
    cell = np.unique(own[row] * CONTAINER_BITS + low)
    occurrences = np.add.reduceat(cols[3].to_numpy(zero_copy_only=False), heads)
    return _containers([c.take(pa.array(heads)) for c in cols[:3]], cell // CONTAINER_BITS, cell % CONTAINER_BITS, occurrences)


def term_bitmaps(terms: DataFrame) -> DataFrame:
    """(attr, term, container, occurrences, records, bitmap): the ids of the records that have a term, 65,536 ids a row.

    terms: (attr string, term string, id long), a row for each occurrence. Every input split builds its own containers
    (a hot term of a split shrinks to 8 KB for 65,536 records), which are then merged by union for each (attr, term,
    container), so that no task ever holds all records of a term. Null attrs and terms are keys of their own; rows with
    a null id are ignored.
    """
    schema = "attr string, term string, container long, occurrences long, records long, bitmap binary"

    def build(batches):
        held, rows = [], 0

        def flush():
            cols = [c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns]
            attr, term, ids = _codes(cols[0]), _codes(cols[1]), cols[2].to_numpy()
            order = np.lexsort((ids, term, attr))
            a, w, i = attr[order], term[order], ids[order]
            box = i >> 16
            new = np.ones(len(i), bool)
            new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (box[1:] != box[:-1])
            fresh = np.ones(len(i), bool)
            fresh[1:] = new[1:] | (i[1:] != i[:-1])
            own = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            at = pa.array(order[heads])
            keys = [cols[k].take(at) for k in (0, 1)]
            return _containers([*keys, pa.array(box[heads])], own[fresh], i[fresh] & (CONTAINER_BITS - 1), np.bincount(own))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    def merge(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 4096:
                done = _union(held)
                # the last key may go on in the next batch; it is carried on merged, one container of at most 8 KB
                yield done.slice(0, done.num_rows - 1)
                held = pa.Table.from_batches([done.slice(done.num_rows - 1)])
        if held is not None and held.num_rows:
            yield _union(held)

    keys = ["attr", "term", "container"]
    built = map_arrow(terms.where("id is not null").select("attr", "term", "id"), build, schema)
    return map_arrow(built.repartition(*keys).sortWithinPartitions(*keys), merge, schema)


def attribute_terms(df: DataFrame, id_col: str, attr: Column, terms: Column) -> DataFrame:
    """(attr, term, id) of every occurrence, and a row with a null term for each value that has any term at all."""
    rows = df.select(attr.alias("attr"), terms.alias("terms"), F.col(id_col).cast("long").alias("id")).where(F.size("terms") > 0)
    return rows.select("attr", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"), "id")


def term_statistics(df: DataFrame, id_col: str, attr: Column, terms: Column, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(attr, term, occurrences, records, of_records, is_rare, is_common) of every term under every attribute.

    records is the number of distinct ids with the term, read from the cardinality of its bitmap; of_records that of ids
    with any term under the attribute. is_rare: in at most ``rare`` records; is_common: in more than the share ``common``
    of them. Null or term-less values and null ids count nowhere; a null attribute is one of its own; an empty table gives an empty result.
    """
    boxes = term_bitmaps(attribute_terms(df, id_col, attr, terms)).drop("bitmap")
    totals = boxes.groupBy("attr", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # the total of an attribute is the row with the null term; it reaches the others in one pass, as the largest of its attribute
    every = totals.where(F.col("term").isNull()).select(F.col("attr").alias("k"), F.col("records").alias("of_records"))
    rows = totals.where(F.col("term").isNotNull()).join(every, F.col("attr").eqNullSafe(F.col("k"))).drop("k")
    return rows.withColumns({"is_rare": F.col("records") <= rare, "is_common": F.col("records") > F.lit(common) * F.col("of_records")})
