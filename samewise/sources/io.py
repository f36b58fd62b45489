"""Reading records and writing pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = ("csv", "json", "parquet", "orc", "text")


def read_csv(spark: SparkSession, path: str, separator: str = ",", header: bool = True, trim: bool = False, multi_line: bool = False) -> DataFrame:
    """A CSV file with all columns as text; quotes are doubled inside quotes. ``trim`` also makes blank cells null.

    A large file is read in splits by many tasks. Cells that hold line breaks need ``multi_line``, which makes a file one task.
    """
    df = spark.read.csv(path, sep=separator, header=header, quote='"', escape='"', multiLine=multi_line)
    return df.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns)) if trim else df


def read_records(spark: SparkSession, path: str, form: str, **options) -> DataFrame:
    """Records in any of READERS' formats."""
    if form not in READERS:
        raise ValueError(f"unknown format {form!r}")
    return read_csv(spark, path, **options) if form == "csv" else spark.read.format(form).options(**options).load(path)


def read_lines(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(id, text): one document a line; ids from ``start`` in the order of the files' names, and of the lines in a file.

    No text is shuffled: lines are counted for each split, and numbered as they are read from where their split begins in
    the order of (file, place in the file). A split's lines stand in one task in their order.
    """
    file, at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"), file, at)
    sizes = rows.groupBy("file", "at").agg(F.count("*").alias("size"), F.min("n").alias("first"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    shift = F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + start
    # broadcast: three numbers for each file, or for each spark.sql.files.maxPartitionBytes of a large one
    offsets = F.broadcast(sizes.select(F.xxhash64("file").alias("h"), "at", shift.alias("shift")))
    return rows.withColumn("h", F.xxhash64("file")).join(offsets, ["h", "at"]).select((F.col("n") + F.col("shift")).cast("long").alias("id"), "text")


def numbered(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """The input with a dense long ``id`` from ``start`` in the order of a column, numbered within ranges and offset by what is before."""
    parts = df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    own = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = own.groupBy("__part").agg(F.max("__row").alias("__size"), F.min(order).alias("__first"))
    before = Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(offsets), "__part").withColumn("id", (F.col("__row") - 1 + F.col("__before") + start).cast("long")).drop("__part", "__row", "__before")


def _values(kind: T.DataType, c: Column, inner_separator: str | None) -> Column:
    """The texts that a cell stands for."""
    if isinstance(kind, T.ArrayType):
        return F.array_compact(c.cast("array<string>"))
    if isinstance(kind, T.StringType) and inner_separator:
        return F.split(c, "\\Q" + inner_separator + "\\E")
    return F.array_compact(F.array(c.cast("string")))


def to_attributes(df: DataFrame, id_col: str, inner_separator: str | None = None) -> DataFrame:
    """(id, attr_key, attr_value) rows of a wide table: null gives none, an array one a non-null element, anything else its text.

    With ``inner_separator``, texts are split at it.
    """
    cells = []
    for f in df.schema.fields:
        if f.name == id_col:
            continue
        values = _values(f.dataType, F.col(f"`{f.name}`"), inner_separator)
        cells.append(F.struct(F.lit(f.name).alias("k"), values.alias("v")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array(*cells)).alias("c"))
    return rows.select("id", F.col("c.k").alias("attr_key"), F.explode("c.v").alias("attr_value"))


def to_profiles(df: DataFrame, id_col: str | None = None, start: int = 0, inner_separator: str | None = None) -> DataFrame:
    """(id, original_id, attributes array<struct<attr_key, attr_value>>) of a wide table, one profile a row.

    ids are dense from ``start`` in the order of the column ``id_col``, whose trimmed text is the original id (without it,
    the order of the rows as text, and the original id is empty). Attributes are those of to_attributes, in the order of the columns.
    """
    cells = [c for c in df.columns if c != id_col]
    order = F.col(f"`{id_col}`") if id_col else F.to_json(F.struct(*(F.col(f"`{c}`") for c in cells)))
    original = F.trim(F.col(f"`{id_col}`").cast("string")) if id_col else F.lit("")

    def cell(c: str) -> Column:
        values = F.coalesce(_values(df.schema[c].dataType, F.col(f"`{c}`"), inner_separator), F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(c).alias("attr_key"), v.alias("attr_value")))

    lists = [cell(c) for c in cells]
    attributes = F.flatten(F.array(*lists)) if lists else F.array().cast("array<struct<attr_key:string,attr_value:string>>")
    rows = df.select(order.alias("order"), original.alias("original_id"), attributes.alias("attributes"))
    return numbered(rows, "order", start).select("id", "original_id", "attributes")


def read_profiles(spark: SparkSession, path: str, id_col: str | None = None, start: int = 0, separator: str = ",", header: bool = True, inner_separator: str | None = None, multi_line: bool = False) -> DataFrame:
    """The profiles of a CSV file; see read_csv and to_profiles."""
    return to_profiles(read_csv(spark, path, separator, header, multi_line=multi_line), id_col, start, inner_separator)


def extract_field(attributes: DataFrame, name: str) -> DataFrame:
    """(id, value): the values of one attribute joined by blanks and lower-cased; records without one or with blanks only are left out."""
    rows = attributes.where((F.col("attr_key") == name) & F.col("attr_value").isNotNull())
    joined = rows.groupBy("id").agg(F.lower(F.concat_ws(" ", F.array_sort(F.collect_list("attr_value")))).alias("value"))
    return joined.where(F.trim("value") != "")


def record_text(df: DataFrame, id_col: str) -> DataFrame:
    """(id, text): all attributes of a record joined by blanks, whatever they are called."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in df.columns if c != id_col)).alias("text"))


def write_pairs(pairs: DataFrame, path: str, form: str = "csv") -> None:
    """Writes (id1, id2) rows; CSV without a header."""
    pairs.select("id1", "id2").write.mode("errorifexists").format(form).save(path)
