"""What every operator needs from the Spark session: a reliable place to cut lineage, and safe column names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to: the one that ``spark.checkpoint.dir`` names, shared by all executors.

    Only a local master, where driver and executors are one process, gets a temporary folder when the setting is absent.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="samewise-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; what is written there goes when the session ends."""
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def checkpoint(df: DataFrame, **counts: Column) -> DataFrame:
    """``df``, computed once and written as a table to the shared checkpoint folder, so that a lost executor costs a re-read only.

    A table rather than an RDD checkpoint: the latter hands on the constraints and partitionings of its plan, which
    multiply through the joins and renamings of an iteration until planning takes longer than the work. The files go when
    the session ends, or with ``forget``. ``counts`` are aggregates taken while the table is written, with no job of their
    own; ``counted`` of the result gives them.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    seen = Observation() if counts else None
    (df.observe(seen, *(c.alias(n) for n, c in counts.items())) if counts else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._samewise_path = path
    out._samewise_counts = seen.get if counts else {}
    return out


def counted(df: DataFrame) -> dict:
    """The aggregates that were taken when the frame was checkpointed."""
    return df._samewise_counts


def forget(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed frames that nothing will read any more."""
    for df in frames:
        path = getattr(df, "_samewise_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the workers of a session, once; executors need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_samewise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="samewise-package-")) / "samewise_package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        sc.addPyFile(str(target))
    sc._samewise_shipped = True


def ship_file(spark: SparkSession, path: str) -> None:
    """Gives a file of the driver's machine to the workers of a session, once; ``shipped`` finds it there."""
    sc = spark.sparkContext
    have = sc.__dict__.setdefault("_samewise_files", set())
    if path not in have and Path(path).is_file():
        sc.addFile(path)
        have.add(path)


def shipped(path: str) -> str:
    """In a worker: the path itself if it exists there, else the file that ship_file brought."""
    return path if Path(path).exists() else SparkFiles.get(Path(path).name)


def map_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` with workers that know this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
