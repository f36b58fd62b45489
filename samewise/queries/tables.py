"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule_threshold(spark: SparkSession, sf_dir: str, rule_id: str, attr_name: str, rule_type: str = "JS") -> float:
    """The threshold of the only condition of that kind in the fixed table ``rules``."""
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "rules").where((F.col("rule_id") == rule_id) & (F.col("attr_name") == attr_name) & (F.col("rule_type") == rule_type))
    return float(rows.agg(F.max("threshold")).first()[0])
