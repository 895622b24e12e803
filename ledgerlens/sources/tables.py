"""Readers for the driver's parquet tables, with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import table_path


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one table; ``cols`` prunes the parquet scan to those columns."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df
