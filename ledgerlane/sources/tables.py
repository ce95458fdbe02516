"""Typed scans of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.schemas import TABLES


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six domain tables under ``folder`` with declared schemas."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}")
        for name, schema in TABLES.items()
    }


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the supplied star-schema tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
