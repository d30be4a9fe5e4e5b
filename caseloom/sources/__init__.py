"""Readers for source functions, and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """With a schema, so that no pass over the data is spent to guess one; short rows get nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path, header=header)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Read in ranges of a numeric key, one for each task."""
    given = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**given, **options).load()
