"""Operational tables (SRC-1): Parquet at rest with explicit schemas, JDBC as
the connector form for a live relational store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewatt.schemas import TABLE_SCHEMAS


def read_table(spark: SparkSession, path: str, name: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """Read one table with its declared schema (no inference, no footer merge)."""
    schema = schema or TABLE_SCHEMAS.get(name)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, names=None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All operational tables under ``path`` (one sub-folder per table)."""
    return {n: read_table(spark, path, n, fmt=fmt) for n in (names or TABLE_SCHEMAS)}


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None) -> DataFrame:
    """Parallel JDBC read: with ``partition_column`` the range is split into
    ``num_partitions`` concurrent queries instead of one single-task read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
              .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions or 8)))
    return r.load()
