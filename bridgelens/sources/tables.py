"""Readers for the fact tables and the given test tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bridgelens.session import scratch_path

# Columns the reports read from each fact table (anything else is pruned).
TRANSFER_COLUMNS = ("id", "created_at", "recipient_address", "sender_address", "status",
                    "simplified_status", "data")
GMP_COLUMNS = ("id", "created_at", "status", "simplified_status", "data")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, e.g. ``read_table(spark, dir, 'lineitem')``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_facts(spark: SparkSession, source: str, columns=None, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame:
    """A fact table from a catalog name or a path (there with ``schema``, or the files' own).

    ``data`` may be JSON text or VARIANT; both are accepted downstream.
    """
    if "/" in source or source.endswith((".parquet", ".orc", ".json")):
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema is not None else reader).load(source)
    else:
        df = spark.table(source)
    return df.select(*columns) if columns else df


def read_transfers(spark: SparkSession, source: str, fmt: str = "parquet", schema=None) -> DataFrame:
    return read_facts(spark, source, TRANSFER_COLUMNS, fmt, schema)


def read_gmp(spark: SparkSession, source: str, fmt: str = "parquet", schema=None) -> DataFrame:
    return read_facts(spark, source, GMP_COLUMNS, fmt, schema)


#: Whether Spark infers a shredding schema for each Parquet file with VARIANT.
SHREDDING = "spark.sql.variant.inferShreddingSchema"


def store_variant(spark: SparkSession, facts: dict[str, DataFrame]) -> list[str]:
    """Write fact tables with ``data`` as VARIANT to the shared scratch folder; returns their paths in order.

    The documents are small and read once, so they are written whole: shredding them costs more than the parse.
    Both writes run at a time, so that the tasks of one fill the cores that the other leaves.
    """
    def write(item: tuple[str, DataFrame]) -> str:
        path = scratch_path(spark, f"variant-{item[0]}")
        item[1].withColumn("data", F.try_parse_json("data")).write.parquet(path)
        return path

    old = spark.conf.get(SHREDDING, None)
    spark.conf.set(SHREDDING, "false")
    try:
        with ThreadPoolExecutor(len(facts)) as pool:
            return list(pool.map(write, facts.items()))
    finally:
        if old is None:
            spark.conf.unset(SHREDDING)
        else:
            spark.conf.set(SHREDDING, old)
