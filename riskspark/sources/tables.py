"""Readers and writers for the stored tables.

Parquet is the first choice: the scan prunes columns and takes pushed
filters.  CSV files written by spreadsheet-style tools are read with an
explicit schema (never inferred), multi-line quoted cells, and NaN -> NULL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class InputNotFoundError(FileNotFoundError):
    pass


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Column pruning and filters reach the scan because
    every caller selects what it uses."""
    path = table_path(sf_dir, name)
    if "://" not in path and not os.path.exists(path):
        raise InputNotFoundError(f"input table not found: {path}")
    return spark.read.parquet(path)


def spread_scan(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Spread the rows of a scan over ``partitions`` hash partitions of
    ``key`` (a unique id, so no partition can be hot); without a number the
    scan stays as it is and no shuffle is added.

    A file written as one row group is read by one task however many cores
    there are; heavy work on whole texts would then run on one core.  Only
    the caller knows such inputs; a table of many files needs no spreading."""
    return df.repartition(partitions, key) if partitions else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a UTF-8 CSV (BOM tolerated) with quoted multi-line cells; float
    NaN cells become NULL so averages skip them like pandas does."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    fixes = {
        f.name: F.when(F.isnan(F.col(f.name)), F.lit(None)).otherwise(F.col(f.name))
        for f in schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write per partition (no funnel through one task or the driver)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        # the writer trims cell whitespace by default; texts must come back whole
        (w.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
