"""Grids and fields as tables: read, written, derived, and split off a supergrid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Which rows and columns of a supergrid belong to each position: (row parity, column parity).
PARITY = {"corner": (0, 0), "v": (0, 1), "u": (1, 0), "center": (1, 1)}


def read_fields(spark: SparkSession, path: str, pattern: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A field of many Parquet files in long form, perhaps only files of a name pattern and some columns."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_fields(df: DataFrame, path: str, j: str, partition_by: tuple[str, ...] = ("time",), mode: str = "error") -> None:
    """Write a field by time, its files sorted by row, so that a section's bounds skip row groups."""
    by = [c for c in partition_by if c in df.columns]
    df = df.repartition(*by, F.floor(F.col(j) / 64)) if by else df.repartitionByRange(j)
    df.sortWithinPartitions(*by, j).write.mode(mode).partitionBy(*by).parquet(path)


def from_arrays(spark: SparkSession, array, dims: list[str], name: str) -> DataFrame:
    """A small array in memory as a long table, an index column for each dimension."""
    import numpy as np

    array = np.asarray(array)
    rows = [(*map(int, at), None if np.isnan(float(x)) else float(x)) for at, x in np.ndenumerate(array)]
    return spark.createDataFrame(rows, ", ".join(f"{d} long" for d in dims) + f", {name} double")


def mesh(spark: SparkSession, rows: int, columns: int, j: str, i: str) -> DataFrame:
    """All index pairs."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias(j), F.pmod("id", F.lit(columns)).alias(i))


def split_supergrid(df: DataFrame, position: str, j: str = "j", i: str = "i", out: tuple[str, str] = ("yh", "xh")) -> DataFrame:
    """The points of a supergrid at one position, ``corner``, ``u``, ``v`` or ``center``, numbered anew."""
    row, column = PARITY[position]
    held = df.where((F.pmod(F.col(j), F.lit(2)) == row) & (F.pmod(F.col(i), F.lit(2)) == column))
    return held.withColumn(j, F.floor(F.col(j) / 2)).withColumn(i, F.floor(F.col(i) / 2)).withColumnRenamed(j, out[0]).withColumnRenamed(i, out[1])


def slice_from(df: DataFrame, index: str, first: int) -> DataFrame:
    """Rows from an index on, numbered from 0."""
    return df.where(F.col(index) >= first).withColumn(index, F.col(index) - first)
