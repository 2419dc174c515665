"""Helpers shared by the operators: durable cuts of a plan, folds, Arrow access."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A-Z to a-z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_LIBC = ctypes.CDLL(None)

#: Temporary folders of applications without a shared one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Only a local session without either, as in tests, gets a temporary one; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='tidewalk-')}"
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package as the driver does; a cluster gets it by --py-files or installation."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_folder(spark)}/tidewalk/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a file read, not a recomputation.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewalk_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete what ``cut`` wrote; nothing may read it any more."""
    jpath = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tidewalk_path)
    jpath.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str = "n", most: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, a cut table that has each key once and in ``n`` how many rows have it.

    Keys that hold more than 1 / ``most`` of the rows, of which there can be ``most`` at most, are broadcast, and their rows are dealt out by
    all their columns; the others meet by shuffle at every size.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    more = [c for c in table.columns if c not in (key, n)]
    packed = table.select(F.col(key).alias("_key"), F.lit(0).alias("_salt"), F.struct(F.lit(1).alias("_there"), *more).alias("_row"), n)
    hot, rest = packed.where(F.col(n) > total / most), packed.where(F.col(n) <= total / most)
    held = rows.join(F.broadcast(hot.select(F.col("_key").alias("_hot"), F.col("_row").alias("_hot_row"))), F.col(key) == F.col("_hot"), "left").drop("_hot")
    held = held.withColumn("_dealt", F.when(F.col("_hot_row").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))))
    held = held.join(rest.drop(n).hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_dealt") == F.col("_salt")), "left")
    held = held.withColumn("_row", F.coalesce("_hot_row", "_row")).where("_row is not null")
    return held.select(*rows.columns, *(F.col("_row")[c].alias(c) for c in more))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sliced(batches, rows: int = 512):
    """Arrow batches in parts of so many rows, so that what is made of a part in Python stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def given_back(result):
    """``result``, after freed memory went back to the system: Spark's Python workers live on and would keep it beside all that follows."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
    return result


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column) -> list[str]:
    """Strings of an Arrow string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def vectors(column) -> list[np.ndarray | None]:
    """Double vectors of an Arrow list column; None for null, null or non-finite components."""
    flat = column.flatten() if column.null_count == 0 else None
    if flat is not None and flat.null_count == 0:
        at = np.asarray(column.offsets)
        at = at - at[0]
        all_of = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        rows = [all_of[a:b] for a, b in zip(at[:-1], at[1:])]
    else:
        rows = [None if x is None or any(y is None for y in x) else np.array(x, dtype=np.float64) for x in column.to_pylist()]
    return [x if x is not None and len(x) and np.isfinite(x).all() else None for x in rows]
