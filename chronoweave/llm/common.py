"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table, through Spark's own reader (the directory may be on any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/chronoweave-{uuid.uuid4().hex}"


_folder: ContextVar[str | None] = ContextVar("chronoweave_scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those to keep, are deleted at the end: results have to be written before."""
    path = shared_dir(spark)
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        _delete(spark, path)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """The frame as a written table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    folder = None if keep else _folder.get()
    path = f"{folder}/{uuid.uuid4().hex}" if folder else shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._chronoweave_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(*frames: DataFrame | None) -> None:
    """Deletes tables made by :func:`written` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_chronoweave_path", None):
            _delete(df.sparkSession, path)


def id_crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written in decimal, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def hash_fraction(*columns: str) -> Column:
    """A fixed pseudo-random number in [0, 1) of the columns' values."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def batches_of(values: Iterable, size: int):
    """Lists of at most ``size`` values."""
    block = []
    for x in values:
        block.append(x)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
