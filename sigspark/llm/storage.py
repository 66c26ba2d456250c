"""Shared folders, intermediate tables and binary shard files.

Intermediates live under ``spark.checkpoint.dir``, which driver and executors share.  Binary files are
written by tasks under a name of the attempt and then moved to their final name, so a retried or
speculative task leaves one whole file.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master without it gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='sigspark-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it or begins with it (in any case)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


@contextlib.contextmanager
def committed(uri: str) -> Iterator[pa.NativeFile]:
    """An output stream whose bytes appear at ``uri`` only once they are complete."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{os.path.dirname(path)}/_attempt-{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(attempt) as out:
            yield out
        files.move(attempt, path)
    except BaseException:
        with contextlib.suppress(OSError):
            files.delete_file(attempt)
        raise


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` whose workers give memory back when a task ends: Spark reuses them, and what a stage needed at its
    peak would otherwise stay with its workers while later stages run.  Columns may have any names: ``mapInArrow`` alone
    takes a dot in one for a field's."""
    names = df.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(task, schema)


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column, by one scan; operators size their partitions by it."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` bytes, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-size // each))
