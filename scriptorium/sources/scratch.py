"""Intermediate tables in the folder that the cluster shares, so that long plans are cut and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """`df`, written under spark.checkpoint.dir and read again; where that is unset, a folder of our own on a single machine, an error on a cluster."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/scriptorium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before us
        pass


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the tables that were stored within; what was made of them must be written by then."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _delete(*_written.pop())


@atexit.register
def _clean() -> None:
    while _written:
        _delete(*_written.pop())
