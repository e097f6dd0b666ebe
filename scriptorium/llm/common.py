"""What the operators of this subpackage share: inputs, scratch tables, streaming over sorted groups."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, one of our own on a single machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before us
        pass


@atexit.register
def _clean() -> None:
    while _written:
        _delete(*_written.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written to the shared folder and read again: its lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a `written` table that nothing reads any more; shuffle files of plans that are gone go with the driver's next collection, which this asks for."""
    entry = df.sparkSession, df.written_to
    _delete(*entry)
    _written.remove(entry)
    df.sparkSession.sparkContext._jvm.System.gc()


def small_enough(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A `written` table, to be broadcast if its rows, as Spark holds them, have at most `most` bytes; else as it is."""
    row = sum(8 if f.dataType.typeName() in ("long", "integer", "double", "boolean") else 32 for f in df.schema.fields) + 16
    return F.broadcast(df) if df.count() * row <= most else df


def over_groups(
    df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str
) -> DataFrame:
    """`f` over the rows of each value of `keys`, in `order`; one sort per partition, groups cut out of the stream.

    Unlike a grouped map this has no cost per group but `f` itself.  Groups must be bounded by the caller.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys]
            new = (k != k.shift()).any(axis=1).to_numpy()
            cuts = new.nonzero()[0]
            if rest and (rest[-1][keys].iloc[-1].to_numpy() == k.iloc[0].to_numpy()).all():
                cuts = cuts[1:]
            edges = [0, *cuts, len(batch)] if not len(cuts) or cuts[0] else [*cuts, len(batch)]
            if len(cuts) and not cuts[0] and rest:
                done, rest = pd.concat(rest), []
                out.append(f(done))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.iloc[a:b]
                if b == len(batch):
                    rest.append(part)
                elif rest:
                    out.append(f(pd.concat([*rest, part])))
                    rest = []
                else:
                    out.append(f(part))
                if out and out[-1] is not None:
                    held += len(out[-1])
                if held > 20_000:
                    yield pd.concat([x for x in out if x is not None])
                    out, held = [], 0
        if rest:
            out.append(f(pd.concat(rest)))
        if out := [x for x in out if x is not None and len(x)]:
            yield pd.concat(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
