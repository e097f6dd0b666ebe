"""What the vector operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id where ids are ordered: after all others.
LAST = (1 << 63) - 1


def usable(embedding: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    parts = embedding.cast("array<double>")
    fine = F.forall(parts, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def numbered(df: DataFrame) -> DataFrame:
    """With rid, a number of its own for every row.  It is stable only once the table is written."""
    return df.withColumn("rid", F.monotonically_increasing_id())
