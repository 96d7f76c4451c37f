"""Small frame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_scalars(small: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row of an already-aggregated frame.

    Done with a union and an unpartitioned window instead of a cross join; only use it
    when ``small`` is itself an aggregate (a handful of rows).
    """
    marker = "_scalar_row"
    u = (small.withColumn(marker, F.lit(False))
         .unionByName(one_row.withColumn(marker, F.lit(True)), allowMissingColumns=True))
    w = Window.partitionBy()
    u = u.withColumns({c: F.max(F.when(F.col(marker), F.col(c))).over(w) for c in one_row.columns})
    return u.filter(~F.col(marker)).drop(marker)
