"""Steps of a run whose results must not change or be made again once later steps have begun."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """``df`` as it is now, in the cluster's checkpoint folder, so that neither a lost executor nor files that later steps write or delete
    make it be computed again. A folder of our own stands in only in local mode."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (context.master or "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def tasks_for(df: DataFrame, most: int, weight: Column | None = None) -> int:
    """Number of tasks that share ``df`` so that the rows of each weigh about ``most`` together (a row weighs 1, or ``weight``)."""
    total = df.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return max(1, -(-int(total) // most))


def spread(df: DataFrame, most: int, *keys: str, weight: Column | None = None) -> DataFrame:
    """``df`` dealt by ``keys``, or in turn without any, to ``tasks_for`` it.

    For tables of few bytes whose rows become many or cost much: Spark reads them as one split, so one task would do it all. The
    number of tasks grows with the table, a task's share doesn't. The filter holds for all rows; as its value is the task's, later
    filters and the costly columns in them stay behind it and aren't moved before the dealing."""
    return df.repartition(tasks_for(df, most, weight), *keys).filter(F.spark_partition_id() >= 0)
