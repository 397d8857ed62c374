"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the contracts: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A key with over one in so many of all rows is heavy, so there are fewer than so many heavy keys.
HEAVY = 2000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path, where both functions agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(*cols: Column) -> tuple[Column, Column]:
    """128 bits in two longs: hashes of the same values under two seeds. Nulls count, so (null, x) and (x, null) differ."""
    values = [*cols, *(c.isNull() for c in cols)]
    return F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, where all
    tasks see it, and an error elsewhere."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _run_folder(spark: SparkSession) -> str:
    """One folder for all stored tables of this application; it goes when the application ends."""
    name = f"{shared_folder(spark)}/lamella-{spark.sparkContext.applicationId}"
    path, files = _path(spark, name)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return name


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later reads don't depend on any executor. The table lasts until
    the application ends, or as long as ``folder``."""
    path = f"{folder or _run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``stored`` for tables that only this block reads; they are deleted when it ends. What outlives it must be stored otherwise."""
    folder = f"{_run_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield lambda df: stored(df, folder)
    finally:
        path, files = _path(spark, folder)
        files.delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For stages that send whole texts to Python and run within this block: at most ``rows`` rows in an Arrow batch, so that a worker
    holds a few MB of text at a time. The session's own setting comes back when the block ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A hint to broadcast ``df`` if a count shows at most ``max_rows`` rows, else ``df`` as it is, for a shuffled join.

    Give it stored tables with narrow rows, so that the count is cheap and bounds the bytes."""
    return F.broadcast(df) if at_most(df, max_rows) else df


def sized_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, max_rows: int = 200_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and, in ``weight``, the number of rows of ``left`` with that
    key; ``rows`` is the number of all rows of ``left``. ``weight`` isn't in the result. Both sides are read twice: give it stored tables.

    A right side of at most ``max_rows`` rows is broadcast. Of a larger one, the heavy keys are broadcast (there are fewer than
    ``HEAVY`` of them, whatever the size), so the shuffle of the others gives no task more than one in ``HEAVY`` rows for one key."""
    values = [c for c in right.columns if c != weight]
    if at_most(right, max_rows):
        return left.join(F.broadcast(right.select(*values)), on)
    heavy = F.broadcast(right.filter(F.col(weight) * HEAVY > rows).select(*values))
    light = right.filter(F.col(weight) * HEAVY <= rows).select(*values)
    return left.join(heavy, on).unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on))


def numbered(df: DataFrame, groups: list[str], order: list[Column], out: str = "place", rows_per_task: int = 100_000) -> DataFrame:
    """``df`` with each row's place in its group, from 0, by ``order``; stored. Groups' columns must not be null.

    Rows are dealt by ranges of (groups, order), so a group may hold any share of all rows: a task numbers its own range, and the ranges
    before it add what they hold of its first group. Rows that are equal in all of ``order`` go to one range, so let ``order`` tell
    repeated rows apart if there may be many. ``df`` is read twice, for a sample and for the rows: give it a stored table."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_task)
    keys = [*(F.col(c) for c in groups), *order]
    dealt = stored(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))  # the function's upper bits number the task
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = stored(starts.select("_range", *groups, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start")))
    placed = dealt.join(sized_broadcast(starts), ["_range", *groups])
    return placed.withColumn(out, F.col("_at") + F.col("_start")).drop("_at", "_range", "_start")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for each node in ``edges`` (a, b: long); nodes without an edge are not in it.

    Each round hooks a node to its smallest smaller neighbour, shortens hooks once, and replaces edges by those between the nodes
    hooked to; a hook that isn't at its root yet leaves an edge, so the work ends when no edge is left. The number of rounds grows
    with the logarithm of the longest path. Every round's tables are stored: a lost executor costs one round at most, and joins on
    a hot node have stored sides that Spark can split."""
    with scratch(edges.sparkSession) as temp:
        left, labels = temp(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()), None
        if left.isEmpty():
            return edges.sparkSession.createDataFrame([], "node long, component long")
        nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        while True:
            hooks = temp(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            hooks = temp(hooks.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")))
            if labels is None:
                labels = nodes.join(hooks, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
            else:
                named = hooks.select(F.col("node").alias("component"), "root")
                labels = labels.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            for side in ("a", "b"):
                left = left.join(hooks.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
            left = temp(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
            if left.isEmpty():
                return stored(labels)
            labels = temp(labels)
