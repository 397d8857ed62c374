"""Sharding: sampled splitters. Size-weighted key samples give quantile boundaries; records are range-partitioned; overfull ranges are subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import sized_broadcast, stored

#: Shards; rows that a range holds on average; ranges at most; sample keys per range; a range is overfull beyond so many times its share.
SHARDS, RANGE_ROWS, MOST_RANGES, PER_RANGE, OVERFULL, SEED = 8, 256, 1 << 14, 16, 3, 11
#: Equal texts of less than this part of a shard aren't parted within a range.
SNAP = 200


def _ranges(keys: DataFrame, splitters: np.ndarray, out: str) -> DataFrame:
    """``keys`` with the number of the range that holds its key: splitters up to and with it."""
    cuts = np.sort(splitters)

    @F.pandas_udf("long")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right"))

    return keys.withColumn(out, place("key"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``, under the law ``bytes``.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Its 64-bit key has a hash of the text above a hash of its
    id, so equal texts are neighbours, and a group of equal texts of any size can still be cut; the last 8 bits keep repeated rows apart. A sample of bounded size, drawn
    in proportion to a row's share of all bytes and of all rows, gives splitters, and these the ranges. A range that holds over
    ``OVERFULL`` times its share is subdivided at equal steps of its keys. Exact sums over ranges place every range, and a window
    within each range places its rows; shard s takes the rows whose middle lies in the s-th part of all bytes. Equal texts
    in a range that are under 1 / ``SNAP`` of a shard go where their first row goes. slot counts a shard's rows from 0.

    Rows with equal ids and texts stay apart by slot alone; which of them has which is arbitrary, but neither shards' sizes nor
    the other columns depend on it. Ids may be null. Empty in, empty out."""
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    text32 = F.shiftright(F.xxhash64(F.lit(seed), F.col(text_col)), 32)
    id24 = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 40)
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 56)
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    key = F.shiftleft(text32, 32).bitwiseOR(F.shiftleft(id24, 8)).bitwiseOR(salt)
    d = stored(docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), key.alias("key")))
    total = d.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    rows, all_bytes = total["n"], total["bytes"] or 0
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    if not rows:
        return d.select(F.col("id").alias(id_col), "size", "text_crc32", law, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), grown)
    n = min(MOST_RANGES, max(shards * 8, rows // range_rows))
    part = (F.col("size") / all_bytes + 1 / rows) / 2  # of all bytes and of all rows
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "key"), 11) / float(1 << 53)
    times = F.least(F.lit(8.0), F.floor(part * n * PER_RANGE + drawn)).cast("int")  # on average n * PER_RANGE keys in all
    sample = np.sort(d.select(F.explode(F.array_repeat("key", times)).alias("key")).toPandas()["key"].to_numpy(np.int64))
    splitters = np.unique(sample[np.linspace(0, len(sample), n, endpoint=False).astype(int)[1:]]) if len(sample) else np.zeros(0, np.int64)
    ranged = _ranges(d, splitters, "range")
    overfull = (F.col("b") > OVERFULL * all_bytes / n) | (F.col("r") > OVERFULL * rows / n)
    while True:  # each round cuts every overfull range of several keys, so it ends; there are fewer of them than n / OVERFULL by bytes and by rows
        counted = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("r"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        counted = counted.filter(overfull & (F.col("lo") < F.col("hi"))).toPandas()
        if not len(counted):
            break
        parts = np.ceil(2 * np.maximum(counted["b"] * n / all_bytes, counted["r"] * n / rows)).astype(int)
        steps = [[int(lo) + (int(hi) - int(lo)) * i // k for i in range(1, k + 1)] for lo, hi, k in zip(counted["lo"], counted["hi"], parts, strict=True)]
        splitters = np.unique(np.concatenate([splitters, *(np.array(x, np.int64) for x in steps)]))
        ranged = _ranges(d, splitters, "range")
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("size").alias("_b"), F.count("*").alias("_r"))
    starts = starts.select("range", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(c) for c in ("_b", "_r")))
    placed_by = Window.partitionBy("range").orderBy("key", F.col("id").asc_nulls_last(), "size", "text_crc32")
    upto = placed_by.rowsBetween(Window.unboundedPreceding, 0)
    laid = ranged.withColumn("_middle", F.sum("size").over(upto) - F.col("size") / 2).withColumn("_row", F.row_number().over(placed_by))
    same = Window.partitionBy("range", "text_crc32", "size", F.shiftright("key", 32))
    small = F.sum("size").over(same) * SNAP <= all_bytes / shards
    laid = laid.withColumn("_middle", F.when(small, F.min("_middle").over(same)).otherwise(F.col("_middle")))
    shard = F.least(F.lit(shards - 1), F.floor((F.col("_middle") + F.col("_b")) * shards / all_bytes)).cast("int")
    placed = laid.join(sized_broadcast(stored(starts)), "range")
    placed = stored(placed.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("_row") + F.col("_r") - 1).alias("_row")))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    out = placed.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", law, "shard", (F.col("_row") - F.col("_first")).alias("slot"), grown)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
