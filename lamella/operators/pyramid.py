"""Half-scale levels of integer rasters, as grouped passes over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import half_scale


def pixels(rasters: DataFrame, raster: str, values: str, side: int) -> DataFrame:
    """raster, x, y, value from an array of side * side values, rows first."""
    return rasters.select(F.col(raster).alias("raster"), F.posexplode(values).alias("i", "value")).select("raster", (F.col("i") % side).cast("long").alias("x"), F.floor(F.col("i") / side).cast("long").alias("y"), "value")


def quantised(x: Column, low: float, high: float) -> Column:
    """0 to 255 by the floor of a double."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") - low) / (high - low) * 256))).cast("long")


def half_level(px: DataFrame, keys: list[str], fill: int = 0) -> DataFrame:
    """The raster at half its scale: each 2 x 2 block is one pixel; samples beyond the edge are ``fill``, as padding is black."""
    qx, qy = F.floor(F.col("x") / 2), F.floor(F.col("y") / 2)
    at = {n: F.coalesce(F.max(F.when((F.col("x") % 2 == i) & (F.col("y") % 2 == j), F.col("value"))), F.lit(fill).cast("long")) for n, (i, j) in {"nw": (0, 0), "ne": (1, 0), "sw": (0, 1), "se": (1, 1)}.items()}
    out = px.groupBy(*keys, qx.alias("qx"), qy.alias("qy")).agg(*(c.alias(n) for n, c in at.items()))
    return out.select(*keys, F.col("qx").alias("x"), F.col("qy").alias("y"), half_scale(*(F.col(n) for n in at)).alias("value"))


def pyramid(px: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """level and pixels of ``levels`` half-scale levels above ``px`` (level 0, included).

    Pixels are dealt once by the block of 2**levels that holds them; every level's groups lie within a block, so one shuffle
    serves all levels."""
    block = 1 << levels
    px = px.withColumn("bx", F.floor(F.col("x") / block)).withColumn("by", F.floor(F.col("y") / block)).repartition(*keys, "bx", "by")
    out, level = px.withColumn("level", F.lit(0)), px
    for k in range(1, levels + 1):
        level = half_level(level, [*keys, "bx", "by"])
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.drop("bx", "by")


def undo_difference(values: DataFrame, row: list[str], order: str, value: str) -> DataFrame:
    """``values`` with decoded: running sum modulo 256 along a row, the horizontal predictor's inverse."""
    upto = Window.partitionBy(*row).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return values.withColumn("decoded", F.pmod(F.sum(value).over(upto), F.lit(256)).cast("long"))
