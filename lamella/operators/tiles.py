"""Tile grids, lookups and the layout of tiles in an output file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.geometry import ceil_div, depth, ets_level_size, level_size, overlaps
from lamella.sources.steps import tasks_for

#: Tiles of one task.
TASK_TILES = 500_000


def levels(slides: DataFrame, slide: str, width: str, height: str, tile: int) -> DataFrame:
    """slide, level, width, height, tiles_x, tiles_y, n_tiles of every level of each slide's pyramid.

    A level has half the tiles of the one above, rounded up; its size halves with halves rounded up. Both have closed forms, so
    each row stands alone and nothing is shuffled."""
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    out = slides.select(F.col(slide).alias("slide"), w.alias("_w"), h.alias("_h"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), depth(w, h, tile) - 1))).alias("level"))
    out = out.select("slide", "level", level_size(F.col("_w"), F.col("level")).alias("width"), level_size(F.col("_h"), F.col("level")).alias("height"), level_size(ceil_div(F.col("_w"), tile), F.col("level")).alias("tiles_x"), level_size(ceil_div(F.col("_h"), tile), F.col("level")).alias("tiles_y"))
    return out.withColumn("n_tiles", F.col("tiles_x") * F.col("tiles_y"))


def tile_tasks(slides: DataFrame, width: str, height: str, tile: int) -> int:
    """Number of tasks that make about ``TASK_TILES`` tiles each. Slides dealt to them by key need no shuffle of tiles for what is then grouped or
    ordered within a slide."""
    return tasks_for(slides, TASK_TILES, ceil_div(F.col(width).cast("long"), tile) * ceil_div(F.col(height).cast("long"), tile))


def grid(slides: DataFrame, slide: str, width: str, height: str, tile: int) -> DataFrame:
    """slide, tile_no, tile_x, tile_y, x, y, w, h of every full-size tile, rows first; edge tiles' w and h are what lies in the image."""
    out = slides.select(F.col(slide).alias("slide"), F.col(width).cast("long").alias("_w"), F.col(height).cast("long").alias("_h"))
    out = out.withColumn("tile_y", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(F.col("_h"), tile) - 1))).withColumn("tile_x", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(F.col("_w"), tile) - 1)))
    return out.select("slide", (F.col("tile_y") * ceil_div(F.col("_w"), tile) + F.col("tile_x")).alias("tile_no"), "tile_x", "tile_y", (F.col("tile_x") * tile).alias("x"), (F.col("tile_y") * tile).alias("y"), F.least(F.lit(tile), F.col("_w") - F.col("tile_x") * tile).cast("long").alias("w"), F.least(F.lit(tile), F.col("_h") - F.col("tile_y") * tile).cast("long").alias("h"))


def look_up(tiles: DataFrame, index: DataFrame, on: list[str], values: list[str], order: str, default: dict[str, object], tasks: int | None = None) -> DataFrame:
    """``tiles`` with the values of the first index entry at the same coordinates, or defaults and is_filler. A default is a constant (a black tile) or a
    column of ``tiles`` (its container's background).

    The index may be as large as the tiles, whatever the plan takes its size for, so it is never broadcast; both are dealt to ``tasks`` if told."""
    dealt = lambda df: df.repartition(tasks, *on) if tasks else df
    first = index.groupBy(*on).agg(F.lit(False).alias("is_filler"), *(F.min_by(v, order).alias(f"_{v}") for v in values))
    out = dealt(tiles).join(dealt(first).hint("merge"), on, "left")
    return out.select(*tiles.columns, F.coalesce("is_filler", F.lit(True)).alias("is_filler"), *(F.coalesce(f"_{v}", F.lit(default[v])).alias(v) for v in values))


def quadrants(tiles: DataFrame, slide: str, value: str, fill: int = 0) -> DataFrame:
    """Two by two tiles as one row: a grouped pass over half coordinates instead of three self-joins; absent neighbours are ``fill``."""
    qx, qy = F.floor(F.col("tile_x") / 2), F.floor(F.col("tile_y") / 2)
    parts = {"nw": (0, 0), "ne": (1, 0), "sw": (0, 1), "se": (1, 1)}
    return tiles.groupBy(F.col(slide), qx.alias("qx"), qy.alias("qy")).agg(*(F.coalesce(F.max(F.when((F.col("tile_x") % 2 == i) & (F.col("tile_y") % 2 == j), F.col(value))), F.lit(fill)).alias(p) for p, (i, j) in parts.items()))


def region_parts(tiles: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """slide, tile_no, and for each tile (x, y, w, h) that meets a region: where in the tile the common part begins (src_x, src_y), where
    in the region it goes (dst_x, dst_y), and its size (part_w, part_h)."""
    c, left, top = F.col, F.greatest(F.col("x"), F.lit(x)), F.greatest(F.col("y"), F.lit(y))
    right, bottom = F.least(c("x") + c("w"), F.lit(x + w)), F.least(c("y") + c("h"), F.lit(y + h))
    places = {"src_x": left - c("x"), "src_y": top - c("y"), "dst_x": left - x, "dst_y": top - y, "part_w": right - left, "part_h": bottom - top}
    return tiles.filter(overlaps(c("x"), c("y"), c("w"), c("h"), x, y, w, h)).select("slide", "tile_no", *(v.cast("long").alias(n) for n, v in places.items()))


def file_offsets(tiles: DataFrame, slide: str, order: list[str], size: str, header: int = 16) -> DataFrame:
    """``tiles`` with the byte offset of each in its file: the header and all before it. One window over a slide's tiles."""
    before = Window.partitionBy(slide).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", (F.lit(header) + F.coalesce(F.sum(size).over(before), F.lit(0))).cast("long"))


def extents(chunks: DataFrame, container: str, resolution: str, axes: list[str]) -> DataFrame:
    """Largest coordinate of each axis by container and resolution, with the number of chunks."""
    return chunks.groupBy(container, resolution).agg(*(F.max(a).alias(f"max_{a}") for a in axes), F.count("*").alias("n_chunks"))


def next_extent(extent_rows: DataFrame, size: str, tiles: str, tile: int) -> DataFrame:
    """``extent_rows`` with next_size: the size of the next resolution, held by the pixels that its tiles cover."""
    return extent_rows.withColumn("next_size", ets_level_size(F.col(size), (F.col(tiles) * tile).cast("long")))


def strip_counts(images: DataFrame, counts: str, plane_bytes: str, strips: str, lzw: str, rows_per_strip: str, height: str) -> DataFrame:
    """``images`` with byte_counts, one for each strip: the given counts, or even shares of the plane. Both are doubled for LZW if the
    rows of a strip aren't given or don't divide the height."""
    share = F.array_repeat((F.col(plane_bytes) / F.col(strips)).cast("long"), F.col(strips).cast("int"))
    uneven = F.col(rows_per_strip).isNull() | (F.col(height) % F.col(rows_per_strip) != 0)
    twice = F.when(F.col(lzw) & uneven, 2).otherwise(1)
    return images.withColumn("byte_counts", F.transform(F.coalesce(F.col(counts), share), lambda n: n * twice))


def plane_bytes(tiles: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``keys``, n_tiles, n_bytes: what each plane takes in the file."""
    return tiles.groupBy(*keys).agg(F.count("*").alias("n_tiles"), F.sum(size).cast("long").alias("n_bytes"))
