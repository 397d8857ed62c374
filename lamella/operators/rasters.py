"""Half-scale levels of tiles of raw samples: whole blocks of tiles are arrays in one Arrow pass, so a tile is a row, not its pixels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.geometry import ceil_div, level_size

#: Levels made in one pass: a group is then 4 ** STEP tiles at most.
STEP = 3
#: Longest side of the smallest level.
SMALLEST = 1024


def halved(a: np.ndarray) -> np.ndarray:
    """Each two by two samples as one: both columns' means, rounded up, then their mean, rounded up."""
    a = a.astype(np.uint16)
    left, right = (a[0::2, 0::2] + a[1::2, 0::2] + 1) >> 1, (a[0::2, 1::2] + a[1::2, 1::2] + 1) >> 1
    return ((left + right + 1) >> 1).astype(np.uint8)


def _levels_of(side: int, samples: int, levels: int, fill: int):
    """All levels above the tiles of one block."""

    def run(table: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], np.ndarray] = {}
        for x, y, raw in zip(*(table.column(c).to_pylist() for c in ("tile_x", "tile_y", "raster")), strict=True):
            if (x, y) not in found and raw is not None:
                tile = np.full(side * side * samples, fill, np.uint8)
                tile[: len(raw)] = np.frombuffer(raw, np.uint8)[: len(tile)]
                found[x, y] = tile.reshape(side, side, samples)
        rows = []
        for level in range(1, levels + 1):
            above: dict[tuple[int, int], np.ndarray] = {}
            for (x, y), tile in found.items():
                whole = above.setdefault((x // 2, y // 2), np.full((2 * side, 2 * side, samples), fill, np.uint8))
                whole[y % 2 * side : (y % 2 + 1) * side, x % 2 * side : (x % 2 + 1) * side] = tile
            found = {at: halved(whole) for at, whole in above.items()}
            rows += [(level, x, y, tile.tobytes()) for (x, y), tile in sorted(found.items())]
        slide = table.column("slide")[0].as_py()
        columns = {"slide": pa.array([slide] * len(rows), table.schema.field("slide").type)}
        columns |= {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("up", pa.int32()), ("tile_x", pa.int64()), ("tile_y", pa.int64()), ("raster", pa.binary())))}
        return pa.table(columns)

    return run


def levels(tiles: DataFrame, n: int, side: int, samples: int = 1, fill: int = 0) -> DataFrame:
    """slide, level, tile_x, tile_y, raster of levels 1 to ``n`` above ``tiles`` (slide, tile_x, tile_y, raster: side * side * samples bytes, rows first).

    Four tiles of a level are one of the next, of the same size, at half scale; absent ones are ``fill``, as padding is black. Of tiles at one place,
    one counts. Tiles are dealt once for every ``STEP`` levels, by the block of tiles that one tile of the last of these comes from, which is a bounded group;
    the next pass starts with a 64th of them."""
    kind = dict(tiles.dtypes)["slide"]
    given, out = tiles.select("slide", F.col("tile_x").cast("long"), F.col("tile_y").cast("long"), "raster"), []
    for start in range(0, n, STEP):
        step = min(STEP, n - start)
        block = [F.shiftright(c, step) for c in ("tile_x", "tile_y")]
        made = given.groupBy("slide", block[0].alias("bx"), block[1].alias("by")).applyInArrow(_levels_of(side, samples, step, fill), f"slide {kind}, up int, tile_x long, tile_y long, raster binary")
        out.append(made.select("slide", (F.col("up") + start).alias("level"), "tile_x", "tile_y", "raster"))
        given = made.filter(F.col("up") == step).select("slide", "tile_x", "tile_y", "raster")
    return reduce(lambda a, b: a.unionByName(b), out)


def depth_below(width: Column, height: Column, smallest: int = SMALLEST) -> Column:
    """How many halvings, rounded up, bring both sides to ``smallest`` at most."""
    longest = F.greatest(width, height).cast("long")
    return F.when(longest <= smallest, 0).otherwise(F.ceil(F.log2(longest / smallest))).cast("int")


def lower(tiles: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lower levels of raw tiles (three interleaved samples of 8 bits), in the form that ``convert`` takes: tiles (slide, level, tile_no, bytes) and
    images, down to a level of ``SMALLEST`` on both sides. Images whose tiles aren't square, of another size or compressed have none."""
    keep = images.filter("compression = 1 and tile = tile_height").withColumn("_depth", depth_below(F.col("width"), F.col("height"))).filter("_depth > 0")
    across = ceil_div(F.col("width"), F.col("tile")).cast("long")
    kinds = keep.select("tile", "_depth").groupBy("tile").agg(F.max("_depth").alias("n")).collect()  # one row for each size of tiles
    below = keep.select("*", F.explode(F.sequence(F.lit(1), "_depth")).alias("_level")).withColumns({"level": F.col("_level"), "_w": F.col("width"), "_h": F.col("height")})
    below = below.withColumns({"width": level_size(F.col("_w"), F.col("level")), "height": level_size(F.col("_h"), F.col("level")), "packet": F.lit(None).cast("string"), "subsampling": F.lit(None).cast("array<int>")})
    if not kinds:
        return tiles.limit(0), below.drop("_depth", "_level", "_w", "_h")
    placed = tiles.join(keep.select("slide", "tile", across.alias("_across")), "slide")
    placed = placed.select("slide", "tile", (F.col("tile_no") % F.col("_across")).alias("tile_x"), F.floor(F.col("tile_no") / F.col("_across")).alias("tile_y"), F.col("bytes").alias("raster"))
    made = reduce(lambda a, b: a.unionByName(b), (levels(placed.filter(F.col("tile") == k["tile"]).drop("tile"), k["n"], k["tile"], 3) for k in kinds))
    wide = below.select("slide", "level", ceil_div(F.col("width"), F.col("tile")).cast("long").alias("_across"), ceil_div(F.col("height"), F.col("tile")).cast("long").alias("_down"))
    made = made.join(wide, ["slide", "level"]).filter((F.col("tile_x") < F.col("_across")) & (F.col("tile_y") < F.col("_down")))
    made = made.select("slide", "level", (F.col("tile_y") * F.col("_across") + F.col("tile_x")).cast("long").alias("tile_no"), F.col("raster").alias("bytes"))
    return made, below.drop("_depth", "_level", "_w", "_h")


def _stepped(raw: bytes | None, width: int, samples: int, size: int, little: bool, forward: bool) -> bytes | None:
    if raw is None:
        return None
    kind = np.dtype(f"u{size}").newbyteorder("<" if little else ">")
    n = len(raw) // size
    held = np.zeros(-(-n // (width * samples)) * width * samples, kind.newbyteorder("="))
    held[:n] = np.frombuffer(raw, kind, n)
    rows = held.reshape(-1, width, samples)
    if forward:
        rows[:, 1:] -= rows[:, :-1].copy()
    else:
        rows = np.cumsum(rows, axis=1, dtype=rows.dtype)
    return rows.ravel()[:n].astype(kind).tobytes() + raw[n * size :]


def predicted(raster: Column, width: int, samples: int = 1, size: int = 1, little: bool = True, forward: bool = False) -> Column:
    """A raster's bytes with the horizontal predictor undone or, with ``forward``, applied: each sample is told by its difference from the same
    sample of the pixel to its left, modulo the sample's range. ``samples`` is 1 for separate planes; samples have ``size`` bytes (1, 2, 4 or 8).

    A last row may be cut short, and bytes behind the last whole sample stay. Null stays null. Whole rasters go by Arrow, a row each."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda raw: _stepped(raw, width, samples, size, little, forward), na_action=None)

    return run(raster)
