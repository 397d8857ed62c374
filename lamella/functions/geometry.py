"""Sizes of pyramid levels and tiles, all in integers but for the number of levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(a: Column, b: Column | int) -> Column:
    """Quotient of integers without its fraction, towards zero."""
    return F.call_function("div", a.cast("long"), (F.lit(b) if isinstance(b, int) else b).cast("long"))


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return whole(a + b - 1, b)


def depth(width: Column, height: Column, tile_width: Column | int) -> Column:
    """Number of levels: whole powers of two between the tile's width and the image's longer side, and two more."""
    tile = F.lit(tile_width) if isinstance(tile_width, int) else tile_width
    two = F.log(F.lit(2.0))
    return (F.ceil(F.log(F.greatest(width, height).cast("double")) / two) - F.ceil(F.log(tile.cast("double")) / two) + 2).cast("long")


def level_size(size: Column, level: Column) -> Column:
    """Halving with halves rounded up, ``level`` times over, in one step."""
    return ceil_div(size, F.pow(F.lit(2.0), level).cast("long"))


def half(a: Column, b: Column) -> Column:
    """Mean of two samples, halves rounded up."""
    return whole(a + b + 1, 2)


def half_scale(nw: Column, ne: Column, sw: Column, se: Column) -> Column:
    """One sample of an image at half its scale: columns first, then the two means."""
    return half(half(nw, sw), half(ne, se))


def ets_level_size(size: Column, extent: Column) -> Column:
    """Next level's size in a tile container: half, one more if the size is odd and that stays within ``extent``; never above it."""
    h = whole(size, 2)
    return F.when((size % 2 == 1) & (h < extent), h + 1).otherwise(F.least(h, extent))


def overlaps(x: Column, y: Column, w: Column, h: Column, x2: int, y2: int, w2: int, h2: int) -> Column:
    return (x < x2 + w2) & (F.lit(x2) < x + w) & (y < y2 + h2) & (F.lit(y2) < y + h)


def plane_coordinates(index: Column, order: str, z: Column, c: Column, t: Column) -> dict[str, Column]:
    """z, c and t of a plane's number, the axes varying in the order of the letters after XY (say XYCZT); zero lengths count as one."""
    length = {"Z": F.greatest(z, F.lit(1)), "C": F.greatest(c, F.lit(1)), "T": F.greatest(t, F.lit(1))}
    out, left = {}, index
    for axis in order[2:]:
        out[axis.lower()] = left % length[axis]
        left = whole(left, length[axis])
    return out


def plane_index(order: str, z: Column, c: Column, t: Column, size_z: Column, size_c: Column, size_t: Column) -> Column:
    at, length = {"Z": z, "C": c, "T": t}, {"Z": size_z, "C": size_c, "T": size_t}
    first, second, third = order[2:]
    return at[first] + length[first] * (at[second] + length[second] * at[third])


def tile_or(size: Column, fallback: Column) -> Column:
    """A tile's size, or what stands in for one that is missing or zero."""
    return F.coalesce(F.nullif(size, F.lit(0)), fallback)


def optimal_tile_height(tile_height: Column, tile_width: Column, height: Column, row_bytes: Column) -> Column:
    """Rows to read at a time: the tile's or the image's, unless that is a single row or over 10 Mi pixels; then about 1 MiB of rows."""
    tall = F.when(F.coalesce(tile_height, F.lit(0)) <= 0, height).otherwise(tile_height)
    few = F.greatest(F.lit(1), F.least(height, whole(F.lit(1 << 20), F.greatest(F.lit(1), row_bytes))))
    return F.when((tall.cast("long") * tile_width > 10 * 1024 * 1024) | (tall <= 1), few).otherwise(tall).cast("long")


def thumbnail(width: Column, height: Column, box: int = 128) -> tuple[Column, Column]:
    """Size of a thumbnail: the longer side is ``box``, the other keeps the proportion; smaller images stay."""
    wide, small = width > height, (width <= box) & (height <= box)
    w = F.when(small, width).when(wide, box).otherwise(F.greatest(F.lit(1), whole(width * box, height)))
    h = F.when(small, height).when(wide, F.greatest(F.lit(1), whole(height * box, width))).otherwise(F.lit(box))
    return w, h


def rgb_channels(size_c: Column, image_count: Column, size_z: Column, size_t: Column) -> tuple[Column, Column]:
    """(planes' channels, samples of a plane): images over z and t, and channels over that; 0 where a length is 0."""
    planes = F.when(size_z * size_t == 0, 0).otherwise(whole(image_count, F.greatest(size_z * size_t, F.lit(1))))
    return planes, F.when(planes == 0, 0).otherwise(whole(size_c, F.greatest(planes, F.lit(1))))


def rotation(angle: Column) -> Column:
    """Matrix of a rotation by an angle in radians."""
    return F.struct(F.cos(angle).alias("a00"), (-F.sin(angle)).alias("a01"), F.sin(angle).alias("a10"), F.cos(angle).alias("a11"))
