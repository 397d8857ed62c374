"""Blocks of an image, tiles or strips, in one index, and regions read from them by ranges of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.geometry import ceil_div, overlaps

LZW = 5


def _blocks(dirs: DataFrame) -> DataFrame:
    """``dirs`` with what their blocks have in common: _w and _rows (a whole block's size), _across, _down, _planes, _at and _counts (offsets and
    byte counts), _strips (it has strips)."""
    c = F.col
    tiled = c("tile_width").isNotNull() & (c("tile_width") > 0)
    rows = F.when(tiled, c("tile_height")).otherwise(F.least(F.coalesce("rows_per_strip", "height"), c("height")))
    d = dirs.withColumns({"_strips": ~tiled, "_w": F.when(tiled, c("tile_width")).otherwise(c("width")).cast("long"), "_rows": rows.cast("long")})
    d = d.withColumns({"_across": ceil_div(c("width"), F.nullif("_w", F.lit(0))), "_down": ceil_div(c("height"), F.nullif("_rows", F.lit(0))), "_planes": F.when(c("planar") == 2, c("samples")).otherwise(1).cast("long")})
    d = d.withColumns({"_at": F.when(tiled, F.coalesce("offsets", "strip_offsets")).otherwise(c("strip_offsets")), "_counts": F.when(tiled, F.coalesce("byte_counts", "strip_counts")).otherwise(c("strip_counts"))})
    # an even share of each plane where no counts are given; both double for LZW in uneven strips
    plane = c("width") * c("height") * ceil_div(c("bits"), 8) * c("samples")
    share = F.array_repeat(F.floor(plane / F.nullif(F.size("_at"), F.lit(0))), F.size("_at"))
    uneven = c("rows_per_strip").isNull() | (c("height") % F.least("rows_per_strip", "height") != 0)
    return d.withColumns({
        "_at": F.transform("_at", lambda x: F.when(x < 0, x + (1 << 32)).otherwise(x)),
        "_counts": F.transform(F.coalesce("_counts", share), lambda x: x * F.when((c("compression") == LZW) & uneven, 2).otherwise(1)),
    })


def block_errors(dirs: DataFrame) -> DataFrame:
    """path, ifd_no, error of directories whose blocks can't be read: none are told, a block has no size, or fewer offsets or byte counts
    than strips. (Tiles may be missing.)"""
    return _told(dirs).select("path", "ifd_no", "error").filter("error is not null")


def _told(dirs: DataFrame) -> DataFrame:
    """``_blocks`` with error, null where they can be read."""
    d = _blocks(dirs)
    strips = F.col("_down") * F.col("_planes")
    short = lambda name, col: F.when(F.col("_strips") & (F.size(col) < strips), F.concat(F.lit(f"{name}: "), F.size(col).cast("string"), F.lit(" of "), strips.cast("string"), F.lit(" strips")))
    sized = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("_w") > 0) & (F.col("_rows") > 0)
    error = F.when(~F.coalesce(sized, F.lit(False)), "a block has no size").when(F.col("_at").isNull(), "no offsets").otherwise(F.coalesce(short("offsets", "_at"), short("byte counts", "_counts")))
    return d.withColumn("error", error)


def _index(dirs: DataFrame, *also: str) -> DataFrame:
    """``block_index`` with the columns ``also`` of ``dirs``."""
    c = F.col
    d = _told(dirs).filter("error is null")
    each = d.select("path", "ifd_no", *also, "width", "height", "_w", "_rows", "_across", "_down", "_at", "_counts", F.explode(F.sequence(F.lit(0).cast("long"), c("_across") * c("_down") * c("_planes") - 1)).alias("block_no"))
    plane, within = F.floor(c("block_no") / (c("_across") * c("_down"))), c("block_no") % (c("_across") * c("_down"))
    each = each.withColumns({"plane": plane.cast("long"), "x": within % c("_across") * c("_w"), "y": F.floor(within / c("_across")) * c("_rows")})
    at = c("block_no").cast("int")
    return each.select(
        "path", "ifd_no", *also, "plane", "block_no", "x", "y", F.least(c("_w"), c("width") - c("x")).cast("long").alias("w"), F.least(c("_rows"), c("height") - c("y")).cast("long").alias("h"), c("_w").alias("block_w"),
        F.get("_at", at).alias("offset"), F.get("_counts", at).alias("n_bytes"),
    )


def block_index(dirs: DataFrame) -> DataFrame:
    """path, ifd_no, plane, block_no, x, y, w, h (what of the block lies in the image), block_w (samples in a stored row), offset, n_bytes of each
    block, tile or strip, of ``directories``; images whose blocks can't be read have none (``block_errors`` tells why).

    Separate planes follow one another in the arrays. Every place has a closed form, so nothing is shuffled."""
    return _index(dirs)


def region_ranges(index: DataFrame, images: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """path, ifd_no, plane, row (of the region), left (in the region), offset, n_bytes: where in the file the samples of a region lie, a row for each row of each
    block that it meets; ``images`` (path, ifd_no) that aren't compressed, with bits, samples and planar.

    Only what the region needs is asked for. Rows beyond what the file has of a block are left out."""
    return _ranges(index.join(images.select("path", "ifd_no", "bits", "samples", "planar"), ["path", "ifd_no"]), x, y, w, h)


def _ranges(index: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """``region_ranges`` of blocks that have bits, samples and planar of their images."""
    c = F.col
    sample = ceil_div(c("bits"), 8) * F.when(c("planar") == 2, 1).otherwise(c("samples"))
    met = index.filter(overlaps(c("x"), c("y"), c("w"), c("h"), x, y, w, h)).withColumn("_b", sample.cast("long"))
    top, bottom = F.greatest(c("y"), F.lit(y)), F.least(c("y") + c("h"), F.lit(y + h))
    left, right = F.greatest(c("x"), F.lit(x)), F.least(c("x") + c("w"), F.lit(x + w))
    rows = met.select("*", F.explode(F.sequence(top, bottom - 1)).alias("_y"), left.alias("_l"), right.alias("_r"))
    begin, n = ((c("_y") - c("y")) * c("block_w") + c("_l") - c("x")) * c("_b"), (c("_r") - c("_l")) * c("_b")
    held = rows.filter((begin + n <= c("n_bytes")) & c("offset").isNotNull())
    return held.select("path", "ifd_no", "plane", (c("_y") - y).cast("long").alias("row"), (c("_l") - x).cast("long").alias("left"), (c("offset") + begin).cast("long").alias("offset"), n.cast("long").alias("n_bytes"))


def region_rows(parts: DataFrame, value: str = "bytes") -> DataFrame:
    """path, ifd_no, plane, row, bytes: each row of a region, its parts from left to right. A part without bytes makes the row null."""
    joined = F.reduce(F.transform(F.array_sort(F.collect_list(F.struct("left", value))), lambda p: p[value]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return parts.groupBy("path", "ifd_no", "plane", "row").agg(joined.alias("bytes"))


def region(dirs: DataFrame, x: int, y: int, w: int, h: int, fetch) -> DataFrame:
    """``region_rows`` of a region of all images of ``dirs`` that aren't compressed; ``fetch`` reads ranges of files (``containers.fetch``). Blocks
    carry what their images have, so no table of images is joined."""
    plain = dirs.filter(F.coalesce("compression", F.lit(1)) == 1)
    return region_rows(fetch(_ranges(_index(plain, "bits", "samples", "planar"), x, y, w, h)))
