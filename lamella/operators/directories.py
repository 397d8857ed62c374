"""Choices among a file's directories and lookups between its parts, by joins on offsets and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_entry(entries: DataFrame, tag: int, value: str, files: DataFrame | None = None) -> DataFrame:
    """path, value of each file's first entry of a tag: of the first directory that has it, its first. With ``files`` (path), one of them
    without such an entry is an error."""
    at = F.struct("ifd_no", "entry_no")
    found = entries.filter(F.col("tag") == tag).groupBy("path").agg(F.min_by(value, at).alias(value), F.lit(True).alias("_has"))
    if files is not None:
        missing = F.raise_error(F.concat(F.lit(f"no entry of tag {tag} in "), "path")).cast("boolean")
        found = files.select("path").join(found, "path", "left").filter(F.coalesce("_has", missing))
    return found.select("path", value)


def with_sub_directories(main: DataFrame, subs: DataFrame) -> DataFrame:
    """``main`` (path, ifd_no, offset, sub_offsets, ...) followed by the directories of ``subs`` (path, offset, ...) that it points to.

    pos numbers them: main ones first, then the others in the order of their main directories and of the pointers."""
    pointers = main.select("path", F.col("ifd_no").alias("_of"), F.posexplode("sub_offsets").alias("_k", "offset"))
    below = subs.join(pointers, ["path", "offset"]).withColumn("is_sub", F.lit(True))
    whole = main.drop("sub_offsets").withColumns({"_of": F.col("ifd_no"), "_k": F.lit(0), "is_sub": F.lit(False)}).unionByName(below, allowMissingColumns=True)
    return whole.withColumn("pos", F.row_number().over(Window.partitionBy("path").orderBy("is_sub", "_of", "_k")) - 1).drop("_of", "_k")


def smallest_usable(series: DataFrame, path: str, resolution: str, width: str, height: str) -> DataFrame:
    """Each file's smallest image with a size: what a thumbnail is read from."""
    area = F.struct((F.col(width) * F.col(height)).alias("a"), F.col(resolution).alias("r"))
    return series.filter((F.col(width) > 0) & (F.col(height) > 0)).groupBy(path).agg(F.min_by(F.struct(*series.columns), area).alias("_s")).select("_s.*")


def split_series(dirs: DataFrame, path: str) -> DataFrame:
    """path, separate: directories differ in size or pixel type, so each is a series of its own."""
    return dirs.groupBy(path).agg((F.count_distinct(F.struct("width", "height", "pixel_type")) > 1).alias("separate"))


def objective_of(images: DataFrame, objectives: DataFrame) -> DataFrame:
    """``images`` with the magnification of the objective they name; null if no instrument has it. The first of equal ids counts."""
    one = objectives.groupBy("path", "objective_id").agg(F.min_by("magnification", F.struct("instrument", "position")).alias("magnification"))
    return images.join(one, ["path", "objective_id"], "left")


def image_metadata(series: DataFrame) -> DataFrame:
    """One nested column of what a slide says about its image, from flat columns; missing ones are null."""
    have = set(series.columns)
    field = lambda n, kind: (F.col(n).cast(kind) if n in have else F.lit(None).cast(kind)).alias(n)
    return series.withColumn("image_meta", F.struct(field("acquired", "timestamp"), field("description", "string"), F.struct(field("um_x", "double"), field("um_y", "double")).alias("physical_size"), F.struct(field("objective_id", "string"), field("magnification", "decimal(18,6)")).alias("objective"), F.struct(field("first_name", "string"), field("last_name", "string")).alias("experimenter"), field("exposure_ms", "decimal(38,6)")))
