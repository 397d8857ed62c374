"""What a folder run does with each file, as a DataFrame: filters, destinations, actions, validation and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions of slides.
EXTENSIONS = (".tif", ".svs", ".vsi")
#: Longest side of an output's smallest image.
SMALLEST = 1024


@dataclass(frozen=True)
class Parameters:
    """Settings of a run."""

    src: str
    dest: str
    filter: str | None = None
    overwrite: bool = False
    retry: bool = False
    validate: bool = False
    validateonly: bool = False
    quality: float = 1.0
    series: tuple[int, ...] = ()
    tile: int = 512


def suffix(path: Column) -> Column:
    return F.lower(F.right(path, F.lit(4)))


def wanted(files: DataFrame, path: str, part: str | None = None) -> DataFrame:
    """Files whose path ends with a slide's extension, in any case, and holds ``part``, in this case."""
    out = files.filter(suffix(F.col(path)).isin(*EXTENSIONS))
    return out.filter(F.col(path).contains(part)) if part else out


def reader(path: Column) -> Column:
    """Format by the last four characters; null for others, which a report tells."""
    return F.when(suffix(path) == ".tif", "tiff").when(suffix(path) == ".svs", "svs").when(suffix(path) == ".vsi", "vsi")


def destinations(files: DataFrame, path: str, root: str, dest: str) -> DataFrame:
    """``files`` with dest (the path below ``root``, its last four characters replaced by .tif, below ``dest``) and collides: another file has it too."""
    below = F.substring(F.col(path), F.lit(len(root.rstrip("/")) + 2), F.length(path))
    out = files.withColumn("dest", F.concat(F.lit(dest.rstrip("/") + "/"), F.substring(below, F.lit(1), F.length(below) - 4), F.lit(".tif")))
    return out.withColumn("collides", F.count("*").over(Window.partitionBy("dest")) > 1)


def series_destinations(files: DataFrame, path: str, series: tuple[int, ...], dest: str) -> DataFrame:
    """``files`` with series and dest, for single slides that go to a folder: the name's base and .tif for the widest image (series is null),
    or one file for each asked series, its number in the name."""
    base = F.regexp_extract(path, r"([^/]*)[^/]{4}$", 1)
    asked = files.withColumn("series", F.explode(F.array(*map(F.lit, series))) if series else F.lit(None).cast("int"))
    end = F.when(F.col("series").isNull(), F.lit(".tif")).otherwise(F.concat(F.lit("-series-"), F.col("series").cast("string"), F.lit(".tif")))
    return asked.withColumn("dest", F.concat(F.lit(dest.rstrip("/") + "/"), base, end))


def actions(exists: Column, valid: Column, overwrite: Column, retry: Column, validate: Column, validateonly: Column) -> dict[str, Column]:
    """delete, convert and validate for a destination in a folder run.

    An existing file goes if overwriting, or if retrying and it isn't valid. A file that isn't there (any more) is made, unless
    only validation is asked for. One that is there afterwards is validated if either flag asks for it; without overwrite and retry
    an existing file is validated only by ``validate``."""
    delete = exists & (overwrite | (retry & ~valid))
    convert = (~exists | delete) & ~validateonly
    stays = exists & ~delete
    return {"delete_first": delete, "convert": convert, "validate_after": (convert & validate) | (stays & F.when(retry, validate | validateonly).otherwise(validate))}


def compression_gate(compression: Column) -> tuple[Column, Column]:
    """(accepted, note): JPEG is taken; an unknown compression is taken as JPEG without promise; others are turned away, as a row, not by ending the run."""
    return compression.isNull() | (compression == "JPEG"), F.when(compression.isNull(), "compression not known, taken as JPEG").when(compression != "JPEG", F.concat(F.lit("compression not handled: "), compression))


def valid_outputs(images: DataFrame, file: str, number: str, width: str, height: str) -> DataFrame:
    """file, valid: the first image has a size, and the last one has one of at most ``SMALLEST`` on both sides. What lies between isn't looked at;
    an unknown size isn't valid, zero is for the last one."""
    size = F.struct(F.col(width).alias("w"), F.col(height).alias("h"))
    ends = images.groupBy(file).agg(F.min_by(size, number).alias("_f"), F.max_by(size, number).alias("_l"))
    first = (F.col("_f.w") != 0) & (F.col("_f.h") != 0)
    last = (F.col("_l.w") <= SMALLEST) & (F.col("_l.h") <= SMALLEST)
    return ends.select(file, F.coalesce(first & last, F.lit(False)).alias("valid"))


def photometric(kind: Column, subsampling: Column, source: Column) -> tuple[Column, Column]:
    """(photometric, subsampling) of level 0. VSI: YCbCr (6), 1:1. SVS: none given, YCbCr and 1:1; 2:2, the source's photometric; any other is copied without a photometric."""
    one, is_two = F.array(F.lit(1), F.lit(1)), subsampling == F.array(F.lit(2), F.lit(2))
    photo = F.when(kind == "vsi", 6).when(kind == "svs", F.when(subsampling.isNull(), 6).when(is_two, source))
    return photo, F.when((kind == "vsi") | subsampling.isNull(), one).when(~is_two, subsampling)


def plan(files: DataFrame, existing: DataFrame, settings: Parameters, path: str = "path", of: tuple[str, ...] = ()) -> DataFrame:
    """The run report before the run: path, dest, reader, collides, exists, delete_first, convert, validate_after. ``existing`` (dest, valid) lists
    outputs that are there; one that is listed more than once is valid if all its rows say so. With ``of``, columns that both have, an output is
    there only for the file that it was made of, not for others that would go to the same place."""
    jobs = destinations(wanted(files, path, settings.filter), path, settings.src, settings.dest).withColumn("reader", reader(F.col(path)))
    there = existing.groupBy("dest", *of).agg(F.bool_and("valid").alias("valid"), F.lit(True).alias("exists"))
    jobs = jobs.join(there, ["dest", *of], "left")
    jobs = jobs.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("exists", "valid")})
    flags = {k: F.lit(getattr(settings, k)) for k in ("overwrite", "retry", "validate", "validateonly")}
    return jobs.select(path, "dest", "reader", "collides", "exists", *(c.alias(k) for k, c in actions(F.col("exists"), F.col("valid"), **flags).items()))
