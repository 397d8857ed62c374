"""A folder of slides to pyramid files: plan, images, choice, tiles, layout, files, report. The first level's JPEG tiles pass through."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import binary, metadata
from lamella.functions.geometry import ceil_div
from lamella.operators import series as s
from lamella.plans import batch
from lamella.sources import bigtiff, containers, slides
from lamella.sources.steps import fixed

JPEG, RAW = 7, 1
#: Given the first level's tiles (slide, tile_no, bytes) and images, the lower levels' tiles (slide, level, tile_no, bytes) and images.
Lower = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path (without a scheme, if local) and length of the files below a folder; no contents are read."""
    return containers.scan(spark, folder, glob).select(containers.local_path(F.col("path")).alias("path"), "length")


def checked_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """dest, valid of the files that are below a folder of outputs, or of one file; a path or a URI. There may be none."""
    if not (containers.is_folder(folder) or containers.is_file(folder)):
        return spark.createDataFrame([], "dest string, valid boolean")
    files = listing(spark, folder, "*.tif").select("path")
    dirs = containers.directories(containers.tiff_entries(files, containers.TAGS))
    checked = batch.valid_outputs(dirs.select("path", "ifd_no", "width", "height"), "path", "ifd_no", "width", "height")
    return files.join(checked, "path", "left").select(F.col("path").alias("dest"), F.coalesce("valid", F.lit(False)).alias("valid"))


def refusal(collides: Column, raw: bool = False) -> Column:
    """Why a chosen image can't be converted, or null. With ``raw``, three interleaved samples of 8 bits, not compressed, are taken too."""
    accepted, note = batch.compression_gate(F.col("compression_name"))
    if raw:
        accepted = accepted | (F.coalesce(F.col("compression") == RAW, F.lit(False)) & F.coalesce((F.col("pixel_type") == "uint8") & (F.col("samples") == 3) & (F.col("planar") == 1), F.lit(False)))
    untiled = F.coalesce(F.col("tile_width"), F.lit(0)) == 0
    odd = F.col("tables").isNotNull() & ~F.coalesce(F.col("photometric").isin(2, 6), F.lit(False))
    text = F.concat(F.lit("photometric not handled: "), F.coalesce(F.col("photometric").cast("string"), F.lit("none")))
    return F.when(collides, "another slide has the same destination").when(F.col("series").isNull(), "no image found").when(~accepted, note).when(untiled, "the image has no tiles").when(odd, text)


def chosen_images(jobs: DataFrame, images: DataFrame, raw: bool = False, asked: int | None = None) -> DataFrame:
    """``jobs`` with the columns of the ``asked`` image of each slide, or of its widest (the first of equals; label and macro count, as width
    alone decides), and error; an image's columns are null where a slide has none."""
    best = s.largest_series(images, "path", "width", "series").select("path", F.col("flat_index").alias("series"))
    best = best if asked is None else images.filter(F.col("series") == asked).select("path", "series")
    return jobs.join(images.drop("reader").join(best, ["path", "series"]), "path", "left").withColumn("error", refusal(F.col("collides"), raw))


def first_level(chosen: DataFrame) -> DataFrame:
    """The images table of ``bigtiff.layout`` for the first level of each chosen image that has no error."""
    photometric, subsampling = batch.photometric(F.when(F.col("reader") == "vsi", "vsi").otherwise("svs"), F.col("subsampling").cast("array<int>"), F.col("photometric").cast("int"))
    is_raw = F.coalesce(F.col("compression") == RAW, F.lit(False))  # samples stay as they are
    photometric, subsampling = F.when(is_raw, F.col("photometric").cast("int")).otherwise(photometric), F.when(~is_raw, subsampling)
    resolution, _ = metadata.um_to_rational(F.col("um_per_pixel"))
    spacing = F.when(F.col("reader") == "vsi", metadata.packet_spacing(F.col("um_per_pixel"), "vsi")).otherwise(metadata.packet_spacing(F.col("um_per_pixel"), "svs"))
    spacing = metadata.plain_number(spacing)
    number = lambda x: metadata.plain_number(x.cast("decimal(38,10)"))
    fields = {"ObjectiveLensPower": number(F.col("magnification")), "Manufacturer": F.col("manufacturer"), "ManufacturerModelName": F.col("device"), "ExposureTime": metadata.plain_number(F.col("exposure_ms"))}
    subject = F.regexp_replace(F.md5("path"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return chosen.filter("error is null").select(
        "path", F.col("below").alias("slide"), F.lit(0).alias("level"), "width", "height", F.col("tile_width").cast("int").alias("tile"), F.col("tile_height").cast("int").alias("tile_height"), F.when(is_raw, RAW).otherwise(JPEG).alias("compression"),
        photometric.cast("int").alias("photometric"), subsampling.alias("subsampling"), resolution.alias("resolution"), bigtiff.packet(subject, fields, spacing, spacing).alias("packet"), "tables", F.col("photometric").alias("source_photometric"),
    )


def convert(spark: SparkSession, settings: batch.Parameters, lower: Lower | None = None, empty_tile: bytes | None = None, raw: bool = False) -> DataFrame:
    """Converts a folder, or one slide (see ``single_jobs``), and returns the report: path, dest, reader, status, error, n_bytes, seconds, valid, one row a slide.

    status is converted, failed, kept, deleted or skipped. A slide that can't be read, has an image that isn't tiled JPEG, misses a
    tile or can't be written is a failed row with its error; the others go on. Only directories and tiles are read, in ranges, so
    slides may be of any size. A tile that the file doesn't hold is ``empty_tile``, a whole JPEG, or an error without one.

    The first level's tiles are the slide's own, with their tables spliced in. ``lower`` makes the levels below; without it a file
    has one level (there is no JPEG codec here). With ``raw``, tiled images that aren't compressed are converted too, and
    ``rasters.lower`` makes their levels. ``src`` and ``dest`` are paths or URIs of stores that Spark and Arrow know. Bytes of the first level are read
    once, by the task that writes them; ``lower`` reads them once more."""
    dest = containers.plain_path(settings.dest).rstrip("/")
    settings = replace(settings, src=containers.plain_path(settings.src), dest=dest)
    how = {"lower": lower, "empty_tile": empty_tile, "raw": raw}
    files = listing(spark, settings.src)
    if containers.is_file(settings.src):
        reports = [_run(spark, files, job, target.rpartition("/")[0], target, asked=number, **how) for job, target, number in single_jobs(files, settings)]
        return reduce(lambda a, b: a.unionByName(b), reports)
    jobs = batch.plan(files, checked_outputs(spark, dest), settings)
    return _run(spark, files, jobs, dest, dest, **how)


def single_jobs(files: DataFrame, settings: batch.Parameters) -> list[tuple[DataFrame, str, int | None]]:
    """(job, output, series or none for the widest) for a source that is one file.

    A destination that is a folder, or isn't there and has no name of an output, takes a file named after the slide, or one for each of
    ``settings.series``. One that is a file is replaced, and may have one series. A file that isn't there yet gets the widest image, whatever series are asked for."""
    dest, asked = settings.dest, settings.series
    row = files.select("path", batch.reader(F.col("path")).alias("reader"), F.lit(False).alias("collides"))
    if containers.is_file(dest):
        if len(asked) > 1:
            raise ValueError("several series need a folder as destination")
        targets = [(dest, asked[0] if asked else None)]
    elif containers.is_folder(dest) or not dest.lower().endswith(".tif"):
        named = batch.series_destinations(files.select("path"), "path", asked, dest).select("dest", "series").collect()  # one row a series
        targets = [(r["dest"], r["series"]) for r in named]
    else:
        targets = [(dest, None)]
    flags = {"delete_first": F.lit(False), "convert": F.lit(True), "validate_after": F.lit(settings.validate)}
    return [(row.withColumns({"dest": F.lit(t), "exists": F.lit(containers.is_file(t)), **flags}), t, n) for t, n in targets]


def _run(spark: SparkSession, files: DataFrame, jobs: DataFrame, dest: str, checked_at: str, lower: Lower | None, empty_tile: bytes | None, raw: bool, asked: int | None = None) -> DataFrame:
    """The report of ``jobs``, whose outputs are below ``dest``; outputs are checked at ``checked_at``."""
    jobs = fixed(jobs.withColumn("below", F.substring("dest", F.lit(len(dest) + 2), F.length("dest"))))  # what is there now decides, not what this run makes
    todo = jobs.filter("convert")
    is_slide = todo.filter("reader <> 'vsi'").select("path")
    dirs = fixed(containers.directories(containers.tiff_entries(is_slide, containers.TAGS)))  # files are walked once
    found = containers.containers_of(todo.filter("reader = 'vsi'"))
    chunks = containers.ets_chunks(found)
    chosen = fixed(chosen_images(todo, slides.images(todo.select("path", "reader"), dirs, found, chunks), raw, asked))
    images = first_level(chosen)
    good = chosen.filter("error is null")
    index = slides.tiff_tiles(dirs, good.filter("reader <> 'vsi'")).unionByName(slides.vsi_tiles(chunks, good.filter("reader = 'vsi'")))
    # every place of the grid, whether the file has a tile there or not
    n_tiles = ceil_div(F.col("width"), F.col("tile_width")) * ceil_div(F.col("height"), F.col("tile_height"))
    places = good.select("path", F.explode(F.sequence(F.lit(0).cast("long"), n_tiles - 1)).alias("tile_no"))
    spots = places.join(index, ["path", "tile_no"], "left")
    lengths = files.select(F.col("path").alias("source"), "length").unionByName(found.select(F.col("path").alias("source"), "length"))
    there = (F.col("n_bytes") > 0) & (F.col("offset") >= 0) & (F.col("offset") + F.col("n_bytes") <= F.col("length"))
    spots = spots.join(lengths, "source", "left").withColumn("_there", F.coalesce(there, F.lit(False)))
    lead = binary.splice_lead(F.col("tables"), F.col("source_photometric")).alias("lead")
    refs = spots.join(images.select("path", "slide", lead), "path")
    held = {"source": F.col("source"), "source_offset": F.col("offset").cast("long"), "source_bytes": F.col("n_bytes").cast("long"), "lead": F.col("lead")}
    held = {n: F.when(F.col("_there"), c) for n, c in held.items()} | {"bytes": F.when(~F.col("_there"), F.lit(empty_tile).cast("binary"))}
    refs = fixed(refs.select("slide", F.lit(0).alias("level"), "tile_no", *(c.alias(n) for n, c in held.items())))
    images, made = images.drop("path", "tables", "source_photometric"), None
    if lower:
        more_tiles, more_images = lower(bigtiff.tile_bytes(refs), images)
        made, images = fixed(more_tiles), images.unionByName(more_images, allowMissingColumns=True)
    written = bigtiff.write_files(bigtiff.layout(bigtiff.references(refs), images, made), dest)
    written = fixed(written.select(F.col("path").alias("below"), "n_bytes", "seconds", F.col("error").alias("_error")))
    gone = bigtiff.remove_files(jobs.filter("delete_first and not convert").select(F.col("below").alias("path")), dest)
    gone = fixed(gone.select(F.col("path").alias("below"), "removed"))
    report = jobs.join(chosen.select("path", "error"), "path", "left").join(written, "below", "left").join(gone, "below", "left")
    report = report.withColumn("error", F.coalesce("error", "_error", F.when(F.col("convert") & F.col("n_bytes").isNull(), "nothing was written")))
    status = F.when(F.col("convert") & F.col("error").isNull(), "converted").when(F.col("convert"), "failed").when(F.col("removed"), "deleted").when(F.col("exists"), "kept").otherwise("skipped")
    checked = checked_outputs(spark, checked_at).withColumnRenamed("valid", "_valid")
    valid = F.when(F.col("validate_after"), F.coalesce("_valid", F.lit(False))).alias("valid")
    return report.join(checked, "dest", "left").select("path", "dest", "reader", status.alias("status"), "error", "n_bytes", "seconds", valid)
