"""Slides as one table of images, whatever their format: a reader for each, and their union.

Columns of an image: path, reader, series (number in the slide's flat list), kind (level, label, macro), ifd_no, width, height,
tile_width, tile_height, compression, photometric, subsampling, tables, z_size, and what the slide says about itself. Where an image's
tiles lie comes from ``tiles_of``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import binary, metadata, tags
from lamella.functions.geometry import ets_level_size
from lamella.operators import series as s
from lamella.operators.directories import split_series
from lamella.sources import containers

# Tag from which private tags begin that may hold text, and the start of an Aperio description.
PRIVATE_TEXT, APERIO = 65000, "Aperio Image"
#: Names of compressions as the gate knows them, by code.
COMPRESSIONS = {code: name for code, name in tags.NAMES["Compression"].items()}


def is_svs(path: Column, description: Column) -> Column:
    """By the name's end, or by how the first directory's description begins."""
    return (F.lower(F.right(path, F.lit(4))) == ".svs") | F.coalesce(description.startswith(APERIO), F.lit(False))


def compression_name(code: Column) -> Column:
    return reduce(lambda out, item: F.when(code == item[0], item[1]).otherwise(out), COMPRESSIONS.items(), F.concat(F.lit("code "), code.cast("string")))


def _first(dirs: DataFrame) -> DataFrame:
    dirs = dirs if "planar" in dirs.columns else dirs.withColumn("planar", F.lit(1).cast("long"))
    return dirs.select("*", (F.row_number().over(Window.partitionBy("path").orderBy("ifd_no")) - 1).alias("i"), binary.pixel_type(F.col("bits"), F.col("sample_format")).alias("pixel_type"))


IMAGE = ("ifd_no", "width", "height", "tile_width", "tile_height", "compression", "photometric", "subsampling", "tables", "samples", "planar")


def svs_images(dirs: DataFrame) -> DataFrame:
    """Images of Aperio slides from their ``directories``.

    Label and macro image are set apart; of the others, those with another pixel type than the first are left out; comments tell the
    focal positions, which share the rest out to resolutions. A slide has its resolutions first, then label and macro."""
    images = s.classify(_first(containers.main_directories(dirs)), "path", "i", "description")
    pairs = metadata.comment_pairs(images.filter("description is not null"), "description", ["path", "i"])
    # a depth counts as position 0 unless an offset comes after it
    z = F.when(F.col("key") == "OffsetZ", F.col("value").try_cast("double")).when(F.col("key") == "TotalDepth", F.lit(0.0))
    at = F.when(F.col("key").isin("OffsetZ", "TotalDepth"), F.col("pos"))
    spots = pairs.groupBy("path", "i").agg(F.max_by(z, at).alias("z")).filter("z is not null")
    z_sizes = spots.groupBy("path").agg(F.count_distinct("z").alias("z_size"))
    levels = images.filter("kind = 'level'")
    first = levels.groupBy("path").agg(F.min_by("pixel_type", "i").alias("_type"))
    levels = levels.join(first, "path").filter(F.col("pixel_type").eqNullSafe(F.col("_type")) | (F.col("i") == 0)).drop("_type")
    kept = levels.unionByName(images.filter("kind <> 'level'"))
    of = Window.partitionBy("path")
    kept = kept.withColumn("at", F.row_number().over(of.orderBy("i")) - 1).withColumn("_extra", F.sum((F.col("kind") != "level").cast("int")).over(of))
    kept = kept.join(z_sizes, "path", "left").withColumn("z_size", F.coalesce("z_size", F.lit(1)))
    n = F.count("*").over(of) - F.col("_extra")
    kept = kept.withColumn("levels", F.floor(n / F.col("z_size")).cast("long"))
    cores = kept.groupBy("path").agg(F.max("levels").alias("levels"), F.max("_extra").alias("_extra"), F.max("z_size").alias("z_size"))
    cores = cores.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("levels") + F.col("_extra") - 1)).alias("series"))
    cores = cores.withColumn("at", s.directory_of(F.col("series"), F.lit(0), F.col("levels"), F.col("z_size")))
    planes = F.when(F.col("series") < F.col("levels"), F.col("z_size")).otherwise(1)
    found = cores.select("path", "series", "at", planes.cast("long").alias("z_size")).join(kept.select("path", "at", "kind", "pixel_type", *IMAGE), ["path", "at"])
    said = metadata.aperio_fields(pairs.filter("i = 0").drop("i"), ["path"])
    return found.drop("at").join(said, "path", "left").withColumn("reader", F.lit("svs"))


def _tiff_planes(dirs: DataFrame) -> DataFrame:
    """Directories of plain TIFF files that hold planes, with series, plane, planes (of the series) and n (of the file): those with a width, without
    reduced ones unless there is nothing else. If all are of one size and pixel type, they are planes of one series, else each is a series."""
    images = s.thumbnails(_first(containers.main_directories(dirs)), "path", "subfile_type").filter(~F.col("is_thumbnail"))
    images = images.join(split_series(images, "path").hint("merge"), "path")  # a row for each file, too many to broadcast
    number = (F.row_number().over(Window.partitionBy("path").orderBy("ifd_no")) - 1).cast("long")
    images = images.withColumns({"_no": number, "n": F.count("*").over(Window.partitionBy("path"))})
    of = lambda apart, whole: F.when(F.col("separate"), apart).otherwise(whole).cast("long")
    return images.withColumns({"series": of(F.col("_no"), F.lit(0)), "plane": of(F.lit(0), F.col("_no")), "planes": of(F.lit(1), F.col("n"))}).drop("_no")


def tiff_planes(dirs: DataFrame) -> DataFrame:
    """path, series, plane, ifd_no: the directory of each plane of plain TIFF files."""
    return _tiff_planes(dirs).select("path", "series", "plane", "ifd_no")


def tiff_images(dirs: DataFrame) -> DataFrame:
    """Images of plain TIFF files: a row for each series, with the directory of its first plane and the number of planes. An ImageJ comment is
    that of the first directory, or else of the last."""
    images = _tiff_planes(dirs)
    of = Window.partitionBy("path")
    said = lambda at: F.min_by("description", F.struct(at, "ifd_no")).over(of)
    is_imagej = lambda c: F.coalesce(c.startswith("ImageJ="), F.lit(False))
    images = images.withColumns({"_first": said(F.col("ifd_no")), "_last": said(-F.col("ifd_no"))})
    comment = F.when(~is_imagej(F.col("_first")) & is_imagej(F.col("_last")), F.col("_last")).otherwise(F.col("_first"))
    fields = metadata.imagej_fields(comment, F.col("n"), F.col("samples") > 1, F.col("samples"))
    one = F.lit(1).cast("long")
    flat = images.filter("plane = 0").select("path", "series", F.lit("level").alias("kind"), "pixel_type", *IMAGE, one.alias("z_size"), "planes", fields.alias("imagej"), F.col("description").alias("comment"))
    return flat.withColumn("reader", F.lit("tiff"))


def imagej_planes(dirs: DataFrame, lengths: DataFrame) -> DataFrame:
    """path, plane, offsets, byte_counts (of strips), size_z, size_c, size_t of all planes of files whose ImageJ comment tells of more images
    than there are directories, as where a file of over 4 GB lost those after the first. ``lengths``: path, length of the files.

    Such a file has one directory, isn't compressed, and holds its planes one after another behind the first; as many as its length has
    room for are there. All offsets follow from the first plane's, so nothing is read and nothing shuffled but the lengths."""
    c = F.col
    only = dirs.join(dirs.groupBy("path").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n"), "path").filter(F.coalesce("compression", F.lit(1)) == 1)
    fields = metadata.imagej_fields(c("description"), F.lit(1), F.lit(False), F.lit(1))
    d = only.select("*", fields.alias("_f")).join(lengths.select("path", "length"), "path").filter((c("_f.images") > 1) & (F.size("strip_offsets") > 0) & (F.size("strip_counts") > 0))
    plane_bytes = c("width") * c("height") * c("samples") * F.ceil(c("bits") / 8)
    total = F.aggregate("strip_counts", F.lit(0).cast("long"), lambda a, n: a + n)
    end = F.element_at("strip_offsets", -1) + F.element_at("strip_counts", -1)
    planes = F.floor((c("length") - end) / plane_bytes) + 1
    d = d.filter(plane_bytes > 0).withColumns({"_end": end, "_total": total, "_planes": planes}).filter("_planes > 0")
    before = F.transform("strip_counts", lambda n, j: F.aggregate(F.slice("strip_counts", 1, j), F.lit(0).cast("long"), lambda a, x: a + x))
    sizes = {n: F.coalesce(c(f"_f.{m}").cast("long"), F.lit(1).cast("long")) for n, m in (("z", "slices"), ("t", "frames"), ("c", "channels"))}
    d = d.withColumns({"_before": before, **{f"_{n}": x for n, x in sizes.items()}})
    whole, flat = c("_z") * c("_c") * c("_t") == c("_planes"), c("_z") * c("_t") == c("_planes")
    axes = [F.when(whole | flat, c("_z")).otherwise(c("_planes")).alias("size_z"), F.when(whole, c("_c")).otherwise(c("samples")).alias("size_c"), F.when(whole | flat, c("_t")).otherwise(1).cast("long").alias("size_t")]
    each = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), c("_planes") - 1)).alias("plane"))
    at = F.when(c("plane") == 0, c("strip_offsets")).otherwise(F.transform("_before", lambda x: c("_end") + (c("plane") - 1) * c("_total") + x))
    return each.select("path", "plane", at.alias("offsets"), F.col("strip_counts").alias("byte_counts"), *axes)


def private_text(entries: DataFrame) -> DataFrame:
    """path, key, value of what private tags of the first directory say: leaf elements of XML by name, other text by the tag's number.

    Text is in values of type BYTE with several members, a character each. Values of type UNDEFINED are taken too, which other readers leave."""
    text = F.decode(F.concat(*(F.coalesce("value_binary", F.lit(b"")),)), "UTF-8")
    shorts = F.array_join(F.transform("value_long", lambda x: F.char(x.bitwiseAND(255))), "")
    found = entries.filter((F.col("ifd_no") == 0) & (F.col("tag") >= PRIVATE_TEXT) & (F.col("count") > 1) & F.col("type").isin(1, 7))
    found = found.select("path", "entry_no", F.col("tag").cast("string").alias("tag"), F.rtrim(F.regexp_replace(F.when(F.col("type") == 1, shorts).otherwise(text), "\\x00", "")).alias("t"))
    leaf = r"<([A-Za-z][\w.:-]*)[^<>]*>([^<]*)</\1>"
    names, values = (F.regexp_extract_all("t", F.lit(leaf), F.lit(k)) for k in (1, 2))
    leaves = F.arrays_zip(names.alias("key"), values.alias("value"))
    plain = F.array(F.struct(F.col("tag").alias("key"), F.col("t").alias("value")))
    pairs = found.select("path", "entry_no", F.posexplode(F.when(F.col("t").contains("xml"), leaves).otherwise(plain)).alias("pos", "p"))
    return pairs.groupBy("path", F.col("p.key").alias("key")).agg(F.max_by("p.value", F.struct("entry_no", "pos")).alias("value"))


def _last(pyramid: str, coord: str) -> Column:
    """A chunk's resolution: its last coordinate, if the container has several."""
    return F.when(F.col(pyramid), F.element_at(coord, -1)).otherwise(0)


def vsi_images(slides: DataFrame, containers_found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Images of VSI slides (path) from their tile containers (path) and these ones' ``ets_chunks``: one series for each container and
    resolution. Sizes are what the tiles cover; a resolution halves the one above, held by its own tiles. Tiles are whole JPEGs."""
    found, _ = containers.pair_containers(slides, containers_found)
    one = chunks.select(F.col("path").alias("container"), "coord", "tile_x", "tile_y", "compression", _last("pyramid", "coord").alias("res"))
    most = [F.max(F.element_at("coord", k)).alias(f"max_{n}") for k, n in ((1, "x"), (2, "y"))]
    sizes = one.groupBy("container", "res").agg(*most, F.max("tile_x").alias("tile_width"), F.max("tile_y").alias("tile_height"), F.max("compression").alias("_code"))
    rows = F.array_sort(F.collect_list(F.struct("res", "max_x", "max_y"))).alias("r")
    tall = sizes.groupBy("container").agg(rows, *(F.max(c).alias(c) for c in ("tile_width", "tile_height", "_code")))

    def level_sizes(axis: str, tile: str) -> Column:
        whole = lambda x: ((x[f"max_{axis}"] + 1) * F.col(tile)).cast("long")
        add = lambda got, x: F.concat(got, F.array(ets_level_size(F.element_at(got, -1), whole(x))))
        return F.aggregate(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), F.array(whole(F.element_at("r", 1))), add)

    tall = tall.withColumns({"width": level_sizes("x", "tile_width"), "height": level_sizes("y", "tile_height")})
    flat = tall.select("container", "tile_width", "tile_height", "_code", F.explode(F.arrays_zip("width", "height", F.col("r.res").alias("resolution"))).alias("_s"))
    flat = flat.select("container", *(F.col(c).cast("long").alias(c) for c in ("tile_width", "tile_height")), "_code", "_s.*").join(found, "container").withColumnRenamed("slide", "path")
    series = (F.row_number().over(Window.partitionBy("path").orderBy("number", "resolution")) - 1).cast("long").alias("series")
    # code 2 is JPEG; its name is left open, as the readers have it, and the gate takes it without promise
    name = F.when(F.col("_code") != 2, F.concat(F.lit("container code "), F.col("_code").cast("string")))
    return flat.select("*", series, F.lit("level").alias("kind"), F.lit(1).cast("long").alias("z_size"), name.alias("compression_name"), F.lit("vsi").alias("reader")).drop("_code", "number")


def images(listed: DataFrame, dirs: DataFrame, containers_found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One table of the images of all ``listed`` slides (path, reader): the union of what the readers make of the files' ``directories``
    and of the tile containers."""
    named = lambda df: df.withColumn("compression_name", compression_name(F.col("compression")))
    of = lambda r: listed.filter(F.col("reader") == r).select("path")
    parts = [named(svs_images(dirs.join(of("svs"), "path"))), named(tiff_images(dirs.join(of("tiff"), "path"))), vsi_images(of("vsi"), containers_found, chunks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tiff_tiles(dirs: DataFrame, image: DataFrame) -> DataFrame:
    """path, tile_no, source, offset, n_bytes of each tile of the chosen images (path, ifd_no) of TIFF slides."""
    index = containers.tile_index(dirs.join(image.select("path", "ifd_no"), ["path", "ifd_no"]))
    return index.select("path", "tile_no", F.col("path").alias("source"), "offset", "n_bytes")


def vsi_tiles(chunks: DataFrame, image: DataFrame) -> DataFrame:
    """As ``tiff_tiles``, from containers: the first chunk at each place of the chosen resolution, the other axes at 0."""
    across = F.ceil(F.col("width") / F.col("tile_width")).cast("long")
    others = F.slice("coord", F.lit(3), F.greatest(F.size("coord") - F.when(F.col("pyramid"), 3).otherwise(2), F.lit(0)))
    flat = chunks.filter(F.forall(others, lambda x: x == 0)).select(F.col("path").alias("container"), _last("pyramid", "coord").alias("resolution"), *(F.element_at("coord", k).alias(n) for k, n in ((1, "x"), (2, "y"))), "chunk_no", "offset", "n_bytes")
    first = flat.groupBy("container", "resolution", "x", "y").agg(*(F.min_by(c, "chunk_no").alias(c) for c in ("offset", "n_bytes")))
    found = first.join(image.select("path", "container", "resolution", across.alias("across")), ["container", "resolution"]).filter(F.col("x") < F.col("across"))
    tile_no = (F.col("y") * F.col("across") + F.col("x")).cast("long").alias("tile_no")
    return found.select("path", tile_no, F.col("container").alias("source"), "offset", F.col("n_bytes").cast("long").alias("n_bytes"))
