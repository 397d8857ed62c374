"""Slide files as DataFrames: a scan of files, directory entries of TIFF and BigTIFF, chunks of tile containers.

A directory chain is a chase of pointers, so a small generator walks each file inside a task; everything after that (choice of
directories, coercion, joins) is DataFrame work on its rows. Files are dealt to tasks by Spark's own scan. A listing without contents
is enough: then tasks read the few bytes they need from the file itself, so a slide may be larger than a value can be."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY_SCHEMA = "path string, ifd_no int, offset long, entry_no int, tag int, type int, count long, value_long array<long>, value_double array<double>, value_rational array<struct<num:long,den:long>>, value_string string, value_strings array<string>, value_binary binary"
#: Type: bytes and code of one value. A rational is two values.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "II"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Values that aren't read unless asked for: colour maps, and those of private tags (from the second number on) with so many members.
COLOR_MAP, PRIVATE, LARGE = 320, 32768, 10 * 1024 * 1024
#: Bytes of a sample by a container's pixel types; 64-bit integers aren't handled.
PIXEL_BYTES = {1: (1, 2), 2: (3, 4), 4: (5, 6, 9), 8: (10,)}
#: Bytes of a file whose ranges one task reads.
FETCH_BLOCK = 64 << 20
Read = Callable[[int, int], bytes]


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime, content of all files below a folder. Content is read only where a plan asks for it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)


def local_path(path: Column) -> Column:
    """A local file's path without its scheme; other URIs as they are."""
    return F.regexp_replace(path, "^file:(//)?/", "/")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store that holds a file and the file's name there, for any store that Arrow knows."""
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?/", "/", path)
    return fs.FileSystem.from_uri(path)


def plain_path(path: str) -> str:
    """A local file's path without its scheme; other URIs as they are."""
    return re.sub("^file:(//)?/", "/", path)


def is_folder(path: str) -> bool:
    store, name = _place(path)
    return store.get_file_info(name).type == fs.FileType.Directory


def is_file(path: str) -> bool:
    store, name = _place(path)
    return store.get_file_info(name).type == fs.FileType.File


def _opened(path: str):
    """A file that can be read at any place."""
    store, name = _place(path)
    return store.open_input_file(name)


def walk(read: Read, length: int, starts: list[int] | None = None, tags: frozenset[int] | None = None) -> Iterator[tuple]:
    """(ifd_no, ifd offset, entry_no, tag, type, count, raw value bytes, byte order) of a TIFF's chain, or of the directories at ``starts``.
    The chain ends at 0, past the end, or at an offset seen before; a directory of fewer than two entries gives no rows; arrays are cut
    at the end of the file. Values are None for tags outside ``tags`` and, without ``tags``, for colour maps and very large private ones."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or length < 8 or len(head) < 8:
        return
    magic = struct.unpack_from(order + "H", head, 2)[0]
    if magic not in (42, 43):
        return
    big = magic == 43
    size_code, slot, width, link = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
    size_bytes, seen, number = struct.calcsize(size_code), set(), 0
    todo = list(starts or [])
    at = todo.pop(0) if todo else (struct.unpack_from(order + link, head, 8 if big else 4)[0] if starts is None and len(head) >= (16 if big else 8) else 0)
    while at and at not in seen and at + size_bytes <= length:
        seen.add(at)
        n, start = struct.unpack(order + size_code, read(at, size_bytes))[0], at + size_bytes
        if start + n * slot > length:
            return
        table = read(start, n * slot + width)
        for k in range(n if n > 1 else 0):
            tag, kind = struct.unpack_from(order + "HH", table, k * slot)
            count = struct.unpack_from(order + ("Q" if big else "I"), table, k * slot + 4)[0]
            size = TYPES.get(kind, (1, "s"))[0] * count
            if (tag in tags) if tags is not None else not (tag == COLOR_MAP or (count >= LARGE and tag >= PRIVATE)):
                if size > width:
                    spot = struct.unpack_from(order + link, table, (k + 1) * slot - width)[0]
                    raw = read(spot, min(size, max(0, length - spot)))
                else:
                    raw = table[(k + 1) * slot - width : (k + 1) * slot - width + size]
            else:
                raw = None
            yield number, at, k, tag, kind, count, raw, order
        after = table[n * slot : n * slot + width]
        if starts is None:
            at = struct.unpack(order + link, after)[0] if len(after) == width else 0
        else:
            at = todo.pop(0) if todo else 0
        number += 1


def entries(data: bytes, **how) -> Iterator[tuple]:
    """``walk`` of a file that is at hand as bytes."""
    return walk(lambda at, n: data[at : at + n], len(data), **how)


_VALUES = ("value_long", "value_double", "value_rational", "value_string", "value_strings", "value_binary")
_TYPES = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.struct([("num", pa.int64()), ("den", pa.int64())])), pa.string(), pa.list_(pa.string()), pa.binary())


def _value(kind: int, count: int, raw: bytes, order: str) -> dict:
    """One value of BYTE keeps its sign, several don't; both kinds of rational are unsigned, as files in the field are read so. Text with
    several end marks is a list, and as one string its parts are lines."""
    size, code = TYPES.get(kind, (1, "s"))
    n = len(raw) // size
    if kind == 2:
        parts = [x.decode("utf-8", "replace") for x in (raw[:-1] if raw.endswith(b"\0") else raw).split(b"\0")]
        return {"value_string": "\n".join(x for x in parts if x), "value_strings": parts if len(parts) > 1 else None}
    if code == "s":
        return {"value_binary": raw}
    if code == "II":
        both = struct.unpack(f"{order}{2 * n}I", raw[: 8 * n])
        return {"value_rational": [{"num": a, "den": b} for a, b in zip(both[::2], both[1::2], strict=True)]}
    code = "b" if kind == 1 and count == 1 else code
    found = list(struct.unpack(f"{order}{n}{code}", raw[: size * n]))
    return {"value_double": found} if code in "fd" else {"value_long": [x - (1 << 64) if x >= 1 << 63 else x for x in found]}


def entry_batch(walks: Iterable[tuple[str, Iterator[tuple]]]) -> pa.RecordBatch:
    """One record batch of (path, walk) of files: entries go to columns, not to rows."""
    names = ("path", "ifd_no", "offset", "entry_no", "tag", "type", "count", *_VALUES)
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *_TYPES)
    out: dict[str, list] = {n: [] for n in names}
    for path, found in walks:
        for number, at, k, tag, kind, count, raw, order in found:
            value = {} if raw is None else _value(kind, count, raw, order)
            for name, x in zip(names, (path, number, at, k, tag, kind, count), strict=False):
                out[name].append(x)
            for name in _VALUES:
                out[name].append(value.get(name))
    return pa.RecordBatch.from_arrays([pa.array(out[n], kind) for n, kind in zip(names, kinds, strict=True)], list(names))


def _tiff_rows(tags: frozenset[int] | None):
    """One record batch for each batch of files."""

    def walked(path: str, at: list[int] | None) -> Iterator[tuple]:
        with _opened(path) as file:
            yield from walk(lambda spot, n: file.read_at(n, spot), file.size(), at, tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts").to_pylist() if "starts" in batch.schema.names else [None] * batch.num_rows
            paths = batch.column("path").to_pylist()
            if "content" in batch.schema.names:
                walks = ((p, entries(c.as_py() or b"", starts=at, tags=tags)) for p, c, at in zip(paths, batch.column("content"), starts, strict=True))
            else:
                walks = ((p, walked(p, at)) for p, at in zip(paths, starts, strict=True))
            yield entry_batch(walks)

    return run


def tiff_entries(files: DataFrame, tags: tuple[int, ...] | None = None) -> DataFrame:
    """A row for each directory entry of the TIFF and BigTIFF files in ``files``; other files give none.

    ``files`` has path and content, or path alone: then only directories and the values asked for are read from the files. With
    ``tags``, entries of other tags have no values. Where ``files`` has starts (an array of offsets), the directories there are read
    instead of the chain: sub directories, or those of EXIF data."""
    given = [c for c in ("path", "content", "starts") if c in files.columns]
    return files.select(*given).mapInArrow(_tiff_rows(None if tags is None else frozenset(tags)), ENTRY_SCHEMA)


def pointed_entries(files: DataFrame, dirs: DataFrame, pointer: str, tags: tuple[int, ...] | None = None) -> DataFrame:
    """Entries of the directories that the column ``pointer`` of ``dirs`` (path, a number or an array) points to."""
    spots = dirs.select("path", F.explode(F.col(pointer) if dict(dirs.dtypes)[pointer].startswith("array") else F.array(pointer)).alias("_at")).filter("_at is not null")
    starts = spots.groupBy("path").agg(F.array_sort(F.collect_set("_at")).alias("starts"))
    return tiff_entries(files.join(starts, "path"), tags)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, file = None, None
    for batch in batches:
        out = []
        for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "n_bytes")), strict=True):
            if name != path:
                if file is not None:
                    file.close()
                path, file = name, _opened(name)
            raw = file.read_at(n, at) if n and n > 0 and at is not None and 0 <= at < file.size() else b""
            out.append(raw if n and len(raw) == n else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])
    if file is not None:
        file.close()


def fetch(ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, offset, n_bytes, ...) with the bytes there, null where the file doesn't hold them all. A task reads the ranges of
    one stretch of a file in order, so a slide of any size is read by many tasks and no range twice."""
    stretch = F.floor(F.coalesce("offset", F.lit(0)) / FETCH_BLOCK)
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as rows are small and would be put together
    dealt = ranges.repartition(tasks, F.col("path"), stretch).sortWithinPartitions("path", "offset")
    schema = ", ".join(f"`{n}` {kind}" for n, kind in ranges.dtypes)
    return dealt.mapInArrow(_fetched, f"{schema}, bytes binary")


#: Tags whose values ``directories`` reads.
TAGS = (254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 322, 323, 324, 325, 330, 339, 347, 530, 700, 34665)


def directories(found: DataFrame) -> DataFrame:
    """One row a directory with the tags that planning needs (``TAGS``); a repeated tag's first entry counts."""
    first = lambda tag, col: F.min_by(F.when(F.col("tag") == tag, F.col(col)), F.when(F.col("tag") == tag, F.col("entry_no")))
    one = lambda tag, other=None: F.coalesce(F.element_at(first(tag, "value_long"), 1), F.lit(other))
    return found.groupBy("path", "ifd_no").agg(
        one(254, 0).alias("subfile_type"), one(256).alias("width"), one(257).alias("height"), one(258, 1).alias("bits"), one(259, 1).alias("compression"), one(262).alias("photometric"),
        first(270, "value_string").alias("description"), one(277, 1).alias("samples"), one(322).alias("tile_width"), one(323).alias("tile_height"), first(324, "value_long").alias("offsets"), first(325, "value_long").alias("byte_counts"),
        first(347, "value_binary").alias("tables"), first(530, "value_long").alias("subsampling"), first(700, "value_binary").alias("packet"),
        first(273, "value_long").alias("strip_offsets"), first(279, "value_long").alias("strip_counts"), first(330, "value_long").alias("sub_offsets"), one(34665).alias("exif_offset"), one(339, 1).alias("sample_format"), one(278).alias("rows_per_strip"), one(284, 1).alias("planar"),
    )


def main_directories(dirs: DataFrame) -> DataFrame:
    """Directories of images: those with a width."""
    return dirs.filter(F.col("width").isNotNull())


def tile_index(dirs: DataFrame) -> DataFrame:
    """path, ifd_no, tile_no, tile_x, tile_y, offset, n_bytes of each tile, from the directory's parallel arrays."""
    across = F.ceil(F.col("width") / F.col("tile_width")).cast("long")
    t = dirs.filter("offsets is not null").select("path", "ifd_no", across.alias("_a"), F.posexplode(F.arrays_zip("offsets", "byte_counts")).alias("tile_no", "_t"))
    return t.select("path", "ifd_no", F.col("tile_no").cast("long").alias("tile_no"), (F.col("tile_no") % F.col("_a")).alias("tile_x"), F.floor(F.col("tile_no") / F.col("_a")).alias("tile_y"), F.col("_t.offsets").alias("offset"), F.col("_t.byte_counts").alias("n_bytes"))


def little(content: Column, at: Column, size: int) -> Column:
    """An unsigned little-endian number of ``size`` bytes at a zero-based place."""
    digits = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    number = F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size)))), 16, 10)
    return number.cast("long") if size < 8 else number.cast("decimal(20,0)").cast("long")


def _ets_head(head: Column) -> dict[str, Column]:
    """Fields of the first 64 bytes of a tile container."""
    return {"dimensions": little(head, F.lit(12), 4).cast("int"), "extra": little(head, F.lit(16), 8), "table": little(head, F.lit(32), 8), "n_chunks": little(head, F.lit(40), 4).cast("int")}


def ets_extra(content: Column, at: Column) -> dict[str, Column]:
    """Fields of the second header, which begins at ``at``."""
    places = {"pixel_type": 8, "channels": 12, "compression": 20, "tile_x": 28, "tile_y": 32}
    fields = {n: little(content, at + k, 4).cast("int") for n, k in places.items()}
    size = reduce(lambda out, item: F.when(fields["pixel_type"].isin(*item[1]), item[0]).otherwise(out), PIXEL_BYTES.items(), F.lit(None).cast("int"))
    # of the 40 bytes kept for it, the colour takes one pixel's
    color = F.substring(content, (at + 109).cast("int"), F.least(F.lit(40), fields["channels"] * size))
    return fields | {"pyramid": little(content, at + 152, 4) != 0, "background": color}


def background_raster(color: Column, tile_x: Column, tile_y: Column) -> Column:
    """A tile of raw samples in one colour, a pixel's bytes over and over. Null without a colour."""
    return F.when(F.octet_length(color) > 0, F.unhex(F.repeat(F.hex(color), tile_x * tile_y)))


def background_tiles(files: DataFrame) -> DataFrame:
    """path, raster: what stands for a tile that a container doesn't hold, in the container's own background colour."""
    return ets_headers(files).select("path", background_raster(F.col("background"), F.col("tile_x"), F.col("tile_y")).alias("raster"))


def ets_headers(files: DataFrame) -> DataFrame:
    """path and the header fields of tile containers among ``files`` (path, and content or not); the fields have fixed places, so no
    generator is needed. _table has the bytes of the chunk table. Without content, the three parts are read from the files."""
    is_ets = lambda c: F.hex(F.substring(c, 1, 4)) == "53495300"
    if "content" in files.columns:
        out = files.filter(is_ets("content")).select("path", "content", *(c.alias(n) for n, c in _ets_head(F.col("content")).items()))
        out = out.select("*", *(c.alias(n) for n, c in ets_extra(F.col("content"), F.col("extra")).items()))
        table = F.substring(F.col("content"), (F.col("table") + 1).cast("int"), F.col("n_chunks") * (F.col("dimensions") * 4 + 20))
        return out.select("*", table.alias("_table")).drop("content", "extra")

    def read(df: DataFrame, at: Column, n: Column, out: str) -> DataFrame:
        return fetch(df.withColumns({"offset": at.cast("long"), "n_bytes": n.cast("long")})).withColumnRenamed("bytes", out).drop("offset", "n_bytes")

    out = read(files.select("path"), F.lit(0), F.lit(64), "_head").filter(is_ets("_head")).select("path", *(c.alias(n) for n, c in _ets_head(F.col("_head")).items()))
    out = read(out, F.col("extra"), F.lit(156), "_more").select("*", *(c.alias(n) for n, c in ets_extra(F.col("_more"), F.lit(0)).items())).drop("_more", "extra")
    return read(out, F.col("table"), F.col("n_chunks") * (F.col("dimensions") * 4 + 20), "_table")


def ets_chunks(files: DataFrame) -> DataFrame:
    """path, chunk_no, coord, offset, n_bytes of each chunk. Entries are of fixed width, so a sequence over their number cuts the table."""
    h = ets_headers(files)
    c, width = F.col("_table"), F.col("dimensions") * 4 + 20
    e = h.filter("n_chunks > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no")).withColumn("_at", F.col("chunk_no") * width + 4)
    coord = F.transform(F.sequence(F.lit(0), F.col("dimensions") - 1), lambda d: little(c, F.col("_at") + d * 4, 4).cast("int"))
    after = F.col("_at") + F.col("dimensions") * 4
    return e.select("path", "chunk_no", coord.alias("coord"), little(c, after, 8).alias("offset"), little(c, after + 8, 4).cast("int").alias("n_bytes"), "tile_x", "tile_y", "compression", "pyramid")


def _listed_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            store, name = _place(path)
            folder = re.sub(r"([^/]+)\.[^./]+$", r"_\1_", name)
            found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
            deep = (f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".ets") and f.path.count("/") == folder.count("/") + 2)
            out += [(path.removesuffix(name) + f.path, f.size) for f in deep]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "length"])


def containers_of(slides: DataFrame) -> DataFrame:
    """path and length of the tile containers in the side folders of ``slides`` (path). Spark's own listing passes over folders whose names begin
    with a low line, as these do, so tasks list them."""
    return slides.select("path").mapInArrow(_listed_containers, "path string, length long")


def pair_containers(slides: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slide, container, number) of the tile containers that a slide's side folder _name_/stack/*.ets holds, in order of path, and
    (slide) of slides without any."""
    key = lambda path: F.regexp_replace(path, r"^(.*)/([^/]+)\.(?i:vsi)$", "$1/_$2_")
    s = slides.select(F.col("path").alias("slide"), key(F.col("path")).alias("_k"))
    e = containers.select(F.col("path").alias("container"), F.regexp_extract("path", r"^(.*)/[^/]+/[^/]+\.ets$", 1).alias("_k"))
    found = s.join(e, "_k").withColumn("number", F.row_number().over(Window.partitionBy("slide").orderBy("container")) - 1).drop("_k")
    return found, s.join(e, "_k", "left_anti").select("slide")
