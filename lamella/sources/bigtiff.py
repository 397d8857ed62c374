"""The output file: a tiled BigTIFF, each directory written once, after its offsets are known from a window over all tiles' sizes.

Tiles that pass through are never rows of bytes: a part says where its bytes lie, and the task that writes a stretch of the output reads them there."""

from __future__ import annotations

import io
import os
import struct
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.binary import little_bytes
from lamella.operators.tiles import file_offsets
from lamella.sources.containers import _opened, _place, fetch
from lamella.sources.steps import fixed

# Names that the metadata packet gives its fields, and the padding after it.
FIELDS = ("ObjectiveLensPower", "Manufacturer", "ManufacturerModelName", "ICCProfile", "ImageComments", "ExposureTime")
PADDING = 2424
SOFTWARE = b"lamella\0"
#: Bytes of an output file that one task writes, where the store can write at any place.
STRETCH = 256 << 20
#: Tasks of a run of the sink; with more stretches, a task writes several.
MOST_TASKS = 100_000
#: Columns of a part that lies in another file: its place there, and bytes that stand for its first two.
ELSEWHERE = {"source": "string", "source_offset": "long", "source_bytes": "long", "lead": "binary"}


def packet(subject: Column, fields: dict[str, Column], spacing_y: Column, spacing_x: Column) -> Column:
    """The XMP packet of a slide as text. ``subject`` is given (a UUID), so reruns agree; null fields are left out; the ICC profile is given
    as bytes and written in base 64; spacing is an RDF list of y and x."""
    def element(name: str, value: Column) -> Column:
        value = F.base64(value) if name == "ICCProfile" else value.cast("string")
        clean = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        kind = ' rdf:datatype="http://www.w3.org/2001/XMLSchema#base64Binary"' if name == "ICCProfile" else ""
        return F.when(value.isNotNull(), F.concat(F.lit(f"<DICOM:{name}{kind}>"), clean, F.lit(f"</DICOM:{name}>"))).otherwise("")

    def listed(*values: Column) -> Column:
        out = F.lit('<rdf:rest rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"/>')
        for i, v in enumerate(reversed(values)):
            node = F.concat(F.lit("<rdf:Description><rdf:first>"), v.cast("string"), F.lit("</rdf:first>"), out, F.lit("</rdf:Description>"))
            out = node if i == len(values) - 1 else F.concat(F.lit("<rdf:rest>"), node, F.lit("</rdf:rest>"))
        return out

    body = [element(n, fields[n]) for n in FIELDS if n in fields]
    spacing = F.concat(F.lit("<DICOM:PixelSpacing>"), listed(spacing_y, spacing_x), F.lit("</DICOM:PixelSpacing>"))
    pair = F.when(spacing_y.isNotNull() & spacing_x.isNotNull(), spacing).otherwise("")
    begin = '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/">'
    spaces = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:DICOM="http://ns.adobe.com/DICOM/">'
    end = "</rdf:Description></rdf:RDF></x:xmpmeta>" + " " * PADDING + '<?xpacket end="w"?>'
    return F.concat(F.lit(f'{begin}{spaces}<rdf:Description rdf:about="urn:uuid:'), subject, F.lit('">'), *body, pair, F.lit(end))


def _directory(at: int, tags: list[tuple[int, int, list[int] | bytes]], following: bool) -> bytes:
    """A BigTIFF directory that starts at ``at``, values that don't fit behind it; it points behind itself or to 0."""
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 16: 8}
    codes = {3: "H", 4: "I", 5: "I", 16: "Q"}
    table, data, behind = b"", b"", at + 8 + 20 * len(tags) + 8
    for tag, kind, value in sorted(tags):
        raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{codes[kind]}", *value)
        if len(raw) > 8:
            data += b"\0" * (len(data) % 2)
            place = struct.pack("<Q", behind + len(data))
            data += raw
        else:
            place = raw.ljust(8, b"\0")
        table += struct.pack("<HHQ", tag, kind, len(raw) // sizes[kind]) + place
    return struct.pack("<Q", len(tags)) + table + struct.pack("<Q", behind + len(data) if following else 0) + data


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directory bytes of each (slide, level) row, whose tiles' places are known."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            tags = [(256, 4, [r["width"]]), (257, 4, [r["height"]]), (258, 3, [8] * 3), (259, 3, [r["compression"]]), (277, 3, [3]), (284, 3, [1])]
            tags += [(322, 3, [r["tile"]]), (323, 3, [r["tile_height"]]), (324, 16, r["offsets"]), (325, 16, r["byte_counts"])]
            tags += [(262, 3, [r["photometric"]])] if r["photometric"] is not None else []
            if r["level"]:
                tags.append((254, 4, [1]))
            else:
                tags += [(270, 2, b"\0"), (274, 3, [1]), (282, 5, [r["resolution"], 1000]), (283, 5, [r["resolution_y"], 1000]), (296, 3, [3]), (305, 2, SOFTWARE), (339, 3, [1] * 3)]
                tags += [(530, 3, r["subsampling"])] if r["subsampling"] else []
                tags += [(700, 7, r["packet"].encode())] if r["packet"] else []
            out.append(_directory(r["at"], tags, not r["last"]))
        yield pa.RecordBatch.from_arrays([batch.column("slide"), batch.column("level"), batch.column("at"), pa.array(out, pa.binary())], ["slide", "part", "offset", "bytes"])


def references(tiles: DataFrame) -> DataFrame:
    """``tiles`` (slide, level, tile_no, bytes, source, source_offset, source_bytes, lead) with size, for ``layout``: a tile has the bytes
    of its source, the first two of them replaced by ``lead`` if there is one, else its own ``bytes``, else none."""
    there = F.col("source_bytes") + F.coalesce(F.octet_length("lead") - 2, F.lit(0))
    return tiles.withColumn("size", F.when(F.col("source").isNotNull(), there).otherwise(F.coalesce(F.octet_length("bytes"), F.lit(0))).cast("long"))


def tile_bytes(tiles: DataFrame) -> DataFrame:
    """slide, level, tile_no, bytes of tiles that may lie elsewhere, read by stretches of their files."""
    own = ["slide", "level", "tile_no", "bytes"]
    there = tiles.filter("source is not null").select("slide", "level", "tile_no", "lead", F.col("source").alias("path"), F.col("source_offset").alias("offset"), F.col("source_bytes").alias("n_bytes"))
    whole = F.when(F.col("lead").isNull(), F.col("bytes")).otherwise(F.concat("lead", F.substring("bytes", F.lit(3), F.octet_length("bytes"))))
    return fetch(there).withColumn("bytes", whole).select(*own).unionByName(tiles.filter("source is null").select(*own))


def layout(tiles: DataFrame, images: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """slide, part, offset, bytes and, if tiles lie elsewhere, ``ELSEWHERE`` of all parts of each slide's file.

    ``tiles``: slide, level, tile_no, bytes; or ``references``. ``made``: more tiles, with bytes. ``images``: slide, level, width, height, tile, compression, photometric, resolution,
    packet and, if they differ from tile, resolution and none, tile_height, resolution_y, subsampling (two numbers). A file has a
    header, then all tiles by level and number, then the directories, so only sizes go through the window.
    A directory's own length follows from its fields, and where it starts from those before it. Tiles with bytes meet their offsets in a
    join, so give them as a stored table; references keep theirs."""
    for name, default in (("tile_height", F.col("tile")), ("resolution_y", F.col("resolution")), ("subsampling", F.lit(None).cast("array<int>"))):
        images = images if name in images.columns else images.withColumn(name, default)
    keys, refs = ["slide", "level", "tile_no"], None
    if "size" in tiles.columns:
        refs = tiles
    else:
        made = tiles
    narrow = [] if refs is None else [refs.withColumn("_made", F.lit(False))]
    narrow += [] if made is None else [made.select(*keys, F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long").alias("size"), F.lit(True).alias("_made"))]
    placed = file_offsets(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow), "slide", ["level", "tile_no"], "size", 16)
    sized = placed.withColumnRenamed("size", "n")
    per = sized.groupBy("slide", "level").agg(F.array_sort(F.collect_list(F.struct("tile_no", "offset", "n"))).alias("t"), F.max(F.col("offset") + F.col("n")).alias("end"))
    per = per.select("slide", "level", F.col("t.offset").alias("offsets"), F.transform("t.n", lambda x: x.cast("long")).alias("byte_counts"), "end")
    d = images.join(per, ["slide", "level"])
    behind = lambda size: F.when(size > 8, size).otherwise(0)
    n_tags = 10 + F.col("photometric").isNotNull().cast("int") + F.when(F.col("level") > 0, 1).otherwise(7 + F.col("packet").isNotNull().cast("int") + F.col("subsampling").isNotNull().cast("int"))
    count = F.size("offsets")
    # values of over 8 bytes lie behind the table; all are of even length save the packet, which comes last
    extra = 2 * behind(8 * count) + F.when(F.col("level") > 0, 0).otherwise(F.coalesce(behind(F.octet_length("packet")), F.lit(0)))
    d = d.withColumn("length", (F.lit(16) + 20 * n_tags + extra).cast("long"))
    order, whole = Window.partitionBy("slide").orderBy("level"), Window.partitionBy("slide")
    first = F.max("end").over(whole)
    d = d.withColumn("at", first + first % 2 + F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("last", F.col("level") == F.max("level").over(whole))
    dirs = d.select("slide", "level", "at", "last", "width", "height", "tile", "tile_height", "compression", "photometric", "resolution", "resolution_y", "subsampling", "packet", "offsets", "byte_counts").mapInArrow(_images, "slide string, part int, offset long, bytes binary")
    heads = d.filter("level = 0").select("slide", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("offset"), "at")
    part = (F.col("level").cast("int").alias("part"), "offset", "bytes")
    bodies = [] if refs is None else [placed.filter("not _made").select("slide", *part, *ELSEWHERE)]
    bodies += [] if made is None else [made.join(placed.filter("_made").select(*keys, "offset"), keys).select("slide", *part)]
    header = heads.select("slide", "part", "offset", F.concat(F.unhex(F.lit("49492B0008000000")), little_bytes(F.col("at"), 8)).alias("bytes"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [header, dirs, *bodies])


def _join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _temporary(path: str, run: str) -> str:
    """The name of a file that isn't whole yet, beside its own."""
    home, _, name = path.rpartition("/")
    return _join(home, f".{run}-{name}")


class _Output:
    """A file that isn't whole yet: at any place where the store is a local file system, else from its start on."""

    def __init__(self, path: str) -> None:
        store, name = _place(path)
        self.local = store.type_name == "local"
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.file = io.FileIO(os.open(name, os.O_RDWR | os.O_CREAT, 0o644), "r+", closefd=True) if self.local else store.open_output_stream(name)
        self.at = 0

    def put(self, at: int, raw: bytes) -> None:
        if self.local:
            self.file.seek(at)
        elif at < self.at:
            raise OSError(f"the part at {at} is written already")
        elif at > self.at:  # a pad byte between parts
            self.file.write(b"\0" * (at - self.at))
        self.file.write(raw)
        self.at = at + len(raw)


def _part_bytes(r: dict, files: dict) -> bytes:
    if r["source"] is None:
        if r["bytes"] is None:
            raise OSError(f"no bytes for the part at {r['offset']}")
        return r["bytes"]
    if r["source"] not in files:
        for file in files.values():
            file.close()
        files.clear()
        files[r["source"]] = _opened(r["source"])
    raw = files[r["source"]].read_at(r["source_bytes"], r["source_offset"])
    if len(raw) != r["source_bytes"]:
        raise OSError(f"no bytes for the part at {r['offset']}")
    return raw if r["lead"] is None else r["lead"] + raw[2:]


def _written(folder: str, run: str):
    """Writes rows of parts, in order of slide, stretch and offset, to files that aren't whole yet; one row for each slide's stretch."""
    kinds = {"slide": pa.string(), "end": pa.int64(), "seconds": pa.float64(), "error": pa.string()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = slide = stretch = error = began = None
        end, done, files = 0, [], {}

        def close() -> None:
            if slide is None:
                return
            problem = error
            try:
                if out is not None:
                    out.file.close()
            except OSError as e:
                problem = problem or str(e)
            done.append((slide, end, time.monotonic() - began, problem))

        for batch in batches:
            for i in range(batch.num_rows):  # one part's bytes at a time
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if (r["slide"], r["stretch"]) != (slide, stretch):
                    close()
                    out, slide, stretch, error, end, began = None, r["slide"], r["stretch"], None, 0, time.monotonic()
                if error is not None:
                    continue
                try:
                    out = out or _Output(_temporary(_join(folder, slide), run))
                    out.put(r["offset"], raw := _part_bytes(r, files))
                    end = r["offset"] + len(raw)
                except OSError as e:
                    error = str(e)
        close()
        for file in files.values():
            file.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return write


def _finished(folder: str, run: str):
    """Gives whole files their names and removes the others."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for slide, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist(), strict=True):
                store, name = _place(_join(folder, slide))
                part = _temporary(name, run)
                try:
                    if error is None and store.get_file_info(part).type == fs.FileType.File:
                        store.move(part, name)
                    elif error is None and store.get_file_info(name).type != fs.FileType.File:  # else an earlier try has moved it
                        error = "the written file is gone"
                    elif error is not None and store.get_file_info(part).type == fs.FileType.File:
                        store.delete_file(part)
                except OSError as e:
                    error = error or str(e)
                errors.append(error)
            at = batch.schema.names.index("error")
            yield batch.set_column(at, "error", pa.array(errors, pa.string()))

    return finish


def write_files(parts: DataFrame, folder: str, stretch: int = STRETCH) -> DataFrame:
    """path, n_bytes, seconds, error, stretches (how many were written apart) of each slide's file below ``folder``, a path or a URI of any store that Arrow knows; n_bytes is null where
    there is an error.

    Tasks write stretches of ``stretch`` bytes of a file that has another name yet, each at its own place, so a large slide is many
    tasks' work; a store that can't write at a place gets a file from one task, in order. A part that lies elsewhere is read there by the task that
    writes it, once, and is never shuffled. When all stretches are written, a second step gives whole files their names and removes those with
    an error; a task that is run again writes the same bytes at the same places, and no failed run leaves a file that looks done. A part
    without bytes, or a file that can't be written, is that slide's error, and the others go on."""
    run = uuid.uuid4().hex
    local = _place(folder)[0].type_name == "local"
    for name, kind in ELSEWHERE.items():
        parts = parts if name in parts.columns else parts.withColumn(name, F.lit(None).cast(kind))
    where = F.floor(F.col("offset") / stretch) if local else F.lit(0).cast("long")
    # rows are small whatever they make a task write, so the number of tasks is that of stretches
    tasks = parts.select("slide", where).distinct().count()
    dealt = parts.select("slide", where.alias("stretch"), "offset", "bytes", *ELSEWHERE).repartition(max(1, min(tasks, MOST_TASKS)), "slide", "stretch").sortWithinPartitions("slide", "stretch", "offset")
    try:
        done = fixed(dealt.mapInArrow(_written(folder, run), "slide string, end long, seconds double, error string"))
    except Exception:
        gone = parts.select(F.col("slide").alias("path"), F.lit(None).cast("long").alias("n_bytes"), F.lit(0.0).alias("seconds"), F.lit("the run failed").alias("error"), F.lit(0).alias("stretches")).distinct()
        gone.mapInArrow(_finished(folder, run), gone.schema).count()
        raise
    each = done.groupBy(F.col("slide").alias("path")).agg(F.max("end").alias("n_bytes"), F.sum("seconds").alias("seconds"), F.max("error").alias("error"), F.count("*").cast("int").alias("stretches"))
    named = fixed(each.mapInArrow(_finished(folder, run), each.schema))
    return named.withColumn("n_bytes", F.when(F.col("error").isNull(), F.col("n_bytes")))


def remove_files(paths: DataFrame, folder: str) -> DataFrame:
    """path, removed for each path (below ``folder``) in ``paths``; a file that isn't there is not removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for path in batch.column("path").to_pylist():
                store, name = _place(_join(folder, path))
                try:
                    store.delete_file(name)
                    gone.append(True)
                except OSError:
                    gone.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(gone)], ["path", "removed"])

    return paths.select("path").distinct().mapInArrow(run, "path string, removed boolean")
