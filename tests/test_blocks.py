"""Strips and tiles of built files in one index; raster levels; the sink in stretches, to any destination."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import blocks, rasters
from lamella.plans import batch, convert
from lamella.sources import bigtiff, containers, slides
from tests.test_convert import NAMES, image, jpeg, outputs, slide
from tests.test_sources import tiff


def striped(pixels, rows, planar=1, order="<", cut=0, reverse=True, comment=None):
    """A classic TIFF of an array (height, width, samples) in strips of ``rows`` rows, the last strip first in the file."""
    h, w, samples = pixels.shape
    planes = [pixels] if planar == 1 else [pixels[:, :, [k]] for k in range(samples)]
    strips = [p[y : y + rows].astype(pixels.dtype.newbyteorder(order)).tobytes() for p in planes for y in range(0, h, rows)]
    p = lambda f, *v: struct.pack(order + f, *v)

    def built(base):
        at, offsets, data = base, [0] * len(strips), b""
        for i in reversed(range(len(strips))) if reverse else range(len(strips)):
            offsets[i], at, data = at, at + len(strips[i]), data + strips[i]
        offsets, counts = offsets[: len(offsets) - cut], [len(s) for s in strips]
        n = len(offsets)
        tags = [(256, 4, p("I", w), 1), (257, 4, p("I", h), 1), (258, 3, p(f"{samples}H", *[8 * pixels.itemsize] * samples), samples), (259, 3, p("H", 1), 1), (273, 4, p(f"{n}I", *offsets), n), (277, 3, p("H", samples), 1), (278, 4, p("I", rows), 1), (279, 4, p(f"{len(counts)}I", *counts), len(counts)), (284, 3, p("H", planar), 1)]
        tags += [(270, 2, comment, len(comment))] if comment else []
        return tiff(order, False, [tags]), data

    head, _ = built(0)
    return b"".join(built(len(head)))


@pytest.fixture(scope="module")
def striped_files(spark, tmp_path_factory):
    folder, rnd = tmp_path_factory.mktemp("strips"), np.random.default_rng(1)
    made = {}
    for name, shape, kind, rows, planar, order in (("a", (23, 17, 3), np.uint8, 4, 1, "<"), ("b", (23, 17, 3), np.uint16, 5, 2, ">"), ("c", (9, 40, 1), np.uint8, 100, 1, "<")):
        made[name] = rnd.integers(0, 250, shape).astype(kind)
        (folder / f"{name}.tif").write_bytes(striped(made[name], rows, planar, order))
    (folder / "short.tif").write_bytes(striped(made["a"], 4, cut=2))
    return containers.directories(containers.tiff_entries(convert.listing(spark, str(folder)), containers.TAGS)), made


def test_regions_of_strips(striped_files):
    dirs, made = striped_files
    x, y, w, h = 3, 2, 11, 15
    got = blocks.region(dirs, x, y, w, h, containers.fetch).collect()
    rows = {(os.path.basename(r.path)[0], r.plane, r.row): bytes(r.bytes) for r in got}
    want = {}
    for name, pixels in made.items():
        order, planar = (">", 2) if name == "b" else ("<", 1)
        for k, part in enumerate([pixels] if planar == 1 else [pixels[:, :, [i]] for i in range(3)]):
            for i, row in enumerate(part[y : y + h, x : x + w].astype(part.dtype.newbyteorder(order))):
                want[name, k, i] = row.tobytes()
    assert rows == want


def test_too_few_strips_are_an_error(striped_files):
    dirs, _ = striped_files
    assert [(os.path.basename(r.path), r.error) for r in blocks.block_errors(dirs).collect()] == [("short.tif", "offsets: 4 of 6 strips")]
    assert "short.tif" not in {os.path.basename(r.path) for r in blocks.block_index(dirs).collect()}


def test_tiles_and_strips_share_an_index(spark, tmp_path):
    tiles = [bytes([i]) * 64 * 64 for i in range(6)]
    tags = {256: (4, [150]), 257: (4, [100]), 258: (3, [8]), 259: (3, [1]), 277: (3, [1]), 322: (3, [64]), 323: (3, [64])}
    (tmp_path / "t.tif").write_bytes(slide([(tags, tiles)]))
    dirs = containers.directories(containers.tiff_entries(convert.listing(spark, str(tmp_path)), containers.TAGS))
    index = blocks.block_index(dirs).orderBy("block_no").collect()
    assert [(r.x, r.y, r.w, r.h) for r in index] == [(0, 0, 64, 64), (64, 0, 64, 64), (128, 0, 22, 64), (0, 64, 64, 36), (64, 64, 64, 36), (128, 64, 22, 36)]
    rows = {r.row: bytes(r.bytes) for r in blocks.region(dirs, 60, 62, 80, 4, containers.fetch).collect()}
    assert rows == {i: bytes([k]) * 4 + bytes([k + 1]) * 64 + bytes([k + 2]) * 12 for i in range(4) for k in [0 if i < 2 else 3]}


def halves(a):
    a = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2), (0, 0))).astype(int)
    left, right = (a[0::2, 0::2] + a[1::2, 0::2] + 1) // 2, (a[0::2, 1::2] + a[1::2, 1::2] + 1) // 2
    return (left + right + 1) // 2


def cut(a, side):
    """Padded tiles of an array, rows first."""
    h, w, _ = a.shape
    a = np.pad(a, ((0, -h % side), (0, -w % side), (0, 0))).astype(np.uint8)
    return [((x, y), a[y * side : (y + 1) * side, x * side : (x + 1) * side].tobytes()) for y in range(a.shape[0] // side) for x in range(a.shape[1] // side)]


def test_raster_levels(spark):
    """Five levels in two passes; a repeated tile counts once, an absent one is black."""
    a = np.random.default_rng(2).integers(0, 256, (75, 130, 3))
    tiles = [("s", x, y, bytearray(raw)) for (x, y), raw in cut(a, 4)]
    a[4:8, 8:12] = 0
    tiles = [t for t in tiles if t[1:3] != (2, 1)]
    got = rasters.levels(spark.createDataFrame(tiles + tiles[:5], "slide string, tile_x int, tile_y int, raster binary"), 5, 4, 3).collect()
    found = {(r.level, r.tile_x, r.tile_y): bytes(r.raster) for r in got}
    assert len(found) == len(got)
    for level in range(1, 6):
        a = halves(a)
        assert {k[1:]: v for k, v in found.items() if k[0] == level} == dict(cut(a, 4))


def test_raw_slide_with_all_levels(spark, tmp_path):
    """A tiled image that isn't compressed becomes a whole pyramid, which is valid; without its lower levels it is too large."""
    (tmp_path / "in").mkdir()
    a = np.random.default_rng(3).integers(0, 256, (1100, 2300, 3))
    raw = image(2300, 1100, 256, compression=1, photometric=2)
    (tmp_path / "in" / "raw.tif").write_bytes(slide([(raw, [t for _, t in cut(a, 256)])]))
    (tmp_path / "in" / "small.tif").write_bytes(slide([(image(300, 200, 256, compression=1, photometric=2), [t for _, t in cut(a[:200, :300], 256)])]))
    out = tmp_path / "out"
    run = lambda **how: {os.path.basename(r.path): (r.status, r.valid) for r in convert.convert(spark, batch.Parameters(str(tmp_path / "in"), str(out), overwrite=True, validate=True), **how).collect()}
    assert run() == {"raw.tif": ("failed", False), "small.tif": ("failed", False)}
    assert run(raw=True) == {"raw.tif": ("converted", False), "small.tif": ("converted", True)}
    assert run(raw=True, lower=rasters.lower) == {"raw.tif": ("converted", True), "small.tif": ("converted", True)}
    tiles, dirs = outputs(spark, out)
    assert {k: (r.width, r.height, r.photometric, r.compression) for k, r in dirs.items()} == {("raw.tif", 0): (2300, 1100, 2, 1), ("raw.tif", 1): (1150, 550, 2, 1), ("raw.tif", 2): (575, 275, 2, 1), ("small.tif", 0): (300, 200, 2, 1)}
    levels = [np.pad(a, ((0, -1100 % 256), (0, -2300 % 256), (0, 0)))]
    for _ in range(2):
        levels.append(halves(levels[-1]))
    for i, (w, h) in enumerate(((2300, 1100), (1150, 550), (575, 275))):
        assert tiles["raw.tif", i] == [t for _, t in cut(levels[i][: -(-h // 256) * 256, : -(-w // 256) * 256], 256)]


def test_destination_as_uri(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "s.tif").write_bytes(slide([(image(100, 60, 64), [jpeg("a"), jpeg("b")])]))
    run = lambda **how: [(r.status, r.valid) for r in convert.convert(spark, batch.Parameters(f"file://{tmp_path}/in", f"file:{tmp_path}/out", validate=True, **how)).collect()]
    assert run() == [("converted", True)] and (tmp_path / "out" / "sub" / "s.tif").exists()
    assert run() == [("kept", True)] and run(overwrite=True) == [("converted", True)]
    assert os.listdir(tmp_path / "out" / "sub") == ["s.tif"]


def parts_of(spark, path, spots, lead=None):
    """references to ``spots`` (offset, bytes) of one file, and the image they make."""
    tiles = spark.createDataFrame([("big.tif", 0, i, None, path, at, n, lead) for i, (at, n) in enumerate(spots)], "slide string, level int, tile_no long, bytes binary, source string, source_offset long, source_bytes long, lead binary")
    images = spark.range(1).selectExpr("'big.tif' as slide", "0 as level", f"{64 * len(spots)} as width", "64 as height", "64 as tile", "7 as compression", "6 as photometric", "1000L as resolution", "cast(null as string) as packet")
    return bigtiff.layout(bigtiff.references(tiles), images)


def test_large_slide_in_stretches(spark, tmp_path):
    """Tiles over three gigabytes of a sparse file; the output is written by many tasks, and no step but the writer's reads a tile."""
    path, n = str(tmp_path / "huge.svs"), 200
    payload = [jpeg(f"tile {i} " + "x" * (i * 37 % 900)) for i in range(n)]
    spots = [(i * 16_000_000 + 7, len(x)) for i, x in enumerate(payload)]
    with open(path, "wb") as f:
        for (at, _), x in zip(spots, payload, strict=True):
            f.seek(at)
            f.write(x)
    parts = parts_of(spark, path, spots, bytearray(b"\xff\xd8LEAD"))
    plan = parts._jdf.queryExecution().toString()
    assert "_fetched" not in plan and plan.count("MapInArrow") <= plan.count("_images")
    row = bigtiff.write_files(parts, str(tmp_path / "out"), stretch=4096).collect()[0]
    assert row.error is None and row.stretches > 10 and row.n_bytes == os.path.getsize(tmp_path / "out" / "big.tif") and os.path.getsize(path) > 3_000_000_000
    tiles, _ = outputs(spark, tmp_path / "out")
    assert tiles == {("big.tif", 0): [b"\xff\xd8LEAD" + x[2:] for x in payload]}
    assert os.listdir(tmp_path / "out") == ["big.tif"]


def test_a_part_that_is_not_there_fails_its_slide_only(spark, tmp_path):
    path = str(tmp_path / "s")
    with open(path, "wb") as f:
        f.write(b"0123456789")
    row = bigtiff.write_files(parts_of(spark, path, [(0, 4), (8, 4)]), str(tmp_path / "out")).collect()[0]
    assert row.error.startswith("no bytes") and row.n_bytes is None and os.listdir(tmp_path / "out") == []
    row = bigtiff.write_files(parts_of(spark, str(tmp_path / "none"), [(0, 4)]), str(tmp_path / "out")).collect()[0]
    assert row.error and os.listdir(tmp_path / "out") == []
    assert len(NAMES) == 6


def test_validity_looks_at_both_ends(spark):
    rows = [("a", 0, 5, 5), ("a", 1, 0, 0), ("a", 2, 9, 9), ("b", 0, 0, 5), ("b", 1, 5, 5), ("c", 0, 5, 5), ("c", 1, 2000, 5), ("d", 0, 5, None), ("e", 0, 5000, 5000), ("e", 1, 0, 0)]
    got = batch.valid_outputs(spark.createDataFrame(rows, "f string, n int, w int, h int"), "f", "n", "w", "h")
    assert {r.f: r.valid for r in got.select("f", F.col("valid")).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": True}


def test_planes_without_directories(spark, tmp_path):
    """The second and later planes of a file that tells of one are read by offsets that follow from the first one's."""
    pixels = np.random.default_rng(4).integers(0, 250, (4, 6, 5, 1)).astype(np.uint8)
    data = striped(pixels[0], 4, reverse=False, comment=b"ImageJ=1.5\nimages=4\nslices=2\nframes=2\n\0") + pixels[1:].tobytes() + b"spare"
    (tmp_path / "j.tif").write_bytes(data)
    (tmp_path / "one.tif").write_bytes(striped(pixels[0], 4, reverse=False))
    files = convert.listing(spark, str(tmp_path))
    dirs = containers.directories(containers.tiff_entries(files, containers.TAGS))
    planes = slides.imagej_planes(dirs, files)
    assert [(r.plane, r.size_z, r.size_c, r.size_t) for r in planes.orderBy("plane").collect()] == [(i, 2, 1, 2) for i in range(4)]
    told = planes.select("path", F.col("plane").cast("int").alias("ifd_no"), F.col("offsets").alias("strip_offsets"), F.col("byte_counts").alias("strip_counts"))
    each = dirs.drop("ifd_no", "strip_offsets", "strip_counts").join(told, "path")
    rows = {(r.ifd_no, r.row): bytes(r.bytes) for r in blocks.region(each, 1, 1, 3, 5, containers.fetch).collect()}
    assert rows == {(p, y): pixels[p, y + 1, 1:4].tobytes() for p in range(4) for y in range(5)}


def test_equal_directories_are_planes(spark):
    data = [("a", i, 5, 6, 8, 0, f"ImageJ=1\nslices={n}" if i == last else "x") for i, last, n in ((0, 2, 3), (1, 2, 3), (2, 2, 3))] + [("b", 0, 5, 6, 8, 0, None), ("b", 1, 5, 6, 16, 0, None), ("b", 2, 1, 1, 8, 1, None)]
    d = spark.createDataFrame(data, "path string, ifd_no int, width long, height long, bits long, subfile_type long, description string")
    d = d.withColumns({n: F.lit(v).cast("long") for n, v in {"sample_format": 1, "samples": 1, "compression": 1, "photometric": 1, "tile_width": 4, "tile_height": 4}.items()} | {"subsampling": F.lit(None).cast("array<long>"), "tables": F.lit(None).cast("binary")})
    got = {(r.path, r.series): (r.ifd_no, r.planes, r.imagej.size_z if r.imagej else None) for r in slides.tiff_images(d).collect()}
    assert got == {("a", 0): (0, 3, 3), ("b", 0): (0, 1, None), ("b", 1): (1, 1, None)}


def test_one_slide(spark, tmp_path):
    """A file as source: to a folder, by series or the widest, to a new name, and over a file."""
    src, out = tmp_path / "s.svs", tmp_path / "out"
    src.write_bytes(slide([(image(100, 60, 64, "Aperio Image"), [jpeg("a"), jpeg("b")]), (image(60, 60, 64, "Aperio Image", reduced=True), [jpeg("thumb")]), (image(64, 30, 64, "label"), [jpeg("l")])]))

    def run(dest, *series):
        report = convert.convert(spark, batch.Parameters(str(src), str(dest), series=series, validate=True)).collect()
        return {os.path.relpath(r.dest, tmp_path): (r.status, r.valid) for r in report}

    good = ("converted", True)
    assert run(out, 0, 2) == {"out/s-series-0.tif": good, "out/s-series-2.tif": good}
    assert run(out, 9) == {"out/s-series-9.tif": ("failed", False)}
    assert run(out) == {"out/s.tif": good} and run(tmp_path / "new.tif", 1, 2) == {"new.tif": good}
    tiles, _ = outputs(spark, out)
    assert tiles == {("s-series-0.tif", 0): [jpeg("a"), jpeg("b")], ("s-series-2.tif", 0): [jpeg("l")], ("s.tif", 0): [jpeg("a"), jpeg("b")]}
    (tmp_path / "over.tif").write_bytes(b"old")
    assert run(tmp_path / "over.tif", 2) == {"over.tif": good} and outputs(spark, tmp_path)[0]["over.tif", 0] == [jpeg("l")]
    with pytest.raises(ValueError, match="folder"):
        run(tmp_path / "over.tif", 0, 2)


@pytest.mark.parametrize(("size", "samples", "little"), [(1, 1, True), (1, 3, True), (2, 3, False), (2, 1, True), (4, 2, False)])
def test_predictor(spark, size, samples, little):
    """As a walk over the bytes has it, with a last row that is cut short and a byte over; and back."""
    width, raw = 5, np.random.default_rng(size * samples).integers(0, 256, 5 * samples * size * 3 + 2 * samples * size + (size > 1)).astype(np.uint8).tobytes()
    order, step, want = "little" if little else "big", samples * size, bytearray(raw)
    for b in range(0, len(raw) - size + 1, size):
        if b // step % width:
            value = int.from_bytes(want[b : b + size], order) + int.from_bytes(want[b - step : b - step + size], order)
            want[b : b + size] = (value % (1 << 8 * size)).to_bytes(size, order)
    df = spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(b""),)], "r binary").select(rasters.predicted(F.col("r"), width, samples, size, little).alias("d"))
    got = [None if r.d is None else (bytes(r.d), bytes(r.b)) for r in df.withColumn("b", rasters.predicted(F.col("d"), width, samples, size, little, True)).collect()]
    assert got == [(bytes(want), raw), None, (b"", b"")]
