"""A folder of built slides, converted and read back; ranges of files too large for a value."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from lamella.functions import binary as b
from lamella.plans import batch, convert
from lamella.sources import containers, slides
from tests.test_sources import ets

SOI, EOI = b"\xff\xd8", b"\xff\xd9"


def jpeg(text):
    return SOI + text.encode() + EOI


def slide(images, order="<"):
    """A BigTIFF: each image is (tags {tag: (type, values or bytes)}, tiles). Tiles come first, then directories."""
    p = lambda f, *v: struct.pack(order + f, *v)
    codes = {3: "H", 4: "I", 16: "Q"}
    body, plans = b"", []
    for tags, tiles in images:
        offsets = []
        for t in tiles:
            offsets.append(16 + len(body))
            body += t
        plans.append({**tags, **({324: (16, offsets), 325: (4, [len(t) for t in tiles])} if tiles else {})})
    out = (b"II" if order == "<" else b"MM") + p("HHHQ", 43, 8, 0, 16 + len(body)) + body
    for i, tags in enumerate(plans):
        at, data, table = len(out), b"", p("Q", len(tags))
        behind = at + 8 + 20 * len(tags) + 8
        for tag, (kind, value) in sorted(tags.items()):
            raw = value if isinstance(value, bytes) else p(f"{len(value)}{codes[kind]}", *value)
            n = len(raw) // {2: 1, 7: 1, 3: 2, 4: 4, 16: 8}[kind]
            place = raw.ljust(8, b"\0") if len(raw) <= 8 else p("Q", behind + len(data))
            data += raw if len(raw) > 8 else b""
            table += p("HHQ", tag, kind, n) + place
        out += table + p("Q", 0 if i == len(plans) - 1 else behind + len(data)) + data
    return out


def image(w, h, tile, text=None, compression=7, photometric=6, tables=None, reduced=False):
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8, 8, 8]), 259: (3, [compression]), 262: (3, [photometric]), 277: (3, [3]), 322: (3, [tile]), 323: (3, [tile])}
    tags |= {254: (4, [1])} if reduced else {}
    tags |= {270: (2, text.encode() + b"\0")} if text is not None else {}
    return tags | ({347: (7, tables)} if tables else {})


COMMENT = "Aperio Image Library v1\n2000x1000 [0,0] (256x256)|AppMag = 20|MPP = 0.5|Date = 01/02/20|Time = 03:04:05|Exposure Time = 8|Exposure Scale = 0.001"
NAMES = [f"t{i}" for i in range(6)]


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    tables = SOI + b"TABLES" + EOI
    good = slide([
        (image(700, 500, 256, COMMENT, tables=tables), [jpeg(x) for x in NAMES]),
        (image(175, 125, 256, COMMENT, reduced=True), [jpeg("thumb")]),
        (image(900, 50, 256, "Aperio\nlabel 900x50"), [jpeg(f"l{i}") for i in range(4)]),
    ], ">")
    (src / "sub" / "good.svs").write_bytes(slide([(image(700, 500, 256, COMMENT, tables=tables), [jpeg(x) for x in NAMES]), (image(60, 50, 256), [jpeg("label")])]))
    (src / "wide.SVS").write_bytes(good)
    (src / "broken.svs").write_bytes(good[:200])
    (src / "noise.svs").write_bytes(b"this is no slide")
    (src / "lzw.tif").write_bytes(slide([(image(100, 90, 64, compression=5), [b"x"] * 4)]))
    (src / "gap.tif").write_bytes(slide([(image(100, 60, 64), [jpeg("a"), b""])]))
    (src / "plain.tif").write_bytes(slide([(image(100, 60, 64), [jpeg("a"), jpeg("b")])]))
    (src / "same.vsi").write_bytes(b"unused")
    (src / "readme.txt").write_text("not a slide")
    stack = src / "_same_" / "stack1"
    stack.mkdir(parents=True)
    payload = [jpeg(f"v{i}") for i in range(3)]
    places = [(0, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 1)]
    size, at = len(ets([(p, 0, 0) for p in places])), []
    for x in payload:
        at.append((size + sum(n for _, n in at), len(x)))
    (stack / "frame_t.ets").write_bytes(ets([(p, *spot) for p, spot in zip(places, at, strict=True)]) + b"".join(payload))
    return src, tmp_path / "out"


def outputs(spark, out):
    dirs = containers.directories(containers.tiff_entries(containers.scan(spark, str(out), "*.tif")))
    tiles = containers.fetch(containers.tile_index(dirs)).collect()
    found = {}
    for r in sorted(tiles, key=lambda r: (r.path, r.ifd_no, r.tile_no)):
        found.setdefault((os.path.relpath(r.path.split(":", 1)[-1], out), r.ifd_no), []).append(bytes(r.bytes))
    return found, {(os.path.relpath(r.path.split(":", 1)[-1], out), r.ifd_no): r for r in dirs.collect()}


def test_folder_to_files(spark, folder):
    src, out = folder
    settings = batch.Parameters(str(src), str(out), validate=True)
    report = {os.path.relpath(r.path, src): r for r in convert.convert(spark, settings).collect()}
    assert set(report) == {"sub/good.svs", "wide.SVS", "broken.svs", "noise.svs", "lzw.tif", "gap.tif", "plain.tif", "same.vsi"}
    print("ERRORS", {k: r.error for k, r in report.items()})
    assert {k: r.status for k, r in report.items()} == {"sub/good.svs": "converted", "wide.SVS": "converted", "broken.svs": "failed", "noise.svs": "failed", "lzw.tif": "failed", "gap.tif": "failed", "plain.tif": "converted", "same.vsi": "converted"}
    assert "LZW" in report["lzw.tif"].error and report["noise.svs"].error == "no image found" and "no bytes" in report["gap.tif"].error
    assert all((r.n_bytes is None) == (r.status == "failed") and r.valid == (r.status == "converted") for r in report.values())
    tiles, dirs = outputs(spark, out)
    spliced = [SOI + b"TABLES" + bytes.fromhex(b.ADOBE[6]) + x.encode() + EOI for x in NAMES]
    assert tiles == {("sub/good.tif", 0): spliced, ("wide.tif", 0): [jpeg(f"l{i}") for i in range(4)], ("plain.tif", 0): [jpeg("a"), jpeg("b")], ("same.tif", 0): [jpeg("v0"), jpeg("v1")]}
    assert {k: (r.width, r.height, r.photometric, r.subsampling) for k, r in dirs.items()} == {("sub/good.tif", 0): (700, 500, 6, [1, 1]), ("wide.tif", 0): (900, 50, 6, [1, 1]), ("plain.tif", 0): (100, 60, 6, [1, 1]), ("same.tif", 0): (1024, 256, 6, [1, 1])}
    packet = bytes(dirs["sub/good.tif", 0].packet).decode()
    assert "<DICOM:ObjectiveLensPower>20</DICOM:ObjectiveLensPower>" in packet and "<DICOM:ExposureTime>8</DICOM:ExposureTime>" in packet and "<rdf:first>500000</rdf:first>" in packet
    assert not [f for _, _, files in os.walk(out) for f in files if f.startswith(".") and not f.endswith(".crc")]


def test_second_runs(spark, folder):
    src, out = folder
    run = lambda **how: {os.path.relpath(r.path, src): (r.status, r.valid) for r in convert.convert(spark, batch.Parameters(str(src), str(out), filter="plain", **how)).collect()}
    assert run(validateonly=True) == {"plain.tif": ("skipped", None)}
    assert run() == {"plain.tif": ("converted", None)}
    made = os.stat(out / "plain.tif").st_ino
    assert run() == {"plain.tif": ("kept", None)} and run(validate=True) == {"plain.tif": ("kept", True)} and os.stat(out / "plain.tif").st_ino == made
    assert run(overwrite=True, validate=True) == {"plain.tif": ("converted", True)}
    (out / "plain.tif").write_bytes(b"II")
    assert run(retry=True, validate=True) == {"plain.tif": ("converted", True)}
    assert run(overwrite=True, validateonly=True) == {"plain.tif": ("deleted", None)} and not (out / "plain.tif").exists()


def test_lower_levels_and_fillers(spark, folder):
    src, out = folder

    def lower(tiles, images):
        small = images.select("slide", F.lit(1).alias("level"), ((F.col("width") + 1) / 2).cast("long").alias("width"), ((F.col("height") + 1) / 2).cast("long").alias("height"), "tile", "tile_height", "compression", F.lit(6).alias("photometric"), "resolution", F.lit(None).cast("string").alias("packet"))
        one = tiles.groupBy("slide").agg(F.encode(F.concat(F.lit("n"), F.count("*").cast("string")), "UTF-8").alias("bytes"))
        return one.select("slide", F.lit(1).alias("level"), F.lit(0).cast("long").alias("tile_no"), "bytes"), small

    report = convert.convert(spark, batch.Parameters(str(src), str(out), filter="gap"), lower, jpeg("black")).collect()
    assert [r.status for r in report] == ["converted"]
    tiles, dirs = outputs(spark, out)
    assert tiles == {("gap.tif", 0): [jpeg("a"), jpeg("black")], ("gap.tif", 1): [b"n2"]} and dirs["gap.tif", 1].subfile_type == 1 and dirs["gap.tif", 1].width == 50


def test_colliding_slides_fail(spark, folder):
    src, out = folder
    (src / "plain.svs").write_bytes((src / "plain.tif").read_bytes())
    report = convert.convert(spark, batch.Parameters(str(src), str(out), filter="plain")).collect()
    assert [(r.status, r.error) for r in report] == [("failed", "another slide has the same destination")] * 2 and not out.exists()


def test_ranges_of_a_file_over_2_gb(spark, tmp_path):
    path = str(tmp_path / "huge.svs")
    tile_at, dirs_at = 2_500_000_000, 3_000_000_000
    entry = lambda tag, kind, n, value: struct.pack("<HHQQ", tag, kind, n, value)
    directory = struct.pack("<Q", 8) + entry(256, 4, 1, 64) + entry(257, 4, 1, 64) + entry(259, 3, 1, 7) + entry(270, 2, 13, dirs_at + 500) + entry(322, 3, 1, 64) + entry(323, 3, 1, 64) + entry(324, 16, 1, tile_at) + entry(325, 4, 1, 6)
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, dirs_at))
        f.seek(tile_at)
        f.write(jpeg("ok"))
        f.seek(dirs_at)
        f.write(directory + struct.pack("<Q", 0))
        f.seek(dirs_at + 500)
        f.write(b"Aperio Image\0")
    files = convert.listing(spark, str(tmp_path))
    assert [r.length for r in files.collect()] == [dirs_at + 513]
    dirs = containers.directories(containers.tiff_entries(files, containers.TAGS))
    row = dirs.first()
    assert (row.width, row.description, row.offsets) == (64, "Aperio Image", [tile_at])
    assert [bytes(r.bytes) for r in containers.fetch(containers.tile_index(dirs)).collect()] == [jpeg("ok")]
    assert [r.value_string for r in containers.tiff_entries(files, (256,)).filter("tag = 270").collect()] == [None]


def test_sub_directories_by_offset(spark, tmp_path):
    e = lambda tag, kind, n, value: struct.pack("<HHII", tag, kind, n, value)
    main = struct.pack("<H", 4) + e(256, 4, 1, 9) + e(257, 4, 1, 9) + e(330, 4, 2, 200) + e(34665, 4, 1, 400) + struct.pack("<I", 0)
    sub = lambda w: struct.pack("<H", 2) + e(256, 4, 1, w) + e(257, 4, 1, w) + struct.pack("<I", 0)
    data = (b"II*\0\x08\0\0\0" + main).ljust(200, b"\0") + struct.pack("<II", 260, 300)
    data = data.ljust(260, b"\0") + sub(5)
    data = data.ljust(300, b"\0") + sub(3)
    data = data.ljust(400, b"\0") + struct.pack("<H", 2) + e(33434, 4, 1, 1) + e(37386, 4, 1, 2) + struct.pack("<I", 0)
    (tmp_path / "a.tif").write_bytes(data)
    files = convert.listing(spark, str(tmp_path))
    dirs = containers.directories(containers.tiff_entries(files))
    below = containers.directories(containers.pointed_entries(files, dirs, "sub_offsets"))
    assert dirs.first().sub_offsets == [260, 300] and sorted(r.width for r in below.collect()) == [3, 5]
    exif = containers.pointed_entries(files, dirs, "exif_offset")
    assert sorted((r.tag, r.offset) for r in exif.collect()) == [(33434, 400), (37386, 400)]


def test_svs_with_focal_positions(spark):
    said = lambda z: f"Aperio Image|TotalDepth = 4|OffsetZ = {z}"
    rows = [("s", 0, 1000, said(0)), ("s", 1, 200, "thumb"), ("s", 2, 500, said(0)), ("s", 3, 1000, said(2)), ("s", 4, 500, said(2)), ("s", 5, 60, None), ("s", 6, 70, None)]
    rows += [("t", 0, 900, "x|MPP = 0.25"), ("t", 1, 300, "y"), ("t", 2, 100, "y"), ("t", 3, 80, "Label"), ("t", 4, 70, "macro=1|a macro")]
    df = spark.createDataFrame([(p, i, w, w, 256, 256, 8, 1, 7, 6, 3, d, [2, 2]) for p, i, w, d in rows], "path string, ifd_no int, width long, height long, tile_width long, tile_height long, bits long, sample_format long, compression long, photometric long, samples long, description string, subsampling array<long>").withColumn("tables", F.lit(None).cast("binary"))
    got = {(r.path, r.series): (r.ifd_no, r.kind, r.z_size) for r in slides.svs_images(df).collect()}
    assert {k: v for k, v in got.items() if k[0] == "t"} == {("t", 0): (0, "level", 1), ("t", 1): (2, "level", 1), ("t", 2): (1, "level", 1), ("t", 3): (3, "label", 1), ("t", 4): (4, "macro", 1)}
    assert got["s", 0] == (0, "level", 2) and got["s", 1] == (2, "level", 2)
