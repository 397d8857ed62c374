"""Bytes made here, read back by the sources; files written by the sink, read back too."""

import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella.functions import binary as b
from lamella.operators import tiles
from lamella.sources import bigtiff, containers


def tiff(order="<", big=False, dirs=(), stop=None):
    """A TIFF of directories [(tag, type, raw value bytes, count)]."""
    head, width, link = ("Q", 8, "Q") if big else ("H", 4, "I")
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42)
    out += struct.pack(order + "HHQ", 8, 0, 16) if big else struct.pack(order + "I", 8)
    for i, tags in enumerate(dirs):
        at, size = len(out), struct.calcsize(head) + (20 if big else 12) * len(tags) + width
        table, data = struct.pack(order + head, len(tags)), b""
        for tag, kind, raw, count in tags:
            place = raw.ljust(width, b"\0") if len(raw) <= width else struct.pack(order + link, at + size + len(data))
            data += raw if len(raw) > width else b""
            table += struct.pack(order + "HH" + ("Q" if big else "I"), tag, kind, count) + place
        following = 0 if i == len(dirs) - 1 else at + size + len(data)
        out += table + struct.pack(order + link, following) + data
    return out[:stop]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_entries_of_every_type(spark, order, big):
    p = lambda f, *v: struct.pack(order + f, *v)
    tags = [(256, 3, p("H", 40000), 1), (257, 4, p("I", 3_000_000_000), 1), (258, 3, p("3H", 8, 8, 8), 3), (270, 2, b"Aperio Image|MPP = 0.25\0", 24), (256, 3, p("H", 7), 1), (282, 5, p("2I", 4_000_000_000, 3), 1), (330, 13, p("I", 12), 1), (700, 7, b"\1\2\3\4\5\6\7\x08\x09", 9), (1, 1, b"\xff", 1), (2, 1, b"\xff\xfe\xfd", 3), (3, 11, p("f", 0.5), 1), (4, 12, p("d", 0.25), 1), (5, 9, p("i", -5), 1), (6, 16, p("Q", 1 << 40), 1)]
    data = tiff(order, big, [tags, [(256, 3, p("H", 1), 1)], [(254, 4, p("I", 1), 1), (256, 4, p("I", 9), 1)]])
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"not a slide")), ("c", None)], "path string, content binary")
    rows = {(r.ifd_no, r.entry_no): r for r in containers.tiff_entries(df).collect()}
    assert {k[0] for k in rows} == {0, 2} and all(r.path == "a" for r in rows.values())
    assert rows[0, 1].value_long == [3_000_000_000] and rows[0, 2].value_long == [8, 8, 8] and rows[0, 3].value_string == "Aperio Image|MPP = 0.25"
    assert [tuple(x) for x in rows[0, 5].value_rational] == [(4_000_000_000, 3)] and rows[0, 8].value_long == [-1] and rows[0, 9].value_long == [255, 254, 253]
    assert rows[0, 10].value_double == [0.5] and rows[0, 11].value_double == [0.25] and rows[0, 12].value_long == [-5] and rows[0, 13].value_long == [1 << 40]
    dirs = {r.ifd_no: r for r in containers.directories(containers.tiff_entries(df)).collect()}
    assert dirs[0].width == 40000 and dirs[0].subfile_type == 0 and dirs[2].subfile_type == 1
    kinds = {r.path: r.k for r in df.select("path", b.tiff_kind(F.col("content")).alias("k")).collect()}
    assert kinds == {"a": f"{'II' if order == '<' else 'MM'} {'big' if big else 'classic'}", "b": None, "c": None}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 120))
def test_damaged_files_end_quietly(noise, cut):
    whole = tiff(dirs=[[(256, 3, b"\1\0", 1), (257, 3, b"\1\0", 1)], [(256, 3, b"\1\0", 1), (257, 3, b"\1\0", 1)]])
    list(containers.entries(noise))
    list(containers.entries(b"II*\0\x08\0\0\0" + noise))
    assert len(list(containers.entries(whole[:cut]))) <= 4


def test_splice(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xd8TABLES\xff\xd9"), bytearray(b"\xff\xd8TILE\xff\xd9"), 6), (None, bytearray(b"\xff\xd8TILE\xff\xd9"), None)], "tables binary, tile binary, photo int")
    got = [bytes(r[0]) for r in df.select(b.spliced(F.col("tables"), F.col("tile"), F.col("photo"))).collect()]
    assert got[0] == b"\xff\xd8TABLES" + bytes.fromhex(b.ADOBE[6]) + b"TILE\xff\xd9" and got[1] == b"\xff\xd8TILE\xff\xd9"
    assert len(got[0]) == 8 + 10 - 4 + 16
    ends = spark.createDataFrame([(bytearray(b"\x0f\xfd\x90\xff\xd9tail\xff\xd9"),), (bytearray(b"none"),)], "c binary")
    assert [r[0] and bytes(r[0]) for r in ends.select(b.to_first_end(F.col("c"))).collect()] == [b"\x0f\xfd\x90\xff\xd9", None]


def ets(chunks, dims=6):
    extra = b"ETS\0" + struct.pack("<I7I", 1, 2, 3, 4, 2, 90, 512, 256) + struct.pack("<I", 1) + b"\0" * 68 + b"\7" * 40 + b"\0" * 4 + struct.pack("<I", 1)
    table = 64 + len(extra)
    head = b"SIS\0" + struct.pack("<IIIqIIqII", 64, 2, dims, 64, len(extra), 0, table, len(chunks), 0)
    body = b"".join(b"\0" * 4 + struct.pack(f"<{dims}i", *c) + struct.pack("<qiI", o, n, 0) for c, o, n in chunks)
    return head.ljust(64, b"\0") + extra + body


def test_tile_container(spark):
    chunks = [((1, 2, 0, 0, 0, 0), 5_000_000_000, 77), ((0, 0, 1, 0, 0, 3), 12, 8)]
    files = spark.createDataFrame([("/s/_a_/stack1/frame_t.ets", bytearray(ets(chunks))), ("/s/_b_/stack1/frame_t.ets", bytearray(ets([], 4))), ("/s/x", bytearray(b"zz"))], "path string, content binary")
    rows = sorted(containers.ets_chunks(files).collect(), key=lambda r: r.chunk_no)
    assert [(tuple(r.coord), r.offset, r.n_bytes) for r in rows] == chunks and (rows[0].tile_x, rows[0].tile_y, rows[0].compression, rows[0].pyramid) == (512, 256, 2, True)
    slides = spark.createDataFrame([("/s/a.vsi",), ("/s/c.vsi",)], "path string")
    found, missing = containers.pair_containers(slides, files.filter("path like '%.ets'"))
    assert [(r.slide, r.container, r.number) for r in found.collect()] == [("/s/a.vsi", "/s/_a_/stack1/frame_t.ets", 0)] and [r.slide for r in missing.collect()] == ["/s/c.vsi"]


def test_background_of_missing_tiles(spark, tmp_path):
    """Each container's own colour fills the tiles that it doesn't hold, read from contents and by ranges."""
    made = {"a": ets([((0, 0, 0, 0, 0, 0), 900, 4)]).replace(b"\7" * 40, bytes(range(40))), "b": ets([])}
    for name, data in made.items():
        (tmp_path / f"{name}.ets").write_bytes(data)
    for files in (spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary"), spark.createDataFrame([(str(tmp_path / f"{k}.ets"),) for k in made], "path string")):
        got = {os.path.basename(r.path)[0]: bytes(r.raster) for r in containers.background_tiles(files).collect()}
        assert got == {"a": bytes([0, 1, 2]) * 512 * 256, "b": b"\7\7\7" * 512 * 256}
    cells = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "path string, x int").join(containers.background_tiles(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")), "path")
    index = spark.createDataFrame([("a", 0, 0, bytearray(b"held"))], "path string, x int, k int, bytes binary")
    found = tiles.look_up(cells, index, ["path", "x"], ["bytes"], "k", {"bytes": F.col("raster")}).collect()
    assert {(r.path, r.x): (r.is_filler, bytes(r.bytes)[:3]) for r in found} == {("a", 0): (False, b"hel"), ("a", 1): (True, bytes([0, 1, 2])), ("b", 0): (True, b"\7\7\7")}


def test_written_file_reads_back(spark, tmp_path):
    payload = lambda s, lv, n: bytearray(f"{s}-{lv}-{n}".encode() * (n + 1))
    tiles = [(s, lv, n, payload(s, lv, n)) for s in ("a.tif", "sub/b.tif") for lv, count in ((0, 6), (1, 2), (2, 1)) for n in range(count)]
    images = [(s, lv, 1500 >> lv, 1000 >> lv, 512, 7 if lv == 0 else 8, 6 if s == "a.tif" or lv else None, 40_000_000, "<x/>odd" if lv == 0 and s == "a.tif" else None) for s in ("a.tif", "sub/b.tif") for lv in range(3)]
    t = spark.createDataFrame(tiles, "slide string, level int, tile_no long, bytes binary")
    i = spark.createDataFrame(images, "slide string, level int, width long, height long, tile int, compression int, photometric int, resolution long, packet string")
    report = bigtiff.write_files(bigtiff.layout(t, i), str(tmp_path)).collect()
    assert {r.path: os.path.getsize(tmp_path / r.path) for r in report} == {r.path: r.n_bytes for r in report} and len(report) == 2
    files = containers.scan(spark, str(tmp_path), "*.tif")
    dirs = containers.directories(containers.tiff_entries(files))
    got = {(r.path.split(str(tmp_path) + "/")[1], r.ifd_no): r for r in dirs.collect()}
    assert {k: (r.width, r.height, r.compression, r.photometric, r.subfile_type) for k, r in got.items()} == {(s, lv): (w, h, c, p, int(lv > 0)) for s, lv, w, h, _, c, p, _, _ in images}
    assert bytes(got["a.tif", 0].packet) == b"<x/>odd" and got["sub/b.tif", 0].packet is None
    for r in containers.tile_index(dirs).collect():
        name = r.path.split(str(tmp_path) + "/")[1]
        with open(tmp_path / name, "rb") as f:
            f.seek(r.offset)
            assert f.read(r.n_bytes) == bytes(payload(name, r.ifd_no, r.tile_no))


def test_failed_file_is_a_row(spark, tmp_path):
    parts = spark.createDataFrame([("good.tif", 0, bytearray(b"ab")), ("gone.tif", 0, bytearray(b"a")), ("gone.tif", 1, None), ("way/x.tif", 0, bytearray(b"x"))], "slide string, offset long, bytes binary")
    (tmp_path / "way").write_text("a file where a folder should be")
    rows = {r.path: r for r in bigtiff.write_files(parts, str(tmp_path)).collect()}
    assert rows["good.tif"].error is None and rows["good.tif"].n_bytes == 2 and rows["good.tif"].seconds >= 0
    assert "no bytes" in rows["gone.tif"].error and rows["way/x.tif"].error and rows["way/x.tif"].n_bytes is None
    assert sorted(os.listdir(tmp_path)) == ["good.tif", "way"]


def test_text_with_several_end_marks(spark):
    data = tiff(dirs=[[(270, 2, b"one\0two\0", 8), (271, 2, b"abc\0", 4), (272, 2, b"open", 4)]])
    rows = {r.tag: r for r in containers.tiff_entries(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).collect()}
    assert rows[270].value_strings == ["one", "two"] and rows[270].value_string == "one\ntwo"
    assert rows[271].value_strings is None and rows[271].value_string == "abc" and rows[272].value_string == "open"


def test_large_private_values_are_left(spark):
    data = tiff(dirs=[[(320, 3, b"\1\0" * 9, 9), (40000, 1, b"\1" * 9, 11_000_000), (256, 3, b"\5\0", 1)]])
    df = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    assert {r.tag: r.value_long for r in containers.tiff_entries(df).collect()} == {320: None, 40000: None, 256: [5]}
    assert {r.tag: r.value_long for r in containers.tiff_entries(df, (320,)).collect()} == {320: [1] * 9, 40000: None, 256: None}


def test_packet(spark):
    row = spark.range(1).select(bigtiff.packet(F.lit("u"), {"Manufacturer": F.lit("A & <B>"), "ImageComments": F.lit(None)}, F.lit("2"), F.lit("3")).alias("p")).first()
    assert "<DICOM:Manufacturer>A &amp; &lt;B&gt;</DICOM:Manufacturer>" in row.p and "ImageComments" not in row.p and row.p.index("<rdf:first>2<") < row.p.index("<rdf:first>3<")
