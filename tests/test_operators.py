"""Column functions and operators against plain Python, and plans for what they must not do."""

import math

import pytest
from pyspark.sql import functions as F

from lamella.functions import binary as b
from lamella.functions import geometry as g
from lamella.functions import metadata as m
from lamella.operators import pyramid, series, tiles
from lamella.plans import batch
from lamella.plans import queries_more  # noqa: F401
from lamella.plans.queries import QUERIES, SQL

SIZES = [(1, 1), (255, 256), (257, 1), (512, 513), (100_000, 80_001), (46_000, 32_914), (2**29, 3)]


def test_levels_follow_the_recurrence(spark):
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(SIZES)], "id long, w long, h long")
    got = {(r.slide, r.level): tuple(r)[2:] for r in tiles.levels(df, "id", "w", "h", 256).collect()}
    for i, (w, h) in enumerate(SIZES):
        x, y = -(-w // 256), -(-h // 256)
        depth = math.ceil(math.log(max(w, h)) / math.log(2)) - math.ceil(math.log(256) / math.log(2)) + 2
        for level in range(max(1, depth)):
            assert got.pop((i, level)) == (w, h, x, y, x * y)
            w, h, x, y = (w + 1) // 2, (h + 1) // 2, (x + 1) // 2, (y + 1) // 2
    assert not got


def test_grid_covers_each_pixel_once(spark):
    df = spark.createDataFrame([(0, 700, 513), (1, 1, 1)], "id long, w long, h long")
    rows = tiles.grid(df, "id", "w", "h", 256).collect()
    for i, (w, h) in enumerate(((700, 513), (1, 1))):
        mine = sorted((r for r in rows if r.slide == i), key=lambda r: r.tile_no)
        assert sum(r.w * r.h for r in mine) == w * h and [r.tile_no for r in mine] == list(range(len(mine)))


def test_region_is_covered_once(spark):
    df = spark.createDataFrame([(0, 700, 513)], "id long, w long, h long")
    rows = tiles.region_parts(tiles.grid(df, "id", "w", "h", 256), 100, 200, 500, 300).collect()
    cells = [(r.dst_x + i, r.dst_y + j) for r in rows for i in range(0, r.part_w, 10) for j in range(0, r.part_h, 10)]
    assert sum(r.part_w * r.part_h for r in rows) == 500 * 300 and len(set(cells)) == len(cells)
    assert all(0 <= r.src_x and r.src_x + r.part_w <= 256 and 0 <= r.dst_x and r.dst_x + r.part_w <= 500 for r in rows)


def test_offsets_are_contiguous(spark):
    df = spark.createDataFrame([("a", n, n * 7 % 5) for n in range(40)], "slide string, tile_no long, n long")
    rows = sorted(tiles.file_offsets(df, "slide", ["tile_no"], "n").collect(), key=lambda r: r.tile_no)
    assert rows[0].offset == 16 and all(y.offset == x.offset + x.n for x, y in zip(rows, rows[1:], strict=False))


def test_half_scale_against_python(spark):
    values = [[(i * 37 + k * 91) % 256 for k in range(64)] for i in range(5)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v array<long>")
    got = {(r.raster, r.level, r.x, r.y): r.value for r in pyramid.pyramid(pyramid.pixels(df, "id", "v", 8), ["raster"], 3).collect()}
    r = lambda a, c: (a + c + 1) // 2
    for i, v in enumerate(values):
        at = {(k % 8, k // 8): x for k, x in enumerate(v)}
        for level in range(4):
            assert all(got[i, level, x, y] == value for (x, y), value in at.items())
            at = {(x, y): r(r(at[2 * x, 2 * y], at[2 * x, 2 * y + 1]), r(at[2 * x + 1, 2 * y], at[2 * x + 1, 2 * y + 1])) for x in range(8 >> (level + 1)) for y in range(8 >> (level + 1))}


def test_pyramid_shuffles_once(spark):
    """The exchange is planned for each level, and at run time all but one are reused."""
    df = spark.createDataFrame([(1, [0] * 64)], "id long, v array<long>")
    made = pyramid.pyramid(pyramid.pixels(df, "id", "v", 8), ["raster"], 3)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1 and "ReusedExchange" in plan


def test_choices_do_not_sort(spark):
    df = spark.createDataFrame([("a", 5, 0), ("a", 9, 1), ("a", 9, 2), ("b", 1, 0)], "s string, w long, i long")
    best = series.largest_series(df, "s", "w", "i")
    assert sorted(map(tuple, best.collect())) == [("a", 9, 1, 3), ("b", 1, 0, 1)]
    cells = spark.createDataFrame([("a", 0, 0), ("a", 1, 0)], "s string, x long, y long")
    index = spark.createDataFrame([("a", 0, 0, 7, 70), ("a", 0, 0, 3, 30)], "s string, x long, y long, k long, at long")
    found = tiles.look_up(cells, index, ["s", "x", "y"], ["at"], "k", {"at": -1})
    assert sorted(map(tuple, found.collect())) == [("a", 0, 0, False, 30), ("a", 1, 0, True, -1)]
    for df_ in (best, found):
        assert "SortAggregate" not in df_._jdf.queryExecution().executedPlan().toString()


def test_label_and_macro_move(spark):
    """One label and one macro at most; words move them, and only a null comment is bare."""
    cases = [
        ([None, None, None], ["label", "macro", "level"]),
        (["x", "A label|y", "again label"], ["level", "level", "label"]),
        ([None, "the label", None], ["level", "label", "macro"]),
        (["Title=label", "", None], ["level", "level", "label"]),
        (["macro", None, None, None], ["macro", "label", "level", "level"]),
        (["label and macro", "a\nMacro", None], ["label", "macro", "level"]),
        (["label", "z", None, None], ["label", "level", "macro", "level"]),
    ]
    df = spark.createDataFrame([(k, i, c) for k, (cs, _) in enumerate(cases) for i, c in enumerate(cs)], "s long, i long, c string")
    got = {(r.s, r.i): r.kind for r in series.classify(df, "s", "i", "c").collect()}
    assert [[got[k, i] for i in range(len(cs))] for k, (cs, _) in enumerate(cases)] == [want for _, want in cases]


def test_counts_of_strips(spark):
    df = spark.createDataFrame([([5, 6], 100, 2, True, None, 10), ([5, 6], 100, 2, True, 5, 10), (None, 101, 2, True, 3, 10), (None, 101, 2, False, None, 10)], "c array<long>, p long, n long, lzw boolean, r long, h long")
    assert [r.byte_counts for r in tiles.strip_counts(df, "c", "p", "n", "lzw", "r", "h").collect()] == [[10, 12], [5, 6], [100, 100], [50, 50]]


@pytest.mark.parametrize("order", ["XYZCT", "XYZTC", "XYCZT", "XYCTZ", "XYTCZ", "XYTZC"])
def test_plane_numbers_invert(spark, order):
    n = F.col("id")
    z, c, t = F.lit(3), F.lit(2), F.lit(4)
    at = g.plane_coordinates(n, order, z, c, t)
    df = spark.range(24).select("id", *(x.alias(k) for k, x in at.items()))
    assert df.filter(g.plane_index(order, F.col("z"), F.col("c"), F.col("t"), z, c, t) != F.col("id")).isEmpty() and df.select("z", "c", "t").distinct().count() == 24


def test_ets_size(spark):
    df = spark.createDataFrame([(101, 200), (101, 50), (100, 200), (100, 30)], "s long, e long")
    assert [r[0] for r in df.select(g.ets_level_size(F.col("s"), F.col("e"))).collect()] == [51, 50, 50, 30]


def test_actions_by_cases(spark):
    cases = {(0, 0, 0, 0, 0, 0): (0, 1, 0), (0, 0, 0, 0, 0, 1): (0, 0, 0), (1, 1, 1, 0, 0, 0): (1, 1, 0), (1, 1, 1, 0, 0, 1): (1, 0, 0), (1, 0, 0, 1, 1, 0): (1, 1, 1), (1, 0, 0, 1, 0, 1): (1, 0, 0), (1, 1, 0, 1, 0, 1): (0, 0, 1), (1, 1, 0, 0, 1, 0): (0, 0, 1), (1, 0, 0, 0, 0, 1): (0, 0, 0)}
    df = spark.createDataFrame([tuple(map(bool, k)) for k in cases], "e boolean, v boolean, o boolean, r boolean, va boolean, vo boolean")
    got = df.select(*(c.alias(n) for n, c in batch.actions(*(F.col(c) for c in ("e", "v", "o", "r", "va", "vo"))).items())).collect()
    assert [tuple(map(int, r)) for r in got] == list(cases.values())


def test_plan_reports_collisions(spark):
    files = spark.createDataFrame([("/in/a.svs",), ("/in/a.vsi",), ("/in/d/B.TIF",), ("/in/c.png",)], "path string")
    there = spark.createDataFrame([("/out/d/B.tif", True)], "dest string, valid boolean")
    rows = {r.path: r for r in batch.plan(files, there, batch.Parameters("/in", "/out", retry=True)).collect()}
    assert set(rows) == {"/in/a.svs", "/in/a.vsi", "/in/d/B.TIF"} and rows["/in/a.svs"].collides and not rows["/in/d/B.TIF"].convert and rows["/in/a.vsi"].reader == "vsi"


def test_gate_and_photometric(spark):
    df = spark.createDataFrame([("JPEG", "vsi", None, 2), (None, "svs", [2, 2], 2), ("LZW", "svs", [2, 1], 6), ("JPEG", "svs", None, 2)], "c string, k string, s array<int>, p int")
    ok, note = batch.compression_gate(F.col("c"))
    photo, sub = batch.photometric(F.col("k"), F.col("s"), F.col("p"))
    assert [tuple(r) for r in df.select(ok, note.isNull(), photo, sub).collect()] == [(True, True, 6, [1, 1]), (True, False, 2, None), (False, False, None, [2, 1]), (True, True, 6, [1, 1])]


def test_valid_outputs(spark):
    df = spark.createDataFrame([("a", 0, 5000, 4000), ("a", 1, 1024, 800), ("b", 0, 1025, 10), ("c", 0, 0, 10), ("d", 0, 9, None)], "f string, i int, w int, h int")
    assert {r.f: r.valid for r in batch.valid_outputs(df, "f", "i", "w", "h").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_metadata_text(spark):
    df = spark.createDataFrame([("[head]\na = b=c\nd: e\nplain\n k =v ",)], "c string").withColumn("id", F.lit(1))
    assert [tuple(r)[2:] for r in m.colon_or_equals_pairs(df, "c", ["id"]).collect()] == [("a", "b=c"), ("d", "e"), ("k", "v")]
    first, rest = m.split_artist(F.col("a"))
    names = spark.createDataFrame([("Ada  Lovelace King",), ("Plato",), (" Plato",)], "a string")
    assert [tuple(r) for r in names.select(first, rest).collect()] == [("Ada", " Lovelace King"), (None, "Plato"), ("", "Plato")]
    pairs = spark.createDataFrame([(" k ", "v&amp;1 <b>"), ("k", None), ("9", "x"), ("k2", "--"), ("k3", "y" * 9000), ("<k4>&", "a &lt;c\x07\u00e9"), ("&lt;", "x"), ("k5", " <> ")], "k string, v string")
    assert [tuple(r) for r in m.clean_pairs(pairs, "k", "v").collect()] == [("k", "v1 b"), ("k2", "--"), ("k4", "a c")]
    # one text in each pattern, a fraction of a second, and text that is no date
    forms = ["2020:01:02 03:04:05", "02/01/2020 03:04:05", "01/02/2020 03:04:05 AM", "20200102 03:04:05", "2020/01/02 03:04:05", "2020-01-02T03:04:05+0000", "2020:01:02 03:04:05.5", "2021-05-06", "junk"]
    dates = spark.createDataFrame([(x,) for x in forms], "d string")
    assert [str(r[0]) for r in dates.select(m.first_date(F.col("d"))).collect()] == ["2020-01-02 03:04:05"] * 6 + ["2020-01-02 03:04:05.500000", "None", "None"]
    units = spark.createDataFrame([("ImageJ=1\nunit=micron\nx",), ("none",)], "c string")
    assert [r[0] for r in units.select(m.unit_of(F.col("c"))).collect()] == ["micron", None]
    assert [r[0] for r in spark.sql("select cast('40.000' as decimal(9,3)) d union all select cast('0.250' as decimal(9,3)) union all select cast(100 as decimal(9,3))").select(m.plain_number(F.col("d"))).collect()] == ["40", "0.25", "100"]


def test_samples(spark):
    bits = spark.range(256).select("id", b.reversed_bits(F.col("id")).alias("r"))
    assert all(r.r == int(f"{r.id:08b}"[::-1], 2) for r in bits.collect())
    df = spark.createDataFrame([(8, 1), (12, 1), (24, 1), (24, 3), (16, 2), (64, 3)], "b int, f int")
    assert [r[0] for r in df.select(b.pixel_type(F.col("b"), F.col("f"))).collect()] == ["uint8", "uint16", "uint32", "float", "int16", "double"]
    rgb = spark.createDataFrame([(128, 128, 128), (255, 255, 255)], "y int, b int, r int").select(*b.ycbcr_to_rgb(F.col("y"), F.col("b"), F.col("r"))).collect()
    assert [tuple(r) for r in rgb] == [(128, 128, 128), (255, 120, 255)]
    dark = spark.createDataFrame([(10, 0, 0), (0, 255, 255), (200, 128, 130)], "y int, b int, r int").select(*b.ycbcr_to_rgb(F.col("y"), F.col("b"), F.col("r"))).collect()
    assert [tuple(r) for r in dark] == [(10, 10, 10), (178, 122, 225), (202, 198, 200)]  # chroma below the middle counts as the middle, and -134 is 122


def test_series_lists(spark):
    df = spark.createDataFrame([("a", "0, 2,x,9", 3)], "f string, s string, n long")
    assert [r.series for r in series.asked_series(df, "s", "n").collect()] == [0, 2]
    images = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("b", 0, 1)], "f string, i int, t int")
    assert {(r.f, r.i): r.is_thumbnail for r in series.thumbnails(images, "f", "t").collect()} == {("a", 0): True, ("a", 1): False, ("b", 0): False}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 70


def test_narrow_floats(spark):
    import struct

    df = spark.createDataFrame([(i,) for i in (0, 1, 0x3C00, 0xC500, 0x7BFF, 0x0400, 0x8001, 0x7C00)], "v long")
    want = [struct.unpack("<e", struct.pack("<H", r[0]))[0] for r in df.collect()]
    assert [r[0] for r in df.select(b.narrow_float(F.col("v"), 16)).collect()] == want
    assert spark.range(1).select(b.narrow_float(F.lit((63 << 16) | (1 << 15)), 24)).first()[0] == 1.5


def test_sample_orders(spark):
    row = spark.range(1).select(b.interleaved(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).alias("i"), b.planar(F.array(*map(F.lit, (1, 3, 2, 4))), 2).alias("p"), b.palette(F.array(*map(F.lit, (300, 7, 65535, 1, 2, 3))), 8).alias("t")).first()
    assert row.i == [1, 3, 2, 4] and row.p == [[1, 2], [3, 4]] and row.t == [[1, 7], [255, 1], [2, 3]]
    strips = spark.createDataFrame([([9, 9], 0, 5), (None, 0, 7), (None, 3, 7)], "g array<long>, t long, h long")
    assert [r[0] for r in strips.select(b.rows_per_strip(F.col("g"), F.col("t"), F.col("h"))).collect()] == [5, 7, 3]
    assert [bytes(x) for x in spark.createDataFrame([(bytearray(b"-ab.cd.ef."),)], "c binary").select(b.plane_rows(F.col("c"), F.lit(1), F.lit(2), F.lit(3), F.lit(1))).first()[0]] == [b"ab", b"cd", b"ef"]


def test_reading_sizes(spark):
    df = spark.createDataFrame([(0, 100, 50), (20_000, 20_000, 20_000), (256, 256, 900), (1, 900, 5)], "th long, tw long, h long")
    assert [r[0] for r in df.select(g.optimal_tile_height(F.col("th"), F.col("tw"), F.col("h"), F.lit(60_000))).collect()] == [50, 17, 256, 5]
    sizes = spark.createDataFrame([(1000, 500), (100, 90), (300, 600)], "w long, h long")
    assert [tuple(r) for r in sizes.select(*g.thumbnail(F.col("w"), F.col("h"))).collect()] == [(128, 64), (100, 90), (64, 128)]
    assert tuple(spark.range(1).select(*g.rgb_channels(F.lit(6), F.lit(8), F.lit(2), F.lit(2))).first()) == (2, 3)
    assert spark.range(1).select(g.tile_or(F.lit(0), F.lit(9))).first()[0] == 9


def test_directories(spark):
    from lamella.operators import directories as d

    entries = spark.createDataFrame([("a", 1, 0, 270, "x"), ("a", 0, 3, 270, "y"), ("a", 0, 5, 270, "z")], "path string, ifd_no int, entry_no int, tag int, value_string string")
    assert [tuple(r) for r in d.first_entry(entries, 270, "value_string").collect()] == [("a", "y")]
    assert [tuple(r) for r in d.first_entry(entries, 270, "value_string", entries.select("path").distinct()).collect()] == [("a", "y")]
    with pytest.raises(Exception, match="no entry of tag 271 in a"):
        d.first_entry(entries, 271, "value_string", entries.select("path").distinct()).collect()
    main = spark.createDataFrame([("a", 0, 10, [70, 60]), ("a", 1, 20, None)], "path string, ifd_no int, offset long, sub_offsets array<long>")
    subs = spark.createDataFrame([("a", 60), ("a", 70), ("a", 99)], "path string, offset long")
    assert [(r.pos, r.offset, r.is_sub) for r in d.with_sub_directories(main, subs).orderBy("pos").collect()] == [(0, 10, False), (1, 20, False), (2, 70, True), (3, 60, True)]
    series_rows = spark.createDataFrame([("a", 0, 100, 100, "u8"), ("a", 1, 50, 50, "u8"), ("a", 2, 0, 10, "u8")], "path string, r int, width long, height long, pixel_type string")
    assert [r.r for r in d.smallest_usable(series_rows, "path", "r", "width", "height").collect()] == [1]
    assert d.split_series(series_rows, "path").first().separate
    lenses = spark.createDataFrame([("a", 1, 0, "o1", 40), ("a", 0, 1, "o1", 20)], "path string, instrument int, position int, objective_id string, magnification int")
    images = spark.createDataFrame([("a", "o1"), ("a", "none")], "path string, objective_id string")
    found = d.image_metadata(d.objective_of(images, lenses)).orderBy("objective_id").collect()
    assert [r.magnification for r in found] == [None, 20] and found[1].image_meta.objective.objective_id == "o1" and found[1].image_meta.acquired is None
