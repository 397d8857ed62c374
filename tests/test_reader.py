"""The data source of directory entries: the rows of ``tiff_entries``, with filters pushed."""

import struct

import pytest
from pyspark.sql import functions as F

from lamella.plans import convert
from lamella.sources import containers, reader
from tests.test_convert import COMMENT, image, jpeg, slide


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    both = [(image(100, 60, 64, COMMENT), [jpeg("a"), jpeg("b")]), (image(50, 30, 64, "second"), [jpeg("c")]), (image(9, 9, 64), [jpeg("d")])]
    (tmp_path / "a.svs").write_bytes(slide(both))
    (tmp_path / "deep" / "er" / "b.tif").write_bytes(slide(both[:2], ">"))
    (tmp_path / "noise.tif").write_bytes(b"no slide")
    (tmp_path / "loop.tif").write_bytes(b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 7) * 2 + struct.pack("<I", 8))
    return tmp_path


def rows(df):
    return sorted((r.path, r.ifd_no, r.entry_no, r.tag, r["count"], r.value_long, r.value_string) for r in df.collect())


def test_same_rows_as_entries(spark, folder):
    reader.register(spark)
    got = spark.read.format("slide").load(str(folder))
    assert rows(got) == rows(containers.tiff_entries(convert.listing(spark, str(folder)))) and got.count() > 40
    one = spark.read.format("slide").option("tags", "256,270").load(f"file://{folder}/a.svs")
    assert rows(one) == rows(containers.tiff_entries(convert.listing(spark, str(folder / "a.svs")), (256, 270)))


def test_filters_are_pushed(spark, folder):
    reader.register(spark)
    whole = spark.read.format("slide").load(str(folder))
    asked = whole.filter(F.col("tag").isin(256, 270) & (F.col("ifd_no") == 1) & F.col("value_string").isNotNull())
    plan = asked._jdf.queryExecution().executedPlan().toString()
    left = plan.split("BatchScan")[0]
    assert "tag" not in left.split("Filter")[-1].split("\n")[0] and "value_string" in left
    assert rows(asked) == [r for r in rows(containers.tiff_entries(convert.listing(spark, str(folder)))) if r[1] == 1 and r[3] == 270]
    assert rows(whole.filter(F.col("path") == str(folder / "a.svs")).filter("ifd_no in (0, 2)").filter("ifd_no = 2")) == [r for r in rows(whole) if r[0].endswith("a.svs") and r[1] == 2]


def test_what_is_not_asked_for_is_not_read(folder):
    """A chain ends behind the directories asked for, and other files aren't opened."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    r = reader.EntryReader(str(folder), None)
    assert list(r.pushFilters([EqualTo(("path",), str(folder / "a.svs")), In(("ifd_no",), (0,)), GreaterThan(("tag",), 300)])) == [GreaterThan(("tag",), 300)]
    parts = r.partitions()
    assert [p.paths for p in parts] == [[str(folder / "a.svs")]]
    raw = (folder / "a.svs").read_bytes()
    (folder / "a.svs").write_bytes(raw[: raw.rindex(b"second") - 100])  # the second directory is gone
    assert {x["ifd_no"] for b in r.read(parts[0]) for x in b.to_pylist()} == {0}
