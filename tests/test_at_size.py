"""What plans of queries over large tables must not do, and results on rows that small tables don't have."""

import re

from pyspark.sql import functions as F

from lamella.functions import binary
from lamella.operators import tiles
from lamella.plans import batch, queries, queries_blocks, queries_more
from lamella.plans.queries import QUERIES
from lamella.sources import containers

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_as_large_as_its_tiles_is_not_broadcast(spark):
    df = QUERIES["tile_lookup"](spark, SF)
    assert "Broadcast" not in plan_of(df) and plan_of(df).count("SortMergeJoin") == 1
    few = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "path string, x long")
    index = spark.createDataFrame([("a", 1, 5, 70), ("a", 1, 4, 71)], "path string, x long, k int, at long")
    for tasks in (None, 3):
        found = tiles.look_up(few, index, ["path", "x"], ["at"], "k", {"at": -1}, tasks)
        assert "Broadcast" not in plan_of(found)
        assert sorted(map(tuple, found.collect())) == [("a", 0, True, -1), ("a", 1, False, 71), ("b", 0, True, -1)]


def test_regions_are_cut_without_broadcasting_files(spark):
    plan = plan_of(QUERIES["strip_region"](spark, SF))
    assert "Broadcast" not in plan and plan.count("Join") == 1
    assert "Join" not in plan_of(QUERIES["block_index"](spark, SF))


def test_slides_with_one_destination_have_rows_of_their_own(spark, tmp_path):
    """Four pages of one URL: three go to one place and each has its own output or none, one is no slide."""
    urls = [(0, "http://a.org/x"), (1, "http://a.org/x"), (4, "http://a.org/x"), (7, "http://a.org/x")]
    spark.createDataFrame([(i, u, "") for i, u in urls], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.path[-4:], r.collides, r.exists, r.delete_first, r.convert) for r in QUERIES["convert_plan"](spark, str(tmp_path)).collect())
    assert got == [(".VSI", True, True, False, False), (".svs", True, False, False, True), (".svs", True, True, False, False)]
    files = spark.createDataFrame([("/s/a.svs",)], "path string")
    there = spark.createDataFrame([("/o/a.tif", True), ("/o/a.tif", False)], "dest string, valid boolean")
    rows = batch.plan(files, there, batch.Parameters("/s", "/o", retry=True)).collect()
    assert [(r.exists, r.delete_first) for r in rows] == [(True, True)]


def test_tiles_are_made_by_many_tasks_and_grouped_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TASK_TILES", 2_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("quadrant_merge", "file_offsets", "tile_grid"):
            df = QUERIES[name](spark, SF)
            assert plan_of(df).count("Exchange hashpartitioning") == 1 and df.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_costly_rows_are_dealt_before_they_are_made(spark, monkeypatch):
    for module in (queries, queries_blocks, queries_more):
        monkeypatch.setattr(module, "TASK_ROWS", 50)
    for name in ("ets_chunks", "container_background", "imagej_comment", "meta_hygiene"):
        above, below = plan_of(QUERIES[name](spark, SF)).split("Exchange RoundRobinPartitioning(4)")
        assert not any(x in below for x in ("Filter (", "hex", "regexp", "concat")), name


def test_little_endian_columns_need_no_lambda(spark):
    row = spark.range(1).select(*(containers.little(F.unhex(F.lit("FF0102030405060780")), F.lit(k), n).alias(f"x{k}_{n}") for k, n in ((0, 4), (0, 8), (5, 4), (7, 4))), binary.little_bytes(F.lit(-2), 4).alias("b"))
    assert tuple(row.first()) == (0x030201FF, 0x07060504030201FF, 0x80070605, 0x8007, bytearray(b"\xfe\xff\xff\xff"))
    assert "lambda" not in row._jdf.queryExecution().analyzed().toString()


def test_series_are_ruled_in_one_dealing_of_files(spark, monkeypatch):
    monkeypatch.setattr(queries_blocks, "TASK_LINES", 500)
    plan = plan_of(QUERIES["tiff_series"](spark, SF))
    assert "Broadcast" not in plan and set(re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", plan)) == {"path"} and "ENSURE_REQUIREMENTS" not in plan
