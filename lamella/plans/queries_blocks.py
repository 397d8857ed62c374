"""Registered queries of blocks and of rasters, over images derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions.binary import little_bytes
from lamella.operators import blocks, rasters
from lamella.operators import pyramid as p
from lamella.plans.queries import SQL, TASK_ROWS, query, read
from lamella.sources import containers, slides
from lamella.sources.steps import spread

#: Directories whose files are ruled by one task.
TASK_LINES = 250_000

IMAGES_SQL = """
d AS (
  SELECT 'p' || p_partkey AS path, p_partkey AS k, 20 + p_size AS width, 10 + p_partkey % 30 AS height, CASE WHEN p_partkey % 6 = 1 THEN 16 ELSE 8 END AS bits,
    CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS samples, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END AS planar, p_partkey % 3 = 0 AS tiled,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 7 + 1 END AS rps, CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE 1 END AS compression FROM part
), b AS (
  SELECT *, CASE WHEN tiled THEN 16 ELSE width END AS bw, CASE WHEN tiled THEN 16 ELSE least(coalesce(rps, height), height) END AS bh,
    CASE WHEN planar = 2 THEN samples ELSE 1 END AS planes FROM d
), n AS (
  SELECT *, (width + bw - 1) // bw AS across, (height + bh - 1) // bh AS down FROM b
), given AS (
  SELECT *, across * down * planes - CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS told FROM n
)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory for each part: tiled or in strips, of one or several planes, with and without byte counts; some tell one block too few."""
    k, c = F.col("p_partkey"), F.col
    d = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("path"), F.lit(0).alias("ifd_no"), k.alias("k"), (20 + c("p_size")).cast("long").alias("width"), (10 + k % 30).alias("height"),
        F.when(k % 6 == 1, 16).otherwise(8).cast("long").alias("bits"), F.when(k % 2 == 0, 3).otherwise(1).cast("long").alias("samples"), F.when(k % 4 == 0, 2).otherwise(1).cast("long").alias("planar"),
        F.when(k % 3 == 0, 16).cast("long").alias("tile_width"), F.when(k % 3 == 0, 16).cast("long").alias("tile_height"),
        F.when(k % 11 != 0, k % 7 + 1).alias("rows_per_strip"), F.when(k % 5 == 0, 5).otherwise(1).cast("long").alias("compression"),
    )
    across = F.when(c("tile_width").isNull(), 1).otherwise(F.ceil(c("width") / 16))
    down = F.ceil(c("height") / F.when(c("tile_width").isNotNull(), 16).otherwise(F.least(F.coalesce("rows_per_strip", "height"), "height")))
    told = across * down * F.when(c("planar") == 2, c("samples")).otherwise(1) - F.when(c("k") % 13 == 0, 1).otherwise(0)
    places = F.when(told > 0, F.sequence(F.lit(0).cast("long"), told - 1)).otherwise(F.array().cast("array<bigint>"))
    at = F.transform(places, lambda i: F.when(i == 3, i - 100).otherwise(i * 1000 + c("k")))  # a negative one is unsigned
    counts = F.when(c("k") % 7 != 0, F.transform(places, lambda i: 50 + i))
    tiled = c("tile_width").isNotNull()
    return d.select("*", F.when(tiled, at).alias("offsets"), F.when(~tiled, at).alias("strip_offsets"), F.when(tiled, counts).alias("byte_counts"), F.when(~tiled, counts).alias("strip_counts"))


@query(f"""
WITH {IMAGES_SQL}, g AS (
  SELECT *, unnest(range(0, across * down * planes)) AS block_no FROM given WHERE tiled OR told >= down * planes
), z AS (
  SELECT *, block_no // (across * down) AS plane, block_no % (across * down) % across * bw AS x, block_no % (across * down) // across * bh AS y,
    CASE WHEN compression = 5 AND (rps IS NULL OR height % least(rps, height) <> 0) THEN 2 ELSE 1 END AS times FROM g
)
SELECT path, plane, block_no, x, y, least(bw, width - x) AS w, least(bh, height - y) AS h, bw AS block_w,
  CASE WHEN block_no >= told THEN NULL WHEN block_no = 3 THEN 4294967199 ELSE block_no * 1000 + k END AS offset,
  CASE WHEN block_no >= told THEN NULL WHEN k % 7 = 0 THEN width * height * (bits // 8) * samples // told * times ELSE (50 + block_no) * times END AS n_bytes
FROM z""")
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips and tiles in one index."""
    return blocks.block_index(_images(spark, sf_dir)).drop("ifd_no")


@query(f"""
WITH {IMAGES_SQL}
SELECT path, 'offsets: ' || told || ' of ' || down * planes || ' strips' AS error FROM given WHERE NOT tiled AND told < down * planes""")
def block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_errors(_images(spark, sf_dir)).select("path", "error")


@query("""
WITH d AS (
  SELECT 'p' || p_partkey AS path, p_partkey % 4 + 1 AS rps, 8 + p_size % 9 AS width, 3 + p_partkey % 9 AS height, repeat(p_name || p_partkey || '.', 300) AS content FROM part
), r AS (
  SELECT *, (height + rps - 1) // rps AS strips, unnest(range(1, least(7, height))) AS y FROM d
), z AS (
  SELECT *, (strips - 1 - y // rps) * width * rps + y % rps * width + 2 AS spot FROM r
)
SELECT path, CAST(y - 1 AS BIGINT) AS row, substr(content, CAST(spot + 1 AS INT), CAST(least(7, width - 2) AS INT)) AS pixels FROM z""")
def strip_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of images whose strips lie in the file in reverse order, cut from the file's bytes by ranges."""
    k = F.col("p_partkey")
    word = F.concat("p_name", k.cast("string"), F.lit("."))
    d = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), F.lit(0).alias("ifd_no"), (k % 4 + 1).alias("rows_per_strip"), (8 + F.col("p_size") % 9).cast("long").alias("width"), (3 + k % 9).alias("height"), word.alias("word"))
    d = spread(d, 50_000, "path")
    strips = F.ceil(F.col("height") / F.col("rows_per_strip"))
    size = F.col("width") * F.col("rows_per_strip")
    none = F.lit(None).cast("array<bigint>")
    one = {"bits": 8, "samples": 1, "planar": 1, "compression": 1, "tile_width": None, "tile_height": None}
    d = d.withColumns({n: F.lit(v).cast("long") for n, v in one.items()} | {"offsets": none, "byte_counts": none})
    d = d.withColumns({"strip_offsets": F.transform(F.sequence(F.lit(1).cast("long"), strips), lambda i: (strips - i) * size), "strip_counts": F.transform(F.sequence(F.lit(1).cast("long"), strips), lambda i: size)})

    def cut(ranges: DataFrame) -> DataFrame:
        """A file's bytes are made only where a range of it is cut, so no table of files is broadcast or shuffled."""
        held = ranges.join(d.select("path", "word").hint("merge"), "path")
        content = F.repeat("word", F.lit(300))
        return held.withColumn("bytes", F.encode(F.substring(content, (F.col("offset") + 1).cast("int"), F.col("n_bytes").cast("int")), "UTF-8")).drop("word")

    return blocks.region(d.drop("word"), 2, 1, 7, 6, cut).select("path", "row", F.decode("bytes", "UTF-8").alias("pixels"))


@query(f"SELECT * FROM ({SQL['pyramid_levels']}) WHERE level > 0")
def raster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels that ``pyramid_levels`` makes from pixels, from tiles of two by two samples."""
    value = lambda i: p.quantised(F.get("embedding", i), -0.6, 0.6)
    hexed = lambda i: F.lpad(F.hex(value(i)), 2, "0")
    places = F.array(*(F.struct(F.lit(x).alias("tile_x"), F.lit(y).alias("tile_y"), F.unhex(F.concat(*(hexed(F.lit((2 * y + j) * 8 + 2 * x + i)) for j in (0, 1) for i in (0, 1)))).alias("raster")) for y in range(4) for x in range(4)))
    tiles = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide"), F.inline(places))
    made = rasters.levels(tiles, 3, 2)
    at = F.sequence(F.lit(0), F.lit(3))
    each = made.select("slide", "level", "tile_x", "tile_y", F.posexplode(F.transform(at, lambda i: F.conv(F.hex(F.substring("raster", i + 1, F.lit(1))), 16, 10).cast("long"))).alias("i", "value"))
    each = each.select(F.col("slide").alias("raster"), (F.col("tile_x") * 2 + F.col("i") % 2).alias("x"), (F.col("tile_y") * 2 + F.floor(F.col("i") / 2)).alias("y"), "value", "level")
    inside = F.when(F.col("level") == 1, 4).when(F.col("level") == 2, 2).otherwise(1)
    return each.filter((F.col("x") < inside) & (F.col("y") < inside))


@query("""
WITH d AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
    CASE WHEN l_orderkey % 3 = 0 THEN 9 ELSE 5 + l_linenumber % 2 END AS w, l_orderkey % 5 = 0 AND l_linenumber % 4 = 3 AS reduced FROM lineitem
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS no FROM (SELECT *, count(*) OVER (PARTITION BY k) AS listed FROM d) WHERE NOT reduced OR listed = 1
), ruled AS (
  SELECT *, count(DISTINCT w) OVER (PARTITION BY k) > 1 AS apart FROM kept
)
SELECT k::VARCHAR AS path, CASE WHEN apart THEN no ELSE 0 END AS series, CASE WHEN apart THEN 0 ELSE no END AS plane, CAST(i AS INT) AS ifd_no FROM ruled""")
def tiff_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes and series of files with a directory for each line of an order: equal ones are planes of one series, others series each."""
    of = Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    width = F.when(F.col("l_orderkey") % 3 == 0, 9).otherwise(5 + F.col("l_linenumber") % 2)
    reduced = (F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") % 4 == 3)
    lines = spread(read(spark, sf_dir, "lineitem").withColumn("path", F.col("l_orderkey").cast("string")), TASK_LINES, "path")
    d = lines.select(
        "path", (F.row_number().over(of) - 1).alias("ifd_no"), width.cast("long").alias("width"), F.lit(7).cast("long").alias("height"),
        reduced.cast("long").alias("subfile_type"), F.lit(8).cast("long").alias("bits"), F.lit(1).cast("long").alias("sample_format"),
    )
    return slides.tiff_planes(d)


@query("""
WITH d AS (
  SELECT 'p' || p_partkey AS path, 4 + p_size AS w, p_partkey % 5 + 1 AS planes, p_partkey % 3 + 1 AS slices, p_partkey % 7 AS spare FROM part WHERE p_partkey % 4 <> 0
), n AS (
  SELECT *, unnest(range(0, planes)) AS plane FROM d
), z AS (
  SELECT *, CASE WHEN plane = 0 THEN 100 ELSE 100 + plane * 6 * w END AS base FROM n
)
SELECT path, plane, [base, base + 4 * w] AS offsets, [4 * w, 2 * w] AS byte_counts,
  CASE WHEN slices * 2 = planes OR slices = planes THEN slices ELSE planes END AS size_z, CASE WHEN slices * 2 = planes THEN 2 ELSE 1 END AS size_c, 1 AS size_t
FROM z""")
def imagej_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes that no directory tells of; files that are compressed have none."""
    k = F.col("p_partkey")
    w = (4 + F.col("p_size")).cast("long")
    comment = F.concat(F.lit("ImageJ=1.5\nimages=9\nchannels=2\nslices="), (k % 3 + 1).cast("string"))
    d = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k.cast("string")).alias("path"), w.alias("width"), F.lit(6).cast("long").alias("height"), F.lit(8).cast("long").alias("bits"), F.lit(1).cast("long").alias("samples"),
        F.when(k % 4 == 0, 5).otherwise(1).cast("long").alias("compression"), comment.alias("description"), F.array(F.lit(100).cast("long"), 100 + 4 * w).alias("strip_offsets"), F.array(4 * w, 2 * w).alias("strip_counts"),
        (100 + 6 * w * (k % 5 + 1) + F.least(k % 7, 6 * w - 1)).alias("length"),
    )
    return slides.imagej_planes(d.drop("length"), d.select("path", "length"))


@query("""
WITH t AS (
  SELECT p_partkey, p_name || p_type || p_brand AS s FROM part
), v AS (
  SELECT p_partkey, i, ascii(substr(s, CAST(2 * i + 1 AS INT), 1)) * 256 + ascii(substr(s, CAST(2 * i + 2 AS INT), 1)) AS v FROM (SELECT *, unnest(range(0, length(s) // 2)) AS i FROM t)
)
SELECT p_partkey, i, v AS restored, CAST(sum(v) OVER (PARTITION BY p_partkey, i // 15, i % 3 ORDER BY i) % 65536 AS BIGINT) AS decoded FROM v""")
def predictor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictor undone over rows of five pixels of three samples of 16 bits, high bytes first, and applied again."""
    raw = F.encode(F.concat("p_name", "p_type", "p_brand"), "UTF-8")
    d = read(spark, sf_dir, "part").select("p_partkey", rasters.predicted(raw, 5, 3, 2, little=False).alias("decoded"))
    d = d.withColumn("restored", rasters.predicted(F.col("decoded"), 5, 3, 2, little=False, forward=True))
    value = lambda c: F.conv(F.hex(F.substring(c, F.col("i").cast("int") * 2 + 1, F.lit(2))), 16, 10).cast("long").alias(c)
    return d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.octet_length("decoded") / 2).cast("long") - 1)).alias("i")).select("p_partkey", "i", value("restored"), value("decoded"))


@query("""
WITH p AS (
  SELECT p_partkey, p_partkey % 4 AS kind, p_partkey % 3 + 1 AS channels, p_size % 3 + 1 AS tx, p_partkey % 2 + 1 AS ty FROM part
), c AS (
  SELECT *, substr(repeat(format('{:02X}', p_partkey % 251) || '0A', 20), 1, CAST(2 * channels * (1 << kind) AS INT)) AS color FROM p
)
SELECT p_partkey, repeat(color, CAST(tx * ty AS INT)) AS raster FROM c""")
def container_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles in the background colours of containers' second headers, of one to eight bytes a sample."""
    k, number = F.col("p_partkey"), lambda c: little_bytes(c.cast("long"), 4)
    kind = F.element_at(F.array(*map(F.lit, (2, 4, 6, 10))), (k % 4 + 1).cast("int"))
    color = F.unhex(F.repeat(F.concat(F.lpad(F.hex(k % 251), 2, "0"), F.lit("0A")), F.lit(20)))
    zeros = lambda n: F.unhex(F.lit("00" * n))
    head = F.concat(F.unhex(F.lit("45545300")), zeros(4), number(kind), number(k % 3 + 1), zeros(12), number(F.col("p_size") % 3 + 1), number(k % 2 + 1), zeros(72), color, zeros(8))
    d = spread(read(spark, sf_dir, "part"), TASK_ROWS).select("p_partkey", *(c.alias(n) for n, c in containers.ets_extra(head, F.lit(0)).items()))
    return d.select("p_partkey", F.hex(containers.background_raster(F.col("background"), F.col("tile_x"), F.col("tile_y"))).alias("raster"))
