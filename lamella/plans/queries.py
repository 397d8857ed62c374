"""Registered queries over the driver's tables, each with SQL that gives the same rows. The tables hold no images, so slides,
series and tiles are derived from their columns inside each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import binary as by
from lamella.functions import geometry as g
from lamella.functions import metadata as m
from lamella.functions import tags
from lamella.operators import pyramid as p
from lamella.operators import series as s
from lamella.operators import tiles as t
from lamella.plans import batch as b
from lamella.sources import bigtiff, containers
from lamella.sources.steps import spread

QUERIES, SQL = {}, {}
TILE, GRID_TILE = 256, 2048
#: Rows of one task where each row costs much.
TASK_ROWS = 10_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide for each part: its key and an image size."""
    w = 256 + F.col("p_size") * 977 + F.col("p_partkey") % 7 * 131
    h = 256 + (F.col("p_partkey") * 31 % 50 + 1) * 811 + F.col("p_partkey") % 5 * 97
    return read(spark, sf_dir, "part").select("p_partkey", w.cast("long").alias("w"), h.cast("long").alias("h"))


def dealt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all slides, a slide's tiles in one task."""
    p = slides(spark, sf_dir)
    return t.grid(p.repartition(t.tile_tasks(p, "w", "h", GRID_TILE), "p_partkey"), "p_partkey", "w", "h", GRID_TILE)


SLIDES_SQL = "SELECT p_partkey AS slide, CAST(256 + p_size * 977 + p_partkey % 7 * 131 AS BIGINT) AS w, CAST(256 + (p_partkey * 31 % 50 + 1) * 811 + p_partkey % 5 * 97 AS BIGINT) AS h FROM part"
GRID_SQL = f"g AS (SELECT slide, y * ((w + {GRID_TILE - 1}) // {GRID_TILE}) + x AS tile_no, x AS tile_x, y AS tile_y, x * {GRID_TILE} AS x, y * {GRID_TILE} AS y, least({GRID_TILE}, w - x * {GRID_TILE}) AS w, least({GRID_TILE}, h - y * {GRID_TILE}) AS h FROM (SELECT *, unnest(range(0, (w + {GRID_TILE - 1}) // {GRID_TILE})) AS x FROM (SELECT *, unnest(range(0, (h + {GRID_TILE - 1}) // {GRID_TILE})) AS y FROM ({SLIDES_SQL}))))"


@query(f"""
WITH RECURSIVE s AS ({SLIDES_SQL}), l AS (
  SELECT slide, CAST(0 AS BIGINT) AS level, w AS width, h AS height, (w + {TILE - 1}) // {TILE} AS tiles_x, (h + {TILE - 1}) // {TILE} AS tiles_y,
         CAST(ceil(ln(greatest(w, h)) / ln(2.0)) - ceil(ln({TILE}) / ln(2.0)) + 2 AS BIGINT) AS depth FROM s
  UNION ALL SELECT slide, level + 1, (width + 1) // 2, (height + 1) // 2, (tiles_x + 1) // 2, (tiles_y + 1) // 2, depth FROM l WHERE level + 1 < depth
) SELECT slide, level, width, height, tiles_x, tiles_y, tiles_x * tiles_y AS n_tiles FROM l""")
def level_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.levels(slides(spark, sf_dir), "p_partkey", "w", "h", TILE)


@query(f"WITH {GRID_SQL} SELECT * FROM g")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_grid(spark, sf_dir)


@query("""
WITH e AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS size_x FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS flat_index FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY size_x DESC, flat_index) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n_series FROM n)
SELECT l_suppkey, size_x, flat_index, n_series FROM r WHERE rn = 1""")
def largest_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("size_x"))
    e = e.withColumn("i", (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")) - 1).cast("long"))
    return s.largest_series(e, "l_suppkey", "size_x", "i")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*map(F.lit, (".svs", ".VSI", ".tif", ".png"))), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/slides/"), F.regexp_replace("url", "^https?://", ""), ends).alias("path"))


PATHS_SQL = "SELECT page_id, '/slides/' || regexp_replace(url, '^https?://', '') || ['.svs', '.VSI', '.tif', '.png'][page_id % 4 + 1] AS path FROM pages"


@query(f"SELECT page_id, path FROM ({PATHS_SQL}) WHERE contains(path, '/en/') AND lower(right(path, 4)) IN ('.svs', '.vsi', '.tif')")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.wanted(paths(spark, sf_dir), "path", "/en/")


@query(f"SELECT page_id, path, CASE lower(right(path, 4)) WHEN '.tif' THEN 'tiff' WHEN '.svs' THEN 'svs' WHEN '.vsi' THEN 'vsi' END AS reader FROM ({PATHS_SQL})")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).withColumn("reader", b.reader(F.col("path")))


@query(f"WITH f AS (SELECT page_id, '/slides/' || replace(substr(path, 9), page_id::VARCHAR, '') AS path FROM ({PATHS_SQL})), d AS (SELECT page_id, path, '/out/' || substr(path, 9, length(path) - 12) || '.tif' AS dest FROM f) SELECT *, count(*) OVER (PARTITION BY dest) > 1 AS collides FROM d")
def dest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = paths(spark, sf_dir).withColumn("path", F.concat(F.lit("/slides/"), F.replace(F.substring(F.col("path"), F.lit(9), F.length("path")), F.col("page_id").cast("string"), F.lit(""))))
    return b.destinations(files, "path", "/slides", "/out")


@query("""
WITH f AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS e, o_orderkey // 2 % 2 = 1 AS v, o_orderkey // 4 % 2 = 1 AS o, o_orderkey // 8 % 2 = 1 AS r, o_orderkey // 16 % 2 = 1 AS va, o_orderkey // 32 % 2 = 1 AS vo FROM orders),
s AS (SELECT *, e AND (o OR (r AND NOT v)) AS d FROM f)
SELECT o_orderkey, d AS delete_first, (NOT e OR d) AND NOT vo AS convert,
  CASE WHEN NOT e OR d THEN va AND NOT vo WHEN r THEN va OR vo ELSE va END AS validate_after FROM s""")
def dest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = [g.whole(F.col("o_orderkey"), 1 << k) % 2 == 1 for k in range(6)]
    return read(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in b.actions(*bit).items()))


@query("""
WITH c AS (SELECT p_partkey, 'Aperio Image ' || p_brand || chr(10) || p_name || '|AppMag = ' || p_size || '| MPP = 0.25|Dye= a=b |' || p_type AS c FROM part),
f AS (SELECT p_partkey, unnest(x) AS f, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT p_partkey, string_split(replace(c, chr(10), '|'), '|') AS x FROM c))
SELECT p_partkey, pos, CASE WHEN contains(f, '=') THEN trim(substr(f, 1, instr(f, '=') - 1)) END AS key, CASE WHEN contains(f, '=') THEN trim(substr(f, instr(f, '=') + 1)) ELSE trim(f) END AS value FROM f""")
def comment_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.lit("Aperio Image "), "p_brand", F.lit("\n"), "p_name", F.lit("|AppMag = "), F.col("p_size").cast("string"), F.lit("| MPP = 0.25|Dye= a=b |"), "p_type")
    return m.comment_pairs(read(spark, sf_dir, "part").select("p_partkey", c.alias("c")), "c", ["p_partkey"])


@query("""
WITH n AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, role) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 1 THEN role ELSE role || ' #' || lpad(i::VARCHAR, length(n::VARCHAR)::INT, '0') END AS role, length(text) AS chars FROM n""")
def meta_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.number_repeats(read(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("SELECT conv_id, role, arg_min(text, turn) AS first_value, arg_max(text, turn) AS last_value FROM conversations GROUP BY ALL")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.first_and_last(read(spark, sf_dir, "conversations"), ["conv_id"], "role", "text", ["turn"])


@query("""
WITH t AS (SELECT *, event_type = 'purchase' AND lag(event_type) OVER w IS NOT DISTINCT FROM 'signup' AS step, event_type = 'error' AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
q AS (SELECT *, sum(reset::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM t)
SELECT event_id, user_id, CAST(sum(step::INT) OVER (PARTITION BY user_id, part ORDER BY ts, event_id) - 1 AS BIGINT) AS meta_index FROM q""")
def meta_index_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    step = (F.col("event_type") == "purchase") & F.col("before").eqNullSafe("signup")
    return s.carried_index(e, "user_id", ["ts", "event_id"], step, F.col("event_type") == "error").select("event_id", "user_id", "meta_index")


@query("SELECT o_orderkey, o_custkey, o_orderkey % 5 + 1 AS n_res, CAST(coalesce(sum(o_orderkey % 5 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS core_index FROM orders")
def core_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 + 1).alias("n_res"))
    return s.first_core(o, "o_custkey", "o_orderkey", "n_res")


@query(f"WITH {GRID_SQL} SELECT slide, tile_no, tile_x, tile_y, tile_no % 5 = 0 AS is_filler, CASE WHEN tile_no % 5 = 0 THEN -1 ELSE slide * 1000003 + tile_no END AS file_offset FROM g")
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = slides(spark, sf_dir)
    n = t.tile_tasks(p, "w", "h", GRID_TILE)
    tiles = t.grid(p.repartition(n, "p_partkey"), "p_partkey", "w", "h", GRID_TILE).select("slide", "tile_no", "tile_x", "tile_y")
    index = tiles.filter("tile_no % 5 <> 0").select("slide", "tile_x", "tile_y", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_no"), (F.col("slide") * 1000003 + F.col("tile_no")).alias("at"))
    index = index.withColumn("file_offset", F.col("at") + 7 * F.col("chunk_no")).drop("at")  # a second entry of a coordinate never counts
    return t.look_up(tiles, index, ["slide", "tile_x", "tile_y"], ["file_offset"], "chunk_no", {"file_offset": -1}, n)


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber % 3 AS res, l_orderkey % 97 AS x, l_partkey % 61 AS y FROM lineitem),
e AS (SELECT l_suppkey, res, max(x) AS max_x, max(y) AS max_y, count(*) AS n_chunks FROM c GROUP BY ALL), z AS (SELECT *, (max_x + 1) * 250 + l_suppkey % 2 AS size_x FROM e)
SELECT l_suppkey, res, max_x, max_y, n_chunks, size_x, CASE WHEN size_x % 2 = 1 AND size_x // 2 < (max_x + 1) * 128 THEN size_x // 2 + 1 ELSE least(size_x // 2, (max_x + 1) * 128) END AS next_size FROM z""")
def ets_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 3).alias("res"), (F.col("l_orderkey") % 97).alias("x"), (F.col("l_partkey") % 61).alias("y"))
    e = t.extents(c, "l_suppkey", "res", ["x", "y"]).withColumn("size_x", (F.col("max_x") + 1) * 250 + F.col("l_suppkey") % 2).withColumn("across", F.col("max_x") + 1)
    return t.next_extent(e, "size_x", "across", 128).drop("across")


@query("SELECT s AS slide, row_number() OVER (PARTITION BY s ORDER BY z) - 1 AS z_index, z FROM (SELECT DISTINCT vec_id % 50 AS s, label * 0.5::DOUBLE AS z FROM embeddings)")
def z_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("slide"), (F.col("label") * F.lit(0.5)).alias("z"))
    return s.z_positions(e, "slide", "z").withColumn("z_index", F.col("z_index").cast("long"))


@query(f"""WITH {GRID_SQL}, v AS (SELECT *, slide * 7 + tile_no AS v FROM g WHERE tile_no % 11 <> 3)
SELECT slide, tile_x // 2 AS qx, tile_y // 2 AS qy, coalesce(max(v) FILTER (tile_x % 2 = 0 AND tile_y % 2 = 0), 0) AS nw, coalesce(max(v) FILTER (tile_x % 2 = 1 AND tile_y % 2 = 0), 0) AS ne,
coalesce(max(v) FILTER (tile_x % 2 = 0 AND tile_y % 2 = 1), 0) AS sw, coalesce(max(v) FILTER (tile_x % 2 = 1 AND tile_y % 2 = 1), 0) AS se FROM v GROUP BY ALL""")
def quadrant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = dealt_grid(spark, sf_dir).filter("tile_no % 11 <> 3").withColumn("v", F.col("slide") * 7 + F.col("tile_no"))
    return t.quadrants(v, "slide", "v")


PIXELS_SQL = "px AS (SELECT vec_id AS raster, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y, CAST(greatest(0, least(255, floor((v::DOUBLE + 0.6) / 1.2 * 256))) AS BIGINT) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"


def half_sql(table: str) -> str:
    q = {n: f"max(value) FILTER (x % 2 = {i} AND y % 2 = {j})" for n, (i, j) in {"nw": (0, 0), "ne": (1, 0), "sw": (0, 1), "se": (1, 1)}.items()}
    return f"SELECT raster, qx AS x, qy AS y, ((nw + sw + 1) // 2 + (ne + se + 1) // 2 + 1) // 2 AS value FROM (SELECT raster, x // 2 AS qx, y // 2 AS qy, {', '.join(f'{c} AS {n}' for n, c in q.items())} FROM {table} GROUP BY ALL)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8).withColumn("value", p.quantised(F.col("value"), -0.6, 0.6))


@query(f"WITH {PIXELS_SQL} {half_sql('px')}")
def half_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.half_level(rasters(spark, sf_dir), ["raster"])


@query(f"WITH {PIXELS_SQL}, a AS ({half_sql('px')}), b AS ({half_sql('a')}), c AS ({half_sql('b')}) SELECT *, 0 AS level FROM px UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.pyramid(rasters(spark, sf_dir), ["raster"], 3)


@query(f"WITH {GRID_SQL}, z AS (SELECT slide, tile_no, 100 + (slide * 31 + tile_no * 17) % 1009 AS n_bytes FROM g) SELECT *, CAST(16 + coalesce(sum(n_bytes) OVER (PARTITION BY slide ORDER BY tile_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM z")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = dealt_grid(spark, sf_dir).select("slide", "tile_no", (100 + (F.col("slide") * 31 + F.col("tile_no") * 17) % 1009).alias("n_bytes"))
    return t.file_offsets(z, "slide", ["tile_no"], "n_bytes")


@query(f"WITH {GRID_SQL} SELECT slide, tile_no, greatest(x, 5000) AS x0, greatest(y, 3000) AS y0, least(x + w, 12000) AS x1, least(y + h, 9000) AS y1 FROM g WHERE x < 12000 AND 5000 < x + w AND y < 9000 AND 3000 < y + h")
def region_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = dealt_grid(spark, sf_dir)
    c = F.col
    return tiles.filter(g.overlaps(c("x"), c("y"), c("w"), c("h"), 5000, 3000, 7000, 6000)).select("slide", "tile_no", F.greatest("x", F.lit(5000)).alias("x0"), F.greatest("y", F.lit(3000)).alias("y0"), F.least(c("x") + c("w"), F.lit(12000)).alias("x1"), F.least(c("y") + c("h"), F.lit(9000)).alias("y1"))


@query("SELECT split_part(url, '/', 3) AS path, min(page_id) AS first_pos FROM pages GROUP BY 1")
def used_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.used_files(read(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("path")), [], "path", "page_id")


NAMED = ("Orientation", "ResolutionUnit", "DeviceSubtype", "StackType", "YCbCrSubSampling")


@query(f"""
WITH v AS (SELECT n_nationkey, unnest([{', '.join(f"'{a}'" for a in NAMED)}]) AS tag, unnest([n_nationkey % 10, n_regionkey, 20000 + n_nationkey % 15, n_nationkey % 10 * 2, n_nationkey % 5]) AS code FROM nation),
names AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {k}, '{n}')" for a in NAMED for k, n in tags.NAMES[a].items())}) AS x(tag, code, name))
SELECT n_nationkey, v.tag, CAST(v.code AS BIGINT) AS code, coalesce(name, CASE WHEN v.tag IN ('DeviceSubtype', 'StackType') THEN v.code::VARCHAR END) AS name FROM v LEFT JOIN names ON v.tag = names.tag AND v.code = names.code""")
def tag_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    codes = dict(zip(NAMED, (n % 10, F.col("n_regionkey"), 20000 + n % 15, n % 10 * 2, n % 5), strict=True))
    pairs = F.array(*(F.struct(F.lit(tag).alias("tag"), code.cast("long").alias("code")) for tag, code in codes.items()))
    return tags.named(read(spark, sf_dir, "nation").select("n_nationkey", F.explode(pairs).alias("p")).select("n_nationkey", "p.*"), "tag", "code")


@query("SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN 1 / (p_size % 10)::DOUBLE * CASE p_partkey % 4 WHEN 2 THEN 25400 WHEN 3 THEN 10000 ELSE 1 END END AS um, CASE WHEN p_size % 10 > 0 THEN CAST(trunc(1 / (p_size % 10 / 8.0::DOUBLE) * 1000 * 10000) AS BIGINT) ELSE 0 END AS numerator, CAST(1000 AS BIGINT) AS denominator FROM part")
def resolution_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = m.um_to_rational(F.col("p_size") % 10 / F.lit(8.0))
    return read(spark, sf_dir, "part").select("p_partkey", m.resolution_to_um(F.col("p_size") % 10, F.col("p_partkey") % 4).alias("um"), n.alias("numerator"), d.alias("denominator"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(38,6)) * CAST(p_size AS DECIMAL(38,0)) * CAST(1000 AS DECIMAL(38,0)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS exposure FROM part")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", m.plain_number(m.exposure_ms(F.col("p_retailprice"), F.col("p_size"))).alias("exposure"))


@query("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(30,10)), 5) * 1000 AS DECIMAL(38,5))::VARCHAR AS vsi, CAST(CAST(p_retailprice AS DECIMAL(20,10)) * 1000000 AS DECIMAL(38,5))::VARCHAR AS svs FROM part")
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", *(m.packet_spacing(F.col("p_retailprice"), k).cast("string").alias(k) for k in ("vsi", "svs")))


@query("""
WITH b AS (SELECT conv_id, turn, ascii(substr(text, i, 1)) % 256 AS v, i FROM (SELECT conv_id, turn, text, unnest(range(1, length(text) + 1)) AS i FROM conversations))
SELECT conv_id, turn, CAST(i AS BIGINT) AS i, CAST(sum(v) OVER (PARTITION BY conv_id, turn ORDER BY i) % 256 AS BIGINT) AS decoded FROM b""")
def predictor_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    v = c.select("conv_id", "turn", F.col("i").cast("long").alias("i"), (F.ascii(F.substring(F.col("text"), F.col("i"), F.lit(1))) % 256).alias("v"))
    return p.undo_difference(v, ["conv_id", "turn"], "i", "v").drop("v")


def hexed(text: str) -> Column:
    return F.unhex(F.lit(text))


@query("""
WITH v AS (SELECT p_partkey::VARCHAR AS path, unnest([256, 257, 270]) AS tag, unnest([4, 4, 2]) AS type, unnest([1, 1, length('Aperio Image|' || p_name) + 1]) AS count, unnest([(256 + p_size * 977)::VARCHAR, (1 + p_partkey * 13)::VARCHAR, 'Aperio Image|' || p_name]) AS value FROM part)
SELECT path, 0 AS ifd_no, tag, type, count, value FROM v""")
def ifd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one directory for each part, made of bytes, then read as any file is."""
    text = F.encode(F.concat(F.lit("Aperio Image|"), "p_name"), "UTF-8")
    entry = lambda tag, kind, count, value: F.concat(by.little_bytes(F.lit(tag), 2), by.little_bytes(F.lit(kind), 2), by.little_bytes(count, 4), by.little_bytes(value, 4))
    body = F.concat(entry(256, 4, F.lit(1), 256 + F.col("p_size") * 977), entry(257, 4, F.lit(1), 1 + F.col("p_partkey") * 13), entry(270, 2, F.octet_length(text) + 1, F.lit(50)))
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(hexed("49492A00080000000300"), body, hexed("00000000"), text, hexed("00")).alias("content"))
    value = F.coalesce(F.element_at("value_long", 1).cast("string"), F.col("value_string"))
    return containers.tiff_entries(files).select("path", "ifd_no", "tag", "type", "count", value.alias("value"))


@query("""
WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS x, hex(encode(p_type)) AS y, p_partkey % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'FFD8' || y || 'FFD9' ELSE 'FFD8' || x || 'FFEE000E41646F62650064000000000' || CASE k WHEN 1 THEN '0' ELSE '1' END || y || 'FFD9' END AS jpeg FROM h""")
def jpeg_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("p_partkey") % 3, lambda c: F.concat(hexed("FFD8"), F.encode(c, "UTF-8"), hexed("FFD9"))
    return read(spark, sf_dir, "part").select("p_partkey", F.hex(by.spliced(F.when(k > 0, part("p_name")), part("p_type"), F.when(k == 1, 2).otherwise(6))).alias("jpeg"))


@query("""
WITH c AS (SELECT p_partkey, unnest(range(0, p_size % 5)) AS chunk_no, 256 + p_partkey % 2 * 256 AS tile_x FROM part)
SELECT p_partkey::VARCHAR AS path, chunk_no, chunk_no * 3 AS c0, p_partkey AS c1, CAST(5000000000 AS BIGINT) + p_partkey * 1000 + chunk_no AS "offset", 10 + chunk_no AS n_bytes, tile_x FROM c""")
def ets_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile container for each part, made of bytes, then read as any file is."""
    n, key = F.col("p_size") % 5, F.col("p_partkey")
    num = by.little_bytes
    head = F.concat(hexed("53495300" + "40000000" + "02000000" + "04000000"), num(F.lit(64), 8), num(F.lit(156), 4), num(F.lit(0), 4), num(F.lit(220), 8), num(n, 4), num(F.lit(0), 4), F.unhex(F.repeat(F.lit("00"), F.lit(16))))
    extra = F.concat(hexed("45545300" + "01000000" + "02000000" + "03000000" + "04000000" + "02000000" + "5A000000"), num(256 + key % 2 * 256, 4), num(F.lit(256), 4), num(F.lit(1), 4), F.unhex(F.repeat(F.lit("00"), F.lit(112))), num(F.lit(1), 4))
    chunk = lambda k: F.concat(hexed("00000000"), num(k * 3, 4), num(key, 4), num(F.lit(0), 8), num(F.lit(5_000_000_000) + key * 1000 + k, 8), num(10 + k, 4), num(F.lit(0), 4))
    table = F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), hexed(""), lambda got, k: F.concat(got, chunk(k)))).otherwise(hexed(""))
    files = spread(read(spark, sf_dir, "part"), TASK_ROWS).select(key.cast("string").alias("path"), F.concat(head, extra, table).alias("content"))
    found = containers.ets_chunks(files)
    return found.select("path", "chunk_no", F.element_at("coord", 1).alias("c0"), F.element_at("coord", 2).alias("c1"), "offset", "n_bytes", "tile_x")


@query("""
WITH t AS (SELECT s_suppkey::VARCHAR AS slide, CASE WHEN i < 4 THEN 0 ELSE 1 END AS level, CASE WHEN i < 4 THEN i ELSE 0 END AS tile_no, 10 + (s_suppkey * 7 + i * 3) % 50 AS n_bytes FROM supplier, range(0, 5) r(i))
SELECT slide, level, tile_no, CAST(16 + coalesce(sum(n_bytes) OVER (PARTITION BY slide ORDER BY level, tile_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", n_bytes FROM t""")
def bigtiff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of two levels for each supplier is laid out, joined to bytes and read back."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("slide"), "s_suppkey")
    i = F.col("i")
    tiles = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("slide", (i > 3).cast("int").alias("level"), F.when(i < 4, i).otherwise(0).cast("long").alias("tile_no"), F.encode(F.repeat(F.lit("x"), (10 + (F.col("s_suppkey") * 7 + i * 3) % 50).cast("int")), "UTF-8").alias("bytes"))
    images = s.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))).select("slide", "level", F.when(F.col("level") == 0, 512).otherwise(256).cast("long").alias("width"), F.lit(300).cast("long").alias("height"), F.lit(256).alias("tile"), F.lit(7).alias("compression"), F.lit(6).alias("photometric"), F.lit(40_000_000).cast("long").alias("resolution"), F.lit(None).cast("string").alias("packet"))
    parts = bigtiff.layout(tiles, images).groupBy("slide").agg(F.array_sort(F.collect_list(F.struct("offset", "bytes"))).alias("p"))
    filled = lambda got, x: F.concat(got, F.when(x["offset"] > F.octet_length(got), hexed("00")).otherwise(hexed("")), x["bytes"])
    files = parts.select(F.col("slide").alias("path"), F.aggregate("p", hexed(""), filled).alias("content"))
    found = containers.tile_index(containers.directories(containers.tiff_entries(files)))
    return found.select(F.col("path").alias("slide"), F.col("ifd_no").alias("level"), "tile_no", "offset", "n_bytes")
