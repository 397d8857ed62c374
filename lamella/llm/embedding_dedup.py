"""Embedding near-dedup by Euclidean p-stable hashing: quantised random projections bucket normalised vectors in several tables; exact cosines follow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.blocks import groups, roots
from lamella.llm.common import components, digest, scratch, sized_join, stored

#: Least cosine; width of a quantisation step; chance to find a pair just at the limit; unrelated vectors in a bucket; vectors in a block.
COSINE, WIDTH, RECALL, CROWD, BLOCK, SEED = 0.9, 1.8, 0.97, 512, 2048, 17
#: Vectors of a block that are compared with another block's at once.
SLICE = 128


def step_chance(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees on two points so far apart."""
    u = width / distance
    return 1 - math.erfc(u / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))


def table_plan(n: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL, crowd: int = CROWD) -> tuple[int, int]:
    """Projections in a key, so that about ``crowd`` of ``n`` unrelated (orthogonal) vectors share a bucket, and tables for the recall wanted."""
    k = max(2, math.ceil(math.log(max(2, n / crowd)) / -math.log(step_chance(math.sqrt(2), width))))
    near = step_chance(math.sqrt(2 - 2 * cosine), width) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double) for each length of vector in the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        x = flat[first[rows][:, None] + np.arange(n)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(k: int, tables: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), np.int32)
            for rows, x in _unit(batch.column("vec")):
                rnd = np.random.default_rng([seed, x.shape[1]])
                a, b, odd = rnd.standard_normal((x.shape[1], tables * k)), rnd.uniform(0, width, tables * k), rnd.integers(1, 1 << 62, (tables, k)) * 2 + 1
                steps = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, k)
                with np.errstate(over="ignore"):
                    out[rows] = (((steps * odd).sum(axis=2) + x.shape[1]) * np.int64(0x9E3779B97F4A7C1) >> 32).astype(np.int32)
            keys = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * tables, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), keys], ["node", "keys"])

    return run


def _compare(cosine: float):
    def group(parts: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        node, copies, first, second = (parts.column(c).to_numpy() for c in ("node", "copies", "first", "second"))
        before = parts.column("before").combine_chunks()
        before = before.values.to_numpy()[before.offsets[0].as_py() : before.offsets[-1].as_py()].reshape(len(node), -1)
        for rows, x in _unit(parts.column("vec")):
            a, b = rows[first[rows]], rows[second[rows]]
            left, right = x[first[rows]], x[second[rows]]
            within = (first[rows] & second[rows]).any()
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for start in range(0, len(left), SLICE):  # so that even a dense block holds few pairs at a time
                i, j = np.nonzero(left[start : start + SLICE] @ right.T >= cosine)
                i, j = a[i + start], b[j]
                if within:
                    i, j = i[once := i < j], j[once]
                for earlier in before.T:  # a pair that an earlier table has had goes
                    i, j = i[once := earlier[i] != earlier[j]], j[once]
                    if not len(i):
                        break
                else:
                    links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
                    root = roots(len(node), np.concatenate([i, np.arange(len(node))]), np.concatenate([j, root]))
            some = np.flatnonzero(links)
            if len(some):
                yield node[some], links[some], node[root[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, "t", "key", "low", "high"):
            for out in group(whole):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id, kept for each row of ``vectors``.

    Vectors link if their cosine in double precision is ``cosine`` or more. Those that are null, empty, zero, or hold nulls or
    values that aren't finite link with nothing; vectors of different lengths don't link. Equal vectors are one node with a count,
    so copies cost one row; nodes are numbered when their table is stored. component_id is the smallest id reachable, the own id
    included; a row with a null id counts as a link, and its component may be null. Empty in, empty out.

    A vector goes once to each table's bucket, with its keys in the tables before; buckets of one node aren't sent. Buckets of over
    ``block`` nodes are dealt to blocks, and each pair of blocks is a group of its own, so no task holds a bucket.
    A pair is counted in the first table that has it. Groups give back sums and spanning edges, not pairs."""
    k1, k2 = digest(F.col("vec"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("ok", usable(F.col("vec")))
    v = v.select("id", "vec", *(F.when(F.col("ok"), h).alias(c) for c, h in (("k1", k1), ("k2", k2))))
    with scratch(vectors.sparkSession) as temp:
        nodes = v.filter("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("vec").alias("vec"))
        nodes = temp(nodes.select(F.monotonically_increasing_id().alias("node"), "*"))
        k, tables = table_plan(nodes.count(), cosine, recall=recall)
        keyed = temp(nodes.select("node", "vec").mapInArrow(_keys(k, tables, WIDTH, seed), "node long, keys array<int>"))
        spots = keyed.select("node", F.posexplode("keys").alias("t", "key"))
        crowds = temp(spots.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block)))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        before = F.slice("keys", F.lit(1), F.col("t")).alias("before")
        spots = keyed.select("node", "keys", F.posexplode("keys").alias("t", "key")).select("node", "t", "key", before)
        dealt = sized_join(spots, crowds, ["t", "key"], "n", nodes.count() * tables)
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", "t"), "blocks")).select("*", others)
        low, high = F.least("own", "other"), F.greatest("own", "other")
        sides = [(F.col("own") == low).alias("first"), (F.col("own") == high).alias("second")]
        group = ["t", "key", "low", "high"]
        dealt = dealt.select("node", "before", "t", "key", low.alias("low"), high.alias("high"), *sides)
        sent = dealt.join(nodes.select("node", "copies", "vec"), "node").repartition(*group).sortWithinPartitions(*group)
        sent = sent.select(*group, "node", "copies", "first", "second", "vec", "before")
        told = temp(sent.mapInArrow(_compare(cosine), "node long, links long, root long"))
        comps = components(told.select(F.col("node").alias("a"), F.col("root").alias("b")))
        links = told.groupBy("node").agg(F.sum("links").alias("links"))
        one = nodes.select("node", "k1", "k2", "copies", "id").join(links, "node", "left").join(comps, "node", "left")
        one = temp(one.withColumn("component", F.coalesce("component", "node")))
        least = temp(one.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members")))
        named = sized_join(one, least, ["component"], "members", one.count())
        named = stored(named.select("k1", "k2", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies"))
    found = sized_join(v.filter("k1 is not null").select("id", "k1", "k2"), named, ["k1", "k2"], "copies", named.agg(F.sum("copies")).first()[0] or 0)
    alone = v.filter("k1 is null").select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select("id", "component_id", "n_links").unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept
FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM e GROUP BY x) USING (vec_id) JOIN (SELECT x AS vec_id, min(y) AS m FROM r GROUP BY x) USING (vec_id)
"""
