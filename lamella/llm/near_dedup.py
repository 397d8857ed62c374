"""MinHash near-dedup by tensored banding: table keys are pairs from two small collections of minhashes; candidates are verified on full
shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.blocks import groups, roots
from lamella.llm.common import components, digest, scratch, sized_broadcast, sized_join, small_batches, stored
from lamella.llm.tokens import mix64, pieces, shingles, split

#: Words in a shingle; similarity in per cent; minhashes in one component of a key; chance to find a pair just at the limit.
WORDS, PERCENT, ROWS, RECALL, SEED = 5, 80, 3, 0.999, 5
#: Nodes in a block that one task compares; blocks of a family that are compared without centres; nodes that are compared with one copy of a centre.
BLOCK, DIRECT, SPOKES = 512, 8, 2048
Temp = Callable[[DataFrame], DataFrame]


def collection_size(percent: int, rows: int, recall: float) -> int:
    """Components in a collection, so that both collections hold an equal one, for a pair at the limit, with chance ``recall``."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - (percent / 100) ** rows))


def _distinct(h: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    for i, j in zip(first[:-1], first[1:], strict=True):
        yield np.unique(h[i:j])


def _set_key(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of its members under two mixings."""
    return x.sum(dtype=np.uint64).view(np.int64), mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _signatures(words: int, size: int, rows: int, seed: int):
    rnd = np.random.default_rng(seed)
    odd = rnd.integers(0, 1 << 63, 2 * size * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rnd.integers(0, 1 << 63, 2 * size * rows, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in pieces(batch.column("text")):
                h, first = shingles(split(data, offs), words)
                n, full = len(first) - 1, np.flatnonzero(np.diff(first))
                parts = np.zeros((n, 2 * size), np.uint64)
                if len(full):
                    for i in range(2 * size * rows):
                        low = np.minimum.reduceat((h ^ flip[i]) * odd[i], first[full])
                        parts[full, i // rows] = mix64(parts[full, i // rows] * np.uint64(31) + low)
                sets = [(len(x), *_set_key(x)) for x in _distinct(h, first)]
                parts = parts.view(np.int64)
                given = [batch.column(c).slice(at, n) for c in ("k1", "k2", "id")]
                out = [*given, *(pa.array([s[k] for s in sets], pa.int64()) for k in range(3)), _lists(parts[:, :size]), _lists(parts[:, size:])]
                yield pa.RecordBatch.from_arrays(out, ["k1", "k2", "id", "n_shingles", "s1", "s2", "t1", "t2"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offs in pieces(batch.column("text")):
                h, first = shingles(split(data, offs), words)
                found = [np.sort(x.view(np.int64)) for x in _distinct(h, first)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(found)), lists], ["node", "found"])

    return run


def _buckets(classes: DataFrame, size: int, temp: Temp) -> DataFrame:
    """k, node, least, top: the tables' buckets that hold two nodes at least, with their least and largest; one of those with the same nodes.

    A component that no other node has can't make a shared key, so only shared components are paired."""
    parts = temp(classes.select("node", F.posexplode(F.concat("t1", "t2")).alias("i", "v")))
    shared = temp(parts.groupBy("i", "v").agg(F.count("*").alias("n")).filter("n > 1"))
    mine = sized_join(parts, shared, ["i", "v"], "n", parts.count())
    sides = [F.collect_list(F.when(on, F.struct("i", "v"))).alias(c) for c, on in (("a", F.col("i") < size), ("b", F.col("i") >= size))]
    pair = lambda x: F.transform(F.col("b"), lambda y: F.xxhash64(x["i"], x["v"], y["i"], y["v"]))
    keyed = temp(mine.groupBy("node").agg(*sides).select("node", F.explode(F.flatten(F.transform("a", pair))).alias("k")))
    same = [F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.min("node").alias("least"), F.max("node").alias("top")]
    full = keyed.groupBy("k").agg(F.count("*").alias("n"), *same).filter("n > 1")
    kept = temp(full.groupBy("n", "x", "y", "least", "top").agg(F.min("k").alias("k")).select("k", "least", "top", "n"))
    return temp(sized_join(keyed, kept, ["k"], "n", keyed.count()))


def _shared(found: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Members that each set of ``first`` has in common with each of ``second``: products of 0/1 tables, some columns at a time."""
    _, column, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    row, column = row[count[column] > 1], column[count[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order, same = np.argsort(column, kind="stable"), np.zeros((len(first), len(second)), np.float32)
    row, column, width = row[order], column[order], 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        table = np.zeros((len(found), width), np.float32)
        table[row[i:j], column[i:j] - at] = 1
        same += table[first] @ table[second].T
    return same.astype(np.int64)


def _compared(limit: int):
    """Pairs of blocks, one after another: edges that join what the links between the two sides' nodes join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "g"):
            node, comp, first, second = (t.column(c).to_numpy() for c in ("node", "comp", "first", "second"))
            found = t.column("found").combine_chunks()
            ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
            n, a, b = np.diff(ends), np.flatnonzero(first), np.flatnonzero(second)
            same = _shared([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], a, b)
            i, j = np.nonzero((same * 100 >= (n[a][:, None] + n[b][None, :] - same) * limit) & (comp[a][:, None] != comp[b][None, :]))
            root = roots(len(node), a[i], b[j])
            some = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["a", "b"])

    return run


def _families(buckets: DataFrame, temp: Temp) -> DataFrame:
    """node, family, members: nodes that share a bucket, directly or by way of others, are a family."""
    found = components(buckets.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counts = temp(found.groupBy("component").agg(F.count("*").alias("members")).withColumn("n", F.col("members")))
    joined = sized_join(found, counts, ["component"], "n", found.count())
    return temp(joined.select("node", F.col("component").alias("family"), "members"))


def _block_links(rest: DataFrame, sets: DataFrame, limit: int, temp: Temp, block: int = BLOCK) -> DataFrame:
    """Links within groups (k, node, comp). A group of at most ``block`` nodes is compared in one task. In a larger one, nodes outside
    its largest component are compared with all nodes, in pairs of blocks; each pair of blocks is a group of its own, so no task
    holds a large group, and nothing is compared within the largest component."""
    rest = temp(rest)
    per = rest.groupBy("k", "comp").count()
    main = per.groupBy("k").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("n"))
    minor, major = F.ceil((F.col("n") - F.col("m.count")) / block), F.ceil(F.col("m.count") / block)
    main = temp(main.select("k", F.col("m.comp").alias("main"), (F.col("n") <= block).alias("one"), minor.alias("minor"), major.alias("major"), "n"))
    spots = sized_join(rest, main.filter("minor > 0"), ["k"], "n", rest.count()).withColumn("small", F.col("comp") != F.col("main"))
    spots = spots.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("small"), F.col("minor")).otherwise(F.col("major"))))

    def pair(lo: Column, hi: Column, kind: int, first: Column, second: Column) -> Column:
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"))

    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    minor, major = (F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("minor", "major"))
    both = lambda o: pair(F.least(o, own), F.greatest(o, own), 0, own <= o, own >= o)
    with_minor = F.transform(minor, lambda o: F.when(F.col("small"), both(o)).otherwise(pair(o, own, 1, no, yes)))
    with_major = F.transform(major, lambda o: pair(own, o, 1, yes, no))
    pairs = F.when(F.col("one"), F.array(pair(F.lit(0), F.lit(0), 2, yes, yes)))
    pairs = pairs.when(F.col("small"), F.concat(with_minor, with_major)).otherwise(with_minor)
    spots = spots.select("k", "node", "comp", F.explode(pairs).alias("p"))
    spots = spots.select("node", "comp", F.xxhash64("k", "p.kind", "p.lo", "p.hi").alias("g"), "p.first", "p.second")
    sent = spots.join(sets, "node").select("g", "node", "comp", "first", "second", "found").repartition("g").sortWithinPartitions("g")
    return temp(sent.mapInArrow(_compared(limit), "a long, b long"))


def _with_centres(pairs: DataFrame, sets: DataFrame, temp: Temp) -> DataFrame:
    """node, c, x, y: the sets of both nodes of each pair (node, c). A centre's set is copied once for each ``SPOKES`` of its pairs, and
    each copy is joined with its own share of them, so that no task holds all pairs of a centre."""
    pairs = temp(pairs)
    copies = temp(pairs.groupBy("c").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SPOKES).alias("copies")))
    dealt = sized_join(pairs, copies, ["c"], "n", pairs.count()).withColumn("copy", F.pmod(F.xxhash64("node"), "copies"))
    centres = copies.join(sets.select(F.col("node").alias("c"), F.col("found").alias("y")), "c")
    centres = centres.select("c", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return dealt.select("node", "c", "copy").join(sets.select("node", F.col("found").alias("x")), "node").join(centres, ["c", "copy"])


def _links(buckets: DataFrame, sets: DataFrame, percent: int, temp: Temp, block: int = BLOCK, direct: int = DIRECT) -> DataFrame:
    """a, b: links that join the same nodes as all links between nodes that share a bucket do.

    Families of at most ``block`` nodes are compared whole, each set sent once, and those of up to ``direct`` blocks by pairs of blocks,
    which sends a set about as often as there are blocks. In a larger family, each bucket's largest node is
    its centre and compared, on full sets, with all others there. One minus the similarity is a metric: with a limit of t, a node
    that is farther than 2 t from the centre can't link with one that is within t. So the bucket falls into the near ones and the
    far ones, and those between belong to both. What still has several components is compared by blocks, of whole families or of
    buckets, whichever sends fewer sets. No pair of different components that shares a bucket is passed over."""
    limit, twice = percent, max(0, 2 * percent - 100)
    if buckets.isEmpty():
        return buckets.select(F.col("node").alias("a"), F.col("node").alias("b"))
    families = _families(buckets, temp)
    few = families.filter(F.col("members") <= block * direct)
    links = _block_links(few.select(F.col("family").alias("k"), "node", F.col("node").alias("comp")), sets, limit, temp, block)
    sizes = sets.select("node", F.size("found").alias("n"))
    many = families.filter(F.col("members") > block * direct).join(sizes, "node")
    asked = temp(buckets.join(many, "node").filter("node <> top").select("k", "node", "n", "family", F.col("top").alias("c")))
    if asked.isEmpty():
        return links
    close = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * twice
    centre_sizes = sizes.select(F.col("node").alias("c"), F.col("n").alias("cn"))
    pairs = asked.select("node", "n", "c").distinct().join(centre_sizes, "c").filter(close).select("node", "c")
    counted = _with_centres(pairs, sets, temp)
    counted = counted.select("node", "c", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("same"))
    within = lambda t: F.col("same") * 100 >= (F.col("n") + F.col("m") - F.col("same")) * t
    told = temp(counted.select("node", "c", F.when(within(limit), 0).when(within(twice), 1).otherwise(2).alias("zone")))
    new = told.filter("zone = 0").select(F.col("node").alias("a"), F.col("c").alias("b"))
    comps = components(new).select("node", F.col("component").alias("_comp"))
    zoned = asked.join(told, ["node", "c"], "left").withColumn("zone", F.coalesce("zone", F.lit(2)))
    near, far = F.xxhash64("k", F.lit(0)), F.xxhash64("k", F.lit(2))
    zones = F.when(F.col("zone") == 0, F.array(near)).when(F.col("zone") == 2, F.array(far)).otherwise(F.array(near, far))
    parts = zoned.select("node", "family", F.explode(zones).alias("k"))
    live = temp(parts.join(comps, "node", "left").select("k", "node", "family", F.coalesce("_comp", "node").alias("comp")))
    sent = lambda n: n * F.ceil(n / block)
    per_bucket = live.groupBy("family", "k").agg(F.count("*").alias("n")).groupBy("family").agg(F.sum(sent(F.col("n"))).alias("sent"), F.sum("n").alias("rows"))
    whole = live.select("family", "node").distinct().groupBy("family").agg(F.count("*").alias("n"))
    by = temp(per_bucket.join(whole, "family").select("family", (sent(F.col("n")) <= F.col("sent")).alias("whole"), "rows"))
    key = F.when(F.col("whole"), F.col("family")).otherwise(F.col("k")).alias("k")
    left = sized_join(live, by, ["family"], "rows", live.count()).select(key, "node", "comp").distinct()
    return links.unionByName(new).unionByName(_block_links(left, sets, limit, temp, block))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, ``id_col``, n_shingles, component_id, kept, group for each row of ``docs``; k1 and k2 are ``digest`` of id and text, group is
    the same for linked rows and null without words.

    A text's set has its distinct runs of ``words`` words (A-Z lower-cased, blanks apart); fewer words are one run; null, empty and
    blank texts have none and link with nothing. Texts link if 100 * intersection >= ``percent`` * union. component_id is the
    smallest id reachable. Rows with equal sets are one node, so copies, however many, cost one row. Rows with a null id take part
    but lend no id; a component of such rows alone is null and not kept. Repeated rows get equal results. Ids are of any type with an order.

    Only minhash components go through the first shuffles; sets follow for nodes that share a key. Each pair at the limit is found
    with chance ``recall`` or more, and what is found is verified exactly. Nodes are numbered when their table is stored."""
    size, kind = collection_size(percent, rows, recall), dict(docs.dtypes)[id_col]
    keys = [h.alias(k) for h, k in zip(digest(F.col(id_col), F.col(text_col)), ("k1", "k2"), strict=True)]
    d = docs.select(*keys, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"k1 long, k2 long, id {kind}, n_shingles long, s1 long, s2 long, t1 array<long>, t2 array<long>"
    with scratch(docs.sparkSession) as temp, small_batches(docs.sparkSession):
        signed = stored(d.mapInArrow(_signatures(words, size, rows, seed), schema))
        one, own_id, tables = F.min(F.struct("id", "k1", "k2")).alias("one"), F.min("id").alias("id"), F.min(F.struct("t1", "t2")).alias("t")
        classes = signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(one, own_id, tables, F.count("*").alias("n"))
        classes = temp(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "id", "one.k1", "one.k2", "t.t1", "t.t2", "n"))
        buckets = _buckets(classes, size, temp)
        asked = temp(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("k1", "k2", "node"))
        texts = d.join(sized_broadcast(asked), ["k1", "k2"]).select("node", "text")
        sets = temp(texts.mapInArrow(_sets(words), "node long, found array<long>").dropDuplicates(["node"]))
        links = _links(buckets, sets, percent, temp)
        joined = classes.select("node", "s1", "s2", "id", "n").join(components(links), "node", "left")
        joined = temp(joined.withColumn("component", F.coalesce("component", "node")))
        least = temp(joined.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members")))
        named = sized_join(joined, least, ["component"], "members", joined.count())
        named = stored(named.select("s1", "s2", "component_id", F.col("component").alias("group"), "n"))
    own = signed.select("k1", "k2", "id", "n_shingles", "s1", "s2")
    linked = sized_join(own.filter("n_shingles > 0"), named, ["s1", "s2"], "n", own.count()).drop("s1", "s2")
    bare = own.filter("n_shingles = 0").select("k1", "k2", "id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(bare).select("k1", "k2", F.col("id").alias(id_col), "n_shingles", "component_id", kept, "group")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, with all its columns: of the smallest id, null ids last. Texts without words stay."""
    found = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col).filter("n_shingles > 0")
    with scratch(docs.sparkSession) as temp:
        rows = temp(found.groupBy("group", "k1", "k2").agg(F.min(id_col).alias("id"), F.count("*").alias("n")))
        best = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("best"), F.count("*").alias("size"))
        best = temp(best.filter("size > 1").select("group", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"), "size"))
        others = sized_join(rows, best, ["group"], "size", rows.count()).filter("k1 <> b1 or k2 <> b2")
        gone, repeated = stored(others.select("k1", "k2")), stored(rows.filter("n > 1").select("k1", "k2"))
    k1, k2 = digest(F.col(id_col), F.col(text_col))
    packed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))  # so that no column's name can clash
    kept, repeated = packed.join(sized_broadcast(gone), ["k1", "k2"], "left_anti"), sized_broadcast(repeated)
    once, many = kept.join(repeated, ["k1", "k2"], "left_anti"), kept.join(repeated, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return once.unionByName(many).select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i + 1 : i + 3], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 0) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""
