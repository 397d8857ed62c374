"""Merkle dataset manifest with coordinate lookup proofs: a proof's sibling coordinates follow from a leaf's index and its group's size, are
exploded, met with the stored node table, ordered, concatenated and folded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower, numbered, sized_join, stored

#: Nodes of a run are FANOUT = 2 ** BITS.
BITS = 4
#: The tree over subroots, beside those of sources, which are numbered from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Each field is ``-`` if null, else its UTF-8 byte count, ``:`` and the value, so no two rows have one encoding."""
    texts = [f.cast("string") for f in fields]
    return digest_of(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def width(leaves: Column, level: int) -> Column:
    """Nodes on a level of a tree with so many leaves: leaves / 16 ** level, rounded up."""
    return F.shiftright(leaves + ((1 << BITS * level) - 1), BITS * level)


def height(leaves: int) -> int:
    """Levels above the leaves: until one node remains."""
    levels = 0
    while -(-leaves >> BITS * levels) > 1:
        levels += 1
    return levels


@dataclass
class Manifest:
    """runs (tree, leaves, run, members: array of place, id, leaf, checked; subroot) has the leaves, 16 consecutive ones a row; nodes (tree, level,
    idx, digest, asked) the nodes above them, and all of the tree over subroots; sources (source, tree, leaves, subroot); root is null
    without rows."""

    runs: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None
    most: int
    trees: int


def _above(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the next level, of trees that aren't down to one node; nodes: tree, leaves, level, idx, digest."""
    runs = nodes.filter(width(F.col("leaves"), level) > 1).groupBy("tree", "leaves", F.shiftright("idx", BITS).alias("idx"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # at most 16
    return runs.agg(digest_of(F.array_join(F.transform(ordered, lambda x: x["digest"]), "")).alias("digest")).withColumn("level", F.lit(level + 1))


def build(docs: DataFrame, checked_text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of ``docs``. ``fields`` names the columns of a leaf: id, source, and others, the text last. ``checked_text`` is
    what proofs are to be checked with (default: the text).

    Leaves of a source ascend by id, null first, then by leaf. Repeated rows are leaves of their own; as they are equal, which comes first
    makes no difference to the nodes. Null sources are a source of their own, before all others. Other columns are ignored, so names can't
    clash. Empty in: no runs, no nodes, root null.

    Texts are read once and not shuffled. Leaves are numbered by ranges, so a source may hold any share of all rows; every level is a
    grouped step over the one below it and is stored, a sixteenth of its size."""
    id_col, source_col, *rest = fields
    text = F.col(fields[-1])
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-")).alias("key"),
        leaf_digest(*(F.col(c) for c in fields)).alias("leaf"),
        leaf_digest(*(F.col(c) for c in fields[:-1]), text if checked_text is None else checked_text).alias("checked"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    rows = stored(rows)
    sources = stored(rows.groupBy("key", "source").agg(F.count("*").alias("leaves")))
    sources = stored(numbered(sources, [], [F.col("source").asc_nulls_first()], "tree"))
    said = sources.agg(F.count("*").alias("trees"), F.coalesce(F.max("leaves"), F.lit(0)).alias("most"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("rows")).first()
    trees, most = said["trees"], said["most"]
    sized = sources.select("key", "tree", "leaves", F.col("leaves").alias("weight"))
    leaves = stored(sized_join(rows.drop("source"), sized, ["key"], "weight", said["rows"]).drop("key"))
    leaves = numbered(leaves, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("salt")])
    member = F.struct("place", "id", "leaf", "checked")
    runs = stored(leaves.groupBy("tree", "leaves", F.shiftright("place", BITS).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members")))

    joined = F.array_join(F.transform("members", lambda x: x["leaf"]), "")
    level = stored(runs.filter("leaves > 1").select("tree", "leaves", F.lit(1).alias("level"), F.col("run").alias("idx"), digest_of(joined).alias("digest")))
    names = ["tree", "leaves", "level", "idx", "digest"]
    lone = runs.filter("leaves = 1").select("tree", "leaves", F.lit(0).alias("level"), F.col("run").alias("idx"), F.get("members", F.lit(0))["leaf"].alias("digest"))
    levels, tops = [level], lone
    for k in range(1, height(most) + 1):
        tops = tops.unionByName(level.filter(width(F.col("leaves"), k) == 1))
        if k < height(most):
            levels.append(level := stored(_above(level, k).select(*names)))
    subroots = stored(tops.select("tree", F.col("digest").alias("subroot")))
    level = stored(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("leaves"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")))
    levels.append(level)
    for k in range(height(trees)):
        levels.append(level := stored(_above(level, k).select(*names)))
    root = level.first()
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.unionByName(other)
    # runs that ask for a node: those below its siblings, or for the tree over subroots any
    asked = F.when(F.col("tree") == TOP, F.lit((said["rows"] >> BITS) + 1)).otherwise(F.pow(F.lit(1 << BITS), "level").cast("long"))
    sources = sources.join(subroots, "tree").select("source", "tree", "leaves", "subroot")
    weighed = sources.select("tree", "subroot", (F.shiftright("leaves", BITS) + 1).alias("weight"))
    runs = stored(sized_join(runs, stored(weighed), ["tree"], "weight", (said["rows"] >> BITS) + trees))
    return Manifest(runs, stored(nodes.withColumn("asked", asked)), sources, root["digest"] if root else None, most, trees)


def _steps(m: Manifest) -> list[tuple[Column, Column, Column, Column, int]]:
    """(the step counts, tree, width, index of the run's ancestor, level) for each step above a run of leaves, to the root."""
    n, run = F.col("leaves"), F.col("run")
    own = [(width(n, k) > 1, F.col("tree"), width(n, k), F.shiftright(run, BITS * (k - 1)), k) for k in range(1, height(m.most))]
    top, trees = F.lit(TOP).cast("long"), F.lit(m.trees).cast("long")
    return own + [(F.lit(True), top, width(trees, k), F.shiftright(F.col("tree"), BITS * k), k) for k in range(height(m.trees))]


def _siblings(number: int, counts: Column, tree: Column, size: Column, at: Column, level: int) -> Column:
    """Coordinates of the siblings of the node ``at``: the others of its run of 16, which the level's width may cut short."""
    start = F.shiftleft(F.shiftright(at, BITS), BITS)
    run = F.sequence(start, F.least(start + ((1 << BITS) - 1), size - 1))
    found = F.transform(F.filter(run, lambda i: i != at), lambda i: F.struct(F.lit(number).alias("step"), tree.alias("of"), F.lit(level).alias("level"), i.alias("idx"), (i < at).alias("left")))
    return F.when(counts, found).otherwise(F.array().cast("array<struct<step:int,of:bigint,level:int,idx:bigint,left:boolean>>"))


def proofs(m: Manifest) -> DataFrame:
    """id, leaf, checked, subroot, steps for each leaf; steps is an array of (left, right), from the leaf's run to the root, each the digests of
    the siblings before and after the path, one after the other. A step without siblings has both empty, and is still a step.

    All leaves of a run share what is above them, so coordinates above it are exploded once a run, some fifteen a level, and met
    with the node table: the few nodes that are asked for by a large part of all runs are broadcast, the others shuffled."""
    steps = _steps(m)
    wanted = [_siblings(i, *step) for i, step in enumerate(steps)]
    if wanted:
        asks = stored(m.runs.select("tree", "run", F.inline(F.flatten(F.array(*wanted)))))
        known = m.nodes.select(F.col("tree").alias("of"), "level", "idx", "digest", F.shiftleft("asked", BITS).alias("weight"))
        met = sized_join(asks, known, ["of", "level", "idx"], "weight", asks.count())
        found = met.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("step", "idx", "digest", "left"))).alias("found"))
        above = m.runs.join(found, ["tree", "run"], "left")
    else:
        above = m.runs.withColumn("found", F.lit(None).cast("array<struct<step:int,idx:bigint,digest:string,left:boolean>>"))

    def side(number: int, left: bool) -> Column:
        met = F.filter("found", lambda x: (x["step"] == number) & (x["left"] == left))
        return F.coalesce(F.array_join(F.transform(met, lambda x: x["digest"]), ""), F.lit(""))

    path = F.array(*(F.when(counts, F.struct(side(i, True).alias("left"), side(i, False).alias("right"))) for i, (counts, *_) in enumerate(steps)))
    path = F.filter(path, lambda x: x.isNotNull()) if steps else F.array().cast("array<struct<left:string,right:string>>")
    leaves = above.select("leaves", "subroot", "members", path.alias("path")).select("*", F.posexplode("members").alias("at", "m"))

    def others(start: Column | int, length: Column) -> Column:
        return F.array_join(F.transform(F.slice("members", start, length), lambda x: x["leaf"]), "")

    first = F.struct(others(1, F.col("at")).alias("left"), others(F.col("at") + 2, F.size("members")).alias("right"))
    steps_ = F.when(F.col("leaves") > 1, F.concat(F.array(first), "path")).otherwise(F.col("path"))
    return leaves.select(F.col("m.id").alias("id"), F.col("m.leaf").alias("leaf"), F.col("m.checked").alias("checked"), "subroot", steps_.alias("steps"))


def proof_digest(steps: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return digest_of(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: digest_of(s["left"], acc, s["right"]))


def verify(docs: DataFrame, checked_text: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``fields[0]``, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``: its proof, folded from the leaf
    of ``checked_text``. See ``build`` for nulls and repeated rows."""
    m = build(docs, checked_text, fields)
    root, back = F.lit(m.root).cast("string"), folded(F.col("checked"), F.col("steps"))
    out = proofs(m).select(F.col("id").alias(fields[0]), "leaf", "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 is a multiple of 5 are checked with a text in lower case; a null id has no crc32, so its row isn't."""
    crc = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    tampered = F.when(F.pmod(crc, F.lit(5)) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered)


ORACLE_SQL = r"""
WITH RECURSIVE polynomial AS (
  SELECT i, i AS t, 0 AS bit FROM (SELECT unnest(range(256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, bit + 1 FROM polynomial WHERE bit < 8
), crc_table AS (
  SELECT list(t ORDER BY i) AS ts FROM polynomial WHERE bit = 8
), crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: xor(crc >> 8, ts[(xor(crc, byte) & 255) + 1]))) AS crc
  FROM documents, crc_table
), checked AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS checked_text
  FROM documents JOIN crcs USING (doc_id)
), encoded AS (
  SELECT doc_id, source, text, checked_text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM checked
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(checked_text) || ':' || checked_text, '-')) AS checked_leaf,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM encoded
), nodes AS (
  SELECT source, 0 AS level, idx, n AS width, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, (any_value(width) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE width > 1 GROUP BY source, level, idx // 16
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM nodes WHERE width = 1
), top AS (
  SELECT 0 AS level, tree AS idx, trees AS width, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (any_value(width) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM top WHERE width > 1 GROUP BY level, idx // 16
), all_nodes AS (
  SELECT source, false AS upper, level, idx, width, digest FROM nodes
  UNION ALL
  SELECT NULL, true, level, idx, width, digest FROM top
), paths AS (
  SELECT l.doc_id, s.upper * 100 + v.level AS step, s.upper, CASE WHEN s.upper = 1 THEN NULL ELSE l.source END AS source,
    v.level AS level, (CASE WHEN s.upper = 1 THEN r.tree ELSE l.idx END) >> (4 * v.level) AS at
  FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source, (VALUES (0), (1)) s(upper), (SELECT unnest(range(12)) AS level) v
  WHERE ((CASE WHEN s.upper = 1 THEN r.trees ELSE l.n END) + (1::BIGINT << (4 * v.level)) - 1) >> (4 * v.level) > 1
), sides AS (
  SELECT p.doc_id, p.step, coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx < p.at), '') AS before,
    coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx > p.at), '') AS after
  FROM paths p JOIN all_nodes a ON a.upper = (p.upper = 1) AND a.source IS NOT DISTINCT FROM p.source AND a.level = p.level AND a.idx >> 4 = p.at >> 4
  GROUP BY p.doc_id, p.step
), steps AS (
  SELECT doc_id, list({'a': before, 'b': after} ORDER BY step) AS path, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY doc_id
), fold AS (
  SELECT doc_id, checked_leaf AS acc, 1 AS k, path FROM leaves LEFT JOIN steps USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(path[k].a || acc || path[k].b), k + 1, path FROM fold WHERE k <= len(path)
)
SELECT l.doc_id, l.leaf, r.subroot, t.digest AS root, coalesce(s.proof_sha256, sha256('')) AS proof_sha256,
  f.acc AS folded_root, f.acc = t.digest AS verified
FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source LEFT JOIN steps s USING (doc_id)
JOIN fold f ON f.doc_id = l.doc_id AND f.k = coalesce(len(f.path), 0) + 1, (SELECT digest FROM top WHERE width = 1) t
"""
