"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import BLANKS, ascii_lower, digest, scratch, sized_broadcast, sized_join, stored

#: Line length in code points and number of documents from which a line counts as repeated.
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of 16 bytes that may be broadcast.
KEY_ROWS = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(line: Column, min_chars: int) -> Column:
    """Two longs for a line that counts, null for a short one. A line shorter than the limit before trimming needs no trimming."""
    key = line_key(line)
    long = (F.char_length(line) >= min_chars) & (F.char_length(F.btrim(line, F.lit(BLANKS))) >= min_chars)
    return F.when(long, F.struct(*(F.xxhash64(F.lit(i), key).alias(f"h{i}") for i in (1, 2))))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, kept_text, n_lines, n_dropped for each row of ``docs``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents keep their lines only in the
    largest id that holds them. Null and empty texts are one empty line. Rows that share an id are one document when
    documents are counted, and each keeps its own lines by the same rule. A null id is one more document, below all
    others. Other columns of ``docs`` are ignored, so their names can't clash. Empty in, empty out.

    Lines are hashed once, into a stored table of (document, hashes, positions). Documents are counted in two grouped steps, both with
    partial sums, so one line in a third of all documents costs each task one row. Positions to drop go back to the texts that have
    any; other texts aren't shuffled, and a text's lines are taken by position, in one pass."""
    k1, k2 = digest(F.col(id_col), F.col(text_col))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    lines = _lines(F.col("text"))
    with scratch(docs.sparkSession) as temp:
        hashed = F.transform(lines, lambda x, i: F.struct(_hashed(x, min_chars).alias("h"), i.alias("pos")))
        found = d.select("id", "k1", "k2", F.explode(F.filter(hashed, lambda x: x["h"].isNotNull())).alias("x"))
        found = temp(found.select("id", "k1", "k2", "x.h.*", "x.pos"))
        # a line may come several times in a document, and a document in several rows
        once = found.groupBy("h1", "h2", "id").agg(F.count("*").alias("rows"))
        repeated = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("id").alias("last"))
        repeated = temp(repeated.filter(F.col("n") >= min_docs).select("h1", "h2", "last", "rows"))
        drops = sized_join(found, repeated, ["h1", "h2"], "rows", found.count()).filter(~F.col("id").eqNullSafe(F.col("last")))
        drops = stored(drops.groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop")))
    some = sized_broadcast(drops.select("k1", "k2"), KEY_ROWS)
    touched = d.join(some, ["k1", "k2"], "left_semi").join(drops, ["k1", "k2"]).select("id", lines.alias("lines"), "drop")
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.transform(rest, lambda i: F.get("lines", i))
    touched = touched.select("id", F.array_join(kept, "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))
    intact = d.join(some, ["k1", "k2"], "left_anti")
    intact = intact.select("id", F.coalesce("text", F.lit("")).alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return touched.unionByName(intact).withColumnRenamed("id", id_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), repeated AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.k IS NOT NULL AND l.doc_id <> r.last) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (r.k IS NULL OR l.doc_id = r.last), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON l.k = r.k GROUP BY l.doc_id
"""
