"""What the two classifiers share: a bounded sample of labelled rows, by hash, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import stored

#: Bytes of text that a model learns from at most.
MOST_BYTES = 64 << 20
#: A text of over one in so many of those bytes is a big one.
BIG = 16


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text", ones: float = 0.5, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, text, y for at most ``most`` labelled rows outside the fold ``held_out``, of which ``ones`` from label 1 as far as there are so
    many, least hashes first; then as many of them, by hash again, as hold ``most_bytes`` bytes of text together. Texts of over a ``BIG``th
    of that come after all others, the smaller ones first, so that no text of any length keeps others out; an error if none fits at all.

    Rows without an id or with a label other than 0 and 1 aren't used; an id with both labels isn't either. Null texts have no bytes. An id
    of several documents has the least text. The ids are at most ``most``, so they are broadcast, and texts aren't shuffled but for the sample."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").drop("z")
    known = known.filter(remainder(F.col("id"), parts) != held_out).withColumn("h", F.xxhash64(F.lit(3), "id"))
    positive, negative = (known.filter(F.col("y") == y).orderBy("h", "id").limit(n) for y, n in ((1, int(most * ones)), (0, most - int(most * ones))))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(positive.unionByName(negative)), "id")
    found = stored(found.groupBy("id").agg(F.min(F.struct("text", "y", "h")).alias("r")).select("id", "r.*"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    big = F.when(F.col("size") * BIG > most_bytes, F.col("size")).otherwise(0)
    upto = Window.orderBy(big, "h", "id").rowsBetween(Window.unboundedPreceding, 0)  # over ``most`` rows of a few bytes
    fits = stored(found.select("id", "h", size.alias("size")).withColumn("bytes", F.sum("size").over(upto)).filter(F.col("bytes") <= most_bytes))
    if fits.isEmpty() and not found.isEmpty():
        raise ValueError(f"no labelled text has {most_bytes} bytes or fewer")
    return found.join(F.broadcast(fits.select("id")), "id").select("id", "text", "y")
