"""Benchmark decontamination: a positional index over the corpus is stored once; the lists of a window's rarest terms, adjusted by their
offsets, are intersected, and the rest of the window is compared at the place they agree on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower, at_most, digest, scratch, sized_broadcast, stored

WINDOW = 10
#: Rows of asked terms or lists that are broadcast at once, each of at most a few hundred bytes.
LIST_ROWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
Temp = Callable[[DataFrame], DataFrame]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def terms(text: Column) -> Column:
    """64-bit hashes of a text's words, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def positional_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1, k2, terms for each row of ``docs``: the term at each position. The only pass that reads and splits texts.

    The index is kept by document, as a search engine's shard is, so lists of one document are intersected where they lie; ``postings``
    turns it to (term, document, position)."""
    k1, k2 = digest(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), terms(F.col(text_col)).alias("terms"))


def postings(index: DataFrame, asked: DataFrame) -> DataFrame:
    """k1, k2, terms, pos and the columns of ``asked`` (term, ...; at most ``LIST_ROWS`` rows, which are broadcast) for each place of an
    asked term: a list for each term. ``terms`` is the document's own array, which a plan that reads it in the same stage doesn't copy."""
    return index.select("k1", "k2", "terms", F.posexplode("terms").alias("pos", "term")).join(F.broadcast(asked), "term")


def test_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """item, win, len, w1, w2: each run of ``n`` words of an item, as terms and as 128 bits; an item of fewer words, but not none, is one run."""
    w = items.select(F.col(id_col).cast("string").alias("item"), terms(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - n))).alias("s")
    w = w.select("item", "w", starts).select("item", F.slice("w", F.col("s") + 1, n).alias("win"))
    return w.select("item", "win", F.size("win").alias("len"), *(h.alias(k) for h, k in zip(digest(F.col("win")), ("w1", "w2"), strict=True))).distinct()


def phrase_matches(index: DataFrame, windows: DataFrame, temp: Temp) -> DataFrame:
    """k1, k2, start, len, w1, w2 of every exact occurrence in ``index`` of a window of ``windows`` (win, len, w1, w2).

    Corpus counts rank a window's terms; a term that is nowhere in the corpus rules its window out. Each place of the rarest term gives
    a start, which must be a start for the list of the second rarest too, and there all terms are compared. All this happens at the
    document's own row, so nothing is shuffled but the matches. A frequent rarest term costs a look a place, not a row that is sent.
    Items of more windows than may be broadcast are taken in blocks, each against the whole index."""
    windows = windows.select("win", "len", "w1", "w2").distinct()
    spots = windows.select("w1", "w2", F.posexplode("win").alias("off", "term"))
    asked = spots.select("term").distinct()
    found = postings(index, asked) if at_most(asked, LIST_ROWS) else index.select(F.explode("terms").alias("term"))
    counts = found.groupBy("term").agg(F.count("*").alias("cf"))
    order = Window.partitionBy("w1", "w2").orderBy("cf", "off")
    ranked = spots.join(counts, "term", "left").withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    first = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    lists = ranked.groupBy("w1", "w2").agg(first(1, "cf").alias("cf"), first(1, "term").alias("term"), first(1, "off").alias("off"), first(2, "term").alias("term2"), first(2, "off").alias("off2"))
    lists = temp(lists.filter("cf is not null").drop("cf").join(windows, ["w1", "w2"]))
    start = F.col("pos") - F.col("off")
    second = F.col("term2").isNull() | (F.get("terms", start + F.col("off2")) == F.col("term2"))
    inside = (start >= 0) & (start + F.col("len") <= F.size("terms"))
    same = F.slice("terms", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")
    blocks = max(1, -(-lists.count() // LIST_ROWS))
    # more lists than are broadcast at once go over the index in blocks; twice as many blocks keep each below the bound
    deal = [F.lit(True)] if blocks == 1 else [F.pmod(F.xxhash64("w1", "w2"), F.lit(2 * blocks)) == i for i in range(2 * blocks)]
    parts = [postings(index, lists.filter(part)).filter(inside & second & same) for part in deal]
    return reduce(DataFrame.unionByName, (p.select("k1", "k2", start.alias("start"), "len", "w1", "w2") for p in parts)).distinct()


def proximity_matches(docs: DataFrame, asked: list[str], within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, start, stop of each shortest run of at most ``within`` words that ends at a term and holds all terms ``asked``, in any order.

    Terms are words, A-Z lower-cased; a repeated one counts once. No terms: no runs. Null and empty texts have no words. Rows that
    share id and text get the same runs, each. Ids may be null. A running maximum of each term's last place gives the run; the window is over one document's postings."""
    asked = list(dict.fromkeys(x.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})) for x in asked))
    index = positional_index(docs, id_col, text_col)
    if not asked:
        return index.select(F.col("id").alias(id_col), F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0)
    spark = docs.sparkSession
    known = spark.createDataFrame([(t, i) for i, t in enumerate(asked)], "word string, no int").select(F.xxhash64("word").alias("term"), "no")
    p = postings(index.dropDuplicates(["k1", "k2"]), known).select("k1", "k2", "pos", "no")
    upto = Window.partitionBy("k1", "k2").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("no") == i, F.col("pos"))).over(upto) for i in range(len(asked))]
    have = p.select("k1", "k2", "pos", F.array(*last).alias("last"))
    have = have.filter(F.forall("last", lambda x: x.isNotNull())).select("k1", "k2", F.array_min("last").alias("start"), F.col("pos").alias("stop"))
    found = have.filter(F.col("stop") - F.col("start") < within)
    return index.select("id", "k1", "k2").join(found, ["k1", "k2"]).select(F.col("id").alias(id_col), "start", "stop")


def decontaminate(
    docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``id_col``, n_words, n_hit, items (sorted ids as strings) for each row of ``docs``; a word inside any occurrence of a window of an item is hit.

    Null and wordless texts have no words and no hits. Rows that share id and text get the same result. Ids may be null. An item
    with a null id hits words, but isn't listed. No items: no hits. Other columns of ``docs`` and ``items`` are ignored."""
    index = stored(positional_index(docs, id_col, text_col))
    with scratch(docs.sparkSession) as temp:
        windows = temp(test_windows(items, n, item_id, item_text))
        hits = temp(phrase_matches(index, windows, temp))
        places = F.flatten(F.transform(F.collect_set(F.struct("start", "len")), lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))
        spots = hits.groupBy("k1", "k2").agg(F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
        named = hits.select("k1", "k2", "w1", "w2").distinct().join(sized_broadcast(windows.select("w1", "w2", "item")), ["w1", "w2"])
        found = stored(spots.join(named.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items")), ["k1", "k2"], "left"))
    out = index.select("id", "k1", "k2", F.size("terms").cast("long").alias("n_words")).join(found, ["k1", "k2"], "left")
    no_items = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", no_items).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns. Nulls and repeats as in ``decontaminate``."""
    with scratch(docs.sparkSession) as temp:
        index = temp(positional_index(docs, id_col, text_col))
        hits = stored(phrase_matches(index, temp(test_windows(items, n, item_id, item_text)), temp).select("k1", "k2").distinct())
    k1, k2 = digest(F.col(id_col), F.col(text_col))
    packed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))  # so that no column's name can clash
    return packed.join(sized_broadcast(hits), ["k1", "k2"], "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_aggregate(w[s + 1 : s + least(10, len(w))], 'string_agg', ' ') AS phrase, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), spots AS (
  SELECT doc_id, n, s, list_aggregate(w[s + 1 : s + n], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, spots.n, item_id FROM spots JOIN win ON spots.phrase = win.phrase AND spots.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
