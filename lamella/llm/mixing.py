"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import sized_broadcast, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 7
#: Words in a block; words a shard of a source has on average; shards a source has at most.
BLOCK, SHARD_WORDS, MOST_SHARDS = 16, 1 << 15, 1 << 16
#: Primes above any number of blocks in a shard: each steps through all blocks before it repeats one.
STEPS = (1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size, ...): ``share`` of all words by weights that repeat over the
    sources in code-point order, null last; no target is above ``most`` times its source, and the excess goes to the others by weight.

    Sources are capped in order of cap over weight: the k-th is capped if the level that the first k-1 leave is not below its
    own ratio. One row per source; the windows are over this small table."""
    one = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    one = one.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    one = one.withColumn("_level", left / open_w).withColumn("_capped", F.col("_level") >= F.col("_cap") / F.col("_w"))
    level = F.min_by(F.when(~F.col("_capped"), F.col("_level")), F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "_rank"))).over(everything)
    return one.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * level))).drop("_rank", "_w", "_cap", "_level", "_capped")


def apportion(claims: DataFrame, by: list[str], claim: str, seats: str, order: list[str]) -> DataFrame:
    """``claims`` with quota: ``seats`` (constant within ``by``) dealt to the highest quotients claim / (2k - 1), ties by ``order``.

    Seats that are certain come by rounding with a divisor that can't deal too many; only the few that are open, about two for
    each claimant, are ranked by quotient. So the cost follows the number of claimants, not that of seats."""
    group = Window.partitionBy(*by)
    c = claims.withColumn("_n", F.count("*").over(group)).withColumn("_sum", F.sum(claim).over(group))
    unit = F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(0.0)
    sure = F.greatest(F.lit(0), F.floor(unit * F.greatest(F.lit(0.0), F.col(seats) - F.col("_n") / 2 - 1) + 0.5))
    most = F.ceil(unit * (F.col(seats) + F.col("_n") / 2 + 1) + 0.5)
    c = c.withColumn("_sure", sure.cast("long")).withColumn("_most", F.greatest(most.cast("long"), sure.cast("long"))).withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    tried = c.withColumn("_k", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, "_most"))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce(F.col(claim) / (2 * F.col("_k") - 1), F.lit(-1.0)).desc(), *order))
    won = tried.withColumn("_won", (F.col("_k").isNotNull() & (rank <= F.col("_left")) & (F.col(claim) > 0)).cast("long"))
    keys = [x for x in claims.columns]
    return won.groupBy(*keys, "_sure").agg(F.sum("_won").alias("_won")).withColumn("quota", F.col("_sure") + F.col("_won")).drop("_sure", "_won")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col``, size, source, source_size, target, taken (and the columns ``keep``) for each row of ``docs``.

    Each source's documents are dealt by hash to shards of about ``shard_words`` words, laid end to end within a shard and cut
    into blocks of ``block`` words. Sainte-Laguë apportionment deals blocks to sources by target, then to a source's shards by
    size. A shard with a quota over its number of blocks takes all of them once, and of the rest as many as are missing, by a
    seeded step through the blocks. A document's ``taken`` is the sum of its words in taken blocks, repeats counted.

    Null texts have no words. A null source is a source, last in order. Rows that share an id and a text may take different
    words; ids may be null. With no words at all, targets are 0. Reruns agree.

    The hot source is spread over its shards, so no task holds a source; the two windows run over one row per source or shard."""
    return _taken(docs, weights, share, most, seed, block, shard_words, id_col, text_col, source_col, keep).select(id_col, "size", "source", "source_size", "target", "taken", *keep)


def _taken(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block: int = BLOCK, shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of ``mix`` with their place (_sid, _shard, _h) and the columns ``keep``."""
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"), *keep)
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    t = source_targets(stored(sizes), weights, share, most)
    t = t.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    t = stored(apportion(t.withColumn("_all", F.lit(0)), ["_all"], "target", "_seats", ["source"]).drop("_all", "_seats"))
    t = t.withColumn("_shards", F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("_docs")) / shard_words))).cast("long")).withColumnRenamed("quota", "_seats")
    # a number for each source, so that nulls and names don't keep later steps from sharing one shuffle
    t = t.withColumn("_sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumnRenamed("source", "_source").drop("_docs")
    dealt = d.join(sized_broadcast(stored(t)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_shard", F.pmod("_h", "_shards"))
    shards = dealt.groupBy("_sid", "_shard").agg(F.sum("size").alias("_words"), F.max("_seats").alias("_seats"))
    q = stored(apportion(shards, ["_sid"], "_words", "_seats", ["_shard"]).select("_sid", "_shard", "_words", "quota"))
    w = Window.partitionBy("_sid", "_shard").orderBy("_h", F.col("id").asc_nulls_last(), "size")
    laid = dealt.withColumn("_end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("size"))
    laid = laid.join(q, ["_sid", "_shard"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_words") / block)).cast("long")
    laid = laid.withColumn("_blocks", blocks).withColumn("_quota", F.least(F.col("quota"), most * F.col("_blocks")))
    laid = laid.withColumn("_full", F.floor(F.col("_quota") / F.col("_blocks"))).withColumn("_more", F.col("_quota") % F.col("_blocks"))
    turn = F.xxhash64(F.lit(seed), "source", "_shard")
    laid = laid.withColumn("_step", F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(turn, F.lit(len(STEPS))) + 1).cast("int")).cast("long")).withColumn("_turn", F.pmod(turn, "_blocks"))

    def words(got: Column, b: Column) -> Column:
        inside = F.least(F.col("_end"), (b + 1) * block) - F.greatest(F.col("_start"), b * block)
        return got + inside * (F.col("_full") + F.when(F.pmod(b * F.col("_step") + F.col("_turn"), F.col("_blocks")) < F.col("_more"), 1).otherwise(0))

    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)), F.lit(0).cast("long"), words))
    return laid.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", taken.alias("taken"), "_sid", "_shard", "_h", *keep)


def mixed_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as taken / size says, rounded. Rows without words (null, empty or blank
    text) take no part in the mix and come once each.

    Within a shard, long documents first, taken / size is summed up with one seeded start, and a document comes as often as the
    sum passes a whole number. So remainders cancel, a shard's words miss its share by no more than its longest document has, and the mean is kept."""
    packed = docs.select(F.col(id_col), F.col(text_col), F.col(source_col), F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    # whole numbers of 2^-32, so that sums are exact
    part = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size") * float(1 << 32))).otherwise(0).cast("long")
    w = Window.partitionBy("_sid", "_shard").orderBy(F.col("size").desc(), "_h", F.col("id").asc_nulls_last(), "taken")
    start = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source", "_shard"), 32)
    upto, before = F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, -1))
    mixed = _taken(packed, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, keep=("_row",), **settings).withColumnRenamed(id_col, "id").withColumn("_part", part)
    times = F.when(F.col("size") > 0, F.shiftright(start + upto, 32) - F.shiftright(start + F.coalesce(before, F.lit(0)), 32)).otherwise(1).cast("int")
    return mixed.select("_row", times.alias("_times")).select(F.explode(F.array_repeat("_row", F.col("_times"))).alias("r")).select("r.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")
