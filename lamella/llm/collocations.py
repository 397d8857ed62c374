"""Phrase collocation mining: frequent words get numbers, pieces break at others, runs of numbers become fixed-width binary keys, and a range-partitioned
radix sort with run-length counts gives the frequency of every phrase."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower, at_most, numbered, scratch, sized_broadcast, sized_join, small_batches, stored
from lamella.llm.tokens import mix64, pieces, split

#: Occurrences a phrase needs, longest phrase in words, and phrases returned for each language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a dictionary that is broadcast; a larger one is joined. Keys sorted at once, and keys of a range on average.
MOST_WORDS, BLOCK, RANGE_KEYS = 1_000_000, 1 << 20, 1 << 20
#: Texts, and keys of each, in the sample that range splitters are drawn from; these set how even ranges are, nothing else.
SAMPLE_TEXTS, SAMPLE_KEYS, SEED = 2000, 256, 7
MARKS, SPACES = ".,;:!?\n\x0b\x0c\r", " \t"
_MARK, _APART = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_APART[list((MARKS + SPACES).encode())] = True

BLOCKS = "part int, n int, keys binary, counts binary"


def _word_keys(hashes: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """What tells a word of a language apart from others: 64 bits of both."""
    return mix64(hashes ^ mix64(lang.view(np.uint64)))


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offs in pieces(batch.column("word")):
            rows = len(offs) - 1
            key = _word_keys(split(data, offs, _APART).hash, batch.column("lang").to_numpy()[first : first + rows])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id").slice(first, rows)], ["key", "id"])


def _with_breaks(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``ids`` with a 0 before each one that is ``new`` to its run, and zeros at the end."""
    at = np.arange(len(ids)) + np.cumsum(new)
    out = np.zeros((at[-1] + 1 if len(at) else 0) + LONGEST, np.int64)
    out[at] = ids
    return out


def _from_texts(batches: Iterator[pa.RecordBatch], known: np.ndarray, numbers: np.ndarray) -> Iterator[np.ndarray]:
    """The words of texts as numbers, 0 for words that aren't in the dictionary and for breaks."""
    for batch in batches:
        langs = batch.column("lang").to_numpy()
        for first, data, offs in pieces(batch.column("text")):
            w = split(data, offs, _APART)
            if not len(w.hash):
                continue
            key = _word_keys(w.hash, langs[first : first + len(offs) - 1][w.doc])
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            ids = np.where(known[at] == key, numbers[at], 0) if len(known) else np.zeros(len(key), np.int64)
            marks = np.concatenate([[0], np.cumsum(_MARK[data])])
            new = np.ones(len(ids), bool)
            new[1:] = (marks[w.start[1:]] != marks[w.end[:-1]]) | (np.diff(w.doc) != 0)
            yield _with_breaks(ids, new)


def _from_places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """As ``_from_texts``, from the joined (place, id) of each piece."""
    for batch in batches:
        column = batch.column("found")
        found, offs = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
        place, ids = found.field("pos").to_numpy(), found.field("id").to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = np.diff(place) != 1
        new[offs[:-1][np.diff(offs) > 0]] = True
        yield _with_breaks(ids, new)


def keys_of(ids: np.ndarray, digits: int) -> np.ndarray:
    """A key for each place that begins a phrase of two words or more: the next ``LONGEST`` numbers up to the first 0, each of ``digits``
    16-bit digits, high ones first."""
    at = np.flatnonzero((ids[:-LONGEST] != 0) & (ids[1 : len(ids) - LONGEST + 1] != 0)) if len(ids) > LONGEST else np.zeros(0, np.int64)
    out = np.zeros((len(at), LONGEST * digits), np.uint16)
    alive = np.ones(len(at), bool)
    for k in range(LONGEST):
        part = ids[at + k] * alive
        alive &= part != 0
        for j in range(digits):
            out[:, k * digits + j] = (part >> (16 * (digits - 1 - j))) & 0xFFFF
    return out


def radix_sorted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each comes: a stable pass for each 16-bit digit from the last to the first (numpy's stable sort of 16 bits is a
    radix sort), then run lengths."""
    order = np.arange(len(keys))
    for c in range(keys.shape[1] - 1, -1, -1):
        digit = keys[order, c]
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit, kind="stable")]
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(starts, len(keys))) if counts is None else np.add.reduceat(counts[order], starts) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], sums.astype(np.int64)


def as_bytes(keys: np.ndarray) -> np.ndarray:
    """Keys as fixed-width strings of bytes, whose order is that of the keys."""
    width = 2 * keys.shape[1]
    return np.frombuffer(keys.astype(">u2").tobytes(), f"S{width}") if len(keys) else np.zeros(0, f"S{width}")


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return tuple(pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in (keys.T, counts))


def _sorted_blocks(ids: Iterator[np.ndarray], digits: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCKS``: each block of keys sorted, counted, and cut at the splitters."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def cut(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = radix_sorted(np.concatenate(held))
        ends = np.append(np.searchsorted(as_bytes(keys), splitters), len(keys))
        starts = np.concatenate([[0], ends[:-1]])
        parts = np.flatnonzero(ends > starts)
        blobs = [_packed(keys[starts[p] : ends[p]], counts[starts[p] : ends[p]]) for p in parts]
        columns = [parts.astype(np.int32), (ends - starts)[parts].astype(np.int32), [b[0] for b in blobs], [b[1] for b in blobs]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    held, n = [], 0
    for some in ids:
        for start in range(0, len(some) - LONGEST, BLOCK):  # a long text is cut, with what its last keys need
            held.append(keys_of(some[start : start + BLOCK + LONGEST], digits))
            n += len(held[-1])
            if n >= BLOCK:
                yield cut(held)
                held, n = [], 0
    if n:
        yield cut(held)


def _phrases(batches: Iterator[pa.RecordBatch], digits: int, least: int) -> Iterator[pa.RecordBatch]:
    """key, a for the phrases of one range: those found ``least`` times, and the first and last of each length whatever their count, as the ranges
    beside this one may hold more of them. A key has the numbers of the phrase's own words only."""
    keys, counts, held = np.zeros((0, LONGEST * digits), np.uint16), np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return radix_sorted(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([counts, *(c for _, c in held)]))

    n = 0
    for batch in batches:
        for size, blob, sums in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True):
            some = np.frombuffer(pa.decompress(blob, size * 2 * LONGEST * digits, "zstd", asbytes=True), np.uint16).reshape(LONGEST * digits, size).T
            held.append((some, np.frombuffer(pa.decompress(sums, size * 8, "zstd", asbytes=True), np.int64)))
            n += size
            if n > 2 * RANGE_KEYS:
                keys, counts = merged()
                held, n = [], 0
    keys, counts = merged()
    for m in range(2, LONGEST + 1):
        whole = (keys[:, (m - 1) * digits : m * digits] != 0).any(axis=1)
        k, c = keys[whole][:, : m * digits], counts[whole]
        if not len(k):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        sums = np.add.reduceat(c, starts)
        take = sums >= least
        take[[0, -1]] = True
        raw, width = np.ascontiguousarray(k[starts[take]].astype(">u2")).tobytes(), 2 * m * digits
        yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), pa.array(sums[take])], ["key", "a"])


def _encoder(docs: DataFrame, dictionary: DataFrame, most_words: int):
    """(rows, how a task turns them to numbers). A dictionary of up to ``most_words`` words goes to all tasks as two sorted arrays; with a larger one,
    words are joined with it, and pieces put together again."""
    spark = docs.sparkSession
    if at_most(dictionary, most_words):
        table = dictionary.select("word", F.xxhash64("lang").alias("lang"), "id").mapInArrow(_hashed_words, "key long, id long").toArrow()
        key, numbers = table.column("key").to_numpy().view(np.uint64), table.column("id").to_numpy()
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], numbers[order]))
        return docs.select("text", F.xxhash64("lang").alias("lang")), lambda batches: _from_texts(batches, *sent.value)
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "lang", F.posexplode(F.split(ascii_lower(F.col("text")), f"[{MARKS}]")).alias("piece", "t"))
    words = F.filter(F.split("t", f"[{SPACES}]+"), lambda x: x != "")
    each = each.select("row", "piece", "lang", F.posexplode(words).alias("pos", "word"))
    total = dictionary.agg(F.sum("n")).first()[0]
    each = sized_join(each, dictionary.select("lang", "word", "id", F.col("n").alias("weight")), ["lang", "word"], "weight", total, most_words)
    each = each.groupBy("row", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("found"))
    return each.select("found"), _from_places


def _splitters(rows: DataFrame, encode, digits: int, parts: int) -> np.ndarray:
    """``parts`` - 1 keys that cut a sample of the distinct keys evenly."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_by_one = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
        for ids in encode(one_by_one):
            keys = keys_of(ids, digits)
            keys = keys[:: max(1, -(-len(keys) // SAMPLE_KEYS))]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(k) for k in keys.astype(">u2")], pa.binary())], ["key"])

    n = rows.count()
    some = rows.sample(min(1.0, SAMPLE_TEXTS / max(1, n)), SEED).mapInArrow(drawn, "key binary").distinct().toArrow().column("key")
    keys = np.sort(np.array(some.to_pylist(), f"S{2 * LONGEST * digits}"))
    return np.unique(keys[np.linspace(0, len(keys), parts, endpoint=False).astype(int)[1:]]) if len(keys) else keys


def phrase_counts(docs: DataFrame, dictionary: DataFrame, digits: int, least: int, most_words: int) -> DataFrame:
    """key, a for each phrase of 2 to ``LONGEST`` words found ``least`` times or more; stored. docs: text, lang.

    A task sorts and counts its own keys before anything is sent, so a passage in a third of all texts is one row a task; rows are blocks
    of keys for a range, and a range is one task's. A phrase that runs over the end of a range is summed in a last, small step."""
    spark = docs.sparkSession
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_KEYS)
    with small_batches(spark):
        rows, encode = _encoder(docs, dictionary, most_words)
        splitters = _splitters(rows, encode, digits, parts)
        blocks = rows.mapInArrow(lambda batches: _sorted_blocks(encode(batches), digits, splitters), BLOCKS)
        found = blocks.repartitionById(len(splitters) + 1, F.col("part")).mapInArrow(lambda batches: _phrases(batches, digits, least), "key binary, a long")
        return stored(found.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, a and phrase.

    Null texts are empty; null languages are ``und``, and so are texts that say so. Repeated rows count each. Other columns are ignored, so names can't clash.
    Empty in, empty out. Every word of a phrase found ``least`` times is found as often, so only such words are numbered.

    Words are told apart by 64 bits where a task looks them up; all counts, joins and scores are exact (decimals of 38 digits)."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    d = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    word = F.explode(F.split(ascii_lower(F.col("text")), f"[{MARKS}{SPACES}]+")).alias("word")
    with scratch(docs.sparkSession) as temp:
        counted = d.select("lang", word).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
        frequent = F.when(F.col("n") >= least, F.col("word")).alias("word")  # all others of a language are one row
        counted = temp(counted.groupBy("lang", frequent).agg(F.sum("n").alias("n")))
        totals = sized_broadcast(temp(counted.groupBy("lang").agg(F.sum("n").alias("n"))))
        dictionary = numbered(counted.filter("word is not null"), [], [F.col("lang"), F.col("word")], "id").withColumn("id", F.col("id") + 1)
        dictionary = temp(dictionary)
        words = dictionary.count()
        digits = 1 if words < 1 << 16 else 2
        width = 2 * digits
        found = phrase_counts(d, dictionary, digits, least, most_words)
        # numbers as bytes: the lower digits of eight
        single = dictionary.select(F.unhex(F.right(F.lpad(F.hex("id"), 16, "0"), F.lit(2 * width))).alias("key"), F.col("n").alias("a"))
        known = temp(found.unionByName(single))
        key, m = F.col("key"), (F.octet_length("key") / width).cast("int")
        cuts = found.select("key", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
        cuts = temp(cuts.select("*", F.call_function("substring", key, F.lit(1), F.col("k") * width).alias("first"), F.call_function("substring", key, F.col("k") * width + 1).alias("rest")))
        n = cuts.count()
        for side, name in (("first", "l"), ("rest", "r")):
            asked = cuts.groupBy(side).agg(F.count("*").alias("weight"))
            values = temp(asked.join(known.select(F.col("key").alias(side), F.col("a").alias(name)), side))
            cuts = temp(sized_join(cuts, values, [side], "weight", n))
        # within a longer candidate as often: then within one that is longer by a word, too
        longer = found.filter(m > 2).select("a", F.explode(F.array(F.call_function("substring", key, F.lit(1), (m - 1) * width), F.call_function("substring", key, F.lit(width + 1)))).alias("key"))
        own = found.join(longer.distinct(), ["key", "a"], "left_anti")
        spelled = own.select("key", F.posexplode(F.sequence(F.lit(0), m - 1)).alias("at", "_k"))
        spelled = temp(spelled.select("key", "at", F.call_function("substring", key, F.col("at") * width + 1, F.lit(width)).alias("word_key")))
        asked = spelled.groupBy("word_key").agg(F.count("*").alias("weight"))
        named = dictionary.select(F.unhex(F.right(F.lpad(F.hex("id"), 16, "0"), F.lit(2 * width))).alias("word_key"), "lang", "word")
        spelled = sized_join(spelled, temp(asked.join(named, "word_key")), ["word_key"], "weight", spelled.count())
        spelled = spelled.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"), F.first("lang").alias("lang"))
        phrase = F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("phrase")
        spelled = spelled.select("key", "lang", phrase).join(totals, "lang")
        scored = cuts.join(spelled, "key").withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
        best = scored.groupBy("key", "lang", "phrase", "n", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
        best = temp(best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score"))
        ranked = numbered(best, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")])
        ranked = ranked.filter(F.col("place") < top)
        return stored(ranked.select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH piece AS (
  SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda w: w <> '') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase
  FROM piece, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m
), counted AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), often AS MATERIALIZED (
  SELECT lang, phrase, f FROM counted WHERE f >= 100
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counted WHERE m > 1 AND f >= 100
), parts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), cuts AS (
  SELECT p.lang, p.phrase, p.a, k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * p.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN totals t USING (lang) JOIN often x ON x.lang = p.lang AND x.phrase = p.head JOIN often y ON y.lang = p.lang AND y.phrase = p.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS size FROM candidates)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
