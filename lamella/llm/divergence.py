"""Quality rules: distribution divergence. A document's histograms of character classes and of common words are compared with references of
its language by Jensen-Shannon distance, with guards for short documents and thin references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import BLANKS, scratch, sized_broadcast, sized_join, stored

#: Limits of the base rules: least words, largest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Common words of a language; distances allowed to character classes and to common words; times the divergence that chance alone gives a document
#: of its length, which is allowed besides; words that a reference must hold to judge by.
COMMON, CHAR_LIMIT, WORD_LIMIT, CHANCE, LEAST_REFERENCE = 32, 0.17, 0.17, 1.5, 2000
#: Signs that are in no other class; what is in none of these is small Latin letters.
CLASSES = {"upper": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-", "sign": r"#$%&*+/<=>@\[\\\]\^_`{|}~", "far": r"\x{80}-\x{10FFFF}"}
#: Languages whose common words may be broadcast.
LANGUAGES = 10_000
SYMBOLS = "#*$%&|<>"
KINDS = ("lower", *CLASSES, "blank")


def words_of(text: Column) -> Column:
    """Runs of characters that aren't blanks; null has none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _count(text: Column, members: str) -> Column:
    """How many characters of a class a text has: what is left without the others."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", "")).cast("long")


def _repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(d: DataFrame, hashes: str, out: str) -> DataFrame:
    """``d`` with, in ``out``, how many of the words (``hashes``: array of long) lie in windows of three words found twice or more.

    Each window becomes one long, the upper bits of its hash above its place, so that a sort of plain longs brings equal windows
    together; neighbours that share those bits are compared by their whole hashes. Places get as many bits as the text needs."""
    h, n = F.col(hashes), F.size(hashes)
    window = F.transform(F.slice(h, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    d = d.withColumns({"_window": window, "_bits": F.length(F.bin(n))})
    packed = F.transform("_window", lambda x, i: F.call_function("shiftleft", x, F.col("_bits")).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct("_window")) < F.size("_window")  # most texts repeat no window and need no sort
    d = d.withColumn("_sorted", F.when(some, F.sort_array(packed)).otherwise(F.array().cast("array<long>"))).withColumn("_mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)

    def same(x: Column, y: Column) -> Column:
        upper = F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("_bits")) == 0
        whole = lambda z: F.get("_window", z.bitwiseAND(F.col("_mask")).cast("int"))
        return F.coalesce(upper & (whole(x) == whole(y)), F.lit(False))

    twice = F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i - 1)) | same(x, F.get("_sorted", i + 1)))
    d = d.withColumn("_twice", F.transform(twice, lambda x: x.bitwiseAND(F.col("_mask"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_twice", lambda p: F.array(p, p + 1, p + 2)))))
    return d.withColumn(out, F.when(F.size("_twice") > 0, covered).otherwise(0).cast("long")).drop("_window", "_bits", "_sorted", "_mask", "_twice")


def common_words(d: DataFrame, k: int = COMMON) -> DataFrame:
    """lang, common (array of hashes) of the ``k`` most frequent words of each language, by count over all texts, then by word; d: lang, text.

    Counts are summed within tasks first; at most ``k`` words of a language leave a task for the last choice."""
    words = d.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("slot", place).filter(F.col("slot") <= k).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("slot", "word"))).alias("top"))
    return top.select("lang", F.transform("top", lambda x: F.xxhash64(x["word"])).alias("common"))


def measure(docs: DataFrame, k: int = COMMON, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, chars and words (the two histograms) for each row of
    ``docs``; stored. lang is a key: null languages are one of their own.

    Texts are read twice, for the common words and for everything else, and never shuffled: all that a row gets are expressions over its own
    text, whose words are hashed once. How often a common word occurs is what an array of hashes loses without it."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("-")).alias("lang")
    d = docs.select(F.col(id_col).alias("id"), lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    common = sized_broadcast(stored(common_words(d, k)), LANGUAGES)
    text = F.col("text")
    base = d.join(common, "lang", "left").select(
        "id", "lang", "common", words_of(text).alias("w"), F.char_length(text).cast("long").alias("length"), _repeated_lines(text).alias("n_dup_lines"),
        _count(text, SYMBOLS).alias("n_symbols"), *(_count(text, x).alias(name) for name, x in CLASSES.items()),
    )
    base = base.withColumns({"h": F.transform("w", lambda x: F.xxhash64(x)), "word_chars": F.char_length(F.array_join("w", "")).cast("long"), "n_words": F.size("w").cast("long")})
    base = repeated_words(base.drop("w"), "h", "n_repeat_words")
    blank = F.col("length") - F.col("word_chars")
    lower = F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0).cast("long"))
    # compiled apart, beside the array of classes below: as one plain expression, Spark would make a method too long to be compiled
    others = [F.size(F.array_remove("h", F.get("common", F.lit(i)))) for i in range(k)]
    known = [F.col("n_words") - F.coalesce(F.when(F.size("common") > i, x), F.col("n_words")) for i, x in enumerate(others)]
    chars = F.transform(F.array(lower, *(F.col(c) for c in CLASSES), blank), lambda x: x)
    base = base.withColumns({"chars": chars, "known": F.array(*known)})
    rest = F.col("n_words") - F.aggregate("known", F.lit(0).cast("long"), lambda a, v: a + v)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars"]
    return stored(base.select(*kept, F.concat("known", F.array(rest)).alias("words"), failed.alias("base_failed")))


def divergence(p: Column, q: Column, drawn: Column, held: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms of counts (arrays of one length) whose sums are ``drawn`` and ``held``: the square of
    the distance. Null where either is empty."""
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: term(x / drawn, y / held) + term(y / held, x / drawn))
    return F.when((drawn > 0) & (held > 0), F.greatest(F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / 2, F.lit(0.0)))


def chance(bins: int, drawn: Column) -> Column:
    """The divergence that so many draws from a reference have from it on average."""
    return F.lit((bins - 1) / (8 * math.log(2))) / F.greatest(drawn, F.lit(1))


def _references(d: DataFrame, bins: dict[str, int]) -> DataFrame:
    """lang, ref_<histogram> and held_<histogram>, its sum, for each histogram, of the rows of ``d``; sums are made within tasks first."""
    out = None
    for c, n in bins.items():
        each = d.select("lang", F.posexplode(c).alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
        each = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").cast("double").alias(f"held_{c}"))
        each = each.select("lang", F.transform("bins", lambda x: x["n"].cast("double")).alias(f"ref_{c}"), f"held_{c}")
        out = each if out is None else out.join(each, "lang")
    return out


def judge(measured: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, k: int = COMMON, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """``measured`` with char_distance, word_distance (to the language's references) and kept.

    First references are sums over all rows that pass the base rules; second ones, which count, over those of them that are within the limits of
    the first or nearer than their language's mean, so that junk in a third of all rows doesn't make the reference its own. A document
    may diverge by the limit, and by what chance alone gives its length. A language whose references hold fewer than
    ``least_reference`` words judges nothing: distances are null, and the base rules decide."""
    bins = {"chars": len(KINDS), "words": k + 1}
    limits = {"chars": (char_limit, F.col("n_chars")), "words": (word_limit, F.col("n_words"))}
    names = measured.columns
    measured = measured.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v))
    with scratch(measured.sparkSession) as temp:
        rows = measured.count()
        weights = measured.groupBy("lang").agg(F.count("*").alias("weight"))
        beyond = {}
        for first in (True, False):
            passed = measured.filter("not base_failed") if first else near
            refs = weights.join(_references(passed, bins), "lang", "left")
            near = sized_join(measured, temp(refs), ["lang"], "weight", rows)
            for c, (limit, drawn) in limits.items():
                near = near.withColumn(f"{c}_far", divergence(F.col(c), F.col(f"ref_{c}"), drawn, F.col(f"held_{c}")))
                beyond[c] = F.col(f"{c}_far") - CHANCE * chance(bins[c], drawn) - limit * limit
            if first:
                near = temp(near.filter("not base_failed").select("lang", "n_words", *bins, *(x.alias(f"{c}_over") for c, x in beyond.items())))
                mean = near.groupBy("lang").agg(F.count("*").alias("weight"), *(F.avg(f"{c}_over").alias(f"{c}_mean") for c in bins))
                near = sized_join(near, temp(mean), ["lang"], "weight", rows)
                for c in bins:
                    near = near.filter(F.coalesce(F.col(f"{c}_over") <= F.greatest(F.lit(0.0), f"{c}_mean"), F.lit(True)))
        judged = F.col("held_words") >= least_reference
        within = [F.coalesce(x <= 0, F.lit(True)) for x in beyond.values()]
        distances = {f"{c[:-1]}_distance": F.when(judged, F.sqrt(f"{c}_far")) for c in bins}
        kept = ~F.col("base_failed") & (~F.coalesce(judged, F.lit(False)) | (within[0] & within[1]))
        return stored(near.withColumns(distances).withColumn("kept", kept).select(*names, *distances, "kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept for each row of
    ``docs``.

    Null and empty texts have no words and fail the base rules, and no reference holds them. Repeated rows are judged each by itself, alike, and count each
    in the references. Ids may be null or repeated. Other columns are ignored, so names can't clash. Empty in, empty out."""
    out = judge(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_judged(rows: str, refs: str) -> str:
    """For each row, kind of histogram and the kind's limits: divergence from the language's references, and how far that is beyond what is allowed."""
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    p, q = "(h.n / h.drawn)", "(r.n / r.held)"
    return f"""
  SELECT row, lang, failed, kind, held, far - {CHANCE!r} * (bins - 1) / (8 * ln(2)) / drawn - {CHAR_LIMIT!r} * {CHAR_LIMIT!r} AS beyond
  FROM (SELECT h.row, h.lang, h.failed, h.kind, any_value(h.drawn) AS drawn, any_value(r.held) AS held, count(*) AS bins,
    greatest(sum({term.format(p, q)} + {term.format(q, p)}) / 2, 0) AS far
    FROM {rows} h JOIN {refs} r ON r.lang = h.lang AND r.kind = h.kind AND r.bin = h.bin WHERE h.drawn > 0 AND r.held > 0 GROUP BY h.row, h.lang, h.failed, h.kind)"""


_SQL_REFS = "SELECT *, sum(n) OVER (PARTITION BY lang, kind) AS held FROM (SELECT lang, kind, bin, sum(n)::DOUBLE AS n FROM {0} GROUP BY lang, kind, bin)"
_SQL_CLASSES = ",\n    ".join("length(regexp_replace(text, '[^{}]+', '', 'g')) AS {}".format(x.replace("'", "''"), name) for name, x in CLASSES.items())
#: Both limits are one number, which the SQL uses for both.
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row, coalesce('=' || lang, '-') AS lang, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT row, i, [ws[i], ws[i + 1], ws[i + 2]] AS w FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)
), repeated AS (
  SELECT row, count(DISTINCT j) AS n_repeat_words FROM (
    SELECT row, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1) GROUP BY row
), base AS MATERIALIZED (
  SELECT doc_id, row, lang, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(array_to_string(ws, '')) AS blank,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * len(ws) AS failed,
    {_SQL_CLASSES}
  FROM d LEFT JOIN repeated USING (row)
), counted AS (
  SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM d) GROUP BY lang, w
), common AS (
  SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS bin FROM counted QUALIFY bin <= {COMMON}
), held AS (
  SELECT b.row, c.bin, count(*) AS n FROM (SELECT row, lang, unnest(ws) AS w FROM base) b JOIN common c USING (lang, w) GROUP BY b.row, c.bin
), word_bins AS (
  SELECT b.row, b.lang, b.failed, n_words, x.bin, coalesce(h.n, 0) AS n FROM base b, (SELECT unnest(range(1, {COMMON + 1})) AS bin) x LEFT JOIN held h ON h.row = b.row AND h.bin = x.bin
), chars AS (
  SELECT row, lang, failed, word_chars + blank AS drawn, unnest([word_chars - {" - ".join(CLASSES)}, {", ".join(CLASSES)}, blank]) AS n, unnest(range(0, {len(KINDS)})) AS bin FROM base
), hists AS MATERIALIZED (
  SELECT row, lang, failed, 'words' AS kind, bin, n::DOUBLE AS n, n_words::DOUBLE AS drawn FROM word_bins
  UNION ALL SELECT row, lang, failed, 'words', 0, any_value(n_words) - sum(n), any_value(n_words) FROM word_bins GROUP BY row, lang, failed
  UNION ALL SELECT row, lang, failed, 'chars', bin, n, drawn FROM chars
), first_refs AS ({_SQL_REFS.format("(SELECT * FROM hists WHERE NOT failed)")}
), first_judged AS ({_sql_judged("hists", "first_refs")}
), far AS (
  SELECT row FROM (SELECT row, beyond > greatest(0, avg(beyond) OVER (PARTITION BY lang, kind)) AS out FROM first_judged WHERE NOT failed) WHERE out
), refs AS ({_SQL_REFS.format("(SELECT * FROM hists WHERE NOT failed AND row NOT IN (SELECT row FROM far))")}
), judged AS ({_sql_judged("hists", "refs")}
), verdict AS (
  SELECT row, max(held) FILTER (kind = 'words') AS held, bool_and(beyond <= 0) AS within FROM judged GROUP BY row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND (coalesce(held, 0) < {LEAST_REFERENCE} OR coalesce(within, true)) AS kept
FROM base LEFT JOIN verdict USING (row)
"""
