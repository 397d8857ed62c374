"""License scans: canonical digest lookup. Case, punctuation, copyright lines and equivalent spellings are normalised away; whole texts are hash-joined to known licence digests."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import ascii_lower, sized_broadcast
from lamella.llm.license_texts import LONG, MORE, MORE_PARTS, titled

# Public licence texts and the notices that stand for a licence.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = {
    "MIT": [MIT, "MIT License\n" + MIT, "MIT License", "The MIT License", "Released under the MIT License.", "Licensed under the MIT License."],
    "ISC": [ISC, "ISC License\n" + ISC, "ISC License", "Released under the ISC License.", "Licensed under the ISC License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Apache License Version 2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU General Public License version 3"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "all-rights-reserved": ["All rights reserved."],
}
#: Titled and partial forms of the two texts above.
FORMS = {
    "MIT": [*titled(MIT, "MIT License", "The MIT License", "The MIT License (MIT)")],
    "ISC": [x.replace("and/or", word) for word in ("and/or", "and") for x in titled(ISC, "ISC License", "The ISC License", "ISC License (ISC)")],
}
#: Parts that name a licence where no more of it is found as a unit, as when lines of other text follow at once. None begins another licence's text.
PARTS = {"MIT": [MIT.split("\n")[0]], "ISC": [ISC.split("\n")[0].replace("and/or", word) for word in ("and/or", "and")]} | MORE_PARTS
#: All known texts: those above, which the SQL has too, and those of ``license_texts``.
FULL = {name: [x for table in (KNOWN, FORMS, MORE) for x in table.get(name, [])] for name in dict.fromkeys([*KNOWN, *MORE])}
#: Equivalent spellings, whole words, after lower-casing.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "authorised": "authorized", "organisation": "organization", "favour": "favor", "whilst": "while", "noninfringement": "non infringement", "v2": "version 2", "v3": "version 3"}
COPYRIGHT_LINE = r"^[^a-z0-9\x{80}-\x{10FFFF}]*(copyright\b|\(c\)|©).*$"
#: As above, but a hard-wrapped line that goes on with "copyright notice" and the like is text.
COPYRIGHT_CLAUSE = r"^[^a-z0-9\x{80}-\x{10FFFF}]*(copyright\b(?![ \t]+(?:notice|holder|owner|law|license|licence|interest|statement|disclaimer)s?\b)|\(c\)|©)"
APART = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
BLANK_LINES = r"\r?\n[ \t\x0B\f\r\n]*\n"
#: One of these is in nearly all known texts, and in all that are known by digest alone; the short one is in both spellings.
ANCHORS = ("licen", "permission", "reserved")
COPYRIGHT_MARKS = ("copyright", "(c)", "©")
#: Digest of an empty unit; what stands for a digest in the row that each document has of its own.
NOTHING, OWN = hashlib.sha256(b"").hexdigest(), "document"


def openings(known: dict[str, list[str]]) -> str:
    """Pattern of the first three words of the known texts: what follows a copyright clause begins with one of them."""
    first = {r"[^a-z0-9]+".join(re.findall("[a-z0-9]+", text.lower())[:3]) for texts in known.values() for text in texts}
    return "|".join(sorted(first, key=lambda x: (-len(x), x)))


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(x) for x in parts))


def anchors(known: dict[str, list[str]]) -> list[str]:
    """Strings of which each known text has one at least, in any spelling; a text without any of them can't hold a known one."""
    found = list(ANCHORS)
    changed = {w for old, new in SPELLINGS.items() for w in (old, *new.split())}
    for text in (t.lower() for texts in known.values() for t in texts):
        if not any(a in text for a in found):
            own = [w for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", text) if w not in changed]
            found.append(max(own, key=len, default=""))
    return found


def canonical_paragraphs(text: Column, after: str | None = None) -> Column:
    """For each part of the text between blank lines, its lines in canonical form, without those that are empty then.

    Copyright lines go. With ``after``, only the clause goes, up to the first place that matches it, and the line begins with a C, which no
    other canonical line holds."""
    clause = COPYRIGHT_CLAUSE + (".*$" if after is None else rf".*?(\b(?=({after})\b)|$)")

    # one step after another, each over all lines, so that none is taken twice; few lines hold a copyright or any of the spellings, so a
    # look for fixed strings spares most lines a pass of patterns
    def without_copyright(x: Column) -> Column:
        return F.when(_holds(x, COPYRIGHT_MARKS), F.regexp_replace(x, clause, "" if after is None else "C ")).otherwise(x)

    def spelled(x: Column) -> Column:
        fixed = reduce(lambda got, item: F.regexp_replace(got, rf"\b{item[0]}\b", item[1]), SPELLINGS.items(), x)
        return F.trim(F.when(_holds(x, tuple(SPELLINGS)), fixed).otherwise(x))

    apart = APART if after is None else APART.replace("0-9", "0-9C")

    def canonical(part: Column) -> Column:
        bare = F.transform(F.transform(F.split(part, r"\r?\n"), without_copyright), lambda x: F.regexp_replace(x, apart, " "))
        return F.filter(F.transform(bare, spelled), lambda x: (x != "") & (x != "C"))

    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BLANK_LINES), canonical)


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form, without copyright lines and those that are empty then."""
    return F.flatten(canonical_paragraphs(text))


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """digest, license, part, n (bytes of the canonical text, null where only its digest is known): one row for each known text or part of
    one; of equal digests, the first name, texts before parts. A fixed table of a few hundred rows."""
    def rows(found: list[dict], schema: str) -> DataFrame:
        """A table of constants, as one literal."""
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(found)), f"array<struct<{schema}>>")))

    tables = ((False, known or FULL), (True, {} if known else PARTS))
    texts = [{"license": name, "text": text, "part": part} for part, table in tables for name, texts in table.items() for text in texts]
    text = F.array_join(canonical_lines(F.col("text")), " ")
    table = rows(texts, "license:string,text:string,part:boolean").select("license", F.sha2(text, 256).alias("digest"), "part", F.octet_length(text).alias("n"))
    if not known:
        long = [{"license": name, "digest": x, "part": False} for name, digests in LONG.items() for x in digests]
        table = table.unionByName(rows(long, "license:string,digest:string,part:boolean,n:int"))
    return table.groupBy("digest").agg(F.min(F.struct("part", "license")).alias("k"), F.max("n").alias("n")).select("digest", "k.license", "k.part", "n")


def _running(sizes: Column) -> Column:
    """Where each paragraph ends when all are joined with a blank after each."""
    last = lambda ends: F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0).cast("long"))
    return F.aggregate(sizes, F.array().cast("array<bigint>"), lambda ends, n: F.concat(ends, F.array(last(ends) + n + 1)))


def _with_ends(u: DataFrame, c: str) -> DataFrame:
    """``c``_ends: as ``_running`` of ``c``_bytes, in blocks of 64, so that the work doesn't grow with the square of the number of paragraphs."""
    size = F.col(f"{c}_bytes")
    blocks = F.when(F.size(size) > 0, F.transform(F.sequence(F.lit(0), F.shiftright(F.size(size) - 1, 6)), lambda b: _running(F.slice(size, b * 64 + 1, F.lit(64)))))
    u = u.withColumn("_blocks", F.coalesce(blocks, F.array().cast("array<array<bigint>>")))
    u = u.withColumn("_starts", _running(F.transform("_blocks", lambda x: F.get(x, F.size(x) - 1) - 1)))
    ends = F.transform("_blocks", lambda x, b: F.transform(x, lambda e: e + F.coalesce(F.get("_starts", b - 1), F.lit(0))))
    return u.withColumn(f"{c}_ends", F.flatten(ends)).drop("_blocks", "_starts")


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", after_copyright: bool = False) -> DataFrame:
    """``id_col``, n_units (canonical lines that are not empty), n_hits (different units that are a known text), licenses (their names, sorted), whole
    (name of the licence that the entire text is, or null) for each row of ``docs``.

    Units are the entire text, each of its lines, and each run of paragraphs (parts between blank lines), its lines joined; each is
    compared as a whole by the digest of its canonical form; an empty unit is nothing. Known parts of a text count where nothing else of that
    licence is a unit. Null texts have no units. Rows that share id and
    text get equal results. Ids may be null; other columns are ignored.

    Copyright lines are nothing. With ``after_copyright``, only the clause is: what follows it, from the first words of a known text
    on, is a line, and paragraphs and the entire text are taken both with such lines and without.

    Texts are read once. Digests meet the known ones in a hash join whose small side is the fixed table, so texts aren't shuffled; only
    hits are, and one row for each document, which meets a row of that table too. A text without any of the ``anchors`` holds no
    known text, so only its units are counted; a unit whose length no known text has can't be one, so only the others, and entire
    texts, are joined and hashed."""
    table = known_digests(docs.sparkSession, known)
    lengths = [r["n"] for r in table.filter("n is not null").select("n").distinct().collect()] or [0]
    tables = [known] if known else [FULL, PARTS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    may = _holds(ascii_lower(text), (*COPYRIGHT_MARKS, *dict.fromkeys(a for t in tables for a in anchors(t))))
    d = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"), may.alias("may"))
    parts = F.when(F.col("may"), canonical_paragraphs(F.col("text"), openings(known or FULL) if after_copyright else None))
    # without copyright lines, a line is a unit if it has a letter or digit
    plain_units = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]")))
    d = d.select("id", "row", F.when(~F.col("may"), plain_units).alias("plain_units"), F.coalesce(parts, F.array().cast("array<array<string>>")).alias("parts"))
    bare = lambda lines: F.filter(lines, lambda x: ~x.startswith("C "))
    kept = lambda lines: F.transform(lines, lambda x: F.regexp_replace(x, "^C ", "")) if after_copyright else lines

    def joined(form) -> Column:
        return F.filter(F.transform("parts", lambda part: F.array_join(form(part), " ")), lambda x: x != "")

    lines = F.flatten("parts")
    # where no line follows a copyright clause, both forms are the same, and one is enough
    without = F.when(F.exists(lines, lambda x: x.startswith("C ")), joined(bare)).otherwise(F.array().cast("array<string>"))
    u = d.select("id", "row", "plain_units", kept(lines).alias("lines"), joined(kept).alias("with"), *([without.alias("without")] if after_copyright else []))
    forms = ("with", "without") if after_copyright else ("with",)
    u = u.select("*", *(F.transform(c, F.octet_length).alias(f"{c}_bytes") for c in forms))
    u = reduce(_with_ends, forms, u)
    unit = lambda x, entire: F.struct(F.lit(entire).alias("entire"), F.sha2(x, 256).alias("digest"))

    def runs(c: str) -> Column:
        """Runs of paragraphs that have, joined, as many bytes as a known text. Their number is bounded by bytes alone: no run has more of
        them than the longest known text could be parted to, with the document's shortest paragraph."""
        end = lambda j: F.get(f"{c}_ends", j)
        most = F.floor(F.lit(max(lengths) + 1) / (F.array_min(f"{c}_bytes") + 1)).cast("int")

        def from_place(i: Column) -> Column:
            last = F.sequence(i, F.least(F.size(c), i + most) - 1)
            return F.transform(F.filter(last, lambda j: (end(j) - F.coalesce(end(i - 1), F.lit(0)) - 1).isin(lengths)), lambda j: F.struct((i + 1).alias("i"), (j - i + 1).alias("n")))

        found = F.when(F.size(c) > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 1), from_place)))
        return F.transform(F.coalesce(found, F.array().cast("array<struct<i:int,n:int>>")), lambda x: unit(F.array_join(F.slice(c, x["i"], x["n"]), " "), False))

    own = F.array(F.struct(F.lit(False).alias("entire"), F.lit(OWN).alias("digest")))
    entire = [F.array(unit(F.array_join(c, " "), True)) for c in forms]
    known_lines = F.array_distinct(F.filter("lines", lambda x: F.octet_length(x).isin(lengths)))
    units = F.concat(own, *entire, F.transform(known_lines, lambda x: unit(x, False)), *(runs(c) for c in forms))
    row = docs.sparkSession.range(1).select(F.lit(OWN).alias("digest"), F.lit(None).cast("string").alias("license"), F.lit(True).alias("part"))
    table = table.drop("n").unionByName(row)
    found = u.select("id", "row", F.coalesce("plain_units", F.size("lines")).cast("long").alias("n_units"), F.explode(units).alias("u")).select("id", "row", "n_units", "u.*")
    found = found.filter(F.col("digest") != NOTHING).join(sized_broadcast(table), "digest")
    hit = F.when(F.col("license").isNotNull(), F.struct("license", "part", "digest"))
    whole = F.min(F.when(F.col("entire") & ~F.col("part"), F.col("license")))
    found = found.groupBy("row").agg(F.first("id").alias("id"), F.max("n_units").alias("n_units"), F.collect_set(hit).alias("hits"), whole.alias("whole"))
    full = F.transform(F.filter("hits", lambda h: ~h["part"]), lambda h: h["license"])
    n_hits = F.size(F.filter("hits", lambda h: ~h["part"] | ~F.array_contains(full, h["license"])))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    return found.select(F.col("id").alias(id_col), "n_units", n_hits.cast("long").alias("n_hits"), names.alias("licenses"), "whole")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), after_copyright=True).withColumn("licenses", F.array_join("licenses", ","))


def _sql_canonical(line: str) -> str:
    out = f"regexp_replace(regexp_replace({line}, '{COPYRIGHT_LINE}', ''), '{APART}', ' ', 'g')"
    for old, new in SPELLINGS.items():
        out = f"regexp_replace({out}, '\\b{old}\\b', '{new}', 'g')"
    return f"trim({out})"


_KNOWN_ROWS = ", ".join("({}, {}, '{}')".format(i, "'" + text.replace("'", "''") + "'", name) for i, (name, text) in enumerate((n, t) for n, ts in KNOWN.items() for t in ts))
ORACLE_SQL = f"""
WITH texts AS (
  SELECT false AS known, doc_id AS i, text, NULL AS license FROM documents UNION ALL SELECT true, * FROM (VALUES {_KNOWN_ROWS}) AS k(i, text, license)
), split AS (
  SELECT known, i, license, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\r?\\n') AS x FROM texts
), lines AS (
  SELECT known, i, license, n, {_sql_canonical("line")} AS line FROM (SELECT known, i, license, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM split)
), entire AS (
  SELECT known, i, license, string_agg(line, ' ' ORDER BY n) AS line, count(*) AS n_units FROM lines WHERE line <> '' GROUP BY known, i, license
), names AS (
  SELECT line, min(license) AS license FROM entire WHERE known GROUP BY line
), units AS (
  SELECT DISTINCT i, line, false AS entire FROM lines WHERE NOT known AND line <> '' UNION ALL SELECT i, line, true FROM entire WHERE NOT known
), found AS (
  SELECT i, count(DISTINCT line) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, min(license) FILTER (entire) AS whole FROM units JOIN names USING (line) GROUP BY i
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, whole
FROM documents LEFT JOIN (SELECT i, n_units FROM entire WHERE NOT known) u ON u.i = doc_id LEFT JOIN found ON found.i = doc_id
"""
