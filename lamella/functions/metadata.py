"""Metadata text: comment lines, hygiene, repeats, units, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Date patterns of the formats.
TIFF_DATES = ("yyyy:MM:dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "yyyyMMdd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssZ")
APERIO_DATE = "MM/dd/yy HH:mm:ss"
# Micrometres in a unit of resolution (2 inch, 3 centimetre).
RESOLUTION_UM = {2: 25400, 3: 10000}
# What metadata loses before it goes into XML, in this order; longest key or value.
XML_MARKS = ("&lt;", "&gt;", "&amp;", "<", ">", "&")
MOST_CHARS = 8192
# Fields of an Aperio comment that have a type, and of an ImageJ comment.
APERIO_NUMBERS = {"MPP": "um_per_pixel", "Emission Wavelength": "emission_nm", "Excitation Wavelength": "excitation_nm", "Exposure Time": "exposure_time", "Exposure Scale": "exposure_scale", "AppMag": "magnification"}
IMAGEJ_NUMBERS = {"channels": "int", "slices": "int", "frames": "int", "images": "int", "finterval": "double", "spacing": "double", "xorigin": "int", "yorigin": "int"}


def comment_pairs(df: DataFrame, comment: str, keys: list[str]) -> DataFrame:
    """``keys``, pos, key, value of a comment's fields: lines, then fields between bars, split at the first equals sign and trimmed.

    A field without one is free text: its key is null. Null comments give no rows."""
    fields = df.select(*keys, F.posexplode(F.split(F.col(comment), r"\r?\n|\|")).alias("pos", "_f"))
    at = F.instr("_f", "=")
    key = F.when(at > 0, F.trim(F.substring(F.col("_f"), F.lit(1), at - 1)))
    return fields.select(*keys, "pos", key.alias("key"), F.trim(F.when(at > 0, F.substring(F.col("_f"), at + 1, F.length("_f"))).otherwise(F.col("_f"))).alias("value"))


def colon_or_equals_pairs(df: DataFrame, comment: str, keys: list[str]) -> DataFrame:
    """``keys``, pos, key, value of lines ``key: value`` or ``key = value``; lines that open a section in brackets are left out."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(comment), r"\r?\n")).alias("pos", "_l")).filter(~F.trim("_l").startswith("["))
    mark = F.when(F.instr("_l", "=") > 0, F.instr("_l", "=")).otherwise(F.instr("_l", ":"))
    return lines.filter(mark > 0).select(*keys, "pos", F.trim(F.substring(F.col("_l"), F.lit(1), mark - 1)).alias("key"), F.trim(F.substring(F.col("_l"), mark + 1, F.length("_l"))).alias("value"))


def unit_of(comment: Column) -> Column:
    return F.nullif(F.regexp_extract(comment, r"(?s)(.*)unit=(\w+)(.*)", 2), F.lit(""))


def clean_pairs(df: DataFrame, key: str, value: str, filtered: bool = True) -> DataFrame:
    """Pairs without null keys or values, keys trimmed. ``filtered`` also drops pairs with a key or value of over 8192 characters or a
    key without a letter, takes signs that can't be printed, then ``XML_MARKS`` out of both, and drops empty keys and blank values."""
    out = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).withColumn(key, F.trim(key))
    if not filtered:
        return out
    out = out.filter((F.length(key) <= MOST_CHARS) & (F.length(value) <= MOST_CHARS))
    out = out.withColumns({c: F.regexp_replace(c, r"[^\t\n -~]", "") for c in (key, value)}).filter(F.col(key).rlike("[A-Za-z]"))
    for mark in XML_MARKS:
        out = out.withColumns({c: F.replace(F.col(c), F.lit(mark), F.lit("")) for c in (key, value)})
    return out.filter((F.col(key) != "") & (F.trim(F.col(value)) != ""))


def number_repeats(df: DataFrame, owner: list[str], key: str, order: list[str]) -> DataFrame:
    """``key`` becomes ``key #NN`` where an owner has it more than once, NN in order and padded to the width of the count."""
    per = Window.partitionBy(*owner, key)
    n, at = F.count("*").over(per), F.row_number().over(per.orderBy(*order))
    return df.withColumn("_n", n).withColumn("_at", at).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(key, F.lit(" #"), F.lpad(F.col("_at").cast("string"), F.length(F.col("_n").cast("string")), F.lit("0"))))).drop("_n", "_at")


def first_and_last(df: DataFrame, owner: list[str], key: str, value: str, order: list[str]) -> DataFrame:
    """first_value (a directory keeps a tag's first entry) and last_value (a metadata table its last) of each key."""
    at = F.struct(*order)
    return df.groupBy(*owner, key).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def split_artist(artist: Column) -> tuple[Column, Column]:
    """What comes before the first blank and after it, as it is; without a blank, all is a last name."""
    at = F.instr(artist, " ")
    return F.when(at > 0, F.substring(artist, F.lit(1), at - 1)), F.when(at > 0, F.substring(artist, at + 1, F.length(artist))).otherwise(artist)


def aperio_fields(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the typed fields of each slide's comment from ``comment_pairs``: numbers, acquired, exposure_ms, dyes, display_color
    (RGB and full alpha), comment. The last value of a key counts; a value that isn't a number is null, and so is a field that is missing."""
    of = lambda name: F.max_by(F.when(F.col("key") == name, F.col("value")), F.when(F.col("key") == name, F.col("pos")))
    dye = F.when(F.col("key") == "Dye", F.struct("pos", "value"))
    found = pairs.groupBy(*keys).agg(
        *(of(name).try_cast("double").alias(out) for name, out in APERIO_NUMBERS.items()), F.concat(of("Date"), F.lit(" "), of("Time")).alias("_when"),
        F.transform(F.array_sort(F.collect_list(dye)), lambda x: x["value"]).alias("dyes"), of("DisplayColor").try_cast("long").alias("_rgb"),
        F.max_by("value", F.when(F.col("key").isNull(), F.col("pos"))).alias("comment"), of("ScanScope ID").alias("device"), of("Image Description").alias("manufacturer"),
    )
    found = found.withColumn("acquired", F.try_to_timestamp("_when", F.lit(APERIO_DATE))).withColumn("display_color", F.shiftleft("_rgb", 8).bitwiseOR(255))
    return found.withColumn("exposure_ms", exposure_ms(F.col("exposure_time"), F.col("exposure_scale"))).drop("_when", "_rgb")


def imagej_fields(comment: Column, directories: Column, rgb: Column, samples: Column) -> Column:
    """Fields of an ImageJ comment and the lengths they give the axes, null for another comment: z by t by channels must be the number
    of directories (channels aren't counted for RGB, whose samples are in one directory); else time takes all directories."""
    lines = F.filter(F.split(comment, "\n"), lambda x: F.instr(x, "=") > 1)
    value = lambda name: F.element_at(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}=")), lambda x: F.substring(x, F.lit(len(name) + 2), F.length(x))), -1)
    number = {n: F.when(F.exists(lines, lambda x: x.startswith(f"{n}=")), value(n)).try_cast(kind) for n, kind in IMAGEJ_NUMBERS.items()}  # noqa: B023
    text = {n: F.when(F.exists(lines, lambda x: x.startswith(f"{n}=")), value(n)) for n in ("unit", "mode")}  # noqa: B023
    z, t0, c = (F.coalesce(number[n], d) for n, d in (("slices", F.lit(1)), ("frames", F.lit(1)), ("channels", samples)))
    t = F.when((z * t0 == 1) & rgb, directories).otherwise(t0)
    plain, mixed = z * t * F.when(rgb, 1).otherwise(c) == directories, (z * c * t == directories) & rgb
    fits = plain | mixed
    size_c = F.when(plain, F.when(rgb, samples).otherwise(c)).when(mixed, samples * c).otherwise(samples)
    sizes = [F.when(fits, z).otherwise(1).cast("int").alias("size_z"), F.when(fits, t).otherwise(directories).cast("int").alias("size_t"), size_c.cast("int").alias("size_c")]
    version = F.regexp_extract(comment, r"^ImageJ=([^\n]*)", 1).alias("version")
    found = F.struct(version, *(x.alias(n) for n, x in {**number, **text}.items()), *sizes)
    return F.when(comment.startswith("ImageJ="), found)


def resolution_to_um(pixels_per_unit: Column, unit: Column) -> Column:
    """Micrometres a pixel; null for no resolution."""
    factor = F.lit(1)
    for code, um in RESOLUTION_UM.items():
        factor = F.when(unit == code, um).otherwise(factor)
    return F.when(pixels_per_unit > 0, 1 / pixels_per_unit.cast("double") * factor)


def um_to_rational(um: Column) -> tuple[Column, Column]:
    """Pixels a centimetre as a numerator over 1000, cut to whole numbers; 0 if the size isn't known."""
    return F.when(um > 0, (1 / um.cast("double") * 1000 * 10000).cast("long")).otherwise(F.lit(0).cast("long")), F.lit(1000).cast("long")


def packet_spacing(um: Column, kind: str) -> Column:
    """Spacing as the metadata packet has it: the two formats use different units, kept as they are (vsi: nm at five places, times 1000; svs: um times 10**6)."""
    d = um.cast("decimal(30,10)")
    return (F.round(d, 5).cast("decimal(30,5)") * 1000 if kind == "vsi" else d * 1_000_000).cast("decimal(38,5)")


def spacing_mm(um: Column) -> Column:
    """Millimetres a pixel, which is what the packet's field is for; the packet itself keeps the formats' own units."""
    return (um.cast("decimal(30,10)") / 1000).cast("decimal(38,13)")


def exposure_ms(time: Column, scale: Column) -> Column:
    return (time.cast("decimal(18,6)") * scale.cast("decimal(12,6)") * 1000).cast("decimal(38,6)")


def plain_number(x: Column) -> Column:
    """A decimal without trailing zeros or a bare point."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def first_date(text: Column, patterns: tuple[str, ...] = TIFF_DATES) -> Column:
    """The time by the first pattern that fits. Digits after a point are a fraction of a second, whatever the pattern."""
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 6), 6, "0")
    plain = F.regexp_replace(text, r"\.[0-9]+", "")
    found = F.coalesce(*(F.try_to_timestamp(plain, F.lit(p)) for p in patterns))
    return F.timestamp_micros(F.unix_micros(found) + F.coalesce(fraction.try_cast("long"), F.lit(0)))


def unix_date(seconds: Column) -> Column:
    """The time of a slide that counts seconds since 1970; null if it isn't known (0 or less)."""
    return F.when(seconds.cast("long") > 0, F.timestamp_seconds(seconds.cast("long")))


def coerced(value: Column, names: tuple[str, ...], other: str | None = "Other") -> Column:
    """The name of a vocabulary that ``value`` is, whatever its case and outer blanks; ``other`` for what isn't in it, null for null."""
    table = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(other)))
