"""Byte-level columns: header sniffing, JPEG table splicing, sample arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 16 bytes of an Adobe segment, with the transform that tells RGB (0) from YCbCr (1).
ADOBE = {2: "FFEE000E41646F626500640000000000", 6: "FFEE000E41646F626500640000000001"}
# Quantities of the colour transform.
YCBCR = {"r_cr": 1.402, "g_cb": 0.34414, "g_cr": 0.71414, "b_cb": 1.772}


def tiff_kind(content: Column) -> Column:
    """'classic' or 'big' with the byte order in front (II or MM), null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    known = {"49492A00": "II classic", "4D4D002A": "MM classic", "49492B00": "II big", "4D4D002B": "MM big"}
    out = F.lit(None).cast("string")
    for code, name in known.items():
        out = F.when(head == code, name).otherwise(out)
    return out


def splice_lead(tables: Column, photometric: Column) -> Column:
    """What stands before an abbreviated tile without its start mark: shared tables without their end mark, then an Adobe segment. Null without
    tables; a photometric other than RGB and YCbCr is an error."""
    segment = F.when(photometric == 2, F.unhex(F.lit(ADOBE[2]))).when(photometric == 6, F.unhex(F.lit(ADOBE[6]))).otherwise(F.raise_error(F.concat(F.lit("photometric not handled: "), F.coalesce(photometric.cast("string"), F.lit("none")))).cast("binary"))
    return F.when(tables.isNotNull(), F.concat(F.substring(tables, F.lit(1), F.octet_length(tables) - 2), segment))


def spliced(tables: Column, tile: Column, photometric: Column) -> Column:
    """A whole JPEG from shared tables and an abbreviated tile. Without tables the tile stays."""
    return F.when(tables.isNull(), tile).otherwise(F.concat(splice_lead(tables, photometric), F.substring(tile, F.lit(3), F.octet_length(tile))))


def to_first_end(content: Column) -> Column:
    """Bytes up to the first end-of-image mark, null without one. As Latin-1 text, each byte is one character, so places agree."""
    at = F.locate("\u00ff\u00d9", F.decode(content, "ISO-8859-1"))
    return F.when(at > 0, F.substring(content, F.lit(1), at + 1))


def bytes_per_sample(bits: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits / 8)).cast("int")


def pixel_type(bits: Column, sample_format: Column) -> Column:
    """Type by bits, rounded up to whole bytes, and sample format (1 unsigned, 2 signed, 3 float); 24-bit integers widen to 32."""
    b = bytes_per_sample(bits) * 8
    b = F.when((b == 24) & (sample_format != 3), 32).otherwise(b)
    name = F.concat(F.when(sample_format == 2, "int").otherwise("uint"), b.cast("string"))
    return F.when(sample_format == 3, F.when(b == 64, "double").when(b.isin(16, 24, 32), "float")).when(b == 64, F.raise_error(F.lit("64-bit integers aren't handled")).cast("string")).otherwise(name)


def reversed_bits(byte: Column) -> Column:
    out = F.lit(0)
    for i in range(8):
        out = out + F.shiftright(byte, i).bitwiseAND(1) * (1 << (7 - i))
    return out


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, mask: int = 255) -> tuple[Column, Column, Column]:
    """As slide readers have it: chroma below the middle counts as the middle, sums lose their fraction, and a negative one wraps round."""
    b, r = (F.greatest(F.lit(0), c - 128) for c in (cb, cr))
    sums = (y + YCBCR["r_cr"] * r, y - YCBCR["g_cb"] * b - YCBCR["g_cr"] * r, y + YCBCR["b_cb"] * b)
    return tuple(F.least(v.cast("double").cast("int"), F.lit(mask)).bitwiseAND(mask) for v in sums)


def ycbcr_to_rgb_standard(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """The transform of the JPEG standard, without those quirks."""
    b, r = cb - 128, cr - 128
    sums = (y + YCBCR["r_cr"] * r, y - YCBCR["g_cb"] * b - YCBCR["g_cr"] * r, y + YCBCR["b_cb"] * b)
    return tuple(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v))).cast("int") for v in sums)


def inverted(sample: Column, bits: Column) -> Column:
    """A sample of an image in which white is 0."""
    return F.pow(F.lit(2), bits).cast("long") - 1 - sample


def unsigned_offset(offset: Column) -> Column:
    """An offset of 32 bits that was read with a sign."""
    return F.when(offset < 0, offset + (1 << 32)).otherwise(offset)


def checked_offsets(offsets: Column, rows_per_strip: Column, height: Column, planes: Column) -> Column:
    """Unsigned strip offsets; an error if there are fewer than the image has strips (``planes``: samples stored apart, else 1)."""
    strips = F.ceil(height / rows_per_strip) * planes
    fixed = F.transform(offsets, unsigned_offset)
    return F.when(F.size(offsets) >= strips, fixed).otherwise(F.raise_error(F.lit("fewer strip offsets than strips")).cast("array<bigint>"))


def bits_per_sample(bits: Column, samples: Column) -> Column:
    """Bits of each sample: 1 where none are given; the first for all where there are fewer than samples."""
    given = F.coalesce(bits, F.array(F.lit(1)))
    return F.when(F.size(given) < samples, F.array_repeat(F.element_at(given, 1), samples)).otherwise(given)


def is_empty_tile(offset: Column, n_bytes: Column, length: Column) -> Column:
    """A tile that the file doesn't hold: no bytes, or a place at or past the file's end."""
    return (F.coalesce(n_bytes, F.lit(0)) <= 0) | offset.isNull() | (offset >= length)


def signed_shorts(content: Column) -> Column:
    """The bytes as signed numbers, as a packet's tag is written by the format's writers."""
    code = lambda i: F.conv(F.hex(F.substring(content, i, F.lit(1))), 16, 10).cast("int")
    widened = F.transform(F.sequence(F.lit(1), F.octet_length(content)), lambda i: F.when(code(i) > 127, code(i) - 256).otherwise(code(i)).cast("short"))
    return F.when(F.octet_length(content) > 0, widened).otherwise(F.array().cast("array<smallint>"))


def codec_options(width: Column, height: Column, bits: Column, samples: Column, interleaved: Column, little_endian: Column) -> Column:
    """What a decoder of one tile must be told."""
    named = {"width": width, "height": height, "bits": bits, "channels": samples, "interleaved": interleaved, "little_endian": little_endian}
    return F.struct(*(c.alias(n) for n, c in named.items()), (width * height * samples * bytes_per_sample(bits)).cast("long").alias("max_bytes"))


def sub_resolutions(levels: Column, width: Column, height: Column) -> Column:
    """Sizes of a codestream's lower resolutions, each half the one above with halves rounded up."""
    return F.transform(F.sequence(F.lit(1), levels), lambda k: F.struct(k.alias("level"), F.ceil(width / F.pow(F.lit(2), k)).alias("width"), F.ceil(height / F.pow(F.lit(2), k)).alias("height")))


def little_bytes(value: Column, size: int) -> Column:
    """A whole number as ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def narrow_float(bits: Column, size: int) -> Column:
    """The double of a float of 16 bits (5 exponent, 10 mantissa) or 24 bits (7 and 16), given as a whole number; infinities and NaN as such."""
    e_bits, m_bits = {16: (5, 10), 24: (7, 16)}[size]
    top, bias = (1 << e_bits) - 1, (1 << (e_bits - 1)) - 1
    sign = F.when(F.shiftright(bits, size - 1).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, m_bits).bitwiseAND(top), bits.bitwiseAND((1 << m_bits) - 1)
    usual = (1 + m / (1 << m_bits)) * F.pow(F.lit(2.0), e - bias)
    tiny = m / (1 << m_bits) * F.pow(F.lit(2.0), F.lit(1 - bias))
    special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(e == top, special).when(e == 0, tiny).otherwise(usual)


def palette(color_map: Column, bits: int) -> Column:
    """Three tables (red, green, blue) from a colour map; for 8 bits, entries above 255 give their high byte."""
    n = F.call_function("div", F.size(color_map), F.lit(3)).cast("int")
    entry = (lambda x: F.when(x > 255, F.shiftright(x, 8)).otherwise(x).bitwiseAND(255)) if bits <= 8 else (lambda x: x.bitwiseAND(65535))
    return F.array(*(F.transform(F.slice(color_map, n * k + 1, n), entry) for k in range(3)))


def interleaved(planes: Column) -> Column:
    """Samples pixel by pixel, from one array a channel."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(F.element_at(planes, 1))), lambda i: F.transform(planes, lambda p: F.element_at(p, i))))


def planar(samples: Column, channels: int) -> Column:
    """One array a channel, from samples pixel by pixel."""
    def one(k: int) -> Column:
        return F.filter(samples, lambda _, i: i % channels == k)

    return F.array(*map(one, range(channels)))


def rows_per_strip(given: Column, tile_length: Column, height: Column) -> Column:
    """Rows of a strip: the tile's or the image's without an entry, never above the height; unequal entries are an error."""
    held = F.array_distinct(F.transform(given, lambda r: F.least(r, height)))
    fake = F.when(F.coalesce(tile_length, F.lit(0)) == 0, height).otherwise(tile_length)
    return F.when(given.isNull(), fake).when(F.size(held) == 1, F.element_at(held, 1)).otherwise(F.raise_error(F.lit("strips of unequal heights aren't handled")).cast("long"))


def plane_rows(content: Column, start: Column, width_bytes: Column, rows: Column, pad: Column) -> Column:
    """The rows of a raw plane as binaries; ``pad`` bytes follow each row."""
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda y: F.substring(content, (start + y * (width_bytes + pad) + 1).cast("int"), width_bytes.cast("int")))
