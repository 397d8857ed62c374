"""Names of coded tag values, as small tables for broadcast left joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of codes, by tag, as the public TIFF 6 standard and the slide formats define them.
NAMES = {
    "Orientation": {1: "1st row -> top; 1st column -> left", 2: "1st row -> top; 1st column -> right", 3: "1st row -> bottom; 1st column -> right", 4: "1st row -> bottom; 1st column -> left", 5: "1st row -> left; 1st column -> top", 6: "1st row -> right; 1st column -> top", 7: "1st row -> right; 1st column -> bottom", 8: "1st row -> left; 1st column -> bottom"},
    "Threshholding": {1: "No dithering or halftoning", 2: "Ordered dithering or halftoning", 3: "Randomized error diffusion"},
    "FillOrder": {1: "Pixels with lower column values are stored in the higher order bits of a byte", 2: "Pixels with lower column values are stored in the lower order bits of a byte"},
    "PlanarConfiguration": {1: "Chunky", 2: "Planar"},
    "ResolutionUnit": {1: "None", 2: "Inch", 3: "Centimeter"},
    "Predictor": {1: "No prediction scheme", 2: "Horizontal differencing"},
    "InkSet": {1: "CMYK", 2: "Other"},
    "SampleFormat": {1: "unsigned integer", 2: "two's complement signed integer", 3: "IEEE floating point", 4: "undefined"},
    "JPEGProc": {1: "baseline sequential process", 14: "lossless process with Huffman encoding"},
    "YCbCrSubSampling": {1: "chroma image dimensions = luma image dimensions", 2: "chroma image dimensions are half the luma image dimensions", 4: "chroma image dimensions are 1/4 the luma image dimensions"},
    "StackType": {0: "Default image", 1: "Overview image", 2: "Sample mask", 4: "Focus image", 8: "EFI sharpness map", 16: "EFI height map", 32: "EFI texture map", 64: "EFI stack", 256: "Macro image"},
    "VolumePrefix": {2043: "Microscope ", 2417: "Channel Wavelength ", 120062: "Objective Working Distance "},
    "Compression": {1: "Uncompressed", 5: "LZW", 6: "Old JPEG", 7: "JPEG", 8: "Deflate", 32773: "PackBits", 32946: "Deflate", 33003: "JPEG-2000", 33005: "JPEG-2000", 34712: "JPEG-2000"},
    "DeviceSubtype": {0: "Camera", 10000: "Stage", 20000: "Objective revolver", 20001: "TV Adapter", 20002: "Filter Wheel", 20003: "Lamp", 20004: "Aperture Stop", 20005: "Shutter", 20006: "Objective", 20007: "Objective Changer", 20008: "TopLens", 20009: "Prism", 20010: "Zoom", 20011: "DSU", 20012: "ZDC", 20050: "Stage Insert", 30000: "Slide Loader", 40000: "Manual Control", 40500: "Microscope Frame"},
}
# Vocabularies of the public OME data model whose members are known without its library; the caller can give others.
VOCABULARIES = {
    "Binning": ("1x1", "2x2", "4x4", "8x8", "Other"),
    "Correction": ("UV", "PlanApo", "PlanFluor", "SuperFluor", "VioletCorrected", "Achro", "Achromat", "Fluor", "Fl", "Fluar", "Neofluar", "Fluotar", "Apo", "PlanNeofluar", "Other"),
    "Immersion": ("Oil", "Water", "WaterDipping", "Air", "Multi", "Glycerol", "Other"),
    "Medium": ("Air", "Oil", "Water", "Glycerol", "Other"),
    "MicroscopeType": ("Upright", "Inverted", "Dissection", "Electrophysiology", "Other"),
}
#: Tags whose unknown codes are kept as they are; for others an unknown code has no name.
KEEPS_CODE = ("DeviceSubtype", "StackType")


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(tag, code, name) for tag, codes in NAMES.items() for code, name in codes.items()], "tag string, code long, name string")


def named(df: DataFrame, tag: str, code: str, out: str = "name", more: DataFrame | None = None) -> DataFrame:
    """``df`` with the name of each coded value. The table is a fixed one of under a hundred rows, so it is broadcast. ``more`` (tag, code,
    name) adds a vocabulary of the caller's, such as a format's list of tag names; it is joined as its size allows."""
    kept = F.when(F.col(tag).isin(*KEEPS_CODE), F.col(code).cast("string"))
    found, names = df, [F.broadcast(name_table(df.sparkSession)), *([more] if more is not None else [])]
    for i, table in enumerate(names):
        table = table.select(F.col("tag").alias("_t"), F.col("code").alias("_c"), F.col("name").alias(f"_n{i}"))
        found = found.join(table, (F.col(tag) == F.col("_t")) & (F.col(code) == F.col("_c")), "left").drop("_t", "_c")
    return found.withColumn(out, F.coalesce(*(f"_n{i}" for i in range(len(names))), kept)).drop(*(f"_n{i}" for i in range(len(names))))
