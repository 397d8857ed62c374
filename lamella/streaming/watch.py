"""A watched folder: files that arrive are planned as a batch run would plan them. One stateless projection, so no watermark is needed."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.plans.batch import EXTENSIONS, Parameters, reader, suffix


def arrivals(spark: SparkSession, settings: Parameters) -> DataFrame:
    """path, length, dest, reader of each new slide below ``settings.src``, as a stream; its checkpoint remembers what was seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(settings.src)
    found = files.filter(suffix(F.col("path")).isin(*EXTENSIONS))
    found = found.filter(F.col("path").contains(settings.filter)) if settings.filter else found
    # paths come as URIs; a relative settings.src is found at its place in them
    scheme = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
    root = posixpath.normpath(re.sub(scheme, "", settings.src))
    below = F.regexp_replace(F.regexp_replace("path", scheme, ""), ("^" if root.startswith("/") else "^.*?/") + re.escape(root.rstrip("/")) + "/", "")
    return found.select("path", "length", F.concat(F.lit(settings.dest.rstrip("/") + "/"), F.substring(below, F.lit(1), F.length(below) - 4), F.lit(".tif")).alias("dest"), reader(F.col("path")).alias("reader"))
