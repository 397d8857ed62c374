"""Choice and numbering of a slide's images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_series(series: DataFrame, slide: str, size_x: str, index: str) -> DataFrame:
    """Each slide's widest series, the first of equals. Width alone decides. Two hashed passes with partial results: the largest width,
    then, among the rows that have it, the least index; neither sorts."""
    widest = series.groupBy(slide).agg(F.max(size_x).alias("size_x"), F.count("*").alias("n_series"))
    per_width = series.groupBy(slide, F.col(size_x).alias("size_x")).agg(F.min(index).alias("flat_index"))
    return widest.join(per_width, [slide, "size_x"]).select(slide, "size_x", "flat_index", "n_series")


def asked_series(df: DataFrame, asked: str, count: str, out: str = "series") -> DataFrame:
    """One row for each number in a comma-separated list that is a series of the slide; no list asks for none here (the largest is taken)."""
    return df.withColumn(out, F.explode(F.transform(F.split(asked, ","), lambda x: F.trim(x).try_cast("long")))).filter((F.col(out) >= 0) & (F.col(out) < F.col(count)))


def classify(images: DataFrame, slide: str, order: str, comment: str) -> DataFrame:
    """``images`` with kind: label, macro or level. A slide has one label and one macro image at most.

    Images are read in order. One whose comment is null becomes the label if there is none yet, else the macro image if there is none
    yet. A field of a comment (between bars and line ends, without an equals sign) that holds "label" moves the label here, one that
    holds "macro" and not "label" moves the macro image here, so the last such image has it."""
    fields = F.filter(F.split(F.lower(comment), r"[|\n]"), lambda f: ~f.contains("="))
    says_label = F.coalesce(F.exists(fields, lambda f: f.contains("label")), F.lit(False))
    says_macro = F.coalesce(F.exists(fields, lambda f: f.contains("macro") & ~f.contains("label")), F.lit(False))
    whole = Window.partitionBy(slide)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda on: F.coalesce(F.sum(on.cast("int")).over(before), F.lit(0))
    out = images.withColumns({"_label": says_label, "_macro": says_macro, "_bare": F.col(comment).isNull()})
    out = out.withColumns({"_labels": seen(F.col("_label")), "_macros": seen(F.col("_macro")), "_bares": seen(F.col("_bare"))})
    takes_label = F.col("_bare") & (F.col("_bares") == 0) & (F.col("_labels") == 0)
    # the first bare image takes the macro place if a word has set the label; then no later one can
    first_took = F.col("_bare") & (F.col("_bares") == 0) & (F.col("_labels") > 0) & (F.col("_macros") == 0)
    out = out.withColumns({"_took_label": takes_label, "_took_macro": first_took})
    taken = F.max(F.col("_took_macro").cast("int")).over(before)
    second_took = F.col("_bare") & (F.col("_bares") == 1) & (F.col("_macros") == 0) & (F.coalesce(taken, F.lit(0)) == 0)
    out = out.withColumn("_took_macro", F.col("_took_macro") | second_took)
    place = lambda says, took: F.coalesce(F.max(F.when(F.col(says), F.col(order))).over(whole), F.max(F.when(F.col(took), F.col(order))).over(whole))
    out = out.withColumns({"_at_label": place("_label", "_took_label"), "_at_macro": place("_macro", "_took_macro")})
    kind = F.when(F.col(order) == F.col("_at_label"), "label").when(F.col(order) == F.col("_at_macro"), "macro").otherwise("level")
    return out.withColumn("kind", kind).drop(*(c for c in out.columns if c not in images.columns))


def directory_of(core: Column, z: Column, levels: Column, z_size: Column) -> Column:
    """Directory of a slide's image ``core`` (0 to levels - 1: resolutions, then label and macro) at the z-th position.

    With one z position, lower resolutions come in reverse order behind the first; with several, a thumbnail follows the first image
    and the planes of each position come together."""
    low = (core > 0) & (core < levels)
    at = F.when(low, F.when(z_size > 1, core + 1).otherwise(levels - core)).otherwise(core)
    deep = low | (z > 0)
    extra = (core >= levels) & (z_size > 1) & ~deep
    return F.when(deep, at + z * levels + F.when(core == 0, 1).otherwise(0)).when(extra, at + levels * z_size - (levels - 1)).otherwise(at).cast("long")


def thumbnails(images: DataFrame, slide: str, subfile_type: str) -> DataFrame:
    """``images`` with is_thumbnail: a reduced image (subfile type 1), unless it is the slide's only image."""
    return images.withColumn("is_thumbnail", (F.coalesce(F.col(subfile_type), F.lit(0)) == 1) & (F.count("*").over(Window.partitionBy(slide)) > 1))


def carried_index(tags: DataFrame, owner: str, order: list[str], step: Column, reset: Column) -> DataFrame:
    """``tags`` with meta_index: -1 after a reset, one more with each step since."""
    upto = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = tags.withColumn("_part", F.sum(reset.cast("int")).over(upto)).withColumn("_step", F.when(reset, 0).otherwise(step.cast("int")))
    return out.withColumn("meta_index", F.sum("_step").over(Window.partitionBy(owner, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_part", "_step")


def first_core(series: DataFrame, slide: str, order: str, resolutions: str) -> DataFrame:
    """``series`` with core_index: resolutions of all series before it."""
    before = Window.partitionBy(slide).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("core_index", F.coalesce(F.sum(resolutions).over(before), F.lit(0)).cast("long"))


def z_positions(planes: DataFrame, slide: str, z: str) -> DataFrame:
    """Distinct z positions of each slide, ascending; 0.0 for a slide that has none."""
    found = planes.groupBy(slide).agg(F.array_sort(F.collect_set(z)).alias("_z"))
    return found.select(slide, F.posexplode(F.when(F.size("_z") == 0, F.array(F.lit(0.0))).otherwise(F.col("_z"))).alias("z_index", "z"))


def used_files(files: DataFrame, owner: list[str], path: str, order: str) -> DataFrame:
    """Distinct files, in the order in which they first come."""
    return files.groupBy(*owner, path).agg(F.min(order).alias("first_pos"))
