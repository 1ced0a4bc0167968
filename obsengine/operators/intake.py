"""Intake of annotated images: labels joined to their images, classes mapped, and what is left out counted beside the rows.

Counts come by observation while the rows are written or read: there is no second pass.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Least side of a box in pixels; file names: camera, day, time and number. Fixed values.
LEAST_SIDE = 4
STEM = r"^(I0\d{3})(\d{8})\d{6}_\d+$"


def checked_classes(mapping: Mapping[str, str | None], known: tuple[str, ...]) -> dict[str, str | None]:
    """mapping, if all its targets are known classes."""
    if wrong := sorted({v for v in mapping.values() if v is not None} - set(known)):
        raise ValueError(f"targets of the class map that are no classes: {wrong}")
    return dict(mapping)


def group_of(stem: Column) -> Column:
    """Camera and day of a file name: what has to stay in one split. Other names are an error."""
    parts = [F.regexp_extract(stem, STEM, i) for i in (1, 2)]
    return F.when(stem.rlike(STEM), F.concat_ws("/", *parts)).otherwise(F.raise_error(F.concat(F.lit("not a file name of the set: "), stem)).cast("string"))


def clipped(a: Column, b: Column, top: Column) -> tuple[Column, Column]:
    """Both ends of a side inside of 0 and top, the lesser first."""
    low, high = F.greatest(F.lit(0), a), F.least(top, b)
    return F.least(low, high), F.greatest(low, high)


def with_images(documents: DataFrame, images: DataFrame, counts: Observation) -> DataFrame:
    """documents (stem, labels) that have an image (stem, sha256), each image's bytes once: the first by stem. Counts missing_image and duplicate_image."""
    there = images.select("stem", "sha256")
    firsts = there.join(documents.select("stem"), "stem", "left_semi").groupBy("sha256").agg(F.min("stem").alias("stem"))
    placed = documents.join(there, "stem", "left").join(firsts.select("stem", F.lit(True).alias("_first")), "stem", "left")
    seen = placed.observe(
        counts, F.count_if(F.col("sha256").isNull()).alias("missing_image"), F.count_if(F.col("sha256").isNotNull() & F.col("_first").isNull()).alias("duplicate_image"), F.count("*").alias("documents")
    )
    return seen.filter("_first").drop("_first")


def boxes(kept: DataFrame, mapping: Mapping[str, str | None], counts: Observation) -> DataFrame:
    """(stem, group, sha256, class_name, xc, yc, w, h) of every label whose name is mapped to a class; shares of the image, to six places.

    A name that isn't in the mapping is an error. Counts, for each name that is mapped to nothing, its labels, and degenerate_box.
    """
    target = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else F.create_map().cast("map<string,string>")
    names = F.array(*(F.lit(n) for n in mapping)).cast("array<string>")
    label = F.col("l")
    known = F.when(F.array_contains(names, label["name"]), F.element_at(target, label["name"]))
    named = F.when(F.array_contains(names, label["name"]), known).otherwise(F.raise_error(F.concat(F.lit("label is missing from the class map: "), F.coalesce(label["name"], F.lit("null")))).cast("string"))
    rows = kept.select("stem", "sha256", F.explode("labels").alias("l")).withColumn("class_name", named)
    width, height = label["size"]["width"], label["size"]["height"]
    (x1, x2), (y1, y2) = clipped(label["x1"], label["x2"], width), clipped(label["y1"], label["y2"], height)
    thin = (x2 - x1 < LEAST_SIDE) | (y2 - y1 < LEAST_SIDE)
    marked = rows.withColumn("_thin", F.col("class_name").isNotNull() & thin)
    unmapped = [F.count_if(label["name"] == n).alias(n) for n, to in mapping.items() if to is None]
    seen = marked.observe(counts, F.count_if("_thin").alias("degenerate_box"), F.count("*").alias("labels"), *unmapped)
    fit = seen.filter(F.col("class_name").isNotNull() & ~F.col("_thin"))
    share = lambda v, top: F.round(v / top, 6)
    return fit.select(
        "stem", group_of(F.col("stem")).alias("group"), "sha256", "class_name", share((x1 + x2) / 2, width).alias("xc"), share((y1 + y2) / 2, height).alias("yc"), share(x2 - x1, width).alias("w"), share(y2 - y1, height).alias("h")
    )


def converted(documents: DataFrame, images: DataFrame, mapping: Mapping[str, str | None]) -> tuple[DataFrame, tuple[Observation, Observation]]:
    """The boxes of annotation documents (stem, labels of name, x1, y1, x2, y2, size) that have an image, and two observations.

    These are of documents (missing_image, duplicate_image) and of labels (degenerate_box, names mapped to nothing), to be read with `.get`
    once the rows have been written.
    """
    about_documents, about_labels = Observation("intake-documents"), Observation("intake-labels")
    return boxes(with_images(documents, images, about_documents), mapping, about_labels), (about_documents, about_labels)
