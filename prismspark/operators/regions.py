"""Regions in which two images of one scene differ: threshold, morphology and connected components without Python workers.

What concerns one image alone is done in its row by array functions: the mean difference of the channels, its robust
threshold, the mask, and the opening and closing, each split into steps along rows and along columns. A mask then becomes
runs, stretches of set pixels of one image row; a joined graph of touching runs is labelled in Spark by the smallest run
that reaches them, in rounds that double the reach, each written to the shared folder. Only runs are shuffled.

Pixels are ARRAY<DOUBLE>, row by row, the channels of a pixel together; from_bytes() reads the bytes of an image source.
Defined results: images of other shapes than their reference, without one, or with null or wrongly sized pixels are
not_comparable; an image without regions has none of them; equal areas are in the order of their first pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions import thresholds as T
from prismspark.session import work_folder

#: Regions listed of an image, the largest first, and the sides of the squares of opening and closing.
LISTED, OPENING, CLOSING = 20, 3, 7


def from_bytes(pixels: Column) -> Column:
    """The unsigned bytes of a binary column as ARRAY<DOUBLE>."""
    return F.transform(F.regexp_extract_all(F.hex(pixels), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("double"))


def median(values: Column) -> Column:
    """The middle of an array, or the mean of both middles."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


def spread(mask: str, side: int, along_rows: bool, grow: bool) -> Column:
    """One step of a dilation (grow) or erosion by a line of side pixels; what lies outside the image never decides."""
    half, w, h = side // 2, F.col("width"), F.col("height")

    def at(v: Column, i: Column) -> Column:
        found = v
        for k in (k for k in range(-half, half + 1) if k):
            there = (i % w + k).between(F.lit(0), w - 1) if along_rows else (F.floor(i / w) + k).between(F.lit(0), h - 1)
            near = F.get(F.col(mask), i + (F.lit(k) if along_rows else w * k))
            found = (found | (there & near)) if grow else (found & (~there | near))
        return found

    return F.transform(F.col(mask), at)


def masks(pairs: DataFrame, key: str, *, floor: float = T.REFERENCE_FLOOR, sigma: float = T.ROBUST_SIGMA) -> DataFrame:
    """key, status, height, width, difference, median, mad, threshold, mask for pairs: key, height, width, channels, pixels and
    reference_height, reference_width, reference_channels, reference_pixels."""
    size = F.col("height") * F.col("width")
    same = F.lit(True)
    for side in ("height", "width", "channels"):
        same = same & (F.col(side) == F.col(f"reference_{side}"))
    for pixels in ("pixels", "reference_pixels"):
        same = same & (F.size(pixels) == size * F.col("channels")) & ~F.exists(pixels, lambda v: v.isNull() | F.isnan(v))
    same = F.coalesce(same & (size > 0), F.lit(False))
    each = F.zip_with("pixels", "reference_pixels", lambda a, b: F.abs(a - b))
    channels = F.col("channels").cast("int")
    of_pixel = lambda i: F.aggregate(F.slice(F.col("each"), i * channels + 1, channels), F.lit(0.0), lambda s, v: s + v) / channels
    whole = F.sequence(F.lit(0), (size - 1).cast("int"))
    out = pairs.withColumn("status", F.when(same, "success").otherwise("not_comparable"))
    out = out.withColumn("each", F.when(F.col("status") == "success", each))
    out = out.select(key, "status", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.when(channels == 1, F.col("each")).when(F.col("status") == "success", F.transform(whole, of_pixel)).alias("difference"))
    out = out.withColumn("median", median(F.col("difference")))
    out = out.withColumn("mad", median(F.transform("difference", lambda v: F.abs(v - F.col("median")))))
    out = out.withColumn("threshold", F.when(F.col("status") == "success", F.greatest(F.lit(floor), F.col("median") + F.lit(sigma * T.MAD_SCALE) * F.col("mad"))))
    out = out.withColumn("mask", F.transform("difference", lambda v: v >= F.col("threshold")))
    for side, order in ((OPENING, (False, True)), (CLOSING, (True, False))):
        for grow in order:
            for along_rows in (True, False):
                out = out.withColumn("mask", spread("mask", side, along_rows, grow))
    return out


def runs(masked: DataFrame, key: str) -> DataFrame:
    """key, start (place of the first pixel), y, x, last_x, total (of the difference) of the stretches of set pixels."""
    mask, w = F.col("mask"), F.col("width")
    starts = F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(mask, i) & ((i % w == 0) | ~F.get(mask, i - 1)))
    ends = F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(mask, i) & ((i % w == w - 1) | ~F.get(mask, i + 1)))
    found = masked.filter("status = 'success'").select(key, "width", "difference", F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("runs"))
    found = found.select(key, "width", F.explode(F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.aggregate(F.slice(F.col("difference"), r["start"] + 1, r["end"] - r["start"] + 1), F.lit(0.0), lambda s, v: s + v).alias("total")))).alias("r"))
    return found.select(key, F.col("r.start").alias("start"), F.floor(F.col("r.start") / F.col("width")).cast("int").alias("y"), (F.col("r.start") % F.col("width")).alias("x"), (F.col("r.end") % F.col("width")).alias("last_x"), F.col("r.total").alias("total"))


def written(df: DataFrame, label: str) -> DataFrame:
    folder = work_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that goes by a shuffle: runs are few bytes on disk, for which Spark would send every table of every round
    through the driver to all executors."""
    return left.join(right.hint("merge"), on, how)


def labelled(found: DataFrame, key: str) -> DataFrame:
    """runs() with label: the smallest start of the runs that are joined with it by touching ones, corners included.

    Each round gives a run the smallest of its label, its neighbours' labels and the label of the run that it names, in one
    job; it ends when nothing changes.
    """
    found = written(found, "runs")
    one, two = found.select(key, F.col("start").alias("a"), F.col("y").alias("y_a"), F.col("x").alias("x_a"), F.col("last_x").alias("last_a")), found.select(key, F.col("start").alias("b"), (F.col("y") - 1).alias("y_a"), F.col("x").alias("x_b"), F.col("last_x").alias("last_b"))
    down = joined(one, two, [key, "y_a"]).filter("x_b <= last_a + 1 AND x_a <= last_b + 1").select(key, "a", "b")
    links = written(down.unionByName(down.select(key, F.col("b").alias("a"), F.col("a").alias("b"))), "touching")
    labels = found.select(key, F.col("start").alias("b"), F.col("start").alias("label"))
    while True:
        near = joined(links, labels, [key, "b"]).groupBy(key, F.col("a").alias("b")).agg(F.min("label").alias("near"))
        named = labels.select(key, F.col("b").alias("label"), F.col("label").alias("further"))
        whole = joined(joined(labels, near, [key, "b"], "left"), named, [key, "label"], "left")
        labels = written(whole.select(key, "b", F.least("label", "near", "further").alias("label"), F.col("label").alias("before")), "labels")
        if labels.filter("label < before").isEmpty():
            return joined(found, labels.select(key, F.col("b").alias("start"), "label"), [key, "start"])
        labels = labels.drop("before")


def regions(labelled_runs: DataFrame, key: str, *, least_area: int = T.COMPONENT_AREA) -> DataFrame:
    """key, label, x, y, w, h, area, mean_abs_difference and place (1: the largest) of regions of least_area pixels or more."""
    area = F.sum(F.col("last_x") - F.col("x") + 1)
    found = labelled_runs.groupBy(key, "label").agg(area.alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("last_x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), (F.sum("total") / area).alias("mean_abs_difference"))
    return found.filter(F.col("area") >= least_area).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area"), "label")))


def differences(pairs: DataFrame, key: str, **rule) -> DataFrame:
    """key, status, median, mad, threshold, changed_fraction, component_count and components (at most LISTED structs place, x,
    y, w, h, area, mean_abs_difference, the largest first) of every pair."""
    masked = written(masks(pairs, key, **rule), "masks")
    columns = ["place", "x", "y", "w", "h", "area", "mean_abs_difference"]
    found = regions(labelled(runs(masked, key), key), key)
    listed = found.groupBy(key).agg(F.count("*").alias("component_count"), F.array_sort(F.collect_list(F.when(F.col("place") <= LISTED, F.struct(*columns)))).alias("components"))
    changed = F.when(F.col("status") == "success", F.size(F.filter("mask", lambda v: v)) / F.size("mask"))
    out = joined(masked.select(key, "status", "median", "mad", "threshold", changed.alias("changed_fraction")), listed, [key], "left")
    return out.withColumn("component_count", F.when(F.col("status") == "success", F.coalesce("component_count", F.lit(0))))
