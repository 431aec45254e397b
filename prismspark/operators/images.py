"""Measures of decoded images: one Arrow map over (path, height, width, channels, pixels), no shuffle.

Images flow through in batches; a task holds one batch and the measures of 256 images. Rows with null, empty or inconsistent pixels give status
`unreadable` and null measures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prismspark.functions import jpeg, pixels
from prismspark.session import ship

GRAY = {"dct": pixels.dct_periodicity, "frequency": pixels.radial_profile, "resampling": pixels.resampling_screen}
COLOUR = {
    "histogram": pixels.histogram,
    "ela": jpeg.error_level,
    "noise": lambda rgb: pixels.residual_stats(pixels.luminance(rgb) / 255, 1.0),
    "noise_map": pixels.noise_map,
    "sensor": pixels.sensor_screen,
    "lsb": pixels.lsb_screen,
    "features": pixels.feature_bank,
}
#: Images whose measures are handed on together, and the bytes that a worker frees once, so that its C library keeps what kernels
#: free for the next image; else pages go back to the system and are faulted in again with every temporary array.
BATCH, KEPT_BYTES = 256, 28 << 20
#: What a kernel may raise on a single odd image without ending the job.
FAILURES = (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError)


def to_rgb(height, width, channels, data) -> np.ndarray | None:
    """An image row as height x width x 3; grey is repeated, a fourth channel dropped; None if the sizes don't agree."""
    if data is None or pd.isna(height) or pd.isna(width) or channels not in (1, 3, 4) or not len(data) or len(data) != height * width * channels:
        return None
    image = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    return image.repeat(3, axis=2) if channels == 1 else image[:, :, 2::-1]


def fields(group: str) -> list[str]:
    """Names of the measures of a group."""
    sample = np.zeros((8, 8, 3), np.uint8)
    return sorted(GRAY[group](pixels.luminance(sample)) if group in GRAY else COLOUR[group](sample))


def measure(images: DataFrame, groups: list[str], key: str = "path") -> DataFrame:
    """key, status, error and one double per measure, named group_measure, for each image and each group of GRAY and COLOUR.

    An image on which a kernel fails gets status `error` with its message, and null measures."""
    ship(images.sparkSession)
    names = {g: fields(g) for g in groups}
    schema = f"{images.select(key).schema[key].simpleString().replace(':', ' ', 1)}, status STRING, error STRING, " + ", ".join(f"{g}_{n} DOUBLE" for g in groups for n in names[g])

    def values(rgb: np.ndarray) -> list:
        gray = pixels.luminance(rgb)
        found = {g: GRAY[g](gray) if g in GRAY else COLOUR[g](rgb) for g in groups}
        return [found[g].get(n) for g in groups for n in names[g]]

    columns = [key, "status", "error"] + [f"{g}_{n}" for g in groups for n in names[g]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.empty(KEPT_BYTES, np.uint8)
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                rows = []
                for k, *image in batch.iloc[start : start + BATCH].itertuples(index=False):
                    rgb, none = to_rgb(*image), [None] * (len(columns) - 3)
                    if rgb is None:
                        rows.append([k, "unreadable", None, *none])
                        continue
                    try:
                        rows.append([k, "success", None, *values(rgb)])
                    except FAILURES as failure:
                        rows.append([k, "error", repr(failure), *none])
                yield pd.DataFrame(rows, columns=columns)

    found = images.select(key, "height", "width", "channels", "pixels").mapInPandas(run, schema)
    # pandas marks a missing measure as NaN.
    return found.select(*[F.nanvl(f.name, F.lit(None).cast("double")).alias(f.name) if isinstance(f.dataType, DoubleType) and f.name != key else f"`{f.name}`" for f in found.schema])


def per_image(images: DataFrame, schema: str, kernel: Callable[[np.ndarray], list[dict]], key: str = "path") -> DataFrame:
    """Rows of dicts that a kernel makes of each readable image, with its key. An image on which the kernel fails gives one
    row of nulls."""
    ship(images.sparkSession)
    kind = images.select(key).schema[key].simpleString().replace(":", " ", 1)
    columns = [key] + [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, h, w, c, data in batch.itertuples(index=False):
                rgb = to_rgb(h, w, c, data)
                if rgb is not None:
                    try:
                        rows = kernel(rgb)
                    except FAILURES:
                        rows = [{}]
                    yield pd.DataFrame([{key: k} | row for row in rows], columns=columns)

    return images.select(key, "height", "width", "channels", "pixels").mapInPandas(run, f"{kind}, {schema}")


def hashes(images: DataFrame, key: str = "path") -> DataFrame:
    """Perceptual hashes of 64 bits in hex."""
    return per_image(images, "average_hash STRING, difference_hash STRING, dct_hash STRING", lambda rgb: [pixels.perceptual_hashes(rgb)], key)


def ghosts(images: DataFrame, key: str = "path") -> DataFrame:
    """Per image the qualities of the sweep with their errors, and the quality of the first least error."""
    rows = per_image(images, "quality INT, error DOUBLE, block_cv DOUBLE", jpeg.ghost_sweep, key)
    return rows.groupBy(key).agg(F.min_by("quality", F.struct("error", "quality")).alias("best_quality"), F.array_sort(F.collect_list(F.struct("quality", "error", "block_cv"))).alias("sweep"))


def quantisation(files: DataFrame) -> DataFrame:
    """Tables of JPEG files (path, content) with sum, mean, bounds and first 16 values; other files give status unavailable."""
    ship(files.sparkSession)

    @F.pandas_udf("array<struct<table_id:int,values:array<int>>>")
    def parse(content: pd.Series) -> pd.Series:
        return content.map(jpeg.quantisation_tables)

    rows = files.select("path", parse("content").alias("tables"))
    each = rows.select("path", F.when(F.col("tables").isNull(), "unavailable").otherwise("success").alias("status"), F.explode_outer("tables").alias("t"))
    total = F.aggregate("t.values", F.lit(0), lambda a, v: a + v)
    return each.select("path", "status", "t.table_id", total.alias("total"), (total / F.size("t.values")).alias("mean"), F.array_min("t.values").alias("low"), F.array_max("t.values").alias("high"), F.slice("t.values", 1, 16).alias("first16"))


def differences(pairs: DataFrame) -> DataFrame:
    """Changed regions of pairs (path, height, width, channels, pixels, ref_height, ref_width, ref_channels, ref_pixels)."""
    ship(pairs.sparkSession)
    columns = ["path", "status", "threshold", "changed_fraction", "component_count", "components"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, *sides in batch.itertuples(index=False):
                a, b = to_rgb(*sides[:4]), to_rgb(*sides[4:])
                found = {"status": "unreadable", "components": []} if a is None or b is None else pixels.reference_difference(a, b)
                yield pd.DataFrame([{"path": path} | found], columns=columns)

    sides = [prefix + c for prefix in ("", "ref_") for c in ("height", "width", "channels", "pixels")]
    return pairs.select("path", *sides).mapInPandas(run, "path STRING, status STRING, threshold DOUBLE, changed_fraction DOUBLE, component_count DOUBLE, components ARRAY<STRUCT<x: INT, y: INT, w: INT, h: INT, area: INT, mean_difference: DOUBLE>>")


def faces(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Screen of given face boxes (path, face, x, y, w, h): measures and flags; a detector is not part of the library."""
    ship(images.sparkSession)
    columns = ["path", "face", "sharpness", "asymmetry", "residual_ratio", "sharpness_ratio"]
    # Of the faces of an image the ten largest count.
    listed = boxes.groupBy("path").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct((F.col("w") * F.col("h")).alias("area"), "face", "x", "y", "w", "h")))), 1, 10).alias("faces"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, h, w, c, data, found in batch.itertuples(index=False):
                rgb = to_rgb(h, w, c, data)
                if rgb is not None:
                    rows = [{"path": path, "face": f["face"]} | pixels.face_measures(rgb, (f["x"], f["y"], f["w"], f["h"])) for f in found]
                    yield pd.DataFrame(rows, columns=columns)

    joined = images.join(listed, "path").select("path", "height", "width", "channels", "pixels", "faces")
    measures = joined.mapInPandas(run, "path STRING, face INT, sharpness DOUBLE, asymmetry DOUBLE, residual_ratio DOUBLE, sharpness_ratio DOUBLE")
    named = [
        (F.expr("asymmetry >= 0.12 AND sharpness < 700"), "face_luminance_texture_inconsistency"),
        (F.expr("residual_ratio < 0.45 OR residual_ratio > 2.2"), "face_context_noise_mismatch"),
        (F.expr("sharpness_ratio < 0.35 OR sharpness_ratio > 2.8"), "face_context_sharpness_mismatch"),
    ]
    return measures.withColumn("flags", F.array_compact(F.array(*[F.when(rule, name) for rule, name in named])))
