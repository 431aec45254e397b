"""Scans of case folders, images, manifests and exported scores; sinks of reports and artifacts.

Files are listed and read by Spark's own sources. A scan of a folder without matching files gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings by medium.
IMAGE_ENDINGS = "jpg jpeg png bmp tif tiff webp gif".split()
VIDEO_ENDINGS = "mp4 mov avi mkv webm m4v".split()
# Words that manifests use for the two classes and for the parts.
REAL_WORDS, SYNTHETIC_WORDS = ("0", "real"), ("1", "synthetic", "fake", "ai", "deepfake")
EXPECTED_TRUE, EXPECTED_FALSE = ("1", "true", "yes", "synthetic", "deepfake", "ai"), ("0", "false", "no", "real", "non_synthetic", "non-synthetic")
SPLITS = ("train", "validation", "test", "test_holdout")

MANIFEST = "path STRING, label STRING, generator STRING, split STRING, transform STRING"
CONVERGENCE = "path STRING, expected_synthetic STRING, case_id STRING, source STRING"
FRAME_PROBE = "video STRING, frames ARRAY<STRUCT<best_effort_timestamp_time: STRING, pkt_duration_time: STRING, pict_type: STRING, key_frame: INT>>"
SCORES = "files MAP<STRING, ARRAY<STRUCT<name: STRING, model: STRING, score: DOUBLE, label: STRING, validated: BOOLEAN, validation: STRING, dataset: STRING, protocol: STRING>>>"
FIXTURES = """images MAP<STRING, STRUCT<label: STRING, method: STRING, reference: STRING, required_checks: ARRAY<STRING>>>,
 videos MAP<STRING, STRUCT<label: STRING, method: STRING, reference: STRING, required_checks: ARRAY<STRING>>>"""


def case_files(spark: SparkSession, folder: str) -> DataFrame:
    """Regular files of a case: path, name, medium, size, digest, content. Anything that is no video counts as image."""
    files = spark.read.format("binaryFile").load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.when(ending.isin(VIDEO_ENDINGS), "video").otherwise("image").alias("medium"),
        "length",
        F.sha2("content", 256).alias("digest"),
        "content",
    )


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: path, height, width, channels, pixels (blue, green, red). Files that can't be read are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(folder)
    return image.select(
        F.col("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("pixels"),
    )


def labelled_images(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows image STRUCT<bytes, path> and label (0 marks fakes): content, synthetic."""
    rows = spark.read.parquet(path)
    content = F.col("image.bytes") if rows.schema["image"].dataType.typeName() == "struct" else F.col("image")
    return rows.select(content.alias("content"), F.when(F.col("label") == 0, 1).otherwise(0).alias("synthetic"))


def csv_rows(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of a CSV by the names of its header; a missing required column fails, a missing other one is null."""
    found = spark.read.option("header", True).csv(path)
    lost = [c for c in required if c not in found.columns]
    if lost:
        raise ValueError(f"{path}: columns missing: {', '.join(lost)}")
    names = [part.split()[0] for part in schema.split(", ")]
    return found.select(*[F.trim(F.col(f"`{c}`")).alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in names])


def resolved(path, base: str):
    """A path as it stands when absolute, else under base."""
    return F.when(path.rlike("^(/|[a-z0-9]+:)"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Benchmark manifest: path, label (1 synthetic), generator, split, transform. Unknown labels and splits fail the query that reads them."""
    rows = csv_rows(spark, path, MANIFEST, ["path", "label"])
    word, part = F.lower("label"), F.lower(F.coalesce(F.nullif("split", F.lit("")), F.lit("test")))
    part = F.when(part == "val", "validation").otherwise(part)
    failure = F.raise_error(F.concat(F.lit("manifest: bad label or split at "), F.coalesce("path", F.lit("an empty path"))))
    return rows.select(
        resolved(F.col("path"), base).alias("path"),
        F.when(word.isin(*REAL_WORDS), 0).when(word.isin(*SYNTHETIC_WORDS), 1).otherwise(failure.cast("int")).alias("label"),
        F.coalesce(F.nullif("generator", F.lit("")), F.lit("unknown")).alias("generator"),
        F.when(part.isin(*SPLITS), part).otherwise(failure.cast("string")).alias("split"),
        F.coalesce(F.nullif("transform", F.lit("")), F.lit("original")).alias("transform"),
    )


def missing_paths(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows whose file a listing doesn't hold; a listing's `file:` prefix doesn't count."""
    bare = listing.select(F.regexp_replace("path", "^file:(//)?", "").alias("path")).distinct()
    return rows.join(bare, "path", "left_anti")


def convergence_manifest(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Convergence manifest: path, expected_synthetic, case_id (default the file name), source (default the manifest)."""
    rows = csv_rows(spark, path, CONVERGENCE, ["path", "expected_synthetic"])
    word = F.lower("expected_synthetic")
    failure = F.raise_error(F.concat(F.lit("manifest: bad expected_synthetic at "), F.coalesce("path", F.lit("an empty path"))))
    return rows.select(
        resolved(F.col("path"), base).alias("path"),
        F.when(word.isin(*EXPECTED_TRUE), True).when(word.isin(*EXPECTED_FALSE), False).otherwise(failure.cast("boolean")).alias("expected_synthetic"),
        F.coalesce(F.nullif("case_id", F.lit("")), F.regexp_extract("path", r"([^/]+)$", 1)).alias("case_id"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit(path)).alias("source"),
    )


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Declared fixtures: name, medium, label, method, reference, required_checks, synthetic."""
    truth = spark.read.schema(FIXTURES).option("multiLine", True).json(path)
    parts = [truth.select(F.explode(column).alias("name", "fixture")).select("name", F.lit(medium).alias("medium"), "fixture.*") for column, medium in (("images", "image"), ("videos", "video"))]
    return parts[0].unionByName(parts[1]).withColumn("synthetic", F.coalesce((F.col("label") == "synthetic") | F.startswith("method", F.lit("synthetic_")), F.lit(False)))


def frame_probe(spark: SparkSession, path: str) -> DataFrame:
    """Exported frame probes, one JSON object per video: video, idx, pts, kind. Frames without a readable time have null pts."""
    rows = spark.read.schema(FRAME_PROBE).json(path)
    frames = rows.select("video", F.posexplode("frames").alias("idx", "f"))
    return frames.select("video", "idx", F.expr("try_cast(f.best_effort_timestamp_time AS DOUBLE)").alias("pts"), F.col("f.pict_type").alias("kind"))


def external_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores of other models by file; text that is no such JSON gives no row. usable: validated and with a score."""
    rows = spark.read.schema(SCORES).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    each = rows.select(F.explode("files").alias("file", "models")).select("file", F.explode("models").alias("m"))
    return each.select("file", F.coalesce("m.name", "m.model").alias("model"), "m.score", "m.label", F.coalesce(F.col("m.validated"), F.lit(False)).alias("validated")).withColumn("usable", F.col("validated") & F.col("score").isNotNull())


def model_exports(texts: DataFrame, column: str = "content") -> DataFrame:
    """Model scores from JSON texts that hold a list or an object with a list `models`; entries of other kinds are skipped."""
    # Entries stay texts until their kind is known: one wrong entry must not null its list.
    listed = F.from_json(column, "ARRAY<STRING>")
    wrapped = F.from_json(column, "STRUCT<models: ARRAY<STRING>>")["models"]
    is_list = F.startswith(F.ltrim(column), F.lit("["))
    others = [c for c in texts.columns if c != column]
    each = texts.select(*others, F.explode(F.when(is_list, listed).otherwise(wrapped)).alias("entry")).filter(F.startswith("entry", F.lit("{")))
    read = each.select(*others, F.from_json("entry", "STRUCT<name: STRING, score: DOUBLE, label: STRING, validated: BOOLEAN>").alias("m"))
    return read.select(*others, "m.name", "m.score", "m.label", F.coalesce("m.validated", F.lit(False)).alias("validated"))


def write_reports(rows: DataFrame, path: str) -> None:
    """One JSON object per row, null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_shards(features: DataFrame, path: str, shards: int, key: str) -> None:
    """Feature rows in Parquet folders shard=0 .. shards - 1 by a hash of key."""
    features.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")
