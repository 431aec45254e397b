"""A case from folder to report: scan, measure, flag, triage, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismspark.operators import images, protocol
from prismspark.sources import incremental, media


def one_scheme(column: str):
    """Local paths as both sources write them: one slash after the scheme."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def incremental_measures(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """Measures of a folder's images, read from a store for files that have not changed and measured for the others."""
    def analyse(files: DataFrame) -> DataFrame:
        listed = [incremental.escaped(r[0]) for r in files.select("path").collect()]
        scanned = spark.read.format("image").option("dropInvalid", True).load(listed).select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
        found = images.measure(scanned.withColumn("path", one_scheme("path")), protocol.GROUPS)
        return files.select("path", one_scheme("path").alias("bare")).join(found.withColumnRenamed("path", "bare"), "bare", "left").drop("bare").withColumn("status", F.coalesce("status", F.lit("unavailable")))

    return incremental.refresh_files(spark, folder, store, analyse).drop("run")


def analyze_case(spark: SparkSession, folder: str, scores: DataFrame | None = None, store: str | None = None) -> DataFrame:
    """One row per file of a folder: name, digest, marker, measures, flags, triage. Files that no decoder reads keep null measures.

    scores: rows file, model, score, label, validated of other models, by file name. Contents stay with the scans; only
    digests and measures are joined. store: a folder in which measures are kept, so that a later run decodes new files only.
    """
    files = media.case_files(spark, folder)
    text = F.lower(F.decode("content", "iso-8859-1"))
    marker = F.contains(text, F.lit("c2pa")) & (F.contains(text, F.lit("jumb")) | F.contains(text, F.lit("jumd")))
    producer = F.when(F.contains(text, F.lit("openai media service")), "openai media service").when(F.contains(text, F.lit("openai")), "openai")
    known = files.select(one_scheme("path").alias("path"), "name", "medium", "length", "digest", marker.alias("marker_only"), F.when(marker, producer).alias("producer_hint"))
    if store is None:
        measured = images.measure(media.image_pixels(spark, folder).withColumn("path", one_scheme("path")), protocol.GROUPS)
    else:
        measured = incremental_measures(spark, folder, store).drop("modified", "length").withColumn("path", one_scheme("path"))
    rows = known.join(measured, "path", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    if scores is not None:
        listed = scores.groupBy(F.col("file").alias("name")).agg(F.collect_list(F.struct(F.col("model").alias("name"), "score", "label", "validated")).alias("models"))
        rows = rows.join(listed, "name", "left")
    return protocol.triage(protocol.flags(rows))


def run_summary(case: DataFrame) -> DataFrame:
    """Files, signals, files that need review, and inconclusive ones."""
    signals = F.size("spectral_flags") + F.size("observations")
    return case.agg(F.count("*").alias("files"), F.coalesce(F.sum(signals), F.lit(0)).alias("signals"), F.count_if(F.col("triage") == "needs_expert_review").alias("needs_review"), F.count_if(F.col("evidentiary_conclusion") == "inconclusive").alias("inconclusive"))


def convergence_benchmark(case: DataFrame, expected: DataFrame) -> DataFrame:
    """Fusion and protocol reviews against expected_synthetic by file name (case_id): counts, null rates where undefined."""
    votes = case.select(F.col("name").alias("case_id"), F.col("convergence").isin("moderate", "high").alias("fusion"), (F.col("triage") == "needs_expert_review").alias("protocol"))
    stacked = votes.join(expected.select("case_id", "expected_synthetic"), "case_id").select("expected_synthetic", F.explode(F.create_map(F.lit("fusion"), "fusion", F.lit("protocol"), "protocol")).alias("rule", "review"))
    real, hit = ~F.col("expected_synthetic"), F.col("review")
    cells = stacked.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(~real & hit).alias("tp"), F.count_if(real & hit).alias("fp"), F.count_if(real & ~hit).alias("tn"), F.count_if(~real & ~hit).alias("fn"))
    rate = {"accuracy": ("tp + tn", "n"), "sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "precision": ("tp", "tp + fp"), "false_negative_rate": ("fn", "tp + fn")}
    return cells.select("*", *[F.expr(f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))").alias(name) for name, (a, b) in rate.items()])


def markdown(case: DataFrame) -> DataFrame:
    """Numbered report sections, one per file in the order of names. The numbering sorts one case at a time."""
    place = F.row_number().over(Window.orderBy("name", "path"))
    listed = F.array_join(F.concat("spectral_flags", "observations"), ", ")
    section = F.concat_ws("\n", F.concat(F.lit("## "), place.cast("string"), F.lit(". "), "name"), F.concat(F.lit("- SHA-256: "), "digest"), F.concat(F.lit("- screening: "), F.when(listed == "", "none").otherwise(listed)), F.concat(F.lit("- triage: "), "triage"), F.concat(F.lit("- conclusion: "), "evidentiary_conclusion"))
    return case.select(place.alias("place"), "name", section.alias("section"))
