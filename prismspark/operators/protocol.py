"""Screening flags, evidence families and triage of measured files. No rule here reaches a conclusion.

`measured` holds the columns of `images.measure` with the groups frequency, noise_map, sensor and resampling. Null
measures raise no flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.functions import thresholds as T
from prismspark.operators import images

GROUPS = ["histogram", "ela", "noise_map", "sensor", "lsb", "dct", "frequency", "resampling"]
# Names of the flags.
SPECTRAL_FLAGS = ("many_spectral_peaks", "unusual_high_low_ratio", "unusual_quadrant_uniformity")


def filled(pictures: DataFrame, measured: DataFrame, groups: list[str] | None = None, key: str = "path") -> DataFrame:
    """Measures of every picture: those of measured, and where a group is missing or all null, what measuring gives. Only
    pictures that lack something are decoded; measured rows without a picture are left out."""
    groups = groups or GROUPS
    columns = {g: [f"{g}_{n}" for n in images.fields(g)] for g in groups}
    given = measured.withColumns({c: F.lit(None).cast("double") for own in columns.values() for c in own if c not in measured.columns})
    for name in ("status", "error"):
        if name not in given.columns:
            given = given.withColumn(name, F.lit(None).cast("string"))
    complete = F.lit(True)
    for own in columns.values():
        complete = complete & F.coalesce(*own).isNotNull()
    wanted = pictures.select(key).distinct()
    have = given.join(wanted, key, "left_semi")
    fresh = images.measure(pictures.join(have.filter(complete).select(key), key, "left_anti"), groups, key)
    added = fresh.select(key, *(F.col(c).alias(f"new_{c}") for c in fresh.columns if c != key))
    rows = have.join(added, key, "full_outer")
    merged = []
    for own in columns.values():
        kept = F.coalesce(*own).isNotNull()
        merged += [F.when(kept, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in own]
    return rows.select(key, F.coalesce("new_status", "status").alias("status"), F.coalesce("new_error", "error").alias("error"), *merged)


def flags(measured: DataFrame) -> DataFrame:
    """measured with spectral_flags and observations, arrays of names."""
    ratio, sigma = F.col("frequency_high_low_ratio"), F.col("sensor_global_sigma")
    spectral = (F.col("frequency_peak_count") >= T.SPECTRAL_PEAKS, (ratio < T.RATIO_LOW) | (ratio > T.RATIO_HIGH), F.col("frequency_quadrant_cv") < T.QUADRANT_CV)
    observed = [
        (F.col("noise_map_block_sigma_cv") > T.NOISE_CV, "noise_inconsistency"),
        (F.col("resampling_persistence") >= T.RESAMPLING_PERSISTENCE, "resampling"),
        ((ratio < T.TEXTURE_RATIO) & (sigma < T.TEXTURE_SIGMA), "synthetic_texture"),
        (F.col("sensor_block_sigma_cv") > T.SENSOR_CV, "sensor_residual_inconsistency"),
    ]
    with_spectral = measured.withColumn("spectral_flags", F.array_compact(F.array(*[F.when(rule, name) for rule, name in zip(spectral, SPECTRAL_FLAGS)])))
    return with_spectral.withColumn("observations", F.array_compact(F.array(*[F.when(rule, name) for rule, name in observed])))


def triage(flagged: DataFrame) -> DataFrame:
    """flagged with families, convergence, review_reasons, triage, evidentiary_conclusion.

    Optional columns: face_flags and context_flags (arrays), provenance_valid, marker_only (booleans), models (array of
    struct name, score, label, validated of successful models). Resampling and bare markers never make a family; models
    do only when validated.
    """
    def given(name: str, kind: str):
        return F.col(name) if name in flagged.columns else F.lit(None).cast(kind)

    faces, context = given("face_flags", "array<string>"), given("context_flags", "array<string>")
    models = F.coalesce(given("models", "array<struct<name:string,score:double,label:string,validated:boolean>>"), F.array().cast("array<struct<name:string,score:double,label:string,validated:boolean>>"))
    evidence = F.transform(F.filter(models, lambda m: m["validated"] & m["score"].isNotNull()), lambda m: m["name"])
    votes = F.filter(models, lambda m: ~F.coalesce(m["validated"], F.lit(False)) & ((m["label"] == "synthetic") | (m["score"] >= T.MODEL_SCORE)))
    seen = F.col("observations")
    members = [
        (F.size("spectral_flags") > 0, "spectral"), (F.size(faces) > 0, "face"), (F.size(context) > 0, "face_context"),
        (F.array_contains(seen, "noise_inconsistency"), "noise"), (F.array_contains(seen, "sensor_residual_inconsistency"), "sensor_residual"), (given("provenance_valid", "boolean"), "validated_provenance"),
    ]
    families = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(rule, name) for rule, name in members])), evidence)))
    count = F.size("families")
    level = F.when(count >= T.FUSION_HIGH, "high").when(count >= T.FUSION_MODERATE, "moderate").when(count == 1, "single").otherwise("none")
    reasons = F.array_compact(F.array(F.when(F.size("evidence") > 0, "evidence_present"), F.when(F.col("convergence").isin("moderate", "high"), F.concat(F.lit("cross_family_convergence:"), "convergence"))))
    anything = (count > 0) | (F.size(seen) > 0) | (F.size(votes) > 0) | F.coalesce(given("marker_only", "boolean"), F.lit(False))
    state = F.when(F.size("review_reasons") > 0, "needs_expert_review").when(anything, "screening_observations_only").otherwise("no_strong_screening_signals")
    joined = flagged.withColumn("evidence", evidence).withColumn("families", families).withColumn("convergence", level)
    return joined.withColumn("review_reasons", reasons).withColumn("triage", state).withColumn("evidentiary_conclusion", F.lit("inconclusive"))
