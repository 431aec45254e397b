"""The rows of the image protocol: what was observed, by family, and what counts as evidence, each with its signals.

Input columns beside the key, all optional but the first (absent ones are null): spectral_flags, face_flags, context_flags and
descriptor_flags (arrays of names); marker (a bare provenance marker was found), producer_hint, provenance_valid; noise_cv,
sensor_cv, sensor_std, high_low_ratio, resampling (a flag); detectors and external (arrays of DETECTOR, those that ran with
success and those given from outside); families and convergence of the fusion.

Null flags and measures observe nothing. Observations never conclude: the conclusion is always `inconclusive`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismspark.functions import thresholds as T

DETECTOR = "struct<kind:string,name:string,score:double,label:string,validated:boolean,calibrated:boolean>"
ROW = "struct<family:string,signals:array<string>,model:string,score:double,calibrated:boolean,validated:boolean>"
# Families of the three kinds of detectors, and the levels of convergence that ask for a review.
DETECTOR_FAMILIES = {"synthetic_ml": "handcrafted_ml_detector", "synthetic_deep": "deep_detector", "autogan_classifier": "autogan_spectral_detector"}
REVIEWED = ("moderate", "high")


def row(family: str | Column, signals: Column | None = None, model: Column | None = None, score: Column | None = None, calibrated: Column | None = None, validated: Column | None = None) -> Column:
    parts = {"family": F.lit(family) if isinstance(family, str) else family, "signals": signals, "model": model, "score": score, "calibrated": F.lit(False) if calibrated is None else calibrated, "validated": validated}
    kinds = {"family": "string", "signals": "array<string>", "model": "string", "score": "double", "calibrated": "boolean", "validated": "boolean"}
    return F.struct(*[(F.lit(None) if v is None else v).cast(kinds[n]).alias(n) for n, v in parts.items()])


def protocol_rows(files: DataFrame) -> DataFrame:
    """files with screening_observations and evidence_families (arrays of ROW, in the order of the protocol's stages),
    validated_models, review_reasons, triage_assessment and evidentiary_conclusion."""
    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in files.columns else F.lit(None).cast(kind)

    names = {n: given(n, "array<string>") for n in ("spectral_flags", "face_flags", "context_flags", "descriptor_flags", "families")}
    number = {n: given(n, "double") for n in ("noise_cv", "sensor_cv", "sensor_std", "high_low_ratio")}
    none = F.array().cast(f"array<{DETECTOR}>")
    detectors, external = (F.coalesce(given(n, f"array<{DETECTOR}>"), none) for n in ("detectors", "external"))
    some = lambda flags: F.coalesce(F.size(flags) > 0, F.lit(False))
    one = lambda name: F.array(F.lit(name))

    base = [
        F.when(some(names["spectral_flags"]), row("frequency", names["spectral_flags"])),
        F.when(some(names["face_flags"]), row("face_region", names["face_flags"])),
        F.when(given("marker", "boolean"), row("content_provenance", F.array_compact(F.array(F.lit("embedded_c2pa_manifest_marker"), given("producer_hint", "string"))), validated=F.coalesce(given("provenance_valid", "boolean"), F.lit(False)))),
        F.when(number["noise_cv"] > T.NOISE_CV, row("noise_consistency", one("high_local_residual_variability"))),
        F.when(given("resampling", "boolean"), row("resampling", one("short_lag_derivative_persistence"))),
        F.when((number["high_low_ratio"] < T.TEXTURE_RATIO) & (number["sensor_std"] < T.TEXTURE_SIGMA), row("synthetic_texture", one("low_high_frequency_ratio_with_low_sensor_residual"), score=number["high_low_ratio"])),
        F.when(number["sensor_cv"] > T.NOISE_CV, row("sensor_residual", one("high_local_residual_energy_variability"))),
        F.when(some(names["context_flags"]), row("face_context", names["context_flags"])),
        F.when(some(names["descriptor_flags"]), row("autogan_spectral_descriptors", names["descriptor_flags"], validated=F.lit(False))),
    ]
    family = F.create_map(*[F.lit(x) for pair in DETECTOR_FAMILIES.items() for x in pair])
    # Detectors in the order of their kinds.
    ordered = F.flatten(F.array(*[F.filter(detectors, of_kind(kind)) for kind in DETECTOR_FAMILIES]))
    as_row = lambda m: row(F.element_at(family, m["kind"]), None, m["name"], m["score"], F.coalesce(m["calibrated"], F.lit(False)), F.coalesce(m["validated"], F.lit(False)))
    sound = lambda m: F.coalesce(m["validated"], F.lit(False))
    observed = F.transform(F.filter(ordered, lambda m: ~sound(m) & (F.coalesce(m["label"] == "synthetic", F.lit(False)) | F.coalesce(m["score"] >= T.MODEL_SCORE, F.lit(False)))), as_row)
    proven = F.transform(F.filter(ordered, sound), as_row)
    outside = F.transform(F.filter(external, lambda m: sound(m) & m["score"].isNotNull()), lambda m: row("validated_learned_detector", None, m["name"], m["score"], F.coalesce(m["calibrated"], F.lit(False)), F.lit(True)))
    level = given("convergence", "string")
    fused = F.array_compact(F.array(F.when(some(names["families"]), row("cross_family_convergence", F.concat(F.array(level), names["families"])))))
    out = files.withColumn("screening_observations", F.concat(F.array_compact(F.array(*base)), observed, fused)).withColumn("evidence_families", F.concat(outside, proven))
    reasons = F.array_compact(F.array(F.when(F.size("evidence_families") > 0, "validated_model_or_evidence_family_present"), F.when(level.isin(*REVIEWED), F.concat(F.lit("cross_family_convergence:"), level))))
    out = out.withColumn("validated_models", F.size(F.filter("evidence_families", lambda e: F.coalesce(e["validated"], F.lit(False))))).withColumn("review_reasons", reasons)
    triage = F.when(F.size("review_reasons") > 0, "needs_expert_review").when(F.size("screening_observations") > 0, "screening_observations_only").otherwise("no_strong_screening_signals")
    return out.withColumn("triage_assessment", triage).withColumn("evidentiary_conclusion", F.lit("inconclusive"))


def of_kind(kind: str):
    return lambda m: m["kind"] == kind


def each_row(files: DataFrame, key: str) -> DataFrame:
    """key, list (observation or evidence), place, family, signals, model, score, calibrated, validated: a row for each."""
    parts = [F.transform(column, lambda r, i: F.struct(i.alias("place"), r.alias("r"))) for column in ("screening_observations", "evidence_families")]
    both = F.concat(*[F.transform(p, named(name)) for p, name in zip(parts, ("observation", "evidence"), strict=True)])
    return files.select(key, F.explode(both).alias("e")).select(key, "e.list", "e.place", "e.r.*")


def named(name: str):
    return lambda p: F.struct(F.lit(name).alias("list"), p["place"].alias("place"), p["r"].alias("r"))
