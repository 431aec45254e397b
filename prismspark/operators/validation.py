"""The regression gate: required checks as predicates over reports, the fixtures' contract, coverage and readiness.

`fixtures` holds a row per declared fixture (kind, fixture, label, method, required ARRAY<STRING>, missing_files
ARRAY<STRING> of what it names and does not exist); `checks` a row per produced check (check, fixture, passed). Nulls
in `required` are an empty list, null results have not passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a fixture's report that the checks read, with their types.
REPORT = (
    "fixture STRING, triage STRING, suspicious_clusters INT, suspicious_pairs INT, translation_error DOUBLE, components INT, iou DOUBLE, dct_score DOUBLE, pristine_dct_score DOUBLE, "
    "resampling_flag BOOLEAN, pristine_resampling_flag BOOLEAN, face_flags ARRAY<STRING>, observations ARRAY<STRING>, duplicate_transitions ARRAY<INT>, expected_duplicates ARRAY<INT>, "
    "abrupt_transitions ARRAY<INT>, expected_abrupt ARRAY<INT>, motion_transitions ARRAY<INT>, questioned_transition INT, skips ARRAY<STRUCT<transition: INT, before: INT, after: INT, skipped: INT>>, expected_skip STRUCT<transition: INT, before: INT, after: INT, skipped: INT>"
)
# Name, fixture and rule of each required check.
CHECKS = [
    ("pristine_image_not_deepfake_escalated", "img_001_pristine.jpg", "coalesce(triage, '') <> 'needs_expert_review'"),
    ("pristine_image_no_copy_move_cluster", "img_001_pristine.jpg", "coalesce(suspicious_clusters, 0) = 0"),
    ("copy_move_detected", "img_002_copy_move.jpg", "suspicious_pairs >= 10 AND suspicious_clusters >= 1"),
    ("copy_move_translation_matches_fixture", "img_002_copy_move.jpg", "translation_error <= 8.0"),
    ("splice_reference_localization", "img_003_splice.jpg", "components >= 1 AND iou >= 0.75"),
    ("double_jpeg_dct_ranks_above_pristine", "img_004_double_jpeg.jpg", "coalesce(dct_score, 0) > coalesce(pristine_dct_score, 0) + 0.05 AND coalesce(dct_score, 0) / (coalesce(pristine_dct_score, 0) + 1e-12) >= 2.0"),
    ("resampling_fixture_separates_from_pristine", "img_005_resampled.jpg", "NOT pristine_resampling_flag AND resampling_flag"),
    ("inpainting_reference_localization", "img_006_inpainted.jpg", "components >= 1 AND iou >= 0.45"),
    ("face_replacement_native_screening_flag", "img_007_deepfake_face.jpg", "size(face_flags) > 0"),
    ("face_replacement_reference_localization", "img_007_deepfake_face.jpg", "components >= 1 AND iou >= 0.50"),
    ("ai_generated_native_synthetic_texture_screen", "img_008_ai_generated.png", "array_contains(observations, 'synthetic_texture')"),
    ("pristine_video_no_duplicate_or_abrupt_transition_flag", "vid_001_pristine.mp4", "coalesce(size(duplicate_transitions), 0) = 0 AND coalesce(size(abrupt_transitions), 0) = 0"),
    ("duplicated_frames_exact_fixture_positions", "vid_002_duplicated_frames.mp4", "coalesce(duplicate_transitions, array()) = expected_duplicates"),
    ("segment_deletion_motion_discontinuity", "vid_003_deleted_segment.mp4", "array_contains(motion_transitions, questioned_transition)"),
    ("segment_deletion_reference_alignment", "vid_003_deleted_segment.mp4", "array_contains(skips, expected_skip)"),
    ("overlay_edit_abrupt_boundaries_detected", "vid_004_overlay_edit.mp4", "coalesce(abrupt_transitions, array()) = expected_abrupt"),
]


def evaluate(reports: DataFrame) -> DataFrame:
    """check, fixture, passed: the required checks of the fixtures that have a report (columns as in REPORT)."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.lit(fixture).alias("fixture"), F.coalesce(F.expr(rule), F.lit(False)).alias("passed")) for name, fixture, rule in CHECKS]))
    return reports.select(F.col("fixture").alias("reported"), each.alias("c")).filter("c.fixture = reported").select("c.*")


def paired(fixtures: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared (kind, fixture, check) and one row per produced check with how often it was produced."""
    declared = fixtures.select("kind", "fixture", F.explode("required").alias("check"))
    produced = checks.groupBy("check").agg(F.count("*").alias("times"), F.array_sort(F.collect_set("fixture")).alias("owners"), F.min(F.coalesce("passed", F.lit(False))).alias("passed"))
    return declared, produced


def errors(fixtures: DataFrame, checks: DataFrame) -> DataFrame:
    """error, kind, fixture, check: every breach of the contract between fixtures and produced checks."""
    declared, produced = paired(fixtures, checks)
    own = F.lit(None).cast("string")

    def of_fixture(rule: F.Column, error: str) -> DataFrame:
        return fixtures.filter(rule).select(F.lit(error).alias("error"), "kind", "fixture", own.alias("check"))

    empty = F.coalesce(F.size("required"), F.lit(-1)) < 1
    out = of_fixture(F.coalesce(F.trim("label"), F.lit("")) == "", "label_missing")
    out = out.unionByName(of_fixture((F.trim("label") != "") & (F.col("label") != "pristine") & (F.coalesce("method", F.lit("")) == ""), "method_missing"))
    out = out.unionByName(of_fixture(empty, "no_required_checks"))
    out = out.unionByName(of_fixture(F.size(F.array_distinct("required")) < F.size("required"), "repeated_required_checks"))
    out = out.unionByName(fixtures.select(F.lit("file_missing").alias("error"), "kind", "fixture", F.explode("missing_files").alias("check")))
    twice = declared.groupBy("check").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("fixture").alias("fixture")).filter("n > 1")
    out = out.unionByName(twice.select(F.lit("declared_twice").alias("error"), "kind", "fixture", "check"))
    out = out.unionByName(produced.filter("times > 1").select(F.lit("produced_twice").alias("error"), own.alias("kind"), F.col("owners")[0].alias("fixture"), "check"))
    both = declared.join(produced, "check", "left")
    out = out.unionByName(both.filter("times IS NULL").select(F.lit("not_produced").alias("error"), "kind", "fixture", "check"))
    out = out.unionByName(both.filter("times IS NOT NULL AND owners <> array(fixture)").select(F.lit("wrong_fixture").alias("error"), "kind", "fixture", "check"))
    return out.unionByName(produced.join(declared, "check", "left_anti").select(F.lit("undeclared").alias("error"), own.alias("kind"), F.col("owners")[0].alias("fixture"), "check"))


def coverage(fixtures: DataFrame, checks: DataFrame) -> DataFrame:
    """Per fixture its required, present, passed, missing, failing and wrong-fixture checks, and whether it is complete and
    validated. The lists are as long as the fixture's own."""
    declared, produced = paired(fixtures, checks)
    there, wrong = F.col("times").isNotNull(), F.col("owners") != F.array("fixture")
    lists = {"present": there, "passed": there & ~wrong & F.col("good"), "missing": ~there, "failing": there & ~F.col("good"), "wrong_fixture": there & wrong}
    both = declared.join(produced.withColumnRenamed("passed", "good"), "check", "left")
    found = both.groupBy("kind", "fixture").agg(*[F.array_sort(F.collect_list(F.when(rule, F.col("check")))).alias(name) for name, rule in lists.items()])
    none = F.array().cast("array<string>")
    rows = fixtures.select("kind", "fixture", F.coalesce("required", none).alias("required")).join(found, ["kind", "fixture"], "left").withColumns({n: F.coalesce(n, none) for n in lists})
    complete = (F.size("required") > 0) & (F.size("missing") == 0) & (F.size("wrong_fixture") == 0)
    return rows.withColumn("coverage_complete", complete).withColumn("validated", complete & (F.size("passed") == F.size("required")))


def readiness(fixtures: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: totals, percentages (100 where there is nothing), contract errors, and whether the gate is open."""
    def share(part: str, whole: str) -> F.Column:
        return F.when(F.col(whole) == 0, 100.0).otherwise(F.round(100.0 * F.col(part) / F.col(whole), 6))

    totals = coverage(fixtures, checks).agg(
        F.count("*").alias("fixtures"), F.count_if("coverage_complete").alias("covered"), F.count_if("validated").alias("validated"),
        *[F.coalesce(F.sum(F.size(n)), F.lit(0)).alias(n) for n in ("required", "present", "passed")],
    )
    found = totals.withColumns({"failed": F.col("required") - F.col("passed"), "contract_errors": F.lit(errors(fixtures, checks).count())})
    found = found.withColumns({"fixture_coverage_pct": share("covered", "fixtures"), "fixture_pass_pct": share("validated", "fixtures"), "assertion_coverage_pct": share("present", "required"), "pass_pct": share("passed", "required")})
    ready = (F.col("required") > 0) & (F.col("contract_errors") == 0)
    for name in ("fixture_coverage_pct", "fixture_pass_pct", "assertion_coverage_pct", "pass_pct"):
        ready = ready & (F.col(name) == 100.0)
    return found.withColumn("ready_for_demo_regression", ready)
