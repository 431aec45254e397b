"""The gate: every kind of breach, lists per fixture, readiness, and the predicates on passing and failing reports."""

import pytest

from prismspark.operators import validation

FIXTURE = "kind string, fixture string, label string, method string, required array<string>, missing_files array<string>"
CHECK = "check string, fixture string, passed boolean"
GOOD = [("images", "a.jpg", "pristine", None, ["a1", "a2"], []), ("videos", "b.mp4", "edited", "cut", ["b1"], [])]


def test_ready(spark):
    fixtures = spark.createDataFrame(GOOD, FIXTURE)
    checks = spark.createDataFrame([("a1", "a.jpg", True), ("a2", "a.jpg", True), ("b1", "b.mp4", True)], CHECK)
    assert validation.errors(fixtures, checks).count() == 0
    row = validation.readiness(fixtures, checks).first()
    assert row.ready_for_demo_regression and (row.required, row.present, row.passed, row.failed, row.covered, row.validated) == (3, 3, 3, 0, 2, 2)


def test_breaches(spark):
    rows = [*GOOD, ("images", "c.jpg", " ", None, None, ["c_mask.png"]), ("images", "d.jpg", "edited", None, ["d1", "d1"], []), ("videos", "e.mp4", "pristine", None, ["a1"], [])]
    fixtures = spark.createDataFrame(rows, FIXTURE)
    checks = spark.createDataFrame([("a1", "a.jpg", True), ("a2", "b.mp4", True), ("b1", "b.mp4", False), ("b1", "b.mp4", True), ("z9", "b.mp4", True)], CHECK)
    found = {(r.error, r.fixture, r.check) for r in validation.errors(fixtures, checks).collect()}
    assert found == {
        ("label_missing", "c.jpg", None), ("no_required_checks", "c.jpg", None), ("file_missing", "c.jpg", "c_mask.png"), ("method_missing", "d.jpg", None), ("repeated_required_checks", "d.jpg", None),
        ("declared_twice", "a.jpg", "a1"), ("declared_twice", "d.jpg", "d1"), ("produced_twice", "b.mp4", "b1"), ("not_produced", "d.jpg", "d1"), ("wrong_fixture", "a.jpg", "a2"), ("wrong_fixture", "e.mp4", "a1"), ("undeclared", "b.mp4", "z9"),
    }
    by = {r.fixture: r for r in validation.coverage(fixtures, checks).collect()}
    assert (by["a.jpg"].present, by["a.jpg"].passed, by["a.jpg"].wrong_fixture, by["a.jpg"].coverage_complete) == (["a1", "a2"], ["a1"], ["a2"], False)
    assert (by["b.mp4"].failing, by["b.mp4"].coverage_complete, by["b.mp4"].validated) == (["b1"], True, False)
    assert (by["d.jpg"].missing, by["c.jpg"].required, by["c.jpg"].coverage_complete) == (["d1", "d1"], [], False)
    row = validation.readiness(fixtures, checks).first()
    assert not row.ready_for_demo_regression and (row.fixtures, row.covered, row.required, row.present, row.passed) == (5, 1, 6, 4, 1) and row.pass_pct == pytest.approx(100 / 6, abs=1e-6)


def test_nothing_declared(spark):
    row = validation.readiness(spark.createDataFrame([], FIXTURE), spark.createDataFrame([], CHECK)).first()
    assert not row.ready_for_demo_regression and row.pass_pct == row.fixture_coverage_pct == 100.0


def test_required_checks(spark):
    fields = [f.name for f in spark.createDataFrame([], validation.REPORT).schema]
    fixtures = sorted({f for _, f, _ in validation.CHECKS})
    assert len(validation.CHECKS) == 16 and len(fixtures) == 12
    skip = (30, 29, 40, 10)
    good = dict(
        triage="no_strong_screening_signals", suspicious_clusters=0, suspicious_pairs=12, translation_error=7.5, components=1, iou=0.8, dct_score=0.4, pristine_dct_score=0.1, resampling_flag=True, pristine_resampling_flag=False,
        face_flags=["asymmetry"], observations=["synthetic_texture"], duplicate_transitions=[3, 4], expected_duplicates=[3, 4], abrupt_transitions=[5], expected_abrupt=[5], motion_transitions=[2, 30], questioned_transition=30, skips=[skip], expected_skip=skip,
    )
    per = {"img_002_copy_move.jpg": {"suspicious_clusters": 1}, "vid_001_pristine.mp4": {"duplicate_transitions": [], "abrupt_transitions": None}}
    rows = [tuple(({"fixture": f} | good | per.get(f, {})).get(n) for n in fields) for f in fixtures]
    found = validation.evaluate(spark.createDataFrame(rows, validation.REPORT)).collect()
    assert len(found) == 16 and all(r.passed for r in found)
    empty = [tuple(f if n == "fixture" else None for n in fields) for f in fixtures]
    passed = {r.check for r in validation.evaluate(spark.createDataFrame(empty, validation.REPORT)).collect() if r.passed}
    assert passed == {"pristine_image_not_deepfake_escalated", "pristine_image_no_copy_move_cluster", "pristine_video_no_duplicate_or_abrupt_transition_flag"}
    bad = good | dict(iou=0.47, dct_score=0.14, translation_error=8.1, duplicate_transitions=[3], abrupt_transitions=[], motion_transitions=[2], skips=[(30, 29, 41, 10)])
    rows = [tuple(({"fixture": f} | bad).get(n) for n in fields) for f in fixtures]
    failed = {r.check for r in validation.evaluate(spark.createDataFrame(rows, validation.REPORT)).collect() if not r.passed}
    assert {"splice_reference_localization", "face_replacement_reference_localization", "double_jpeg_dct_ranks_above_pristine", "copy_move_translation_matches_fixture", "copy_move_detected", "duplicated_frames_exact_fixture_positions", "segment_deletion_motion_discontinuity", "segment_deletion_reference_alignment", "overlay_edit_abrupt_boundaries_detected"} <= failed
    assert "inpainting_reference_localization" not in failed
