"""Rows of the image protocol."""

from prismspark.operators import protocol_rows

FULL = f"""id INT, spectral_flags ARRAY<STRING>, face_flags ARRAY<STRING>, context_flags ARRAY<STRING>, descriptor_flags ARRAY<STRING>, marker BOOLEAN, producer_hint STRING, provenance_valid BOOLEAN, noise_cv DOUBLE, sensor_cv DOUBLE, sensor_std DOUBLE,
 high_low_ratio DOUBLE, resampling BOOLEAN, detectors ARRAY<{protocol_rows.DETECTOR}>, external ARRAY<{protocol_rows.DETECTOR}>, families ARRAY<STRING>, convergence STRING"""


def test_rows(spark):
    rows = [
        (1, ["p"], ["f"], ["c"], ["d"], True, "maker", None, 0.8, 0.9, 0.01, 0.5, True, [("autogan_classifier", "g", 0.2, "synthetic", None, None), ("synthetic_ml", "m", 0.5, "real", False, True), ("synthetic_deep", "n", 0.4, "real", False, None)], [("x", "e", None, "synthetic", True, None)], ["noise"], "single"),
        (2, [], None, None, None, False, None, None, 0.75, None, 0.02, 0.5, None, [("synthetic_deep", "n", None, None, True, True)], [("x", "e", 0.1, "real", True, None), ("x", "u", 0.9, "synthetic", False, None)], [], "none"),
        (3, *[None] * 16),
        (4, [], [], [], [], None, None, None, None, None, None, None, None, [], [], ["a", "b"], "moderate"),
    ]
    df = protocol_rows.protocol_rows(spark.createDataFrame(rows, FULL))
    found = {r.id: r for r in df.collect()}
    assert [o.family for o in found[1].screening_observations] == ["frequency", "face_region", "content_provenance", "noise_consistency", "resampling", "synthetic_texture", "sensor_residual", "face_context", "autogan_spectral_descriptors", "handcrafted_ml_detector", "autogan_spectral_detector", "cross_family_convergence"]
    first = {o.family: o for o in found[1].screening_observations}
    assert first["content_provenance"].signals == ["embedded_c2pa_manifest_marker", "maker"] and first["handcrafted_ml_detector"].calibrated and first["cross_family_convergence"].signals == ["single", "noise"]
    assert found[1].evidence_families == [] and found[1].triage_assessment == "screening_observations_only"
    assert [(e.family, e.model) for e in found[2].evidence_families] == [("validated_learned_detector", "e"), ("deep_detector", "n")] and found[2].validated_models == 2 and found[2].screening_observations == []
    assert found[2].review_reasons == ["validated_model_or_evidence_family_present"] and found[2].triage_assessment == "needs_expert_review"
    assert found[3].triage_assessment == "no_strong_screening_signals" and found[4].review_reasons == ["cross_family_convergence:moderate"] and found[4].triage_assessment == "needs_expert_review"
    assert {r.evidentiary_conclusion for r in found.values()} == {"inconclusive"}
    assert [(r.list, r.place) for r in protocol_rows.each_row(df.filter("id = 2"), "id").collect()] == [("evidence", 0), ("evidence", 1)]
    assert protocol_rows.protocol_rows(spark.range(2)).select("triage_assessment").distinct().first()[0] == "no_strong_screening_signals"
