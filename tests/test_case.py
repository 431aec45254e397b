"""A case from files to report, and the frame screens."""

import os

import numpy as np
from pyspark.sql import functions as F

from prismspark import case
from prismspark.functions import pixels, png
from prismspark.operators import artifacts, images, protocol, temporal
from prismspark.sources import media


def planted(tmp_path):
    rng = np.random.default_rng(8)
    image = np.clip(120 + rng.normal(0, 20, (128, 128, 3)), 0, 255).astype(np.uint8)
    (tmp_path / "noise.png").write_bytes(png.encode(image))
    (tmp_path / "flat.png").write_bytes(png.encode(np.full((128, 128, 3), 90, np.uint8)))
    (tmp_path / "marked.bin").write_bytes(b"test-JUMB-marker-c2pa-openai")
    return str(tmp_path)


def test_case(spark, tmp_path):
    folder = planted(tmp_path)
    scores = spark.createDataFrame([("noise.png", "m", 0.9, "synthetic", True), ("flat.png", "m", 0.2, "real", False)], "file STRING, model STRING, score DOUBLE, label STRING, validated BOOLEAN")
    found = case.analyze_case(spark, folder, scores).cache()
    rows = {r.name: r for r in found.collect()}
    assert {n: r.status for n, r in rows.items()} == {"noise.png": "success", "flat.png": "success", "marked.bin": "unavailable"}
    assert rows["noise.png"].triage == "needs_expert_review" and "m" in rows["noise.png"].families
    assert rows["marked.bin"].marker_only and rows["marked.bin"].producer_hint == "openai" and rows["marked.bin"].families == []
    assert rows["marked.bin"].triage == "screening_observations_only"
    assert {r.evidentiary_conclusion for r in rows.values()} == {"inconclusive"}
    assert case.run_summary(found).first().files == 3
    assert [r.name for r in case.markdown(found).orderBy("place").collect()] == ["flat.png", "marked.bin", "noise.png"]
    expected = spark.createDataFrame([("noise.png", True), ("flat.png", False)], "case_id STRING, expected_synthetic BOOLEAN")
    outcome = {r.rule: r for r in case.convergence_benchmark(found, expected).collect()}
    assert outcome["protocol"].tp == 1 and outcome["protocol"].n == 2 and outcome["protocol"].sensitivity == 1.0


def test_case_with_kept_measures(spark, tmp_path):
    """A second run takes the measures of files that have not changed from the store, whatever is in the files now."""
    (tmp_path / "case").mkdir()
    folder, store = planted(tmp_path / "case"), str(tmp_path / "store")
    plain = {r.name: r for r in case.analyze_case(spark, folder).collect()}
    kept = {r.name: r for r in case.analyze_case(spark, folder, store=store).collect()}
    assert {n: r.asDict() for n, r in kept.items()} == {n: r.asDict() for n, r in plain.items()}
    file = tmp_path / "case" / "noise.png"
    state = file.stat()
    file.write_bytes(b"x" * state.st_size)
    os.utime(file, ns=(state.st_atime_ns, state.st_mtime_ns))
    again = {r.name: r for r in case.analyze_case(spark, folder, store=store).collect()}
    assert again["noise.png"].status == "success" and again["noise.png"].spectral_flags == plain["noise.png"].spectral_flags
    os.utime(file)
    assert {r.name: r.status for r in case.analyze_case(spark, folder, store=store).collect()} == {"noise.png": "unavailable", "flat.png": "success", "marked.bin": "unavailable"}


def test_rules_take_nulls(spark):
    names = ["frequency_peak_count", "frequency_high_low_ratio", "frequency_quadrant_cv", "sensor_global_sigma", "sensor_block_sigma_cv", "noise_map_block_sigma_cv", "resampling_persistence"]
    rows = [(0, *[None] * 7), (1, 4.0, 0.2, 0.001, 0.01, 0.8, 0.8, 0.95), (2, 0.0, 1.0, 0.5, 0.5, 0.1, 0.1, 0.95)]
    measured = spark.createDataFrame(rows, "id INT, " + ", ".join(f"{n} DOUBLE" for n in names))
    found = {r.id: r for r in protocol.triage(protocol.flags(measured)).collect()}
    assert found[0].triage == "no_strong_screening_signals" and found[0].convergence == "none"
    assert found[1].families == ["noise", "sensor_residual", "spectral"] and found[1].convergence == "moderate" and found[1].triage == "needs_expert_review"
    assert len(found[1].spectral_flags) == 3 and "synthetic_texture" in found[1].observations
    assert found[2].families == [] and found[2].triage == "screening_observations_only"


def frames_of(spark, shift=()):
    side, rows, rng = 16, [], np.random.default_rng(9)
    for i in range(72):
        frame = np.full((side, side), 60.0) + rng.uniform(0, 12, (side, side)) * rng.uniform(0.5, 1.5)
        frame[:, (i * 3) % side] = 200
        rows.append(("v", i, i / 24 + (1.0 if i >= 50 else 0.0), "I" if i % 12 == 0 else "P", frame.ravel().tolist()))
    rows = [(v, i, p, k, rows[20][4] if i in (21, 22) else f) for v, i, p, k, f in rows]
    rows = [(v, i, p, k, [255.0 - x for x in f] if i >= 40 else f) for v, i, p, k, f in rows]
    return spark.createDataFrame(rows + [("one", 0, None, None, [1.0])], "video STRING, idx BIGINT, pts DOUBLE, kind STRING, frame ARRAY<DOUBLE>")


def test_frame_screens(spark):
    frames = frames_of(spark)
    marks = temporal.transitions(frames)
    assert [r.idx for r in marks.filter("duplicate").orderBy("idx").collect()] == [21, 22]
    assert [r.idx for r in marks.filter("anomaly").collect()] == [40]
    rows = {r.video: r for r in temporal.summary(frames).collect()}
    assert rows["v"].gaps == [49] and rows["v"].key_frames == 6 and rows["v"].keyframes == [21, 22, 40]
    assert rows["v"].triage == "needs_expert_review" and rows["one"].transitions == 0 and rows["one"].triage == "no_strong_screening_signals"
    flows = spark.createDataFrame([("v", i, 9.0 if i == 5 else 1.0 + i % 3 / 10) for i in range(20)], "video STRING, idx BIGINT, flow DOUBLE")
    assert [r.idx for r in temporal.motion(flows).filter("discontinuity").collect()] == [5]


def test_artifacts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = artifacts.artifacts(media.image_pixels(spark, planted(tmp_path / "in")))
    artifacts.write_artifacts(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 14 and back.filter(F.hex(F.substring("content", 1, 4)) == "89504E47").count() == 14


def test_failing_kernel_is_recorded(spark, monkeypatch):
    def fail(rgb):
        if rgb.shape[0] == 3:
            raise ValueError("three rows")
        return {"x": 1.0}

    monkeypatch.setitem(images.COLOUR, "fragile", fail)
    rows = spark.createDataFrame([("a", 3, 1, 1, b"123"), ("b", 1, 1, 1, b"1")], "path STRING, height INT, width INT, channels INT, pixels BINARY")
    found = {r.path: (r.status, r.error, r.fragile_x) for r in images.measure(rows, ["fragile"]).collect()}
    assert found["a"][0] == "error" and "three rows" in found["a"][1] and found["b"] == ("success", None, 1.0)


def test_video_screen(spark):
    """Evenly sampled frames, their frequency ratio, and the variation that flags a video."""
    frames = spark.createDataFrame([("v", i) for i in range(100)] + [("w", i) for i in range(3)], "video STRING, idx BIGINT")
    taken = {}
    for r in temporal.sampled(frames).collect():
        taken.setdefault(r.video, set()).add(r.idx)
    assert taken == {"v": set(np.linspace(0, 99, 24).astype(int).tolist()), "w": {0, 1, 2}}
    flat, noisy = np.tile(np.linspace(0, 200, 64), (64, 1)), np.random.default_rng(1).uniform(0, 255, (64, 64))
    low, high = pixels.frequency_ratio(flat), pixels.frequency_ratio(np.kron(noisy, np.ones((8, 8))))
    assert 0 <= low < high
    rows = [("calm", 0.1, 5.0, 90.0), ("calm", 0.11, 5.5, 91.0), ("jumpy", 0.01, None, None), ("jumpy", 0.01, None, None), ("jumpy", 0.4, None, None), ("face", 0.1, 0.1, 1.0), ("face", 0.1, 0.1, 1.0), ("face", 0.1, 9.0, 1.0)]
    found = {r.video: r for r in temporal.video_screen(spark.createDataFrame(rows, "video STRING, ratio DOUBLE, sharpness DOUBLE, luminance DOUBLE")).collect()}
    assert (found["calm"].screening_flags, found["calm"].triage, found["calm"].frames_with_face) == ([], "no_strong_screening_signals", 2)
    assert (found["jumpy"].screening_flags, found["jumpy"].face_sharpness_cv) == (["large_sampled_frequency_variation"], None)
    assert (found["face"].screening_flags, found["face"].triage) == (["large_face_texture_sharpness_variation"], "needs_expert_review")
