"""Kernels against plain versions and planted changes; maps over decoded files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.functions import jpeg, pixels, png
from prismspark.operators import images
from prismspark.sources import media


def textured(side=256, seed=3):
    rng = np.random.default_rng(seed)
    wave = 90 + 40 * np.sin(np.arange(side)[:, None] / 9) + 30 * np.cos(np.arange(side)[None, :] / 7)
    return np.clip(wave[:, :, None] + rng.normal(0, 6, (side, side, 3)), 0, 255).astype(np.uint8)


def test_feature_bank_has_all_names_at_any_size():
    assert len(pixels.FEATURES) == 73
    assert sum(n.startswith("autogan_") for n in pixels.FEATURES) == 25
    for shape in ((1, 1), (1, 9), (7, 5), (40, 33)):
        bank = pixels.feature_bank(np.zeros((*shape, 3), np.uint8))
        assert sorted(bank) == pixels.FEATURES and all(math.isfinite(v) for v in bank.values())


def test_resize_averages_areas():
    plane = np.arange(36, dtype=float).reshape(6, 6)
    assert np.allclose(pixels.resize(plane, 3, 3), plane.reshape(3, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(pixels.cubic_weights(5, 12).sum(axis=1), 1)


def test_dct_is_orthonormal_and_bands_partition():
    assert np.allclose(pixels.dct_matrix(8) @ pixels.dct_matrix(8).T, np.eye(8))
    masks = pixels.band_masks(224)
    assert (sum(masks[m].astype(int) for m in ("low", "mid", "high")) == 1).all()
    assert masks["low"].sum() == 120 * 120


def test_autocorrelation_matches_sums():
    v = np.random.default_rng(1).normal(size=50)
    z = v - v.mean()
    plain = [sum(z[i] * z[i + k] for i in range(50 - k)) / (z * z).sum() for k in range(10)]
    assert np.allclose(pixels.autocorrelation(v)[:10], plain)


def test_cooccurrence_matches_counting():
    level = np.random.default_rng(2).integers(0, 16, (12, 11))
    contrast = []
    for d in (1, 2):
        for dy, dx in ((0, d), (round(d * math.sqrt(0.5)), round(d * math.sqrt(0.5))), (d, 0)):
            contrast.append(np.mean([(level[y, x] - level[y + dy, x + dx]) ** 2 for y in range(12 - dy) for x in range(11 - dx)]))
    assert pixels.cooccurrence(level)["glcm_contrast"] == pytest.approx(np.mean(contrast))


def test_haar_first_level():
    gray = np.random.default_rng(4).integers(0, 256, (8, 8)).astype(float)
    a, b, c, d = (gray[y::2, x::2] / 255 for y in (0, 1) for x in (0, 1))
    found = pixels.haar_energies(gray)
    assert found["wavelet_l1_lh_energy"] == pytest.approx((((a - b + c - d) / 2) ** 2).mean())
    assert found["wavelet_l1_hl_energy"] == pytest.approx((((a + b - c - d) / 2) ** 2).mean())
    assert found["wavelet_l1_hh_energy"] == pytest.approx((((a - b - c + d) / 2) ** 2).mean())


def test_recompression_errs_less_at_higher_quality_and_finds_the_earlier_one():
    image = textured()
    errors = [row["error"] for row in jpeg.ghost_sweep(image)]
    assert errors[0] > errors[-1]
    sweep = jpeg.ghost_sweep(jpeg.recompress(image, 75))
    assert sweep[4]["quality"] == 75 and sweep[4]["error"] < min(sweep[3]["error"], sweep[5]["error"])


def test_double_coding_raises_dct_periodicity():
    image = textured()
    once = pixels.dct_periodicity(pixels.luminance(image))["dct_score"]
    twice = pixels.dct_periodicity(pixels.luminance(jpeg.recompress(jpeg.recompress(image, 50), 92)))["dct_score"]
    assert twice > once + 0.05


def test_reference_difference_finds_the_planted_patch():
    base = textured()
    changed = base.copy()
    changed[60:100, 30:80] = 255 - changed[60:100, 30:80]
    found = pixels.reference_difference(changed, base)
    box = found["components"][0]
    inter = max(0, min(box["x"] + box["w"], 80) - max(box["x"], 30)) * max(0, min(box["y"] + box["h"], 100) - max(box["y"], 60))
    assert inter / (box["w"] * box["h"] + 2000 - inter) >= 0.75
    assert pixels.reference_difference(base, base[:10])["status"] == "not_comparable"


def test_regions_join_diagonals():
    mask = np.array([[1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    labels, count = pixels.regions(mask)
    assert count == 3 and labels[0, 0] == labels[1, 1] == labels[0, 3]


def test_images_from_files(spark, tmp_path):
    image = textured(64)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    scanned = media.image_pixels(spark, str(tmp_path))
    row = scanned.first()
    assert (images.to_rgb(row.height, row.width, row.channels, row.pixels) == image).all()
    measured = images.measure(scanned, ["histogram", "resampling"]).collect()
    assert len(measured) == 1 and measured[0]["histogram_r_mean"] == pytest.approx(image[:, :, 0].mean())
    files = media.case_files(spark, str(tmp_path))
    assert {r.name: r.medium for r in files.collect()} == {"a.png": "image", "b.png": "image"}
    assert images.quantisation(files).select("status").distinct().collect()[0].status == "unavailable"
    other = scanned.withColumn("path", F.lit("p"))
    pairs = other.join(other.select("path", *[F.col(c).alias("ref_" + c) for c in ("height", "width", "channels", "pixels")]), "path")
    assert images.differences(pairs).first().component_count == 0
    boxes = spark.createDataFrame([(row.path, 0, 10, 10, 30, 30), (row.path, 1, 90, 90, 5, 5)], "path STRING, face INT, x INT, y INT, w INT, h INT")
    found = {r.face: r for r in images.faces(scanned, boxes).collect()}
    assert found[0].sharpness > 0 and found[1].flags == []


def test_unreadable_and_empty_images(spark):
    schema = "path STRING, height INT, width INT, channels INT, pixels BINARY"
    rows = spark.createDataFrame([("a", 2, 2, 1, b"1234"), ("b", 2, 2, 3, b"12"), ("c", None, None, None, None)], schema)
    found = {r.path: r for r in images.measure(rows, ["lsb", "resampling"]).collect()}
    assert [found[k].status for k in "abc"] == ["success", "unreadable", "unreadable"]
    assert found["a"].resampling_persistence is None and found["b"].lsb_r_p1 is None
    assert images.measure(rows.limit(0), ["lsb"]).count() == 0
    assert images.hashes(rows).count() == 1
    assert images.ghosts(rows).first().best_quality in jpeg.SWEEP


def test_quantisation_tables_are_read():
    table = bytes(range(1, 65))
    content = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xdb\x00\x43\x01" + table + b"\xff\xda"
    assert jpeg.quantisation_tables(content) == [{"table_id": 1, "values": list(table)}]
    assert jpeg.quantisation_tables(b"\x89PNG") is None and jpeg.quantisation_tables(None) is None
    assert jpeg.quantisation_tables(b"\xff\xd8\xff\xdb\x00\x10\x00") == []


def test_chi2_survival():
    assert pixels.chi2_survival(3.841458820694124) == pytest.approx(0.05)


def test_few_lines_stand_for_an_enlarged_image():
    """Texture counted on the lines that differ, against the whole image; equal channels have one spectrum."""
    rng = np.random.default_rng(8)
    for shape in ((8, 8), (1, 9), (100, 64), (300, 17)):
        gray = rng.integers(0, 256, shape).astype(float)
        whole = np.rint(pixels.resize(gray, 256, 256))
        few, _, counts = pixels.shrunk(gray, 256, 256)
        by_cell, *kept = pixels.shrunk(gray, 256, 16)
        assert all(n.sum() == 256 for n in counts + kept[1]) and (shape != (8, 8) or (few.size, by_cell.size) == (32 * 32, 64 * 64))
        level = lambda plane: np.clip(plane / 16, 0, 15).astype(int)
        for mine, plain in ((pixels.cooccurrence(level(few), counts=counts), pixels.cooccurrence(level(whole))), (pixels.uniform_patterns(few, counts), pixels.uniform_patterns(whole)), (pixels.gradient_blocks(by_cell, kept=kept), pixels.gradient_blocks(whole))):
            assert mine.keys() == plain.keys() and np.allclose(list(mine.values()), list(plain.values()), rtol=1e-12, atol=1e-12)
    grey = rng.integers(0, 256, (8, 8, 1), np.uint8).repeat(3, axis=2)
    tensor = pixels.upsampling_tensor(grey)
    assert tensor.shape == (3, 224, 224) and tensor.strides[0] == 0
    plane = np.rint(pixels.resize(grey[:, :, 0].astype(float), 256, 256, pixels.cubic_weights))[16:240, 16:240] / 255
    log = np.log(np.abs(np.fft.fft2(plane)) + 1e-3)
    low, high = np.percentile(log, [5, 95])
    assert np.allclose(tensor[0], np.clip((log - low) / (high - low) * 2 - 1, -1, 1))
    values = rng.normal(size=1001)
    assert all(np.isclose(pixels.quantile(values, p), np.percentile(values, p)) for p in (0, 5, 33.3, 95, 100))
