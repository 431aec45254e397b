"""Row-local image rules against numpy."""

import math

import numpy as np

from prismspark.operators import planes

SCHEMA = "key INT, height INT, width INT, levels ARRAY<DOUBLE>"


def dct(n):
    return np.array([[math.sqrt((1 if u == 0 else 2) / n) * math.cos((2 * x + 1) * u * math.pi / (2 * n)) for x in range(n)] for u in range(n)])


def periodicity(image):
    h, w = (s - s % 8 for s in image.shape)
    d, q = dct(8), []
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            q.append((d @ (image[y : y + 8, x : x + 8] - 128.0) @ d.T)[1, 2])
    q = np.rint(np.round(q, 6)).astype(int)
    if q.size < 10:
        return 0.0, q.size, None
    lo, hi = np.percentile(q, [2, 98]).astype(int)
    hist, _ = np.histogram(q, bins=np.arange(lo, hi + 2))
    if len(hist) < 5:
        return 0.0, q.size, None
    z = float(np.mean(hist == 0))
    return min(1.0, 0.5 * z + 0.05 * (np.abs(np.diff(hist)).mean() / (hist.mean() + 1e-9))), q.size, z


def haar(image):
    x, out = image / 255.0, []
    for _ in range(3):
        h, w = (s - s % 2 for s in x.shape)
        if h < 4 or w < 4:
            break
        x = x[:h, :w]
        a, b, c, d = x[0::2, 0::2], x[0::2, 1::2], x[1::2, 0::2], x[1::2, 1::2]
        bands = [((a + s * b + t * c + u * d) * 0.5) for s, t, u in ((-1, 1, -1), (1, -1, -1), (-1, -1, 1))]
        out.append([float((v * v).mean()) for v in bands])
        x = (a + b + c + d) * 0.5
    return out


def glcm(image):
    q, props = np.clip((image / 256 * 16).astype(int), 0, 15), []
    for dy, dx in planes.GLCM_STEPS:
        p = np.zeros((16, 16))
        for i, j in zip(q[: q.shape[0] - dy, : q.shape[1] - dx].ravel(), q[dy:, dx:].ravel()):
            p[i, j] += 1
            p[j, i] += 1
        p /= p.sum()
        i, j = np.indices(p.shape)
        m = (p * i).sum()
        var = (p * (i - m) ** 2).sum()
        props.append([(p * (i - j) ** 2).sum(), (p * abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), math.sqrt((p * p).sum()), 1.0 if var < 1e-30 else (p * (i - m) * (j - m)).sum() / var])
    return np.mean(props, axis=0)


def area(image, n):
    for axis in (1, 0):
        fine = np.repeat(image, n, axis=axis)
        size = image.shape[axis]
        shape = (fine.shape[0], n, size) if axis else (n, size, fine.shape[1])
        image = fine.reshape(shape).mean(axis=2 if axis else 1)
    return image


def test_rules_like_numpy(spark):
    rng, images = np.random.default_rng(7), {}
    for k, (h, w) in enumerate([(48, 40), (33, 67), (8, 8), (3, 50), (64, 32), (90, 33), (17, 9)]):
        image = rng.integers(0, 256, (h, w)).astype(float)
        images[k] = np.round(image / (1 + 9 * (k % 3)))
        images[k] += 60 * (np.arange(h) % 7 == 0)[:, None] * (k % 2)
        images[k] = np.clip(images[k], 0, 255)
    images[7] = np.full((40, 40), 77.0)
    rows = [(k, *im.shape, im.ravel().tolist()) for k, im in images.items()] + [(100, 0, 0, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    args = (df.levels, df.height, df.width)
    found = df.select("key", planes.dct_periodicity(*args).alias("dct"), planes.haar_energies(*args).alias("haar"), planes.glcm(*args).alias("glcm"), planes.dct_hash(*args).alias("hash"), planes.profile_peak(planes.row_means(*args)).alias("peak"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" not in plan
    found = {r.key: r for r in found.collect()}
    for k, im in images.items():
        r = found[k]
        score, n, zero = periodicity(im)
        assert np.isclose(r.dct.score, score) and r.dct.n_blocks == n and (r.dct.zero_bin_fraction is None if zero is None else np.isclose(r.dct.zero_bin_fraction, zero))
        bands = haar(im)
        assert [x is not None for x in r.haar or [None] * 3] == [i < len(bands) for i in range(3)]
        assert all(np.allclose([x.lh, x.hl, x.hh], b) and np.isclose(x.hf_total, sum(b)) for x, b in zip(r.haar or [], bands))
        assert np.allclose(list(r.glcm), glcm(im))
        if min(im.shape) >= 32:
            d = dct(32)
            c = np.round(d @ np.rint(np.round(area(im, 32), 6)) @ d.T, 6)[:8, :8]
            bits = "".join("1" if b else "0" for b in (c >= np.median(c[1:])).ravel())
            assert r.hash == f"{int(bits, 2):016x}"
        else:
            assert r.hash is None
        z = im.mean(axis=1) - im.mean(axis=1).mean()
        n, peak = len(z), (0.0, 0)
        if n >= 8 and z @ z > 1e-12:
            corr = np.round(np.correlate(z, z, "full")[n - 1 :] / (z @ z), 9)
            start = max(2, n // 64)
            window = corr[start : max(start + 1, n // 2)]
            peak = (window.max(), start + int(window.argmax()))
        assert np.isclose(r.peak.peak, peak[0]) and r.peak.lag == peak[1]
    assert found[100].dct.n_blocks == 0 and found[100].glcm is None and found[100].hash is None and found[100].peak.lag == 0


def odd_pages(spark, folder):
    """One file of one row group with pages that are null, short, of one level, with code points over a byte, and long."""
    rng = np.random.default_rng(3)
    text = lambda n, low=32, high=127: "".join(chr(c) for c in rng.integers(low, high, n))
    html = [None, "", "x" * 31, "x" * 32, text(64), text(95), text(96), "a" * 4000, text(1023), text(1024), text(1060), "é\U0001f600ß" * 700, text(5000, 0x4E00, 0x9FFF), ("ab" * 16 + "yz" * 16) * 40, text(40000), "\n".join(text(50) for _ in range(300))]
    spark.createDataFrame(list(enumerate(html)), "page_id BIGINT, html STRING").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    levels = [[ord(c) % 256 for c in (h or "")[: len(h or "") // 32 * 32]] for h in html]
    return spark.createDataFrame([(k, len(v) // 32, 32, [float(x) for x in v]) for k, v in enumerate(levels)], SCHEMA)


def test_pages_like_the_rules_in_a_row(spark, tmp_path):
    from prismspark.plans import page_planes

    rows = odd_pages(spark, str(tmp_path))
    args = (rows.levels, rows.height, rows.width)
    found = rows.select("key", planes.dct_periodicity(*args).alias("dct"), planes.haar_energies(*args).alias("haar"), planes.glcm(*args).alias("glcm"), planes.dct_hash(*args).alias("hash"), planes.profile_peak(planes.row_means(*args)).alias("peak"))
    levels = lambda r: [list(x) if x else [None] * 4 for x in r.haar] if r.haar else [[None] * 4] * 3
    want = {
        "page_glcm": lambda r: list(r.glcm) if r.glcm else [None] * 5,
        "page_dct_hash": lambda r: [r.hash],
        "page_dct_periodicity": lambda r: [r.dct.n_blocks, r.dct.score, r.dct.zero_bin_fraction],
        "page_haar_levels": lambda r: sum(levels(r), []),
        "page_profile_peak": lambda r: [r.peak.peak, r.peak.lag],
    }
    found = found.collect()
    for name, of in want.items():
        query = page_planes.PLANES[name][1](spark, str(tmp_path))
        # Pages of one row group are many tasks' work, without a text split into characters.
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "hashpartitioning(page_id" in plan and "split(" not in plan
        mine = {r.page_id: list(r)[1:] for r in query.collect()}
        assert len(mine) == len(found)
        for r in found:
            for a, b in zip(mine[r.key], of(r), strict=True):
                assert a == b or (isinstance(b, float) and abs(a - b) < 1e-6), (name, r.key, a, b)
