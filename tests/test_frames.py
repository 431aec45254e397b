"""Raw frames: ranges of one file, odd formats, files that cannot be read."""

import numpy as np

from prismspark.operators import temporal
from prismspark.sources import frames


def y4m(images, space="420jpeg", mark=b"FRAME\n", deep=False):
    h, w = images[0].shape
    head = f"YUV4MPEG2 W{w} H{h} F25:1 Ip A1:1 C{space}\n".encode()
    n = frames.layout(head).frame_bytes
    body = [(im.astype("<u2") if deep else im.astype(np.uint8)).tobytes() for im in images]
    return head + b"".join(mark + b + bytes(n - len(b)) for b in body)


def area(image, n):
    h, w = image.shape
    return image.reshape(n, h // n, n, w // n).mean(axis=(1, 3)).ravel().tolist()


def test_frames_of_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, (16, 32)) for _ in range(23)]
    (tmp_path / "plain.y4m").write_bytes(y4m(images))
    (tmp_path / "marked.y4m").write_bytes(y4m(images, mark=b"FRAME Ixyz\n"))
    (tmp_path / "deep.y4m").write_bytes(y4m([im * 4 for im in images], "444p10", deep=True))
    (tmp_path / "mono.y4m").write_bytes(y4m(images, "mono"))
    (tmp_path / "cut.y4m").write_bytes(y4m(images)[:-10])
    (tmp_path / "none.y4m").write_bytes(y4m(images[:1])[:-(6 + 16 * 32 * 3 // 2)])
    (tmp_path / "bad.y4m").write_bytes(b"RIFF....")
    (tmp_path / "other.txt").write_bytes(b"x")
    df = frames.frames(spark, str(tmp_path), size="8x8", frames="5")
    assert df.rdd.getNumPartitions() > 20
    found = {}
    for r in df.collect():
        found.setdefault(r.video.rpartition("/")[2], []).append(r)
    assert set(found) == {"plain.y4m", "marked.y4m", "deep.y4m", "mono.y4m", "cut.y4m", "none.y4m", "bad.y4m"}
    for name in ("plain.y4m", "marked.y4m", "deep.y4m", "mono.y4m"):
        rows = sorted(found[name], key=lambda r: r.idx)
        assert [r.idx for r in rows] == list(range(23)) and all((r.height, r.width, r.status) == (16, 32, "success") for r in rows)
        assert rows[7].pts == 7 / 25 and all(np.allclose(r.frame, area(im, 8)) for r, im in zip(rows, images))
    cut = sorted(found["cut.y4m"], key=lambda r: r.idx)
    assert [r.status for r in cut] == ["success"] * 22 + ["unreadable"] and "cut off" in cut[-1].error
    assert [(r.status, r.frame) for r in found["none.y4m"]] == [("empty", None)] and [r.status for r in found["bad.y4m"]] == ["unreadable"]
    one = frames.frames(spark, str(tmp_path / "mono.y4m"), size="none").filter("idx = 3").first()
    assert one.frame == images[3].ravel().astype(float).tolist()


def test_area_means_of_uneven_sizes():
    image = np.arange(35.0).reshape(5, 7)
    small = np.array(frames.averaged(image, (3, 2))).reshape(2, 3)
    fine = np.kron(image, np.ones((6, 6)))
    assert np.allclose(small, fine.reshape(2, 15, 3, 14).mean(axis=(1, 3))) and np.allclose(frames.averaged(image, (7, 5)), image.ravel())
    assert np.allclose(np.array(frames.averaged(np.full((3, 3), 9.0), (8, 8))), 9.0)


def test_pgm_sequences_feed_the_screens(spark, tmp_path):
    (tmp_path / "clip").mkdir()
    rng = np.random.default_rng(2)
    for k in range(12):
        image = np.full((10, 10), 60) + rng.integers(0, 9, (10, 10)) + (120 if k >= 8 else 0)
        (tmp_path / "clip" / f"{k:03}.pgm").write_bytes(b"P5\n# made here\n10 10\n255\n" + image.astype(np.uint8).tobytes())
    (tmp_path / "clip" / "004.pgm").write_bytes(b"P2 1 1 1 1")
    (tmp_path / "clip" / "005.pgm").write_bytes(b"P5 10 10 65535\n" + (np.full(100, 65535)).astype(">u2").tobytes())
    df = frames.frames(spark, str(tmp_path), size="5x5", frames="4")
    rows = sorted(df.collect(), key=lambda r: r.idx)
    assert [r.status for r in rows] == ["success"] * 4 + ["unreadable"] + ["success"] * 7 and rows[5].frame == [255.0] * 25
    assert {r.video.rpartition("/")[2] for r in rows} == {"clip"} and rows[0].pts is None
    screened = temporal.transitions(df.filter("status = 'success'").select("video", "idx", "frame"))
    assert screened.count() > 0
