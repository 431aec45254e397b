"""Regions of difference against a plain computation, pixel by pixel."""

import numpy as np

from prismspark.operators import regions

SCHEMA = "key long, height int, width int, channels int, pixels array<double>, reference_height int, reference_width int, reference_channels int, reference_pixels array<double>"


def plain(q, r):
    """Opening, closing and flood fill by loops."""
    d = np.abs(q - r).mean(axis=2)
    med = np.median(d)
    mad = np.median(np.abs(d - med))
    cut = max(12.0, med + 8 * 1.4826 * mad)
    mask = d >= cut

    def step(m, side, grow):
        half, out = side // 2, m.copy()
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                part = m[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
                out[y, x] = part.any() if grow else part.all()
        return out

    for side, order in ((3, (False, True)), (7, (True, False))):
        for grow in order:
            mask = step(mask, side, grow)
    seen, found = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, own = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
        if len(own) >= 50:
            ys, xs = np.array(own).T
            found.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, len(own), round(float(d[ys, xs].mean()), 9)))
    found.sort(key=lambda c: -c[4])
    return round(med, 9), round(mad, 9), round(cut, 9), round(float(mask.mean()), 9), found


def pair(rng, h, w, channels):
    r = rng.integers(0, 256, (h, w, channels)).astype(float)
    q = r + rng.normal(0, 1.2, r.shape).round(1)
    for _ in range(rng.integers(0, 9)):
        y, x, a, b = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 14), rng.integers(2, 14)
        q[y : y + a, x : x + b] += rng.choice([-60, 25, 90])
    for i in range(min(h, w)):  # a diagonal of blocks that touch by their corners
        if i % 8 < 4 and h > 40:
            q[i : i + 4, i : i + 4] += 100
    return q, r


def test_like_a_plain_computation(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for k, (h, w, c) in enumerate([(24, 31, 3), (48, 20, 1), (50, 50, 3), (9, 9, 1), (64, 64, 1), (1, 80, 1), (30, 1, 3)] * 2):
        q, r = pair(rng, h, w, c)
        rows.append((k, h, w, c, q.ravel().tolist(), h, w, c, r.ravel().tolist()))
        want[k] = plain(q, r)
    flat = [7.0] * 40
    rows += [(100, 5, 8, 1, flat, 8, 5, 1, flat), (101, 5, 8, 1, flat, None, None, None, None), (102, 5, 8, 1, None, 5, 8, 1, flat), (103, 5, 8, 1, flat[1:], 5, 8, 1, flat), (104, 5, 8, 1, [None, *flat[1:]], 5, 8, 1, flat), (105, 0, 0, 1, [], 0, 0, 1, []), (106, 5, 8, 1, flat, 5, 8, 1, flat)]
    found = {r.key: r for r in regions.differences(spark.createDataFrame(rows, SCHEMA), "key").collect()}
    assert len(found) == len(rows)
    for k, (med, mad, cut, changed, parts) in want.items():
        r = found[k]
        assert (r.status, round(r.median, 9), round(r.mad, 9), round(r.threshold, 9), round(r.changed_fraction, 9), r.component_count) == ("success", med, mad, cut, changed, len(parts))
        listed = [(c.x, c.y, c.w, c.h, c.area, round(c.mean_abs_difference, 9)) for c in r.components or []]
        assert listed == parts[:20] and [c.place for c in r.components or []] == list(range(1, len(listed) + 1))
    assert sum(len(w[-1]) for w in want.values()) > 8
    assert all(found[k].status == "not_comparable" and found[k].component_count is None for k in range(100, 106))
    assert (found[106].status, found[106].component_count, found[106].changed_fraction) == ("success", 0, 0.0)


def test_at_most_twenty_are_listed_and_long_shapes_are_one(spark):
    mask = np.zeros((120, 130))
    for k in range(25):
        mask[(k // 5) * 20 + 2 : (k // 5) * 20 + 10, (k % 5) * 20 + 2 : (k % 5) * 20 + 10 + k % 3] = 99
    snake = np.zeros((120, 130))
    for k in range(0, 120, 20):
        snake[k : k + 5, 5:125] = 99
        snake[k : k + 25, (120 if k % 40 == 0 else 5) : (125 if k % 40 == 0 else 10)] = 99
    zero = np.zeros((120, 130)).ravel().tolist()
    rows = [(k, 120, 130, 1, m.ravel().tolist(), 120, 130, 1, zero) for k, m in enumerate((mask, snake))]
    found = {r.key: r for r in regions.differences(spark.createDataFrame(rows, SCHEMA), "key").collect()}
    assert found[0].component_count == 25 and len(found[0].components) == 20
    areas = [c.area for c in found[0].components]
    assert areas == sorted(areas, reverse=True) and found[1].component_count == 1
    assert regions.differences(spark.createDataFrame([], SCHEMA), "key").collect() == []


def test_bytes(spark):
    df = spark.createDataFrame([(bytearray([0, 127, 128, 255]),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in df.select(regions.from_bytes(df.b)).collect()] == [[0.0, 127.0, 128.0, 255.0], [], None]


def test_no_table_of_a_round_passes_through_the_driver(spark):
    """Small tables on disk stay shuffled as well, in every round."""
    plans, write = [], regions.written

    def spied(df, label):
        out = write(df, label)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    mask = np.zeros((40, 40))
    mask[5:20, 5:30] = 99
    flat = np.zeros((40, 40)).ravel().tolist()
    rows = [(k, 40, 40, 1, mask.ravel().tolist(), 40, 40, 1, flat) for k in range(3)]
    regions.written = spied
    try:
        found = regions.differences(spark.createDataFrame(rows, SCHEMA), "key")
        assert [r.component_count for r in found.collect()] == [1, 1, 1]
    finally:
        regions.written = write
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("Broadcast" in plan for plan in plans) and sum("SortMergeJoin" in plan for plan in plans) > 2
