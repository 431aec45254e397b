"""Sources, order-dependent joins, provenance, training and streams against plain versions."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismspark.operators import matching, provenance, training
from prismspark.plans.applied import APPLIED
from prismspark.sources import media
from prismspark.streaming import temporal

SF = "/root/testdata/sf0.001"


def test_manifests(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("path,label,split\na.png,Fake,val\n/x/b.png,0,\n")
    rows = media.manifest(spark, str(path), "/base").orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("/base/a.png", 1, "unknown", "validation", "original"), ("/x/b.png", 0, "unknown", "test", "original")]
    listing = spark.createDataFrame([("file:/base/a.png",)], "path STRING")
    assert [r.path for r in media.missing_paths(media.manifest(spark, str(path), "/base"), listing).collect()] == ["/x/b.png"]
    path.write_text("path,label\na.png,perhaps\n")
    with pytest.raises(Exception, match="bad label"):
        media.manifest(spark, str(path), "/base").collect()
    path.write_text("path\na.png\n")
    with pytest.raises(ValueError, match="label"):
        media.manifest(spark, str(path), "/base")
    path.write_text("path,expected_synthetic\nd/a.png,yes\nb.png,non-synthetic\n")
    rows = media.convergence_manifest(spark, str(path), "/base").orderBy("path").collect()
    assert [(r.case_id, r.expected_synthetic) for r in rows] == [("b.png", False), ("a.png", True)]


def test_json_sources(spark, tmp_path):
    truth = {"images": {"a.jpg": {"label": "synthetic"}, "b.jpg": {"label": "pristine", "method": None}}, "videos": {"v.mp4": {"label": "manipulated", "method": "synthetic_x"}}}
    (tmp_path / "t.json").write_text(json.dumps(truth))
    assert {r.name: r.synthetic for r in media.ground_truth(spark, str(tmp_path / "t.json")).collect()} == {"a.jpg": True, "b.jpg": False, "v.mp4": True}
    scores = {"files": {"a.jpg": [{"model": "m", "score": 0.9, "validated": True}, {"name": "n", "score": None, "validated": True}]}}
    (tmp_path / "s.json").write_text(json.dumps(scores))
    assert {r.model: r.usable for r in media.external_scores(spark, str(tmp_path / "s.json")).collect()} == {"m": True, "n": False}
    (tmp_path / "bad.json").write_text("{nonsense")
    assert media.external_scores(spark, str(tmp_path / "bad.json")).count() == 0
    texts = spark.createDataFrame([("a", '[{"name":"m","score":1}]'), ("b", '{"models":[{"name":"n","validated":true}, 3]}'), ("c", None), ("d", "x")], "file STRING, content STRING")
    assert {(r.file, r.name, r.validated) for r in media.model_exports(texts).collect()} == {("a", "m", False), ("b", "n", True)}


def test_sinks(spark, tmp_path):
    rows = spark.range(20).withColumn("f", F.lit(None).cast("double"))
    media.write_reports(rows, str(tmp_path / "r"))
    assert '"f":null' in spark.read.text(str(tmp_path / "r")).first().value
    media.write_shards(rows, str(tmp_path / "s"), 3, "id")
    assert media.read_shards(spark, str(tmp_path / "s")).count() == 20


def test_alignment_is_greedy_and_monotone(spark):
    frames = [[float(v), float(v * v % 7)] for v in range(12)]
    kept = [f for i, f in enumerate(frames) if i not in (4, 5)]
    schema = "video STRING, idx BIGINT, frame ARRAY<DOUBLE>"
    q = spark.createDataFrame([("a", i, f) for i, f in enumerate(kept)] + [("long", i, f) for i, f in enumerate(frames)], schema)
    r = spark.createDataFrame([("a", i, f) for i, f in enumerate(frames)] + [("long", 0, frames[0]), ("alone", 0, frames[0])], schema)
    found = matching.align(q, r, "video").collect()
    a = sorted((x.idx, x.matched, x.skipped) for x in found if x.video == "a")
    assert [m for _, m, _ in a] == [0, 1, 2, 3, 6, 7, 8, 9, 10, 11] and [i for i, _, s in a if s] == [4] and a[4][2] == 2
    assert {x.video: x.status for x in found if x.video != "a"} == {"long": "not_comparable", "alone": "error"}
    assert {x.video: x.reason for x in found} == {"a": None, "long": "questioned_longer_than_reference", "alone": "could_not_decode_video"}


def test_alignment_like_a_plain_loop(spark):
    """Ties go to the first; the fold stops when no reference frame is left."""
    rng, rows_q, rows_r, want = np.random.default_rng(3), [], [], set()
    for k in range(30):
        n = int(rng.integers(1, 9))
        r = rng.integers(0, 3, (n, 2)).astype(float)
        q = rng.integers(0, 3, (int(rng.integers(1, n + 1)), 2)).astype(float)
        rows_q += [(k, i, f.tolist()) for i, f in enumerate(q)]
        rows_r += [(k, i * 2, f.tolist()) for i, f in enumerate(r)] + [(k, 99, None)]
        last = -1
        for i, f in enumerate(q):
            if last + 1 >= n:
                break
            d = np.abs(r[last + 1 :] - f).mean(axis=1)
            j = last + 1 + int(d.argmin())
            want.add((k, i, j, float(d.min()), j - last - 1 if i else 0))
            last = j
    schema = "video BIGINT, idx BIGINT, frame ARRAY<DOUBLE>"
    found = matching.align(spark.createDataFrame(rows_q, schema), spark.createDataFrame(rows_r, schema), "video")
    assert {(r.video, r.idx, r.matched, r.distance, r.skipped) for r in found.collect()} == want and "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_copy_move_finds_the_planted_translation(spark):
    rng = np.random.default_rng(5)
    words = rng.integers(-(2**63), 2**63 - 1, (60, 4))
    rows = [("i", k, float(rng.uniform(0, 200)), float(rng.uniform(0, 200)), [int(v) for v in words[k]]) for k in range(60)]
    rows += [("i", 100 + k, rows[k][2] + 230, rows[k][3] + 240, rows[k][4]) for k in range(20)] + [("j", 0, 1.0, 1.0, None)]
    points = spark.createDataFrame(rows, "image STRING, kp BIGINT, x DOUBLE, y DOUBLE, words ARRAY<BIGINT>")
    best = matching.copy_move(points, "image").filter("place = 1").collect()
    assert len(best) == 1 and best[0].suspicious and best[0].n == 20 and abs(best[0].dx - 230) < 8 and abs(best[0].dy - 240) < 8


def plain_pairs(words, x, y):
    """One keypoint after the other, all distances."""
    taken, found = set(), []
    for a in range(len(words)):
        distance = np.bitwise_count(words[a] ^ words).sum(axis=1)
        for b in map(int, np.argsort(distance, kind="stable")[:5]):
            pair, dx, dy = (min(a, b), max(a, b)), x[b] - x[a], y[b] - y[a]
            if a == b or pair in taken or distance[b] > 55 or np.hypot(dx, dy) < 40:
                continue
            taken.add(pair)
            found.append((a, b, int(distance[b]), *((-dx, -dy) if dx < 0 or (dx == 0 and dy < 0) else (dx, dy))))
            break
    return found


def test_pairs_of_keypoints_like_a_plain_loop(spark):
    """Images of several blocks, copies, equal distances and equal places."""
    rng, rows, want = np.random.default_rng(12), [], []
    for image, n in enumerate((300, 40, 3, 1)):
        words = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        for _ in range(2 * n):
            a, b = rng.integers(0, n, 2)
            flips = np.zeros(4, np.uint64)
            for bit in rng.integers(0, 256, rng.integers(0, 60)):
                flips[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
            words[b] = words[a] ^ flips
        x, y = rng.integers(0, 120, n).astype(float), rng.integers(0, 120, n).astype(float)
        rows += [(image, 2 * k, float(x[k]), float(y[k]), [int(v) for v in words[k].view(np.int64)]) for k in range(n)] + [(image, 999, None, 1.0, [1, 2, 3, 4])]
        want += [(image, *p) for p in plain_pairs(words, x, y)]
    points = spark.createDataFrame(rows, "image INT, kp BIGINT, x DOUBLE, y DOUBLE, words ARRAY<BIGINT>")
    pairs = matching.pairs_of(matching.neighbours(points, "image", block=64), "image")
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(want) and len(want) > 100
    assert "Python" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_small_images_are_compared_inside_their_row(spark):
    """Rows as by blocks for images on both sides of the bound; without a large one keypoints are shuffled once, not joined."""
    rng, rows = np.random.default_rng(13), []
    for image, n in enumerate((90, 64, 65, 7, 2, 1)):
        words = rng.integers(-(2**62), 2**62, (6, 4))
        rows += [(image, int(k), float(rng.integers(0, 300)), float(rng.integers(0, 300)), [int(v) for v in words[rng.integers(0, 6)]]) for k in rng.integers(0, 60, n)]
    rows += [(None, 1, 1.0, 1.0, [1]), (9, 1, None, 1.0, [1])]
    points = spark.createDataFrame(rows, "image INT, kp BIGINT, x DOUBLE, y DOUBLE, words ARRAY<BIGINT>")
    want = sorted(map(tuple, matching.translations(matching.pairs_of(matching.neighbours(points, "image"), "image"), "image").collect()))
    for block in (64, 512):
        found = matching.copy_move(points, "image", block=block)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 20
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan


def test_scores_of_translations(spark):
    clusters = spark.createDataFrame([("i", 12, 5.0, 6.0, True, 1), ("i", 11, 7.0, 8.0, True, 2), ("i", 30, 1.0, 1.0, False, 3), ("j", 12, 2.0, 3.0, True, 1), ("k", 5, 0.0, 1.0, False, 1)], "image STRING, n BIGINT, dx DOUBLE, dy DOUBLE, suspicious BOOLEAN, place INT")
    found = {r.image: tuple(r)[1:] for r in matching.copy_move_scores(clusters, "image").collect()}
    assert found == {"i": (23, 2, 1.0, 5.0, 6.0), "j": (12, 1, 0.6, 2.0, 3.0), "k": (0, 0, 0.0, None, None)}


def test_validation_rows(spark):
    tree = {"activeManifest": {"success": [{"code": "a", "url": "u"}], "failure": [{"code": "b"}], "other": [{"code": "c", "success": False}, {"code": "d"}]}}
    docs = spark.createDataFrame([("f", json.dumps(tree)), ("g", "{"), ("h", None)], "file STRING, tree STRING")
    rows = provenance.validation_rows(docs, "tree", "file")
    assert [(r.scope, r.kind, r.code) for r in rows.orderBy("place").collect()] == [
        ("activeManifest.success", "success", "a"), ("activeManifest.failure", "failure", "b"), ("activeManifest.other", "failure", "c"), ("activeManifest.other", "status", "d")]
    stores = spark.createDataFrame([("f", "m", "Valid"), ("k", "m", "Trusted"), ("l", None, "valid")], "file STRING, active STRING, state STRING")
    found = {r.file: r for r in provenance.summary(stores, rows, "file").collect()}
    assert {f: (r.status, r.trust_status, r.integrity_validated) for f, r in found.items()} == {"f": ("invalid", "valid_but_not_trusted", False), "k": ("validated", "trusted", True), "l": ("no_active_manifest", "valid_but_not_trusted", False)}
    assert (found["f"].success_codes, found["f"].failure_codes, found["f"].status_codes) == (["a"], ["b", "c"], ["a", "b", "c", "d"])
    assert found["f"].reason == "validation_state=Valid; trust_status=valid_but_not_trusted; failures=b,c" and found["l"].reason == "no_active_manifest"


def test_provenance_lists_are_cut_and_signatures_count(spark):
    tree = {"success": [{"code": "claimSignature.validated"}, {"code": "assertion.dataHash.match"}] + [{"code": f"s{i}"} for i in range(120)]}
    rows = provenance.validation_rows(spark.createDataFrame([("s", json.dumps(tree))], "file STRING, tree STRING"), "tree", "file")
    stores = spark.createDataFrame([("s", "m", None), ("i", "m", "Invalid"), ("n", "m", None)], "file STRING, active STRING, state STRING")
    found = {r.file: r for r in provenance.summary(stores, rows, "file").collect()}
    assert (found["s"].status, found["s"].trust_status, found["s"].successes, len(found["s"].success_codes), len(found["s"].status_codes)) == ("validated", "not_established", 122, 50, 100)
    assert found["s"].signature_validated and found["s"].data_hash_validated and found["i"].status == "invalid" and found["n"].status == "manifest_present_unverified"


def test_active_manifest_and_fallback(spark):
    store = {"active_manifest": "b", "validation_state": "Valid", "manifests": {"a": {"claim_generator": "x"}, "b": {"claim_generator": "y", "validation_state": "ValidationState.Trusted", "assertions": [{"label": "l1"}, {"kind": 2}]}}}
    rows = [("one", json.dumps(store)), ("two", json.dumps(store | {"active_manifest": "zz"})), ("none", "{}"), ("bad", "{"), ("null", None)]
    found = {r.file: r for r in provenance.stores(spark.createDataFrame(rows, "file STRING, tree STRING"), "tree", "file").collect()}
    assert (found["one"].active, found["one"].state, found["one"].producer, found["one"].labels) == ("b", "trusted", "y", ["l1"])
    assert (found["two"].active, found["two"].state, found["two"].producer) == ("zz", "valid", None) and all(found[k].active is None for k in ("none", "bad", "null"))
    markers = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", None)], "file STRING, marker BOOLEAN")
    attempts = spark.createDataFrame([("a", "library", "{}", None), ("b", "library", None, "library: broken"), ("b", "command", None, "command: code 2"), ("c", "library", None, "library: broken"), ("c", "command", "{}", None)], "file STRING, tool STRING, store STRING, error STRING")
    assert {r.file: (r.tool, r.status, r.reason) for r in provenance.inspected(markers, attempts, "file").collect()} == {
        "a": ("library", "inspected", None), "b": ("marker_scan", "marker_only", "command: code 2"), "c": ("command", "inspected", None), "d": ("marker_scan", "unavailable", "validator_not_available")}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, y, ("train", "validation", "test")[i // 2 % 3], "real" if not y else "gen" + str(i // 2 % 2), float(rng.normal(2 * y, 0.7)), float(rng.normal(0, 1)) if i % 9 else None))
    return spark.createDataFrame(rows, "id BIGINT, label INT, split STRING, generator STRING, a DOUBLE, b DOUBLE").coalesce(2)


def test_folds_hold_as_many_rows_of_a_class(spark):
    rows = spark.range(5003).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS label", "'x' AS order")
    found = training.stratified(rows, "id", 5).groupBy("label", "stratum_fold").count().collect()
    assert {(r.label, r.stratum_fold) for r in found} == {(v, k) for v in (0, 1) for k in range(5)}
    for v, n in ((1, 501), (0, 4502)):
        sizes = [r["count"] for r in found if r.label == v]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    again = training.stratified(rows.repartition(7), "id", 5)
    assert again.exceptAll(training.stratified(rows, "id", 5)).count() == 0 and again.columns == ["id", "label", "order", "stratum_fold"]


def test_candidates_learn(labelled):
    found = training.benchmark(labelled, ["a", "b"], "id", trees=10).collect()
    assert {r.model for r in found} == set(training.NAMES) and sum(r.chosen for r in found) == 1
    assert all(r.balanced_accuracy > 0.8 and r.n == 100 and not r.validated for r in found)


def test_calibration_and_held_out_generators(labelled):
    model = training.fit(labelled.filter("split = 'train'"), ["a", "b"], "logistic", "id", calibrate=True, folds=3)
    assert training.metrics(model.score(labelled.filter("split = 'test'"))).first().brier < 0.12
    with pytest.raises(ValueError, match="missing"):
        model.score(labelled.drop("b"))
    held = training.leave_one_generator_out(labelled, ["a", "b"], "id", "logistic").collect()
    assert [r.held for r in held] == ["gen0", "gen1"]
    with pytest.raises(ValueError, match="class"):
        training.fit(labelled.filter("label = 1"), ["a"], "logistic", "id")
    assert training.leave_one_generator_out(labelled.filter("label = 0"), ["a"], "id", "logistic").count() == 0


def test_stream_screen_matches_a_plain_pass(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    plain = {}
    for user, group in events.groupby("user_id"):
        changes, gaps, before = [], [], None
        for row in group.itertuples():
            marks = (False, False)
            if before is not None:
                change, gap = abs(row.value - before.value), (row.ts - before.ts).total_seconds()
                if len(changes) >= 3:
                    m = np.median(changes)
                    marks = (change >= max(0.01, m + 8 * 1.4826 * np.median(np.abs(np.array(changes) - m))), gap > 1.8 * sorted(gaps)[len(gaps) // 2] > 0)
                changes, gaps = (changes + [change])[-256:], (gaps + [gap])[-256:]
            plain[row.event_id] = marks
            before = row
    found = APPLIED["streaming_screen"][1](spark, SF).collect()
    assert {r.id: (r.anomaly, r.timing_gap) for r in found} == plain


def test_stream_windows_match_the_batch(spark):
    found = APPLIED["streaming_windows"][1](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    whole = events.groupBy(F.col("user_id").cast("string").alias("series"), F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count()
    assert found.select("series", "start", "n").exceptAll(whole.select("series", "w.start", "count")).count() == 0
    assert found.count() == whole.count()


def test_late_frames_are_marked():
    state = [None, None, [], []]
    assert temporal.judge(10.0, 1.0, state)[0] is None
    assert temporal.judge(11.0, 1.0, state)[2]
    assert temporal.judge(5.0, 9.0, state)[4] and state[:2] == [11.0, 1.0]


@pytest.mark.parametrize("name", ["image_measures", "image_hashes", "sequence_alignment", "copy_move", "validation_flatten"])
def test_applied_queries_give_rows(spark, name):
    assert isinstance(APPLIED[name][1](spark, SF).toPandas(), pd.DataFrame)


def test_candidates_are_whole(spark):
    from prismspark.plans import applied

    assert not hasattr(applied, "TREES") and training.estimator("boosting", 300, 10).getMaxIter() == 100


def test_areas(spark):
    """ROC area against all pairs, average precision against its steps; ties, groups and a group of one class."""
    rows = [("a", k * 7 % 5 % 2, k * 13 % 11 / 11) for k in range(60)] + [(None, k % 2, 0.5 + k / 90000) for k in range(40)] + [("one", 1, 0.3)]
    got = {r.g: r for r in training.metrics(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    for g in ("a", None):
        own = [(y, s) for h, y, s in rows if h == g]
        p, n = [s for y, s in own if y], [s for y, s in own if not y]
        roc = sum((x > z) + (x == z) / 2 for x in p for z in n) / len(p) / len(n)
        pr = sum(sum(x >= s for x in p) / sum(x >= s for _, x in own) for s in p) / len(p)
        assert abs(got[g].roc_auc - roc) < 1e-12 and abs(got[g].pr_auc - pr) < 1e-12
    assert got["one"].roc_auc is None and got["one"].pr_auc is None and got["one"].tp == 0
