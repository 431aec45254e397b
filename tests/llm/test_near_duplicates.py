"""Near-duplicates against brute force: crowded regions, forced slices and descents, sets of every size, edge rows."""

import numpy as np
import pytest

from prismspark.llm import components, near_duplicates
from prismspark.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, digest string, component string, tree int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operator uses itself."""
    prepare(spark)
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "d", "c", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def roots(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    found = {n: r for r, n in components.forest(pairs)}
    return [found.get(i, i) for i in range(len(texts))]


def check(spark, texts, percent=85, **forced):
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs(spark, texts), percent=percent, **forced).collect()}
    expected = roots(texts, percent)
    for i, t in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingle_set(t)), expected[i], expected[i] == i)
    return expected


def test_edge_rows_and_copies(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "a", "A", " \t\n", "one two three four five six seven", "one  two three FOUR five six seven", "naïve é \u00a0 x", "z" * 3000, "word " * 6000]
    for _ in range(30):
        b = " ".join(f"w{rng.integers(5000)}" for _ in range(200))
        texts += [b, b, b.upper(), b.replace(b.split()[100], "changed"), " ".join(b.split()[:150]) + " tail" * 50]
    expected = check(spark, texts)
    assert expected[3] == 2 and expected[6] == 5 and expected[4] == 4


def test_null_and_repeated_ids(spark):
    """Rows without an id stay alone and kept; rows of one id are one node, linked by any of its texts."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    out = near_duplicates.near_duplicates(docs(spark, [one, one, one, two, two, "other words"], [None, 5, 9, 9, 12, 20])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(5, 5, True), (9, 5, False), (9, 5, False), (12, 5, False), (20, 20, True)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]


def crowd(n, seed=11, words=1200):
    """Variants of one text that share about 83 % with each other, and twins of some of them just over 85 %."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(words)], []
    for k in range(n):
        copy = list(base)
        for at in rng.choice(words, 11, replace=False):
            copy[at] = f"x{k}_{at}"
        out.append(" ".join(copy))
        if k % 5 == 0:
            for at in range(3, 18 * 60, 60):
                copy[at] = f"y{k}_{at}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("forced", [{}, {"dense_rows": 5, "slice_rows": 17}, {"dense_rows": 10_000, "slice_items": 3000}])
def test_crowded_region_with_forced_descent_and_slices(spark, forced):
    texts = crowd(60)
    sets = [shingle_set(t) for t in texts]
    shares = [len(a & b) / len(a | b) for a in sets for b in sets if a is not b]
    assert sum(0.78 < x < 0.85 for x in shares) > 0.5 * len(shares) and sum(x >= 0.85 for x in shares) >= 20
    expected = check(spark, texts, **forced)
    assert 10 < len(set(expected)) < len(texts)


def test_descent_alone_gives_true_links(spark):
    """Regions of many rows take a longer prefix, each its own."""
    prepare(spark)
    rows = [(0, b"\0" * 6 + bytes([0, k % 3]) + bytes([k]) * 8, k, 100, k) for k in range(30)] + [(1, bytes([9]) * 6 + bytes([k]) * 10, 100 + k, 100, k) for k in range(4)] + [(2, b"\1" * 16, 200 + k, 100, k) for k in range(9)]
    placed = spark.createDataFrame(rows, "tree int, path binary, node long, n_shingles long, component long")
    found = near_duplicates.descended(placed, 3, 5).collect()
    assert {(r.tree, len(r.region)) for r in found} == {(0, 10), (2, 16)} and len(found) == 39
    assert near_duplicates.descended(placed, 3, 100) is None


@pytest.mark.parametrize("words", [1028, 3000])
def test_sets_of_every_size(spark, words):
    """Copies on both sides of 85 %, of sets below and above a thousand shingles, whole and in slices."""
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(5000)}" for _ in range(words)]
    texts = []
    for changes in rng.integers(1, words // 25, 30):
        copy = base[: words - int(rng.integers(0, 12))]
        for at in rng.integers(0, len(copy), changes):
            copy[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    assert 1 < len(set(check(spark, texts))) < len(texts)
    if words == 3000:
        check(spark, texts, slice_items=4 * words, slice_rows=9, dense_rows=4)


def at_percent(k, n, words=104):
    own = [f"w{k}_{i}" for i in range(words)]
    return [" ".join(own), " ".join(own[n:] + [f"x{k}_{i}" for i in range(n)])]


@pytest.mark.parametrize("percent, over, under", [(80, 11, 12), (85, 8, 9)])
def test_pairs_close_to_the_limit(spark, percent, over, under):
    """100 - n of 100 + n shingles are common: 80.2 or 78.6 %, 85.2 or 83.5 %."""
    texts = [t for k in range(150) for t in at_percent(k, over if k % 2 else under)]
    assert len(set(check(spark, texts, percent))) == len(texts) - 75
    assert near_duplicates.shape(85) == (12, 3) and near_duplicates.shape(80) == (16, 3)


def test_empty_table(spark):
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicates.near_duplicates(docs(spark, [None, ""])).filter("kept").count() == 2


def test_pipeline_takes_80_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = at_percent(0, 10)  # 90 of 110 shingles: 81.8 %
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts).select(columns), "").count() == 1
