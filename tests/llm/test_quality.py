"""The quality classifier: its bounded sample and its scores against a plain computation."""

import math

import pytest
import zstandard
from pyspark.sql import functions as F

from prismspark.llm import quality, registry
from prismspark.llm.common import prepare

SF = "/root/testdata/sf0.01"


def plain_score(text, model):
    """Compressed sizes by compressors made anew, block by block."""
    raw = (text or "").encode()
    if not raw:
        x = [0.0] * 4
    else:
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        sizes = []
        for words in (model.good, model.bad, b""):
            tool = zstandard.ZstdCompressor(**options, **({"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}))
            sizes.append(sum(len(tool.compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192)))
        gap, ratio = (sizes[1] - sizes[0]) / max(sizes[:2]), min(sizes[2] / len(raw), 1.5) - 0.4
        x = [gap, ratio, gap * gap, ratio * ratio]
    return 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x)))))


def test_scores_like_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = registry.op6_quality(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], model), abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_sample_of_an_id_that_repeats(spark):
    """100,000 rows of one labelled id, of ten texts, are one text of the sample; so are ids once each."""
    prepare(spark)
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 10).cast("string"), F.repeat(F.lit(" word"), 100)).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(3, None), (4, "b" * 1000), (4, "b" * 1000), (None, "x"), (7, "not labelled")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.filter(quality.held_out_remainder("doc_id") == 2).collect()}
    rows = quality.sample(docs, labels).collect()
    want = {1: 1, 3: 0, 4: 1}
    assert sorted((r.doc_id, r.label) for r in rows) == sorted((k, v) for k, v in want.items() if k not in held) and len(rows) >= 2
    assert quality.sample(docs, labels).collect() == rows
    few = quality.sample(docs, labels, sample_bytes=1200).collect()
    assert len(few) < len(rows) and sum(len(r.t) for r in few) <= 1200
    assert quality.sample(docs.limit(0), labels).collect() == [] and quality.fit(docs, labels.limit(0)).weights[0] == 0.0
