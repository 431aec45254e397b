"""Kept analyses: unchanged files are not read again."""

import os

import numpy as np
from pyspark.sql import functions as F

from prismspark.operators import images, protocol
from prismspark.sources import incremental


def analyse(files):
    return files.select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").alias("bytes"))


def put(path, content, at):
    path.write_bytes(content)
    os.utime(path, ns=(at, at))


def test_second_run_reads_only_what_changed(spark, tmp_path):
    folder, store = tmp_path / "case", str(tmp_path / "store")
    (folder / "a").mkdir(parents=True)
    names = ["one.bin", "two.bin", "a/three.bin", "a/odd [1]{x}*.bin"]
    for i, name in enumerate(names):
        put(folder / name, bytes([i]) * 100, 10**18)
    got = lambda df: {r.path.split("/case/")[1].replace("%20", " "): r for r in df.collect()}
    first = got(incremental.refresh_files(spark, str(folder), store, analyse, chunk_paths=3))
    assert len(first) == 4 and len({r.run for r in first.values()}) == 2
    # Of another content, but with the old time and size: it shows in the digest if it is read.
    put(folder / "one.bin", b"x" * 100, 10**18)
    put(folder / "two.bin", b"y" * 100, 2 * 10**18)
    put(folder / "new.bin", b"z", 10**18)
    os.remove(folder / "a/three.bin")
    second = got(incremental.refresh_files(spark, str(folder), store, analyse))
    assert set(second) == {"one.bin", "two.bin", "new.bin", "a/odd [1]{x}*.bin"}
    assert second["one.bin"].digest == first["one.bin"].digest and second["one.bin"].run == first["one.bin"].run
    assert second["two.bin"].digest != first["two.bin"].digest and second["new.bin"].bytes == 1 and second["two.bin"].run == second["new.bin"].run
    third = got(incremental.refresh_files(spark, str(folder), store, lambda files: 1 / 0))
    assert {k: r.digest for k, r in third.items()} == {k: r.digest for k, r in second.items()}
    incremental.compact(incremental.listing(spark, str(folder)), store, str(tmp_path / "compact"))
    kept = incremental.stored(spark, str(tmp_path / "compact"))
    assert kept.count() == 4 < incremental.stored(spark, store).count()
    assert got(incremental.view(incremental.listing(spark, str(folder)), str(tmp_path / "compact"))).keys() == second.keys()


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    plan = incremental.listing(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content:" not in plan and "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_only_missing_measures_are_filled(spark):
    grey = lambda k: bytearray((np.arange(256) * k % 251).astype(np.uint8).tobytes())
    pictures = spark.createDataFrame([(f"p{k}", 16, 16, 1, grey(k + 1)) for k in range(4)], "path STRING, height INT, width INT, channels INT, pixels BINARY")
    whole = images.measure(pictures, ["lsb", "noise_map"])
    some = whole.filter("path <> 'p3'").withColumns({c: F.when(F.col("path") != "p1", F.lit(-5.0)) for c in whole.columns if c.startswith("lsb_")})
    found = {r.path: r for r in protocol.filled(pictures.filter("path <> 'p0'"), some, ["lsb", "noise_map"]).collect()}
    want = {r.path: r for r in whole.collect()}
    names = [c for c in whole.columns if c.startswith("lsb_")]
    assert set(found) == {"p1", "p2", "p3"} and all(found["p2"][c] == -5.0 for c in names)
    assert [found["p1"][c] for c in names] == [want["p1"][c] for c in names] and found["p3"] == want["p3"]
    # A measure that is complete is not computed again: its image need not be readable any more.
    gone = pictures.withColumn("pixels", F.lit(None).cast("binary"))
    assert {r.path: r.status for r in protocol.filled(gone, whole, ["lsb", "noise_map"]).collect()} == {f"p{k}": "success" for k in range(4)}


def test_keys_with_nulls_and_repeats(spark, tmp_path):
    schema = "path STRING, modified TIMESTAMP, length BIGINT"
    listed = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("b", None, None), (None, None, 3)], schema)
    calls = []

    def count(new):
        calls.append(sorted((r.path or "") for r in new.collect()))
        return new.select("path", F.lit(7).alias("m"))

    store = str(tmp_path / "store")
    assert incremental.stored(spark, store) is None
    for _ in range(2):
        found = incremental.refresh(listed, store, count)
        assert sorted(r.path for r in found.collect()) == ["a", "b"]
    assert calls[0] == ["", "a", "b"]
