"""Target-distribution importance resampling by an external sort-count.

Every run of one to n words falls into one of a fixed number of buckets. One reading of the texts writes the bucket
numbers of many documents as one packed stream of unsigned 16-bit numbers with the documents' offsets, cut at
`STREAM_BYTES`. The streams are sorted and run-length encoded for the counts of the whole table; those of the target
table are counted in the same way. The gain of a bucket is the rounded log ratio of its two shares; a second reading, of
streams only, gathers the gains and sums them per document with np.add.reduceat.

Documents are drawn by Gumbel keys: weight plus noise from a hash of the id, so reruns agree. The order comes from one
range-partitioned sort of (score, id); partitions are numbered, their sizes summed, and a rank is the size of the
partitions before plus the place inside, so no task holds more than a partition.

What grows with the input: the streams (2 bytes a feature) and 50 bytes a document for the sort. What does not: counts
and gains, a row a bucket.

Edge cases: null and empty texts and those without words have no features, weight 0 and no rank; a null id hashes as the
empty string and comes last among ties; rows that share an id are weighed each and drawn each; ties go to the smaller id;
an empty target gives every bucket the gain of no target features; an empty table gives an empty one. Only the key and
the text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_rows, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, WIDTH = 10_000, 2
#: Size at which a packed stream is closed.
STREAM_BYTES = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(text: str, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to width words. A longer run's CRC goes on from that of the run
    without its last word, so no feature is spelled out."""
    words = WORD.findall(text.encode().translate(LOWER))
    if not words:
        return 0, np.zeros(0, "<u2")
    ends = [b" " + w for w in words]
    crcs, found = list(map(zlib.crc32, words)), []
    for k in range(1, width + 1):
        found.append(np.array(crcs, np.uint32))
        crcs = list(map(zlib.crc32, ends[k:], crcs))
    return len(words), (np.concatenate(found) % np.uint32(buckets)).astype("<u2")


def packed_row(kind: pa.DataType, keys: list, words: list[int], offsets: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    numbers = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kind)), pa.array([words], numbers), pa.array([offsets], numbers), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["keys", "words", "offsets", "stream"])


def streams(df: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Packed streams: keys, words (of each document), offsets (of each in the stream) and stream."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch):
            keys, words, offsets, parts, held = [], [], [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                n, found = features(t, width, buckets)
                keys.append(k), words.append(n), offsets.append(held), parts.append(found)
                held += len(found)
                if 2 * held >= STREAM_BYTES:
                    yield packed_row(batch.schema.field(0).type, keys, words, offsets, parts)
                    keys, words, offsets, parts, held = [], [], [], [], 0
            if keys:
                yield packed_row(batch.schema.field(0).type, keys, words, offsets, parts)

        return each

    return map_rows(df.select(key, text), make, f"keys array<{kind}>, words array<bigint>, offsets array<bigint>, stream binary")


def runs(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted stream run-length encoded: buckets and their counts."""
    numbers = np.sort(np.frombuffer(stream, "<u2"))
    starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
    return numbers[starts].astype(np.int64), np.diff(np.r_[starts, len(numbers)])


def counts(packed: DataFrame) -> DataFrame:
    """bucket, n over all streams: each is sorted and run-length encoded where it lies, and the few runs are summed."""

    def make():
        def each(batch: pa.RecordBatch):
            for stream in batch.column(0).to_pylist():
                found, n = runs(stream)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["bucket", "n"])

        return each

    return map_rows(packed.select("stream"), make, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for every bucket; at most `buckets` rows of each come here."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, table in ((s, source), (t, target)):
        for bucket, n in table.collect():
            into[bucket] = n
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (all_s + buckets) / ((a + 1.0) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(packed: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, words, n_features and weight of every document in the streams."""
    kind = packed.schema["keys"].dataType.elementType.simpleString()

    def make():
        def each(batch: pa.RecordBatch):
            for keys, words, offsets, stream in zip(*(c for c in batch.columns), strict=True):
                found = gain[np.frombuffer(stream.as_py(), "<u2")]
                at = np.array(offsets.as_py(), np.int64)
                n = np.diff(np.r_[at, len(found)])
                # reduceat gives an element where a document has none, and needs every offset inside the stream.
                sums = np.add.reduceat(np.r_[found, 0], at) if len(at) else at
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([keys.values, words.values, pa.array(n), pa.array(weight)], [key, "words", "n_features", "weight"])

        return each

    return map_rows(packed.select("keys", "words", "offsets", "stream"), make, f"`{key}` {kind}, words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) from a hash of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, *, key: str = "doc_id", score: str = "score", eligible: str = "eligible", percent: int = 25) -> DataFrame:
    """scored with rank: 1, 2, 3... by falling score, ties by key, of the eligible rows' best `percent` percent; else null.

    One range-partitioned sort; what is collected is a row per partition.
    """
    order = [F.col(eligible).desc(), F.col(score).desc(), F.col(key).asc_nulls_last()]
    place = F.monotonically_increasing_id()
    lined = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "ranked")
    in_part = F.shiftright("place", 33)
    sizes = sorted(lined.groupBy(in_part.alias("part")).agg(F.count("*"), F.count_if(F.col(eligible))).collect())
    drawn, before, starts = percent * sum(r[2] for r in sizes) // 100, 0, []
    for part, n, _ in sizes:
        starts.append((part, before))
        before += n
    spark = scored.sparkSession
    starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = lined.withColumn("part", in_part).join(starts, "part")
    return out.select(*scored.columns, F.when(F.col(eligible) & (rank <= drawn), rank).alias("rank"))


def resample(df: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 7, percent: int = 25, least_words: int = 20, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """key, n_features, weight, score and rank (null if not drawn) of every row of df, drawn towards target's words."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("streams hold unsigned 16-bit numbers: at most 65,536 buckets")
    packed = cut(streams(df, key=key, text=text, width=width, buckets=buckets), "streams")
    aimed = streams(target.select(F.lit(0).alias(key), F.col(target_text).alias(text)), key=key, text=text, width=width, buckets=buckets)
    gain = gains(counts(packed), counts(aimed), buckets)
    found = weights(packed, gain, key)
    score = (F.col("weight") + noise(F.col(key), seed)).alias("score")
    found = found.select(key, "n_features", "weight", score, (F.col("words") >= least_words).alias("eligible"))
    out = ranked(found, key=key, percent=percent).select(key, "n_features", "weight", "score", "rank")
    drop(packed)
    return out


def drawn(df: DataFrame, result: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The drawn rows of df, whole, with their rank; of rows that share an id all come, each with the id's best rank."""
    best = result.filter(F.col("rank").isNotNull()).groupBy(key).agg(F.min("rank").alias("rank"))
    return df.drop("rank").join(best, key)


ORACLE = r"""
WITH table_(i, c) AS (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) FROM (SELECT unnest(range(256)) AS i) q),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_),
texts AS (SELECT 0 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents UNION ALL SELECT 1, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, row_number() OVER () AS row_, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, row_, doc_id, len(w) AS n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
names AS (SELECT DISTINCT f FROM runs),
hexed AS (SELECT f, lower(hex(encode(f))) AS x FROM names),
buckets AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM hexed, crc_table),
sums AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM runs JOIN buckets USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS g FROM sums),
means AS (SELECT row_, count(*)::BIGINT AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM runs JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY row_),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS eligible,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN means USING (row_) WHERE side = 0),
lined AS (SELECT *, row_number() OVER (ORDER BY eligible DESC, score DESC, doc_id ASC NULLS LAST) AS r, 25 * count(*) FILTER (eligible) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND r <= drawn THEN r END::BIGINT AS rank FROM lined
"""
