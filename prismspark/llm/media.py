"""Media columns stored by content-defined chunking.

A payload becomes an 8-bit grey image (binary PGM, rows of 192 samples). A rolling gear hash cuts the stored bytes
into chunks where its high bits are zero; chunks are named by digest and kept once each. A store is three tables at
rest in the shared folder: the chunks, bucketed by name and compressed with a common dictionary; the ordered chunk list
of every row; and the dictionary. Reading starts from these tables alone: chunk lists are joined to the chunks, media
rebuilt and verified against their digest before features are computed.

The dictionary is trained from a bounded sample (`SAMPLE_ROWS` whole texts by a hash of the key); it only saves bytes.

Edge cases: null and empty texts store 192 padding bytes; equal texts share one list and all chunks; one chunk in
very many media is joined by broadcast, the number of such chunks being bounded; a medium is rebuilt row by row from
sorted chunks and is as large as its document; rows with a null or repeated key are stored as any other; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hashed_sample, join_hot, map_rows, scratch, shuffles_removed

WIDTH, PAD = 192, b" "
#: A cut needs 12 zero bits, so chunks have about 5 KiB between these bounds.
LEAST, MOST, MASK = 1024, 32_768, np.uint32(0xFFF00000)
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)
DIGEST_BYTES = 16
#: Texts that the dictionary is trained from at most, its size, and the compression level of chunks.
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 1000, 112_640, 6
#: Chunks of a bucket of the store (about 1 KB each when compressed): as few as the first number while the session's
#: shuffles have as many partitions, else up to the second; most buckets that Spark allows by default.
BUCKET_CHUNKS, FULL_BUCKET_CHUNKS, MOST_BUCKETS = 4000, 64_000, 100_000
#: Chunk names that a task remembers to have sent.
SENT = 300_000


def to_media(payload: bytes) -> bytes:
    """Payload, a multiple of 192 bytes, as a binary PGM image."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    """Samples of a binary PGM image."""
    head = re.match(rb"P5\s(\d+)\s(\d+)\s255\s", media)
    if not head or len(media) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not an 8-bit PGM image")
    return media[head.end() :]


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + PAD * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum over the last 32 bytes of GEAR[byte] shifted by its age, by doubling."""
    h, step = GEAR[data], 1
    while step < 32:
        older = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks."""
    data = np.frombuffer(media, np.uint8)
    spots = (np.flatnonzero((gear(data) & MASK) == 0) + 1).tolist() if len(data) > LEAST else []
    ends, last = [], 0
    for spot in [*spots, len(data)]:
        while spot - last > MOST:
            last += MOST
            ends.append(last)
        if spot - last >= LEAST or spot == len(data) > last:
            last = spot
            ends.append(last)
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).digest()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 64-bit difference hash of the image's 8 rows of 9 column means."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(float)
    rows = np.array_split(x, 8) if len(x) >= 8 else [x[i * len(x) // 8 : i * len(x) // 8 + 1] for i in range(8)]
    cells = np.array([[c.mean() for c in np.array_split(r, 9, axis=1)] for r in rows])
    bits = (cells[:, 1:] >= cells[:, :-1]).ravel()
    return f"mean={x.mean():.4f};std={x.std():.4f};dhash={int(''.join('1' if b else '0' for b in bits), 2):016x}"


@dataclass(frozen=True)
class Store:
    """Where a store lies: its folder of lists and dictionary, and the bucketed table of chunks in it."""

    folder: str
    table: str


def texts_of_column(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def recipes(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media_sha256, names: each medium's digest and ordered chunk digests. A narrow map."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        def each(batch: pa.RecordBatch):
            sizes, digests, names = [], [], []
            for t in texts_of_column(batch.column(1)):
                n, payload = padded(t)
                media = to_media(payload)
                sizes.append(n)
                digests.append(hashlib.sha256(media).hexdigest())
                names.append([name_of(c) for c in chunks(media)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(names, pa.list_(pa.binary()))], ["key", "n_bytes", "media_sha256", "names"])

        return each

    return map_rows(df.select(key, text), make, f"key {kind}, n_bytes long, media_sha256 string, names array<binary>").withColumnRenamed("key", key)


def dictionary(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> bytes:
    """A compression dictionary from the sample's chunks; empty where there is too little to train one."""
    rows = hashed_sample(df.select(key, text), [key], SAMPLE_ROWS, 3).select(text).toArrow()
    samples = [c for t in sorted(set(texts_of_column(rows.column(0)))) for c in chunks(to_media(padded(t)[1]))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def compressor(words: bytes) -> zstandard.ZstdCompressor:
    if not words:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(words)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_dict_id=False)


def decompressor(words: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()


def chunk_rows(df: DataFrame, words: bytes, *, text: str = "text") -> DataFrame:
    """name, body (compressed) of the chunks of every text. A task sends a chunk it has lately sent only once."""

    def make():
        tool, sent = compressor(words), set()

        def each(batch: pa.RecordBatch):
            names, bodies = [], []
            if len(sent) > SENT:
                sent.clear()
            for t in texts_of_column(batch.column(0)):
                for c in chunks(to_media(padded(t)[1])):
                    name = name_of(c)
                    if name not in sent:
                        sent.add(name)
                        names.append(name)
                        bodies.append(tool.compress(c))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], ["name", "body"])

        return each

    return map_rows(df.select(text), make, "name binary, body binary")


def write_store(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> Store:
    """Write the chunk lists, the dictionary and every distinct chunk once to a new folder of the shared one."""
    spark = df.sparkSession
    store = Store(scratch(spark, "media-store"), f"media_chunks_{uuid.uuid4().hex}")
    words = dictionary(df, key=key, text=text)
    with shuffles_removed(spark):
        recipes(df, key=key, text=text).write.option("compression", "zstd").parquet(f"{store.folder}/lists")
        spark.createDataFrame([(bytearray(words),)], "words binary").coalesce(1).write.parquet(f"{store.folder}/dictionary")
        total = spark.read.parquet(f"{store.folder}/lists").agg(F.sum(F.size("names"))).first()[0] or 0
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, max(1, -(-total // FULL_BUCKET_CHUNKS), min(partitions, -(-total // BUCKET_CHUNKS))))
        # Rows are dealt by name as the buckets are, so that a task writes one bucket, and reading needs no other shuffle of bodies.
        once = chunk_rows(df, words, text=text).repartition(buckets, "name").groupBy("name").agg(F.first("body").alias("body"))
        once.write.option("compression", "none").option("path", f"{store.folder}/chunks").bucketBy(buckets, "name").sortBy("name").format("parquet").saveAsTable(store.table)
    return store


READ = "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def read_back(wanted: DataFrame, stored: DataFrame, words: bytes) -> DataFrame:
    """A row per medium of wanted (media_sha256, place, parts, name), rebuilt from stored chunks, verified and read."""
    bodies = join_hot(wanted, stored, "name").select("media_sha256", "place", "parts", "body")
    # Media of one chunk are whole as they are; only the chunks of the others are brought together.
    single = bodies.filter("parts = 1")
    sorted_parts = bodies.filter("parts > 1").repartition("media_sha256").sortWithinPartitions("media_sha256", "place")

    def make():
        tool, held = decompressor(words), {"digest": None, "parts": []}

        def each(batch: pa.RecordBatch):
            out = []
            for digest, place, parts, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    held["digest"], held["parts"] = digest, []
                if held["digest"] != digest or place != len(held["parts"]):
                    raise ValueError(f"chunks of {digest} are missing")
                held["parts"].append(tool.decompress(body))
                if place == parts - 1:
                    media = b"".join(held["parts"])
                    if hashlib.sha256(media).hexdigest() != digest:
                        raise ValueError(f"media {digest} differs from what was stored")
                    payload = from_media(media)
                    out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), feature(payload)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

        return each

    return map_rows(single, make, READ).unionByName(map_rows(sorted_parts, make, READ))


def read_store(spark: SparkSession, store: Store, *, key: str = "doc_id") -> DataFrame:
    """A row per stored row: what its list and chunks at rest give."""
    lists = spark.read.parquet(f"{store.folder}/lists")
    words = bytes(spark.read.parquet(f"{store.folder}/dictionary").first()[0])
    once = lists.groupBy("media_sha256").agg(F.first("names").alias("names"))
    wanted = cut(once.select("media_sha256", F.size("names").alias("parts"), F.posexplode("names").alias("place", "name")), "chunk-lists")
    read = cut(read_back(wanted, spark.table(store.table), words), "media-read")
    return join_hot(lists.drop("names"), read, "media_sha256")


def store_and_read(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media, then read the store: a row per row of df."""
    return read_store(df.sparkSession, write_store(df, key=key, text=text), key=key)
