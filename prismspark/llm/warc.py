"""WARC writing and reading with boundary-chain verification.

Writing: payloads are digested in one narrow pass; digests that occur more than once make later records revisits.
Records are written by Spark's text writer, whose line separator is the end of a WARC record, one file per task.

Reading: files are split at every occurrence of the record magic, by byte ranges, so that the magic inside a payload
also gives a candidate. Tasks emit each candidate's offset and the offset of its successor as its header declares it.
Pointer jumping from each file's start then keeps the candidates that are reachable and rejects the others. Payloads
that hold the magic lie in several candidates and are joined again in a second, targeted read.

Edge cases: null html is an empty payload; equal payloads of rows with one page_id are one capture, each a response;
null page_ids count as largest; control characters and spaces of a url are percent-encoded in the header only; an
empty table gives an empty table; other columns are not read. A file's candidates, two numbers each, are held by
one task: the writer's files follow the size of Spark's input splits.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows, scratch, small_or_not

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Rows up to which the digests that repeat, or the rows of payloads that hold the magic, are broadcast (under 100 bytes a row).
BROADCAST_ROWS = 100_000
DATE = "2026-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, digest, size: a narrow row per page."""

    def make():
        def each(batch: pa.RecordBatch):
            raw = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest_of(b) for b in raw]), pa.array([len(b) for b in raw], pa.int64())], ["key", "digest", "size"])

        return each

    return map_rows(pages.select(key, html), make, "key long, digest string, size long")


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write WARC files with a response or revisit record per page. Payloads under `least` bytes are all responses."""
    seen = digests(pages, key=key, html=html).filter(F.col("size") >= least)
    again = seen.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = small_or_not(cut(again, "warc-again"), BROADCAST_ROWS)
    kinds = ", ".join(f"{n} {t}" for n, t in (("key", "long"), ("url", "string"), ("html", "string"), ("digest", "string"), ("size", "long")))

    def with_digest():
        def each(batch: pa.RecordBatch):
            raw = [b or b"" for b in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest_of(b) for b in raw]), pa.array([len(b) for b in raw], pa.int64())], ["key", "url", "html", "digest", "size"])

        return each

    rows = map_rows(pages.select(key, url, html), with_digest, kinds).join(again, "digest", "left").select("key", "url", "html", "digest", "size", "first")

    def records():
        state = {"begun": False}

        def each(batch: pa.RecordBatch):
            out = []
            if not state["begun"]:
                state["begun"] = True
                info = "software: prismspark\r\nformat: WARC File Format 1.1\r\n"
                out.append(f"{MAGIC}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:prismspark:info>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}{END}{info}".encode())
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            for page, address, body, digest, size, first in zip(*(batch.column(i).to_pylist() for i in (0, 1)), raw, *(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                revisit = first is not None and page != first and size >= least
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}".encode()
                block = http if revisit else http + (body or b"")
                target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", address) if address else "urn:none"
                head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
                if revisit:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                out.append((MAGIC + "\r\n".join(head) + END).encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

        return each

    map_rows(rows, records, "value string").write.option("lineSep", END).text(path)


HEADER = re.compile(rb"(?i)^(WARC-Type|WARC-Record-ID|WARC-Refers-To|WARC-Payload-Digest|Content-Length)[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", re.M)


def parse(row: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Header and block lengths (the header's with the magic) and fields of what follows a magic; None if it is no record."""
    end = row.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in HEADER.findall(row[:end])}
    length = fields.get("content-length", "")
    if not length.isdecimal() or "warc-type" not in fields:
        return None
    return len(MAGIC) + end + 4, int(length), fields


def payload_of(block: bytes) -> bytes:
    """The entity after the HTTP header."""
    return block[block.find(b"\r\n\r\n") + 4 :]


def page_of(urn: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


ROW = "file string, block long, place long, size long, next long, whole boolean, kind string, page_id long, refers_to long, bytes long, digest string"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics, with its file and the start of its byte range."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def described(row: bytes) -> tuple:
    """next (length to the successor, 0 if none), whole, kind, page_id, refers_to, bytes, digest."""
    found = parse(row)
    if found is None:
        return 0, False, None, None, None, None, None
    head, length, fields = found
    whole = len(row) + len(MAGIC) >= head + length + 4 and row[head - len(MAGIC) + length :] == b"\r\n\r\n"
    kind, size, digest = fields["warc-type"], None, None
    if kind == "response" and whole:
        body = payload_of(row[head - len(MAGIC) : head - len(MAGIC) + length])
        size, digest = len(body), digest_of(body)
    elif kind == "revisit":
        size = re.search(rb"(?i)Content-Length:\s*(\d+)", row[head - len(MAGIC) :])
        size, digest = int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return head + length + 4, whole, kind, page_of(fields.get("warc-record-id", "")), page_of(fields.get("warc-refers-to", "")), size, digest


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per candidate: its place in its byte range, its size, and the length to its successor."""

    def make():
        at: dict[tuple, int] = {}

        def each(batch: pa.RecordBatch):
            out = []
            for row, file, block in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                place = at.get((file, block), 0)
                at[file, block] = place + len(row) + len(MAGIC)
                out.append((file, block, place, len(row) + len(MAGIC), *described(row)))
            columns = zip(*out, strict=True)
            kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.string(), *[pa.int64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])

        return each

    return map_rows(segments(spark, path), make, ROW)


def reachable(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets lie on the chain from the first one, by pointer jumping over successor offsets."""
    n = len(offsets)
    at = np.searchsorted(offsets, following)
    jump = np.where((at < n) & (offsets[np.minimum(at, n - 1)] == following) & (at > np.arange(n)), at, n)
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more[:n] == reached[:n]).all():
            return reached[:n]
        reached, jump = more, jump[jump]


def verified(found: DataFrame) -> DataFrame:
    """Candidates with kept (reachable from their file's start) and owner (place number of the record that holds them)."""

    def one(table: pa.Table) -> pa.Table:
        block, place, size, ahead = (table[c].to_numpy() for c in ("block", "place", "size", "next"))
        order = np.lexsort((place, block))
        # The first row of a file is the empty text before its first magic; each row starts where the one before ends.
        starts = np.cumsum(size[order]) - size[order] - len(MAGIC)
        kept = np.zeros(len(order), bool)
        kept[1:] = reachable(starts[1:], np.where(ahead[order][1:] > 0, starts[1:] + ahead[order][1:], -1))
        owner = np.maximum.accumulate(np.where(kept, np.arange(len(order)), 0))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        number = np.arange(len(order))
        return pa.table({"file": table["file"], "block": table["block"], "place": table["place"], "kept": kept[back], "owner": owner[back], "number": number[back]})

    narrow = found.select("file", "block", "place", "size", "next")
    return narrow.groupBy("file").applyInArrow(one, "file string, block long, place long, kept boolean, owner long, number long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives under path."""
    found = cut(candidates(spark, path), "warc-candidates")
    chain = cut(verified(found), "warc-chain")
    kept = found.join(chain.hint("shuffle_merge"), ["file", "block", "place"]).filter("kept and kind in ('response', 'revisit')")
    final = F.col("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to")
    done = kept.filter("whole").select(*final)
    open_rows = kept.filter("not whole").select("file", F.col("number").alias("owner"))
    if open_rows.isEmpty():
        return done
    parts = cut(chain.join(open_rows, ["file", "owner"]).select("file", "block", "place", "owner", "number"), "warc-parts")

    def with_place():
        at: dict[tuple, int] = {}

        def each(batch: pa.RecordBatch):
            places = []
            for size, file, block in zip((len(b) for b in batch.column(0).cast(pa.binary()).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                places.append(at.get((file, block), 0))
                at[file, block] = places[-1] + size + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), *batch.columns[1:], pa.array(places, pa.int64())], ["value", "file", "block", "place"])

        return each

    pieces = map_rows(segments(spark, path), with_place, "value binary, file string, block long, place long").join(small_or_not(parts, BROADCAST_ROWS), ["file", "block", "place"])

    def joined(table: pa.Table) -> pa.Table:
        row = MAGIC.encode().join(v for _, v in sorted(zip(table["number"].to_pylist(), table["value"].to_pylist(), strict=True)))
        ahead, whole, kind, page, refers, size, digest = described(row)
        return pa.table({"page_id": pa.array([page], pa.int64()), "payload_bytes": pa.array([size], pa.int64()), "payload_digest": pa.array([digest], pa.string()), "record_type": pa.array([kind], pa.string()), "refers_to": pa.array([refers], pa.int64())})

    rest = pieces.groupBy("file", "owner").applyInArrow(joined, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return done.unionByName(rest)


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
