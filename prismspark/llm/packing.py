"""Sum-of-squares packing of token sequences.

Tokenising is a narrow map that leaves one short row per piece. Pieces are dealt evenly over groups of bounded
size by a hash of their row number, whatever their document or source; each group is packed by the sum-of-squares
rule: longest first, a piece goes into the open bin with which the sum over residual gaps of (open bins with that
gap) squared becomes smallest; a new bin is opened only when no open one has room.

Edge cases: null and empty texts are one piece holding only the end id; equal rows are packed as often as they
occur; a text of any length is cut into pieces of the sequence size of which only the first may be shorter;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, map_rows, texts_of

#: Pieces packed together: bounds a task's memory, and is large enough that a group's open bins cost little.
GROUP_PIECES = 20_000
#: Bytes of cached units per worker before the older half goes; what a unit's place takes beside its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 600_000_000, 200
#: A single space between two other characters: no token of a byte-level BPE reaches over it from the left.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: Signs on whose classes all engines agree, and the parts into which a byte-level BPE cuts a text of such signs.
COMMON = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]*")
PRETOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Units without white space but the single space they may begin with, and units that are encoded as one text.
SPACED, BARE = re.compile(r" \S+"), re.compile(r"\S+")
JOINED = 4096


class ByteBpe:
    """Ids of a byte-level BPE by its library, cached by the unit. Bytes of an answer: little-endian uint32 ids. Units not
    seen before are encoded as one text where the ids show where each begins (by the space that is part of its first
    token, or by the new lines between units), and each by itself elsewhere."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        # A byte-level vocabulary writes the space as this letter, and the new line as the other.
        self.begins = np.array([(self.library.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.line = self.library.token_to_id("\u010a")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        cuts = settings.get("pre_tokenizer") or {}
        self.standard = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and not settings.get("normalizer")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def keep(self, units: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(units, ids, strict=True))
        self.held += 2 * sum(map(len, units)) + sum(map(len, ids)) + ENTRY_BYTES * len(units)

    def units(self, text: str) -> list[str]:
        """The text in parts that are encoded each by itself: those that the tokenizer makes of common signs, or else what
        stands between single spaces."""
        if self.standard and COMMON.fullmatch(text) and not any(t in text for t in self.added):
            return PRETOKEN.findall(text)
        return units_of(text)

    def joined(self, units: list[str], between: str) -> list[str]:
        """Encode units as one text; gives back those that have to be encoded by themselves."""
        alone: list[str] = []
        for i in range(0, len(units), JOINED):
            part = units[i : i + JOINED]
            ids = np.array(self.library.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, "<u4")
            # Places of the first ids of units, and of what follows the last of each.
            cuts = np.flatnonzero(ids == self.line if between else self.begins[ids])
            starts = np.r_[0, cuts + 1] if between else cuts
            ends = np.r_[cuts, len(ids)] if between else np.r_[cuts[1:], len(ids)]
            if len(starts) != len(part) or starts[0] or (ends <= starts).any():
                alone += part
                continue
            raw = ids.tobytes()
            self.keep(part, [raw[s:e] for s, e in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)])
        return alone

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if not any(t in u for t in self.added)]
        spaced = [u for u in plain if SPACED.fullmatch(u)]
        bare = [u for u in plain if BARE.fullmatch(u)] if self.standard and self.line is not None else []
        alone = list(set(units).difference(spaced, bare)) + self.joined(spaced, "") + self.joined(bare, "\n")
        self.keep(alone, [np.array(found.ids, "<u4").tobytes() for found in self.library.encode_batch_fast(alone, add_special_tokens=False)])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 64):
            split = [self.units(t) for t in texts[i : i + 64]]
            if self.held > CACHE_BYTES // 2:
                self.known, self.older, self.held = {}, self.known, 0
            new = set().union(*split).difference(self.known)
            if again := list(new.intersection(self.older)):
                self.keep(again, [self.older[u] for u in again])
            if new := list(new.difference(self.known)):
                self.learn(new)
            for units in split:
                yield b"".join(map(self.known.__getitem__, units))


def units_of(text: str) -> list[str]:
    """The text in parts that are encoded each by itself: a unit begins with the single space before it."""
    units = BETWEEN.split(text) if UNEVEN.search(text) else text.split(" ")
    return [units[0], *(" " + u for u in units[1:])]


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def pieces(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32, full_id: a row per piece; full_id numbers pieces that fill a sequence."""
    kind = df.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        bpe = loaded(path)
        context = TaskContext.get()
        count = [(context.partitionId() if context else 0) << 36]

        def each(batch: pa.RecordBatch):
            rows: list[tuple] = []
            owners: list[int] = []
            for i, ids in enumerate(bpe.encode(texts_of(batch.column(1)))):
                ids += end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = min(size, n) if at or n <= size else (n % size or size)
                    full = None
                    if length == size:
                        full = count[0]
                        count[0] += 1
                    rows.append((k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), full))
                    owners.append(i)
                    at, k = at + length, k + 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["key", "piece", "start", "length", "ids_crc32", "full_id"])

        return each

    return map_rows(df.select(key, text), make, f"key {kind}, piece int, start long, length long, ids_crc32 long, full_id long").withColumnRenamed("key", key)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first. open_bins[g]: stack of bins with gap g; count[g]: how many."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(size + 1, np.float64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # Moving a bin from gap h to h - s changes the sum by 2 (count[h-s] - count[h] + 1); a filled bin (gap 0) counts no more.
        change = count[: size - s] - count[s:size] + 1.0
        if s < size:
            change[0] = 0.5 - count[s]
            change[count[s:size] == 0] = np.inf
            best = int(change.argmin())
            fits = np.isfinite(change[best])
        else:
            best, fits = 0, False
        if fits:
            b = open_bins[s + best].pop()
            count[s + best] -= 1
            gap = s + best
        else:
            b, made, gap = made, made + 1, size
        bins[i], offsets[i] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(found: DataFrame, *, key: str = "doc_id", size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces(). found should be a written table: its row numbers deal out the groups."""
    kind = found.schema[key].dataType.simpleString()
    out = f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    short = found.filter("full_id is null").drop("full_id")
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, size)
        base = (2 * table["dealt"][0].as_py() + 1) << 36
        return table.drop(["dealt"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    # Odd multiples of 2^36 number the packed sequences, even ones the pieces that fill a sequence.
    whole = found.filter("full_id is not null").select(key, "piece", "start", "length", "ids_crc32", F.expr("(full_id & ((1L << 36) - 1)) | ((full_id >> 36) << 37)").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("dealt").applyInArrow(one, out).unionByName(whole)


def best_fit_packing(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for every text of df."""
    return pack(cut(pieces(df, path, key=key, text=text, size=size, end_id=end_id), "pieces"), key=key, size=size)
