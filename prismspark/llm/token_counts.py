"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch lie in one flat symbol array with a sequence number per symbol. A round finds
each sequence's lowest-ranked adjacent pair, merges all its occurrences in every sequence at once, and drops
sequences without a pair that merges; what is left of a sequence is its token count. A very long pre-token is merged by
the same rule with its positions linked and gathered by rank, so that a round touches only what changes.

Edge cases: null and empty texts count 0; repeated rows give equal counts; a very long text is read in pieces
that end at spaces; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_rows, texts_of

NO_RANK = np.int32(2**31 - 1)
#: Bytes of cached words per worker before the caches start anew (a word's own and ENTRY_BYTES for its places in both),
#: characters of the pieces of a long text, and bytes from which a word is merged with linked positions.
CACHE_BYTES, ENTRY_BYTES, PIECE_CHARS, LONG_WORD = 200_000_000, 250, 1 << 20, 2048


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself when printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Counts the tokens of a BPE with an end-of-word suffix, as the file's own library would."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.normal = Tokenizer.from_file(path).normalizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.units: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.held = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def merge_count_of_long(self, word: bytes) -> int:
        """merge_counts of one long word: its symbols are linked, and the places of each rank wait in a heap of ranks."""
        raw = np.frombuffer(word, np.uint8)
        n = len(raw)
        sym = self.inner[raw]
        sym[-1] = self.final[raw[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, NO_RANK, np.int32)  # of the pair that starts here; the last place stands for the end
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []
        left = n

        def gather(places: np.ndarray) -> None:
            """Ranks of the pairs at places, which then wait for their turn."""
            rank[places] = NO_RANK
            places = places[after[places] < n]
            now = self.rank(sym[places], sym[after[places]])
            rank[places] = now
            order = np.argsort(now, kind="stable")
            low, starts = np.unique(now[order], return_index=True)
            for r, own in zip(low.tolist(), np.split(places[order], starts[1:]), strict=True):
                if r != NO_RANK:
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(own)

        gather(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            first = np.concatenate(([True], after[at[:-1]] != at[1:]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            sym[at] = self.made[r]
            rank[gone] = NO_RANK
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            ahead = before[at]
            gather(np.unique(np.concatenate((at, ahead[ahead >= 0]))))
        return left

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty word after all merges."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG_WORD]
        if long:
            out = np.zeros(len(words), np.int64)
            out[long] = [self.merge_count_of_long(words[i]) for i in long]
            short = [i for i, w in enumerate(words) if len(w) < LONG_WORD]
            out[short] = self.merge_counts([words[i] for i in short]) if short else []
            return out
        counts = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(counts) - 1
        sym = self.inner[raw]
        sym[ends] = self.final[raw[ends]]
        seq = np.repeat(np.arange(len(words)), counts)
        rank = np.full(len(sym), NO_RANK, np.int32)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[ends] = NO_RANK
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            live = low != NO_RANK
            if not live.all():
                stay = np.repeat(live, sizes)
                sym, seq, rank, low, sizes = sym[stay], seq[stay], rank[stay], low[live], sizes[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            # In a run such as aaa the pair overlaps itself: every other occurrence merges.
            first = np.concatenate(([True], at[1:] != at[:-1] + 1))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym[at] = self.made[rank[at]]
            np.subtract.at(counts, seq[at], 1)
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            now = (np.cumsum(stay) - 1)[at]
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            touched = np.unique(np.concatenate((now, now[now > 0] - 1)))
            rank[touched] = NO_RANK
            touched = touched[touched < len(sym) - 1]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.rank(sym[touched], sym[touched + 1])
        return counts

    def learn(self, units: set[str]) -> None:
        """Count units (runs without a space) that were not seen before."""
        parts, fresh = {}, set()
        for unit in units:
            own, found = 0, []
            pieces = [unit]
            if "<|" in unit:
                own, pieces = len(self.special.findall(unit)), self.special.split(unit)
            for piece in pieces:
                found += self.words.findall(piece.lower() if piece.isascii() else self.normal.normalize_str(piece))
            parts[unit] = (own, found)
            fresh.update(w for w in found if w not in self.known)
        if fresh:
            words = list(fresh)
            self.known.update(zip(words, self.merge_counts([w.encode() for w in words]).tolist(), strict=True))
        for unit, (own, found) in parts.items():
            self.units[unit] = own + sum(map(self.known.__getitem__, found))
            self.held += 2 * len(unit) + ENTRY_BYTES

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        for i0 in range(0, len(texts), 256):
            chunk = [(i, part) for i, t in enumerate(texts[i0 : i0 + 256], i0) for part in pieces(t)]
            split = [(i, part.split(" ")) for i, part in chunk]
            if self.held > CACHE_BYTES:
                self.units, self.known, self.held = {}, {}, 0
            if new := {u for u in set().union(*(u for _, u in split)) if u not in self.units}:
                self.learn(new)
            for i, units in split:
                out[i] += sum(map(self.units.__getitem__, units))
        return out


def pieces(text: str):
    """The text in pieces of bounded length that end at spaces (where no token crosses)."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        end = text.find(" ", start + PIECE_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One counter per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def token_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row of df: a narrow map without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def make():
        bpe = loaded(path)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch.column(1))
            counts = np.array(bpe.count(texts), np.int64)
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

        return each

    return map_rows(df.select(key, text), make, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
