"""MinHash near-duplicates with an LSH forest.

A document is the set of its distinct shingles of five words. Documents with equal sets are one class; classes get
MinHash signatures that are sorted in several orders (trees). In each order, neighbours with a common prefix of at
least REGION values are candidates; links are confirmed on full sets. What then remains is searched by regions, the
classes that share a prefix: a region of many rows is first descended to the depth at which its parts are small, so
that a crowd of near copies joins cheaply, and then every region is searched whole at REGION values, at every size.

A region is searched between components only. First its signatures are compared, and only classes with a partner whose
signature agrees within DEVIATIONS stay; then their full sets are, whatever their size, in slices of bounded bytes.
A task returns no more links than join the components it holds, so a large group of near copies costs no pairs of its
own. Rows outside a region's most frequent component are held against all of it.

Edge cases: texts without words or null have no shingles and are linked with nothing; texts of fewer than five words
are one shingle, the whole sequence; rows that share a doc_id are one node; rows without doc_id take no part and are
kept; other columns are not read; an empty table gives an empty table. Texts of any length are used whole. Pairs are
missed by chance only where they share no region in any order or their signatures agree too little (see MISSED and
DEVIATIONS); no bound on rows, sizes or partners drops any.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, join_hot, map_rows, mix64, small_or_not
from .components import components

#: Values of an order; at most so many are the common prefix of a region; words of a shingle.
DEPTH, REGION, WORDS = 8, 3, 5
#: Share of pairs of exactly the wanted similarity that may share no region in any order, and orders up to which that is
#: reached by more orders before it is by a shorter prefix.
MISSED, MOST_TREES = 1 / 90_000, 24
#: Deviations under the wanted similarity to which the agreement of signatures may fall before a pair is not tested.
DEVIATIONS = 5
#: Rows of a region above which it is descended first; classes and shingles (8 bytes each) of a slice. A set is never cut.
DENSE_ROWS, SLICE_ROWS, SLICE_ITEMS = 2000, 2000, 1_000_000
#: Ids up to which the documents to confirm are picked by broadcast (8 bytes each); regions up to which they are (50 bytes each).
BROADCAST_IDS, BROADCAST_REGIONS = 500_000, 100_000
#: Word hashes (about 100 bytes each) and shingles (8 bytes each) that a worker keeps.
KNOWN_WORDS, KNOWN_SHINGLES = 200_000, 2_000_000


def shape(percent: int) -> tuple[int, int]:
    """Orders and values of a region's prefix for a similarity: 12 and 3 at 85 %, 16 and 3 at 80 %."""
    for region in range(REGION, 0, -1):
        trees = max(1, math.ceil(math.log(MISSED) / math.log(max(1e-9, 1 - (percent / 100) ** region))))
        if trees <= MOST_TREES:
            break
    return trees, region


@functools.cache
def functions(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4)
    xor = rng.integers(0, 1 << 63, trees * DEPTH, dtype=np.uint64)
    return xor, rng.integers(0, 1 << 63, trees * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; bytes.lower and bytes.split know ASCII only, as is wanted."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n])
    return np.unique(out)


def signature(items: np.ndarray, trees: int = 12) -> bytes:
    """Sixteen bits of the smallest hash of the set under each of trees * DEPTH functions."""
    xor, odd = functions(trees)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        least = np.minimum(least, ((items[None, i : i + 2048] ^ xor[:, None]) * odd[:, None]).min(1))
    # The bytes are big-endian, so that sorting them sorts the values.
    return (mix64(least) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(docs: DataFrame, trees: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, n_shingles, digest of the set, signature: a narrow row per document."""

    def make():
        def each(batch: pa.RecordBatch):
            sizes, digests, signatures = [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                items = shingles(raw or b"")
                sizes.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                signatures.append(signature(items, trees) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["node", "n_shingles", "digest", "signature"])

        return each

    return map_rows(docs.select(F.col(key).cast("long"), text), make, "node long, n_shingles long, digest binary, signature binary")


def orders(classes: DataFrame, trees: int) -> DataFrame:
    """tree, path (the signature's values of that tree), node, n_shingles: as many short rows per class as trees."""
    each = F.posexplode(F.array(*(F.substring("signature", 2 * DEPTH * t + 1, 2 * DEPTH) for t in range(trees)))).alias("tree", "path")
    return classes.select("node", "n_shingles", each)


def prefix(depth: int) -> F.Column:
    return F.substring("path", 1, 2 * depth)


def neighbours(rows: DataFrame, percent: int, region: int) -> DataFrame:
    """a, b, shared: the nearest in sorted order with a common prefix of `region` values; sizes must allow a link."""

    def make():
        last: list[tuple] = []

        def each(batch: pa.RecordBatch):
            out = []
            for tree, path, node, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for t, p, m, k in last:
                    if t == tree and p[: 2 * region] == path[: 2 * region] and m != node and min(n, k) * 100 >= percent * max(n, k):
                        shared = region
                        while shared < DEPTH and p[2 * shared : 2 * shared + 2] == path[2 * shared : 2 * shared + 2]:
                            shared += 1
                        out.append((min(m, node), max(m, node), shared))
                last.append((tree, path, node, n))
                if len(last) > 2:
                    del last[0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "shared"])

        return each

    # A range sort splits runs of any length evenly; pairs at its seams are found in other orders or by regions().
    in_order = rows.select("tree", "path", "node", "n_shingles").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = map_rows(in_order, make, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    best = Window.partitionBy("a").orderBy(F.col("shared").desc(), "b")
    return found.withColumn("place", F.row_number().over(best)).filter("place <= 2").select("a", "b")


def descended(placed: DataFrame, region: int, dense_rows: int) -> DataFrame | None:
    """The rows of regions of more than dense_rows rows, with a longer prefix as their region: for each of them the
    shortest at which none of its parts has more rows (all values, if there is none). None without such regions."""
    dense = placed.groupBy("tree", prefix(region).alias("whole")).agg(F.count("*").alias("n")).filter(F.col("n") > dense_rows).select("tree", "whole")
    dense = cut(dense, "dense")
    if dense.isEmpty():
        return None
    inside = placed.withColumn("whole", prefix(region)).join(small_or_not(dense, BROADCAST_REGIONS), ["tree", "whole"])
    paths = inside.groupBy("tree", "whole", "path").agg(F.count("*").alias("n")).withColumn("depth", F.explode(F.sequence(F.lit(region + 1), F.lit(DEPTH))))
    parts = paths.groupBy("tree", "whole", "depth", F.expr("substring(path, 1, 2 * depth)").alias("part")).agg(F.sum("n").alias("n"))
    levels = parts.groupBy("tree", "whole", "depth").agg(F.max("n").alias("n")).groupBy("tree", "whole").agg(F.coalesce(F.min(F.when(F.col("n") <= dense_rows, F.col("depth"))), F.lit(DEPTH)).alias("depth"))
    return inside.join(small_or_not(cut(levels, "levels"), BROADCAST_REGIONS), ["tree", "whole"]).withColumn("region", F.expr("substring(path, 1, 2 * depth)")).drop("whole", "depth")


def sliced(rows: DataFrame, slice_rows: int, slice_items: int | None = None) -> DataFrame:
    """rows (tree, region, node, n_shingles, component) of regions that hold several components, with the region's most
    frequent component (top), dealt over pairs of slices i and j.

    Within the most frequent component of a region nothing is compared. Rows outside it are dealt over pairs of their
    slices and over pairs with the slices of that component, which are numbered after theirs; a row of that component
    is copied only as often as there are slices outside it. A region of one slice is one task."""
    counts = rows.groupBy("tree", "region", "component").agg(F.count("*").alias("own"), F.sum("n_shingles").alias("items"))
    found = counts.groupBy("tree", "region").agg(F.sum("own").alias("n"), F.sum("items").alias("all_items"), F.max(F.struct("own", "component", "items")).alias("most")).filter("most.own < n")

    def slices(n: F.Column, items: F.Column) -> F.Column:
        return F.greatest(F.ceil(n / F.lit(slice_rows)), F.ceil(items / F.lit(slice_items)) if slice_items else F.lit(1)).cast("int")

    rest, rest_items = F.col("n") - F.col("most.own"), F.col("all_items") - F.col("most.items")
    found = found.select("tree", "region", F.col("most.component").alias("top"), slices(rest, rest_items).alias("rares"), F.when(slices(F.col("n"), F.col("all_items")) > 1, slices(F.col("most.own"), F.col("most.items"))).otherwise(0).cast("int").alias("tops"))
    rows = rows.join(small_or_not(cut(found, "regions"), BROADCAST_REGIONS), ["tree", "region"])
    rare = F.col("component") != F.col("top")
    own = F.when(rare, F.pmod(F.xxhash64("node"), F.col("rares"))).when(F.col("tops") > 0, F.col("rares") + F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(0).cast("int")
    others = F.sequence(F.lit(0), F.when(rare, F.col("rares") + F.col("tops")).otherwise(F.col("rares")) - 1)
    dealt = rows.withColumn("slice", own).withColumn("other", F.explode(others))
    return dealt.withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")}).select("tree", "region", "i", "j", "slice", "node", "n_shingles", "component", "top")


def lowest_agreement(percent: int, values: int) -> float:
    share = percent / 100
    return share - DEVIATIONS * math.sqrt(share * (1 - share) / values)


def partners(x: int, node: np.ndarray, size: np.ndarray, joined: np.ndarray, rare: np.ndarray, part: np.ndarray | None, sig: np.ndarray, percent: int, agree: float) -> np.ndarray:
    """Rows of other components that x, outside the most frequent one, may be linked with by size and signature.
    Of two rows outside it one is x; with part, only pairs across two slices count."""
    y = (joined != joined[x]) & (np.minimum(size, size[x]) * 100 >= percent * np.maximum(size, size[x])) & (~rare | (node > node[x]))
    if part is not None:
        y &= part != part[x]
    y = np.flatnonzero(y)
    return y[(sig[y] == sig[x]).mean(1) >= agree] if len(y) else y


def read_slices(table: pa.Table) -> tuple:
    node, size, component, part = (table[c].to_numpy() for c in ("node", "n_shingles", "component", "slice"))
    i, j, top = (table[c][0].as_py() for c in ("i", "j", "top"))
    return node, size, component, component != top, part if i != j else None, np.frombuffer(b"".join(table["signature"].to_pylist()), ">u2").reshape(len(node), -1)


def screened(mixed: DataFrame, signatures: DataFrame, percent: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """tree, region, node: the rows of regions that have a partner of another component by size and signature."""

    def find(table: pa.Table) -> pa.Table:
        node, size, component, rare, part, sig = read_slices(table)
        agree, good = lowest_agreement(percent, sig.shape[1]), np.zeros(len(node), bool)
        for x in np.flatnonzero(rare).tolist():
            if len(y := partners(x, node, size, component, rare, part, sig, percent, agree)):
                good[x] = good[y] = True
        return table.select(["tree", "region", "node"]).filter(pa.array(good))

    dealt = sliced(mixed, slice_rows).join(signatures, ["node", "n_shingles"])
    return dealt.groupBy("tree", "region", "i", "j").applyInArrow(find, "tree int, region binary, node long").distinct()


def full_sets(nodes: DataFrame, docs: DataFrame, trees: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, n_shingles, signature, items (the whole sorted set) of the documents among nodes, once for equal sets."""

    def make():
        def each(batch: pa.RecordBatch):
            held = [shingles(raw or b"") for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(items.tobytes(), digest_size=16).digest() for items in held]
            signatures = [signature(items, trees) if len(items) else None for items in held]
            # Few at a time: the sets of a batch of long texts are large.
            for i in range(0, len(held), 64):
                part = slice(i, i + 64)
                columns = [batch.column(0)[i : i + 64], pa.array([len(x) for x in held[part]], pa.int64()), pa.array(digests[part], pa.binary()), pa.array(signatures[part], pa.binary()), pa.array([x.tobytes() for x in held[part]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n_shingles", "digest", "signature", "items"])

        return each

    picked = docs.select(F.col(key).cast("long").alias("node"), text).join(small_or_not(nodes, BROADCAST_IDS), "node", "left_semi")
    return map_rows(picked, make, "node long, n_shingles long, digest binary, signature binary, items binary").filter("n_shingles > 0")


def crossing(mixed: DataFrame, sets: DataFrame, percent: int, slice_rows: int = SLICE_ROWS, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """a, b: links of a region between different components, tested on full sets. Of its links a task returns those that
    join components it had not joined yet, so fewer than it has components."""

    def make_links(table: pa.Table) -> pa.Table:
        node, size, component, rare, part, sig = read_slices(table)
        items = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        agree = lowest_agreement(percent, sig.shape[1])
        names, ids = np.unique(np.concatenate(items), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(size)))
        marks = np.zeros(len(names), bool)
        joined = component.copy()  # components with the links found in this task
        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(rare).tolist():
            y = partners(x, node, size, joined, rare, part, sig, percent, agree)
            if not len(y):
                continue
            mine = ids[starts[x] : starts[x + 1]]
            marks[mine] = True
            for k in y.tolist():
                if joined[k] == joined[x]:
                    continue
                both = int(marks[ids[starts[k] : starts[k + 1]]].sum())
                if 100 * both >= percent * (int(size[x]) + int(size[k]) - both):
                    out.append((int(node[x]), int(node[k])))
                    joined[joined == joined[k]] = joined[x]
            marks[mine] = False
        a, b = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = sliced(mixed, slice_rows, slice_items).join(sets, ["node", "n_shingles"])
    return dealt.groupBy("tree", "region", "i", "j").applyInArrow(make_links, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """pairs whose full shingle sets are similar enough. Texts travel compressed; only those of the pairs do, each pair of
    different texts of two ids in a row of its own."""
    wanted = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")

    def packed():
        tool = zstandard.ZstdCompressor(level=3)

        def each(batch: pa.RecordBatch):
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = [hashlib.blake2b(t, digest_size=16).digest() for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array([tool.compress(t) for t in raw], pa.binary())], ["node", "name", "body"])

        return each

    picked = docs.select(F.col(key).cast("long").alias("node"), text).join(small_or_not(wanted, BROADCAST_IDS), "node", "left_semi")
    bodies = cut(map_rows(picked, packed, "node long, name binary, body binary").dropDuplicates(["node", "name"]), "bodies")
    both = pairs.join(bodies.withColumnsRenamed({"node": "a", "name": "name_a", "body": "body_a"}), "a").join(bodies.withColumnsRenamed({"node": "b", "name": "name_b", "body": "body_b"}), "b")

    def test():
        tool, recent, held = zstandard.ZstdDecompressor(), {}, [0]

        def items_of(name: bytes, body: bytes) -> np.ndarray:
            if name not in recent:
                found = shingles(tool.decompress(body))
                if held[0] + len(found) > KNOWN_SHINGLES:
                    recent.clear()
                    held[0] = 0
                recent[name] = found
                held[0] += len(found)
            return recent[name]

        def each(batch: pa.RecordBatch):
            names_a, bodies_a, names_b, bodies_b = (c.to_pylist() for c in batch.columns[2:])
            good = [similar(items_of(m, s), items_of(n, t), percent) for m, s, n, t in zip(names_a, bodies_a, names_b, bodies_b, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return each

    return map_rows(both.select("a", "b", "name_a", "body_a", "name_b", "body_b"), test, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 85, dense_rows: int = DENSE_ROWS, slice_rows: int = SLICE_ROWS, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """key, n_shingles, component_id, kept of every row of docs."""
    trees, region = shape(percent)
    found = cut(signed(docs, trees, key=key, text=text), "signed")
    members = found.filter("node is not null and n_shingles > 0")
    classes = cut(members.groupBy("digest").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    rows = cut(orders(classes, trees), "orders")
    tested = cut(neighbours(rows, percent, region), "pairs")
    links = cut(confirmed(tested, docs, percent, key=key, text=text), "confirmed")
    # Ids whose rows hold different sets join the classes of all their rows.
    several = cut(members.groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("node"), "several")
    if not several.isEmpty():
        owners = members.join(small_or_not(several, BROADCAST_IDS), "node").join(classes.select("digest", F.col("node").alias("b")), "digest")
        links = links.unionByName(cut(owners.select(F.col("node").alias("a"), "b").filter("a <> b").distinct(), "same-id"))
    signatures = classes.select("node", "n_shingles", "signature")
    parts = cut(components(links), "components")
    for whole in (False, True):
        placed = rows.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        at = placed.withColumn("region", prefix(region)) if whole else descended(placed, region, dense_rows)
        if at is None:
            continue
        at = cut(at.select("tree", "region", "node", "n_shingles", "component"), "regions")
        some = cut(screened(at, signatures, percent, slice_rows), "screened")
        if some.isEmpty():
            continue
        sets = cut(full_sets(some.select("node").distinct(), docs, trees, key=key, text=text).dropDuplicates(["node", "digest"]).drop("digest"), "sets")
        crossed = cut(crossing(at.join(some, ["tree", "region", "node"], "left_semi"), sets, percent, slice_rows, slice_items), "crossed")
        links = links.unionByName(crossed)
        parts = cut(components(links), "components")
        for done in (at, some, sets):
            drop(done)
    named = cut(classes.select("digest", "node").join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "named")
    linked = join_hot(members.select("node", "n_shingles", "digest"), named, "digest").select("node", "n_shingles", "component_id")
    alone = found.filter("node is null or n_shingles = 0").select("node", "n_shingles", F.col("node").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("node").alias(key), "n_shingles", "component_id", F.coalesce(F.col("node") == F.col("component_id"), F.lit(True)).alias("kept"))
