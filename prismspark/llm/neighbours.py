"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a vector's cell is its pair of centroids. A query
walks the cells in the order of their summed distances with a heap until the cells hold the wanted share of all
vectors, and the entries of those cells, and of no others, are reranked by exact distance in double precision.

The number of centroids grows with the table: about the square root of its vectors over `CELL_ROWS`, up to
`MOST_CENTROIDS`. They are fitted on a bounded sample (`SAMPLE_ROWS` vectors by a hash of the id). The share to visit is
measured on the whole table: the true neighbours of `PROBES` vectors by brute force, and the smallest share at which
the walk reaches the wanted recall of them. Every vector is indexed.

Equal vectors form one class: distances are computed once per class, and as ties go to the smaller id only a class's
`k` + 1 smallest ids can be in a result. Cells lie in buckets of at most `BLOCK_ROWS` classes; a larger cell is dealt
over several. A query goes once to each bucket that holds a cell it visits, and a task holds one bucket while the
bucket's queries stream past, so that no task's memory grows with the number of queries or of vectors.

Edge cases: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part; repeated ids count as separate candidates, none of them their own neighbour; with fewer
candidates than k a query gets all; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed_sample, join_hot, map_rows

SAMPLE_ROWS, TRAIN_STEPS = 16_384, 12
#: Vectors of a cell aimed at, most centroids of a half, and vectors by which the share to visit is measured.
CELL_ROWS, MOST_CENTROIDS, PROBES = 12, 512, 64
#: Classes of a bucket, and queries compared with them at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 256
#: Tasks over which buckets are dealt at most; a task holds one bucket at a time.
MOST_TASKS = 20_000


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to the centroids."""
        h = self.first.shape[1]
        return squared(x[:, :h], self.first), squared(x[:, h:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's steps; empty ones restart at the farthest vectors."""
    rng = np.random.default_rng(seed)
    unique = np.unique(x, axis=0)
    centre = unique[rng.permutation(len(unique))[:k]].copy()
    for _ in range(TRAIN_STEPS):
        d = squared(x, centre)
        own = d.argmin(1)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        if (empty := np.flatnonzero(count == 0)).size:
            centre[empty] = x[np.argsort(-d.min(1))[: len(empty)]]
    return centre


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of a[i] + b[j] until they hold `wanted` entries: the multi-sequence walk with a heap."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[ia].tolist(), b[ib].tolist()
    ia, ib = ia.tolist(), ib.tolist()
    heap, done, out, seen = [(sa[0] + sb[0], 0, 0)], [0] * len(sa), [], 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = ia[i] * len(sb) + ib[j]
        if counts[cell]:
            out.append(cell)
            seen += counts[cell]
        # A cell enters once both its predecessors have left.
        if i + 1 < len(sa) and done[i + 1] == j:
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < len(sb) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
    return out


def fit(vectors: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 2) -> MultiIndex | None:
    """Centroids for usable(vectors); None if there is none. The sample is bounded, so it may come to the driver."""
    total = vectors.count()
    rows = hashed_sample(vectors, ["id"], sample_rows, seed).select("vector").toArrow()["vector"].combine_chunks()
    if not len(rows):
        return None
    sizes = np.diff(rows.offsets.to_numpy())
    lengths, times = np.unique(sizes, return_counts=True)
    dim = int(lengths[times.argmax()])
    x = matrix(rows.filter(pa.array(sizes == dim)), dim)
    h = max(1, dim // 2)
    centroids = min(MOST_CENTROIDS, max(1, round((total / CELL_ROWS) ** 0.5)), max(1, len(x) // 8))
    return MultiIndex(kmeans(x[:, :h], centroids, seed), kmeans(x[:, h:], centroids, seed + 1) if dim > h else np.zeros((1, 0)))


def usable(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector of the rows that take part, in double precision."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null and vector is not null and size(vector) > 0")
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.filter(fine & F.exists("vector", lambda v: v != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def measured_share(classes: DataFrame, index: MultiIndex, counts: np.ndarray, *, k: int, recall: float, probes: int = PROBES) -> float:
    """The smallest share of all classes at which walks reach `recall` of the probes' true k nearest, found by brute force."""
    dim = index.dim
    chosen = hashed_sample(classes, ["name"], probes, 7).select("name", "vector").toArrow()
    if chosen.num_rows < 2:
        return 1.0
    q, own = matrix(chosen["vector"].combine_chunks(), dim), chosen["name"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, cells = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = squared(q, matrix(batch.column(1), dim))
            names = batch.column(0).to_pylist()
            same = {n: i for i, n in enumerate(own)}
            for j, n in enumerate(names):
                if n in same:
                    d[same[n], j] = np.inf
            d = np.concatenate((near, d), 1)
            c = np.concatenate((cells, np.broadcast_to(batch.column(2).to_numpy(), (len(q), batch.num_rows))), 1)
            best = np.argsort(d, 1, kind="stable")[:, :k]
            near, cells = np.take_along_axis(d, best, 1), np.take_along_axis(c, best, 1)
        probe = np.repeat(np.arange(len(q)), k)
        good = np.isfinite(near.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(probe[good]), pa.array(near.ravel()[good]), pa.array(cells.ravel()[good])], ["probe", "d", "cell"])

    found = classes.select("name", "vector", "cell").mapInArrow(run, "probe long, d double, cell long")
    place = F.row_number().over(Window.partitionBy("probe").orderBy("d", "cell"))
    true = found.withColumn("place", place).filter(F.col("place") <= k).select("probe", "cell").collect()
    a, b = index.halves(q)
    total, needed, reached = int(counts.sum()), [], {}
    for probe, cell in true:
        if probe not in reached:
            order = walk(a[probe], b[probe], counts, total)
            reached[probe] = dict(zip(order, np.cumsum(counts[order]).tolist(), strict=True))
        needed.append(reached[probe][cell] / total)
    return float(np.quantile(needed, recall, method="higher")) if needed else 1.0


def buckets(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each cell: neighbouring cells share one as long as they fit."""
    first, spread = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    at, held = 0, 0
    for c in np.flatnonzero(counts).tolist():
        n = int(counts[c])
        if held and held + n > block_rows:
            at, held = at + 1, 0
        first[c] = at
        if n > block_rows:
            spread[c] = -(-n // block_rows)
            at, held = at + int(spread[c]), 0
        else:
            held += n
    return first, spread


def nearest(df: DataFrame, index: MultiIndex | None = None, *, every: int = 100, k: int = 10, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`. `told` gets the
    number of centroids, of classes and of buckets and the share visited."""
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, key=key, vector=vector)
    index = index or fit(rows)
    if index is None:
        return spark.createDataFrame([], out)
    dim = index.dim

    def place_in_cells():
        def each(batch: pa.RecordBatch):
            # 0.0 and -0.0 are one value, so a class is named by the digest of its normalised components.
            x = matrix(batch.column(1), dim) + 0.0
            names = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(x), pa.int64()), pa.array(names, pa.binary())], ["id", "vector", "cell", "name"])

        return each

    placed = cut(map_rows(rows.filter(F.size("vector") == dim), place_in_cells, "id long, vector array<double>, cell long, name binary"), "vectors")
    first_ids = placed.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("place") <= k + 1)
    classes = cut(first_ids.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("vector", "place").alias("vector"), F.min("cell").alias("cell")), "classes")
    # One number per cell: at most MOST_CENTROIDS squared rows.
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in classes.groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    share = measured_share(classes, index, counts, k=k, recall=recall)
    wanted = max(share * int(counts.sum()), k + 1)
    first, spread = buckets(counts, block_rows)
    if told is not None:
        told.update(centroids=len(index.first), classes=int(counts.sum()), buckets=int((first + spread).max(initial=0)), share=share)
    queries = placed.filter(F.col("id") % every == 0)
    # Walks and buckets cost much more time than their bytes tell, so they are spread by number and not by size.
    asked = queries.repartition(4 * spark.sparkContext.defaultParallelism, "name").groupBy("name").agg(F.min_by("vector", "id").alias("vector"))
    kinds = "bucket int, query boolean, name binary, vector array<double>, cells array<int>, ids array<long>"
    columns = [k.split()[0] for k in kinds.split(", ")]

    def visits():
        def each(batch: pa.RecordBatch):
            a, b = index.halves(matrix(batch.column(1), dim))
            owner, to, seen = [], [], []
            for i in range(batch.num_rows):
                cells = np.array(walk(a[i], b[i], counts, wanted), np.int32)
                cells = cells[np.argsort(first[cells], kind="stable")]
                at, starts = np.unique(first[cells], return_index=True)
                for bucket, own in zip(at.tolist(), np.split(cells, starts[1:]), strict=True):
                    for other in range(int(spread[own].max())):
                        owner.append(i)
                        to.append(bucket + other)
                        seen.append(own)
            take = pa.array(owner, pa.int64())
            none = pa.nulls(len(owner), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(owner)), batch.column(0).take(take), batch.column(1).take(take), pa.array(seen, pa.list_(pa.int32())), none], columns)

        return each

    def entries():
        def each(batch: pa.RecordBatch):
            cell = batch.column(2).to_numpy()
            deal = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)[::2] % spread[cell].astype(np.uint64)
            own = pa.array(cell.astype(np.int32)[:, None].tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + deal.astype(np.int32), pa.int32()), pa.array([False] * len(cell)), *batch.columns[:2], own, batch.column(3)], columns)

        return each

    both = map_rows(classes.select("name", "vector", "cell", "ids"), entries, kinds).unionByName(map_rows(asked.select("name", "vector"), visits, kinds))

    def rerank():
        held: dict = {"bucket": None}

        def load(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts)
            cell = table["cells"].combine_chunks().flatten().to_numpy()
            order = np.argsort(cell, kind="stable")
            names, starts = np.unique(cell[order], return_index=True)
            ids = table["ids"].combine_chunks().take(pa.array(order))
            held["x"] = matrix(table["vector"].combine_chunks(), dim)[order]
            held["spans"] = {int(c): (int(i), int(j)) for c, i, j in zip(names, starts, [*starts[1:], len(cell)], strict=True)}
            held["ids"] = ids.to_pylist()
            held["least"] = np.array([i[0] for i in held["ids"]], np.int64)

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            """The k + 1 nearest of each query among the entries of its cells; distances are computed within those only."""
            q, x = matrix(part.column(3), dim), held["x"]
            names, asking = part.column(2).to_pylist(), {}
            for i, seen in enumerate(part.column(4).to_pylist()):
                for c in seen:
                    if c in held["spans"]:
                        asking.setdefault(c, []).append(i)
            near = np.full((len(q), len(x)), np.inf)
            for c, rows in asking.items():
                i, j = held["spans"][c]
                near[rows, i:j] = squared(q[rows], x[i:j])
            out: list[tuple] = []
            for i in range(len(q)):
                mine = np.flatnonzero(np.isfinite(near[i]))
                if len(mine) > 2 * k + 2:
                    # All that may be among the k + 1 nearest, ties and rounding included, by exact distance.
                    bound = np.partition(near[i, mine], k)[k]
                    mine = mine[near[i, mine] <= bound + 1e-9 * (1 + bound)]
                exact = np.sqrt(((x[mine] - q[i]) ** 2).sum(1))
                out += [(names[i], held["ids"][mine[m]], float(exact[m])) for m in np.lexsort((held["least"][mine], exact))[: k + 1].tolist()]
            found = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.list_(pa.int64())), pa.array(found[2], pa.float64())], ["name", "ids", "score"])

        parts: list[pa.RecordBatch] = []

        def each(batch: pa.RecordBatch):
            bucket, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1).tolist(), len(bucket)]
            for i, j in zip(edges, edges[1:], strict=False):
                if not query[i]:
                    if held["bucket"] != bucket[i]:
                        parts.clear()
                        held["bucket"], held["x"] = bucket[i], None
                    parts.append(batch.slice(i, j - i))
                elif held["bucket"] == bucket[i]:
                    if held["x"] is None:
                        load(parts)
                        parts.clear()
                    for at in range(i, j, BLOCK_QUERIES):
                        yield answer(batch.slice(at, min(BLOCK_QUERIES, j - at)))

        return each

    # Within a bucket entries come first: they are held, and the queries that visit one of its cells stream past.
    dealt = both.repartition(min(MOST_TASKS, int((first + spread).max(initial=1))), "bucket").sortWithinPartitions("bucket", "query")
    close = map_rows(dealt, rerank, "name binary, ids array<long>, score double")
    # Ids of nearer classes first; a query finds itself among them, so k + 1 are enough.
    best = Window.partitionBy("name").orderBy("score", F.col("ids")[0])
    few = close.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    single = few.select("name", "score", F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("score", "vec_id"))).filter(F.col("place") <= k + 1)
    lists = cut(single.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found")), "found")
    answered = join_hot(cut(queries.select("id", "name"), "queries"), lists, "name")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
