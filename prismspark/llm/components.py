"""Connected components of a table of links, by local contraction and star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_rows

#: Links that one contraction holds.
LOCAL_LINKS = 500_000


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(root, node) of every node other than a root; a root is its component's smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(find(x), x) for x in parent if find(x) != x]


def contracted(links: DataFrame) -> DataFrame:
    """links with each task's own components turned into stars; no shuffle."""

    def run(batches):
        held: list[tuple[int, int]] = []

        def stars():
            found = np.array(forest(held), np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= LOCAL_LINKS:
                yield stars()
        if held:
            yield stars()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every linked node.

    The links of every task are contracted first; then each round hangs each node's larger neighbours below its smallest one
    (large star) and its smaller neighbours, too (small star); the written table ends the lineage of each round.
    """
    pairs = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v")
    # So few links that one task holds them are done in one contraction; more are contracted by as many tasks.
    pieces = -(-pairs.count() // LOCAL_LINKS)
    now = cut(contracted(pairs.coalesce(max(1, pieces))), "links")
    while pieces > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Done when no node hangs below two and no root hangs below another.
        twice = now.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
        if twice.isEmpty() and now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.filter("v > u").join(least, "u").select(F.col("least").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(low, "v").selectExpr("stack(2, least, u, least, v) as (u, v)").filter("u < v").distinct()
        after = cut(contracted(small).distinct(), "links")
        drop(now)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("u").alias("component")))
