"""Joins that depend on order: greedy alignment of frame sequences and pairs of like keypoints inside an image.

One sequence is in a row, and of an image the keypoints with the few neighbours of each: a video's thumbnails and an image's
keypoints are bounded by their makers (frames sampled per video, keypoints per image), not by the size of the collection.
The distances between an image's descriptors, of which there is one a pair, are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions import thresholds as T

#: Descriptors of one block of an image.
BLOCK = 512
MATCH = "struct<idx:bigint,matched:bigint,distance:double,skipped:bigint>"


def align(questioned: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Alignment of sequences (key, idx, frame ARRAY<DOUBLE>): key, status, reason, idx, matched, distance, skipped before the
    match.

    For each questioned frame in order the nearest later reference frame is taken, the first of equals, until none is left:
    a fold over the sequence that holds the last matched place. A key without questioned or without reference frames gives
    one row of status error, one with more questioned than reference frames one of status not_comparable. Frames that are
    null are left out; positions count the rest in the order of idx, equal ones in that of their levels.
    """
    def ordered(side: DataFrame, name: str) -> DataFrame:
        rows = side.filter(F.col("frame").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "frame"))).alias("rows"))
        return rows.select(key, F.transform("rows", lambda r: r["frame"]).alias(name))

    pairs = ordered(questioned, "q").join(ordered(reference, "r"), key, "full_outer")
    n_q, n_r = (F.coalesce(F.size(side), F.lit(0)) for side in "qr")
    n_q, n_r = F.when(F.col("q").isNull(), 0).otherwise(n_q), F.when(F.col("r").isNull(), 0).otherwise(n_r)

    def step(state, frame):
        last = state["last"]
        apart = lambda other: F.aggregate(F.zip_with(other, frame, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(frame)
        later = F.transform(F.slice(F.col("r"), last + 2, F.size("r")), lambda other, j: F.struct(apart(other).alias("distance"), (last + 1 + j).alias("place")))

        def taken(best):
            i = F.size(state["found"])
            match = F.struct(i.cast("bigint").alias("idx"), best["place"].cast("bigint").alias("matched"), best["distance"].alias("distance"), F.when(i == 0, 0).otherwise(best["place"] - last - 1).cast("bigint").alias("skipped"))
            return F.when(best.isNull(), state).otherwise(F.struct(best["place"].alias("last"), F.concat(state["found"], F.array(match)).alias("found")))

        # A list of one binds the best, so that it is looked for once.
        return F.get(F.transform(F.array(F.array_min(later)), taken), F.lit(0))

    start = F.struct(F.lit(-1).alias("last"), F.array().cast(f"array<{MATCH}>").alias("found"))
    status = F.when((n_q == 0) | (n_r == 0), "error").when(n_q > n_r, "not_comparable").otherwise("success")
    reason = F.when(status == "error", "could_not_decode_video").when(status == "not_comparable", "questioned_longer_than_reference")
    found = pairs.select(key, status.alias("status"), reason.alias("reason"), F.when(status == "success", F.aggregate("q", start, step, lambda s: s["found"])).alias("found"))
    return found.select(key, "status", "reason", F.explode_outer("found").alias("m")).select(key, "status", "reason", "m.idx", "m.matched", "m.distance", "m.skipped")


def apart(a: Column, b: Column) -> Column:
    """Bits in which two descriptors (arrays of 64-bit words) differ."""
    return F.aggregate(F.zip_with(a, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, n: s + n)


def neighbours(keypoints: DataFrame, key: str, *, nearest: int = 5, most: int = T.HAMMING, block: int = BLOCK) -> DataFrame:
    """key, place (from 0, in the order of kp), kp, x, y, near: of every keypoint (key, kp, x, y, words ARRAY<BIGINT>) its
    `nearest` ones of the same image, itself among them, that differ in at most `most` bits: structs d, place, x, y, the
    nearest first and equals by place.

    Distances are of all pairs of an image, as the rule asks; an image of more than `block` keypoints is split into blocks
    of about that size, and each pair of blocks is one part of the join, so that a large image is many tasks' work. A task
    holds one block. Only the nearest of a block are passed on.
    """
    whole = keypoints.select(key, "kp", "x", "y", "words").dropna()
    placed = whole.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("kp", "x", "y", "words")) - 1)
    blocks = F.ceil(F.count("*").over(Window.partitionBy(key)) / block).cast("int")
    dealt = placed.withColumn("blocks", blocks).withColumn("mine", (F.col("place") % F.col("blocks")).cast("int"))
    point = F.struct("place", "x", "y", "words")
    others = dealt.groupBy(key, "blocks", F.col("mine").alias("theirs")).agg(F.collect_list(point).alias("points"))
    # A copy of each block for each block of those that look for neighbours.
    others = others.select(key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"), "points")

    def close(points: Column) -> Column:
        listed = F.transform(points, lambda p: F.struct(apart(p["words"], F.col("words")).alias("d"), p["place"].alias("place"), p["x"].alias("x"), p["y"].alias("y")))
        return F.slice(F.sort_array(F.filter(listed, lambda c: c["d"] <= most)), 1, nearest)

    found = dealt.join(others, [key, "mine"]).select(key, "place", "kp", "x", "y", close(F.col("points")).alias("near"))
    return found.groupBy(key, "place", "kp", "x", "y").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, nearest).alias("near"))


def within(keypoints: DataFrame, key: str, *, nearest: int = 5, most: int = T.HAMMING) -> DataFrame:
    """key and points, an array of place, x, y, near in the order of place, with the keypoints and rule of neighbours(), for
    images that are small enough for one task each: keypoints are moved once and compared inside the image's row."""
    whole = keypoints.select(key, "kp", "x", "y", "words").dropna()
    images = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "words"))).alias("points"))

    def close(p: Column) -> Column:
        listed = F.transform("points", lambda q, j: F.struct(apart(q["words"], p["words"]).alias("d"), j.alias("place"), q["x"].alias("x"), q["y"].alias("y")))
        return F.slice(F.sort_array(F.filter(listed, lambda c: c["d"] <= most)), 1, nearest)

    return images.select(key, F.transform("points", lambda p, i: F.struct(i.alias("place"), p["x"].alias("x"), p["y"].alias("y"), close(p).alias("near"))).alias("points"))


def gathered(found: DataFrame, key: str) -> DataFrame:
    """The rows of neighbours() as those of within()."""
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y", "near"))).alias("points"))


def pairs_of(found: DataFrame, key: str, *, distance: float = T.DISTANCE_PX) -> DataFrame:
    """key, first, second (places), hamming, dx, dy: per keypoint in order the first of its neighbours that is far enough and
    not yet paired with it; the shift points right, or down if it is upright.

    Whether a pair is taken depends on what keypoints before took: a fold over an image's keypoints, with at most `nearest`
    neighbours of each, that holds what each took.
    """
    return pairs_inside(gathered(found, key), key, distance=distance)


def pairs_inside(points: DataFrame, key: str, *, distance: float = T.DISTANCE_PX) -> DataFrame:
    """pairs_of() for rows of within()."""

    def step(taken: Column, p: Column) -> Column:
        # A neighbour before this keypoint that took it is paired with it already.
        free = lambda c: (c["place"] != p["place"]) & (F.hypot(c["x"] - p["x"], c["y"] - p["y"]) >= distance) & ~((c["place"] < p["place"]) & F.coalesce(F.get(taken, c["place"])["place"] == p["place"], F.lit(False)))
        return F.concat(taken, F.array(F.get(F.filter(p["near"], free), F.lit(0))))

    nothing = F.array().cast("array<struct<d:int,place:int,x:double,y:double>>")
    rows = points.select(key, F.explode(F.arrays_zip("points", F.aggregate("points", nothing, step).alias("taken"))).alias("r")).filter("r.taken IS NOT NULL")
    dx, dy = (F.col(f"r.taken.{c}") - F.col(f"r.points.{c}") for c in "xy")
    sign = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    return rows.select(key, F.col("r.points.place").alias("first"), F.col("r.taken.place").alias("second"), F.col("r.taken.d").alias("hamming"), (dx * sign).alias("dx"), (dy * sign).alias("dy"))


def copy_move(keypoints: DataFrame, key: str, *, block: int = BLOCK) -> DataFrame:
    """Translations within images of keypoints (key, kp, x, y, words ARRAY<BIGINT>), at most 25 of each image by rank.

    Images with no pair give no row. Keypoints with a null part are left out. Images of up to `block` keypoints are compared
    inside their row; larger ones, which a count finds, by pairs of blocks.
    """
    typed = keypoints.select(key, "kp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "words").dropna()
    large = typed.groupBy(key).count().filter(F.col("count") > block).select(key)
    if large.isEmpty():
        return translations(pairs_inside(within(typed, key), key), key)
    small = within(typed.join(large, key, "left_anti"), key)
    split = gathered(neighbours(typed.join(large, key, "left_semi"), key, block=block), key)
    return translations(pairs_inside(small.unionByName(split), key), key)


def copy_move_scores(clusters: DataFrame, key: str, enough: int = 20) -> DataFrame:
    """key, suspicious_pairs, suspicious_clusters, score (the pairs' share of `enough`, at most 1) and the dominant translation,
    that of the first suspicious cluster, of translations()."""
    marked = F.col("suspicious")
    found = clusters.groupBy(key).agg(F.coalesce(F.sum(F.when(marked, F.col("n"))), F.lit(0)).alias("suspicious_pairs"), F.count_if(marked).alias("suspicious_clusters"), F.min_by(F.when(marked, F.struct("dx", "dy")), F.when(marked, F.col("place"))).alias("dominant"))
    return found.select(key, "suspicious_pairs", "suspicious_clusters", F.least(F.lit(1.0), F.col("suspicious_pairs") / enough).alias("score"), F.col("dominant.dx").alias("dominant_dx"), F.col("dominant.dy").alias("dominant_dy"))


def translations(pairs: DataFrame, key: str) -> DataFrame:
    """Clusters of displacements in bins of 8 pixels, ranked by suspicion, size and likeness."""
    bins = pairs.groupBy(key, F.rint(F.col("dx") / T.BIN_PX).cast("bigint").alias("bin_x"), F.rint(F.col("dy") / T.BIN_PX).cast("bigint").alias("bin_y")).agg(
        F.count("*").alias("n"), F.avg("hamming").alias("mean_hamming"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.hypot(F.stddev_pop("dx"), F.stddev_pop("dy")).alias("spread")
    )
    marked = bins.withColumn("suspicious", (F.col("n") >= T.CLUSTER_N) & (F.col("mean_hamming") <= T.CLUSTER_HAMMING) & (F.col("spread") <= T.CLUSTER_STD))
    order = Window.partitionBy(key).orderBy(F.desc("suspicious"), F.desc("n"), "mean_hamming", "bin_x", "bin_y")
    return marked.withColumn("place", F.row_number().over(order)).filter("place <= 25")
