"""Screens of ordered frames by window functions: (video, idx, pts, kind, frame ARRAY<DOUBLE> of grey levels 0 to 255).

Null times and frames give null gaps and changes, which raise nothing. A video of one frame has no transition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions import thresholds as T


def transitions(frames: DataFrame) -> DataFrame:
    """Each frame but the first of a video: change from its predecessor, duplicate and anomaly marks."""
    order, whole = Window.partitionBy("video").orderBy("idx"), Window.partitionBy("video")
    change = F.aggregate(F.zip_with("frame", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("frame"), F.lit(0))
    steps = frames.withColumn("before", F.lag("frame").over(order)).withColumn("place", F.row_number().over(order)).filter("place > 1").select("video", "idx", change.alias("change"))
    mid = steps.withColumn("mid", F.median("change").over(whole))
    spread = mid.withColumn("spread", F.median(F.abs(F.col("change") - F.col("mid"))).over(whole))
    # The floor is stated for levels of 0 to 1.
    limit = F.greatest(F.lit(T.TRANSITION_FLOOR * 255), F.col("mid") + T.ROBUST_SIGMA * T.MAD_SCALE * F.col("spread"))
    return spread.select("video", "idx", "change", limit.alias("threshold"), (F.col("change") <= T.DUPLICATE_MAD).alias("duplicate"), (F.col("change") >= limit).alias("anomaly"))


def timing(frames: DataFrame) -> DataFrame:
    """Per video: readable times, key frames, upper median of the steps, and the steps above 1.8 times it."""
    order = Window.partitionBy("video").orderBy("idx")
    timed = frames.filter("pts IS NOT NULL").withColumn("step", F.col("pts") - F.lag("pts").over(order)).withColumn("position", F.row_number().over(order) - 2)
    ranked = Window.partitionBy("video").orderBy("step", "position")
    steps = timed.filter("step IS NOT NULL").withColumn("place", F.row_number().over(ranked) - 1).withColumn("n", F.count("*").over(Window.partitionBy("video")))
    usual = F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("step"))).over(Window.partitionBy("video"))
    marked = steps.withColumn("usual", usual).withColumn("gap", (F.col("n") >= 2) & (F.col("usual") > 0) & (F.col("step") > T.GAP_FACTOR * F.col("usual")))
    gaps = marked.groupBy("video").agg(F.max("usual").alias("usual_step"), F.array_sort(F.collect_list(F.when(F.col("gap"), F.col("position")))).alias("gaps"))
    counts = frames.groupBy("video").agg(F.count("pts").alias("times"), F.count_if(F.col("kind") == "I").alias("key_frames"))
    return counts.join(gaps, "video", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<int>")))


def motion(flows: DataFrame) -> DataFrame:
    """Frames (video, idx, flow) whose given mean flow stands out upwards; the flow itself comes from outside."""
    whole = Window.partitionBy("video")
    mid = flows.filter("flow IS NOT NULL").withColumn("mid", F.median("flow").over(whole))
    spread = mid.withColumn("spread", F.median(F.abs(F.col("flow") - F.col("mid"))).over(whole))
    z = (F.col("flow") - F.col("mid")) / (T.MAD_SCALE * F.col("spread") + 1e-12)
    return spread.select("video", "idx", "flow", z.alias("z"), (z >= T.MOTION_Z).alias("discontinuity"))


def summary(frames: DataFrame) -> DataFrame:
    """Per video: transitions, duplicates, anomalies, gaps, the first 12 marked frames and the triage."""
    steps = transitions(frames)
    marked = F.when(F.col("duplicate") | F.col("anomaly"), F.col("idx"))
    found = steps.groupBy("video").agg(
        F.count("change").alias("transitions"), F.median("change").alias("median_change"), F.count_if("duplicate").alias("duplicates"),
        F.count_if("anomaly").alias("anomalies"), F.slice(F.array_sort(F.collect_list(marked)), 1, 12).alias("keyframes"),
    )
    joined = timing(frames).join(found, "video", "left").fillna(0, ["transitions", "duplicates", "anomalies"])
    signals = F.col("duplicates") + F.col("anomalies") + F.size("gaps")
    return joined.withColumn("triage", F.when(signals > 0, "needs_expert_review").otherwise("no_strong_screening_signals")).withColumn("evidentiary_conclusion", F.lit("inconclusive"))


def sampled(frames: DataFrame, samples: int = 24) -> DataFrame:
    """Evenly spaced frames of each video (video, idx from 0, ...), first and last included."""
    last = F.max("idx").over(Window.partitionBy("video"))
    taken = F.least(F.lit(samples), last + 1)
    return frames.withColumn("taken", taken).withColumn("last", last).withColumn("wanted", F.transform(F.sequence(F.lit(0), F.col("taken") - 1), lambda k: F.when(F.col("taken") == 1, 0).otherwise(F.floor(k * F.col("last") / (F.col("taken") - 1))).cast("long"))).filter(F.array_contains("wanted", F.col("idx").cast("long"))).drop("taken", "last", "wanted")


def video_screen(rows: DataFrame) -> DataFrame:
    """Per video (video, ratio: high to low frequency energy, sharpness and luminance of the largest face or null): variation
    over its sampled frames, flags and triage. A mean of zero gives its own floor, no frames with a face give null."""
    def variation(name: str) -> F.Column:
        return F.stddev_pop(name) / (F.avg(name) + 1e-12)

    found = rows.groupBy("video").agg(
        F.count("*").alias("sampled_frames"), F.count("sharpness").alias("frames_with_face"), variation("sharpness").alias("face_sharpness_cv"),
        variation("luminance").alias("face_luminance_cv"), variation("ratio").alias("spectral_ratio_cv"),
    )
    # Names of the flags.
    flags = F.array_compact(F.array(F.when(F.col("face_sharpness_cv") > T.SHARPNESS_CV, "large_face_texture_sharpness_variation"), F.when(F.col("spectral_ratio_cv") > T.DCT_RATIO_CV, "large_sampled_frequency_variation")))
    judged = found.withColumn("screening_flags", flags)
    return judged.withColumn("triage", F.when(F.size("screening_flags") > 0, "needs_expert_review").otherwise("no_strong_screening_signals")).withColumn("evidentiary_conclusion", F.lit("inconclusive"))
