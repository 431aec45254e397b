"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document gets the key u ** (1 / weight), u a repeatable uniform number from its id and text. Each source first
takes whole epochs of all its documents; the rest of its word budget goes to the documents with the largest keys.
Keys fall into fixed buckets; sizes are summed per source and bucket, and only the bucket in which a budget ends
is sorted, so that a source of any size needs neither a sort nor a task of its own.

Edge cases: null and empty texts have size 0 and are repeated as often as their source's whole epochs; null sources
are one source, the last; equal rows get equal keys and are taken one by one in any order; an empty table gives an
empty table. Columns of the input are carried along; those named as a result (size, source_size, target, copies, taken)
or with the prefix mix_ are replaced. The weight is a parameter; the default one is a share of noise symbols, which
SQL can state, and any column with a better score can take its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_or_not, word_count

BUCKETS = 1 << 16
#: Sources up to which their plan is broadcast (a few dozen bytes each).
BROADCAST_SOURCES = 100_000
NOISE = "#$%&*|!~^<>{}[]"
RESULTS = ("size", "source_size", "target", "copies", "taken")


def quality_weight(text: str) -> F.Column:
    """1 for clean text, down to 0.25 as symbols other than letters, digits and punctuation grow to a tenth of it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    noise = (F.length(whole) - F.length(F.translate(whole, NOISE, ""))).cast("double") / F.greatest(F.length(whole), F.lit(1)).cast("double")
    return F.lit(0.25) + F.lit(0.75) * (F.lit(1.0) - F.least(F.lit(1.0), F.lit(10.0) * noise))


def scored(df: DataFrame, *, key: str = "doc_id", text: str = "text", weight: F.Column | None = None) -> DataFrame:
    """df with mix_size, mix_hash and mix_key."""
    hashed = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))
    out = df.withColumn("mix_weight", quality_weight(text) if weight is None else weight).drop(*RESULTS, *(c for c in df.columns if c.startswith("mix_") and c != "mix_weight"))
    out = out.withColumns({"mix_size": word_count(text), "mix_hash": hashed})
    uniform = (F.conv(F.substring("mix_hash", 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return out.withColumn("mix_key", F.pow(uniform, F.lit(1.0) / F.col("mix_weight"))).drop("mix_weight")


def bucket() -> F.Column:
    return F.floor(F.lit(float(BUCKETS)) * (F.lit(1.0) - F.col("mix_key"))).cast("int")


def source_targets(sizes: DataFrame, *, source: str = "source", cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size: shares by weight, none above cap times its size.

    Sources in order of cap / weight are full up to the first whose share of what is left stays under its cap.
    One short row per source is sorted in one place.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weights = F.element_at(F.array(*(F.lit(w) for w in cycle)), F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1)
    table = sizes.withColumn("weight", weights.cast("long")).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("level", F.col(source).asc_nulls_last())
    table = table.withColumns(
        {
            "full_before": F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    )
    table = table.withColumn("water", (F.lit(share) * F.col("total") - F.col("full_before")) / F.col("weight_left"))
    water = F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(Window.partitionBy())["water"]
    return table.withColumn("target", F.least(F.col("most"), F.coalesce(water, F.lit(0.0)) * F.col("weight"))).select(source, "source_size", "target")


def plan(found: DataFrame, *, source: str = "source", **shares) -> DataFrame:
    """A row per source: its target, whole epochs, what is left for a part epoch, and the bucket where that ends."""
    sums = found.groupBy(F.col(source).alias("mix_source"), bucket().alias("mix_bucket")).agg(F.sum("mix_size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("mix_source").agg(F.sum("bucket_size").alias("source_size")), source="mix_source", **shares)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("so_far", F.sum("bucket_size").over(run)).withColumnRenamed("mix_source", "its_source")
    ends = ends.join(F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets, F.col("its_source").eqNullSafe(F.col("mix_source")))
    last = F.min(F.when(F.col("so_far") > F.col("rest"), F.struct("mix_bucket", (F.col("so_far") - F.col("bucket_size")).alias("before"))))
    ends = ends.groupBy("mix_source", "source_size", "target", "epochs", "rest").agg(last.alias("last"))
    return ends.select("mix_source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("epochs").alias("mix_epochs"), F.col("rest").alias("mix_rest"), F.col("last.mix_bucket").alias("mix_last"), F.col("last.before").alias("mix_before"))


def apply_mix(found: DataFrame, plans: DataFrame, *, source: str = "source") -> DataFrame:
    """found with size, source_size, target, copies and taken. found and plans should be written or cheap to read again."""
    columns = [c for c in found.columns if not c.startswith("mix_")]
    joined = found.withColumn("mix_bucket", bucket()).join(small_or_not(plans, BROADCAST_SOURCES), F.col(source).eqNullSafe(F.col("mix_source")))
    ends_here = F.coalesce(F.col("mix_bucket") == F.col("mix_last"), F.lit(False))
    clear = joined.filter(~ends_here).withColumn("mix_part", F.coalesce((F.col("mix_bucket") < F.col("mix_last")), F.lit(True)))
    order = Window.partitionBy("mix_source").orderBy(F.col("mix_key").desc(), "mix_hash").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("mix_before") + F.sum("mix_size").over(order) - F.col("mix_size") / F.lit(2.0)
    out = clear.unionByName(joined.filter(ends_here).withColumn("mix_part", middle <= F.col("mix_rest")))
    copies = F.col("mix_epochs") + (F.col("mix_part") & (F.col("mix_size") > 0)).cast("int")
    return out.select(*columns, F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), copies.alias("copies"), (copies * F.col("mix_size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h FROM documents),
k AS (
  SELECT doc_id, source, size, h,
    pow((('0x' || substr(h, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE, 1.0::DOUBLE / (0.25::DOUBLE + 0.75::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, 10.0::DOUBLE * ((length(t) - length(translate(t, '#$%&*|!~^<>{}[]', '')))::DOUBLE / greatest(length(t), 1)::DOUBLE))))) AS mix_key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM k GROUP BY source),
w AS (SELECT source, source_size, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, most / weight AS level FROM w),
f AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    sum(source_size) OVER () AS total FROM l),
g AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - full_before) / weight_left::DOUBLE AS water FROM f),
v AS (SELECT arg_min(water, level) AS water FROM (SELECT water, level FROM g WHERE water <= level)),
p AS (SELECT g.source, source_size, least(most, coalesce(v.water, 0) * weight) AS target FROM g, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM p),
o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.mix_key DESC, k.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN middle <= rest AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
