"""What the operators of this subpackage share: scratch tables, Arrow mapping and a repeatable 64-bit hash."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.session import shared_folder, ship

#: Rows in one Arrow batch: texts are long, so batches are short.
BATCH_ROWS = "1000"
#: Spark removes the shuffle files of a finished write when this is set: what cut() wrote does not need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship the package and keep Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for a table or for files in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside are removed as each ends; the setting is put back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: make() is called once a task and gives the function applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null reads as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_count(column: str) -> F.Column:
    """Number of words, a word being a run of bytes that are not ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def join_hot(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", share: int = 200, least: int = 1000) -> DataFrame:
    """Join left to right, which has one row per key, though a few keys may hold most of left.

    Keys with more than 1/share of left's rows, of which there can be at most `share`, are joined by broadcasting
    their rows of right (at most `share` rows); all other keys take an ordinary shuffle join. left is read several
    times, so it should be a written table.
    """
    total = left.count()
    hot = left.groupBy(key).count().filter(F.col("count") > max(total // share, least)).select(key)
    keys = [r[0] for r in hot.collect() if r[0] is not None]
    if not keys:
        return left.join(right, key, how)
    few = left.sparkSession.createDataFrame([(k,) for k in keys], right.select(key).schema)
    some = F.broadcast(right.join(F.broadcast(few), key, "left_semi"))
    cold = left.join(F.broadcast(few), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(few), key, "left_semi").join(some, key, how).unionByName(cold)


def hashed_sample(df: DataFrame, by: list[str], rows: int, seed: int) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hashes of the columns `by`. Only hashes are sorted; the rows
    themselves are picked by the largest hash that is in, so that no task gets more than the sample."""
    hashed = F.xxhash64(*by, F.lit(seed))
    last = df.select(hashed.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.filter(hashed <= F.lit(last)).limit(rows)


def small_or_not(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast when a count shows that it has at most most_rows rows; else df, for a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
