"""Analyses that are kept: what has been measured once is read from a store as long as its path, time and size are the same.

A store is a folder of Parquet files, a sub-folder for each run that found something new, so that runs only append. The
view of a listing takes the stored rows of its keys; rows of outdated keys stay behind until compact() rewrites the store.
A listing is made without reading contents. Files are measured in chunks of paths, each appended when it is done: a run
that is broken off goes on where it stopped.

Defined results: null times or sizes are equal to null; a path that a listing holds twice has one row; a store that does not
exist is empty; files that are gone have no row in the view.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What identifies a file's state, and the paths that one read names (the driver has listed them anyway).
KEY, CHUNK_PATHS = ["path", "modified", "length"], 5000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length of the files under a folder. Spark's source reads no content for these columns."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, store: str, schema: StructType | None = None) -> DataFrame | None:
    """All rows of a store with the run that wrote them, or None if there are none."""
    if not exists(spark, store):
        return None
    return spark.read.parquet(store) if schema is None else spark.read.schema(schema).parquet(store)


def same_key(left: DataFrame, right: DataFrame) -> F.Column:
    rule = F.lit(True)
    for column in KEY:
        rule = rule & left[column].eqNullSafe(right[column])
    return rule


def changed(listed: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The keys of a listing that a store does not hold, each once."""
    keys = listed.select(*KEY).dropDuplicates(["path"])
    if kept is None:
        return keys
    have = kept.select(*KEY).distinct()
    return keys.join(have, same_key(keys, have), "left_anti")


def append(measured: DataFrame, store: str) -> str:
    """Add rows (path, modified, length and measures) as a run; gives its name."""
    run = f"r{uuid.uuid4().hex}"  # no partition value that reads as a number
    measured.withColumn("stored_at", F.current_timestamp()).write.parquet(f"{store}/run={run}")
    return run


def view(listed: DataFrame, store: str) -> DataFrame:
    """The stored rows of the listing's keys, of each key the last, with the run that measured them."""
    keys, kept = listed.select(*KEY).dropDuplicates(["path"]), stored(listed.sparkSession, store)
    if kept is None:
        return keys
    rows = kept.join(keys, same_key(kept, keys), "left_semi")
    order = Window.partitionBy(*KEY).orderBy(F.desc("stored_at"), F.desc("run"))
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place", "stored_at")


def refresh(listed: DataFrame, store: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The view of a listing after analyse() has measured what is new: it gets the new keys and gives path and measures."""
    new = changed(listed, stored(listed.sparkSession, store))
    if not new.isEmpty():
        append(new.join(analyse(new), "path"), store)
    return view(listed, store)


def refresh_files(spark: SparkSession, folder: str, store: str, analyse: Callable[[DataFrame], DataFrame], chunk_paths: int = CHUNK_PATHS) -> DataFrame:
    """The view of a folder: contents are read of new files only. analyse() gets path, content of some files and gives path and
    measures."""
    listed = listing(spark, folder)
    new = changed(listed, stored(spark, store)).orderBy("path")
    paths, more = [], True
    rows = new.select("path").toLocalIterator()
    while more:
        row = next(rows, None)
        more = row is not None
        if more:
            paths.append(row[0])
        if paths and (not more or len(paths) == chunk_paths):
            contents = spark.read.format("binaryFile").load([escaped(p) for p in paths]).select("path", "content")
            # Times and sizes as they were listed: a file that changes meanwhile is new in the next run.
            append(new.filter(F.col("path").between(paths[0], paths[-1])).join(analyse(contents), "path"), store)
            paths = []
    return view(listed, store)


def escaped(path: str) -> str:
    """A path whose signs of patterns stand for themselves."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def compact(listed: DataFrame, store: str, into: str) -> None:
    """Write the view of a listing as a new store, without outdated keys and in one run."""
    append(view(listed, store).drop("run"), into)
