"""Named queries of the library and the SQL that states the same results."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from prismspark.functions.dialect import render
from prismspark.session import read_table

from . import applied, page_planes
from .catalog import QUERIES

#: Queries whose form is no SQL text, and the checking engine's SQL of those that it can state.
APPLIED = applied.APPLIED | page_planes.PLANES
ORACLES = applied.ORACLES | page_planes.ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Plan a catalog text over the tables it names."""
    text = render(sql, "spark")
    for name in TABLES:
        if name in text:
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def catalog_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, QUERIES[name][1])


def queries() -> dict:
    return {name: partial(catalog_query, name) for name in QUERIES} | {name: query for name, (_, query) in APPLIED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: render(sql, "duckdb") for name, (_, sql) in QUERIES.items()} | ORACLES
