"""The corpus pipeline: quality classifier, near-duplicates, secret scans, mixing, packing.

Each stage takes the documents that the one before it kept and returns documents; the last returns packed pieces.
Stages read the five columns of documents and no others; a null in any of them, repeated rows and an empty table are
handled as each stage states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.llm import mixing, near_duplicates, packing, quality, secrets
from prismspark.llm.common import cut, prepare, small_or_not
from prismspark.session import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity of near-duplicates in the pipeline; the query op4 has its own.
SIMILAR_PERCENT = 80
#: Ids up to which the documents to drop are broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as such; equal texts go or stay together."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id; rows without doc_id and those
    without words stay; of rows that share a doc_id one stays."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = cut(near_duplicates.near_duplicates(docs, percent=SIMILAR_PERCENT).select("doc_id", "kept"), "kept")
    gone = small_or_not(found.filter("not kept").select("doc_id").distinct(), BROADCAST_IDS)
    stay = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # A doc_id that several rows carry is one document: of its rows one stays.
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return stay
    repeated = small_or_not(cut(repeated, "repeated"), BROADCAST_IDS)
    once = stay.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)
    return stay.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark and n_chars follows; every document stays, null texts as null."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    return secrets.redact(docs, secrets.default_forest(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one source; documents without words have size 0 and are
    repeated with their source's whole epochs."""
    prepare(spark)
    found = cut(mixing.scored(docs.select(*COLUMNS)), "mix")
    mixed = mixing.apply_mix(found, cut(mixing.plan(found), "mix-plan"))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as packed pieces. A null or empty text is one piece with the end id; each repeat of a document is packed."""
    prepare(spark)
    return packing.best_fit_packing(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("minhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: No stage but the mix can be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
