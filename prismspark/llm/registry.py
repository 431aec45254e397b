"""The queries of this subpackage, with production parameters over whole tables, and their SQL.

An empty table gives an empty result; other columns of a table, whatever their names, do not matter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.session import read_table

from . import fill_in_middle, html_text, importance, language_id, media, mixing, near_duplicates, neighbours, packing, quality, secrets, token_counts, warc
from .common import cut, prepare


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text. Nulls count as empty texts, 0 tokens; repeated rows are counted each."""
    prepare(spark)
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector. Null, zero and non-finite vectors take no part; ties go to the smaller id."""
    prepare(spark)
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as media and read back. Nulls are empty texts, 192 padding bytes; equal texts give equal values."""
    prepare(spark)
    out = media.store_and_read(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at 85 %. Texts that are null or without words are linked with nothing; null ids stay alone."""
    prepare(spark)
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text packed into sequences of 2048 tokens. Nulls are empty texts, one piece of one token; repeats are packed each."""
    prepare(spark)
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text. Nulls and empty texts have the score of empty texts; null ids are not held out."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.held_out_remainder("doc_id") == 2, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back. Null html is an empty payload; equal payloads revisit the smallest page."""
    prepare(spark)
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document. Null texts have size 0; a null source is one source, the last."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = cut(mixing.scored(docs).drop("text"), "mix")
    out = mixing.apply_mix(found, cut(mixing.plan(found), "mix-plan"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page. Null and empty html give an empty text; pages without a url share the empty host."""
    prepare(spark)
    return html_text.main_texts(read_table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per candidate of every whole text. Null and empty texts have none; equal texts have equal rows."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.default_forest(docs))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text. Texts that are null or without a letter are `und`; null ids are not held out."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    learned = cut(language_id.learn(docs.filter(~language_id.held_out("doc_id"))), "languages")
    found = language_id.predict(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text transformed and taken apart again. Null and empty texts stay plain; equal rows give equal rows."""
    found = fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document weighed by how it is like the benchmark's texts, a quarter drawn. Texts without words have weight 0."""
    prepare(spark)
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_neighbours": op2_neighbours,
        "op3_media": op3_media,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality": op6_quality,
        "op7_warc": op7_warc,
        "op8_mixing": op8_mixing,
        "op9_main_text": op9_main_text,
        "op10_secrets": op10_secrets,
        "op11_language": op11_language,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE, "op11_language": language_id.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_importance": importance.ORACLE}
