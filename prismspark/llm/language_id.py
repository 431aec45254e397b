"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams of letters, of one to three letters, a space standing for a word's
edge. A document's profile is held against each language's: every n-gram adds the distance of its two ranks, or the
length of a profile where the language has not got it (the out-of-place distance); the language with the smallest sum
wins. The score is one less the sum over the largest that it could be.

Learning counts the n-grams of all given texts: each task counts its batches with numpy, Spark sums by language and
n-gram, and the best ranks of a language are taken by a window that Spark limits inside every task before it shuffles.
The profiles of up to `MOST_LANGUAGES` languages go to the tasks (`TOP` numbers each); beyond it the distances are one
join of the documents' n-grams with the profiles, which gives the same rows.

Edge cases: texts that are null or without a letter are `und` with score 0, and so is everything if nothing was learned;
ties between n-grams go to the shorter and then to the smaller code points, between languages to the smaller name; null
languages and texts teach nothing; rows that repeat count each; texts are read whole and lowered as Python lowers them;
columns of the input are kept, those named as results (lang_pred, score) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_rows, texts_of

#: Length of a profile.
TOP = 300
#: Languages whose profiles are sent to every task, 8 bytes a rank.
MOST_LANGUAGES = 1000
#: Letters of one text, and n-grams of several, that are counted at once.
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"
SPACE = 32


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Every n-gram of the text's words as one number: code points in base 2 ** 21, so that shorter ones are smaller.
    They come in parts, those that begin in the same `CHUNK_CHARS` letters together."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return
    line = np.r_[np.uint32(SPACE), np.where(is_letter, points, np.uint32(SPACE)), np.uint32(SPACE)]
    # One space between words.
    line = line[np.r_[True, (line[1:] != SPACE) | (line[:-1] != SPACE)]]
    for i in range(0, len(line), CHUNK_CHARS):
        one = line[i : i + CHUNK_CHARS + 2].astype(np.int64)
        two = (one[:-1] << 21) | one[1:]
        three = (two[:-1] << 21) | one[2:]
        middle = one[1:-1] != SPACE
        starts = one[:CHUNK_CHARS]
        yield np.concatenate((starts[starts != SPACE], two[:CHUNK_CHARS], three[:CHUNK_CHARS][middle[:CHUNK_CHARS]]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams, each once and in order, with their counts."""
    parts = [np.unique(grams, return_counts=True) for grams in ngrams(text)]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def profile(text: str, top: int = TOP) -> np.ndarray:
    """The text's most frequent n-grams, the most frequent first."""
    grams, n = counted(text)
    return grams[np.lexsort((grams, -n))[:top]]


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, gram and place (from 0) of every language's most frequent n-grams in docs."""

    def make():
        def each(batch: pa.RecordBatch):
            found: dict[str, list[np.ndarray]] = {}
            held = 0

            def rows():
                for name, grams in found.items():
                    keys, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

            for t, name in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for grams in ngrams(t):
                    found.setdefault(name, []).append(grams)
                    held += len(grams)
                    if held >= CHUNK_CHARS:
                        yield from rows()
                        found, held = {}, 0
            yield from rows()

        return each

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, F.col(lang).cast("string"))
    sums = map_rows(known, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < top).select("lang", "gram", "place")


class Profiles:
    """The profiles of all languages as one table: n-gram by language, with the rank or the length of a profile."""

    def __init__(self, rows: list, top: int = TOP):
        self.names, self.top = sorted({r[0] for r in rows}, key=lambda s: s.encode()), top
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.names)), top, np.int64)
        at = {name: i for i, name in enumerate(self.names)}
        for name, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), at[name]] = place

    def predict(self, text: str) -> tuple[str, float]:
        own = profile(text, self.top)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == own[known]
        places = self.places[np.where(known, at, len(self.grams))]
        # A rank that the language has not got is at the length of a profile from every rank.
        apart = np.where(places == self.top, self.top, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.names[best], 1.0 - int(apart[best]) / (self.top * len(own))


def predict(df: DataFrame, learned: DataFrame, *, text: str = "text", top: int = TOP, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """df with lang_pred and score. learned should be a written table."""
    df = df.drop("lang_pred", "score")
    if learned.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        return predict_by_join(df, learned, text=text, top=top)
    profiles, at = Profiles([tuple(r) for r in learned.collect()], top), df.columns.index(text)

    def make():
        def each(batch: pa.RecordBatch):
            found = [profiles.predict(t) for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

        return each

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_rows(df, make, f"{fields}, lang_pred string, score double")


def predict_by_join(df: DataFrame, learned: DataFrame, *, text: str = "text", top: int = TOP) -> DataFrame:
    """The same for any number of languages: a row for each document and each language that shares an n-gram with it.

    An n-gram that a language has takes (top - distance of ranks) off the largest sum. The rows are numbered and written
    first, as the numbers have to hold for both sides of the join.
    """
    numbered = cut(df.withColumn("_lid_row", F.monotonically_increasing_id()), "texts")

    def make():
        def each(batch: pa.RecordBatch):
            for number, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = profile(t, top)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own), pa.array(np.arange(len(own))), pa.array(np.full(len(own), len(own)))], ["_lid_row", "gram", "own", "_lid_n"])

        return each

    own = map_rows(numbered.select("_lid_row", text), make, "_lid_row long, gram long, own long, _lid_n long")
    near = own.join(learned, "gram").groupBy("_lid_row", "_lid_n", "lang").agg(F.sum(top - F.abs(F.col("own") - F.col("place"))).alias("near"))
    best = near.groupBy("_lid_row", "_lid_n").agg(F.max("near").alias("_lid_near"), F.min_by("lang", F.struct(-F.col("near"), F.col("lang"))).alias("_lid_lang"))
    # A text that shares no n-gram is at the largest distance from all languages: the first name is chosen.
    first = learned.agg(F.min("lang")).first()[0]
    has_letters = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")
    largest = F.col("_lid_n") * top
    score = F.coalesce(1.0 - (largest - F.col("_lid_near")) / largest, F.lit(0.0))
    pred = F.coalesce("_lid_lang", F.when(has_letters, F.lit(first)), F.lit(UNKNOWN))
    return numbered.join(best, "_lid_row", "left").select(*df.columns, pred.alias("lang_pred"), score.alias("score"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_, doc_id, text, lang, xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), lambda a, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295) % 3 = 1 AS held_out FROM documents),
w AS (SELECT row_, lang, held_out, ' ' || unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) || ' ' AS word FROM d),
v AS (SELECT row_, lang, held_out, word, count(*) AS times FROM w GROUP BY row_, lang, held_out, word),
k AS (SELECT *, unnest(range(1, 4)) AS size FROM v),
p AS (SELECT *, unnest(range(1, length(word) - size + 2)) AS pos FROM k),
o AS (SELECT row_, lang, held_out, substr(word, pos, size) AS gram, times FROM p),
g AS (SELECT row_, lang, held_out, gram, sum(times) AS n FROM o WHERE gram <> ' ' GROUP BY row_, lang, held_out, gram),
l AS (SELECT lang, gram, sum(n) AS n FROM g WHERE lang IS NOT NULL AND NOT coalesce(held_out, false) GROUP BY lang, gram),
learned AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(gram), gram) - 1 AS place FROM l) q WHERE place < 300),
own AS (SELECT * FROM (SELECT row_, gram, row_number() OVER (PARTITION BY row_ ORDER BY n DESC, length(gram), gram) - 1 AS place FROM g) q WHERE place < 300),
sizes AS (SELECT row_, count(*) AS n FROM own GROUP BY row_),
near AS (SELECT own.row_, learned.lang, sum(300 - abs(own.place - learned.place)) AS near FROM own JOIN learned USING (gram) GROUP BY own.row_, learned.lang),
every AS (SELECT sizes.row_, sizes.n, langs.lang, coalesce(near, 0) AS near FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM learned) langs LEFT JOIN near ON near.row_ = sizes.row_ AND near.lang = langs.lang),
best AS (SELECT row_, n, near, lang FROM (SELECT *, row_number() OVER (PARTITION BY row_ ORDER BY near DESC, lang) AS place FROM every) q WHERE place = 1)
SELECT doc_id, coalesce(held_out, false) AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - (300 * n - near)::DOUBLE / (300 * n)::DOUBLE, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (row_)
"""
