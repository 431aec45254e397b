"""Fill-in-middle by escaped marker injection, in built-in functions alone.

A one-byte delimiter is escaped out of the text, regexp_replace appends it after every unit (white space before a word,
and the word), counting the delimiters gives the number of units, and substring_index takes the parts before, between
and after two ranks. The parts lose their delimiters, are unescaped and put together with the three marks.

Cuts and forms come from the hex sha256 of `<seed>:<key>`, so reruns agree on any cluster; the work is one narrow map
over whole texts, without a shuffle. Each text is copied a few times while a row is worked on, and nothing else is held.

Edge cases: null and empty texts are plain and stay as they are (null reads as empty); so do texts that hold one of the
marks, as they could not be taken apart again; a null key hashes as the empty string; equal rows give equal rows, an
empty table an empty one. Texts may hold the delimiter and the escape. Columns of the input are carried along; those
named as results (n, form, prefix, middle, suffix, output) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space at the end. Possessive: no run is read twice.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix", "middle", "suffix", "output")


def escaped(text: Column) -> Column:
    """text without the delimiter; words stay words, as neither sign nor what stands for it is white space."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """The inverse of escaped() on a part that has lost its delimiters."""
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def part(marked: Column, rank: Column) -> Column:
    """The units of marked, or its last ones, by substring_index; without delimiters and unescaped."""
    return unescaped(F.replace(F.call_function("substring_index", marked, F.lit(DELIMITER), rank), F.lit(DELIMITER), F.lit("")))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """df with n (units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output.

    rate is the share in percent of texts that are transformed, spm_rate that of these with the suffix first.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in RESULTS]
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    marks = F.lit(False)
    for mark in (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK):
        marks = marks | F.contains(whole, F.lit(mark))
    plain = (whole == "") | marks | (h3 % 100 >= rate)
    out = df.select(*kept, whole.alias("fim_text"), F.regexp_replace(escaped(whole), UNIT, "$0" + DELIMITER).alias("fim_marked"), h1.alias("fim_h1"), h2.alias("fim_h2"), F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"))
    marked = F.col("fim_marked")
    out = out.withColumn("n", (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long"))
    one, two, n = F.col("fim_h1") % (F.col("n") + 1), F.col("fim_h2") % (F.col("n") + 1), F.col("n")
    out = out.withColumns({"fim_low": F.least(one, two).cast("int"), "fim_high": F.greatest(one, two).cast("int")})
    low, high, changed = F.col("fim_low"), F.col("fim_high"), F.col("form") != "plain"
    to_high = F.call_function("substring_index", marked, F.lit(DELIMITER), high)
    out = out.withColumns(
        {
            "prefix": F.when(changed, part(marked, low)),
            "middle": F.when(changed, part(to_high, low - high)),
            # marked ends with a delimiter: behind the last but n - high of them stand the units after high.
            "suffix": F.when(changed, part(marked, (high - n - 1).cast("int"))),
        }
    )
    p, m, s = F.col("prefix"), F.col("middle"), F.col("suffix")
    psm = F.concat(F.lit(PREFIX_MARK), p, F.lit(SUFFIX_MARK), s, F.lit(MIDDLE_MARK), m)
    spm = F.concat(F.lit(SUFFIX_MARK), s, F.lit(PREFIX_MARK), p, F.lit(MIDDLE_MARK), m)
    out = out.withColumn("output", F.when(F.col("form") == "plain", F.col("fim_text")).when(F.col("form") == "psm", psm).otherwise(spm))
    return out.select(*kept, *RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made from: the marks stand once each and in a known order, so three cuts give the parts."""
    body = F.substring(output, len(PREFIX_MARK) + 1, (1 << 31) - 1)
    cut = lambda t, mark, side: F.substring_index(t, mark, side)
    middle = cut(body, MIDDLE_MARK, -1)
    both = cut(body, MIDDLE_MARK, 1)
    psm = F.concat(cut(both, SUFFIX_MARK, 1), middle, cut(both, SUFFIX_MARK, -1))
    spm = F.concat(cut(both, PREFIX_MARK, -1), middle, cut(both, PREFIX_MARK, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM r),
p AS (
  SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
