"""Language identification, fill-in-middle and importance resampling: edge rows, brute force and their SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from prismspark.llm import fill_in_middle, importance, language_id, packing, registry
from prismspark.llm.common import cut, prepare

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "a", "one two  three\n", "one two  three\n", "\x01\x02d e\x02\x02e\x01 \x01", "x <P> y", "a <S b <S> c", "<< <S <P <M > b", "naïve ΣΑΣ İx ééé́ 日本語 \U0001d4d0\U0001f600 ½ 12", "z" * 3000, "word " * 6000, "$1 \\ $0 \\$", "1234 !!! ???", "\t\t\x0b" * 500 + "end", "le chat et la souris " * 4, "the cat and the mouse " * 9]
SCHEMA = "doc_id long, text string, lang string, source string, n long, form string, score double, rank long, bucket long, place long, gram long"


def docs(spark, texts=TEXTS, langs=(None, "en", "fr")):
    """Documents with extra columns named as the operators name their own."""
    prepare(spark)
    return spark.createDataFrame([(i, t, langs[i % len(langs)], "s", 1, "f", 0.5, 1, 2, 3, 4) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", ["op11_language", "op12_fill_in_middle", "op13_importance"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(theirs)


def plain_middle(key, text):
    """The contract read word by word."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_like_a_plain_reading(spark):
    rows = [(k, t) for t in TEXTS for k in (None, *range(40))]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, output long")
    found = fill_in_middle.fill_in_middle(df).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    forms = Counter()
    for r in found:
        assert (r.n, r.form, r.prefix, r.middle, r.suffix, r.output) == plain_middle(r.doc_id, r.text) and r.back == (r.text or "")
        forms[r.form] += 1
    assert len(found) == len(rows) and min(forms[f] for f in ("plain", "psm", "spm")) > 20
    assert found[0].asDict().keys() == {"doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output", "back"}
    assert fill_in_middle.fill_in_middle(df.limit(0)).collect() == []
    plan = fill_in_middle.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_fill_in_middle_of_a_long_text(spark):
    text = "word\x01 " * 300_000 + "x" * 2_000_000 + " " * 2_000_000
    row = fill_in_middle.fill_in_middle(spark.createDataFrame([(5, text)], "doc_id long, text string"), rate=100).first()
    assert row.n == 300_002 and row.prefix + row.middle + row.suffix == text


def plain_profile(texts, top=300):
    """N-grams counted one by one."""
    n = Counter()
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", (t or "").lower()):
            if all(c.isalpha() for c in word):
                n.update(g for k in (1, 2, 3) for i in range(len(word) + 3 - k) if (g := f" {word} "[i : i + k]) != " ")
    return sorted(n, key=lambda g: (-n[g], len(g), g))[:top]


def test_languages_like_a_plain_reading(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 50)
    df = docs(spark)
    learned = cut(language_id.learn(df), "languages")
    want = {lang: plain_profile([t for i, t in enumerate(TEXTS) if (None, "en", "fr")[i % 3] == lang]) for lang in ("en", "fr")}
    rows = sorted(learned.collect(), key=lambda r: r.place)
    number = lambda g: int(sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)))
    assert {lang: [r.gram for r in rows if r.lang == lang] for lang in want} == {lang: [number(g) for g in grams] for lang, grams in want.items()}
    found = {r.doc_id: r for r in language_id.predict(df, learned).collect()}
    for i, t in enumerate(TEXTS):
        own = plain_profile([t])
        apart = {lang: sum(abs(grams.index(g) - k) if g in grams else 300 for k, g in enumerate(own)) for lang, grams in want.items()}
        best = min(sorted(apart), key=apart.get) if own else "und"
        assert (found[i].lang_pred, found[i].score) == (best, pytest.approx(1 - apart[best] / (300 * len(own))) if own else 0.0)
    assert [found[i].lang_pred for i in (0, 1, 2, 14)] == ["und"] * 4 and set(df.columns) < set(found[0].asDict())
    joined = {r.doc_id: r for r in language_id.predict(df, learned, most_languages=1).collect()}
    assert all(joined[i].lang_pred == found[i].lang_pred and joined[i].score == pytest.approx(found[i].score) for i in found)


def test_languages_without_rows(spark):
    df = docs(spark)
    nothing = cut(language_id.learn(df.limit(0)), "languages")
    for most in (1000, -1):
        assert {(r.lang_pred, r.score) for r in language_id.predict(df, nothing, most_languages=most).collect()} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), nothing).collect() == []
    foreign = cut(language_id.learn(spark.createDataFrame([("日本", "ja"), ("中", "zh")], "text string, lang string")), "languages")
    one = spark.createDataFrame([("abc",)], "text string")
    assert {tuple(language_id.predict(one, foreign, most_languages=m).first()) for m in (9, 1)} == {("abc", "ja", 0.0)}


def test_held_out_languages(spark):
    found = registry.op11_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 300 and np.mean([r.lang == r.lang_pred for r in found]) > 0.99


def plain_importance(rows, target, percent=25):
    """One document at a time."""
    def buckets(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]

    read = [(k, *buckets(t)) for k, t in rows]
    s, t = Counter(b for *_, f in read for b in f), Counter(b for x in target for b in buckets(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10000) / ((s[b] + 1) * (sum(t.values()) + 10000))))
    out = []
    for k, words, f in read:
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    best = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(best[: percent * len(best) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("stream_bytes", [2, 1 << 20])
def test_importance_like_a_plain_reading(spark, monkeypatch, stream_bytes):
    monkeypatch.setattr(importance, "STREAM_BYTES", stream_bytes)
    rng = np.random.default_rng(5)
    texts = [*TEXTS, *(" ".join(f"W{w}é" for w in rng.integers(0, 40, n)) for n in rng.integers(15, 60, 60))]
    target = [None, "", " ".join(f"w{w}é" for w in range(10))]
    bench = spark.createDataFrame([(0, t) for t in target], "doc_id long, text string")
    df = docs(spark, texts)
    assert sorted(map(tuple, importance.resample(df, bench).collect()), key=repr) == plain_importance(list(enumerate(texts)), target)
    # Ids that repeat or are null, no target, no rows.
    odd = df.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 7))
    want = plain_importance([(r.doc_id, r.text) for r in odd.collect()], [])
    found = sorted(map(tuple, importance.resample(odd, bench.limit(0)).collect()), key=repr)
    assert [r[:4] for r in found] == [r[:4] for r in want] and sorted(r[4] or 0 for r in found) == sorted(r[4] or 0 for r in want)
    assert importance.resample(df.limit(0), bench).collect() == []
    result = importance.resample(df, bench)
    assert {(r.doc_id, r["rank"]) for r in importance.drawn(df, result).collect()} == {(r.doc_id, r["rank"]) for r in result.collect() if r["rank"]}
    with pytest.raises(ValueError):
        importance.resample(df, bench, buckets=70_000)


def test_runs_of_a_stream():
    stream = np.array([5, 3, 5, 9999, 0, 3, 5], "<u2").tobytes()
    buckets, n = importance.runs(stream)
    assert dict(zip(buckets.tolist(), n.tolist())) == {0: 1, 3: 2, 5: 3, 9999: 1} and len(importance.runs(b"")[0]) == 0


@pytest.mark.parametrize("cache_bytes", [400_000_000, 3000])
def test_ids_of_packing_are_the_library_s(monkeypatch, cache_bytes):
    monkeypatch.setattr(packing, "CACHE_BYTES", cache_bytes)
    bpe, rng = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), np.random.default_rng(8)
    parts = ["'s", "'ll", "'S", "'", "it", "\n", "\n\n", " ", "  ", "\t", "word", "Été", "ß", "12", "½", "²", "_", "__", "a_b", "...", "!?", "<|endoftext|>", "日本", "\x1c", "\x85", "\xa0", "é\u0301", "Σ", "’", "€", "\r\n", "x", "\x00", "ª", "\u200b"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)] + ["word " * 3000, ""]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.library.encode(t, add_special_tokens=False).ids, t
