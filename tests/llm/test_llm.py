"""The training-data operators against brute force, exact round trips and held-out labels, with edge rows."""

import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismspark.llm import components, html_text, media, mixing, near_duplicates, neighbours, packing, quality, secrets, token_counts, warc
from prismspark.llm.common import cut, prepare, scratch

TEXTS = [None, "", "a", "one two three four five six seven", "one two three four five six seven", " lead  double\n\n tab\t end ", "<|endoftext|> x<|endoftext|> <|ENDOFTEXT|> it's WE'LL", "naïve ΣΑΣ ééé́ 日本語 ½ \x1c!\x1c", "z" * 3000, "word " * 6000, "aaaa aaaaa aaaaaaa", "1234 5678 !!! ???"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, digest string, score double, path string"


def docs(spark, texts=TEXTS):
    """Documents with extra columns whose names the operators use themselves."""
    prepare(spark)
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", 7, "d", 0.5, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_token_counts(spark):
    found = {r.doc_id: r for r in token_counts.token_counts(docs(spark), P.path("word_bpe_49k.json")).collect()}
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((t or "").encode()), n > 2048)


def test_packing(spark):
    out = packing.best_fit_packing(docs(spark), P.path("byte_bpe_50k.json")).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, t in enumerate(TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.length == 2048 or r.piece == 0
    bins = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048


def test_packing_of_documents(spark):
    """As few sequences as the tokens of a table need, or one more."""
    prepare(spark)
    out = packing.best_fit_packing(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), P.path("byte_bpe_50k.json")).select("sequence_id", "length").collect()
    assert len({r.sequence_id for r in out}) <= -(-sum(r.length for r in out) // 2048) + 1


def test_token_counts_of_long_words_and_small_caches(monkeypatch):
    rng, library = np.random.default_rng(3), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counter = token_counts.WordBpe(P.path("word_bpe_49k.json"))
    texts = ["".join(map(chr, 97 + rng.integers(0, n, 5000))) for n in (1, 2, 26)] + ["é" * 3001, "x " * 3000 + "ab" * 2000]
    for size, piece in ((1 << 30, 1 << 20), (300, 100)):
        monkeypatch.setattr(token_counts, "CACHE_BYTES", size)
        monkeypatch.setattr(token_counts, "PIECE_CHARS", piece)
        assert [counter.count([t])[0] for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert counter.count(texts) == [counter.count([t])[0] for t in texts]


def test_sum_of_squares_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2048, 5000)
    bins, _ = packing.sum_of_squares(lengths, 2048)
    assert np.bincount(bins, lengths).max() <= 2048
    assert bins.max() + 1 <= 1.03 * -(-lengths.sum() // 2048)


def test_components_in_rounds(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(components, "LOCAL_LINKS", 10)
    links = [(i, i + 1) for i in range(0, 40)] + [(i, i + 2) for i in range(100, 120, 2)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 122, 2)}}


def search(spark, rows, **options):
    prepare(spark)
    return neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, name string, cell long, bucket int"), **options)


def brute_force(rows, every=100, k=10):
    """query_id: [(score, vec_id)] of the k nearest, ties to the smaller id."""
    x = np.array([np.float32(r[1]) for r in rows], float)
    ids = np.array([r[0] for r in rows])
    out = {}
    for q in range(len(rows)):
        if ids[q] % every == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            out[int(ids[q])] = [(d[i], int(ids[i])) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return out


@pytest.mark.parametrize("block_rows", [4096, 7])
def test_neighbours(spark, block_rows):
    """Recall against brute force, exact scores and ranks; with tiny buckets every larger cell is split."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)], 0, "n", 1, 2) for i in range(1000)]
    rows[7] = (7, rows[0][1], *rows[7][2:])
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0], [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    told = {}
    out = search(spark, rows + [(2000 + 100 * i, v, 1, "n", 1, 2) for i, v in enumerate(odd)], block_rows=block_rows, told=told).collect()
    true, hits = brute_force(rows), 0
    assert {r.query_id for r in out} == set(true) and told["share"] < 1 and told["buckets"] > (1 if block_rows == 7 else 0)
    for q, own in true.items():
        found = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        exact = np.float32([rows[r.vec_id][1] for r in found]).astype(float) - np.float32(rows[q][1])
        assert np.allclose([r.score for r in found], np.sqrt((exact**2).sum(1)), atol=1e-12)
        hits += len({r.vec_id for r in found} & {i for _, i in own})
    assert hits >= 90 and sorted(r.vec_id for r in out if r.query_id == 0 and r["rank"] == 1) == [7]


def test_neighbours_of_repeats_and_few_candidates(spark):
    """A vector that most rows share gives the smallest ids; with fewer candidates than k a query gets all of them."""
    rows = [(i, [1.0, 2.0, -0.0, 0.0] if i % 4 else [float(i), 1.0, 0.0, 3.0], 0, "n", 1, 2) for i in range(400)]
    out = search(spark, rows, recall=1.0).collect()
    for q, own in brute_force(rows).items():
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in own]
    few = [(i * 100, [float(i), 1.0], 0, "n", 1, 2) for i in range(4)] + [(0, [5.0, 1.0], 0, "n", 1, 2)]
    found = search(spark, few).collect()
    assert sorted(r["rank"] for r in found if r.query_id == 100) == [1, 2, 3, 4] and all(r.vec_id != r.query_id for r in found)
    assert search(spark, []).count() == 0


def test_mixing_of_repeated_rows(spark, monkeypatch):
    """Equal rows have equal keys; the bucket in which the budget ends is sorted and taken one by one."""
    prepare(spark)
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    d = spark.createDataFrame([(7, "four words of text", "a", 1)] * 40 + [(8, None, "b", 1), (9, "", None, 1)] + [(i, "one two", "b", 1) for i in range(20)], "doc_id long, text string, source string, size int")
    found = cut(mixing.scored(d), "mix-test")
    rows = mixing.apply_mix(found, mixing.plan(found)).collect()
    for source in ("a", "b", None):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 and all(r.taken <= 2 * r.size for r in own)
    assert len(rows) == 62 and sorted(r.taken for r in rows) == sorted(r.taken for r in mixing.apply_mix(found, mixing.plan(found)).collect())


def check_media(found, texts):
    for i, t in enumerate(texts):
        n, payload = media.padded(t or "")
        stored = media.to_media(payload)
        r = found[i]
        assert b"".join(media.chunks(stored)) == stored and len(payload) % 192 == 0 < len(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        x = np.frombuffer(payload, np.uint8).reshape(-1, 192)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.feature(payload) and r.feature.startswith(f"mean={x.mean():.4f};std={x.std():.4f};dhash=")


def test_media(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(30_000))
    texts = [*TEXTS, long, long[:100_000] + " changed " + long[100_000:]]
    store = media.write_store(docs(spark, texts))
    check_media({r.doc_id: r for r in media.read_store(spark, store).collect()}, texts)
    # Everything is at rest: each distinct chunk once, fewer bytes than the media, and a damaged store is noticed.
    kept = spark.read.parquet(f"{store.folder}/chunks")
    names = {media.name_of(c) for t in texts for c in media.chunks(media.to_media(media.padded(t or "")[1]))}
    assert kept.count() == len(names) == kept.select("name").distinct().count() and len(names) < 60
    lists = {r.doc_id: r.names for r in spark.read.parquet(f"{store.folder}/lists").collect()}
    assert len(set(map(bytes, lists[len(texts) - 1])) - set(map(bytes, lists[len(texts) - 2]))) <= 2
    some = spark.createDataFrame([("0" * 64, 1, 0, bytearray(next(iter(names))))], "media_sha256 string, parts int, place int, name binary")
    with pytest.raises(Exception, match="differs from what was stored"):
        media.read_back(some, spark.table(store.table), bytes(spark.read.parquet(f"{store.folder}/dictionary").first()[0])).collect()


def test_media_of_copies_in_most_rows(spark, monkeypatch):
    """Chunks and media that a large share of the rows holds are joined by broadcast; ids may be null or repeated."""
    texts = ["many copies of one text"] * 1500 + [f"text {i}" for i in range(100)]
    prepare(spark)
    rows = [(None if i % 7 == 0 else i // 2, t, 1, "x") for i, t in enumerate(texts)]
    out = media.store_and_read(spark.createDataFrame(rows, "doc_id long, text string, place int, name string")).collect()
    assert len(out) == 1600 and len({r.media_sha256 for r in out}) == 101
    assert sum(r.media_sha256 == hashlib.sha256(media.to_media(media.padded(texts[0])[1])).hexdigest() for r in out) == 1500


def test_media_chunks_move_with_content():
    raw = np.random.default_rng(5).integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    first, second = set(media.chunks(raw)), set(media.chunks(b"inserted" + raw))
    assert len(first & second) > len(first) / 2


PAGES = [(1, "http://a.org/1", "<p>same</p>"), (2, "http://a.org/2", "<p>same</p>"), (3, None, None), (4, "u v", ""), (5, "x", "in WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n and WARC/1.1\r\n tail é\r\n\r\n"), (6, "y", "z" * 100_000)]


@pytest.mark.parametrize("split", ["128m", "200"])
def test_warc(spark, split):
    prepare(spark)
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = {r.page_id: r for r in warc.read(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(out) == {p for p, *_ in PAGES}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or ""))
        assert (out[page].payload_bytes, out[page].payload_digest) == (len(raw), warc.digest_of(raw))
        assert (out[page].record_type, out[page].refers_to) == (("response", None) if page == first else ("revisit", first))


def test_quality(spark):
    prepare(spark)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, labels)
    held = quality.score(d.select("doc_id", "text"), model).join(labels, "doc_id").filter(quality.held_out_remainder("doc_id") == 2).collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    scores = quality.score(docs(spark).withColumn("predicted", F.lit("other")), model)
    assert scores.columns.count("score") == scores.columns.count("predicted") == 1
    rows = {r.doc_id: r for r in scores.collect()}
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert rows[0].score == rows[1].score and rows[3].score == rows[4].score
    assert quality.score(docs(spark), quality.fit(d, labels.limit(0))).select(F.max("score")).first()[0] == pytest.approx(0.5)


def test_quality_labels_of_every_kind(spark):
    """Null and contradictory labels are not fitted, repeated ones count once, held-out ones never do."""
    prepare(spark)
    good, bad = "a fine long sentence of plain words ", "zz## %% @@ !! qq $$ "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(80)]
    held = {r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").filter(quality.held_out_remainder("doc_id") == 2).collect()}
    labels = [(i, i % 2 if i not in held else 1 - i % 2) for i in range(80)] * 2 + [(None, 1), (3, None), (4, 1), (4, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.score(d, quality.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert held and sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in out) >= 78


def test_mixing(spark):
    names = ["size", "target", "source_size", "taken", "copies", "part", "rest", "mix_key", "mix_bucket", "epochs"]
    found = cut(mixing.scored(docs(spark).withColumns({n: F.lit("own") for n in names})), "mix-test")
    mixed = mixing.apply_mix(found, mixing.plan(found))
    assert sorted(mixed.columns) == sorted({*docs(spark).columns, "size", "source_size", "target", "copies", "taken", "part", "rest", "epochs"})
    out = mixed.collect()
    assert len(out) == len(TEXTS) and {r.part for r in out} == {"own"}
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert all(r.source_size == sum(x.size for x in own) and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(1.5 * sum(r.size for r in out))


def test_main_text(spark):
    prepare(spark)
    body = "<nav><a href=x>menu</a></nav><div class='ad'>buy</div><article class='post7'><h1>Title &amp; more</h1><p>First   <b>bold<br>line<p>Second&nbsp;one.</p><div class='comments'><p>reader says</p></div></article><footer>foot</footer>"
    rows = [(1, "http://h.org/a", f"<html><body>{body}</body></html>"), (2, "http://h.org/b", None), (3, None, ""), (4, "http://h.org/c", "<p>only <script>x</script>this"), (5, "http://h.org/d", "<<<a & b")]
    out = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "Title & more\nFirst bold line\nSecond one."
    assert (out[2].text, out[3].text, out[4].text) == ("", "", "only this") and out[1].n_chars == len(out[1].text) and len(out) == 5


def best_text(body):
    return html_text.Page(f"<html><body>{body}</body></html>").text(None)


@pytest.mark.parametrize("mark", ["layout no-sidebar", "mw-content has-sidebar", "post tag-news", "post-header", "related-work", "form-validation", "search-results", "social-history", "sidebar", "page search"])
def test_main_text_keeps_marked_articles(mark):
    for inner in ("<article><h1>Title</h1><p>All of it.</p></article>", "<h1>Title</h1><p>All of it.</p>"):
        assert best_text(f"<nav>menu</nav><div class='{mark}'>{inner}</div><div class='ad'>buy</div>") == "Title\nAll of it."
    assert best_text(f"<article><h1>Title</h1><h2 id='{mark.split()[-1]}'>Part</h2><p id='comments'>All <a id='search'>of</a> it.</p><section id='related'>End.</section></article>") == "Title\nPart\nAll of it.\nEnd."


def test_main_text_drops_boilerplate():
    for mark in ("ad", "ads", "ad-slot", "sidebar", "site-footer", "main-nav", "social-share", "cookie-notice", "related-posts", "comments", "comment-list", "post-comments", "sidebar-right"):
        assert best_text(f"<main><h1>Title</h1><p>All of it, a line.</p></main><div class='x {mark}'>other</div>") == "Title\nAll of it, a line."
        assert best_text(f"<article><p>All of it.</p><div class='{mark}'><p>{'other ' * 9}</p></div></article>") == "All of it."
    assert best_text(f"<article><p>All of it.</p></article><div id='comments'><article>{'reader ' * 9}</article></div>") == "All of it."


@pytest.mark.parametrize("tag", ["article", "main", "div class='post'", "div"])
def test_main_text_of_nested_containers(tag):
    long = "long " * 60
    for parts in (f"<section>{long}</section><section>{long}</section>", f"<section class='a'>{long}</section><div class='b'>{long}</div>", f"<p>End.</p><table><tr><td>{long}<td>{long}</table>", f"<blockquote>{long}</blockquote>"):
        text = best_text(f"<div><div class='lead'>by the way</div><{tag}><h1>Title</h1><p>Intro.</p>{parts}</{tag.split()[0]}></div>").split("\n")
        assert text[:2] == ["Title", "Intro."] and text.count(long.strip()) == parts.count(long) and ("<p>" not in parts or text[2] == "End.")
    assert best_text(f"<{tag}><h1>Title</h1><div class='ad'>buy</div><section>{long}</section></{tag.split()[0]}>") == "Title\n" + long.strip()


def test_main_text_of_nested_containers_by_host(spark):
    prepare(spark)
    long = "long " * 60
    rows = [(i, "http://h.org/a", f"<body><p>site</p><article><h1>Title</h1><p>Intro.</p><section class='s'>{long}</section></article></body>") for i in range(3)]
    out = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Title\nIntro.\n" + long.strip()}


def test_main_text_by_the_hosts_vote(spark):
    """On two hosts with templates of their own the votes change the text of pages whose article is the shorter part."""
    prepare(spark)
    long, short = "long text of a page " * 12, "A short one."
    rows = []
    for h, (article, other) in enumerate([("post-body", "latest"), ("latest", "post-body")]):
        for i in range(6):
            own, beside = (long, short) if i else (short, long)
            rows.append((10 * h + i, f"https://u@H{h}.org:80/{i}", f"<body><div class='{article}'><h1>Title {i}</h1><p>{own}</p></div><div class='{other}'><p>{beside}</p></div></body>", 1, "x"))
    # Without a vote of its host a page takes what it has most of.
    assert all(html_text.Page(r[2]).text(None) == long.strip() for r in rows if r[0] % 10 == 0)
    out = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string")).collect()}
    for page, *_ in rows:
        assert out[page] == f"Title {page % 10}\n" + (long.strip() if page % 10 else short)


def test_main_text_of_generated_pages(spark):
    """Against a plain reading of the tables' pages: what is between the article's tags, a line for each heading or paragraph."""
    prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))) for part in re.split("</?(?:h1|p)>", article)]
        assert found[r.page_id] == "\n".join(t for t in (" ".join(p.split()) for p in parts) if t)


@pytest.mark.parametrize("inside", ["<div class='search-engine-guide'><p>body</p></div>", "<section class='notice-of-results'><p>body</p></section>", "<p><label>body</label></p>", "<fieldset><p>body</p></fieldset>", "<div class='tag-cloud-theory'>body</div>"])
def test_main_text_keeps_what_only_sounds_like_boilerplate(inside):
    assert best_text(f"<article><p>Intro</p>{inside}<p>End</p></article>") == "Intro\nbody\nEnd"


def test_empty_tables(spark):
    d = docs(spark, [])
    path = P.path("byte_bpe_50k.json")
    assert token_counts.token_counts(d, P.path("word_bpe_49k.json")).count() == 0
    assert packing.best_fit_packing(d, path).count() == near_duplicates.near_duplicates(d).count() == media.store_and_read(d).count() == 0
    found = cut(mixing.scored(d), "mix-empty")
    assert mixing.apply_mix(found, mixing.plan(found)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == html_text.main_texts(pages).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.classify(spark, before, sf)
    assert kept.columns == before.columns and 0 < kept.count() < before.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best-fit packing"


PIPELINE_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages():
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    return corpus_pipeline.STAGES


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_on_edge_rows(spark, at):
    """Every stage on nulls in all columns, empty and long texts, repeated rows and clashing columns, against what it states."""
    name, stage = stages()[at]
    prepare(spark)
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [None, "", "same text of six words here", "same text of six words here", long, long + " end", 'token = "be64439e3e49cf46b2d7c90f3602a3d0b907ff12" x']
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if t is None else len(t), 1.0, "h", 5) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, 27, 1.0, "h", 5), (None, texts[3], "en", "s", 27, 1.0, "h", 5)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string, size int")
    out = stage(spark, docs_, "/root/testdata/sf0.001")
    found = out.collect()
    if at < 4:
        assert out.columns == PIPELINE_COLUMNS
    given = [r[:5] for r in rows]
    if at == 0:
        assert all(tuple(r) in given for r in found)
        counts = {t: sum(r.text == t for r in found) for t in texts}
        assert all(counts[t] in (0, sum(g[1] == t for g in given)) for t in texts)
    elif at == 1:
        assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found) == [-1, 0, 1, 2, 4, 6]
    elif at == 2:
        assert len(found) == 9 and next(r.text for r in found if r.doc_id == 6) == 'token = "[SECRET]" x' and sum(r.text is None for r in found) == 1
        assert all(r.n_chars == len(r.text) for r in found if r.text)
    elif at == 3:
        assert all(tuple(r) in given for r in found) and max(sum(tuple(r) == g for r in found) for g in given if g[1]) <= 4
    else:
        library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        assert sum(r.length for r in found) == sum(len(library.encode(g[1] or "", add_special_tokens=False).ids) + 1 for g in given)


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_on_an_empty_table(spark, at):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stages()[at][1](spark, empty, "/root/testdata/sf0.001").count() == 0


def test_packing_ids_of_joined_units_are_the_library_s():
    """Units encoded as one text, alone, from the older half of the cache, and after a change of halves."""
    bpe = packing.ByteBpe(P.path("byte_bpe_50k.json"))
    odd = ["", "  ", " a", "a  b", "<|endoftext|> x y<|endoftext|>z <|endoftext|>", "it's  a\n b c\u3000d\u2003e", "\u0120 \u0120a \u0120", "a \u200b b", "x" * 5000 + " y", " 's 't", "\u6f22\u5b57 \u304b\u306a \U0001f600 \U0001f600", "tab\t tab a\tb c", "a \x85 b \x1c c"]
    want = [np.array(bpe.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert list(bpe.encode(odd)) == want
    bpe.held = packing.CACHE_BYTES
    assert list(bpe.encode(odd)) == want and bpe.older and set(bpe.known) == set(bpe.older)
