"""Queries that apply the operators SQL cannot state, over whole tables. Vectors stand in for 8 x 8 grey images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.functions.dialect import render
from prismspark.operators import checks, headers, images, matching, planes, provenance, regions, reporting, training
from prismspark.operators import protocol_rows as protocol
from prismspark.plans.catalog import FUSION
from prismspark.session import read_table, work_folder
from prismspark.sources import incremental
from prismspark.streaming import temporal

CANDIDATE_FEATURES = ["size", "words", "lines", "digits", "symbols", "distinct_words"]


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 components as images of 8 x 8 bytes; others have null pixels."""
    level = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255).cast("int")))), 2, "0"))
    whole = (F.size("embedding") == 64) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.when(whole, F.unhex(F.array_join(level, ""))).alias("pixels")
    )


def feature_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector. Few bytes of vectors are much work, so images are dealt out first."""
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return images.measure(vector_images(spark, sf_dir).repartition(parts, "vec_id"), ["features"], "vec_id")


def image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.measure(vector_images(spark, sf_dir), ["histogram", "ela", "noise", "noise_map", "sensor", "lsb", "dct", "frequency", "resampling"], "vec_id")


def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.hashes(vector_images(spark, sf_dir), "vec_id")


def ghost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.ghosts(vector_images(spark, sf_dir), "vec_id")


def tiled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 32 x 32 from 16 vectors each, and a reference that is brighter by 0 to 2 levels, by 90 where the label is 3
    or 4 and by 100 at one pixel of every fifth vector; every 17th reference is lower. Absent or short vectors are black."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255).cast("int")))
    grey = F.when(F.size("embedding") == 64, F.transform("embedding", lambda v: F.coalesce(level(v), F.lit(0))))
    moved = F.when(F.col("label").isin(3, 4), 90).otherwise(0)
    turned = F.transform("grey", lambda v, i: (v + i % 3 + moved + F.when((F.col("vec_id") % 5 == 0) & (i == 27), 100).otherwise(0)) % 256)
    tiles = read_table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").withColumn("grey", grey).select(F.floor(F.col("vec_id") / 16).alias("img"), F.struct((F.col("vec_id") % 16).cast("int").alias("tile"), "grey", turned.alias("turned")).alias("tile"))
    images = tiles.groupBy("img").agg(F.array_sort(F.collect_list("tile")).alias("tiles"))

    place = lambda p: (F.floor(p / 256) * 4 + F.floor(p % 32 / 8)).cast("int")
    inside = lambda p: (F.floor(p / 32) % 8 * 8 + p % 8).cast("int")

    def pixels(side: str) -> F.Column:
        """Tiles in the order of their numbers, bound once, and each pixel from its tile."""
        grid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.get(F.filter("tiles", lambda s: s["tile"] == t), F.lit(0))[side])
        return planes.let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda p: F.coalesce(F.get(F.get(g, place(p)), inside(p)), F.lit(0)).cast("double")))

    lower = F.col("img") % 17 == 3
    rows = images.select("img", pixels("grey").alias("pixels"), pixels("turned").alias("other"))
    sides = [F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(1).alias("channels"), F.when(lower, 24).otherwise(32).alias("reference_height"), F.lit(32).alias("reference_width"), F.lit(1).alias("reference_channels")]
    return rows.select("img", "pixels", *sides, F.when(lower, F.slice("other", 1, 24 * 32)).otherwise(F.col("other")).alias("reference_pixels"))


def reference_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every region of difference, one with nulls for images without any."""
    found = regions.differences(tiled_pairs(spark, sf_dir), "img").select("img", "status", "threshold", "changed_fraction", "component_count", F.explode_outer("components").alias("c"))
    return found.select("img", "status", F.round("threshold", 6).alias("threshold"), F.round("changed_fraction", 6).alias("changed_fraction"), *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("component_count", "c.place", "c.x", "c.y", "c.w", "c.h", "c.area")), F.round("c.mean_abs_difference", 6).alias("mean_abs_difference"))


#: The same with masks as relations and regions by recursion.
REFERENCE_REGIONS = """WITH RECURSIVE v AS (SELECT vec_id // 16 AS img, vec_id % 16 AS tile, vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS raw FROM embeddings WHERE len(embedding) = 64),
q AS (SELECT *, coalesce(least(255, greatest(0, floor((raw::DOUBLE + 0.5::DOUBLE) * 255)::INT)), 0) AS q FROM v),
given AS (SELECT img, (tile // 4) * 8 + pos // 8 AS y, (tile % 4) * 8 + pos % 8 AS x, abs(q - (q + pos % 3 + CASE WHEN label IN (3, 4) THEN 90 ELSE 0 END + CASE WHEN vec_id % 5 = 0 AND pos = 27 THEN 100 ELSE 0 END) % 256) AS d FROM q),
imgs AS (SELECT DISTINCT vec_id // 16 AS img FROM embeddings),
px AS (SELECT g.img, g.y, g.x, coalesce(d, 0) AS d FROM (SELECT img, y, x FROM imgs, range(32) a(y), range(32) b(x) WHERE img % 17 <> 3) g LEFT JOIN given USING (img, y, x)),
m AS (SELECT img, median(d)::DOUBLE AS med FROM px GROUP BY img),
t AS (SELECT px.img, greatest(12.0::DOUBLE, any_value(med) + 8.0::DOUBLE * 1.4826::DOUBLE * median(abs(d - med))) AS threshold FROM px JOIN m USING (img) GROUP BY px.img),
m0 AS (SELECT img, y, x, d >= threshold AS s FROM px JOIN t USING (img)),
e1 AS (SELECT a.img, a.y, a.x, bool_and(b.s) AS s FROM m0 a JOIN m0 b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
o1 AS (SELECT a.img, a.y, a.x, bool_or(b.s) AS s FROM e1 a JOIN e1 b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
d2 AS (SELECT a.img, a.y, a.x, bool_or(b.s) AS s FROM o1 a JOIN o1 b ON a.img = b.img AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY ALL),
c2 AS (SELECT a.img, a.y, a.x, bool_and(b.s) AS s FROM d2 a JOIN d2 b ON a.img = b.img AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY ALL),
on_ AS (SELECT img, y, x, y * 32 + x AS p FROM c2 WHERE s),
seeds AS (SELECT a.img, a.y, a.x, a.p AS root FROM on_ a WHERE NOT EXISTS (SELECT 1 FROM on_ b WHERE b.img = a.img AND ((b.y = a.y - 1 AND abs(b.x - a.x) <= 1) OR (b.y = a.y AND b.x = a.x - 1)))),
reach AS (SELECT * FROM seeds UNION SELECT n.img, n.y, n.x, r.root FROM reach r JOIN on_ n ON n.img = r.img AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1),
labels AS (SELECT img, y, x, min(root) AS label FROM reach GROUP BY img, y, x),
parts AS (SELECT l.img, label, count(*) AS area, min(l.x) AS x, min(l.y) AS y, max(l.x) - min(l.x) + 1 AS w, max(l.y) - min(l.y) + 1 AS h, avg(d) AS mean_ FROM labels l JOIN px USING (img, y, x) GROUP BY l.img, label HAVING count(*) >= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY area DESC, label) AS place, count(*) OVER (PARTITION BY img) AS n FROM parts),
changed AS (SELECT img, avg(s::INT) AS changed_fraction FROM c2 GROUP BY img)
SELECT imgs.img, CASE WHEN threshold IS NULL THEN 'not_comparable' ELSE 'success' END AS status, round(threshold, 6) AS threshold, round(changed_fraction, 6) AS changed_fraction, CASE WHEN threshold IS NOT NULL THEN coalesce(n, 0) END::BIGINT AS component_count, place::BIGINT AS place, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, area::BIGINT AS area, round(mean_, 6) AS mean_abs_difference
FROM imgs LEFT JOIN t USING (img) LEFT JOIN changed USING (img) LEFT JOIN ranked ON ranked.img = imgs.img AND place <= 20"""


def sequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events without clicks against all of theirs."""
    events = read_table(spark, sf_dir, "events")
    frames = events.select("user_id", "event_type", F.concat_ws("-", F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("idx"), F.array("value").alias("frame"))
    return matching.align(frames.filter("event_type <> 'click'"), frames, "user_id")


#: The same by recursion over places.
SEQUENCE_ALIGNMENT = """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j FROM events WHERE user_id IS NOT NULL),
q AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events WHERE event_type <> 'click' AND user_id IS NOT NULL),
sizes AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'click') AS n_q FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
walk AS (SELECT user_id, -1::BIGINT AS i, -1::BIGINT AS j, -1::BIGINT AS before FROM sizes WHERE n_q BETWEEN 1 AND n
  UNION ALL SELECT w.user_id, q.i, (min({'d': abs(r.value - q.value), 'j': r.j})).j, any_value(w.j) FROM walk w JOIN q ON q.user_id = w.user_id AND q.i = w.i + 1 JOIN r ON r.user_id = w.user_id AND r.j > w.j GROUP BY w.user_id, q.i)
SELECT s.user_id, CASE WHEN n_q = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN n_q = 0 THEN 'could_not_decode_video' END AS reason, w.i AS idx, w.j AS matched, abs(q.value - r.value) AS distance, CASE WHEN w.i = 0 THEN 0 ELSE w.j - w.before - 1 END AS skipped
FROM sizes s LEFT JOIN walk w ON w.user_id = s.user_id AND w.i >= 0 LEFT JOIN q ON q.user_id = w.user_id AND q.i = w.i LEFT JOIN r ON r.user_id = w.user_id AND r.j = w.j"""


def copy_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, their lines as keypoints with 64-bit descriptors."""
    lines = read_table(spark, sf_dir, "lineitem")
    points = lines.select("l_orderkey", F.col("l_linenumber").alias("kp"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_discount") * 1000).alias("y"), F.array(F.xxhash64("l_returnflag", "l_linestatus")).alias("words"))
    return matching.copy_move(points, "l_orderkey")


def validation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation results built from event properties, flattened."""
    code = F.struct(F.concat(F.lit("code."), F.get_json_object("props", "$.k")).alias("code"), (F.col("value") > 0).alias("success"))
    tree = F.to_json(F.struct(F.struct(F.when(F.col("event_type") == "click", F.array(code)).alias("failure"), F.when(F.col("event_type") == "purchase", F.array(code)).alias("success"), code.alias("other")).alias("activeManifest")))
    return provenance.validation_rows(read_table(spark, sf_dir, "events").select("event_id", tree.alias("tree")), "tree", "event_id")


VALIDATION_FLATTEN = """WITH r AS (SELECT event_id, event_type, 'code.' || (props->>'$.k') AS code, value > 0 AS ok FROM events)
SELECT event_id, 0::INTEGER AS place, 'activeManifest.' || kind AS scope, kind, code, ok AS success, NULL::VARCHAR AS explanation, NULL::VARCHAR AS url FROM (SELECT *, CASE event_type WHEN 'click' THEN 'failure' WHEN 'purchase' THEN 'success' END AS kind FROM r) k WHERE kind IS NOT NULL
UNION ALL SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END::INTEGER, 'activeManifest.other', CASE WHEN ok THEN 'success' WHEN NOT ok THEN 'failure' ELSE 'status' END, code, ok, NULL, NULL FROM r"""


#: A tree per event in text that both engines put together: nested lists, inherited kinds, a status inside a status, text that
#: looks like one, nulls, a key named root; every seventh is cut off.
TREE = """concat('{"activeManifest":{"failures":[{"code":"f.', event_type, '","success":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"url":"u', CAST(event_id AS {text}), '"},{"no":1}],"info":{"deep":[[{"code":', CAST(event_id AS {text}), '}],"text",null,{"Warnings":{"code":null,"success":false}}]}},"a":{"code":"', event_type, '","explanation":"by ', CAST(user_id AS {text}), '","success":true,"inner":{"code":1}},"text":"{\\"code\\":1}","other":[{"code":"o","success":', CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"no"' END, '}],"root":{"x":{"code":true}}', CASE WHEN event_id % 7 = 0 THEN '' ELSE '}' END)"""


def validation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of every event's tree, in document order. Few bytes of events are much work, so rows are dealt out first."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    trees = events.select("event_id", F.expr(TREE.replace("{text}", "STRING").replace("\\", "\\\\")).alias("tree"))
    return provenance.validation_rows(trees, "tree", "event_id").withColumn("place", F.col("place").cast("long"))


VALIDATION_TREE = f"""WITH RECURSIVE trees AS (SELECT event_id, {TREE.replace("{text}", "VARCHAR")} AS t FROM events),
walk AS (SELECT event_id, t::JSON AS node, 'root' AS scope, NULL::VARCHAR AS kind, []::BIGINT[] AS place FROM trees WHERE json_valid(t)
  UNION ALL SELECT w.event_id, e.value, CASE WHEN json_type(w.node) = 'ARRAY' THEN w.scope WHEN w.scope = 'root' THEN e.key ELSE w.scope || '.' || e.key END,
    CASE WHEN json_type(w.node) = 'ARRAY' THEN w.kind WHEN lower(e.key) IN ('success', 'successes') THEN 'success' WHEN lower(e.key) IN ('failure', 'failures', 'error', 'errors') THEN 'failure' WHEN lower(e.key) IN ('informational', 'info', 'warning', 'warnings') THEN 'informational' ELSE w.kind END, w.place || [e.id::BIGINT]
  FROM walk w, json_each(w.node) e WHERE json_type(w.node) IN ('OBJECT', 'ARRAY') AND NOT (json_type(w.node) = 'OBJECT' AND list_contains(json_keys(w.node), 'code'))),
leaves AS (SELECT *, CASE json_type(node, '$.success') WHEN 'BOOLEAN' THEN (node->>'$.success')::BOOLEAN END AS flag FROM walk WHERE json_type(node) = 'OBJECT' AND list_contains(json_keys(node), 'code'))
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY place) - 1 AS place, scope, coalesce(kind, CASE WHEN flag THEN 'success' WHEN NOT flag THEN 'failure' ELSE 'status' END) AS kind,
  CASE json_type(node, '$.code') WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN upper(left(node->>'$.code', 1)) || substr(node->>'$.code', 2) ELSE node->>'$.code' END AS code, flag AS success, node->>'$.explanation' AS explanation, node->>'$.url' AS url FROM leaves"""


def incremental_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages measured twice, of which every tenth was shorter the first time: rows of the others come from the store."""
    pages = read_table(spark, sf_dir, "pages").filter("page_id IS NOT NULL").select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))

    def state(html: F.Column) -> tuple[DataFrame, DataFrame]:
        rows = pages.withColumn("html", html)
        return rows, rows.select("path", F.lit("2024-01-01").cast("timestamp").alias("modified"), F.octet_length("html").cast("long").alias("length"))

    def analyse(rows: DataFrame, when: str):
        return lambda new: rows.join(new.select("path"), "path", "left_semi").select("path", F.sha2("html", 256).alias("digest"), F.regexp_count("html", F.lit("<")).cast("long").alias("tags"), F.lit(when).alias("measured"))

    store = work_folder(spark, "pages-store")
    for when, html in (("before", F.when(F.col("page_id") % 10 == 0, F.substring("html", 2, 1 << 30)).otherwise(F.col("html"))), ("now", F.col("html"))):
        rows, listed = state(html)
        found = incremental.refresh(listed, store, analyse(rows, when))
    return found.select("path", "length", "digest", "tags", "measured")


INCREMENTAL_PAGES = """SELECT 'page/' || page_id AS path, strlen(coalesce(html, ''))::BIGINT AS length, sha256(coalesce(html, '')) AS digest, (length(coalesce(html, '')) - length(replace(coalesce(html, ''), '<', '')))::BIGINT AS tags,
  CASE WHEN page_id % 10 = 0 AND coalesce(html, '') <> '' THEN 'now' ELSE 'before' END AS measured FROM pages WHERE page_id IS NOT NULL"""


#: Results in JSON that both engines put together; names of nested objects are in their order.
RESULT = """concat('{"anomalies":["', event_type, '",{"a":', CAST(event_id AS {text}), ',"b":null}],"anomaly_count":', CAST(user_id AS {text}), ',"calibrated":false,"frame_count":', CAST(event_id % 9 AS {text}), ',"reason":"', repeat('why ', CAST(event_id % 400 AS INT)), '","status":"success","warning":null', CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END)"""
METHODS = "CASE event_id % 5 WHEN 0 THEN 'synthetic_ml' WHEN 1 THEN 'video_motion_discontinuities' WHEN 2 THEN 'synthetic_evidence_fusion' WHEN 3 THEN 'noise_map' ELSE 'other' END"


def short_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short form of a result of every event; every 13th result is cut off and has none."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.expr(METHODS).alias("method"), F.expr(RESULT.replace("{text}", "STRING")).alias("result"))
    return reporting.short_results(rows).drop("result")


def _picked(keys: str, present: bool) -> str:
    parts = [f"""CASE WHEN {present} AND NOT list_contains(json_keys(j), '{k}') THEN NULL ELSE '"{k}": ' || coalesce(json_extract(j, '$.{k}')::VARCHAR, 'null') END""" for k in keys.split()]
    return "'{' || array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ', ') || '}'"


SHORT_RESULTS = f"""WITH r AS (SELECT event_id, {METHODS} AS method, {RESULT.replace("{text}", "VARCHAR")} AS t FROM events), v AS (SELECT event_id, method, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM r)
SELECT event_id, method, CASE WHEN j IS NULL THEN NULL ELSE CASE method {' '.join(f"WHEN '{m}' THEN {f'left({_picked(keys, present)}, {most})' if most else _picked(keys, present)}" for m, (keys, present, most) in reporting.SHORT.items() if m in METHODS)} ELSE left(j::VARCHAR, {reporting.OTHER_CHARS}) END END AS short FROM v"""


def cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector through the built-in checks, one that is not known and one that cannot be loaded."""
    checks.register(spark)
    read_table(spark, sf_dir, "embeddings").createOrReplaceTempView("checked_vectors")
    names = "array('mean', 'largest', 'zero_share', 'sharpest', 'no.such.module:check')"
    rows = spark.sql(f"SELECT v.vec_id, c.* FROM checked_vectors v, LATERAL cross_check({names}, CAST(v.embedding AS ARRAY<DOUBLE>)) c")
    return rows.select("vec_id", "feature", "status", F.round("value", 9).alias("value"), F.when(F.col("reason").isNotNull(), F.element_at(F.split("reason", r"\("), 1)).alias("failure"))


CROSS_CHECKS = """WITH f(feature) AS (VALUES ('mean'), ('largest'), ('zero_share'), ('sharpest'), ('no.such.module:check'))
SELECT vec_id, feature, CASE WHEN feature = 'sharpest' THEN 'unsupported' WHEN contains(feature, ':') THEN 'unavailable' WHEN len(embedding) = 0 THEN 'error' ELSE 'success' END AS status,
  round(CASE feature WHEN 'mean' THEN list_avg(embedding::DOUBLE[]) WHEN 'largest' THEN list_max(embedding)::DOUBLE WHEN 'zero_share' THEN len(list_filter(embedding, lambda v: v = 0)) / len(embedding)::DOUBLE END, 9) AS value,
  CASE WHEN contains(feature, ':') THEN 'ModuleNotFoundError' END AS failure FROM embeddings, f"""


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TIFF block for every page, in the byte order of its number: its id as width, a maker of its url's length, an
    orientation; every tenth is cut off inside the maker."""
    big = F.col("page_id") % 2 == 0

    def word(value: F.Column, n: int) -> F.Column:
        h = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
        return F.when(big, h).otherwise(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))]))

    maker = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    size = F.length(maker) + 1
    entry = lambda tag, kind, n, value: [word(F.lit(tag), 2), word(F.lit(kind), 2), word(n, 4), value]
    short = F.rpad(word(F.col("page_id") % 8 + 1, 2), 8, "0")
    parts = [F.when(big, "4D4D").otherwise("4949"), word(F.lit(42), 2), word(F.lit(8), 4), word(F.lit(3), 2), *entry(256, 4, F.lit(1), word(F.col("page_id"), 4)), *entry(271, 2, size, word(F.lit(50), 4)), *entry(274, 3, F.lit(1), short), F.lit("00000000"), F.hex(maker), F.lit("00")]
    whole = F.concat(*parts)
    files = read_table(spark, sf_dir, "pages").select("page_id", F.unhex(F.when(F.col("page_id") % 10 == 0, F.substring(whole, 1, 106)).otherwise(whole)).alias("content"))
    found = headers.image_headers(files)
    return found.select("page_id", "format", "width", "exif", *(F.col("tags")[t].alias(a) for t, a in (("Make", "maker"), ("Orientation", "orientation"))))


IMAGE_HEADERS = """SELECT page_id, 'TIFF' AS format, page_id AS width, CASE WHEN page_id % 10 = 0 THEN 'damaged' ELSE 'success' END AS exif, CASE WHEN page_id % 10 > 0 THEN 'page ' || page_id END AS maker, (page_id % 8 + 1)::VARCHAR AS orientation FROM pages"""


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as JSON, with a number that is not finite, a time, bytes and nested values."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("event_id") / 4).alias("ratio"), F.encode("event_type", "UTF-8").alias("raw"), F.create_map(F.col("user_id"), F.array(F.col("event_id") % 2 == 0, F.lit(None).cast("boolean"))).alias("flags"), F.to_date("ts").alias("day"))
    return reporting.json_safe(rows).select("event_id", "json")


JSON_ROWS = """SELECT event_id, concat('{"event_id":', event_id, ',"user_id":', user_id, ',"ratio":', CASE WHEN event_id % 4 = 0 THEN '"NaN"' ELSE (event_id / 4.0::DOUBLE)::VARCHAR END, ',"raw":"', lower(hex(encode(event_type))), '","flags":{"', user_id, '":[', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',null]},"day":"', ts::DATE::VARCHAR, '"}') AS json FROM events"""


def protocol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and evidence of every vector; what detectors would give comes from its label, as in the catalog."""
    read_table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    found = spark.sql(render(f"WITH {FUSION} SELECT * FROM fusion", "spark"))
    named = lambda **flags: F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for n, c in flags.items()]))
    kind = F.element_at(F.array(*map(F.lit, protocol.DETECTOR_FAMILIES)), (F.col("vec_id") % 3 + 1).cast("int"))
    detector = F.struct(kind.alias("kind"), F.lit("m").alias("name"), F.col("ml_score").alias("score"), F.lit(None).cast("string").alias("label"), F.col("ml_validated").alias("validated"), F.col("ml_calibrated").alias("calibrated"))
    files = found.select(
        "vec_id", named(peaks="f_peaks", ratio="f_ratio", quadrant="f_quadrant").alias("spectral_flags"), named(face="face_flag").alias("face_flags"), named(context="context_flag").alias("context_flags"), F.col("marker_only").alias("marker"), "provenance_valid",
        "noise_cv", "sensor_cv", "sensor_std", "high_low_ratio", F.col("f_resampling").alias("resampling"), F.when(F.col("ml_status") == "success", F.array(detector)).alias("detectors"),
        named(face="face_flag", context="context_flag", noise="f_noise", sensor="f_sensor", provenance="provenance_valid").alias("families"), F.col("level").alias("convergence"),
    )
    rows = protocol.each_row(protocol.protocol_rows(files), "vec_id")
    return rows.select("vec_id", "list", F.col("place").cast("long").alias("place"), "family", F.array_join("signals", ",").alias("signals"), F.round("score", 6).alias("score"), "validated")


_FAMILIES = "array_to_string(list_filter([CASE WHEN face_flag THEN 'face' END, CASE WHEN context_flag THEN 'context' END, CASE WHEN f_noise THEN 'noise' END, CASE WHEN f_sensor THEN 'sensor' END, CASE WHEN provenance_valid THEN 'provenance' END], lambda x: x IS NOT NULL), ',')"
_STAGES = [
    ("f_peaks OR f_ratio OR f_quadrant", "'frequency'", "array_to_string(list_filter([CASE WHEN f_peaks THEN 'peaks' END, CASE WHEN f_ratio THEN 'ratio' END, CASE WHEN f_quadrant THEN 'quadrant' END], lambda x: x IS NOT NULL), ',')", "NULL", "NULL"),
    ("face_flag", "'face_region'", "'face'", "NULL", "NULL"),
    ("marker_only", "'content_provenance'", "'embedded_c2pa_manifest_marker'", "NULL", "provenance_valid"),
    ("f_noise", "'noise_consistency'", "'high_local_residual_variability'", "NULL", "NULL"),
    ("f_resampling", "'resampling'", "'short_lag_derivative_persistence'", "NULL", "NULL"),
    ("f_texture", "'synthetic_texture'", "'low_high_frequency_ratio_with_low_sensor_residual'", "high_low_ratio", "NULL"),
    ("f_sensor", "'sensor_residual'", "'high_local_residual_energy_variability'", "NULL", "NULL"),
    ("context_flag", "'face_context'", "'context'", "NULL", "NULL"),
    ("ml_status = 'success' AND NOT ml_validated AND ml_score >= 0.5", "['handcrafted_ml_detector', 'deep_detector', 'autogan_spectral_detector'][vec_id % 3 + 1]", "NULL", "ml_score", "false"),
    (f"{_FAMILIES} <> ''", "'cross_family_convergence'", f"level || ',' || {_FAMILIES}", "NULL", "NULL"),
    ("ml_status = 'success' AND ml_validated", "['handcrafted_ml_detector', 'deep_detector', 'autogan_spectral_detector'][vec_id % 3 + 1]", "NULL", "ml_score", "true"),
]
PROTOCOL_ROWS = f"""WITH {render(FUSION, "duckdb")},
rows_ AS ({" UNION ALL ".join(f"SELECT vec_id, '{'evidence' if k == len(_STAGES) - 1 else 'observation'}' AS list, {k} AS stage, {family} AS family, {signals} AS signals, {score}::DOUBLE AS score, {validated}::BOOLEAN AS validated FROM fusion WHERE {rule}" for k, (rule, family, signals, score, validated) in enumerate(_STAGES))})
SELECT vec_id, list, row_number() OVER (PARTITION BY vec_id, list ORDER BY stage) - 1 AS place, family, signals, round(score, 6) AS score, validated FROM rows_"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with shape features; quality 0 is class 1, the source is the generator. The features are
    written once, so that fits and scores do not read the texts again."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    text = F.coalesce("text", F.lit(""))
    size = F.length(text).cast("double")
    words = F.split(text, r"\s+")
    shaped = docs.select(
        "doc_id", F.col("source").alias("generator"), F.log1p(size).alias("size"), F.log1p(F.size(words).cast("double")).alias("words"),
        F.regexp_count(text, F.lit("\n")).cast("double").alias("lines"), F.try_divide(F.regexp_count(text, F.lit("[0-9]")).cast("double"), size).alias("digits"),
        F.try_divide(F.regexp_count(text, F.lit(r"[^\w\s]")).cast("double"), size).alias("symbols"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_words"),
    )
    split = F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation").otherwise("train")
    rows = shaped.join(labels, "doc_id").withColumn("label", F.when(F.col("quality") == 0, 1).otherwise(0)).withColumn("split", split)
    folder = work_folder(spark, "candidates")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def candidate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.benchmark(candidates(spark, sf_dir), CANDIDATE_FEATURES, "doc_id")


def held_out_generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.leave_one_generator_out(candidates(spark, sf_dir), CANDIDATE_FEATURES, "doc_id", "logistic")


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    model = training.fit(rows.filter("split = 'train'"), CANDIDATE_FEATURES, "logistic", "doc_id", calibrate=True)
    return model.score(rows.select("doc_id", "label", *CANDIDATE_FEATURES)).select("doc_id", "label", "score", "predicted")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of series."""
    schema = read_table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.select(F.col("user_id").cast("string").alias("series"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "value")


def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of each series; of a window updated by several batches the last counts."""
    folder = work_folder(spark, "windows")
    temporal.drain(temporal.windows(series(spark, sf_dir)), folder, "update")
    rows = spark.read.parquet(f"{folder}/out")
    columns = [c for c in rows.columns if c not in ("batch", "series", "start")]
    latest = rows.groupBy("series", "start").agg(F.max_by(F.struct(*columns), "batch").alias("last"))
    return latest.select("series", "start", "last.*")


def streaming_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "screen")
    temporal.drain(temporal.screen(series(spark, sf_dir)), folder)
    return spark.read.parquet(f"{folder}/out").drop("batch")


#: name: (operators of the survey it covers, query).
APPLIED = {
    "feature_bank": ("G2 G4 G6 G7 G8 G9 G10 G11 G15 G17 C10 C11 K14", feature_bank),
    "image_measures": ("C1 C2 C3 C4 C5 C8 G1 G2 G3 G5", image_measures),
    "image_hashes": ("C9", image_hashes),
    "ghost_sweep": ("C6", ghost_sweep),
    "reference_regions": ("H2 I3 E4", reference_regions),
    "sequence_alignment": ("H3 H4", sequence_alignment),
    "copy_move": ("H5 H6 I1 I2", copy_move),
    "validation_flatten": ("B5", validation_flatten),
    "validation_tree": ("B5", validation_tree),
    "incremental_pages": ("G16", incremental_pages),
    "short_results": ("L5", short_results),
    "cross_checks": ("2.12", cross_checks),
    "protocol_rows": ("J5", protocol_rows),
    "json_rows": ("B9", json_rows),
    "image_headers": ("A6", image_headers),
    "candidate_benchmark": ("K4 K5 K7 K12", candidate_benchmark),
    "held_out_generators": ("I7 K12", held_out_generators),
    "calibrated_scores": ("K1 K6", calibrated_scores),
    "streaming_windows": ("F1", streaming_windows),
    "streaming_screen": ("F1 F2 F3", streaming_screen),
}

#: The checking engine's SQL of queries whose own form is no SQL text.
ORACLES = {"reference_regions": REFERENCE_REGIONS, "validation_flatten": VALIDATION_FLATTEN, "validation_tree": VALIDATION_TREE, "incremental_pages": INCREMENTAL_PAGES, "sequence_alignment": SEQUENCE_ALIGNMENT, "short_results": SHORT_RESULTS, "cross_checks": CROSS_CHECKS, "protocol_rows": PROTOCOL_ROWS, "json_rows": JSON_ROWS, "image_headers": IMAGE_HEADERS}
