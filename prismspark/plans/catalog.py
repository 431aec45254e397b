"""Queries in one SQL text that Catalyst plans and the checking engine repeats."""

from __future__ import annotations

from prismspark.functions import thresholds as T

FRAMES = """frames AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  @us(ts) AS us, value, event_id, event_type FROM events),
steps AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS before, lag(us) OVER (PARTITION BY user_id ORDER BY idx) AS us_before FROM frames),
diffs AS (SELECT user_id, idx, event_id, abs(value - before) AS mad, us - us_before AS dt FROM steps WHERE before IS NOT NULL)"""
ROBUST = FRAMES + """,
mids AS (SELECT *, median(mad) OVER (PARTITION BY user_id) AS med FROM diffs),
robust AS (SELECT *, median(abs(mad - med)) OVER (PARTITION BY user_id) AS spread FROM mids)"""
PIX = """pix AS (SELECT vec_id, label, CAST(pos AS BIGINT) AS pos, CAST(floor(pos / 8) AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x, CAST(raw AS DOUBLE) AS v,
  CAST(least(255, greatest(0, floor((CAST(raw AS DOUBLE) + 0.5D) * 255))) AS BIGINT) AS q FROM embeddings @explode64)"""
#: The same, dealt by vector before the explosion: windows, groups and joins by vec_id then need no further shuffle.
PIXV = PIX.replace("FROM embeddings @explode64", "FROM @dealt_embeddings @explode64")
VOTES = f"""votes AS (SELECT l.doc_id, d.source, d.lang, l.quality AS truth, least(1.0D, d.n_chars / 4000.0D) AS score,
  CASE WHEN least(1.0D, d.n_chars / 4000.0D) >= {T.MODEL_SCORE}D THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cells AS (SELECT *, CAST(truth = 1 AND pred = 1 AS INT) AS tp, CAST(truth = 0 AND pred = 1 AS INT) AS fp, CAST(truth = 0 AND pred = 0 AS INT) AS tn, CAST(truth = 1 AND pred = 0 AS INT) AS fn FROM votes)"""
SUMS = "count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn"
RATES = """n, tp, fp, tn, fn, (tp + tn) / nullif(CAST(n AS DOUBLE), 0) AS accuracy, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision_, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS sensitivity,
  tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity, fp / nullif(CAST(tn + fp AS DOUBLE), 0) AS false_positive_rate, fn / nullif(CAST(tp + fn AS DOUBLE), 0) AS false_negative_rate, 2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1"""
#: Measures of a vector as an image of 8 x 8 grey levels, rounded so that thresholds fall alike. What detectors absent here
#: would give (faces, provenance, a model's score) is read from the vector's label and first component.
MEASURES = PIXV + """,
near AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY pos) AS before, avg(v) OVER (PARTITION BY vec_id) AS mean_, stddev_pop(v) OVER (PARTITION BY vec_id) AS sd FROM pix),
whole AS (SELECT vec_id, max(label) AS label, max(CASE WHEN pos = 0 THEN round(abs(v), 6) END) AS first_, count_if(round(abs(v - mean_) - 2 * sd, 9) > 0) AS peak_count, round(corr(v, before), 6) AS persistence, round(stddev_pop(v - before), 6) AS sensor_std,
  round(avg(CASE WHEN y NOT BETWEEN 2 AND 5 OR x NOT BETWEEN 2 AND 5 THEN abs(v) END) / (avg(CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN abs(v) END) + 1.0E-12D), 6) AS high_low_ratio FROM near GROUP BY vec_id),
blocks AS (SELECT vec_id, floor(y / 4) AS by_, floor(x / 4) AS bx, avg(abs(v)) AS energy, stddev_pop(v) AS s, stddev_pop(v - before) AS r FROM near GROUP BY vec_id, floor(y / 4), floor(x / 4)),
cvs AS (SELECT vec_id, round(stddev_pop(energy) / (avg(energy) + 1.0E-12D), 6) AS quadrant_cv, round(stddev_pop(s) / (avg(s) + 1.0E-12D), 6) AS noise_cv, round(stddev_pop(r) / (avg(r) + 1.0E-12D), 6) AS sensor_cv FROM blocks GROUP BY vec_id),
measures AS (SELECT whole.vec_id, peak_count, high_low_ratio, quadrant_cv, noise_cv, sensor_cv, sensor_std, persistence, label = 1 AS face_flag, label = 2 AS context_flag, label = 3 AS provenance_valid, label = 4 AS marker_only,
  CASE WHEN label >= 3 THEN 'success' ELSE 'not_configured' END AS ml_status, label = 5 AS ml_validated, label = 6 AS ml_calibrated, least(1.0D, 4 * first_) AS ml_score FROM whole JOIN cvs ON whole.vec_id = cvs.vec_id)"""
FLAGS = MEASURES + f""",
flags AS (SELECT *, peak_count >= {T.SPECTRAL_PEAKS} AS f_peaks, high_low_ratio < {T.RATIO_LOW:.2f}D OR high_low_ratio > {T.RATIO_HIGH}D AS f_ratio, quadrant_cv < {T.QUADRANT_CV}D AS f_quadrant,
  noise_cv > {T.NOISE_CV}D AS f_noise, sensor_cv > {T.SENSOR_CV}D AS f_sensor, persistence >= {T.RESAMPLING_PERSISTENCE}D AS f_resampling, high_low_ratio < {T.TEXTURE_RATIO}D AND sensor_std < {T.TEXTURE_SIGMA}D AS f_texture,
  ml_status = 'success' AND ml_validated AS f_model FROM measures)"""
FUSION = FLAGS + f""",
families AS (SELECT *, CAST(f_peaks OR f_ratio OR f_quadrant AS INT) + CAST(face_flag AS INT) + CAST(context_flag AS INT) + CAST(f_noise AS INT) + CAST(f_sensor AS INT) + CAST(provenance_valid AS INT) + CAST(f_model AS INT) AS family_count FROM flags),
fusion AS (SELECT *, CASE WHEN family_count >= {T.FUSION_HIGH} THEN 'high' WHEN family_count >= {T.FUSION_MODERATE} THEN 'moderate' WHEN family_count = 1 THEN 'single' ELSE 'none' END AS level FROM families)"""
# The methods of each profile.
METHOD_PLAN = """plan_(method, media, quick, deepfake, full_, jpeg_only) AS (VALUES ('hash_sha256','any',1,1,1,0),('c2pa','any',1,1,1,0),('metadata','any',1,1,1,0),('perceptual_hashes','image',1,1,1,0),('ela','image',1,1,1,0),
  ('noise_residual','image',1,1,1,0),('noise_map','image',1,1,1,0),('deepfake_protocol','image',1,1,1,0),('histogram','image',0,1,1,0),('frequency','image',0,1,1,0),('resampling','image',0,1,1,0),('prnu_screen','image',0,1,1,0),
  ('face_artifacts','image',0,1,1,0),('face_context_consistency','image',0,1,1,0),('synthetic_spectral','image',0,1,1,0),('autogan_spectral','image',0,1,1,0),('synthetic_feature_bank','image',0,1,1,0),('synthetic_ml','image',0,1,1,0),
  ('synthetic_deep','image',0,1,1,0),('autogan_classifier','image',0,1,1,0),('synthetic_evidence_fusion','image',0,1,1,0),('jpeg_quantization','image',1,1,1,1),('jpeg_ghost','image',0,1,1,1),('jpeg_dct','image',0,1,1,1),
  ('copy_move_orb','image',0,0,1,0),('steganography_lsb','image',0,0,1,0),('video_timing','video',1,1,1,0),('video_duplicates','video',1,1,1,0),('video_transition_anomalies','video',1,1,1,0),('video_motion_discontinuities','video',1,1,1,0),('video_deepfake_protocol','video',1,1,1,0))"""

# Parts of words that route a question, in the order in which they are tried.
ROUTE_WORDS = {"assessment": ["alteração", "manipulação"], "provenance": ["metadad", "estrutura", "origem"], "synthetic": ["sintét", "ia", "deepfake"]}
ROUTES = " ".join(f"WHEN {' OR '.join(f"contains(t, '{w}')" for w in words)} THEN '{route}'" for route, words in ROUTE_WORDS.items())


# Fixed value: a version of three numbers without leading zeros, with a pre-release and a build.
SEMVER = "^(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)(?:-([0-9A-Za-z][0-9A-Za-z.-]*))?(?:[+]([0-9A-Za-z.-]+))?$"


def wilson(k: str, n: str) -> str:
    """Two columns: the bounds of the Wilson interval of k of n."""
    z2, p, m = T.WILSON_Z * T.WILSON_Z, f"({k} / CAST({n} AS DOUBLE))", f"CAST({n} AS DOUBLE)"
    half = f"{T.WILSON_Z}D * sqrt({p} * (1 - {p}) / {m} + {z2 / 4}D / {m} / {m})"
    low, high = (f"({p} + {z2 / 2}D / {m} {sign} {half}) / (1 + {z2}D / {m})" for sign in "-+")
    return f"round(greatest(0.0D, {low}), 9) AS low, round(least(1.0D, {high}), 9) AS high"


#: Checks that fixtures require and checks that were produced: sources as fixtures, documents as their checks, labels as
#: results. Some results are planted with another fixture, twice, or for a check that nobody requires. A check that was
#: produced several times passes when all its results do, and belongs to its fixture when all of them do.
GATE = """required_ AS (SELECT coalesce(source, 'none') AS fixture, doc_id AS check_id FROM documents),
produced AS (SELECT l.doc_id AS check_id, CASE WHEN l.doc_id % 37 = 0 THEN 'elsewhere' ELSE coalesce(d.source, 'none') END AS fixture, l.quality = 1 AS passed FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL SELECT doc_id, 'elsewhere', true FROM labels WHERE doc_id % 41 = 0 UNION ALL SELECT -1 - doc_id, 'none', quality = 1 FROM labels WHERE doc_id % 43 = 0),
results AS (SELECT check_id, count(*) AS times, min(fixture) AS low, max(fixture) AS high, min(CAST(passed AS INT)) = 1 AS passed FROM produced GROUP BY check_id),
states AS (SELECT r.fixture, coalesce(r.check_id, p.check_id) AS check_id, r.check_id IS NULL AS undeclared, p.check_id IS NULL AS missing, coalesce(p.times > 1, false) AS repeated,
  coalesce(r.check_id IS NOT NULL AND (p.low <> r.fixture OR p.high <> r.fixture), false) AS wrong_fixture, coalesce(r.check_id IS NOT NULL AND NOT p.passed, false) AS failing FROM required_ r FULL OUTER JOIN results p ON r.check_id = p.check_id),
fixtures AS (SELECT fixture, count(*) AS required, count_if(NOT missing) AS present, count_if(NOT missing AND NOT wrong_fixture AND NOT failing) AS passed, count_if(missing) AS missing, count_if(failing) AS failing, count_if(wrong_fixture) AS wrong_fixture FROM states WHERE NOT undeclared GROUP BY fixture)"""

#: name: (operators of the survey it covers, SQL).
QUERIES: dict[str, tuple[str, str]] = {
    "integrity_sha256": ("B1", "SELECT doc_id, @sha256(text) AS digest, CAST(@bytes(text) AS BIGINT) AS size FROM documents"),
    "exact_duplicates": ("B1", "SELECT @sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "marker_scan": ("B2 B3", "WITH t AS (SELECT page_id, lower(html) AS h FROM pages) SELECT page_id, CASE WHEN contains(h, 'nav') AND (contains(h, 'jumb') OR contains(h, 'article')) THEN 'marker_only' ELSE 'unavailable' END AS status, CASE WHEN contains(h, 'example.org') THEN 'example.org' WHEN contains(h, 'example') THEN 'example' END AS producer FROM t"),
    "html_metadata": ("", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, CAST(length(html) AS BIGINT) AS size FROM pages"),
    "state_normaliser": ("B4", "SELECT event_id, nullif(trim(regexp_replace(lower(concat('ValidationState.', event_type)), '^validationstate[.]', '')), '') AS state FROM events"),
    "validation_summary": ("B7", """WITH codes AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'success' ELSE 'informational' END AS kind, concat('code.', event_type) AS code FROM events WHERE event_id % 7 > 0 OR event_type <> 'click'),
stores AS (SELECT user_id, CASE WHEN user_id % 6 < 5 THEN concat('urn:', CAST(user_id AS STRING)) END AS active, CASE user_id % 6 WHEN 0 THEN 'trusted' WHEN 1 THEN 'valid' WHEN 2 THEN 'invalid' ELSE '' END AS state FROM (SELECT DISTINCT user_id FROM events) u),
c AS (SELECT user_id, count_if(kind = 'success') AS ok, count_if(kind = 'failure') AS failed, count_if(kind = 'informational') AS told, max(CASE WHEN code = 'code.signup' THEN 1 ELSE 0 END) = 1 AS signed FROM codes GROUP BY user_id),
j AS (SELECT s.user_id, active, state, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed, coalesce(told, 0) AS told, coalesce(signed, false) AS signed FROM stores s LEFT JOIN c ON s.user_id = c.user_id),
v AS (SELECT *, active IS NOT NULL AND failed = 0 AND state <> 'invalid' AND (state IN ('valid', 'trusted') OR signed) AS integrity_validated FROM j)
SELECT user_id, ok, failed, told, integrity_validated, CASE WHEN state = 'trusted' THEN 'trusted' WHEN state = 'valid' THEN 'valid_but_not_trusted' WHEN state = 'invalid' THEN 'invalid' WHEN active IS NOT NULL THEN 'not_established' ELSE 'not_applicable' END AS trust_status,
  CASE WHEN integrity_validated THEN 'validated' WHEN failed > 0 OR state = 'invalid' THEN 'invalid' WHEN active IS NOT NULL THEN 'manifest_present_unverified' ELSE 'no_active_manifest' END AS status FROM v"""),
    "byte_histogram_entropy": ("C1", f"WITH {PIXV}, h AS (SELECT vec_id, q, count(*) AS n FROM pix GROUP BY vec_id, q), m AS (SELECT vec_id, avg(q) AS mean, stddev_pop(q) AS std, max(q) - min(q) AS dynamic_range, avg(CASE WHEN q = 0 THEN 1.0D ELSE 0.0D END) AS clipped_black, avg(CASE WHEN q = 255 THEN 1.0D ELSE 0.0D END) AS clipped_white FROM pix GROUP BY vec_id) SELECT m.vec_id, round(mean, 6) AS mean, round(std, 6) AS std, dynamic_range, clipped_black, clipped_white, e.entropy_bits, e.zero_bins FROM m JOIN (SELECT vec_id, round(-sum(n / 64.0D * log2(n / 64.0D)), 6) AS entropy_bits, 256 - count(*) AS zero_bins FROM h GROUP BY vec_id) e ON m.vec_id = e.vec_id"),
    "noise_block_cv": ("C3 C4 C5", f"WITH {PIXV}, r AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS res FROM pix), b AS (SELECT vec_id, floor(y / 4) AS by_, floor(x / 4) AS bx, stddev_pop(res) AS s FROM r GROUP BY vec_id, floor(y / 4), floor(x / 4)), g AS (SELECT vec_id, avg(res) AS residual_mean, stddev_pop(res) AS residual_std FROM r GROUP BY vec_id) SELECT g.vec_id, round(residual_mean, 6) AS residual_mean, round(residual_std, 6) AS residual_std, c.blocks, c.local_std_mean, c.local_std_cv FROM g JOIN (SELECT vec_id, count(*) AS blocks, round(avg(s), 6) AS local_std_mean, round(stddev_pop(s) / (avg(s) + 1.0E-12D), 6) AS local_std_cv FROM b GROUP BY vec_id) c ON g.vec_id = c.vec_id"),
    "noise_mad": ("C3", f"WITH {PIXV}, m AS (SELECT vec_id, v, median(v) OVER (PARTITION BY vec_id) AS med FROM pix) SELECT vec_id, round(median(abs(v - med)), 6) AS mad FROM m GROUP BY vec_id"),
    "quality_sweep_argmin": ("C6", f"WITH {PIXV}, qs(quality) AS (VALUES (55), (60), (65), (70), (75), (80), (85), (90), (95), (100)), e AS (SELECT vec_id, quality, avg(abs(q - @rint(q / CAST(106 - quality AS DOUBLE), 0) * (106 - quality))) AS err FROM pix CROSS JOIN qs GROUP BY vec_id, quality), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(err, 9), quality) AS place FROM e) SELECT vec_id, quality AS minimum_error_quality, round(err, 6) AS minimum_mean_abs_error FROM k WHERE place = 1"),
    "quant_table_stats": ("C7", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, @join(@sorted(@list(l_linenumber)), ',') AS lines FROM lineitem GROUP BY l_orderkey"),
    "lsb_screen": ("C8", f"WITH {PIX}, n AS (SELECT vec_id, CAST(sum(CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, CAST(sum(q % 2) AS BIGINT) AS n1 FROM pix GROUP BY vec_id) SELECT vec_id, n0, n1, n1 / 64.0D AS p1, round(CASE WHEN n0 = 0 OR n1 = 0 THEN 0.0D ELSE -(n0 / 64.0D * log2(n0 / 64.0D) + n1 / 64.0D * log2(n1 / 64.0D)) END, 6) AS entropy_bits, ((n0 - 32) * (n0 - 32) + (n1 - 32) * (n1 - 32)) / 32.0D AS chi2 FROM n"),
    "average_hash": ("C9", f"WITH {PIXV}, m AS (SELECT vec_id, pos, v, avg(v) OVER (PARTITION BY vec_id) AS mean FROM pix) SELECT vec_id, CAST(sum(CASE WHEN v >= mean AND pos < 32 THEN CAST(pow(2, 31 - pos) AS BIGINT) ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN v >= mean AND pos >= 32 THEN CAST(pow(2, 63 - pos) AS BIGINT) ELSE 0 END) AS BIGINT) AS low FROM m GROUP BY vec_id"),
    "difference_hash": ("C9", f"WITH {PIXV}, m AS (SELECT vec_id, y, x, v, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS after FROM pix) SELECT vec_id, CAST(sum(CASE WHEN after >= v THEN CAST(pow(2, 55 - (y * 7 + x)) AS BIGINT) ELSE 0 END) AS BIGINT) AS dhash FROM m WHERE after IS NOT NULL GROUP BY vec_id"),
    "channel_correlation": ("C10", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS rg, round(coalesce(corr(l_quantity, l_discount), 0.0D), 6) AS rb, round(coalesce(corr(l_extendedprice, l_tax), 0.0D), 6) AS gb FROM lineitem GROUP BY l_returnflag"),
    "colour_moments": ("C11", f"WITH {PIX}, m AS (SELECT label, avg(v) AS mean, stddev_pop(v) AS std FROM pix GROUP BY label) SELECT pix.label, round(max(mean), 6) AS mean, round(max(std), 6) AS std, round(avg(pow((v - mean) / (std + 1.0E-12D), 3)), 5) AS skew FROM pix JOIN m ON pix.label = m.label GROUP BY pix.label"),
    "robust_normalise": ("C12 G11", "WITH p AS (SELECT user_id, @percentile(value, 0.01) AS lo, @percentile(value, 0.99) AS hi FROM events GROUP BY user_id) SELECT event_id, round(CASE WHEN hi > lo THEN least(255.0D, greatest(0.0D, (value - lo) / (hi - lo) * 255.0D)) ELSE 0.0D END, 4) AS level FROM events JOIN p ON events.user_id = p.user_id"),
    "dct_coefficient": ("G1", f"WITH {PIX} SELECT vec_id, round(sum(v * cos((2 * y + 1) * pi() / 16) * cos((2 * x + 1) * 2 * pi() / 16)) / 4.0D, 6) AS c12 FROM pix GROUP BY vec_id"),
    "dct_periodicity": ("G1", f"""WITH {PIX}, c AS (SELECT label, CAST(@rint(round(sum(q * cos((2 * y + 1) * pi() / 16) * cos((2 * x + 1) * 2 * pi() / 16)) / 4.0D, 6), 0) AS BIGINT) AS k, vec_id FROM pix GROUP BY label, vec_id),
p AS (SELECT label, round(@percentile(k, 0.02), 6) AS lo, round(@percentile(k, 0.98), 6) AS hi, count(*) AS n_blocks FROM c GROUP BY label),
r AS (SELECT label, n_blocks, CAST(CASE WHEN lo < 0 THEN ceil(lo) ELSE floor(lo) END AS BIGINT) AS lo, CAST(CASE WHEN hi < 0 THEN ceil(hi) ELSE floor(hi) END AS BIGINT) AS hi FROM p),
h AS (SELECT c.label, k, count(*) AS n FROM c JOIN r ON c.label = r.label WHERE k BETWEEN lo AND hi GROUP BY c.label, k)
SELECT r.label, r.n_blocks, round(1.0D - count(h.k) / CAST(max(hi) - max(lo) + 1 AS DOUBLE), 6) AS zero_bin_fraction FROM r JOIN h ON r.label = h.label GROUP BY r.label, r.n_blocks"""),
    "haar_energy": ("G4", f"WITH {PIXV}, b AS (SELECT vec_id, floor(y / 2) AS by_, floor(x / 2) AS bx, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v ELSE 0 END) AS a, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v ELSE 0 END) AS b_, sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v ELSE 0 END) AS c, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v ELSE 0 END) AS d FROM pix GROUP BY vec_id, floor(y / 2), floor(x / 2)) SELECT vec_id, round(avg(pow((a + b_ + c + d) * 0.5D, 2)), 6) AS ll, round(avg(pow((a - b_ + c - d) * 0.5D, 2)), 6) AS lh, round(avg(pow((a + b_ - c - d) * 0.5D, 2)), 6) AS hl, round(avg(pow((a - b_ - c + d) * 0.5D, 2)), 6) AS hh FROM b GROUP BY vec_id"),
    "autocorrelation": ("G3 G13", f"WITH {PIXV}, c AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY vec_id) AS z FROM pix), e AS (SELECT vec_id, sum(z * z) AS energy FROM c GROUP BY vec_id), k AS (SELECT a.vec_id, b.pos - a.pos AS lag_, sum(a.z * b.z) AS s FROM c a JOIN c b ON a.vec_id = b.vec_id WHERE b.pos - a.pos BETWEEN 1 AND 8 GROUP BY a.vec_id, b.pos - a.pos) SELECT k.vec_id, lag_, round(s / (energy + 1.0E-12D), 6) AS ac FROM k JOIN e ON k.vec_id = e.vec_id"),
    "resampling_screen": ("G3", f"WITH {PIXV}, c AS (SELECT vec_id, pos, v - avg(v) OVER (PARTITION BY vec_id) AS z FROM pix), k AS (SELECT a.vec_id, sum(CASE WHEN b.pos = a.pos + 1 THEN a.z * b.z ELSE 0 END) AS ac1, sum(CASE WHEN b.pos = a.pos + 2 THEN a.z * b.z ELSE 0 END) AS ac2 FROM c a JOIN c b ON a.vec_id = b.vec_id AND b.pos - a.pos BETWEEN 1 AND 2 GROUP BY a.vec_id) SELECT vec_id, CASE WHEN abs(ac1) < 1.0E-12D THEN NULL ELSE round(ac2 / ac1, 4) END AS persistence, coalesce(round(ac2 / ac1, 6) >= {T.RESAMPLING_PERSISTENCE}D, false) AS flag FROM k"),
    "glcm_contrast": ("G6", f"WITH {PIXV}, l AS (SELECT vec_id, y, x, CAST(floor(q / 16) AS BIGINT) AS g FROM pix), o(dy, dx) AS (VALUES (0, 1), (0, 2), (1, 0), (2, 0), (1, 1), (2, 2)), p AS (SELECT a.vec_id, dy, dx, a.g AS i, b.g AS j FROM l a CROSS JOIN o JOIN l b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx), t AS (SELECT vec_id, dy, dx, avg(CAST((i - j) * (i - j) AS DOUBLE)) AS contrast, avg(CAST(abs(i - j) AS DOUBLE)) AS dissimilarity, avg(1.0D / (1 + (i - j) * (i - j))) AS homogeneity FROM p GROUP BY vec_id, dy, dx) SELECT vec_id, round(avg(contrast), 6) AS contrast, round(avg(dissimilarity), 6) AS dissimilarity, round(avg(homogeneity), 6) AS homogeneity FROM t GROUP BY vec_id"),
    "band_energy": ("G12", f"WITH {PIX}, b AS (SELECT vec_id, v, CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 THEN 'low' WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN 'mid' ELSE 'high' END AS band FROM pix) SELECT vec_id, band, round(avg(abs(v)), 6) AS mean_abs, round(stddev_pop(v), 6) AS std FROM b GROUP BY vec_id, band"),
    "quadrant_replication": ("G14", f"WITH {PIXV}, k AS (SELECT vec_id, floor(y / 4) * 2 + floor(x / 4) AS quad, y % 4 AS ly, x % 4 AS lx, v FROM pix), c AS (SELECT a.vec_id, a.quad AS qa, b.quad AS qb, corr(a.v, b.v) AS r FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.ly = b.ly AND a.lx = b.lx AND a.quad < b.quad GROUP BY a.vec_id, a.quad, b.quad) SELECT vec_id, round(avg(abs(r)), 6) AS replication FROM c GROUP BY vec_id"),
    "spectral_flags": ("J1", f"WITH {FLAGS} SELECT vec_id, f_peaks, f_ratio, f_quadrant FROM flags"),
    "native_observations": ("J2", f"WITH {FLAGS} SELECT vec_id, CAST(f_peaks AS INT) + CAST(f_ratio AS INT) + CAST(f_quadrant AS INT) + CAST(face_flag AS INT) + CAST(marker_only AS INT) + CAST(f_noise AS INT) + CAST(f_resampling AS INT) + CAST(f_texture AS INT) + CAST(f_sensor AS INT) AS observations, f_resampling, f_texture FROM flags"),
    "fusion_level": ("J4 I9", f"WITH {FUSION} SELECT vec_id, family_count, level, 'inconclusive' AS evidentiary_conclusion FROM fusion"),
    "machine_assessment": ("J6", f"WITH {FLAGS} SELECT vec_id, CASE WHEN ml_status = 'success' THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN ml_status <> 'success' THEN NULL WHEN ml_calibrated THEN round(ml_score / (1 + ml_score), 6) ELSE round(ml_score, 6) END AS probability, CASE WHEN ml_status <> 'success' THEN NULL WHEN ml_calibrated THEN 'calibrated' ELSE 'score' END AS probability_of, CASE WHEN ml_status <> 'success' THEN NULL WHEN ml_validated THEN 'validated_model_evidence' ELSE 'screening_only' END AS effect FROM flags"),
    "protocol_triage": ("J3 J5 K11", f"WITH {FUSION} SELECT vec_id, CASE WHEN f_model OR level IN ('moderate', 'high') THEN 'needs_expert_review' WHEN family_count > 0 OR f_resampling OR f_texture OR marker_only OR (ml_status = 'success' AND ml_score >= {T.MODEL_SCORE}D) THEN 'screening_observations_only' ELSE 'no_strong_screening_signals' END AS triage, f_model AS has_evidence, 'inconclusive' AS evidentiary_conclusion FROM fusion"),
    "signal_counts": ("J9 L4", f"WITH {FUSION} SELECT vec_id % 10 AS bucket, CAST(sum(CAST(marker_only AS INT)) AS BIGINT) AS provenance, CAST(sum(CAST(f_resampling AS INT)) AS BIGINT) AS resampling, CAST(sum(CAST(f_noise AS INT) + CAST(f_sensor AS INT)) AS BIGINT) AS sensor, CAST(sum(CAST(peak_count >= 6 AS INT)) AS BIGINT) AS compression, CAST(sum(CAST(quadrant_cv < 0.05D AS INT)) AS BIGINT) AS local_, CAST(sum(CAST(face_flag AS INT) + CAST(context_flag AS INT) + CAST(f_peaks AS INT) + CAST(f_ratio AS INT) + CAST(f_quadrant AS INT) + CAST(f_texture AS INT) + CAST(f_model AS INT)) AS BIGINT) AS synthetic FROM fusion GROUP BY vec_id % 10"),
    "domain_scope": ("J8", """WITH given AS (SELECT vec_id, vec_id % 3 > 0 AS confirmed, CASE label % 5 WHEN 0 THEN '8x8' WHEN 1 THEN '16 X 16' WHEN 2 THEN ' 8 x 8 x 3' WHEN 3 THEN 'eight' END AS declared, CASE WHEN @length(embedding) = 64 THEN 8 END AS side FROM embeddings),
parsed AS (SELECT *, nullif(regexp_extract(replace(lower(declared), ' ', ''), '^([0-9]+)x([0-9]+)(x.*)?$', 1), '') AS h, nullif(regexp_extract(replace(lower(declared), ' ', ''), '^([0-9]+)x([0-9]+)(x.*)?$', 2), '') AS w FROM given),
matched AS (SELECT *, CAST(h AS INT) = side AND CAST(w AS INT) = side AS geometry_match FROM parsed)
SELECT vec_id, h, w, geometry_match, CASE WHEN NOT confirmed THEN 'unconfirmed' WHEN NOT geometry_match THEN 'confirmed_but_geometry_mismatch' ELSE 'confirmed_match' END AS scope FROM matched"""),
    "assessment_rules": ("J10", f"""WITH {ROBUST}, a AS (SELECT user_id, count_if(mad <= {T.DUPLICATE_MAD}D) AS duplicates, count_if(mad >= greatest({T.TRANSITION_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread)) AS abrupt, count_if((mad - med) / ({T.MAD_SCALE}D * spread + 1.0E-12D) >= {T.MOTION_Z}D) AS motion FROM robust GROUP BY user_id),
s AS (SELECT user_id, dt, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY dt, idx) AS place FROM diffs), u AS (SELECT user_id, max(CASE WHEN place = floor(n / 2) + 1 THEN dt END) AS usual, max(n) AS n FROM s GROUP BY user_id),
g AS (SELECT s.user_id, count_if(s.n > 1 AND usual > 0 AND dt > {T.GAP_FACTOR}D * usual) AS gaps FROM s JOIN u ON s.user_id = u.user_id GROUP BY s.user_id)
SELECT a.user_id, concat_ws('; ', CASE WHEN gaps > 0 THEN concat('timing gaps: ', CAST(gaps AS STRING)) END, CASE WHEN duplicates > 0 THEN concat('near-duplicate transitions: ', CAST(duplicates AS STRING)) END, CASE WHEN abrupt > 0 THEN concat('abrupt transitions: ', CAST(abrupt AS STRING)) END, CASE WHEN motion > 0 THEN concat('motion discontinuities: ', CAST(motion AS STRING)) END, CASE WHEN duplicates + abrupt + motion > 0 THEN 'protocol: needs expert review' END) AS findings, gaps + duplicates + abrupt + motion = 0 AS nothing_found FROM a JOIN g ON a.user_id = g.user_id"""),
    "question_routing": ("J11", f"WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations) SELECT conv_id, turn, CASE {ROUTES} ELSE 'general' END AS route FROM q"),
    "profile_plan": ("J12 H9", f"""WITH {METHOD_PLAN}, kinds AS (SELECT method, kind, quick, deepfake, full_, jpeg_only FROM plan_ JOIN (VALUES ('image'), ('video')) AS k(kind) ON plan_.media = 'any' OR plan_.media = kind),
files AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'video' ELSE 'image' END AS kind, CASE WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END AS jpeg FROM documents)
SELECT doc_id, CAST(sum(quick) AS BIGINT) AS quick_methods, CAST(sum(deepfake) AS BIGINT) AS deepfake_methods, CAST(sum(full_) AS BIGINT) AS full_methods, @join(@sorted(@list(method)), ',') AS methods FROM files JOIN kinds ON files.kind = kinds.kind WHERE jpeg_only <= jpeg GROUP BY doc_id"""),
    "timing_gaps": ("F1 A4", f"WITH {FRAMES}, s AS (SELECT user_id, idx, dt, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY dt, idx) AS place FROM diffs), u AS (SELECT user_id, max(CASE WHEN place = floor(n / 2) + 1 THEN dt END) AS med, max(n) AS n FROM s GROUP BY user_id) SELECT diffs.user_id, idx - 1 AS idx, diffs.dt AS delta FROM diffs JOIN u ON diffs.user_id = u.user_id WHERE n > 1 AND med > 0 AND diffs.dt > {T.GAP_FACTOR}D * med"),
    "near_duplicate_frames": ("F2", f"WITH {FRAMES} SELECT user_id, idx, event_id, round(mad, 6) AS mad FROM diffs WHERE mad <= {T.DUPLICATE_MAD}D"),
    "transition_anomalies": ("F3", f"WITH {ROBUST} SELECT user_id, idx, round(mad, 6) AS mad, round(greatest({T.TRANSITION_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread), 6) AS threshold FROM robust WHERE mad >= greatest({T.TRANSITION_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread)"),
    "motion_discontinuity": ("F4", f"WITH {ROBUST} SELECT user_id, idx, round(mad, 4) AS flow, round((mad - med) / ({T.MAD_SCALE}D * spread + 1.0E-12D), 4) AS robust_z FROM robust WHERE (mad - med) / ({T.MAD_SCALE}D * spread + 1.0E-12D) >= {T.MOTION_Z}D"),
    "uniform_sampling": ("F5", f"WITH {FRAMES}, n AS (SELECT user_id, count(*) AS n, least(24, count(*)) AS k FROM frames GROUP BY user_id), i AS (SELECT DISTINCT n.user_id, CASE WHEN k = 1 THEN 0 ELSE CAST(floor(s.idx * CAST(n.n - 1 AS DOUBLE) / (k - 1)) AS BIGINT) END AS idx FROM n JOIN frames s ON n.user_id = s.user_id AND s.idx < k) SELECT frames.user_id, frames.idx, event_id FROM frames JOIN i ON frames.user_id = i.user_id AND frames.idx = i.idx"),
    "video_screen_cv": ("F6 J7", f"WITH {FRAMES}, c AS (SELECT user_id, stddev_pop(value) / (avg(value) + 1.0E-12D) AS cv FROM frames GROUP BY user_id) SELECT user_id, round(cv, 6) AS cv, cv > {T.SHARPNESS_CV}D AS sharpness_flag, cv > {T.DCT_RATIO_CV}D AS ratio_flag, CASE WHEN cv > {T.DCT_RATIO_CV}D THEN 'needs_expert_review' ELSE 'no_strong_screening_signals' END AS triage FROM c"),
    "keyframe_union": ("F7", f"WITH {ROBUST}, k AS (SELECT user_id, idx FROM robust WHERE mad <= {T.DUPLICATE_MAD}D OR mad >= greatest({T.TRANSITION_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread) OR (mad - med) / ({T.MAD_SCALE}D * spread + 1.0E-12D) >= {T.MOTION_Z}D), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS place FROM k) SELECT user_id, idx FROM r WHERE place <= 12"),
    "temporal_triage": ("F1 F3 F4 J7", f"WITH {ROBUST}, a AS (SELECT user_id, count(*) AS transitions, CAST(sum(CASE WHEN mad >= greatest({T.TRANSITION_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread) THEN 1 ELSE 0 END) AS BIGINT) AS abrupt, CAST(sum(CASE WHEN (mad - med) / ({T.MAD_SCALE}D * spread + 1.0E-12D) >= {T.MOTION_Z}D THEN 1 ELSE 0 END) AS BIGINT) AS discontinuities, CAST(sum(CASE WHEN mad <= {T.DUPLICATE_MAD}D THEN 1 ELSE 0 END) AS BIGINT) AS duplicates FROM robust GROUP BY user_id) SELECT user_id, transitions, abrupt, discontinuities, duplicates, CASE WHEN abrupt + discontinuities + duplicates > 0 THEN 'needs_expert_review' ELSE 'no_strong_screening_signals' END AS triage, 'inconclusive' AS evidentiary_conclusion FROM a"),
    "reference_lookup": ("H1", "SELECT o_orderkey, c_name AS reference FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"),
    "reference_difference": ("H2", f"WITH {PIX}, r AS (SELECT label, pos, avg(q) AS ref FROM pix GROUP BY label, pos), d AS (SELECT vec_id, pix.pos, abs(q - ref) AS diff FROM pix JOIN r ON pix.label = r.label AND pix.pos = r.pos), m AS (SELECT *, median(diff) OVER (PARTITION BY vec_id) AS med FROM d), s AS (SELECT *, median(abs(diff - med)) OVER (PARTITION BY vec_id) AS spread FROM m) SELECT vec_id, round(max(med), 5) AS median_abs_difference, round(max(greatest({T.REFERENCE_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread)), 5) AS threshold, avg(CASE WHEN round(diff, 9) >= round(greatest({T.REFERENCE_FLOOR}D, med + {T.ROBUST_SIGMA}D * {T.MAD_SCALE}D * spread), 9) THEN 1.0D ELSE 0.0D END) AS changed_fraction FROM s GROUP BY vec_id"),
    "largest_region": ("E4 I3", "WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_extendedprice DESC, l_linenumber) AS place FROM lineitem) SELECT l_orderkey, l_linenumber, round(area, 2) AS area FROM r WHERE place = 1"),
    "component_ranking": ("I3", "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_quantity >= 50) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE place <= 20"),
    "translation_clusters": ("I1 I2", f"WITH p AS (SELECT l_suppkey, CAST(@rint((l_quantity - 25.0D) / {T.BIN_PX}D, 0) AS BIGINT) AS bx, CAST(@rint(round((l_discount * 1000.0D - 50.0D) / {T.BIN_PX}D, 6), 0) AS BIGINT) AS by_, l_quantity AS dx, l_discount * 1000.0D AS dy, l_tax * 1000.0D AS hamming FROM lineitem), c AS (SELECT l_suppkey, bx, by_, count(*) AS n, avg(hamming) AS mean_hamming, avg(dx) AS mean_dx, avg(dy) AS mean_dy, sqrt(pow(stddev_pop(dx), 2) + pow(stddev_pop(dy), 2)) AS spread FROM p GROUP BY l_suppkey, bx, by_) SELECT l_suppkey, bx, by_, n, round(mean_hamming, 5) AS mean_hamming, round(mean_dx, 5) AS mean_dx, round(mean_dy, 5) AS mean_dy, round(spread, 5) AS spread, n >= {T.CLUSTER_N} AND round(mean_hamming, 9) <= {T.CLUSTER_HAMMING}D AND round(spread, 9) <= {T.CLUSTER_STD}D AS suspicious FROM c"),
    "contract_outer": ("H7 H8", f"WITH {GATE} SELECT fixture, check_id, undeclared, missing, repeated, wrong_fixture, failing, NOT (undeclared OR missing OR wrong_fixture OR failing) AS passed FROM states"),
    "missing_files": ("H8 A7", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')"),
    "citations_join": ("H10", """WITH refs(k, title) AS (VALUES ('sha2', 'Secure hash standard'), ('dct', 'Discrete cosine transform'), ('prnu', 'Sensor noise'), ('wilson', 'Probable inference')), uses(method, k) AS (VALUES ('hash_sha256', 'sha2'), ('jpeg_dct', 'dct'), ('prnu_screen', 'prnu'), ('metrics', 'wilson'), ('metrics', 'sha2')),
ran AS (SELECT DISTINCT source, CASE doc_id % 5 WHEN 0 THEN 'hash_sha256' WHEN 1 THEN 'jpeg_dct' WHEN 2 THEN 'prnu_screen' WHEN 3 THEN 'metrics' ELSE 'ela' END AS method FROM documents)
SELECT source, refs.k AS ref, title, count(*) AS methods FROM ran JOIN uses ON ran.method = uses.method JOIN refs ON uses.k = refs.k GROUP BY source, refs.k, title"""),
    "external_evidence": ("H11 A11 A12", "SELECT d.doc_id, l.quality AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 AND l.quality IS NOT NULL"),
    "binary_metrics": ("K7 K8", f"WITH {VOTES}, s AS (SELECT {SUMS} FROM cells) SELECT {RATES} FROM s"),
    "subgroup_metrics": ("I4 I5 K13", f"WITH {VOTES}, s AS (SELECT source, lang, {SUMS} FROM cells GROUP BY GROUPING SETS ((source), (lang), ())) SELECT source, lang, {RATES} FROM s"),
    "generator_vs_reals": ("I6", f"""WITH {VOTES}, g AS (SELECT source AS generator, count_if(truth = 0) AS reals, count_if(truth = 1) AS own, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn FROM cells GROUP BY source),
s AS (SELECT generator, CAST(own + sum(reals) OVER () AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(sum(fp) OVER () AS BIGINT) AS fp, CAST(sum(tn) OVER () AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn FROM g) SELECT generator, {RATES} FROM s"""),
    "leave_one_out": ("I7", """WITH r AS (SELECT CASE WHEN quality = 1 THEN 'real' ELSE source END AS generator, quality, CASE l.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT generator, count_if(split <> 'test') AS fitting, count_if(split <> 'train') AS held_out, count_if(quality = 1 AND split = 'test') AS real_test, count_if(quality = 1 AND split <> 'test') AS real_fit FROM r GROUP BY generator),
s AS (SELECT generator AS held, CAST(sum(fitting) OVER () - fitting AS BIGINT) AS train, CAST(held_out + sum(real_test) OVER () AS BIGINT) AS test, sum(fitting - real_fit) OVER () - fitting AS fake_fit, sum(real_fit) OVER () AS real_fit, held_out, sum(real_test) OVER () AS real_test FROM g)
SELECT held, train, test, fake_fit > 0 AND real_fit > 0 AND held_out > 0 AND real_test > 0 AS evaluable FROM s WHERE held NOT IN ('real', 'camera', 'unknown')"""),
    "wilson_intervals": ("K9 K10", f"WITH {VOTES}, s AS (SELECT source, {SUMS} FROM cells GROUP BY source), r AS (SELECT source, 'accuracy' AS rate, tp + tn AS k, n FROM s UNION ALL SELECT source, 'sensitivity', tp, tp + fn FROM s UNION ALL SELECT source, 'specificity', tn, tn + fp FROM s UNION ALL SELECT source, 'false_positive_rate', fp, tn + fp FROM s) SELECT source, rate, k, n, {wilson('k', 'n')} FROM r WHERE n > 0"),
    "roc_auc": ("K7", f"WITH {VOTES}, t AS (SELECT floor(1024 * score) AS part, score, count_if(truth = 1) AS p, count_if(truth = 0) AS n FROM votes GROUP BY score), parts AS (SELECT part, sum(sum(n)) OVER (ORDER BY part) - sum(n) AS earlier FROM t GROUP BY part), c AS (SELECT p, n, CAST(earlier + sum(n) OVER (PARTITION BY t.part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) - n / 2.0D AS below FROM t JOIN parts ON t.part = parts.part) SELECT round(sum(p * below) / CAST(sum(p) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 9) AS auc FROM c"),
    "average_precision": ("K7", f"WITH {VOTES}, t AS (SELECT floor(1024 * score) AS part, score, count_if(truth = 1) AS p, count(*) AS n FROM votes GROUP BY score), parts AS (SELECT part, sum(sum(p)) OVER (ORDER BY part DESC) - sum(p) AS earlier_p, sum(sum(n)) OVER (ORDER BY part DESC) - sum(n) AS earlier_n FROM t GROUP BY part), c AS (SELECT p, CAST(earlier_p + sum(p) OVER w AS DOUBLE) AS tp, CAST(earlier_n + sum(n) OVER w AS DOUBLE) AS seen FROM t JOIN parts ON t.part = parts.part WINDOW w AS (PARTITION BY t.part ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(sum(p * tp / seen) / CAST(sum(p) AS DOUBLE), 9) AS average_precision FROM c"),
    "brier": ("K7", f"WITH {VOTES} SELECT round(avg(pow(score - truth, 2)), 9) AS brier FROM votes"),
    "stratified_holdout": ("I12 I11", "WITH r AS (SELECT doc_id, quality, md5(concat(CAST(doc_id AS STRING), '-42')) AS h FROM labels), parts AS (SELECT quality, substring(h, 1, 3) AS part, sum(count(*)) OVER (PARTITION BY quality ORDER BY substring(h, 1, 3)) - count(*) AS earlier FROM r GROUP BY quality, substring(h, 1, 3)), k AS (SELECT r.doc_id, r.quality, earlier + row_number() OVER (PARTITION BY r.quality, parts.part ORDER BY h, doc_id) AS place FROM r JOIN parts ON r.quality IS NOT DISTINCT FROM parts.quality AND substring(r.h, 1, 3) = parts.part) SELECT doc_id, quality, CASE WHEN place <= 30 THEN 'development' WHEN place <= 45 THEN 'holdout' ELSE 'rest' END AS part, doc_id % 4 AS shard FROM k"),
    "overlap_guard": ("I13", "WITH parts AS (SELECT doc_id, 'fit' AS part FROM labels WHERE doc_id % 5 < 4 UNION ALL SELECT doc_id, 'test' FROM labels WHERE doc_id % 5 >= 3), t AS (SELECT md5(d.text) AS digest, max(CASE WHEN part = 'fit' THEN 1 ELSE 0 END) AS in_fit, max(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS in_test FROM parts JOIN documents d ON parts.doc_id = d.doc_id GROUP BY md5(d.text)) SELECT count_if(in_fit = 1 AND in_test = 1) AS overlap, count_if(in_fit = 1 AND in_test = 1) = 0 AS allowed FROM t"),
    "flag_union": ("I8 E2 E3", "SELECT user_id, @join(@sorted(@list(event_type)), ',') AS flags FROM (SELECT DISTINCT user_id, event_type FROM events) t GROUP BY user_id"),
    "unique_names": ("I14", "WITH e AS (SELECT event_id, event_type, floor(event_id / 4096) AS part FROM events), parts AS (SELECT event_type, part, sum(count(*)) OVER (PARTITION BY event_type ORDER BY part) - count(*) AS earlier FROM e GROUP BY event_type, part), k AS (SELECT event_id, e.event_type, CAST(earlier + row_number() OVER (PARTITION BY e.event_type, e.part ORDER BY event_id) AS BIGINT) AS place FROM e JOIN parts ON e.event_type = parts.event_type AND e.part = parts.part) SELECT event_id, CASE WHEN place = 1 THEN event_type ELSE concat(event_type, '_', CAST(place AS STRING)) END AS name FROM k"),
    "bbox_iou": ("K16", "WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100.0D AS y, 10.0D + l_tax * 100.0D AS w, 12.0D AS h FROM lineitem), p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, greatest(0.0D, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0D, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h + b.w * b.h AS both_ FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber) SELECT l_orderkey, i, j, round(inter / (both_ - inter), 6) AS iou FROM p"),
    "vector_distance": ("K17", f"WITH {PIX}, c AS (SELECT label, pos, avg(v) AS m FROM pix GROUP BY label, pos) SELECT vec_id, round(sqrt(sum(pow(v - m, 2))), 6) AS distance FROM pix JOIN c ON pix.label = c.label AND pix.pos = c.pos GROUP BY vec_id"),
    "coverage_summary": ("K18", f"WITH {GATE} SELECT fixture, required, present, passed, missing, failing, wrong_fixture, round(100.0D * present / required, 6) AS present_pct, round(100.0D * passed / required, 6) AS passed_pct, missing = 0 AND wrong_fixture = 0 AS coverage_complete, missing = 0 AND wrong_fixture = 0 AND passed = required AS validated FROM fixtures"),
    "readiness": ("K18", f"""WITH {GATE}, e AS (SELECT count_if(undeclared) + count_if(missing) + count_if(repeated) + count_if(wrong_fixture) AS contract_errors FROM states),
f AS (SELECT count(*) AS fixtures, count_if(missing = 0 AND wrong_fixture = 0) AS covered, count_if(missing = 0 AND wrong_fixture = 0 AND passed = required) AS validated, CAST(sum(required) AS BIGINT) AS required, CAST(sum(present) AS BIGINT) AS present, CAST(sum(passed) AS BIGINT) AS passed FROM fixtures)
SELECT fixtures, covered, validated, required, present, passed, required - passed AS failed, (SELECT contract_errors FROM e) AS contract_errors, round(100.0D * covered / fixtures, 6) AS fixture_coverage_pct, round(100.0D * validated / fixtures, 6) AS fixture_pass_pct, round(100.0D * present / required, 6) AS assertion_coverage_pct, round(100.0D * passed / required, 6) AS pass_pct,
  required > 0 AND (SELECT contract_errors FROM e) = 0 AND covered = fixtures AND validated = fixtures AND present = required AND passed = required AS ready_for_demo_regression FROM f"""),
    "skip_segments": ("H4", f"WITH {FRAMES}, matched AS (SELECT user_id, idx, lag(idx) OVER (PARTITION BY user_id ORDER BY idx) AS before FROM frames WHERE event_type <> 'click') SELECT user_id, before AS from_index, idx AS to_index, idx - before - 1 AS skipped FROM matched WHERE idx - before > 1"),
    "histogram_chart": ("L1", f"WITH {PIX}, h AS (SELECT label, CAST(floor(q / 8) AS BIGINT) AS bin, count(*) AS n FROM pix GROUP BY label, CAST(floor(q / 8) AS BIGINT)) SELECT label, bin, n, round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM h"),
    "transition_timeline": ("L2", f"WITH {FRAMES}, t AS (SELECT user_id, idx, us - min(us) OVER (PARTITION BY user_id) AS at_us, abs(value - before) AS mad FROM steps) SELECT user_id, idx, at_us, round(mad, 6) AS mad, round(mad / nullif(max(mad) OVER (PARTITION BY user_id), 0), 6) AS height FROM t WHERE mad IS NOT NULL"),
    "slug_names": ("2.13 string", "SELECT page_id, @btrim(@join(@split(url, '[^0-9A-Za-z._-]+'), '_'), '._') AS slug FROM pages"),
    "run_ids": ("2.13 date", "SELECT event_id, concat(@stamp(ts), '_', @btrim(@join(@split(event_type, '[^0-9A-Za-z._-]+'), '_'), '._')) AS run_id FROM events"),
    "version_parts": ("2.13 regex", f"""WITH v AS (SELECT event_id, concat(CAST(user_id % 4 AS STRING), '.', CASE WHEN event_id % 7 = 0 THEN '01' ELSE CAST(event_id % 12 AS STRING) END, '.', CAST(event_id % 5 AS STRING), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('-rc.', event_type) ELSE '-' END, CASE WHEN event_id % 2 = 0 THEN '+build.5' ELSE '' END) AS version FROM events),
p AS (SELECT event_id, version, regexp_extract(version, '{SEMVER}', 1) AS major FROM v)
SELECT event_id, version, major <> '' AS valid, CAST(nullif(major, '') AS BIGINT) AS major, CAST(nullif(regexp_extract(version, '{SEMVER}', 2), '') AS BIGINT) AS minor, CAST(nullif(regexp_extract(version, '{SEMVER}', 3), '') AS BIGINT) AS patch, nullif(regexp_extract(version, '{SEMVER}', 4), '') AS prerelease, nullif(regexp_extract(version, '{SEMVER}', 5), '') AS build FROM p"""),
    "hash_distance": ("2.13 bit", f"WITH {PIXV}, m AS (SELECT vec_id, pos, v, avg(v) OVER (PARTITION BY vec_id) AS mean FROM pix), h AS (SELECT vec_id, CAST(sum(CASE WHEN v >= mean AND pos < 32 THEN CAST(pow(2, 31 - pos) AS BIGINT) ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN v >= mean AND pos >= 32 THEN CAST(pow(2, 63 - pos) AS BIGINT) ELSE 0 END) AS BIGINT) AS low FROM m GROUP BY vec_id) SELECT a.vec_id, CAST(bit_count((a.high | b.high) - (a.high & b.high)) + bit_count((a.low | b.low) - (a.low & b.low)) AS BIGINT) AS hamming FROM h a JOIN h b ON b.vec_id = a.vec_id + 1"),
    "run_summary": ("L7", f"WITH {FUSION} SELECT count(*) AS files, CAST(sum(family_count) AS BIGINT) AS signals, CAST(count_if(level IN ('moderate', 'high')) AS BIGINT) AS needs_review, count(*) AS inconclusive FROM fusion"),
    "short_result": ("", "SELECT doc_id, substring(text, 1, 650) AS excerpt, length(text) > 650 AS truncated FROM documents"),
    "manifest_split": ("A7 A8 A10", "SELECT doc_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS synthetic, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM labels"),
}
