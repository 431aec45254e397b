"""Image rules over pages: the code points of a page's html, modulo 256, as an image of 32 columns. Each query deals the pages
out and measures them in one Arrow map; the checking engine states the same by joins of pixels. The rules as expressions inside
a row are in `prismspark.operators.planes`; on whole pages those take some fifty times the time of array kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.functions import pixels
from prismspark.session import read_table, ship

WIDTH = 32


def page_image(html: str | None) -> np.ndarray:
    """Rows of 32 levels; what does not fill a row is left out, and null pages are images without rows."""
    codes = np.frombuffer((html or "").encode("utf-32-le"), "<u4")
    height = codes.size // WIDTH
    return (codes[: height * WIDTH] % 256).astype(np.int64).reshape(height, WIDTH)


def measured(spark: SparkSession, sf_dir: str, schema: str, kernel: Callable[[np.ndarray], tuple]) -> DataFrame:
    """page_id and what kernel gives for the image of each page. A file of pages may be one row group and so one task, and
    measuring costs more than moving a page, so pages are dealt out first."""
    ship(spark)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"LONG": pa.int64(), "DOUBLE": pa.float64(), "STRING": pa.string()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernel(page_image(html.as_py())) for html in batch.column(1)]
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", *names])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {schema}")


def rounded(names: list[str]) -> list[F.Column]:
    return [F.round(n, 9).alias(n) for n in names]


def periodicity_row(image: np.ndarray) -> tuple:
    found = pixels.dct_periodicity(image, 6)
    counted = found["dct_bins"] >= 5
    return int(found["dct_blocks"]), found["dct_score"], found["dct_zero_fraction"] if counted else None


def page_dct_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(spark, sf_dir, "n_blocks LONG, score DOUBLE, zero_bin_fraction DOUBLE", periodicity_row)
    return found.select("page_id", "n_blocks", *rounded(["score", "zero_bin_fraction"]))


HAAR = [f"l{k}_{n}" for k in (1, 2, 3) for n in ("lh", "hl", "hh", "hf_total")]


def haar_row(image: np.ndarray) -> tuple:
    found = list(pixels.haar_energies(image.astype(float)).values())
    # Levels under four pixels a side have none.
    levels = sum(min(image.shape) >> k >= 4 for k in range(3))
    return tuple(found[: 4 * levels] + [None] * (12 - 4 * levels))


def page_haar_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(spark, sf_dir, ", ".join(f"{n} DOUBLE" for n in HAAR), haar_row)
    return found.select("page_id", *rounded(HAAR))


GLCM = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]


def glcm_row(image: np.ndarray) -> tuple:
    """Null where a step finds no pair."""
    return tuple(pixels.cooccurrence(image // 16).values()) if image.shape[0] >= 3 else (None,) * 5


def page_glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(spark, sf_dir, ", ".join(f"{n} DOUBLE" for n in GLCM), glcm_row)
    return found.select("page_id", *rounded(GLCM))


def hash_row(image: np.ndarray) -> tuple:
    """Null under 32 rows, where the image would have to be made larger."""
    return (pixels.dct_hash(image.astype(float), 6) if image.shape[0] >= 32 else None,)


def page_dct_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir, "dct_hash STRING", hash_row)


def peak_row(image: np.ndarray) -> tuple:
    return pixels.replication_peak(image.mean(axis=1), 9) if len(image) else (0.0, 0)


def page_profile_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measured(spark, sf_dir, "peak DOUBLE, lag LONG", peak_row)
    return found.select("page_id", F.round("peak", 6).alias("peak"), "lag")


#: name: (operators of the survey it covers, query).
PLANES = {
    "page_dct_periodicity": ("G1", page_dct_periodicity),
    "page_haar_levels": ("G4", page_haar_levels),
    "page_glcm": ("G6", page_glcm),
    "page_dct_hash": ("C9", page_dct_hash),
    "page_profile_peak": ("G13", page_profile_peak),
}

_PX = r"""s AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s).') AS c, len(c) // 32 AS h FROM pages),
k AS (SELECT page_id, c, h, unnest(range(h * 32)) AS k FROM s),
px AS (SELECT page_id, h, k // 32 AS y, k % 32 AS x, (unicode(c[k + 1]) % 256)::DOUBLE AS v FROM k)"""


def _haar(level: int, before: str) -> str:
    """Quads of one level, and the next image; sides of the image before are in its rows."""
    return f"""q{level} AS (SELECT page_id, y // 2 AS y, x // 2 AS x, any_value(h) // 2 AS h, any_value(w) // 2 AS w, sum(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS a, sum(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS b, sum(v) FILTER (y % 2 = 1 AND x % 2 = 0) AS c, sum(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS d
  FROM {before} WHERE h >= 4 AND w >= 4 AND y < h - h % 2 AND x < w - w % 2 GROUP BY page_id, y // 2, x // 2),
e{level} AS (SELECT page_id, avg(pow((a - b + c - d) * 0.5, 2)) AS lh, avg(pow((a + b - c - d) * 0.5, 2)) AS hl, avg(pow((a - b - c + d) * 0.5, 2)) AS hh FROM q{level} GROUP BY page_id),
x{level} AS (SELECT page_id, y, x, h, w, (a + b + c + d) * 0.5 AS v FROM q{level})"""


ORACLES = {
    "page_dct_periodicity": f"""WITH {_PX},
q AS (SELECT page_id, round_even(round(sum((v - 128) * 0.25 * cos((2 * (y % 8) + 1) * pi() / 16) * cos((2 * (x % 8) + 1) * pi() / 8)), 6), 0)::BIGINT AS q FROM px WHERE y < h - h % 8 GROUP BY page_id, y // 8, x // 8),
r AS (SELECT page_id, count(*) AS n, trunc(round(quantile_cont(q, 0.02), 6))::BIGINT AS lo, trunc(round(quantile_cont(q, 0.98), 6))::BIGINT AS hi FROM q GROUP BY page_id),
bins AS (SELECT page_id, lo, hi, unnest(range(lo, hi + 1)) AS b FROM r WHERE n >= 10),
hist AS (SELECT bins.page_id, b, count(q.q) AS n FROM bins LEFT JOIN q ON q.page_id = bins.page_id AND (q.q = b OR (b = hi AND q.q = b + 1)) GROUP BY bins.page_id, b),
steps AS (SELECT page_id, n, abs(n - lag(n) OVER (PARTITION BY page_id ORDER BY b)) AS d FROM hist),
f AS (SELECT page_id, avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z, avg(d) / (avg(n) + 1e-9) AS alt FROM steps GROUP BY page_id HAVING count(*) >= 5)
SELECT s.page_id, coalesce(r.n, 0)::BIGINT AS n_blocks, round(CASE WHEN z IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.5 * z + 0.05 * alt) END, 9) AS score, round(z, 9) AS zero_bin_fraction FROM s LEFT JOIN r USING (page_id) LEFT JOIN f USING (page_id)""",
    "page_haar_levels": f"""WITH {_PX}, x0 AS (SELECT page_id, y, x, h, 32 AS w, v / 255.0 AS v FROM px), {', '.join(_haar(k, f'x{k - 1}') for k in (1, 2, 3))}
SELECT s.page_id, {', '.join(f'round(e{k}.{n}, 9) AS l{k}_{n}' for k in (1, 2, 3) for n in ('lh', 'hl', 'hh'))}, {', '.join(f'round(e{k}.lh + e{k}.hl + e{k}.hh, 9) AS l{k}_hf_total' for k in (1, 2, 3))}
FROM s LEFT JOIN e1 USING (page_id) LEFT JOIN e2 USING (page_id) LEFT JOIN e3 USING (page_id)""",
    "page_glcm": f"""WITH {_PX}, g AS (SELECT page_id, y, x, floor(v / 16)::BIGINT AS g FROM px),
o(step, dy, dx) AS (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 0, 2), (4, 1, 1), (5, 2, 0)),
far AS (SELECT page_id, step, y + dy AS y, x + dx AS x, g AS i FROM g, o),
one AS (SELECT page_id, step, i, g AS j FROM far JOIN g USING (page_id, y, x)),
sides AS (SELECT * FROM one UNION ALL SELECT page_id, step, j, i FROM one),
cells AS (SELECT page_id, step, i, j, count(*) AS n FROM sides GROUP BY page_id, step, i, j),
p AS (SELECT page_id, step, i, j, n / sum(n) OVER (PARTITION BY page_id, step) AS p FROM cells),
m AS (SELECT page_id, step, sum(p * i) AS m FROM p GROUP BY page_id, step),
f AS (SELECT p.page_id, p.step, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy,
  CASE WHEN sum(p * (i - m) * (i - m)) < 1e-15 THEN 1.0::DOUBLE ELSE sum(p * (i - m) * (j - m)) / sum(p * (i - m) * (i - m)) END AS correlation FROM p JOIN m USING (page_id, step) GROUP BY p.page_id, p.step),
a AS (SELECT page_id, avg(contrast) AS contrast, avg(dissimilarity) AS dissimilarity, avg(homogeneity) AS homogeneity, avg(energy) AS energy, avg(correlation) AS correlation FROM f GROUP BY page_id HAVING count(*) = 6)
SELECT s.page_id, round(contrast, 9) AS contrast, round(dissimilarity, 9) AS dissimilarity, round(homogeneity, 9) AS homogeneity, round(energy, 9) AS energy, round(correlation, 9) AS correlation FROM s LEFT JOIN a USING (page_id)""",
    "page_dct_hash": f"""WITH {_PX},
small AS (SELECT page_id, t AS y, x, round_even(round(sum(v * (least((t + 1) * h / 32.0::DOUBLE, y + 1) - greatest(t * h / 32.0::DOUBLE, y))) / any_value(h / 32.0::DOUBLE), 6), 0) AS v FROM px JOIN range(32) r(t) ON y < (t + 1) * h / 32.0::DOUBLE AND y + 1 > t * h / 32.0::DOUBLE WHERE h >= 32 GROUP BY page_id, t, x),
lines AS (SELECT page_id, y, b AS b, sum(v * sqrt(CASE WHEN b = 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) * cos((2 * x + 1) * b * pi() / 64)) AS v FROM small, range(8) r(b) GROUP BY page_id, y, b),
c AS (SELECT page_id, a, b, round(sum(v * sqrt(CASE WHEN a = 0 THEN 1 ELSE 2 END / 32.0::DOUBLE) * cos((2 * y + 1) * a * pi() / 64)), 6) AS c FROM lines, range(8) r(a) GROUP BY page_id, a, b),
m AS (SELECT page_id, median(c) AS m FROM c WHERE a > 0 GROUP BY page_id),
n AS (SELECT page_id, (a * 8 + b) // 4 AS nibble, sum(CASE WHEN c >= m THEN 8 >> ((a * 8 + b) % 4)::INT ELSE 0 END)::INT AS n FROM c JOIN m USING (page_id) GROUP BY page_id, (a * 8 + b) // 4),
w AS (SELECT page_id, string_agg(substr('0123456789abcdef', n + 1, 1), '' ORDER BY nibble) AS dct_hash FROM n GROUP BY page_id)
SELECT s.page_id, dct_hash FROM s LEFT JOIN w USING (page_id)""",
    "page_profile_peak": f"""WITH {_PX}, rows_ AS (SELECT page_id, y, any_value(h) AS n, avg(v) AS v FROM px GROUP BY page_id, y),
z AS (SELECT page_id, y, n, v - avg(v) OVER (PARTITION BY page_id) AS z FROM rows_),
e AS (SELECT page_id, any_value(n) AS n, sum(z * z) AS e, greatest(2, any_value(n) // 64) AS first_, greatest(greatest(2, any_value(n) // 64) + 1, any_value(n) // 2) AS end_ FROM z GROUP BY page_id),
c AS (SELECT a.page_id, b.y - a.y AS lag_, round(sum(a.z * b.z) / any_value(e.e), 9) AS c FROM z a JOIN e ON e.page_id = a.page_id JOIN z b ON b.page_id = a.page_id AND b.y - a.y >= first_ AND b.y - a.y < end_ WHERE e.n >= 8 AND e.e > 1e-12 GROUP BY a.page_id, b.y - a.y),
best AS (SELECT page_id, max(c) AS peak, arg_max(lag_, (c, -lag_)) AS lag FROM c GROUP BY page_id)
SELECT s.page_id, round(coalesce(peak, 0.0::DOUBLE), 6) AS peak, coalesce(lag, 0)::BIGINT AS lag FROM s LEFT JOIN best USING (page_id)""",
}
