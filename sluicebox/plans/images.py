"""Queries that run the curation of images, from pixels on, over pictures made of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import pixels
from sluicebox.operators import robust
from sluicebox.plans import curation
from sluicebox.plans.vectors import SIDE as CELLS
from sluicebox.plans.vectors import vectors
from sluicebox.storage import park, spread

#: A picture has SIDE x SIDE pixels in CELLS x CELLS flat cells; green and red take other cells than blue.
SIDE, SHIFT = 40, 21
_STEP = SIDE // CELLS
#: Distances and sizes at which some of the pictures are rejected and some kept.
THRESHOLD, QUEUE, BATCH, K = 26, 10, 100, 2


def _byte(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value.cast("double") * 300 + 128))).cast("int")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, height, width, channels, data) of one picture per vector; some can't be decoded."""
    each = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def cell(k: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(_byte(F.get(F.col("embedding"), (k + SHIFT * c) % (CELLS * CELLS)))), 2, "0") for c in range(3)])

    line = lambda y: F.array_join(F.transform(each, lambda x: F.repeat(cell(y * CELLS + x), F.lit(_STEP))), "")
    data = F.unhex(F.array_join(F.transform(each, lambda y: F.repeat(line(y), F.lit(_STEP))), ""))
    rows = spread(vectors(spark, sf_dir))
    rows = rows.select(_path().alias("path"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(3).alias("channels"), F.when(F.col("vec_id") % 50 != 7, data).alias("data"))
    return park(rows, "pictures")


def _path() -> Column:
    return F.concat(F.lit("/made/"), F.col("vec_id").cast("string"), F.lit(".png"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.col("vec_id").alias("idx"), _path().alias("path"))
    return rows.select("idx", "path", F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("name"), F.floor(F.col("vec_id") / BATCH).cast("long").alias("batch"))


def _rounded() -> list[Column]:
    return [F.round(m, 6).alias(m) for m in curation.DIRECTIONS]


def image_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, deduplication, scores and verdicts of every picture, batch by batch."""
    made = curation.curate_images(pictures(spark, sf_dir), _catalog(spark, sf_dir), THRESHOLD, QUEUE, BATCH, K)
    return made.select("idx", "batch", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.col("phash").cast("string").alias("phash"), *_rounded(), *[f"keep_{m}" for m in curation.DIRECTIONS], "keep", "fate")


def image_bad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers among all pictures that can be decoded, as one sequence."""
    bad = curation.bad_images(pictures(spark, sf_dir), _catalog(spark, sf_dir), None, K)
    return bad.select("idx", *_rounded(), *[f"bad_{m}" for m in curation.DIRECTIONS])


def image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel of image_curation, with the bytes that were decoded."""
    return curation.report(curation.curate_images(pictures(spark, sf_dir), _catalog(spark, sf_dir), THRESHOLD, QUEUE, BATCH, K))


def _means(make):
    """A UDF: the mean of each channel of what `make` returns, and its value in the second row and column."""

    @F.pandas_udf("array<double>")
    def udf(data: pd.Series) -> pd.Series:
        def one(raw):
            out = make(pixels.unpacked(raw, SIDE, SIDE, 3)).astype(float)
            return np.concatenate([out.mean(axis=(1, 2)), out[:, 1, 1]]).tolist()

        return data.map(one)

    return udf


def image_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red, green and blue of the tensor: their means, and the values of one pixel."""
    rows = pictures(spark, sf_dir).filter("data is not null").select("path", _means(pixels.tensor)("data").alias("m"))
    return rows.select("path", *[F.round(F.get("m", F.lit(i)), 6).alias(n) for i, n in enumerate(("red", "green", "blue", "red_11", "green_11", "blue_11"))])


def image_motion_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blue, green and red after a level motion blur over 5 pixels: their means, and the values of one pixel."""
    blurred = _means(lambda bgr: pixels.motion_blurred(bgr, 5, 0.0).transpose(2, 0, 1))
    rows = pictures(spark, sf_dir).filter("data is not null").select("path", blurred("data").alias("m"))
    return rows.select("path", *[F.round(F.get("m", F.lit(i)), 6).alias(n) for i, n in enumerate(("blue", "green", "red", "blue_11", "green_11", "red_11"))])


QUERIES = {q.__name__: q for q in (image_curation, image_bad_frames, image_report, image_tensor, image_motion_blur)}


def _beside(value: str, by: str, along: str) -> tuple[str, str]:
    """The values before and after a pixel along a row (or column), mirrored at the edges."""
    w = f"(PARTITION BY vec_id, {by} ORDER BY {along})"
    before, after = f"lag({value}) OVER {w}", f"lead({value}) OVER {w}"
    return f"coalesce({before}, {after})", f"coalesce({after}, {before})"


def _edges(channel: str) -> str:
    """|Sobel x| + |Sobel y| of a channel of `tones`, as rows (vec_id, y, x, g_<channel>)."""
    left, right = _beside(channel, "y", "x")
    up_d, down_d = _beside("d", "x", "y")
    up_s, down_s = _beside("s", "x", "y")
    return f"""SELECT vec_id, y, x, abs({up_d} + 2 * d + {down_d}) + abs({down_s} - {up_s}) AS g_{channel} FROM (
        SELECT vec_id, y, x, {right} - {left} AS d, {left} + 2 * {channel} + {right} AS s FROM tones)"""


_LUMA = "((blue * 1868 + green * 9617 + red * 4899 + 8192) // 16384)"
_LINEAR = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE {c} / 255.0::DOUBLE / 12.92 END"
_ROOT = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END"
_HELD = lambda v: f"greatest(0, least(255, round_even({v}, 0)))::BIGINT"
_X = lambda k: f"({' + '.join(f'{w}::DOUBLE * l{c}' for w, c in zip(pixels.XYZ[k], 'rgb'))}) / {pixels.WHITE[k]}::DOUBLE"
_ANGLE = lambda k, i, n: f"2 * pi() * {k} * {i} / {n}"


def _spectrum(rows: str, side: int) -> str:
    """Rows (vec_id, a, c, m): magnitudes of the two-dimensional spectrum of `rows` (vec_id, y, x, luma)."""
    half = f"range({-side // 2}, {side // 2})"
    return f"""SELECT vec_id, a, c, sqrt(sum(re * cos(w) + im * sin(w)) ** 2 + sum(im * cos(w) - re * sin(w)) ** 2) AS m FROM (
        SELECT vec_id, y, c, re, im, a, {_ANGLE("a", "y", side)} AS w FROM (
            SELECT vec_id, y, c, sum(luma * cos(w)) AS re, -sum(luma * sin(w)) AS im FROM (
                SELECT vec_id, y, luma, c, {_ANGLE("c", "x", side)} AS w FROM {rows}, {half} AS t(c)) GROUP BY ALL), {half} AS u(a)) GROUP BY ALL"""


_HALF, _STRIP = max(1, int(SIDE * 0.05)), max(1, int(SIDE * 0.1))
_RADIUS = min(_HALF * 2, _STRIP) // 2 // 2
_PICTURES = f"""
    e AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor(v::DOUBLE * 300 + 128)))::BIGINT) AS e
          FROM embeddings WHERE len(embedding) = {CELLS * CELLS}),
    px AS (SELECT *, {_LUMA} AS luma FROM (
        SELECT vec_id, y, x, e[k + 1] AS blue, e[(k + {SHIFT}) % 64 + 1] AS green, e[(k + {2 * SHIFT}) % 64 + 1] AS red
        FROM (SELECT *, (y // {_STEP}) * {CELLS} + x // {_STEP} AS k FROM e, range({SIDE}) AS r(y), range({SIDE}) AS s(x) WHERE vec_id % 50 <> 7)))"""
_MEASURED = f"""{_PICTURES},
    cover AS (SELECT o, i, greatest(0, least((o + 1) * {SIDE} / 32.0::DOUBLE, i + 1) - greatest(o * {SIDE} / 32.0::DOUBLE, i)) / ({SIDE} / 32.0::DOUBLE) AS share
              FROM range(32) AS r(o), range({SIDE}) AS s(i)),
    wide AS (SELECT vec_id, y, o AS x, sum(luma * share) AS v FROM px JOIN cover ON i = x AND share > 0 GROUP BY ALL),
    small AS (SELECT vec_id, o AS y, x, round_even(sum(v * share), 0) AS v FROM wide JOIN cover ON i = y AND share > 0 GROUP BY ALL),
    basis AS (SELECT k, i, cos(pi() * (2 * i + 1) * k / 64) * sqrt(2 / 32.0::DOUBLE) / CASE k WHEN 0 THEN sqrt(2::DOUBLE) ELSE 1 END AS w FROM range(8) AS r(k), range(32) AS s(i)),
    turned AS (SELECT vec_id, y, k, sum(v * w) AS v FROM small JOIN basis ON i = x GROUP BY ALL),
    freq AS (SELECT vec_id, basis.k * 8 + turned.k AS f, sum(v * w) AS v FROM turned JOIN basis ON i = y GROUP BY ALL),
    low AS (SELECT vec_id, list(v ORDER BY f) AS low, list_sort(list(v))[32] AS mid FROM freq WHERE f > 0 GROUP BY vec_id),
    h AS (SELECT vec_id, list_reduce(list_transform(low, lambda v: (v > mid)::BIGINT), lambda p, q: p * 2 + q) AS phash,
                 row_number() OVER (ORDER BY vec_id) AS rn, vec_id // {BATCH} AS batch FROM low),
    spec AS ({_spectrum("px", SIDE)}),
    blurs AS (SELECT vec_id, coalesce(sum(m) FILTER (a * a + c * c > {int(SIDE * 0.1) ** 2}) / nullif(sum(m), 0), 0) AS blur FROM spec GROUP BY vec_id),
    strip AS (SELECT vec_id, y - {SIDE // 2 - _HALF} AS y, x, luma FROM px WHERE y >= {SIDE // 2 - _HALF} AND y < {SIDE // 2 + _HALF} AND x < {_STRIP}),
    bands AS ({_spectrum("strip", _STRIP)}),
    artifacts AS (SELECT vec_id, coalesce(sum(m) FILTER (a BETWEEN {-_RADIUS} AND {_RADIUS - 1} AND c BETWEEN {-_RADIUS} AND {_RADIUS - 1}) / nullif(sum(m), 0), 0) AS artifact FROM bands GROUP BY vec_id),
    ghosts AS (SELECT vec_id, var_pop(d) AS ghost FROM (
        SELECT vec_id, {" + ".join((*_beside("luma", "y", "x"), *_beside("luma", "x", "y")))} - 4 * luma AS d FROM px) GROUP BY vec_id)"""
_SCORED = f"""{_MEASURED},
    tones AS (SELECT vec_id, y, x, {_HELD("CASE WHEN ty > 0.008856 THEN 116 * cbrt(ty) - 16 ELSE 903.3 * ty END * 255 / 100")} AS light,
                     {_HELD("500 * (fx - fy) + 128")} AS a, {_HELD("200 * (fy - fz) + 128")} AS b FROM (
        SELECT *, {_ROOT("tx")} AS fx, {_ROOT("ty")} AS fy, {_ROOT("tz")} AS fz FROM (
            SELECT *, {_X(0)} AS tx, {_X(1)} AS ty, {_X(2)} AS tz FROM (
                SELECT vec_id, y, x, {_LINEAR("red")} AS lr, {_LINEAR("green")} AS lg, {_LINEAR("blue")} AS lb FROM px)))),
    grads AS (SELECT vec_id, g_light AS plain, sqrt(g_a ** 2 + g_b ** 2) AS chroma
              FROM ({_edges("light")}) JOIN ({_edges("a")}) USING (vec_id, y, x)
              JOIN ({_edges("b")}) USING (vec_id, y, x)),
    tops AS (SELECT vec_id, max(plain) + 1e-8 AS p, max(chroma) + 1e-8 AS q FROM grads GROUP BY vec_id),
    fringes AS (SELECT vec_id, count(*) FILTER (chroma / q > 0.1 AND plain / p < 0.3) / (3.0 * count(*)) AS fringe FROM grads JOIN tops USING (vec_id) GROUP BY vec_id),
    scores AS (SELECT vec_id, vec_id // {BATCH} AS batch, blur, ghost, artifact, fringe::DOUBLE AS fringe
               FROM blurs JOIN ghosts USING (vec_id) JOIN artifacts USING (vec_id) JOIN fringes USING (vec_id))"""


def _verdicts(rows: str, window: str) -> str:
    tests = ", ".join(f"(mad({m}) OVER {window} = 0 OR {m} {f'>= median({m}) OVER {window} - {K} * mad({m}) OVER {window}' if up else f'<= median({m}) OVER {window} + {K} * mad({m}) OVER {window}'}) AS keep_{m}" for m, up in curation.DIRECTIONS.items())
    return f"SELECT *, {tests} FROM {rows}"


_FIFO = f"""
    r AS (SELECT rn, batch, [phash] AS q, true AS kept FROM h WHERE rn = 1
          UNION ALL
          SELECT rn, batch, CASE WHEN dup THEN old ELSE list_append(old, phash)[-{QUEUE}:] END, NOT dup FROM (
              SELECT *, len(list_filter(old, lambda v: bit_count(xor(v, phash)) < {THRESHOLD})) > 0 AS dup FROM (
                  SELECT h.rn, h.batch, h.phash, CASE WHEN h.batch = r.batch THEN r.q ELSE [] END AS old FROM r JOIN h ON h.rn = r.rn + 1)))"""
_ALL = " AND ".join(f"keep_{m}" for m in curation.DIRECTIONS)
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in curation.DIRECTIONS)
_CURATED = f"""WITH RECURSIVE {_SCORED}, {_FIFO},
    k AS (SELECT scores.* FROM scores JOIN h USING (vec_id) JOIN r USING (rn) WHERE kept), j AS ({_verdicts("k", "(PARTITION BY batch)")}),
    m AS (SELECT v.vec_id AS idx, v.vec_id // {BATCH} AS batch, CASE WHEN h.phash IS NOT NULL THEN {SIDE * SIDE * 3} ELSE 0 END::BIGINT AS bytes, h.phash::VARCHAR AS phash, {_ROUNDED},
                 {", ".join(f"keep_{m}" for m in curation.DIRECTIONS)}, coalesce({_ALL}, false) AS keep,
                 CASE WHEN h.phash IS NULL THEN 'unreadable' WHEN j.vec_id IS NULL THEN 'duplicate' WHEN {_ALL} THEN 'kept' ELSE 'outlier' END AS fate
          FROM e v LEFT JOIN h USING (vec_id) LEFT JOIN j USING (vec_id))"""
_PATH = "'/made/' || vec_id || '.png' AS path"

ORACLE_SQL = {
    "image_curation": f"{_CURATED} SELECT * FROM m",
    "image_report": f"""{_CURATED} SELECT count(*) AS total, count(*) FILTER (fate IN ('kept', 'outlier')) AS after_dedup, count(*) FILTER (keep) AS retained,
        coalesce(sum(bytes), 0)::BIGINT AS bytes, round((count(*) - count(*) FILTER (keep)) * 100 / count(*), 2)::DOUBLE AS removal_pct FROM m""",
    "image_bad_frames": f"""WITH {_SCORED}, j AS ({_verdicts("scores", "()")})
        SELECT vec_id AS idx, {_ROUNDED}, {", ".join(f"NOT keep_{m} AS bad_{m}" for m in curation.DIRECTIONS)} FROM j WHERE NOT ({_ALL})""",
    "image_tensor": f"""WITH {_PICTURES} SELECT {_PATH}, {", ".join(f"round(avg(({c} / 255.0::DOUBLE)::FLOAT::DOUBLE), 6) AS {c}" for c in ("red", "green", "blue"))},
        {", ".join(f"round(max(({c} / 255.0::DOUBLE)::FLOAT::DOUBLE) FILTER (y = 1 AND x = 1), 6) AS {c}_11" for c in ("red", "green", "blue"))} FROM px GROUP BY vec_id""",
    "image_motion_blur": f"""WITH {_PICTURES}, places AS (SELECT *, list_transform([-2, -1, 0, 1, 2], lambda d: CASE WHEN x + d < 0 THEN -x - d WHEN x + d > {SIDE - 1} THEN {2 * SIDE - 2} - x - d ELSE x + d END) AS xs FROM px),
        spread AS (SELECT vec_id, y, x, unnest(xs) AS o FROM places),
        made AS (SELECT s.vec_id, s.y, s.x, {", ".join(f"round_even(sum(p.{c}) / 5.0::DOUBLE, 0) AS {c}" for c in ("blue", "green", "red"))}
                 FROM spread s JOIN px p ON p.vec_id = s.vec_id AND p.y = s.y AND p.x = s.o GROUP BY ALL)
        SELECT {_PATH}, {", ".join(f"round(avg({c}), 6)::DOUBLE AS {c}" for c in ("blue", "green", "red"))},
        {", ".join(f"max({c}) FILTER (y = 1 AND x = 1)::DOUBLE AS {c}_11" for c in ("blue", "green", "red"))} FROM made GROUP BY vec_id""",
}
