"""Queries that read 64-float vectors as 8 x 8 images or blocks of low frequencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import pixels
from sluicebox.functions.numeric import sign_hash, swish
from sluicebox.operators import robust, sequence, training
from sluicebox.session import table
from sluicebox.storage import park, spread

SIDE = 8
#: Distances and queue at which some of the test vectors are rejected and some kept.
THRESHOLD, QUEUE = 26, 10


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors]).reshape(-1, SIDE, SIDE)


def _scores():
    @F.pandas_udf("blur double, ghost double, artifact double")
    def udf(vectors: pd.Series) -> pd.DataFrame:
        grid = _stack(vectors) if len(vectors) else np.empty((0, SIDE, SIDE))
        return pd.DataFrame({"blur": pixels.blur(grid), "ghost": pixels.ghost(grid), "artifact": pixels.low_band(grid)})

    return udf.asNondeterministic()


def _fringe():
    @F.pandas_udf("double")
    def udf(light: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(pixels.fringe(_stack(light), _stack(a), _stack(b)) if len(light) else [], dtype="float64")

    return udf.asNondeterministic()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == SIDE * SIDE)


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", sign_hash(F.slice("embedding", 2, 63)).alias("phash"))


def sign_hash63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashes(spark, sf_dir)


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.hamming_pairs(hashes(spark, sf_dir), "vec_id", "phash", 18)


def fifo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashes(spark, sf_dir).withColumn("run", F.lit(0))
    return sequence.fifo_dedup(rows, "run", "vec_id", "phash", THRESHOLD, QUEUE).select("vec_id", "phash")


def fifo_dedup_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.with_batches(hashes(spark, sf_dir), F.col("vec_id"), size=100)
    return sequence.fifo_dedup(rows, "batch", "vec_id", "phash", THRESHOLD, QUEUE).select("batch", "vec_id", "phash")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = vectors(spark, sf_dir).select("vec_id", _scores()("embedding").alias("s"))
    return scored.select("vec_id", *[F.round(f"s.{m}", 6).alias(m) for m in ("blur", "ghost", "artifact")])


def blur_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, sf_dir).select("vec_id", "blur")


def laplacian_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, sf_dir).select("vec_id", "ghost")


def artifact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, sf_dir).select("vec_id", "artifact")


def fringe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in a row as light and two tones; what an incomplete triple lacks is flat."""
    part = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, F.col("embedding"))).alias("Lab"[k])
    flat = F.array_repeat(F.lit(0.0).cast("float"), SIDE * SIDE)
    triples = vectors(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 3).alias("triple")).agg(part(0), part(1), part(2))
    triples = triples.select("triple", *[F.coalesce(c, flat).alias(c) for c in "Lab"])
    return triples.select("triple", F.round(_fringe()("L", "a", "b"), 6).alias("fringe"))


#: Higher is better for blur and ghost.
DIRECTIONS = {"blur": True, "ghost": True, "artifact": False}


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of deduplication with scores and verdicts. Only survivors are scored."""
    kept = fifo_dedup(spark, sf_dir).select("vec_id")
    scored = park(quality_scores(spark, sf_dir).join(kept, "vec_id", "left_semi"), "scores")
    return robust.global_verdicts(scored, DIRECTIONS)


def curation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("vec_id", *DIRECTIONS, robust.all_kept(list(DIRECTIONS)).alias("keep"))


def curation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: all vectors, those left after deduplication, and those that all verdicts keep."""
    names = list(DIRECTIONS)
    left = judged(spark, sf_dir).select("vec_id", robust.all_kept(names).alias("keep"))
    all_ = vectors(spark, sf_dir).select("vec_id").join(left, "vec_id", "left")
    kept = F.coalesce("keep", F.lit(False))
    return robust.funnel(all_, after_dedup=F.col("keep").isNotNull(), retained=kept)


def bad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers among all vectors, without deduplication: any bad verdict is enough."""
    rated = robust.global_verdicts(park(quality_scores(spark, sf_dir), "scores"), DIRECTIONS)
    return rated.filter(robust.any_bad(list(DIRECTIONS))).select("vec_id", *[f"bad_{m}" for m in DIRECTIONS])


def mask_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mask_relation(spread(vectors(spark, sf_dir).select("vec_id")), "vec_id", seed=7)


def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with 9 of their 16 patches of 2 x 2 set to 0."""
    flags = training.patch_mask(F.col("vec_id"), 16, seed=7)
    hidden = training.masked_pixels(F.col("embedding"), F.col("flags"), SIDE, 2)
    return spread(vectors(spark, sf_dir)).withColumn("flags", flags).select("vec_id", F.posexplode(hidden).alias("pixel", "value")).withColumn("value", F.round("value", 6))


def masked_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the reconstruction of the one before it."""
    rows = spread(vectors(spark, sf_dir))
    pairs = rows.select("vec_id", F.col("embedding").alias("original")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("made")), "vec_id")
    pairs = pairs.withColumn("flags", training.patch_mask(F.col("vec_id"), 16, seed=7))
    total, n = training.masked_l1(F.col("made"), F.col("original"), F.col("flags"), SIDE, 2)
    return pairs.select("vec_id", n.cast("long").alias("masked"), F.round(F.try_divide(total, n), 6).alias("loss"))


def channel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the block as channels, pooled and put through the activation."""
    flat = vectors(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("i", "p"))
    flat = flat.select("vec_id", F.floor(F.col("i") / SIDE).cast("long").alias("channel"), F.col("p").cast("double").alias("p"))
    return training.channel_means(flat, "vec_id", "channel", "p").select("vec_id", "channel", F.round("mean", 6).alias("mean"), F.round(swish(F.col("mean")), 6).alias("activated"))


QUERIES = {q.__name__: q for q in (sign_hash63, hamming_pairs, fifo_dedup, fifo_dedup_batched, blur_ratio, laplacian_var, artifact_ratio, fringe_ratio, curation_funnel, curation_report, bad_frames, mask_topk, apply_mask, masked_l1, channel_means)}

_HASH = f"""
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = {SIDE * SIDE}),
    b AS (SELECT vec_id, e[2:64] AS low, list_sort(e[2:64])[32] AS mid FROM v),
    h AS (SELECT vec_id, list_reduce(list_transform(low, lambda x: (x > mid)::BIGINT), lambda x, y: x * 2 + y) AS phash,
                 row_number() OVER (ORDER BY vec_id) AS rn, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS batch FROM b)"""


def _fifo(reset: bool) -> str:
    """Rows (rn, q, kept): the queue after each row of h."""
    old = "CASE WHEN h.batch = r.batch THEN r.q ELSE [] END" if reset else "r.q"
    dup = f"len(list_filter({old}, lambda x: bit_count(xor(x, h.phash)) < {THRESHOLD})) > 0"
    return f"""
    r AS (SELECT rn, batch, [phash] AS q, true AS kept FROM h WHERE rn = 1
          UNION ALL
          SELECT h.rn, h.batch, CASE WHEN {dup} THEN {old} ELSE list_append({old}, h.phash)[-{QUEUE}:] END, NOT ({dup})
          FROM r JOIN h ON h.rn = r.rn + 1)"""


def _at(dy: int, dx: int, name: str = "e") -> str:
    """The pixel beside (y, x), mirrored at the edges."""
    fold = lambda v, d: f"(CASE WHEN {v} + {d} < 0 THEN 1 WHEN {v} + {d} > {SIDE - 1} THEN {SIDE - 2} ELSE {v} + {d} END)"
    return f"{name}[({fold('y', dy)} * {SIDE} + {fold('x', dx)} + 1)::INT]"


_PIXELS = f"px AS (SELECT *, i // {SIDE} AS y, i % {SIDE} AS x FROM v, range({SIDE * SIDE}) AS t(i))"
_SPECTRUM = f"""
    f AS (SELECT vec_id, a, c, sqrt(sum(p * cos(w)) ** 2 + sum(p * sin(w)) ** 2) AS m FROM (
              SELECT vec_id, a, c, e[y * {SIDE} + x + 1] AS p, 2 * pi() * (a * y + c * x) / {SIDE} AS w
              FROM px, range({-SIDE // 2}, {SIDE // 2}) AS r(a), range({-SIDE // 2}, {SIDE // 2}) AS s(c))
          GROUP BY vec_id, a, c)"""
_BLUR = "SELECT vec_id, round(coalesce(sum(m) FILTER (a <> 0 OR c <> 0) / nullif(sum(m), 0), 0), 6) AS blur FROM f GROUP BY vec_id"
_ARTIFACT = "SELECT vec_id, round(coalesce(sum(m) FILTER (a BETWEEN -2 AND 1 AND c BETWEEN -2 AND 1) / nullif(sum(m), 0), 0), 6) AS artifact FROM f GROUP BY vec_id"
_GHOST = f"SELECT vec_id, round(var_pop({_at(-1, 0)} + {_at(1, 0)} + {_at(0, -1)} + {_at(0, 1)} - 4 * {_at(0, 0)}), 6) AS ghost FROM px GROUP BY vec_id"


def _sobel(name: str) -> str:
    x = " + ".join(f"{k} * ({_at(dy, 1, name)} - {_at(dy, -1, name)})" for dy, k in ((-1, 1), (0, 2), (1, 1)))
    y = " + ".join(f"{k} * ({_at(1, dx, name)} - {_at(-1, dx, name)})" for dx, k in ((-1, 1), (0, 2), (1, 1)))
    return f"(abs({x}) + abs({y}))"


_SCORES = f"s AS (SELECT vec_id, blur, ghost, artifact FROM ({_BLUR}) JOIN ({_GHOST}) USING (vec_id) JOIN ({_ARTIFACT}) USING (vec_id))"


def _verdicts(rows: str) -> str:
    """Rows (vec_id, scores, keep_<metric>) over the scores of `rows`."""
    tests = ", ".join(f"(mad({m}) OVER () = 0 OR {m} {'>= median(%s) OVER () - 3 * mad(%s) OVER ()' % (m, m) if up else '<= median(%s) OVER () + 3 * mad(%s) OVER ()' % (m, m)}) AS keep_{m}" for m, up in DIRECTIONS.items())
    return f"SELECT vec_id, blur, ghost, artifact, {tests} FROM {rows}"


_FUNNEL = f"""WITH RECURSIVE {_HASH}, {_fifo(False)}, {_PIXELS}, {_SPECTRUM}, {_SCORES},
    k AS (SELECT s.* FROM s JOIN h USING (vec_id) JOIN r USING (rn) WHERE kept), j AS ({_verdicts("k")})"""
_MASK = "md5(vec_id || ':' || p || ':0:7')"

ORACLE_SQL = {
    "sign_hash63": f"WITH {_HASH} SELECT vec_id, phash FROM h",
    "hamming_pairs": f"WITH {_HASH} SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.phash, y.phash))::INT AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.phash, y.phash)) < 18",
    "fifo_dedup": f"WITH RECURSIVE {_HASH}, {_fifo(False)} SELECT vec_id, phash FROM h JOIN r USING (rn) WHERE kept",
    "fifo_dedup_batched": f"WITH RECURSIVE {_HASH}, {_fifo(True)} SELECT h.batch, vec_id, phash FROM h JOIN r USING (rn) WHERE kept",
    "blur_ratio": f"WITH {_HASH}, {_PIXELS}, {_SPECTRUM} {_BLUR}",
    "laplacian_var": f"WITH {_HASH}, {_PIXELS} {_GHOST}",
    "artifact_ratio": f"WITH {_HASH}, {_PIXELS}, {_SPECTRUM} {_ARTIFACT}",
    "fringe_ratio": f"""
        WITH {_HASH}, z AS (SELECT list_transform(range({SIDE * SIDE}), lambda x: 0.0::DOUBLE) AS e),
        t AS (SELECT n.triple, coalesce(l.e, z.e) AS l, coalesce(a.e, z.e) AS a, coalesce(b.e, z.e) AS b
              FROM (SELECT DISTINCT vec_id // 3 AS triple FROM v) n CROSS JOIN z LEFT JOIN v l ON l.vec_id = 3 * triple
              LEFT JOIN v a ON a.vec_id = 3 * triple + 1 LEFT JOIN v b ON b.vec_id = 3 * triple + 2),
        px AS (SELECT *, i // {SIDE} AS y, i % {SIDE} AS x FROM t, range({SIDE * SIDE}) AS n(i)),
        g AS (SELECT triple, {_sobel("l")} AS plain, sqrt({_sobel("a")} ** 2 + {_sobel("b")} ** 2) AS chroma FROM px),
        n AS (SELECT triple, plain / (max(plain) OVER (PARTITION BY triple) + 1e-8) AS plain,
                     chroma / (max(chroma) OVER (PARTITION BY triple) + 1e-8) AS chroma FROM g)
        SELECT triple, round(count(*) FILTER (chroma > 0.1 AND plain < 0.3) / (3.0 * count(*)), 6)::DOUBLE AS fringe FROM n GROUP BY triple""",
    "curation_funnel": f"{_FUNNEL} SELECT vec_id, blur, ghost, artifact, keep_blur AND keep_ghost AND keep_artifact AS keep FROM j",
    "curation_report": f"""{_FUNNEL} SELECT (SELECT count(*) FROM v) AS total, count(*) AS after_dedup,
        count(*) FILTER (keep_blur AND keep_ghost AND keep_artifact) AS retained,
        round(((SELECT count(*) FROM v) - count(*) FILTER (keep_blur AND keep_ghost AND keep_artifact)) * 100 / (SELECT count(*) FROM v), 2)::DOUBLE AS removal_pct FROM j""",
    "bad_frames": f"""WITH {_HASH}, {_PIXELS}, {_SPECTRUM}, {_SCORES}, j AS ({_verdicts("s")})
        SELECT vec_id, NOT keep_blur AS bad_blur, NOT keep_ghost AS bad_ghost, NOT keep_artifact AS bad_artifact FROM j
        WHERE NOT (keep_blur AND keep_ghost AND keep_artifact)""",
    "mask_topk": f"""WITH {_HASH} SELECT vec_id, p::INT AS patch FROM v, range(576) AS t(p)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_MASK}, p) <= 345""",
    "apply_mask": f"""WITH {_HASH}, m AS (SELECT vec_id, p FROM v, range(16) AS t(p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_MASK}, p) <= 9),
        {_PIXELS} SELECT vec_id, i::INT AS pixel, CASE WHEN (vec_id, (y // 2) * 4 + x // 2) IN (SELECT (vec_id, p) FROM m) THEN 0 ELSE round(e[i + 1], 6) END AS value FROM px""",
    "masked_l1": f"""WITH {_HASH}, m AS (SELECT vec_id, p FROM v, range(16) AS t(p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_MASK}, p) <= 9),
        {_PIXELS} SELECT px.vec_id, count(*) AS masked, round(sum(abs(px.e[i + 1] - w.e[i + 1])) / count(*), 6) AS loss
        FROM px JOIN v w ON w.vec_id = px.vec_id + 1 JOIN m ON m.vec_id = px.vec_id AND m.p = (y // 2) * 4 + x // 2 GROUP BY px.vec_id""",
    "channel_means": f"""WITH {_HASH}, {_PIXELS}, c AS (SELECT vec_id, y AS channel, avg(e[i + 1]) AS m FROM px GROUP BY ALL)
        SELECT vec_id, channel, round(m, 6) AS mean, round(m / (1 + exp(-m)), 6) AS activated FROM c""",
}
