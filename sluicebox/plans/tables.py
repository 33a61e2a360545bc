"""Queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import numeric, text
from sluicebox.operators import review, robust, sequence, training, video
from sluicebox.session import table
from sluicebox.storage import global_index, spread

LINEITEM = {"l_quantity": True, "l_extendedprice": False, "l_discount": False, "l_tax": False}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def mad_reject_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = robust.verdicts(_events(spark, sf_dir).select("event_id", "event_type", "value"), ["event_type"], {"value": False})
    return rated.filter("bad_value").select("event_id", "event_type")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *LINEITEM)
    # At k = 3 these bounded columns have no outliers.
    return robust.verdicts(spread(rows), ["l_returnflag"], LINEITEM, k=1.0)


def mad_bad_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter(robust.any_bad(list(LINEITEM))).select("l_orderkey", "l_linenumber", *[f"bad_{m}" for m in LINEITEM])


def mad_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter(robust.all_kept(list(LINEITEM))).select("l_orderkey", "l_linenumber")


def mad_bad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.bad_counts(_lines(spark, sf_dir), list(LINEITEM))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of several shapes, one per document."""
    n = F.col("doc_id").cast("string")
    long = F.concat(F.lit("shot_"), F.repeat((F.col("doc_id") % 9 + 1).cast("string"), (F.col("doc_id") % 7 + 25).cast("int")), F.lit(".bmp"))
    shapes = [F.concat(F.lit("shot_"), n, F.lit(".jpg")), F.concat(F.lit("img"), n, F.lit("b"), (F.col("doc_id") % 13).cast("string"), F.lit(".PNG")), F.concat(F.lit("a."), n, F.lit(".gif")), F.concat(F.lit("."), n), F.concat(F.lit("v"), n, F.lit(".Tiff")), F.concat(F.lit("00"), n, F.lit(".tif")), long]
    name = F.element_at(F.array(*shapes), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))


def ext_filter_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _names(spark, sf_dir).withColumn("ext", text.extension(F.col("name"))).filter(F.col("ext").isin(*text.IMAGE_EXTENSIONS))
    return global_index(images, text.natural_key(F.col("name")), F.col("name")).select("idx", "name", "ext")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.file_name(F.concat(F.lit("/data/in/"), F.col("name")))
    return _names(spark, sf_dir).select("doc_id", name.alias("name"), text.stem(name).alias("stem"), text.extension(name).alias("ext"))


def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.with_batches(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), size=64)


def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos: urgent ones on the GPU route, and some whose length isn't known."""
    n = F.when(F.col("o_orderkey") % 10 != 3, F.floor(F.col("o_totalprice") / 1000).cast("long"))
    out = video.start_frames(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), n, F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey"))
    return out.select("o_orderkey", "reserved", "start_frame", text.frame_name(F.col("start_frame")).alias("first_file"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe texts: some without a codec, a rate or a duration."""
    k = F.col("p_partkey")
    codecs = F.element_at(F.array(*[F.lit(c) for c in ("H264", "hevc", "mpeg4", "h265", "vp9", "h264_vdpau")]), (k % 6 + 1).cast("int"))
    stream = F.when(k % 11 != 0, F.concat(F.lit("Stream #0:0(und): Video: "), codecs, F.lit(" (High), yuv420p")))
    rate = F.when(k % 7 != 0, F.concat((F.col("p_size") + 10).cast("string"), F.when(k % 2 == 0, ".97").otherwise(""), F.lit(" fps")))
    span = F.when(k % 5 != 0, F.format_string("Duration: %02d:%02d:%02d.%02d", k % 3, k % 60, k * 7 % 60, k * 13 % 100))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", span, stream, rate).alias("stderr"))


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = video.video_info(_probes(spark, sf_dir))
    return info.select("p_partkey", "codec", F.round("fps", 6).alias("fps"), F.round("duration", 6).alias("duration"), "frames")


def codec_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.routed(video.video_info(_probes(spark, sf_dir))).select("p_partkey", "route", "decoder")


def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = video.extraction_plan(_probes(spark, sf_dir), path="p_partkey")
    return plan.select("p_partkey", "route", "reserved", "start_frame", "first_file")


def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files numbered from 500 on."""
    files = table(spark, sf_dir, "orders").select(text.frame_name(F.col("o_orderkey")).alias("name"))
    return video.extraction_report(video.frames_in_range(files, F.col("name"), 500), F.col("name"))


def failed_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planned videos; those with a returned line have succeeded."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return video.failed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


def progress_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    log = F.when(k % 9 == 0, "no progress").otherwise(F.concat(F.lit("frame= "), (k * 3).cast("string"), F.lit(" fps=25\rframe="), (k * 31 % 977).cast("string"), F.lit(" q=2")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.last_progress(log).alias("frames"), text.short_error(log, 9).alias("head"))


def _presses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("event_type").isin("click", "view"), "L").otherwise("R")
    return review.decisions(_events(spark, sf_dir), "user_id", made, F.col("ts"), F.col("event_id"))


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _presses(spark, sf_dir)


def _to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id % 30 + 1 images for every user."""
    users = _events(spark, sf_dir).select("user_id").distinct()
    return users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 30)).alias("idx"))


def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_totals(_to_review(spark, sf_dir), _presses(spark, sf_dir), "user_id")


def review_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.retained(_to_review(spark, sf_dir), _presses(spark, sf_dir), "user_id")


def stable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.steady_stop(_events(spark, sf_dir), "user_id", F.col("value"), F.col("ts"), F.col("event_id"), threshold=10.0)


def minibatch_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.minibatches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=3).select("doc_id", "batch", "place")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(301).select(F.col("id").alias("epoch"), F.round(numeric.lr_factor(F.col("id")) * 1e-4, 12).alias("lr"))


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.best_so_far(_events(spark, sf_dir), "user_id", F.col("value"), F.col("ts"), F.col("event_id")).select("user_id", "event_id", "value")


def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the loss log of an epoch per type."""
    log = training.epoch_losses(_events(spark, sf_dir), "event_type", F.col("event_id"), F.col("value"))
    return log.select("event_type", "event_id", F.floor(F.col("running") * 10000 + 1e-5).alias("running_e4"))


def hsv_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    u = lambda what, most: (numeric.uniform(k, F.lit(what), seed=5) * 2 - 1) * most
    h, s, v = numeric.jitter_hsv((k % 180).cast("double"), (k * 7 % 256).cast("double"), (F.col("p_size") * 5).cast("double"), u("h", 0.02), u("s", 0.1), u("v", 0.1))
    return table(spark, sf_dir, "part").select("p_partkey", h.alias("h"), s.alias("s"), v.alias("v"))


def crop_and_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random crop box for images of many shapes, and whether they are flipped."""
    k = F.col("p_partkey")
    box = numeric.crop_box((400 + k % 2900).cast("double"), (390 + k * 7 % 2000).cast("double"), k, seed=5)
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", box.alias("b"), (numeric.uniform(k, F.lit("flip"), seed=5) < 0.5).alias("flipped")).select("p_partkey", "b.*", "flipped")


def window_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = text.fitted((400 + k % 2900).cast("double"), (390 + k * 7 % 2000).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"), text.status_line(k, F.lit(20_000), F.col("p_name")).alias("status"))


def random_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.one_at_random(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=9)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "decoder.").when(k % 7 == 0, "my.encoder.").otherwise("encoder."), F.lit("stage"), (k % 7).cast("string"), F.lit(".w"), k.cast("string"))
    shape = F.when(k % 4 == 0, F.array(k % 64 + 1)).otherwise(F.array(k % 64 + 1, k % 32 + 1, F.lit(3).cast("long"), F.lit(3).cast("long")))
    return table(spark, sf_dir, "part").select(name.alias("name"), shape.alias("shape"))


def encoder_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.encoder_parameters(_manifest(spark, sf_dir)).select("name", "size")


def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.encoder_parameters(_manifest(spark, sf_dir)).agg(F.count("*").alias("layers"), F.sum("size").alias("parameters"))


QUERIES = {
    q.__name__: q
    for q in (mad_reject_by_type, mad_bad_union, mad_keep_all, mad_bad_counts, ext_filter_natural_order, path_parts, batch_numbers, frame_offsets, duration_parse, codec_route, extraction_plan, extraction_report, failed_requeue, progress_tail, review_decisions, review_totals, review_retained, stable_run, minibatch_drop_last, lr_schedule, best_checkpoint, running_loss, hsv_jitter, crop_and_flip, window_fit, random_row, encoder_keys, parameter_count)
}


def _rated(rows: str, group: str, directions: dict[str, bool], k: int) -> str:
    """rows with keep_<metric>."""
    med = ", ".join(f"median({m}) AS med_{m}" for m in directions)
    mad = ", ".join(f"mad({m}) AS mad_{m}" for m in directions)
    keep = ", ".join(f"(mad_{m} = 0 OR {m} {'>=' if up else '<='} med_{m} {'-' if up else '+'} {k} * mad_{m}) AS keep_{m}" for m, up in directions.items())
    return f"SELECT t.*, {keep} FROM {rows} t JOIN (SELECT {group}, {med}, {mad} FROM {rows} GROUP BY {group}) USING ({group})"


_LINES = f"WITH k AS ({_rated('lineitem', 'l_returnflag', LINEITEM, 1)})"
_ALL = " AND ".join(f"keep_{m}" for m in LINEITEM)
_NAMES = """n AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'shot_' || doc_id || '.jpg' WHEN 1 THEN 'img' || doc_id || 'b' || doc_id % 13 || '.PNG'
    WHEN 2 THEN 'a.' || doc_id || '.gif' WHEN 3 THEN '.' || doc_id WHEN 4 THEN 'v' || doc_id || '.Tiff' WHEN 5 THEN '00' || doc_id || '.tif'
    ELSE 'shot_' || repeat((doc_id % 9 + 1)::VARCHAR, doc_id % 7 + 25) || '.bmp' END AS name FROM documents),
    x AS (SELECT *, lower(regexp_extract(name, '[^.].*(\\.[^.]*)$', 1)) AS ext FROM n)"""
_PROBES = """p AS (SELECT p_partkey, p_partkey AS k, concat_ws(', ',
        CASE WHEN p_partkey % 5 <> 0 THEN printf('Duration: %02d:%02d:%02d.%02d', p_partkey % 3, p_partkey % 60, p_partkey * 7 % 60, p_partkey * 13 % 100) END,
        CASE WHEN p_partkey % 11 <> 0 THEN 'Stream #0:0(und): Video: ' || ['H264', 'hevc', 'mpeg4', 'h265', 'vp9', 'h264_vdpau'][p_partkey % 6 + 1] || ' (High), yuv420p' END,
        CASE WHEN p_partkey % 7 <> 0 THEN (p_size + 10) || CASE WHEN p_partkey % 2 = 0 THEN '.97' ELSE '' END || ' fps' END) AS stderr FROM part),
    i AS (SELECT p_partkey, lower(nullif(regexp_extract(stderr, 'Stream #.*Video:\\s*(\\w+)', 1), '')) AS codec,
        nullif(regexp_extract(stderr, '(\\d+(?:\\.\\d+)?)\\s*fps', 1), '')::DOUBLE AS fps,
        nullif(regexp_extract(stderr, 'Duration:\\s*(\\d+):(\\d+):(\\d+\\.\\d+)', 1), '')::DOUBLE * 3600
        + nullif(regexp_extract(stderr, 'Duration:\\s*(\\d+):(\\d+):(\\d+\\.\\d+)', 2), '')::DOUBLE * 60
        + nullif(regexp_extract(stderr, 'Duration:\\s*(\\d+):(\\d+):(\\d+\\.\\d+)', 3), '')::DOUBLE AS duration FROM p),
    v AS (SELECT *, CASE WHEN fps > 0 AND duration > 0 THEN floor(fps * duration)::BIGINT END AS frames,
        coalesce(codec IN ('h264', 'h264_vdpau', 'hevc', 'h265', 'hevc_vdpau'), false) AS gpu FROM i)"""
_PRESSES = """a AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'L' ELSE 'R' END AS act,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
    q AS (SELECT user_id, n // 2 AS pair, min(act) AS x, max(act) AS y, count(*) AS c FROM a GROUP BY ALL),
    d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pair) AS k, CASE x WHEN 'L' THEN 'KEEP' ELSE 'DELETE' END AS decision
        FROM q WHERE c = 2 AND x = y),
    g AS (SELECT user_id, idx, decision FROM (SELECT user_id, unnest(range(user_id % 30 + 1)) AS idx FROM (SELECT DISTINCT user_id FROM events))
        LEFT JOIN (SELECT user_id, k - 1 AS idx, decision FROM d) USING (user_id, idx))"""


def _u(*parts: str, seed: int = 5) -> str:
    key = " || ':' || ".join((*parts, f"'{seed}'"))
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _draw(k: int) -> str:
    """Columns of the k-th draw of a crop box over p (w, h)."""
    area, aspect = f"w * h * (0.6 + 0.4 * {_u('p_partkey', chr(39) + 'area' + chr(39), str(k))})", f"exp(ln(0.75) + (ln(1.33) - ln(0.75)) * {_u('p_partkey', chr(39) + 'aspect' + chr(39), str(k))})"
    return f"round(sqrt({area} * {aspect})) AS w{k}, round(sqrt({area} / {aspect})) AS h{k}, {_u('p_partkey', chr(39) + 'top' + chr(39), str(k))} AS t{k}, {_u('p_partkey', chr(39) + 'left' + chr(39), str(k))} AS l{k}"


#: Draws of a crop box.
_TRIES = 10


def _choose(drawn: str, else_: str) -> str:
    """The value of the first draw that fits, written with # for its number, or the other."""
    tests = " ".join(f"WHEN w{k} BETWEEN 1 AND w AND h{k} BETWEEN 1 AND h THEN {drawn.replace('#', str(k))}" for k in range(_TRIES))
    return f"CASE {tests} ELSE {else_} END::INT"


ORACLE_SQL = {
    "mad_reject_by_type": f"SELECT event_id, event_type FROM ({_rated('events', 'event_type', {'value': False}, 3)}) WHERE NOT keep_value",
    "mad_bad_union": f"{_LINES} SELECT l_orderkey, l_linenumber, {', '.join(f'NOT keep_{m} AS bad_{m}' for m in LINEITEM)} FROM k WHERE NOT ({_ALL})",
    "mad_keep_all": f"{_LINES} SELECT l_orderkey, l_linenumber FROM k WHERE {_ALL}",
    "mad_bad_counts": f"{_LINES} SELECT {', '.join(f'count(*) FILTER (NOT keep_{m}) AS bad_{m}' for m in LINEITEM)}, count(*) FILTER (NOT ({_ALL})) AS bad FROM k",
    "ext_filter_natural_order": f"""WITH {_NAMES} SELECT row_number() OVER (ORDER BY regexp_extract(name, '^[^0-9]*'),
        lpad(ltrim(regexp_extract(name, '^[^0-9]*([0-9]*)', 1), '0'), 60, '0'), regexp_extract(name, '^[^0-9]*[0-9]*([^0-9]*)', 1),
        lpad(ltrim(regexp_extract(name, '^[^0-9]*[0-9]*[^0-9]*([0-9]*)', 1), '0'), 60, '0'), name) - 1 AS idx, name, ext FROM x
        WHERE ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.tif')""",
    "path_parts": f"WITH {_NAMES} SELECT doc_id, name, left(name, length(name) - length(ext)) AS stem, ext FROM x",
    "batch_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents",
    "frame_offsets": """WITH n AS (SELECT o_orderkey, o_orderpriority <> '1-URGENT' AS cpu, CASE WHEN o_orderkey % 10 = 3 THEN 10000000 ELSE floor(o_totalprice / 1000)::BIGINT + 100 END AS reserved FROM orders),
        s AS (SELECT *, 1 + coalesce(sum(reserved) OVER (ORDER BY o_orderkey % 10 = 3, cpu, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM n)
        SELECT o_orderkey, reserved, start_frame, printf('%011d.jpg', start_frame) AS first_file FROM s""",
    "duration_parse": f"WITH {_PROBES} SELECT p_partkey, codec, round(fps, 6) AS fps, round(duration, 6) AS duration, frames FROM v",
    "codec_route": f"""WITH {_PROBES} SELECT p_partkey, CASE WHEN gpu THEN 'gpu' ELSE 'cpu' END AS route,
        CASE WHEN codec IN ('hevc', 'h265', 'hevc_vdpau') THEN 'hevc_cuvid' WHEN gpu THEN 'h264_cuvid' END AS decoder FROM v""",
    "extraction_plan": f"""WITH {_PROBES}, r AS (SELECT *, coalesce(frames + 100, 10000000) AS reserved FROM v),
        s AS (SELECT *, 1 + coalesce(sum(reserved) OVER (ORDER BY frames IS NULL, NOT gpu, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM r)
        SELECT p_partkey, CASE WHEN gpu THEN 'gpu' ELSE 'cpu' END AS route, reserved, start_frame, printf('%011d.jpg', start_frame) AS first_file FROM s""",
    "extraction_report": "SELECT count(*) AS files, printf('%011d.jpg', min(o_orderkey)) AS first_file, printf('%011d.jpg', max(o_orderkey)) AS last_file FROM orders WHERE o_orderkey >= 500",
    "failed_requeue": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "progress_tail": """SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN greatest(s_suppkey * 3, s_suppkey * 31 % 977) END AS frames,
        CASE WHEN s_suppkey % 9 = 0 THEN 'no progre' ELSE left('frame= ' || s_suppkey * 3 || ' fps=25', 9) END AS head FROM supplier""",
    "review_decisions": f"WITH {_PRESSES} SELECT user_id, k, decision FROM d",
    "review_totals": f"WITH {_PRESSES} SELECT user_id, count(*) AS total, count(*) FILTER (decision = 'KEEP') AS retained, count(*) - count(*) FILTER (decision = 'KEEP') AS deleted FROM g GROUP BY user_id",
    "review_retained": f"WITH {_PRESSES} SELECT user_id, idx FROM g WHERE decision = 'KEEP' AND user_id IN (SELECT user_id FROM g GROUP BY 1 HAVING count(*) = count(decision))",
    "stable_run": """WITH m AS (SELECT user_id, abs(value - lag(value) OVER w) AS d, row_number() OVER w - 1 AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, n, n >= 3 AND sum((coalesce(d, 99) < 10)::INT) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS ok FROM m WHERE n <= 30)
        SELECT user_id, coalesce(min(n) FILTER (ok), max(n)) AS waited, min(n) FILTER (ok) IS NOT NULL AS steady FROM s GROUP BY user_id""",
    "minibatch_drop_last": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':0:3'), doc_id) - 1 AS n, count(*) OVER () AS c FROM documents)
        SELECT doc_id, n // 64 AS batch, n % 64 AS place FROM o WHERE n < c // 64 * 64""",
    "lr_schedule": """SELECT e AS epoch, round(1e-4 * CASE WHEN e < 15 THEN 0.01 + 0.99 * e / 15 ELSE 0.01 + 0.99 * greatest(0, 0.5 * (1 + cos(pi() * (e - 15) / 285))) END, 12)::DOUBLE AS lr FROM range(301) AS t(e)""",
    "best_checkpoint": """SELECT user_id, event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM events)
        WHERE low IS NULL OR value < low""",
    "running_loss": "SELECT event_type, event_id, floor(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 10000 + 1e-5)::BIGINT AS running_e4 FROM events",
    "hsv_jitter": f"""WITH j AS (SELECT p_partkey, p_partkey % 180 + (2 * {_u("p_partkey", "'h'")} - 1) * 0.02 * 180 AS h, p_partkey * 7 % 256 * (1 + (2 * {_u("p_partkey", "'s'")} - 1) * 0.1) AS s,
        p_size * 5 * (1 + (2 * {_u("p_partkey", "'v'")} - 1) * 0.1) AS v FROM part)
        SELECT p_partkey, floor(h - 180 * floor(h / 180))::INT AS h, floor(greatest(0, least(255, s)))::INT AS s, floor(greatest(0, least(255, v)))::INT AS v FROM j""",
    "crop_and_flip": f"""WITH p AS (SELECT p_partkey, (400 + p_partkey % 2900)::DOUBLE AS w, (390 + p_partkey * 7 % 2000)::DOUBLE AS h FROM part),
        z AS (SELECT *, {", ".join(map(_draw, range(_TRIES)))}, CASE WHEN w / h > 1.33 THEN round(h * 1.33) ELSE w END AS ww, CASE WHEN w / h < 0.75 THEN round(w / 0.75) ELSE h END AS hh FROM p)
        SELECT p_partkey, {_choose("floor(t# * (h - h# + 1))", "floor((h - hh) / 2)")} AS top,
               {_choose("floor(l# * (w - w# + 1))", "floor((w - ww) / 2)")} AS left,
               {_choose("h#", "hh")} AS height, {_choose("w#", "ww")} AS width, {_u("p_partkey", "'flip'")} < 0.5 AS flipped FROM z""",
    "window_fit": """WITH p AS (SELECT p_partkey, p_name, (400 + p_partkey % 2900)::DOUBLE AS w, (390 + p_partkey * 7 % 2000)::DOUBLE AS h FROM part),
        s AS (SELECT *, least(1280 / w, 720 / h, 1.0::DOUBLE) AS k FROM p)
        SELECT p_partkey, floor(w * k)::INT AS width, floor(h * k)::INT AS height, '[' || (p_partkey + 1) || '/20000] ' || p_name AS status FROM s""",
    "random_row": "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':9'), doc_id LIMIT 1",
    "encoder_keys": """WITH m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'decoder.' WHEN p_partkey % 7 = 0 THEN 'my.encoder.' ELSE 'encoder.' END || 'stage' || p_partkey % 7 || '.w' || p_partkey AS name FROM part)
        SELECT substr(name, 9) AS name, CASE WHEN k % 4 = 0 THEN k % 64 + 1 ELSE (k % 64 + 1) * (k % 32 + 1) * 9 END AS size FROM m WHERE starts_with(name, 'encoder.')""",
    "parameter_count": """WITH m AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0)
        SELECT count(*) AS layers, sum(CASE WHEN k % 4 = 0 THEN k % 64 + 1 ELSE (k % 64 + 1) * (k % 32 + 1) * 9 END)::BIGINT AS parameters FROM m""",
}
