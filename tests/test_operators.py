"""Literal edge cases and properties of the operators."""

import math
import random
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluicebox import storage
from sluicebox.functions import numeric, pixels, text
from sluicebox.operators import review, robust, sequence, training, video
from sluicebox.storage import global_index, running_total
from sluicebox.streaming.sequence import stream_fifo_dedup


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    names = ["A.JPG", "b.Tiff", "c.gif", ".jpg", "a..jpg", "x.", "noext", ".a.b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.extension(F.col("n")).alias("e"), text.stem(F.col("n")).alias("s")).collect()
    assert [r.e for r in rows] == [".jpg", ".tiff", ".gif", "", ".jpg", ".", "", ".b"]
    assert [r.s for r in rows] == ["A", "b", "c", ".jpg", "a.", "x", "noext", ".a"]
    shuffled = ["shot_10", "shot_9", "a2b10", "12", "shot_1", "007", "a2b9"]
    got = spark.createDataFrame([(n,) for n in shuffled], "n string").orderBy(text.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in got] == ["007", "12", "a2b9", "a2b10", "shot_1", "shot_9", "shot_10"]
    numbers = ["a" + "9" * 30, "a1" + "0" * 29, "a" + "0" * 40 + "7", "a8", "7x", "-1", "07"]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").orderBy(text.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in got] == ["07", "7x", "-1", "a" + "0" * 40 + "7", "a8", "a1" + "0" * 29, "a" + "9" * 30]
    assert value(spark, text.frame_name(F.lit(123456789012).cast("long"))) == "123456789012.jpg"


def test_probe(spark):
    probe = F.lit("Duration: 01:02:03.50, start\n  Stream #0:0: Video: H264 (High), 25 fps")
    rows = spark.range(1).select(probe.alias("stderr"))
    got = video.routed(video.video_info(rows)).first()
    assert (got.codec, got.fps, got.duration, got.frames, got.route, got.decoder) == ("h264", 25.0, 3723.5, 93087, "gpu", "h264_cuvid")
    probes = [("Duration: 00:00:01.00",), (None,), ("Stream #0: Video: h264, 10 fps",), ("Duration: 00:00:02.00, Stream #0: Video: h264, 10 fps",)]
    plan = video.extraction_plan(spark.createDataFrame(probes, "stderr string").withColumn("path", F.col("stderr")))
    # Videos of unknown length come last, on both routes, and share no number with others.
    rows = [(r.route, r.frames, r.reserved, r.start_frame) for r in plan.orderBy("start_frame").collect()]
    assert rows == [("gpu", 20, 120, 1), ("gpu", None, 10**7, 121), ("cpu", None, 10**7, 121 + 10**7), ("cpu", None, 10**7, 121 + 2 * 10**7)]


def test_sign_hash(spark):
    ones = [0.0] * 31 + [0.0] + [1.0] * 31
    rows = spark.createDataFrame([(ones,), ([1.0] * 63,), ([1.0] * 5,), (None,)], "v array<double>")
    assert [r.h for r in rows.select(numeric.sign_hash(F.col("v")).alias("h")).collect()] == [2**31 - 1, 0, None, None]
    assert value(spark, numeric.hamming(F.lit(2**63 - 1), F.lit(0).cast("long"))) == 63


def plain_fifo(rows, threshold, most):
    queues, kept = {}, []
    for key, at, h in sorted(rows):
        q = queues.setdefault(key, deque(maxlen=most))
        if all((h ^ x).bit_count() >= threshold for x in q):
            q.append(h)
            kept.append((key, at))
    return kept


def test_fifo(spark):
    far = [0xFFFF << 16 * k for k in range(3)]
    rows = [("a", 0, far[0]), ("a", 1, far[0] ^ 0b111), ("a", 2, far[0] ^ 0b1111), ("a", 3, far[1]), ("a", 4, far[2]), ("a", 5, far[0]), ("b", 0, far[0]), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, h long")
    got = sorted((r.k, r.i) for r in sequence.fifo_dedup(df, "k", "i", "h", 4, 3).collect())
    # A distance of the threshold is kept, a shorter one is not; the first hash has left the queue when it returns.
    assert got == [("a", 0), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 0)]
    rng = random.Random(1)
    many = [(i % 3, i, rng.getrandbits(12)) for i in range(3000)]
    df = spark.createDataFrame(many, "k long, i long, h long")
    assert sorted((r.k, r.i) for r in sequence.fifo_dedup(df, "k", "i", "h", 3, 5).collect()) == plain_fifo(many, 3, 5)
    assert sequence.fifo_dedup(df.limit(0), "k", "i", "h").collect() == []


def test_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 2, i, rng.getrandbits(12)) for i in range(400)]
    schema = "k long, i long, h long"
    out = []
    (tmp_path / "in").mkdir()
    stream = stream_fifo_dedup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in"), "k", "i", "h", 3, 5)
    for part in (rows[:150], rows[150:], rows[10:30]):  # the last part comes late
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: out.extend((r.k, r.i) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(out) == plain_fifo(rows, 3, 5)


def test_hamming_pairs(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(63) for _ in range(60)]
    hashes += [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in hashes[:30]] + [hashes[0]]
    df = spark.createDataFrame(list(enumerate(hashes)), "i long, h long")
    want = lambda t: sorted((a, b, d) for b in range(len(hashes)) for a in range(b) if (d := (hashes[a] ^ hashes[b]).bit_count()) < t)
    for threshold, bands in ((4, None), (2, 1), (4, 3), (7, 4), (1, None), (0, None), (26, None)):
        got = sorted(tuple(r) for r in sequence.hamming_pairs(df, "i", "h", threshold, bands=bands).collect())
        assert got == want(threshold), (threshold, bands)
    # More hashes make wider bands worth their neighbouring keys.
    assert sequence.band_count(10**3, 14) > sequence.band_count(10**9, 14) >= 4
    links = sequence.hash_links(spark.createDataFrame([(0, 5)] * 50 + [(1, None)], "i long, h long"), "h", 4)
    assert links.collect() == []


def test_verdicts(spark):
    rows = [("a", float(v)) for v in (10, 10, 11, 12, 12, 5, 4.999, float("nan"))] + [("same", 1.0), ("same", 1.0), ("same", 99.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    up = robust.verdicts(df, ["g"], {"v": True})
    got = {(r.g, str(r.v)): (r.keep_v, r.bad_v) for r in up.collect()}
    data = np.array([10, 10, 11, 12, 12, 5, 4.999])
    low = np.median(data) - 3 * np.median(np.abs(data - np.median(data)))
    for v in data:
        assert got["a", str(v)] == (v >= low, v < low)
    assert got["a", "nan"] == got["none", "None"] == (None, None) and got["same", "99.0"] == (True, False) and got[None, "3.0"] == (True, False)
    empty = robust.funnel(up.limit(0), kept=F.col("keep_v"))
    assert empty.first()[:] == (0, 0, 0.0)


def test_bound_is_inclusive(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 6.0)], "g string, v double")
    low = {r.v: r.keep_v for r in robust.verdicts(df, ["g"], {"v": True}, k=1.5).collect()}  # median 3, MAD 2
    assert low[0.0] is True and not robust.verdicts(df, ["g"], {"v": True}, k=1.49).filter("v = 0").first().keep_v


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), max_size=60))
def test_global_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = robust.global_median(df, F.col("v"))
    assert got == (float(np.median(values)) if values else None) or math.isclose(got, np.median(values))


def test_global_verdicts(spark, monkeypatch):
    monkeypatch.setattr(robust, "MOST_SORTED", 50)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000).round(3), [50.0, -50.0, float("nan")]])
    df = spark.createDataFrame([(0, float(v), float(-v)) for v in values], "g int, v double, w double")
    assert robust.global_median(df, F.col("v")) == float(np.median(values[:-1]))
    sides = {"v": True, "w": False}
    key = lambda r: (str(r.v), r.keep_v, r.bad_v, r.keep_w, r.bad_w)
    assert sorted(map(str, map(key, robust.global_verdicts(df, sides).collect()))) == sorted(map(str, map(key, robust.verdicts(df, ["g"], sides).collect())))
    assert robust.global_verdicts(df.limit(0), sides).collect() == []


def test_clean(spark):
    kept = storage.park(spark.range(3), "x")
    assert kept.count() == 3
    storage.clean(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(kept.inputFiles()[0]).count()
    one, two = storage.park(spark.range(3), "x"), storage.park(spark.range(4), "x")
    storage.drop(one)
    assert two.count() == 4
    with pytest.raises(AnalysisException):
        spark.read.parquet(one._parked).count()


def test_large_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v), None if i % 7 == 0 else float(w)) for g, n in (("a", 30_001), ("b", 10), (None, 500), ("one", 1)) for i, (v, w) in enumerate(zip(rng.normal(size=n).round(2), rng.exponential(size=n)))]
    df = spark.createDataFrame(rows + [("none", None, None), ("nan", float("nan"), 1.0)], "g string, v double, w double")
    plain, large, counted = (sorted(map(str, robust.statistics(df, ["g"], ["v", "w"], big).select("g", "med_v", "med_w", "mad_v", "mad_w").collect())) for big in (False, True, None))
    assert plain == large == counted and len(plain) == 6


def press(spark, pressed):
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(pressed)], "s long, i long, a string")
    return review.decisions(df, "s", F.col("a"), F.col("i"))


def test_review(spark):
    assert [r.decision for r in press(spark, "LLRRLRLL").orderBy("k").collect()] == ["KEEP", "DELETE", "KEEP"]
    assert [r.decision for r in press(spark, "LLR").collect()] == ["KEEP"]
    images = spark.createDataFrame([(1, i) for i in range(2)] + [(2, 0)], "s long, idx long")
    made = press(spark, "LLRRLL")
    assert [(r.s, r.idx) for r in review.retained(images, made, "s").collect()] == [(1, 0)]
    assert sorted(tuple(r) for r in review.review_totals(images, made, "s").collect()) == [(1, 2, 1, 1), (2, 1, 0, 1)]
    assert review.retained(images, press(spark, "LL"), "s").collect() == []  # not finished


def steady(values, threshold, most):
    count = waited = 0
    for a, b in zip(values, values[1:]):
        if count == 3 or waited == most:
            break
        count, waited = (count + 1 if abs(b - a) < threshold else 0), waited + 1
    return waited, count == 3


def test_steady(spark):
    rng = random.Random(4)
    series = {k: [rng.choice([0, 0.1, 0.2, 5]) for _ in range(rng.randint(1, 50))] for k in range(40)}
    df = spark.createDataFrame([(k, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "k long, i long, v double")
    got = {r.k: (r.waited, r.steady) for r in review.steady_stop(df, "k", F.col("v"), F.col("i")).collect()}
    assert got == {k: steady(s, 0.5, 30) for k, s in series.items()}


def test_training(spark):
    flags = spark.range(3).select(training.patch_mask(F.col("id"), 576).alias("m"), training.masked_patches(F.col("id"), 576).alias("p")).collect()
    assert all(sum(r.m) == 345 and {i for i, x in enumerate(r.m) if x} == set(r.p) for r in flags) and flags[0].p != flags[1].p
    made, orig = F.array(*[F.lit(float(x)) for x in range(16)]), F.array(*[F.lit(0.0)] * 16)
    mask = F.array(*[F.lit(x) for x in (True, False, False, False)])
    row = spark.range(1).select(*training.masked_l1(made, orig, mask, 4, 2), training.masked_pixels(made, mask, 4, 2)).first()
    assert row[0] == 0 + 1 + 4 + 5 and row[1] == 4 and [i for i, x in enumerate(row[2]) if x == 0] == [0, 1, 4, 5]
    batches = training.minibatches(spark.range(130).withColumnRenamed("id", "i"), "i", 64).collect()
    assert len(batches) == 128 and {(r.batch, r.place) for r in batches} == {(b, p) for b in (0, 1) for p in range(64)}
    log = spark.createDataFrame(list(enumerate([3.0, 2.0, 2.0, 1.0])), "e long, l double").withColumn("k", F.lit(0))
    assert [r.e for r in training.best_so_far(log, "k", F.col("l"), F.col("e")).orderBy("e").collect()] == [0, 1, 3]
    names = spark.createDataFrame([("encoder.a.w", [2, 3]), ("decoder.b", [4]), ("x.encoder.c", [5]), ("encoder.s", [])], "name string, shape array<int>")
    assert sorted(tuple(r)[0::2] for r in training.encoder_parameters(names).collect()) == [("a.w", 6), ("s", 1)]


def test_schedule_and_jitter(spark):
    rate = lambda e: value(spark, numeric.lr_factor(F.lit(e)))
    assert [round(rate(e), 9) for e in (0, 15, 300)] == [0.01, 1.0, 0.01]
    h, s, v = numeric.jitter_hsv(F.lit(1.0), F.lit(250.0), F.lit(100.0), F.lit(-0.02), F.lit(0.1), F.lit(-0.1))
    assert spark.range(1).select(h, s, v).first()[:] == (177, 255, 90)
    boxes = spark.range(300).select(numeric.crop_box(F.lit(400.0), F.lit(300.0), F.col("id")).alias("b")).select("b.*").collect()
    for b in boxes:
        assert 0 <= b.top <= 300 - b.height and 0 <= b.left <= 400 - b.width and 0.55 * 120_000 <= b.height * b.width
    w, h = text.fitted(F.lit(3264.0), F.lit(2448.0))
    assert spark.range(1).select(w, h).first()[:] == (960, 720)


def test_total_order(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    assert all(r.i == r.idx for r in global_index(df, F.col("i")).collect())
    keyed = storage.running_totals(df.withColumn("k", F.when(F.col("i") > 20, F.col("i") % 2)), "k", {"a": F.col("v"), "n": F.lit(1)}, F.col("i")).collect()
    for r in keyed:
        before = [v for i, v in rows if i < r.i and (i > 20) == (r.i > 20) and (i <= 20 or i % 2 == r.i % 2)]
        assert (r.a, r.n) == (sum(before), len(before))
    assert len(keyed) == 500 and storage.running_totals(df.limit(0), "v", {"a": F.col("i")}, F.col("i")).collect() == []
    sums, seen = 0, {}
    for i, v in sorted(rows):
        seen[i], sums = sums, sums + v
    assert {r.i: r.before for r in running_total(df, F.col("v"), F.col("i")).collect()} == seen
    assert global_index(df.limit(0), F.col("i")).collect() == []


def test_pixels():
    flat = np.full((16, 16), 7)
    assert pixels.ghost(flat) == 0 and pixels.artifact(flat) == 0 and pixels.fringe(flat, flat, flat) == 0
    assert 0 <= pixels.blur(flat) < 1e-9 and pixels.blur(np.zeros((4, 4))) == 0
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 33, 3)).astype(np.uint8)
    got = pixels.scores(image)
    assert 0 <= got["blur"] <= 1 and 0 <= got["fringe"] <= 1 / 3 and got["ghost"] > 0
    assert pixels.gray(np.array([[[7, 100, 200]]]))[0, 0] == round(0.114 * 7 + 0.587 * 100 + 0.299 * 200)
    assert pixels.lab(np.array([[[255, 255, 255], [0, 0, 0]]])).tolist() == [[[255, 128, 128], [0, 128, 128]]]
    assert pixels.area_resized(np.arange(64 * 64).reshape(64, 64) % 200, 32, 32).shape == (32, 32)
    assert len(pixels.low_frequencies(pixels.gray(image))) == 63
    for size, angle in [(2, 0.0), (3, 45.0), (4, 90.0), (5, 0.0), (5, 135.0)]:
        kernel = pixels.motion_kernel(size, angle)
        assert kernel.shape == (size, size) and math.isclose(kernel.sum(), 1) and (kernel >= 0).all()
    assert np.count_nonzero(pixels.motion_kernel(5, 0.0)[2]) == 5
    assert (pixels.motion_blurred(np.full((9, 9, 3), 50, np.uint8), 5, 30.0) == 50).all()
    tensor = pixels.tensor(image)
    assert tensor.shape == (3, 40, 33) and tensor.dtype == np.float32 and math.isclose(tensor[0, 0, 0], image[0, 0, 2] / 255, rel_tol=1e-6)


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (2, 2), (3, 50)])
def test_tiny_images(shape):
    assert all(math.isfinite(x) for x in pixels.scores(np.ones((*shape, 3), np.uint8)).values())
