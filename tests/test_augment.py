import colorsys

import numpy as np
import pytest

from sluicebox.functions import augment


def test_hsv():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (200, 3)).astype(np.uint8)
    for got, x in zip(augment.to_hsv(rgb), rgb):
        h, s, v = colorsys.rgb_to_hsv(*(x / 255))
        assert abs((int(got[0]) - h * 180 + 90) % 180 - 90) <= 0.51 and abs(got[1] - s * 255) <= 0.51 and got[2] == round(v * 255)
    back = augment.from_hsv(augment.to_hsv(rgb)).astype(int)
    assert np.abs(back - rgb).max() <= 9  # hue has 180 steps
    gray = np.array([[7, 7, 7], [0, 0, 0], [255, 255, 255]], np.uint8)
    assert (augment.jittered(gray, (0.02, 0.1, 0.0)) == gray).all()


def test_crop():
    for h, w in [(100, 100), (1, 1), (10, 1000), (1000, 10)]:
        for k in range(20):
            top, left, a, b = augment.crop(h, w, augment.generator(k))
            assert 0 <= top <= h - a and 0 <= left <= w - b and a > 0 and b > 0


@pytest.mark.parametrize("shape", [(40, 30), (5, 90)])
def test_sample(shape):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 3)).astype(np.uint8)
    one, same, other = (augment.sample(image, augment.generator("a", e), 32) for e in (0, 0, 1))
    assert one.shape == (3, 32, 32) and one.dtype == np.float32 and 0 <= one.min() and one.max() <= 1
    assert (one == same).all() and not (one == other).all()


def test_udf(spark):
    data = bytearray(range(48))
    rows = spark.createDataFrame([("a", data, 4, 4, 3), ("b", data, 4, 4, 3), ("c", None, 0, 0, 3)], "k string, data binary, height int, width int, channels int")
    got = {r.k: r.x for r in rows.select("k", augment.samples_udf(side=16)("data", "height", "width", "channels", "k").alias("x")).collect()}
    assert len(got["a"]) == 768 and got["a"] != got["b"] and got["c"] is None
