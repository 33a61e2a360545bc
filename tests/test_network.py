import numpy as np
from pyspark.sql import functions as F

from sluicebox.functions import network as net
from sluicebox.operators import training


def naive(x, w, stride):
    n, c, h, v = x.shape
    o, i, k, _ = w.shape
    p = np.pad(x, ((0, 0), (0, 0), (k // 2,) * 2, (k // 2,) * 2))
    out = np.zeros((n, o, -(-h // stride), -(-v // stride)))
    for a in range(n):
        for b in range(o):
            for y in range(out.shape[2]):
                for z in range(out.shape[3]):
                    window = p[a, :, y * stride : y * stride + k, z * stride : z * stride + k]
                    out[a, b, y, z] = (window[b] * w[b, 0]).sum() if i == 1 and c > 1 else (window * w[b]).sum()
    return out


def test_convolution():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2, 4, 7, 6))
    for shape, stride in [((3, 4, 3, 3), 1), ((3, 4, 3, 3), 2), ((4, 1, 5, 5), 2), ((4, 1, 3, 3), 1), ((5, 4, 1, 1), 1)]:
        w = rng.standard_normal(shape)
        assert np.allclose(net.convolved(x, w, stride), naive(x, w, stride))


def test_parts():
    assert np.allclose(net.gelu(np.array([-1.0, 0.0, 2.0])), [-0.15865525, 0, 1.95449974], atol=1e-6)
    assert np.allclose(net.resized(np.array([[[[0.0, 1.0]]]]), 1, 4), [[[[0, 0.25, 0.75, 1]]]])
    image, flags = np.ones((1, 3, 8, 8)), np.array([[[1, 0], [0, 0]]])
    assert net.masked(image, flags).sum() == 3 * 48


def test_manifest():
    trained = [(n, int(np.prod(s))) for n, s in net.manifest() if "running" not in n]
    assert sum(k for n, k in trained if n.startswith("encoder.")) == 7_142_848
    assert sum(k for n, k in trained if n.startswith("decoder.")) == 7_451_139


def test_forward(spark):
    weights, rng = net.initial(), np.random.default_rng(1)
    images = rng.random((2, 3, 64, 64)).astype(np.float32)
    found = net.encode(images, weights)
    assert [x.shape[1:] for x in found] == [(16, 32, 32), (24, 16, 16), (40, 8, 8), (80, 4, 4), (112, 4, 4), (192, 2, 2), (320, 2, 2), (1280, 2, 2)]
    flags = rng.random((2, 4, 4)) < 0.6
    made, loss = net.reconstructed(images, flags, weights)
    assert made.shape == images.shape and np.isfinite(loss)
    assert net.classified(images, weights, np.ones((2, 1280)), np.zeros(2)).shape == (2, 2)
    rows = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(images)], "id long, image array<float>")
    got = rows.select("id", net.features_udf(weights, 64)("image").alias("f")).orderBy("id").collect()
    assert np.allclose([r.f for r in got], found[-1].mean(axis=(2, 3)), atol=1e-4)
    outputs = rows.filter("id = 0").select(net.stages_udf(weights, 64)("image").alias("s")).first().s
    assert [x.shape for x in outputs] == [list(x.shape[1:]) for x in found] and np.allclose(outputs[7].data, found[7][0].ravel(), atol=1e-4)
    names = spark.createDataFrame([(n, list(map(int, s))) for n, s in net.manifest() if "running" not in n], "name string, shape array<int>")
    assert training.encoder_parameters(names).agg(F.sum("size")).first()[0] == 7_142_848
