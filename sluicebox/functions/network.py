"""Inference with the masked-image encoder and decoder, in NumPy, for use inside Arrow-batched functions.

Weights come as a mapping of names to arrays; `manifest` lists the names and shapes, which are those under which
checkpoints of this architecture are stored, so that a checkpoint's arrays can be used as they are. Training is left
to a tensor framework; the tables that it reads and writes are in sluicebox.operators.training.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Channels out, kernel, stride of the first block, expansion and number of blocks of each stage.
STAGES = ((16, 3, 1, 1, 1), (24, 3, 2, 6, 2), (40, 5, 2, 6, 2), (80, 3, 2, 6, 3), (112, 5, 1, 6, 3), (192, 5, 2, 6, 4), (320, 3, 1, 6, 1))
#: Channels of the stem, of the last layer of the encoder, and of the decoder's steps.
STEM, TOP, DECODER, SQUEEZE = 32, 1280, (512, 256, 128, 64), 0.25
SIDE = 384
Weights = Mapping[str, np.ndarray]


def _blocks():
    """(name, channels in, hidden, channels out, kernel, stride, expands) of every block."""
    inside = STEM
    for s, (out, kernel, stride, expand, repeat) in enumerate(STAGES):
        for b in range(repeat):
            yield f"encoder.stages.{s}.{b}.conv", inside, inside * expand, out, kernel, stride if b == 0 else 1, expand != 1
            inside = out


def _norm(name: str, channels: int) -> list[tuple[str, tuple[int, ...]]]:
    return [(f"{name}.{part}", (channels,)) for part in ("weight", "bias", "running_mean", "running_var")]


def manifest() -> list[tuple[str, tuple[int, ...]]]:
    """Names and shapes of all arrays; running statistics are not trained."""
    out = [("encoder.stem.0.weight", (STEM, 3, 3, 3)), *_norm("encoder.stem.1", STEM)]
    for name, inside, hidden, outside, kernel, _, expands in _blocks():
        k = 0
        if expands:
            out += [(f"{name}.0.weight", (hidden, inside, 1, 1)), *_norm(f"{name}.1", hidden)]
            k = 3
        squeezed = max(1, int(hidden * SQUEEZE))
        out += [(f"{name}.{k}.weight", (hidden, 1, kernel, kernel)), *_norm(f"{name}.{k + 1}", hidden)]
        out += [(f"{name}.{k + 3}.fc1.weight", (squeezed, hidden, 1, 1)), (f"{name}.{k + 3}.fc1.bias", (squeezed,))]
        out += [(f"{name}.{k + 3}.fc2.weight", (hidden, squeezed, 1, 1)), (f"{name}.{k + 3}.fc2.bias", (hidden,))]
        out += [(f"{name}.{k + 4}.weight", (outside, hidden, 1, 1)), *_norm(f"{name}.{k + 5}", outside)]
    out += [("encoder.top_conv.0.weight", (TOP, STAGES[-1][0], 1, 1)), *_norm("encoder.top_conv.1", TOP)]
    inside = TOP
    for step, channels in enumerate((*DECODER, 3)):
        name = f"decoder.decoder.{4 * step}"
        out += [(f"{name}.weight", (channels, inside, 3, 3)), (f"{name}.bias", (channels,))]
        if channels != 3:
            out += _norm(f"decoder.decoder.{4 * step + 1}", channels)
        inside = channels
    return out


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights: convolutions normal by their fan-out, scales 1 and shifts 0."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in manifest():
        if len(shape) == 4:
            out[name] = (rng.standard_normal(shape) * np.sqrt(2 / (shape[0] * shape[2] * shape[3]))).astype(np.float32)
        else:
            out[name] = np.full(shape, 1 if name.endswith(("running_var", "weight")) else 0, np.float32)
    return out


def convolved(x: np.ndarray, weight: np.ndarray, stride: int = 1, bias: np.ndarray | None = None) -> np.ndarray:
    """(images, channels, rows, columns) correlated with (out, in, k, k), zeros around; in = 1 is one filter per
    channel."""
    k = weight.shape[2]
    if k == 1 and stride == 1:
        out = np.tensordot(weight[:, :, 0, 0], x, (1, 1)).swapaxes(0, 1)
    else:
        padded = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
        rows, columns = (-(-s // stride) for s in x.shape[2:])
        out = 0
        for i in range(k):
            for j in range(k):
                part = padded[:, :, i : i + stride * (rows - 1) + 1 : stride, j : j + stride * (columns - 1) + 1 : stride]
                tap = weight[:, :, i, j]
                out = out + (part * tap[:, 0, None, None] if weight.shape[1] == 1 and x.shape[1] > 1 else np.tensordot(tap, part, (1, 1)).swapaxes(0, 1))
    return out if bias is None else out + bias[:, None, None]


def normalised(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    scale = w[f"{name}.weight"] / np.sqrt(w[f"{name}.running_var"] + 1e-5)
    return x * scale[:, None, None] + (w[f"{name}.bias"] - w[f"{name}.running_mean"] * scale)[:, None, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -80, 80)))


def swish(x: np.ndarray) -> np.ndarray:
    return x * sigmoid(x)


def gelu(x: np.ndarray) -> np.ndarray:
    """With the error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * x * (1 + np.sign(x) * (1 - tail))


def excited(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Channels scaled by what their means say."""
    means = x.mean(axis=(2, 3), keepdims=True)
    hidden = swish(convolved(means, w[f"{name}.fc1.weight"], bias=w[f"{name}.fc1.bias"]))
    return x * sigmoid(convolved(hidden, w[f"{name}.fc2.weight"], bias=w[f"{name}.fc2.bias"]))


def block(x: np.ndarray, w: Weights, name: str, stride: int, expands: bool, outside: int) -> np.ndarray:
    y, k = x, 0
    if expands:
        y, k = swish(normalised(convolved(y, w[f"{name}.0.weight"]), w, f"{name}.1")), 3
    y = swish(normalised(convolved(y, w[f"{name}.{k}.weight"], stride), w, f"{name}.{k + 1}"))
    y = normalised(convolved(excited(y, w, f"{name}.{k + 3}"), w[f"{name}.{k + 4}.weight"]), w, f"{name}.{k + 5}")
    return x + y if stride == 1 and x.shape[1] == outside else y


def encode(images: np.ndarray, w: Weights) -> list[np.ndarray]:
    """The outputs of the seven stages and of the last layer, for images (n, 3, rows, columns) in 0..1."""
    x = swish(normalised(convolved(images, w["encoder.stem.0.weight"], 2), w, "encoder.stem.1"))
    ends = np.cumsum([s[-1] for s in STAGES]) - 1
    out = []
    for i, (name, _, _, outside, _, stride, expands) in enumerate(_blocks()):
        x = block(x, w, name, stride, expands, outside)
        if i in ends:
            out.append(x)
    return [*out, swish(normalised(convolved(x, w["encoder.top_conv.0.weight"]), w, "encoder.top_conv.1"))]


def _interpolation(size: int, out: int) -> np.ndarray:
    """out x size weights of linear interpolation between pixel centres, edges held."""
    at = np.clip((np.arange(out) + 0.5) * size / out - 0.5, 0, size - 1)
    low = np.minimum(at.astype(int), max(0, size - 2))
    w = np.zeros((out, size), np.float32)
    w[np.arange(out), low] = 1 - (at - low)
    w[np.arange(out), np.minimum(low + 1, size - 1)] += at - low
    return w


def resized(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return _interpolation(x.shape[2], rows) @ x @ _interpolation(x.shape[3], columns).T


def decode(features: np.ndarray, w: Weights, side: int = SIDE) -> np.ndarray:
    x = features
    for step in range(len(DECODER)):
        name = f"decoder.decoder.{4 * step}"
        x = gelu(normalised(convolved(x, w[f"{name}.weight"], bias=w[f"{name}.bias"]), w, f"decoder.decoder.{4 * step + 1}"))
        x = resized(x, 2 * x.shape[2], 2 * x.shape[3])
    name = f"decoder.decoder.{4 * len(DECODER)}"
    return resized(convolved(x, w[f"{name}.weight"], bias=w[f"{name}.bias"]), side, side)


def masked(images: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """images with the patches flagged in (n, p, p) set to 0."""
    size = images.shape[2] // flags.shape[1]
    return images * ~np.kron(flags.astype(bool), np.ones((size, size), bool))[:, None]


def reconstructed(images: np.ndarray, flags: np.ndarray, w: Weights) -> tuple[np.ndarray, float]:
    """What the model makes of masked images, and its mean absolute error over masked pixels."""
    made = decode(encode(masked(images, flags), w)[-1], w, images.shape[2])
    size = images.shape[2] // flags.shape[1]
    under = np.kron(flags.astype(bool), np.ones((size, size), bool))[:, None]
    total = under.sum() * images.shape[1]
    return made, float((np.abs(made - images) * under).sum() / total) if total else float("nan")


def classified(images: np.ndarray, w: Weights, head: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of a linear head over the pooled features."""
    return encode(images, w)[-1].mean(axis=(2, 3)) @ head.T + bias


def features_udf(weights: dict[str, np.ndarray], side: int = SIDE, batch: int = 8):
    """Pooled features (array<float>) of columns of flattened images (3 * side * side floats)."""
    def make():
        return lambda images: encode(images, weights)[-1].mean(axis=(2, 3)).astype(np.float32)

    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[3, side, side]])


def stages_udf(weights: dict[str, np.ndarray], side: int = SIDE):
    """array<struct<stage,shape,data>> of an image's eight outputs, from columns of flattened images."""

    @F.pandas_udf("array<struct<stage:int,shape:array<int>,data:array<float>>>")
    def udf(images: pd.Series) -> pd.Series:
        rows = []
        for image in images:
            found = encode(np.asarray(image, np.float32).reshape(1, 3, side, side), weights)
            rows.append([{"stage": k + 1, "shape": list(x.shape[1:]), "data": x.ravel().astype(np.float32).tolist()} for k, x in enumerate(found)])
        return pd.Series(rows)

    return udf.asNondeterministic()
