"""Training samples from images: random crop, flip, colour jitter and motion blur, then floats.

Draws depend on the seed, the epoch and the image's key alone, so that reruns and retried tasks agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sluicebox.functions.network import resized
from sluicebox.functions.pixels import motion_blurred, tensor, unpacked

SIDE = 384
#: Bounds of the crop's share of the area and of its aspect, of the colour shifts, and of the blur.
SCALE, RATIO, SHIFTS, BLUR = (0.6, 1.0), (0.75, 1.33), (0.02, 0.1, 0.1), 5


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (0..179, half degrees), saturation and value of (..., 3)."""
    x = rgb.astype(float)
    high, low = x.max(axis=-1), x.min(axis=-1)
    span = np.where(high > low, high - low, 1)
    r, g, b = (x[..., k] for k in range(3))
    sixth = np.select([high == low, high == r, high == g], [0, (g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span)
    saturation = np.divide((high - low) * 255, high, out=np.zeros_like(high), where=high > 0)
    return np.stack([np.rint(sixth % 6 * 30) % 180, np.rint(saturation), high], axis=-1).astype(np.uint8)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    """8-bit RGB."""
    h, s, v = hsv[..., 0] / 30.0, hsv[..., 1] / 255.0, hsv[..., 2].astype(float)
    channel = lambda n: v - v * s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1)
    return np.rint(np.stack([channel(n) for n in (5, 3, 1)], axis=-1)).astype(np.uint8)


def jittered(rgb: np.ndarray, shifts: tuple[float, float, float]) -> np.ndarray:
    hsv = to_hsv(rgb).astype(np.float32)
    hue = (hsv[..., 0] + shifts[0] * 180) % 180
    rest = np.clip(hsv[..., 1:] * (1 + np.array(shifts[1:], np.float32)), 0, 255)
    return from_hsv(np.concatenate([hue[..., None], rest], axis=-1).astype(np.uint8))


def generator(key: object, epoch: int = 0, seed: int = 0) -> np.random.Generator:
    digest = hashlib.md5(f"{key}:{epoch}:{seed}".encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def crop(height: int, width: int, rng: np.random.Generator, tries: int = 10) -> tuple[int, int, int, int]:
    """(top, left, height, width) of the first draw that fits, else the largest centred box within the aspects."""
    for _ in range(tries):
        area, aspect = height * width * rng.uniform(*SCALE), np.exp(rng.uniform(*np.log(RATIO)))
        w, h = round(np.sqrt(area * aspect)), round(np.sqrt(area / aspect))
        if 0 < w <= width and 0 < h <= height:
            return int(rng.integers(height - h + 1)), int(rng.integers(width - w + 1)), h, w
    w, h = min(width, max(1, round(height * RATIO[1]))), min(height, max(1, round(width / RATIO[0])))
    return (height - h) // 2, (width - w) // 2, h, w


def sample(bgr: np.ndarray, rng: np.random.Generator, side: int = SIDE) -> np.ndarray:
    """float32 (3, side, side) in RGB within 0..1."""
    top, left, h, w = crop(*bgr.shape[:2], rng)
    part = bgr[top : top + h, left : left + w].transpose(2, 0, 1)[None].astype(np.float32)
    image = np.rint(resized(part, side, side)[0].transpose(1, 2, 0)).astype(np.uint8)
    if rng.random() < 0.5:
        image = image[::-1]
    rgb = jittered(image[..., ::-1], tuple(rng.uniform(-s, s) for s in SHIFTS))
    return tensor(motion_blurred(rgb, int(rng.integers(2, BLUR + 1)), rng.uniform(0, 180))[..., ::-1])


def samples_udf(epoch: int = 0, seed: int = 0, side: int = SIDE):
    """array<float> of 3 * side * side from data, height, width, channels and the image's key."""

    @F.pandas_udf("array<float>")
    def udf(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([sample(unpacked(d, h, w, c), generator(k, epoch, seed), side).ravel() if d is not None and h > 0 and w > 0 else None for d, h, w, c, k in zip(data, height, width, channels, key)])

    return udf.asNondeterministic()
