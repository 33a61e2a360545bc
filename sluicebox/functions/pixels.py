"""Pixel features in NumPy over stacks of equally large images (..., rows, columns).

Decoding, resizing, transforms and convolutions are beyond SQL expressions; everything decided from their results
(hash bits, thresholds, verdicts) is not done here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: Weights of blue, green and red in 14-bit integer luma.
LUMA = np.array([1868, 9617, 4899])
#: Linear sRGB (red, green, blue) to XYZ, and the D65 white point.
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def gray(bgr: np.ndarray) -> np.ndarray:
    """8-bit luma of (..., rows, columns, 3)."""
    return ((bgr.astype(np.int64) @ LUMA + 8192) >> 14).astype(np.uint8)


def _coverage(size: int, out: int) -> np.ndarray:
    """out x size: the share of each of `out` equal cells that each of `size` pixels covers."""
    edges = np.arange(out + 1) * size / out
    low, high = edges[:-1, None], edges[1:, None]
    pixel = np.arange(size)
    return np.clip(np.minimum(high, pixel + 1) - np.maximum(low, pixel), 0, None) / (size / out)


def area_resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Every output pixel is the mean of the area that it covers, rounded to 8 bits."""
    mean = _coverage(image.shape[-2], rows) @ image.astype(float) @ _coverage(image.shape[-1], columns).T
    return np.rint(mean).astype(np.uint8)


def _cosines(n: int) -> np.ndarray:
    basis = np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(n)[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def low_frequencies(luma: np.ndarray, size: int = 32, low: int = 8) -> np.ndarray:
    """The low x low block of the orthonormal DCT of the image at size x size, row by row, without its mean."""
    basis = _cosines(size)[:low]
    block = basis @ area_resized(luma, size, size).astype(np.float32) @ basis.T
    return block.reshape(*block.shape[:-2], low * low)[..., 1:]


def _spectrum(image: np.ndarray) -> np.ndarray:
    """Magnitudes with the zero frequency in the middle."""
    return np.fft.fftshift(np.abs(np.fft.fft2(image.astype(float), axes=(-2, -1))), axes=(-2, -1))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(np.shape(whole)), where=whole > 0)


def blur(luma: np.ndarray, ratio: float = 0.1) -> np.ndarray:
    """Share of the spectrum's magnitude outside a disc around the zero frequency. Higher is sharper."""
    found = _spectrum(luma)
    rows, columns = luma.shape[-2:]
    y, x = np.ogrid[:rows, :columns]
    outside = (y - rows // 2) ** 2 + (x - columns // 2) ** 2 > int(min(rows, columns) * ratio) ** 2
    return _share((found * outside).sum(axis=(-2, -1)), found.sum(axis=(-2, -1)))


def _mirrored(image: np.ndarray) -> np.ndarray:
    """One more pixel on each side, mirrored without repeating the edge; a single row or column repeats."""
    edge = [(0, 0)] * (image.ndim - 2)
    out = np.pad(image.astype(float), [*edge, (1, 1), (0, 0)], mode="reflect" if image.shape[-2] > 1 else "edge")
    return np.pad(out, [*edge, (0, 0), (1, 1)], mode="reflect" if image.shape[-1] > 1 else "edge")


def ghost(luma: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian. Higher is sharper."""
    m = _mirrored(luma)
    around = m[..., :-2, 1:-1] + m[..., 2:, 1:-1] + m[..., 1:-1, :-2] + m[..., 1:-1, 2:]
    return (around - 4 * m[..., 1:-1, 1:-1]).var(axis=(-2, -1))


def low_band(patch: np.ndarray) -> np.ndarray:
    """Share of a patch's magnitudes in the square of a quarter of its shorter side around the zero frequency."""
    if not patch.shape[-2] * patch.shape[-1]:
        return np.zeros(patch.shape[:-2])
    found = _spectrum(patch)
    y, x = patch.shape[-2] // 2, patch.shape[-1] // 2
    r = min(y, x) // 2
    return _share(found[..., y - r : y + r, x - r : x + r].sum(axis=(-2, -1)), found.sum(axis=(-2, -1)))


def artifact(luma: np.ndarray) -> np.ndarray:
    """low_band of the strip at the left edge, a tenth of the image wide and high. Higher is worse."""
    rows, columns = luma.shape[-2:]
    half, middle = max(1, int(rows * 0.05)), rows // 2
    return low_band(luma[..., max(0, middle - half) : min(rows, middle + half), : max(1, int(columns * 0.1))])


def lab(bgr: np.ndarray) -> np.ndarray:
    """8-bit CIE Lab of (..., rows, columns, 3): L over 0..255, a and b around 128."""
    rgb = bgr[..., ::-1] / 255.0
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _edges(channel: np.ndarray) -> np.ndarray:
    """|Sobel x| + |Sobel y|."""
    m = _mirrored(channel)
    smooth_y = m[..., :-2, :] + 2 * m[..., 1:-1, :] + m[..., 2:, :]
    smooth_x = m[..., :, :-2] + 2 * m[..., :, 1:-1] + m[..., :, 2:]
    return np.abs(smooth_y[..., 2:] - smooth_y[..., :-2]) + np.abs(smooth_x[..., 2:, :] - smooth_x[..., :-2, :])


def fringe(light: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels with a colour edge but no light edge, over the number of pixel values (three a pixel)."""
    chroma, plain = np.hypot(_edges(a), _edges(b)), _edges(light)
    normal = lambda g: g / (g.max(axis=(-2, -1), keepdims=True) + 1e-8)
    found = (normal(chroma) > 0.1) & (normal(plain) < 0.3)
    return found.sum(axis=(-2, -1)) / (3 * found.shape[-2] * found.shape[-1])


def unpacked(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) in BGR from the bytes of Spark's image source; gray is spread, alpha is dropped."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[..., :3]


def scores(bgr: np.ndarray) -> dict[str, float]:
    luma, tones = gray(bgr), lab(bgr)
    return {"blur": float(blur(luma)), "ghost": float(ghost(luma)), "artifact": float(artifact(luma)), "fringe": float(fringe(*(tones[..., k] for k in range(3))))}


def quality_udf():
    """struct(blur, ghost, artifact, fringe) from data, height, width and channels. Not deterministic for the
    optimizer, which would else compute it once more for every filter on a field."""

    @F.pandas_udf("blur double, ghost double, artifact double, fringe double")
    def udf(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        nothing = dict.fromkeys(("blur", "ghost", "artifact", "fringe"))
        rows = [scores(unpacked(d, h, w, c)) if d is not None and h > 0 and w > 0 else nothing for d, h, w, c in zip(data, height, width, channels)]
        return pd.DataFrame(rows, columns=list(nothing), dtype="float64")

    return udf.asNondeterministic()


def frequency_udf():
    """The 63 low frequencies of an image, of which sign_hash makes its hash."""

    @F.pandas_udf("array<double>")
    def udf(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([low_frequencies(gray(unpacked(d, h, w, c))).astype(float) if d is not None and h > 0 and w > 0 else None for d, h, w, c in zip(data, height, width, channels)])

    return udf.asNondeterministic()


def motion_kernel(size: int, angle: float) -> np.ndarray:
    """size x size weights of a line through the middle at an angle in degrees, summing to 1."""
    middle = (size - 1) / 2
    dx, dy = middle * np.cos(np.deg2rad(angle)), middle * np.sin(np.deg2rad(angle))
    ends = np.rint([[middle - dx, middle - dy], [middle + dx, middle + dy]])
    steps = int(np.abs(ends[1] - ends[0]).max())
    points = np.rint(ends[0] + (ends[1] - ends[0]) * np.linspace(0, 1, steps + 1)[:, None]).astype(int)
    out = np.zeros((size, size))
    out[points[:, 1], points[:, 0]] = 1
    return out / out.sum()


def motion_blurred(image: np.ndarray, size: int, angle: float) -> np.ndarray:
    """(rows, columns, channels) correlated with the kernel, edges mirrored, rounded to 8 bits."""
    kernel, low = motion_kernel(size, angle), size // 2
    edge = ((low, size - 1 - low), (low, size - 1 - low), (0, 0))
    padded = np.pad(image.astype(float), edge, mode="reflect" if min(image.shape[:2]) > size else "edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size), axis=(0, 1))
    return np.clip(np.rint((windows * kernel).sum(axis=(-2, -1))), 0, 255).astype(np.uint8)


def tensor(bgr: np.ndarray) -> np.ndarray:
    """float32 (3, rows, columns) in RGB within 0..1."""
    return np.ascontiguousarray(bgr[..., ::-1].transpose(2, 0, 1), dtype=np.float32) / np.float32(255)
