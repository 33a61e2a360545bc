"""Hashes, schedules, seeded draws and other arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_hash(values: Column) -> Column:
    """63 values as bits, most significant first: 1 where a value is above their median. Null unless there are
    63 of them."""
    middle = F.get(F.sort_array(values), F.lit(31))
    packed = F.aggregate(F.transform(values, lambda x: F.when(x > middle, 1).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return F.when(F.size(values) == 63, packed)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the parts and the seed alone, by MD5, alike in any engine."""
    key = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def draw_key(*parts: Column, seed: int = 0) -> Column:
    """Sorts rows at random, alike in every run."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def lr_factor(epoch: Column, warmup: int = 15, total: int = 300, start: float = 0.01, least: float = 1e-6, base: float = 1e-4) -> Column:
    """Share of the base rate: linear warm-up, then a half cosine down to the least rate."""
    floor = least / base
    cosine = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * (epoch - warmup) / (total - warmup))))
    return F.when(epoch < warmup, start + (1 - start) * epoch / warmup).otherwise(floor + (1 - floor) * cosine)


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def jitter_hsv(h: Column, s: Column, v: Column, dh: Column, ds: Column, dv: Column) -> tuple[Column, Column, Column]:
    """Hue (0..179) turned by dh * 180, saturation and value scaled by 1 + ds and 1 + dv and held within 0..255,
    all cut to whole numbers."""
    held = lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("int")
    return F.floor(F.pmod(h + dh * 180, F.lit(180.0))).cast("int"), held(s * (1 + ds)), held(v * (1 + dv))


def crop_box(width: Column, height: Column, *key: Column, scale: tuple[float, float] = (0.6, 1.0), ratio: tuple[float, float] = (0.75, 1.33), tries: int = 10, seed: int = 0) -> Column:
    """struct(top, left, height, width) of a random resized crop: of up to `tries` draws of area and (log-uniform)
    aspect the first that fits, else the largest centred box within the aspects."""
    u = lambda k, what: uniform(*key, F.lit(what), k, seed=seed)
    low, high = math.log(ratio[0]), math.log(ratio[1])

    def draw(k: Column) -> Column:
        area = width * height * (scale[0] + (scale[1] - scale[0]) * u(k, "area"))
        return F.struct(k.alias("k"), area.alias("area"), F.exp(low + (high - low) * u(k, "aspect")).alias("aspect"))

    def sized(d: Column) -> Column:
        return F.struct(d["k"].alias("k"), F.round(F.sqrt(d["area"] * d["aspect"])).alias("w"), F.round(F.sqrt(d["area"] / d["aspect"])).alias("h"))

    def placed(d: Column) -> Column:
        return F.struct(F.floor(u(d["k"], "top") * (height - d["h"] + 1)).alias("top"), F.floor(u(d["k"], "left") * (width - d["w"] + 1)).alias("left"), d["h"].alias("height"), d["w"].alias("width"))

    draws = F.transform(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), draw), sized)
    fitting = F.filter(draws, lambda d: (d["w"] > 0) & (d["w"] <= width) & (d["h"] > 0) & (d["h"] <= height))
    shape = width / height
    w = F.when(shape > ratio[1], F.round(height * ratio[1])).otherwise(width)
    h = F.when(shape < ratio[0], F.round(width / ratio[0])).otherwise(height)
    whole = F.struct(F.floor((height - h) / 2).alias("top"), F.floor((width - w) / 2).alias("left"), h.alias("height"), w.alias("width"))
    found = F.coalesce(F.get(F.transform(F.slice(fitting, 1, 1), placed), F.lit(0)), whole)
    return found.cast("struct<top:int,left:int,height:int,width:int>")
