"""Preparation of training samples, and logs of training, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sluicebox.functions.numeric import draw_key
from sluicebox.storage import global_index, running_totals


def _keys(image: Column, patches: int, epoch: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.struct(draw_key(image, p, F.lit(epoch), seed=seed).alias("key"), p.alias("patch")))


def masked_patches(image: Column, patches: int, ratio: float = 0.6, *, epoch: int = 0, seed: int = 0) -> Column:
    """The int(patches * ratio) patches of an image that are masked, drawn within the row: no rows meet."""
    return F.transform(F.slice(F.sort_array(_keys(image, patches, epoch, seed)), 1, int(patches * ratio)), lambda x: x["patch"])


def patch_mask(image: Column, patches: int, ratio: float = 0.6, *, epoch: int = 0, seed: int = 0) -> Column:
    """The same draw as one flag per patch."""
    chosen = masked_patches(image, patches, ratio, epoch=epoch, seed=seed)
    at = F.map_from_arrays(chosen, F.transform(chosen, lambda _: F.lit(True)))
    return F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.map_contains_key(at, p))


def mask_relation(images: DataFrame, image: str, patches: int = 576, ratio: float = 0.6, *, epoch: int = 0, seed: int = 0) -> DataFrame:
    """(image, patch) of every masked patch."""
    return images.select(image, F.explode(masked_patches(F.col(image), patches, ratio, epoch=epoch, seed=seed)).alias("patch"))


def _under(flags: Column, i: Column, width: int, patch_size: int) -> Column:
    """Whether pixel i of an image, counted row by row, lies in a masked patch."""
    y, x = F.floor(i / width), i % width
    return F.get(flags, (F.floor(y / patch_size) * (width // patch_size) + F.floor(x / patch_size)).cast("int"))


def masked_pixels(pixels: Column, flags: Column, width: int, patch_size: int) -> Column:
    """An image's pixels, row by row, with those of masked patches set to 0."""
    return F.transform(pixels, lambda p, i: F.when(_under(flags, i, width, patch_size), 0.0).otherwise(p.cast("double")))


def masked_l1(made: Column, original: Column, flags: Column, width: int, patch_size: int) -> tuple[Column, Column]:
    """Sum of |made - original| over masked pixels, and how many those are, as columns of one image. The loss of a
    batch is the one summed over the other; without masked pixels it is null."""
    apart = F.zip_with(made, original, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    chosen = F.filter(apart, lambda d, i: _under(flags, i, width, patch_size))
    return F.aggregate(chosen, F.lit(0.0), lambda s, d: s + d), F.size(chosen)


def minibatches(rows: DataFrame, id_col: str, size: int = 64, *, epoch: int = 0, seed: int = 0, drop_last: bool = True) -> DataFrame:
    """rows with batch and its place in it, in an order drawn for the epoch; an incomplete last batch is dropped."""
    out = global_index(rows, draw_key(F.col(id_col), F.lit(epoch), seed=seed), F.col(id_col), name="place")
    if drop_last:
        out = out.filter(F.col("place") < rows.count() // size * size)
    return out.withColumn("batch", F.floor(F.col("place") / size).cast("long")).withColumn("place", F.col("place") % size)


def epoch_losses(log: DataFrame, epoch: str, batch: Column, loss: Column) -> DataFrame:
    """log with running, the mean loss of its epoch so far; missing losses don't count. An epoch of any length is
    summed over several tasks."""
    known = loss.isNotNull().cast("int")
    rows = running_totals(log.withColumn("_loss", loss), epoch, {"_sum": F.col("_loss"), "_count": known}, batch)
    value = F.coalesce(F.col("_loss"), F.lit(0))
    return rows.withColumn("running", F.try_divide(F.col("_sum") + value, F.col("_count") + F.col("_loss").isNotNull().cast("int"))).drop("_loss", "_sum", "_count")


def best_so_far(log: DataFrame, key: str, loss: Column, *order: Column) -> DataFrame:
    """The rows of each key whose loss is below all losses before it."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("_low", F.min(loss).over(before)).filter(F.col("_low").isNull() | (loss < F.col("_low"))).drop("_low")


def one_at_random(rows: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(draw_key(F.col(id_col), seed=seed), F.col(id_col)).limit(1)


def encoder_parameters(manifest: DataFrame, prefix: str = "encoder.") -> DataFrame:
    """The parameters (name, shape) under a prefix, without it, and how many numbers each has."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda n, d: n * d)
    inside = manifest.filter(F.startswith(F.col("name"), F.lit(prefix)))
    return inside.withColumn("name", F.substring(F.col("name"), F.lit(len(prefix) + 1), F.length("name"))).withColumn("size", size)


def channel_means(pixels: DataFrame, image: str, channel: str, value: str) -> DataFrame:
    return pixels.groupBy(image, channel).agg(F.avg(value).alias("mean"))
