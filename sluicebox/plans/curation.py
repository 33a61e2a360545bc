"""From image folders and video folders to manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import pixels
from sluicebox.functions.numeric import sign_hash
from sluicebox.operators import robust, sequence, video
from sluicebox.sources import media
from sluicebox.storage import park

DIRECTIONS = {"blur": True, "ghost": True, "artifact": False, "fringe": False}
_IMAGE = ("data", "height", "width", "channels")


#: Most survivors whose paths are sent to every executor; with more of them all images are scored.
MOST_PATHS = 200_000


def hashed(images: DataFrame, catalog: DataFrame) -> DataFrame:
    """(batch, idx, path, name, bytes, phash) of the catalog's images that are among `images` (path and pixels; null
    data couldn't be decoded). Pixels end in the scan: only narrow rows are written and joined."""
    low = images.filter("data is not null").withColumn("low", pixels.frequency_udf()(*_IMAGE))
    size = (F.col("height") * F.col("width") * F.col("channels")).cast("long")
    narrow = park(low.select(media.plain_path(F.col("path")).alias("_path"), size.alias("bytes"), sign_hash(F.col("low")).alias("phash")), "measured")
    return catalog.join(narrow, media.plain_path(F.col("path")) == F.col("_path")).select("batch", "idx", "path", "name", "bytes", "phash")


def scored(images: DataFrame, catalog: DataFrame) -> DataFrame:
    """(batch, idx, path, name, blur, ghost, artifact, fringe) of the catalog's images. While the catalog is small
    enough to be broadcast, only its images are scored; beyond that all are, and narrow rows meet it afterwards."""
    rows = images.filter("data is not null").withColumn("_path", media.plain_path(F.col("path")))
    wanted = catalog.select(media.plain_path(F.col("path")).alias("_path"))
    if wanted.limit(MOST_PATHS + 1).count() <= MOST_PATHS:
        rows = rows.join(F.broadcast(wanted), "_path", "left_semi")
    narrow = park(rows.withColumn("s", pixels.quality_udf()(*_IMAGE)).select("_path", "s.*"), "measured")
    return catalog.join(narrow, media.plain_path(F.col("path")) == F.col("_path")).select("batch", "idx", "path", "name", *DIRECTIONS)


def _rated(rows: DataFrame, batch: int | None, k: float) -> DataFrame:
    return robust.verdicts(rows, ["batch"], DIRECTIONS, k) if batch else robust.global_verdicts(rows, DIRECTIONS, k)


def curate_images(images: DataFrame, catalog: DataFrame, threshold: int = 14, queue: int = 10, batch: int | None = 100_000, k: float = 3.0) -> DataFrame:
    """The manifest of a catalog (idx, path, name, batch) of images (path, height, width, channels, data): every listed
    image with bytes, phash, scores, verdicts and what became of it (unreadable, duplicate, outlier, kept). Only
    survivors of deduplication are scored, and the four verdicts are taken on the same survivors of a batch. With
    batch=None the catalog is one sequence."""
    hashes = park(hashed(images, catalog), "hashes")
    left = park(sequence.fifo_dedup(hashes, "batch", "idx", "phash", threshold, queue).select("idx"), "survivors")
    survivors = catalog.join(left, "idx", "left_semi")
    rated = _rated(park(scored(images, survivors), "scores"), batch, k)
    names = list(DIRECTIONS)
    rated = rated.select("idx", *names, *[f"keep_{m}" for m in names], robust.all_kept(names).alias("keep"))
    out = catalog.join(hashes.select("idx", "bytes", "phash"), "idx", "left").join(rated, "idx", "left")
    fate = F.when(F.col("phash").isNull(), "unreadable").when(F.col("keep").isNull(), "duplicate").when(F.col("keep"), "kept").otherwise("outlier")
    return out.withColumn("fate", fate).withColumn("keep", F.coalesce("keep", F.lit(False)))


def bad_images(images: DataFrame, catalog: DataFrame, batch: int | None = 100_000, k: float = 3.0) -> DataFrame:
    """The images that any verdict calls bad, over all that can be decoded, with scores and verdicts."""
    return _rated(park(scored(images, catalog), "scores"), batch, k).filter(robust.any_bad(list(DIRECTIONS)))


def curate(spark: SparkSession, folder: str, threshold: int = 14, queue: int = 10, batch: int | None = 100_000, k: float = 3.0) -> DataFrame:
    """curate_images() of an image folder. batch=None makes one sequence of it, for which the usual threshold is 4 and
    the queue 5."""
    catalog = park(media.image_catalog(spark, folder, batch or 1 << 62), "catalog")
    return curate_images(media.images(spark, folder), catalog, threshold, queue, batch, k)


def bad_frames(spark: SparkSession, folder: str, batch: int | None = 100_000, k: float = 3.0) -> DataFrame:
    """bad_images() of an image folder."""
    catalog = park(media.image_catalog(spark, folder, batch or 1 << 62), "catalog")
    return bad_images(media.images(spark, folder), catalog, batch, k)


def report(manifest: DataFrame) -> DataFrame:
    """One row: listed, left after deduplication, kept, bytes of decoded pixels, and the share removed."""
    return robust.funnel(manifest, size=F.col("bytes"), after_dedup=F.col("fate").isin("kept", "outlier"), retained=F.col("keep"))


def plan_videos(spark: SparkSession, folder: str, gpu: bool | None = None, probe=None) -> DataFrame:
    """The extraction plan of a folder of videos."""
    probed = media.probe_videos(media.video_catalog(spark, folder), **({"probe": probe} if probe else {}))
    return video.extraction_plan(park(probed, "probes"), media.gpu_decoders() if gpu is None else gpu)
