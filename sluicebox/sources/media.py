"""Image and video files as tables."""

from __future__ import annotations

import errno
import functools
import itertools
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import text
from sluicebox.storage import global_index, own_path, park


#: Entries of folders that a task lists for one that it was given, before it leaves the folders below to other tasks.
WALK = 100_000
#: Rows that are handed on at once.
ROWS = 10_000


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a folder of this name; over a file also if it begins with `_metadata`."""
    out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_metadata", "_common_metadata"))


def _wanted(name: str, extensions: tuple[str, ...]) -> bool:
    return name.lower().endswith(extensions) and not _hidden(name) and (name[0] != "_" or "=" in name)


def _known(entry: os.DirEntry) -> tuple[bool, int]:
    """Whether it is a folder, and its bytes; none if it is gone or a link to nothing."""
    try:
        return (True, 0) if entry.is_dir() else (False, entry.stat().st_size)
    except OSError as error:
        if error.errno in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP):
            return False, 0
        raise


def _walked(root: str, extensions: tuple[str, ...], recursive: bool, most: int, gone: bool) -> Iterator[tuple[str, bool]]:
    """(path, False) of the files of a folder and below, and (path, True) of folders left to others. gone: whether the
    folder may have been deleted since it was found. Names that aren't UTF-8 have no path that Spark can open."""
    waiting, seen = [root], 0
    while waiting:
        here = waiting.pop()
        if seen >= most:
            yield here, True
            continue
        try:
            entries = os.scandir(here)
        except (FileNotFoundError, NotADirectoryError):
            if here != root or gone:
                continue
            raise
        with entries:
            for entry in entries:
                seen += 1
                if not entry.name.isascii() and os.fsencode(entry.name) != entry.name.encode("utf-8", "replace"):
                    continue
                if not (plain := _wanted(entry.name, extensions)) and not recursive:
                    continue
                # Of files of other kinds no more is read than the folder itself tells.
                folder, size = _known(entry) if plain or entry.is_symlink() else (entry.is_dir(), 0)
                if folder and recursive and not _hidden(entry.name):
                    if seen < most:
                        waiting.append(entry.path)
                    else:
                        yield entry.path, True
                elif plain and not folder and size:
                    yield entry.path, False


def _mounted(spark: SparkSession, folders: list[str], extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    """(path) of files below folders of a file system that all executors mount. Executors read the folders and write
    what they find; those that a task leaves are dealt out for the next round."""
    most, cores = WALK, spark.sparkContext.defaultParallelism

    def walk(gone: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (row for part in parts for root in part.path for row in _walked(root, extensions, recursive, most, gone))
            while some := list(itertools.islice(rows, ROWS)):
                yield pd.DataFrame(some, columns=["path", "below"])

        return run

    left, count, rounds = spark.createDataFrame([(f,) for f in folders], "path string"), len(folders), []
    while count:
        rounds.append(park(left.repartition(min(count, 4 * cores)).mapInPandas(walk(bool(rounds)), "path string, below boolean"), "listed"))
        left = rounds[-1].filter("below").select("path")
        count = left.count()
    return functools.reduce(DataFrame.unionByName, rounds).filter("not below").select(F.concat(F.lit("file:"), "path").alias("path"))


def _stored(spark: SparkSession, fs: JavaObject, folders: list[JavaObject], extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    """(path) of files below folders of another store, which only the driver's JVM can list: entry by entry, and
    written out after so many that the driver never holds them all."""

    def files() -> Iterator[tuple[str]]:
        waiting = list(folders)
        while waiting:
            entries = fs.listStatusIterator(waiting.pop())
            while entries.hasNext():
                entry = entries.next()
                path = entry.getPath()
                name = path.getName()
                if entry.isDirectory():
                    if recursive and not _hidden(name):
                        waiting.append(path)
                elif _wanted(name, extensions) and entry.getLen():
                    yield (path.toString(),)

    path, rows = own_path(spark, "listed"), files()
    spark.createDataFrame([], "path string").write.parquet(path)
    while some := list(itertools.islice(rows, 10 * ROWS)):
        spark.createDataFrame(some, "path string").write.mode("append").parquet(path)
    return spark.read.schema("path string").parquet(path)


def _listed(spark: SparkSession, folder: str, extensions: tuple[str, ...], recursive: bool) -> DataFrame:
    """(path, name, ext) of files; contents are not read. The listing is a parked table, as large as it may be: the
    driver holds only what the pattern `folder` itself matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    roots = list(fs.globStatus(fs.makeQualified(path)) or ())
    if not roots:
        raise FileNotFoundError(folder)
    folders = [r.getPath() for r in roots if r.isDirectory()]
    files = [r.getPath() for r in roots if r.isFile() and r.getLen() and _wanted(r.getPath().getName(), extensions)]
    parts = [spark.createDataFrame([(p.toString(),) for p in files], "path string")] if files or not folders else []
    if folders and fs.getUri().getScheme() == "file":
        parts.append(_mounted(spark, [p.toUri().getPath() for p in folders], extensions, recursive))
    elif folders:
        parts.append(_stored(spark, fs, folders, extensions, recursive))
    found = functools.reduce(DataFrame.unionByName, parts)
    name = text.file_name(F.col("path"))
    return found.select("path", name.alias("name"), text.extension(name).alias("ext")).filter(F.col("ext").isin(*extensions))


def image_catalog(spark: SparkSession, folder: str, batch: int = 100_000) -> DataFrame:
    """(idx, path, name, ext, batch) of the images directly in a folder, in natural order. Files that can't be
    decoded are listed and numbered too."""
    rows = global_index(_listed(spark, folder, text.IMAGE_EXTENSIONS, False), text.natural_key(F.col("name")), F.col("name"))
    return rows.select("idx", "path", "name", "ext", F.floor(F.col("idx") / batch).cast("long").alias("batch"))


def video_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, ext) of the videos in a folder and below; sort by path."""
    return _listed(spark, folder, text.VIDEO_EXTENSIONS, True)


def training_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, ext) of the training images in a folder and below, in no order."""
    return _listed(spark, folder, text.TRAINING_EXTENSIONS, True)


def images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, height, width, channels, data) of the images that can be decoded; data is BGR, row by row."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def plain_path(path: Column) -> Column:
    """Without the scheme of a local file, so that paths of different readers compare."""
    return F.regexp_replace(path, "^file:/*", "/")


def tool_versions(*names: str) -> dict[str, str | None]:
    """The first line that each tool says of its version; None if this machine doesn't have it or it fails."""
    out = {}
    for name in names:
        done = subprocess.run([name, "-version"], capture_output=True, timeout=60) if shutil.which(name) else None
        out[name] = done.stdout.decode(errors="replace").partition("\n")[0] if done and not done.returncode else None
    return out


def require_tools(*names: str) -> None:
    """An error that names the tools that this machine lacks."""
    lacking = [n for n, version in tool_versions(*names).items() if version is None]
    if lacking:
        raise RuntimeError(f"not installed or not working: {', '.join(lacking)}")


@functools.cache
def _ready() -> None:
    """require_tools("ffmpeg"), asked once per process and not once per video."""
    require_tools("ffmpeg")


def _probe(path: str) -> str | None:
    _ready()
    done = subprocess.run(["ffmpeg", "-hide_banner", "-i", path], capture_output=True, timeout=60)
    return done.stderr.decode(errors="replace")


def probe_videos(videos: DataFrame, probe: Callable[[str], str | None] = _probe) -> DataFrame:
    """(path, stderr): what a probe says about each video, null if it fails on that video. Without the tool itself
    the query fails, since all videos would look alike. The work is dealt by video."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> str | None:
            try:
                return probe(path)
            except (OSError, ValueError, subprocess.SubprocessError):
                return None

        for part in parts:
            yield pd.DataFrame({"path": part.path, "stderr": part.path.map(one)})

    return videos.select(plain_path(F.col("path")).alias("path")).mapInPandas(run, "path string, stderr string")


def gpu_decoders() -> bool:
    """Whether this machine's ffmpeg lists a decoder that runs on a GPU."""
    require_tools("ffmpeg")
    listed = subprocess.run(["ffmpeg", "-hide_banner", "-decoders"], capture_output=True, timeout=60).stdout
    return b"h264_cuvid" in listed or b"hevc_cuvid" in listed
