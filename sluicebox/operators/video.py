"""Planning of frame extraction: probe texts, routes, start frames, and what has to be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.text import GPU_CODECS, HEVC_CODECS, codec, duration, fps, frame_count, frame_name
from sluicebox.storage import running_total

#: Numbers that a video reserves beyond its estimated frames, and those of a video whose length isn't known. File
#: names have eleven digits.
RESERVE, UNKNOWN = 100, 10_000_000


def video_info(probes: DataFrame, text: str = "stderr") -> DataFrame:
    """probes with codec, fps, duration and frames; null where the text doesn't tell."""
    out = probes.withColumns({"codec": codec(F.col(text)), "fps": fps(F.col(text)), "duration": duration(F.col(text))})
    return out.withColumn("frames", frame_count(F.col("fps"), F.col("duration")))


def routed(videos: DataFrame, gpu: bool = True) -> DataFrame:
    """videos with route (gpu or cpu) and decoder (null on the CPU). A codec that isn't known goes to the CPU."""
    able = F.coalesce(F.col("codec").isin(*GPU_CODECS), F.lit(False)) & F.lit(gpu)
    decoder = F.when(able & F.col("codec").isin(*HEVC_CODECS), "hevc_cuvid").when(able, "h264_cuvid")
    return videos.withColumn("route", F.when(able, "gpu").otherwise("cpu")).withColumn("decoder", decoder)


def start_frames(videos: DataFrame, frames: Column, on_cpu: Column, *order: Column, reserve: int = RESERVE, unknown: int = UNKNOWN, first: int = 1) -> DataFrame:
    """videos with reserved, how many numbers a video may use, and start_frame, the first of them. No two videos share
    a number: lengths are estimates, so each video has a reserve beyond its own, and one whose length isn't known has
    `unknown` numbers. Videos on the GPU come first, then those on the CPU, then those of unknown length."""
    out = videos.withColumn("reserved", F.coalesce(frames.cast("long") + reserve, F.lit(unknown).cast("long")))
    return running_total(out, F.col("reserved"), frames.isNull(), on_cpu, *order, name="start_frame").withColumn("start_frame", F.col("start_frame") + first)


def extraction_plan(probes: DataFrame, gpu: bool = True, path: str = "path", text: str = "stderr") -> DataFrame:
    """From probe texts to route, decoder, reserved numbers, first number and first file of every video."""
    out = routed(video_info(probes, text), gpu)
    out = start_frames(out, F.col("frames"), F.col("route") == "cpu", F.col(path))
    return out.withColumn("first_file", frame_name(F.col("start_frame")))


def failed(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned videos without a success; they go to the CPU route."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def frames_in_range(files: DataFrame, name: Column, start: int, end: int | None = None) -> DataFrame:
    """Files whose stems are numbers from start on, and before end if it is given."""
    number = F.regexp_extract(name, r"^(\d+)\.[^.]*$", 1).try_cast("long")
    return files.filter((number >= start) & (number < end if end is not None else F.lit(True)))


def extraction_report(files: DataFrame, name: Column) -> DataFrame:
    """One row: how many files, and the first and the last by name."""
    return files.agg(F.count(name).alias("files"), F.min(name).alias("first_file"), F.max(name).alias("last_file"))
