"""Names, paths and probe texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of images and videos, in lower case.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")
TRAINING_EXTENSIONS = (".jpg", ".jpeg", ".png")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv", ".webm")
#: Codecs that a GPU decodes, and those of them that its HEVC decoder takes.
GPU_CODECS = ("h264", "h264_vdpau", "hevc", "h265", "hevc_vdpau")
HEVC_CODECS = ("hevc", "h265", "hevc_vdpau")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-cased, with its dot; empty for names that only begin with one."""
    return F.lower(F.regexp_extract(name, r"[^.].*(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    """The name without its extension."""
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def natural_key(name: Column) -> Column:
    """Digit runs of any length compare as numbers and other runs as text; a name that begins with digits comes before
    those that don't. A number is led by how many digits it has without leading zeros."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def number(t: Column) -> Column:
        digits = F.ltrim(t, F.lit("0"))
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    keys = F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), number(t)).otherwise(t))
    return F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), keys)).otherwise(keys)


def frame_name(number: Column) -> Column:
    return F.format_string("%011d.jpg", number)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


#: How ffmpeg writes streams, rates, durations and its progress.
STREAM = r"Stream #.*Video:\s*(\w+)"
RATE = r"(\d+(?:\.\d+)?)\s*fps"
DURATION = r"Duration:\s*(\d+):(\d+):(\d+\.\d+)"
PROGRESS = r"frame=\s*(\d+)"


def codec(probe: Column) -> Column:
    """The video codec that a probe text names; null if none."""
    return F.lower(F.nullif(F.regexp_extract(probe, STREAM, 1), F.lit("")))


def fps(probe: Column) -> Column:
    return _number(probe, RATE)


def duration(probe: Column) -> Column:
    """Seconds."""
    return _number(probe, DURATION, 1) * 3600 + _number(probe, DURATION, 2) * 60 + _number(probe, DURATION, 3)


def frame_count(rate: Column, seconds: Column) -> Column:
    """Whole frames; null if either is missing or 0."""
    return F.when((rate > 0) & (seconds > 0), F.floor(rate * seconds).cast("long"))


def last_progress(log: Column) -> Column:
    """The largest frame number that a progress log reports; null if none."""
    found = F.regexp_extract_all(log, F.lit(PROGRESS), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("long")))


def short_error(text: Column, length: int = 200) -> Column:
    return F.left(text, F.lit(length))


def status_line(position: Column, total: Column, name: Column) -> Column:
    """position counts from 0."""
    return F.format_string("[%d/%d] %s", position + 1, total, name)


def fitted(width: Column, height: Column, most_width: int = 1280, most_height: int = 720) -> tuple[Column, Column]:
    """Sizes scaled down, never up, to fit a window, cut to whole pixels."""
    scale = F.least(F.lit(float(most_width)) / width, F.lit(float(most_height)) / height, F.lit(1.0))
    return F.floor(width * scale).cast("int"), F.floor(height * scale).cast("int")
