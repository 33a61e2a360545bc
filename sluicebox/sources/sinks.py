"""Manifests, and the side effects that follow from them."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "src string, dst string, ok boolean, error string"


def write_manifest(rows: DataFrame, path: str, *partition: str) -> None:
    """The kept rows as Parquet, which is what later steps read; copies of files are a convenience."""
    rows.write.mode("overwrite").partitionBy(*partition).parquet(path)


def copy_files(rows: DataFrame) -> DataFrame:
    """(src, dst, ok, error) after copying src to dst with its times. One file's failure fails nothing else, and a
    copy that is done again gives the same file, so lost executors do no harm. Paths are on a file system that all
    executors mount."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for src, dst in zip(part.src, part.dst):
                try:
                    os.makedirs(os.path.dirname(dst) or ".", exist_ok=True)
                    shutil.copy2(src, dst)
                    out.append((src, dst, True, None))
                except (OSError, TypeError) as error:
                    out.append((src, dst, False, str(error)[:200]))
            yield pd.DataFrame(out, columns=["src", "dst", "ok", "error"])

    return rows.select("src", "dst").mapInPandas(run, STATUS)


def copy_counts(status: DataFrame) -> DataFrame:
    """One row: copied and failed."""
    return status.agg(F.count_if("ok").alias("copied"), F.count_if(~F.col("ok")).alias("failed"))


def require_copied(status: DataFrame) -> None:
    """An error that names one failure, if there is any."""
    bad = status.filter("not ok").select("src", "error").first()
    if bad:
        raise OSError(f"{bad.src}: {bad.error}")


def _ffmpeg(path: str, folder: str, start: int, decoder: str | None) -> list[str]:
    device = ["-hwaccel", "cuda", "-c:v", decoder] if decoder else ["-threads", "1"]
    return ["ffmpeg", "-hide_banner", *device, "-i", path, "-start_number", str(start), f"{folder}/%011d.jpg"]


#: Most tasks that a plan is dealt to.
MOST_TASKS = 10_000


def _extracted(command: list[str], own: str, folder: str, start: int, reserved: int, timeout: int) -> int:
    """Run one extraction into a folder of its own, then move its frames. A video that has outgrown its numbers is an
    error and moves nothing, so no video ever writes over another's frames."""
    shutil.rmtree(own, ignore_errors=True)
    os.makedirs(own)
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout)
        if done.returncode:
            raise OSError(done.stderr.decode(errors="replace"))
        made = sorted((int(n[:-4]), n) for n in os.listdir(own) if n.endswith(".jpg") and n[:-4].isdigit())
        if made and not (start <= made[0][0] and made[-1][0] < start + reserved):
            raise OSError(f"frames {made[0][0]} to {made[-1][0]} are not within the {reserved} numbers from {start}")
        for _, name in made:
            os.replace(f"{own}/{name}", f"{folder}/{name}")
        return len(made)
    finally:
        shutil.rmtree(own, ignore_errors=True)


def extract_frames(plan: DataFrame, folder: str, command: Callable[[str, str, int, str | None], list[str]] = _ffmpeg, timeout: int = 86_400) -> DataFrame:
    """(path, frames, ok, error) after running the planned extractions (path, decoder, start_frame, reserved). Videos
    are dealt out singly, since each is a long job. One that fails or outgrows its numbers is an error row, and one
    that is done again gives the same files, so lost executors do no harm."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                own, start = f"{folder}/.parts/{int(row.start_frame)}", int(row.start_frame)
                try:
                    made = _extracted(command(row.path, own, start, row.decoder), own, folder, start, int(row.reserved), timeout)
                    out.append((row.path, made, True, None))
                except (OSError, subprocess.TimeoutExpired) as error:
                    out.append((row.path, 0, False, str(error)[:200]))
            yield pd.DataFrame(out, columns=["path", "frames", "ok", "error"])

    rows = plan.select("path", "decoder", "start_frame", "reserved")
    return rows.repartition(max(1, min(MOST_TASKS, rows.count()))).mapInPandas(run, "path string, frames long, ok boolean, error string")
