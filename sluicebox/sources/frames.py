"""Video frames as a data source: spark.read.format("frames").load(folder)."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sluicebox.functions.text import VIDEO_EXTENSIONS

SCHEMA = "path string, frame long, height int, width int, data binary, error string"
_FIELDS = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
#: Bytes of pixels that a batch of rows is closed at, so that a task holds a few frames whatever a video's length.
BATCH = 16 << 20


class _Videos(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _header(stream: BinaryIO) -> tuple[int, int] | None:
    """Width and height of the next portable pixmap; None at the end of the stream."""
    words: list[bytes] = []
    while len(words) < 4:
        word = b""
        while (c := stream.read(1)) and not c.isspace():
            word += c
        if word:
            words.append(word)
        elif not c:
            break
    if not words:
        return None
    if len(words) < 4 or words[0] != b"P6" or words[3] != b"255":
        raise ValueError("the decoder's output is not a pixmap of three bytes a pixel")
    return int(words[1]), int(words[2])


def _decoded(command: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """Height, width and BGR bytes of every frame that a command writes as pixmaps; one frame in memory at a time."""
    with tempfile.TemporaryFile() as said, subprocess.Popen(command, stdout=subprocess.PIPE, stderr=said, stdin=subprocess.DEVNULL) as run:
        try:
            while size := _header(run.stdout):
                width, height = size
                pixels = run.stdout.read(3 * width * height)
                if len(pixels) < 3 * width * height:
                    raise ValueError("the last frame is cut off")
                yield height, width, np.frombuffer(pixels, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()
        except BaseException:
            run.kill()
            raise
        if run.wait():
            said.seek(0)
            raise OSError(said.read().decode(errors="replace")[:200] or f"exit status {run.returncode}")


class _Frames(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.tool = options.get("tool", "ffmpeg")
        self.every = int(options.get("every", "1"))
        self.tasks = int(options.get("tasks", "10000"))

    def partitions(self) -> list[_Videos]:
        """One video a task, as long as there are no more than `tasks` of them."""
        found = sorted(os.path.join(at, name) for at, _, names in os.walk(self.folder) for name in names if os.path.splitext(name)[1].lower() in VIDEO_EXTENSIONS)
        return [_Videos(found[i :: self.tasks]) for i in range(max(1, min(self.tasks, len(found))))]

    def read(self, partition: _Videos) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            held, size = [], 0
            try:
                for frame, (height, width, data) in enumerate(_decoded([self.tool, "-v", "error", "-i", path, "-f", "image2pipe", "-c:v", "ppm", "-"])):
                    if frame % self.every:
                        continue
                    held.append((path, frame, height, width, data, None))
                    size += len(data)
                    if size >= BATCH:
                        yield _batch(held)
                        held, size = [], 0
            except (FileNotFoundError, PermissionError):
                raise
            except (OSError, ValueError) as error:
                held.append((path, None, None, None, None, str(error)))
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


class FrameSource(DataSource):
    """(path, frame, height, width, data, error) of the videos in a folder and below, data as BGR row by row, frames
    from 0 on. A video that fails has its frames up to there and a last row with the error and no frame; without the
    decoder itself the query fails.

    Options: `every` reads each n-th frame only, `tool` is the decoder, called as ffmpeg is, and `tasks` the most tasks.
    The folder has to be one that all executors mount at the same place.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Frames(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FrameSource)
