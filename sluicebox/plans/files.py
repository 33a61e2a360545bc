"""Queries that write files, list, copy and extract them, and one that runs as a stream."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import text
from sluicebox.functions.numeric import sign_hash
from sluicebox.operators import video
from sluicebox.plans import vectors
from sluicebox.session import table
from sluicebox.sources import media, sinks
from sluicebox.storage import park, shared_dir, spread
from sluicebox.streaming.sequence import stream_fifo_dedup

#: Vectors in a sequence of the stream.
RUN = 100


def _folder(spark: SparkSession) -> str:
    """A new folder on the file system that driver and executors share."""
    return f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/sluicebox/{spark.sparkContext.applicationId}/files/{uuid.uuid4().hex}"


def _written(paths: DataFrame) -> None:
    """One byte at every path, as a hole: it takes no block of the disk."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part.path:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w") as out:
                    out.truncate(1)
            yield part

    paths.select("path").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def _part_name(k: Column) -> Column:
    endings = F.array(*[F.lit(e) for e in (".jpg", ".PNG", ".tiff", ".mp4", ".Mov", ".txt", ".webm", ".bmp")])
    return F.concat(F.lit("clip "), k.cast("string"), F.get(endings, (k % 8).cast("int")))


def file_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the three listings find among files of many kinds, a third of them in a folder below."""
    folder, k = _folder(spark), F.col("p_partkey")
    below = F.when(k % 3 == 0, "/below/").otherwise("/")
    _written(spread(table(spark, sf_dir, "part").select(F.concat(F.lit(folder), below, _part_name(k)).alias("path"))))
    found = [(media.image_catalog(spark, folder, 64), "image"), (media.video_catalog(spark, folder), "video"), (media.training_catalog(spark, folder), "training")]
    order = lambda df: F.col("idx") if "idx" in df.columns else F.lit(-1).cast("long")
    rows = [df.select(F.lit(kind).alias("kind"), "name", "ext", order(df).alias("idx")) for df, kind in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of files, of which every fifth is missing."""
    folder, k = _folder(spark), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit(f"{folder}/in/"), k.cast("string")).alias("src"), F.concat(F.lit(f"{folder}/out/"), (k % 4).cast("string"), F.lit("/"), k.cast("string")).alias("dst"))
    _written(rows.filter(k % 5 != 0).select(F.col("src").alias("path")))
    status = park(sinks.copy_files(rows), "status")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/out").select(media.plain_path(F.col("path")).alias("_path"), "length")
    out = status.join(there, F.col("dst") == F.col("_path"), "left")
    return out.select(F.substring_index("src", "/", -1).alias("name"), "ok", F.col("error").isNull().alias("no_error"), F.coalesce("length", F.lit(0)).alias("bytes"))


def copy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, k = _folder(spark), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit(f"{folder}/in/"), k.cast("string")).alias("src"), F.concat(F.lit(f"{folder}/out/"), k.cast("string")).alias("dst"))
    _written(rows.filter(k % 5 != 0).select(F.col("src").alias("path")))
    return sinks.copy_counts(sinks.copy_files(rows))


def _made(path: str, folder: str, start: int, decoder: str | None) -> list[str]:
    """Stands for a decoder: as many frames as the path says, or a failure."""
    count = path.rsplit("/", 1)[1]
    if count == "broken":
        return ["sh", "-c", "echo no video >&2; exit 1"]
    return ["sh", "-c", f'i={start}; while [ $i -lt {start + int(count)} ]; do printf x > "$(printf "%s/%011d.jpg" "{folder}" $i)"; i=$((i + 1)); done']


def extracted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions that fit their numbers, some that fail, and some that have far more frames than was estimated; with
    each, how many of its frames are there as files."""
    folder, k = _folder(spark), F.col("s_suppkey")
    made = F.when(k % 10 == 4, 260).otherwise(k % 7)
    path = F.concat(k.cast("string"), F.lit("/"), F.when(k % 10 == 6, "broken").otherwise(made.cast("string")))
    rows = table(spark, sf_dir, "supplier").select(k, path.alias("path"), F.lit(None).cast("string").alias("decoder"), (k % 7).alias("n"))
    plan = park(video.start_frames(rows, F.when(k % 10 != 8, F.col("n")), F.lit(True), k, unknown=1000), "plan")
    done = park(sinks.extract_frames(plan, folder, _made), "done").withColumnRenamed("path", "_done")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long").alias("number"))
    named = plan.join(done, F.col("path") == F.col("_done"))
    own = F.when(F.col("frames") > 0, F.sequence(F.col("start_frame"), F.col("start_frame") + F.col("frames") - 1))
    named = named.withColumn("claimed", F.explode_outer(own)).join(files, F.col("claimed") == F.col("number"), "left")
    return named.groupBy("s_suppkey", "frames", "ok", F.col("error").isNull().alias("no_error")).agg(F.count("number").alias("files"))


def streamed_fifo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication of the vectors' hashes as a stream that reads the table, with state by sequence."""
    schema = table(spark, sf_dir, "embeddings").schema
    # A pattern, since a stream can't read a path that is one file.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/embedding[s].parquet").filter(F.size("embedding") == vectors.SIDE**2)
    hashes = rows.select(F.floor(F.col("vec_id") / RUN).cast("long").alias("run"), "vec_id", sign_hash(F.slice("embedding", 2, 63)).alias("phash"))
    kept = stream_fifo_dedup(hashes, "run", "vec_id", "phash", vectors.THRESHOLD, vectors.QUEUE)
    folder = _folder(spark)
    kept.writeStream.format("parquet").option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/kept").select("run", "vec_id", "phash")


QUERIES = {q.__name__: q for q in (file_catalogs, copied_files, copy_totals, extracted_frames, streamed_fifo_dedup)}

_FILES = """f AS (SELECT p_partkey AS k, 'clip ' || p_partkey || ['.jpg', '.PNG', '.tiff', '.mp4', '.Mov', '.txt', '.webm', '.bmp'][p_partkey % 8 + 1] AS name FROM part),
    x AS (SELECT *, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM f)"""

ORACLE_SQL = {
    "file_catalogs": f"""WITH {_FILES} SELECT 'image' AS kind, name, ext, row_number() OVER (ORDER BY k) - 1 AS idx FROM x WHERE k % 3 <> 0 AND ext IN ('.jpg', '.png', '.tiff', '.bmp')
        UNION ALL SELECT 'video', name, ext, -1 FROM x WHERE ext IN ('.mp4', '.mov', '.webm')
        UNION ALL SELECT 'training', name, ext, -1 FROM x WHERE ext IN ('.jpg', '.png')""",
    "copied_files": "SELECT s_suppkey::VARCHAR AS name, s_suppkey % 5 <> 0 AS ok, s_suppkey % 5 <> 0 AS no_error, (s_suppkey % 5 <> 0)::BIGINT AS bytes FROM supplier",
    "copy_totals": "SELECT count(*) FILTER (s_suppkey % 5 <> 0) AS copied, count(*) FILTER (s_suppkey % 5 = 0) AS failed FROM supplier",
    "extracted_frames": """WITH v AS (SELECT *, s_suppkey % 10 <> 6 AND (s_suppkey % 10 <> 4 OR s_suppkey % 7 + 100 >= 260) AS ok FROM supplier)
        SELECT s_suppkey, CASE WHEN ok THEN s_suppkey % 7 ELSE 0 END AS frames, CASE WHEN ok THEN s_suppkey % 7 ELSE 0 END AS files, ok, ok AS no_error FROM v""",
    "streamed_fifo_dedup": f"WITH RECURSIVE {vectors._HASH}, {vectors._fifo(True)} SELECT h.vec_id // {RUN} AS run, vec_id, phash FROM h JOIN r USING (rn) WHERE kept",
}
