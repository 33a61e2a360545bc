"""Tables parked in the shared folder, and positions in a total order without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset a local session gets one of
    its own; a cluster has to name it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluicebox-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sluicebox/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has parked. DataFrames that operators returned can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that park() made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._parked)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def own_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used, for a table."""
    return f"{_own(spark)}/{uuid.uuid4().hex}/{label}"


def park(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder, read again. It cuts the lineage, survives lost
    executors and gives later joins a scan below their own exchange, which adaptive execution can split."""
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parked = path.rsplit("/", 1)[0]
    return out


def park_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """park(), with one folder for each of the few values of an integer key, so that a filter on it reads one."""
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.partitionBy(key).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parked = path.rsplit("/", 1)[0]
    return out


#: Bytes of input for each core beyond which a table is taken as it comes.
ENOUGH = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, parked over as many files as the cluster has cores if its own files would keep less than half of them
    busy: one row group is one task, however long its rows take. Only inputs of less than ENOUGH bytes a core are
    looked at, so large tables are never moved."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > ENOUGH * cores or 2 * df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return park(df.repartition(cores), "spread")


#: monotonically_increasing_id() holds the partition above these bits and the position in it below.
_BITS = 33


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """df range-partitioned and sorted, parked with _part and _at, a row's partition and position there."""
    df = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    return park(df, "sorted").withColumn("_part", F.shiftright("_mid", _BITS)).withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("_mid")


def _before(sums: DataFrame) -> DataFrame:
    """(_part, _base): sums of `_n` over all earlier partitions. One row per partition, whatever the rows."""
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))


def global_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """df with its 0-based position in a total order. Rows are range-partitioned and counted by partition; only
    the counts, one per partition, meet in one task."""
    rows = _sorted(df, list(order))
    bases = _before(rows.groupBy("_part").agg(F.count("*").alias("_n")))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def running_total(df: DataFrame, value: Column, *order: Column, name: str = "before") -> DataFrame:
    """df with the sum of value over all earlier rows of a total order, summed in the same two steps."""
    rows = _sorted(df.withColumn("_v", F.coalesce(value, F.lit(0))), list(order))
    bases = _before(rows.groupBy("_part").agg(F.sum("_v").alias("_n")))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_at", "_base", "_v")


def running_totals(df: DataFrame, key: str, values: dict[str, Column], *order: Column) -> DataFrame:
    """df with the sum of each value over all earlier rows of the same key. A key may have any share of the rows: it
    runs through as many tasks as the range partitioning gives it, and one row per partition and key is summed
    beyond them."""
    held = {name: f"_v{i}" for i, name in enumerate(values)}
    rows = _sorted(df.withColumns({held[n]: F.coalesce(v, F.lit(0)) for n, v in values.items()}), [F.col(key), *order])
    sums = rows.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(*[F.sum(v).alias(f"_s{v}") for v in held.values()])
    earlier = W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_p", "_k", *[F.coalesce(F.sum(f"_s{v}").over(earlier), F.lit(0)).alias(f"_b{v}") for v in held.values()])
    inside = W.partitionBy("_part", key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in held.items()})
    rows = rows.join(sums, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return rows.withColumns({n: F.col(n) + F.col(f"_b{v}") for n, v in held.items()}).drop("_part", "_at", "_p", "_k", *held.values(), *[f"_b{v}" for v in held.values()])
