"""Session and table access shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sluicebox") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as Parquet; Spark's reader resolves the path, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
