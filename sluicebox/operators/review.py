"""Replay of human keep and delete decisions, and detection of steady readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def decisions(actions: DataFrame, session: str, action: Column, *order: Column) -> DataFrame:
    """(session, k, decision): presses L and R count in consecutive pairs; LL keeps, RR deletes, and a mixed pair
    cancels. k counts decisions from 1; a trailing press decides nothing. Sessions with many presses are windows
    of one session each, which is what a person can press."""
    w = W.partitionBy(session).orderBy(*order)
    pressed = actions.select(session, action.alias("_a"), (F.row_number().over(w) - 1).alias("_n")).filter("_a is not null")
    pairs = pressed.groupBy(session, F.floor(F.col("_n") / 2).alias("_pair")).agg(F.min("_a").alias("_a"), F.max("_a").alias("_b"), F.count("*").alias("_c"))
    made = pairs.filter("_c = 2 and _a = _b")
    return made.select(session, F.row_number().over(W.partitionBy(session).orderBy("_pair")).cast("long").alias("k"), F.when(F.col("_a") == "L", "KEEP").otherwise("DELETE").alias("decision"))


def reviewed(images: DataFrame, made: DataFrame, session: str) -> DataFrame:
    """images (session, idx from 0) with the decision of each, null for those not reached. Presses beyond the last
    image are ignored."""
    right = made.select(F.col(session).alias("_s"), (F.col("k") - 1).alias("_idx"), "decision")
    return images.join(right, images[session].eqNullSafe(F.col("_s")) & (images["idx"] == F.col("_idx")), "left").drop("_s", "_idx")


def retained(images: DataFrame, made: DataFrame, session: str) -> DataFrame:
    """The kept images of finished sessions; a session that stops before its last image keeps nothing."""
    done = reviewed(images, made, session)
    finished = done.groupBy(F.col(session).alias("_s")).agg(F.bool_and(F.col("decision").isNotNull()).alias("_all")).filter("_all").select("_s")
    return done.filter("decision = 'KEEP'").join(finished, F.col(session).eqNullSafe(F.col("_s")), "left_semi").drop("decision")


def review_totals(images: DataFrame, made: DataFrame, session: str) -> DataFrame:
    """(session, total, retained, deleted): deleted is what isn't retained."""
    out = reviewed(images, made, session).groupBy(session).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("decision") == "KEEP", F.lit(False))).alias("retained"))
    return out.withColumn("deleted", F.col("total") - F.col("retained"))


def steady_stop(readings: DataFrame, key: str, value: Column, *order: Column, threshold: float = 0.5, run: int = 3, most: int = 30) -> DataFrame:
    """(key, waited, steady): after a first reading, how many more it takes until `run` in a row change by less
    than threshold; at most `most`."""
    w = W.partitionBy(key).orderBy(*order)
    moved = readings.select(key, F.abs(value - F.lag(value).over(w)).alias("_d"), (F.row_number().over(w) - 1).alias("_n")).filter(F.col("_n") <= most)
    last = W.partitionBy(key).orderBy("_n").rowsBetween(-(run - 1), 0)
    small = F.coalesce(F.col("_d") < threshold, F.lit(False)).cast("int")
    seen = moved.withColumn("_steady", (F.sum(small).over(last) == run) & (F.col("_n") >= run))
    out = seen.groupBy(key).agg(F.min(F.when(F.col("_steady"), F.col("_n"))).alias("_at"), F.max("_n").alias("_end"))
    return out.select(key, F.coalesce("_at", "_end").cast("long").alias("waited"), F.col("_at").isNotNull().alias("steady"))
