"""Labelled benchmarks: a sample of each category, and how its entries came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(rows: DataFrame, category: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows of each category: those whose key has the least hash (ties by key), so that every run takes the same. Spark
    drops what cannot be among them before it moves rows."""
    order = Window.partitionBy(category).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).drop("_place")


def crosstab(rows: DataFrame, category: str, status: str) -> DataFrame:
    """Counts of each category and status, of each category, of each status and of all: category, status, n, share (of the category, or of all where
    there is none) and level (0: both, 1: category, 2: status, 3: all; null columns are totals)."""
    sets = rows.groupingSets([[category, status], [category], [status], []], category, status).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    whole = sets.where("level in (1, 3)").select(F.col(category).alias("_category"), F.col("level").alias("_level"), F.col("n").alias("_n"))
    own = (F.col("_level") == F.when(F.col("level") < 2, 1).otherwise(3)) & F.when(F.col("level") < 2, F.col(category).eqNullSafe(F.col("_category"))).otherwise(True)
    both = sets.join(F.broadcast(whole), own)  # a row for each category
    return both.select(category, status, "n", (F.col("n") / F.col("_n")).alias("share"), F.col("level").cast("long").alias("level"))
