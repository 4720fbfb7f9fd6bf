"""The given tables and the metric tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_SECONDS = 21600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan may have fewer tasks with rows than the cluster has cores.

    Parsing is work per row. A file is read by its row groups, however many splits it is cut into:
    splits that hold the middle of none stay empty, so splits tell nothing about tasks with rows.
    Tables of fewer files than cores are dealt out; others are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table for work that is heavy per row."""
    return spread(table(spark, sf_dir, name))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, metric, ts, id, value``: events as samples, values in bands of 50."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("n"), F.col("user_id")).alias("node"),
        F.upper("event_type").alias("metric"),
        "ts",
        F.col("event_id").alias("id"),
        F.floor(F.col("value") / 50).cast("string").alias("value"),
    )


def tick_of(ts):
    return F.floor(F.unix_micros(ts) / (TICK_SECONDS * 1_000_000))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("node", tick_of(F.col("ts")).alias("tick")).distinct()
