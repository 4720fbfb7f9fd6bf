"""Streaming forms of the metric and mailbox operators.

Each job is idempotent by batch id: a batch writes into a folder of its own, and a
batch that runs again after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmeter.operators import metrics
from postmeter.operators.mailbox import diff_listing
from postmeter.plans.workspace import remove_folder
from postmeter.sources.maildir import listed_messages, store_listing

KEYS = ("node", "metric")
_STATE = "node string, metric string, ts timestamp, id bigint, value string"


#: Parts of the state by a hash of the series: a batch reads and writes only those it touches.
BUCKETS = 64


def _before(spark: SparkSession, folder: str, batch: int, schema: str) -> DataFrame:
    """What the batch before left in ``folder``; nothing for the first batch.

    Every batch leaves its table, so a missing one is an error and stops the stream.
    """
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={batch - 1}")


def _versions(spark: SparkSession, out: str, batch: int) -> dict[int, int]:
    """For each bucket the batch that wrote its state last, as of the end of the batch before."""
    rows = _before(spark, f"{out}/versions", batch, "bucket int, version bigint").collect()
    return {r.bucket: r.version for r in rows}


def _state_folder(out: str, version: int, bucket: int) -> str:
    return f"{out}/state/version={version}/bucket={bucket}"


def change_stream(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    slice_seconds: int = metrics.SLICE_SECONDS,
    trigger: Mapping | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Change-only history of a stream of ``node, metric, ts, id, value``.

    State is the last sample of each series, kept as tables by a hash of the series. A batch is
    evaluated once, into a staging table; it reads the state of the buckets that it has samples
    of and writes these anew, under its own number. A small table says which batch wrote each
    bucket last, so a batch that runs again starts from the same state; states that no batch can
    need any more are removed. Samples that are not newer than the state are dropped and counted
    under ``late``. A batch is handled by the sliced windows of the batch operator, so a series
    that fills a third of a batch is spread over tasks like any other.
    """

    def one_batch(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        staging = f"{out}/staging/batch={batch}"
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")
        batch_df.select("node", "metric", "ts", "id", "value", bucket).write.mode("overwrite").parquet(staging)
        rows = spark.read.schema(_STATE + ", bucket int").parquet(staging)
        # No more than ``buckets`` numbers come to the driver.
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        versions = _versions(spark, out, batch)
        known_at = [_state_folder(out, versions[b], b) for b in touched if b in versions]
        last = spark.read.schema(_STATE).parquet(*known_at) if known_at else spark.createDataFrame([], _STATE)

        known = last.select(
            F.col("node").alias("__n"), F.col("metric").alias("__m"), F.col("ts").alias("__ts")
        )
        joined = rows.join(
            known, F.col("node").eqNullSafe(F.col("__n")) & F.col("metric").eqNullSafe(F.col("__m")), "left"
        )
        late = F.col("__ts").isNotNull() & (F.col("ts") <= F.col("__ts"))
        fresh = joined.filter(~late).drop("__n", "__m", "__ts", "bucket")
        seeded = fresh.withColumn("seed", F.lit(False)).unionByName(last.withColumn("seed", F.lit(True)))
        # The state row comes before every fresh row of its series.
        changed = metrics.changes_only(seeded, KEYS, slice_seconds=slice_seconds).filter("not seed").drop("seed")
        changed.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")
        newest = seeded.groupBy(*KEYS).agg(
            F.max_by(F.struct("ts", "id", "value"), F.struct("ts", "id")).alias("s")
        )
        # Dealt by bucket, or each task would write a file into each folder.
        kept = newest.select(*KEYS, "s.*", bucket).hint("rebalance", "bucket")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/state/version={batch}")
        joined.filter(late).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("late")).write.mode("overwrite").parquet(
            f"{out}/late/batch={batch}"
        )
        now = versions | dict.fromkeys(touched, batch)
        listed = spark.createDataFrame(sorted(now.items()), "bucket int, version bigint")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{out}/versions/batch={batch}")
        remove_folder(spark, staging)
        if batch > 0:
            # The batch before is done, so nothing goes back behind the state it started from.
            older = _versions(spark, out, batch - 1)
            for b, version in older.items():
                if versions.get(b) != version:
                    remove_folder(spark, _state_folder(out, version, b))

    return (
        samples.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


#: Name of the observed metrics of ``cadence_stream``.
REJECTS = "rejects"


def cadence_stream(samples: DataFrame, cadence: Mapping[str, int], delay_seconds: int) -> DataFrame:
    """Last sample per series and sampling interval of its kind, when the interval is over.

    The event time is the end of the interval. It runs ahead of the samples by one
    interval at most, so the longest interval is added to the delay. Samples without a time or
    of a kind that is not in the cadence belong to no interval; each micro-batch reports how many
    it had, by reason, as observed metrics under ``REJECTS``.
    """
    every = F.create_map(*[F.lit(x) for kv in cadence.items() for x in kv])[F.col("kind")].cast("bigint")
    micros = every * 1_000_000
    start = F.floor(F.unix_micros("ts") / micros) * micros
    reason = metrics.resample_reject(cadence)
    counted = samples.withColumn("reject", reason).observe(
        REJECTS, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("reject") == r).alias(r) for r in metrics.RESAMPLE_REJECTS]
    )
    rows = counted.filter("reject is null").drop("reject").withColumn("bucket_end", F.timestamp_micros(start + micros))
    watermark = f"{delay_seconds + max(cadence.values())} seconds"
    return (
        rows.withWatermark("bucket_end", watermark)
        .groupBy("node", "metric", "kind", "bucket_end")
        .agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.count(F.lit(1)).alias("samples"))
    )


def write_appended(df: DataFrame, out: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_LOG = "node string, section string, name string, content string, content_type string, sink string, micro int, batch bigint"


def logged(spark: SparkSession, out: str) -> DataFrame:
    """The delivery log; ``micro`` and ``batch`` are folders, so filters on them leave the others unread."""
    return spark.read.schema(_LOG).parquet(f"{out}/log")


def delivery_stream(
    closed: DataFrame,
    contents: DataFrame,
    sinks: Sequence[str],
    out: str,
    checkpoint: str,
    sections: Sequence[tuple[str, str, int, bool]] | None = None,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Delivery log of a stream of closed ``node, batch`` rows.

    A delivery that an earlier batch has logged is not made again; the log folder of
    the batch itself is left out of that look, so a repeated batch gives the same rows.
    The log is kept by batch number, and only the numbers at hand are looked up in it.
    """

    def one_batch(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        due = metrics.due_sections(batch_df.select("node", "batch").distinct(), sections)
        plan = metrics.delivery_plan(due, sinks, contents).select(
            "node", "batch", "section", "name", "content", "content_type", "sink"
        )
        if batch > 0:
            low, high = batch_df.agg(F.min("batch"), F.max("batch")).first()
            log = logged(spark, out).filter((F.col("micro") < batch) & F.col("batch").between(low, high))
            keys = ["node", "batch", "section", "sink"]
            plan = plan.join(log.select(*keys), keys, "left_anti")
        plan.write.mode("overwrite").partitionBy("batch").parquet(f"{out}/log/micro={batch}")

    return (
        closed.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_LISTING = "folder array<string>, uid string, flags int, size bigint, state string, ts timestamp, path string"


def mailbox_stream(
    ticks: DataFrame,
    root: str,
    out: str,
    checkpoint: str,
    layout: str = "dots",
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Events of a mail store, at any depth of folders: added, removed and changed flags.

    Every micro-batch of ``ticks``, whatever its rows, lists the store anew, folder levels that
    have appeared since included, and compares the listing with that of the batch before. The
    listing is kept as a table of its batch, so that a repeated batch starts from the same one;
    older ones are removed. Events of a batch lie in ``events/batch=<number>`` and have the path
    of the message, from which ``listed_messages`` reads the bytes of those that were added.
    """

    def one_batch(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        store_listing(spark, root, layout).write.mode("overwrite").parquet(f"{out}/listing/batch={batch}")
        now = _before(spark, f"{out}/listing", batch + 1, _LISTING)
        before = _before(spark, f"{out}/listing", batch, _LISTING)
        keys = ["folder", "uid"]
        facts = now.select(*keys, "size", "ts", "path")
        events = diff_listing(before, now, keys).join(facts, keys, "left")
        events.write.mode("overwrite").parquet(f"{out}/events/batch={batch}")
        remove_folder(spark, f"{out}/listing/batch={batch - 2}")

    return (
        ticks.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def added_messages(spark: SparkSession, events: DataFrame, root: str) -> DataFrame:
    """``folder, uid, flags, size, ts, raw`` of the added events, for the mail operators."""
    added = events.filter("event = 'added'").withColumnRenamed("new_flags", "flags")
    return listed_messages(spark, added.select("folder", "uid", "flags", "size", "ts", "path"), root).drop("path")
