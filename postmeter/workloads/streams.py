"""Streaming and sink queries: a stream runs over the given files to its end, the result is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import fixed
from postmeter.plans.workspace import new_folder
from postmeter.sources.nodes import write_contents as write
from postmeter.sources.tables import table, tick_of
from postmeter.streaming import jobs
from postmeter.workloads.metrics import BATCHES, CHANGES, CONTENTS, DUE, METRICS, contents
from postmeter.workloads.registry import query


def metric_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # The source wants a pattern; it matches this one table.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events.parque[t]")
    return raw.select(
        F.concat(F.lit("n"), F.col("user_id")).alias("node"),
        F.upper("event_type").alias("metric"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"),
        F.floor(F.col("value") / 50).cast("string").alias("value"),
    )


@query("t1_change_stream", f"""
WITH {CHANGES}
SELECT node, metric, epoch_us(ts) AS ts_us, id, value FROM changes""")
def change_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "changes")
    q = jobs.change_stream(metric_stream(spark, sf), out, out + "/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/changes").select(
        "node", "metric", F.unix_micros("ts").alias("ts_us"), "id", "value"
    )


# Samples arrive in four waves by time; one in fifty comes a wave late.
WAVES = """span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM metrics),
waves AS (SELECT metrics.*, (epoch_us(ts) - lo) * 3 // (hi - lo + 1) + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END AS wave FROM metrics, span),
judged AS (SELECT *, max(ts) OVER (PARTITION BY node, metric ORDER BY wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM waves),
fresh AS (SELECT *, row_number() OVER w AS n, lag(value) OVER w AS before FROM judged WHERE known IS NULL OR ts > known
  WINDOW w AS (PARTITION BY node, metric ORDER BY ts, id))"""


@query("t1_late_stream", f"""
WITH {METRICS}, {WAVES}
SELECT 'change' AS kind, node, metric, epoch_us(ts) AS ts_us, id, value FROM fresh WHERE n = 1 OR value IS DISTINCT FROM before
UNION ALL SELECT 'late', node, metric, NULL, NULL, CAST(count(*) AS VARCHAR) FROM judged WHERE ts <= known GROUP BY node, metric""")
def late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Four micro-batches: changes against the state of the batches before, and how many samples came too late."""
    out = new_folder(spark, "waves")
    samples = table(spark, sf, "events").select(
        F.concat(F.lit("n"), F.col("user_id")).alias("node"), F.upper("event_type").alias("metric"), "ts",
        F.col("event_id").alias("id"), F.floor(F.col("value") / 50).cast("string").alias("value"),
    )
    low, high = samples.select(F.unix_micros("ts").alias("t")).agg(F.min("t"), F.max("t")).first()
    wave = F.expr(f"(unix_micros(ts) - {low or 0}L) * 3 div {(high or 0) - (low or 0) + 1}L + CASE WHEN id % 50 = 0 THEN 1 ELSE 0 END")
    for n in range(4):
        samples.filter(wave == n).write.mode("append").parquet(f"{out}/source")
        source = spark.readStream.schema(samples.schema).parquet(f"{out}/source")
        jobs.change_stream(source, out, f"{out}/checkpoint").awaitTermination()
    changes = spark.read.parquet(f"{out}/changes").select(
        F.lit("change").alias("kind"), "node", "metric", F.unix_micros("ts").alias("ts_us"), "id", "value"
    )
    none = F.lit(None).cast("bigint")
    late = spark.read.parquet(f"{out}/late").groupBy("node", "metric").agg(F.sum("late").cast("string").alias("value"))
    return changes.unionByName(late.select(F.lit("late").alias("kind"), "node", "metric", none.alias("ts_us"), none.alias("id"), "value"))


@query("t2_cadence_stream", f"""
WITH {METRICS}, kinded AS (
  SELECT *, ['query', 'explain', 'schema', 'replication', 'variable', 'status'][CAST(id % 6 AS INT) + 1] AS kind,
    CAST([12000, 30000, 12000, 500, 3000, 200][CAST(id % 6 AS INT) + 1] AS BIGINT) AS every FROM metrics),
buckets AS (SELECT node, metric, kind, CAST((floor(epoch_us(ts) / (every * 1000000)) + 1) * every AS BIGINT) AS bucket_end,
  max_by(value, (ts, id)) AS value, count(*) AS samples FROM kinded GROUP BY 1, 2, 3, 4)
SELECT * FROM buckets WHERE bucket_end <= (SELECT max(bucket_end) FROM buckets) - 30000 - 600""")
def cadence_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals that are over by the watermark; cadences scaled by 100 as in the batch query."""
    kinds = F.element_at(
        F.array(*map(F.lit, ["query", "explain", "schema", "replication", "variable", "status"])),
        (F.col("id") % 6 + 1).cast("int"),
    )
    slow = {k: v * 100 for k, v in fixed.CADENCE.items()}
    agg = jobs.cadence_stream(metric_stream(spark, sf).withColumn("kind", kinds), slow, 600)
    out = new_folder(spark, "cadence")
    jobs.write_appended(agg, out + "/data", out + "/checkpoint").awaitTermination()
    return spark.read.parquet(out + "/data").select(
        "node", "metric", "kind", F.unix_seconds("bucket_end").alias("bucket_end"), "value", "samples"
    )


@query("t3_delivery_stream", f"""
WITH {DUE.replace(BATCHES, METRICS + ", batches AS (SELECT DISTINCT node, CAST(tick % 60 + 2 AS BIGINT) AS batch FROM metrics)")}, {CONTENTS}
SELECT node, batch, section, d.name AS name, content, sink FROM (
  SELECT *, CASE WHEN section = 'history' THEN '/history_' || node ELSE '/template_' || node || '_' || suffix END AS name FROM due) d
JOIN contents c ON c.name = d.name, (VALUES ('smtp://a.example'), ('smtp://b.example')) s(sink)""")
def delivery_stream(spark: SparkSession, sf: str) -> DataFrame:
    closed = metric_stream(spark, sf).select("node", (tick_of(F.col("ts")) % 60 + 2).alias("batch"))
    out = new_folder(spark, "delivery")
    q = jobs.delivery_stream(
        closed, contents(spark, sf), ["smtp://a.example", "smtp://b.example"], out, out + "/checkpoint"
    )
    q.awaitTermination()
    return spark.read.parquet(f"{out}/log").select("node", "batch", "section", "name", "content", "sink")


@query("s5_write_contents", f"""
WITH {CONTENTS}
SELECT name, content, 'text/html' AS content_type FROM contents""")
def write_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Contents written one file per row, and read back."""
    out = new_folder(spark, "contents")
    write(contents(spark, sf), out)
    return spark.read.schema("name string, content string, content_type string").json(out).select(
        "name", "content", "content_type"
    )
