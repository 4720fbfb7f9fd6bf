"""Queries over mail stores: mail of the given tables is written as message files, then read as a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import mail
from postmeter.operators.headers import with_headers
from postmeter.plans.workspace import new_folder
from postmeter.sources import maildir
from postmeter.sources.tables import table
from postmeter.streaming import jobs
from postmeter.workloads.registry import query

# Up to this many levels of folders.
LEVELS = 12
_NAMES = ["Été & co", "box", "a-b"]


def folder_of(depth: Column) -> Column:
    names = F.transform(
        F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), i % 3 + 1), i.cast("string"))
    )
    return F.slice(names, F.lit(1), depth)


def store_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A message for each turn of a conversation, in a folder of 0 to 12 levels; ``wave`` says when it arrives."""
    t = table(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    depth = (conv % (LEVELS + 1)).cast("int")
    number = conv + turn
    return t.select(
        folder_of(depth).alias("folder"),
        F.concat(F.lit("c"), conv, F.lit(".t"), turn).alias("uid"),
        (F.when(number % 2 == 0, 1).otherwise(0) + F.when(number % 5 == 0, 16).otherwise(0)).alias("flags"),
        F.concat(
            F.lit("From: user"), conv, F.lit("@corpus.example\r\nSubject: conversation "), conv, F.lit("\r\n\r\n"), F.col("text")
        ).alias("raw"),
        # Folders of five levels and more appear with the second wave.
        F.when(depth < 5, number % 3).otherwise(1 + number % 2).alias("wave"),
    )


MESSAGES = f"""messages AS (
  SELECT array_to_string(list_transform(range(1, CAST(conv_id % {LEVELS + 1} AS BIGINT) + 1), lambda i: ['Été & co', 'box', 'a-b'][i % 3 + 1] || i), '/') AS folder,
    'c' || conv_id || '.t' || turn AS uid, conv_id, conv_id + turn AS number,
    strlen('From: user' || conv_id || '@corpus.example' || 'Subject: conversation ' || conv_id || text) + 6 AS size,
    CASE WHEN conv_id % {LEVELS + 1} < 5 THEN (conv_id + turn) % 3 ELSE 1 + (conv_id + turn) % 2 END AS wave
  FROM conversations)"""


@query("s3_scan_store", f"""
WITH {MESSAGES}
SELECT folder, count(*) AS messages, count(CASE WHEN number % 2 = 0 THEN 1 END) AS seen, count(CASE WHEN number % 5 = 0 THEN 1 END) AS flagged,
  sum(size) AS bytes, count(DISTINCT conv_id) AS subjects, count(*) AS whole
FROM messages GROUP BY folder""")
def scan_store(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, flags, sizes and different subjects per folder, from the files of a store with nested folders."""
    root = new_folder(spark, "store")
    maildir.write_maildir(store_messages(spark, sf), root, "nested")
    scanned = maildir.scan_maildir(spark, root, "nested")
    found = with_headers(scanned.withColumn("whole", F.octet_length("raw") == F.col("size")))
    bit = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
    return found.groupBy(F.array_join("folder", "/").alias("folder")).agg(
        F.count(F.lit(1)).alias("messages"),
        bit(1).alias("seen"),
        bit(16).alias("flagged"),
        F.sum("size").alias("bytes"),
        F.countDistinct(mail.header_first("headers", "subject")).alias("subjects"),
        F.count_if("whole").alias("whole"),
    )


@query("t4_mailbox_stream", f"""
WITH {MESSAGES}
SELECT wave AS batch, folder, 'added' AS event, count(*) AS messages, sum(size) AS bytes, min(uid) AS first FROM messages GROUP BY wave, folder""")
def mailbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Three micro-batches over a store that grows in between, new folder levels included."""
    out = new_folder(spark, "mailbox")
    root, ticks = f"{out}/store", f"{out}/ticks"
    mails = store_messages(spark, sf)
    for wave in range(3):
        maildir.write_maildir(mails.filter(F.col("wave") == wave), root, "nested")
        spark.range(1).coalesce(1).write.mode("append").parquet(ticks)
        source = spark.readStream.schema("id long").parquet(ticks)
        jobs.mailbox_stream(source, root, out, f"{out}/checkpoint", "nested").awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    return events.groupBy(F.col("batch").cast("bigint").alias("batch"), F.array_join("folder", "/").alias("folder"), "event").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes"), F.min("uid").alias("first")
    )
