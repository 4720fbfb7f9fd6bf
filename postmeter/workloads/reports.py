"""Job queries over rendered mail and hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.operators import bodies as b
from postmeter.operators import headers as h
from postmeter.plans import jobs
from postmeter.plans.workspace import new_folder
from postmeter.sources import corpus
from postmeter.sources.tables import table, texts
from postmeter.workloads import metrics as mq
from postmeter.workloads.bodies import document_parts, page_parts
from postmeter.workloads.headers import BOT, ROLE, SENT, USER
from postmeter.workloads.registry import query


@query("j3_mail_ingest", """
SELECT 'lang/' || lang AS folder, count(*) AS messages, count(*) * 3 AS parts, 1 AS depth, count(*) * 11 AS headers, count(*) AS stored FROM documents GROUP BY 1
UNION ALL SELECT 'page/' || (page_id % 3), count(*), count(*) * 6, 2, count(*) * 16, count(*) FROM pages GROUP BY 1""")
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages ingested into tables; the counts are joined with what was stored."""
    out = new_folder(spark, "archive")
    messages = corpus.document_messages(spark, sf).unionByName(corpus.page_messages(spark, sf))
    counts = jobs.ingest(spark, messages, out)
    stored = spark.read.parquet(out + "/messages").groupBy("folder").agg(F.count(F.lit(1)).alias("stored"))
    return counts.join(stored, "folder")


@query("j4_sender_volume", f"""
SELECT split_part(a, '@', 2) AS sender_domain, week(sent_at) AS iso_week, count(*) AS messages, CAST(sum(1 + CASE WHEN turn % 3 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS recipients,
  count(CASE WHEN imp IN ('high', 'highest') THEN 1 END) AS important
FROM (SELECT *, {ROLE.format(u=USER, a=BOT)} AS a, make_timestamp({SENT} * 1000000) AS sent_at,
  CASE WHEN (conv_id + turn) % 4 = 1 THEN CASE (conv_id + turn) % 7 WHEN 1 THEN 'highest' WHEN 2 THEN 'high' ELSE 'x' END
    WHEN (conv_id + turn) % 4 = 3 THEN 'normal' ELSE CASE conv_id % 3 WHEN 1 THEN 'highest' ELSE 'x' END END AS imp FROM conversations) GROUP BY 1, 2""")
def sender_volume(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sender_volume(jobs.header_facts(corpus.conversation_messages(spark, sf)))


@query("j4_hop_delays", """
SELECT host, count(*) AS hops, CAST(sum(delay) AS BIGINT) AS delay_sum, max(delay) AS delay_max FROM (
  SELECT 'mx.corpus.example' AS host, 60 + turn AS delay FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT 'relay.example', NULL FROM conversations WHERE turn % 2 = 0) GROUP BY host""")
def hop_delays(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.hop_delays(h.received_hops(corpus.conversation_messages(spark, sf)))


LOW = "length(regexp_replace(text, '[^\\x00-\\x7E]', '', 'g'))"
SHARE = "floor(100 * (length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) - len(regexp_extract_all(text, '=\\?')) - CASE WHEN text LIKE '%=' THEN 1 ELSE 0 END) / strlen(text))"


@query("j5_text_report", f"""
SELECT lang, source, count(*) AS documents, count(CASE WHEN e = '7bit' THEN 1 END) AS seven_bit, count(CASE WHEN e = 'qp' THEN 1 END) AS qp, count(CASE WHEN e = 'base64' THEN 1 END) AS base64,
  quantile_cont(share, 0.5) AS median_share, CAST(min(share) AS BIGINT) AS min_share, 0 AS invalid, CAST(sum(ceil(n / 3.0) * 4 - n) AS BIGINT) AS base64_growth
FROM (SELECT lang, source, strlen(text) AS n, {SHARE} AS share, CASE WHEN {LOW} = strlen(text) THEN
    CASE WHEN regexp_matches(text, '[^\\n]{{79}}') OR contains(text, chr(10) || '.') THEN 'qp' ELSE '7bit' END
    WHEN strlen(text) - {LOW} <= strlen(text) // 5 THEN 'qp' ELSE 'base64' END AS e FROM documents) GROUP BY lang, source""")
def text_report(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.text_report(texts(spark, sf, "documents"), "text")


@query("j6_attachment_report", """
SELECT 'text' AS type, 'plain' AS subtype, 'txt' AS suffix, count(*) AS attachments, CAST(sum(n + 2 * ((n - 1) // 76)) AS BIGINT) AS encoded, CAST(sum(strlen(text)) AS BIGINT) AS decoded
FROM (SELECT text, CAST(ceil(strlen(text) / 3.0) * 4 AS BIGINT) AS n FROM documents)""")
def attachment_report(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.attachment_report(document_parts(spark, sf))


@query("j6_embedded_coverage", "SELECT subtype, count(*) AS objects, count(CASE WHEN subtype = 'png' THEN 1 END) AS shown FROM pages, (VALUES ('png'), ('gif')) t(subtype) GROUP BY 1")
def embedded_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with a content id, and how many of them an html part shows."""
    return b.object_coverage(page_parts(spark, sf)).groupBy("subtype").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if("shown").alias("shown")
    )


@query("j7_host_inventory", f"WITH {mq.HOSTS} SELECT distribution, count(*) AS nodes, CAST(sum(cpu_count) AS BIGINT) AS cpus FROM hosts GROUP BY 1")
def host_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.host_inventory(mq.hosts(spark, sf))


@query("j7_uid_collisions", """
SELECT to_base64(unhex(sha1(from_hex(printf('%02X%02X', (3306 + k % 3) % 256, (3306 + k % 3) // 256) || printf('%012X', k % 20))))) AS server_uid, count(*) AS nodes, min('h' || k) AS first_node
FROM (SELECT s_suppkey AS k FROM supplier) GROUP BY k % 3, k % 20 HAVING count(*) > 1""")
def uid_collisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("h"), k).alias("node"), (k % 3 + 3306).cast("int").alias("port"), F.lpad(F.hex(k % 20), 12, "0").alias("mac")
    )
    return jobs.uid_collisions(rows)
