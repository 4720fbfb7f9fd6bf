"""Jobs that put the operators together: traffic, endpoints, ingest, header facts, text, attachments, hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import dates, mail, text, urls
from postmeter.operators import bodies, metrics, weblog
from postmeter.operators.headers import with_headers
from postmeter.plans.workspace import remove_folder, shuffles_removed, slices
from postmeter.sources import nodes


def clean_requests(log: DataFrame, col: str, rules: str | None, types: dict[str, str] | None = None) -> DataFrame:
    """Log lines to requests with day, path, MIME type, reason and access."""
    parsed = weblog.parse_access_log(log, col)
    path = urls.normalise_path(urls.percent_decode(F.regexp_extract("uri", r"^([^?]*)", 1)))
    rows = parsed.withColumns(
        {
            "day": F.to_date("ts"),
            "path": path,
            "query": F.when(F.col("uri").contains("?"), F.regexp_extract("uri", r"^[^?]*\?(.*)$", 1)),
            "reason": urls.reason(F.col("status")),
        }
    )
    return weblog.ip_access(weblog.mime_type(rows, "path", types), "ip", rules)


def log_outcome(log: DataFrame, col: str) -> DataFrame:
    """How many lines were parsed and how many were not, by reason, in one pass; all lines are counted."""
    reason = F.coalesce(weblog.access_log_reject(F.col(col)), F.lit("parsed"))
    return log.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("lines"))


def endpoint_outcome(lists: DataFrame, col: str) -> DataFrame:
    """The same for the addresses of node and sink lists."""
    each = lists.select(F.explode(F.split(F.col(col), ",")).alias("url"))
    reason = F.coalesce(nodes.endpoint_reject(F.col("url")), F.lit("parsed"))
    return each.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("addresses"))


def traffic_report(requests: DataFrame) -> DataFrame:
    return requests.groupBy("day", "path", "mime_type", "reason", "access").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("bytes").alias("bytes"),
        F.countDistinct("ip").alias("addresses"),
    )


def busiest_paths(requests: DataFrame, k: int) -> DataFrame:
    return weblog.top_paths(requests.groupBy("day", "path").agg(F.count(F.lit(1)).alias("requests")), k)


def parameter_use(requests: DataFrame) -> DataFrame:
    """How often each parameter is given, and with how many different values."""
    pairs = requests.select(F.explode(urls.query_params(F.col("query"))).alias("name", "value"))
    return pairs.groupBy("name").agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct("value").alias("values")
    )


def url_catalogue(df: DataFrame, col: str) -> DataFrame:
    """Per scheme, host and port: addresses, different paths, and rejects by reason."""
    return weblog.split_url(df, col).groupBy("scheme", "host", "port", "error").agg(
        F.count(F.lit(1)).alias("urls"), F.countDistinct("path").alias("paths")
    )


def endpoint_catalogue(lists: DataFrame, col: str) -> DataFrame:
    """Per scheme, host and port of node and sink lists: endpoints and different nodes."""
    return nodes.parse_endpoints(lists, col).groupBy("scheme", "host", "port").agg(
        F.count(F.lit(1)).alias("endpoints"), F.countDistinct("path").alias("paths")
    )


def reply_texts(pages: DataFrame, col: str) -> DataFrame:
    return metrics.reply_text(pages, col).groupBy("reply").agg(F.count(F.lit(1)).alias("replies"))


def reject_reason(raw: Column) -> Column:
    """Why a message cannot be ingested, or null."""
    head = F.get(mail.split_message(text.octets(raw)), F.lit(0))
    return (
        F.when(raw.isNull() | (F.octet_length(raw) == 0), "empty")
        .when(F.size(mail.header_fields(head)) == 0, "no header fields")
    )


#: Tasks write their own files of up to so many folders, unless they read files of fewer bytes than this on average.
FOLDERS, FILE_BYTES = 64, 1 << 20
#: Staged parts are copied in so many slices at most, each of so many bytes at least.
SLICES, SLICE_BYTES = 8, 32 << 20


def ingest(spark: SparkSession, messages: DataFrame, path: str) -> DataFrame:
    """Write ``messages``, ``headers``, ``parts``, ``rejects`` and ``counts`` by folder; returns the counts per folder.

    The raw table is written first, so each message is rendered or fetched once; its parts are
    parsed once into a staging table, from which all other tables are written, and which goes in
    the end. Every table is overwritten, so a job that is run again leaves the same rows.

    Texts are on disk twice, in ``messages`` and ``parts``, besides an eighth of them: staged parts are
    copied slice by slice, and a slice goes as soon as it is copied. Texts are not shuffled: a folder may
    hold a third of all mail, and its files are those of the tasks that have messages of it. Only where
    folders are many or tasks read many small files, which would leave many small ones, messages are
    rebalanced by folder at run time, which splits a busy one by its size. Parts are read and written as
    messages lie.
    """
    raw = messages.select(
        F.array_join("folder", "/").alias("folder"), "msg_key", "raw", reject_reason(F.col("raw")).alias("reason")
    )
    with shuffles_removed(spark):
        _written(raw if _few_files(raw) else _by_folder(raw), f"{path}/messages")
        stored = spark.read.schema(raw.schema).parquet(f"{path}/messages")
        stored.filter("reason is not null").groupBy("folder", "reason").agg(
            F.count(F.lit(1)).alias("messages")
        ).write.mode("overwrite").parquet(f"{path}/rejects")
        opened = bodies.explode_parts(stored.filter("reason is null").drop("reason"))
        opened.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/_staging")
        parts = spark.read.schema(opened.schema).parquet(f"{path}/_staging")
        fields = parts.select("folder", "msg_key", "part_path", F.inline("headers"))
        _written(_by_folder(fields), f"{path}/headers")
        counts = ingest_counts(parts)
        counts.write.mode("overwrite").parquet(f"{path}/counts")
        remove_folder(spark, f"{path}/parts")
        for files in slices(spark, f"{path}/_staging", SLICES, SLICE_BYTES):
            _written(spark.read.schema(opened.schema).parquet(*files).drop("headers"), f"{path}/parts", "append")
            for file in files:
                remove_folder(spark, file)
    remove_folder(spark, f"{path}/_staging")
    return spark.read.schema(counts.schema).parquet(f"{path}/counts")


def _few_files(rows: DataFrame) -> bool:
    """Whether tasks may each write files of their own: folders are few, and so are the files that are read for their size."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < len(rows._jdf.inputFiles()) * FILE_BYTES:
        return False
    return rows.select("folder").distinct().limit(FOLDERS + 1).count() <= FOLDERS


def _by_folder(df: DataFrame) -> DataFrame:
    return df.hint("rebalance", "folder")


def _written(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").partitionBy("folder").parquet(path)


def ingest_counts(parts: DataFrame) -> DataFrame:
    """Messages, header fields, parts and decoded leaf sizes per folder."""
    return parts.groupBy("folder").agg(
        F.count_if(F.col("depth") == 0).alias("messages"),
        F.sum(F.size("headers")).alias("headers"),
        F.count(F.lit(1)).alias("parts"),
        F.max("depth").alias("depth"),
    )


def header_facts(messages: DataFrame) -> DataFrame:
    """One narrow row per message with what the header reports need.

    Values come out of the header first, then the sender, then its domain: each step names the
    columns of the one before, so no rule is spelled out more than once in the plan.
    """
    keep = [c for c in messages.columns if c != "raw"]
    names = {"from": "__from", "date": "__date", "to": "__to", "cc": "__cc", "x-priority": "__priority", "importance": "__importance"}
    values = with_headers(messages).select(*keep, *[mail.header_first("headers", n).alias(c) for n, c in names.items()])
    read = values.withColumns(
        {
            "__sender": mail.mailbox(F.col("__from"))["address"],
            "__sent": dates.mail_date(F.col("__date")),
            "__to": mail.address_list(F.col("__to")),
            "__cc": mail.address_list(F.col("__cc")),
        }
    )
    rows = read.select(
        *keep,
        mail.address_parts(F.col("__sender"))["domain"].alias("sender_domain"),
        F.col("__sent.ts").alias("ts"),
        F.size(F.coalesce("__to", F.array())).alias("to_count"),
        F.size(F.coalesce("__cc", F.array())).alias("cc_count"),
        mail.importance(F.col("__priority"), F.col("__importance")).alias("importance"),
    )
    return rows.withColumn("iso_week", dates.week(F.col("ts")))


def sender_volume(facts: DataFrame) -> DataFrame:
    return facts.groupBy("sender_domain", "iso_week").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.col("to_count") + F.col("cc_count")).alias("recipients"),
        F.count_if(F.col("importance").isin("high", "highest")).alias("important"),
    )


def hop_delays(hops: DataFrame) -> DataFrame:
    """Hops per receiving host, with the delay behind the hop before."""
    return hops.groupBy(F.col("by").alias("host")).agg(
        F.count(F.lit(1)).alias("hops"),
        F.sum("delay").alias("delay_sum"),
        F.max("delay").alias("delay_max"),
    )


def text_report(docs: DataFrame, col: str) -> DataFrame:
    """Per language and source: encoding choices, ASCII share, and growth under base64.

    The share is a whole percent, so the exact median works on at most 101 values a group.
    """
    c = F.col(col)
    rows = docs.select(
        "lang", "source",
        text.choose_encoding(c).alias("encoding"),
        F.when(F.octet_length(c) == 0, 100).otherwise(F.floor(text.counted_ascii(c) * 100 / F.octet_length(c))).alias("share"),
        F.octet_length(c).alias("bytes"),
        text.utf8_valid(c).alias("valid"),
    )
    encoded = F.ceil(F.col("bytes") / 3) * 4
    return rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(F.col("encoding") == e).alias(n) for e, n in (("7bit", "seven_bit"), ("quoted-printable", "qp"), ("base64", "base64"))],
        F.percentile("share", F.lit(0.5)).alias("median_share"),
        F.min("share").alias("min_share"),
        F.count_if(~F.col("valid")).alias("invalid"),
        (F.sum(encoded) - F.sum("bytes")).alias("base64_growth"),
    )


def attachment_report(parts: DataFrame) -> DataFrame:
    """Attachments per type and file suffix, with encoded and decoded sizes."""
    listed = bodies.attachment_inventory(bodies.decode_parts(parts))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return listed.groupBy("type", "subtype", suffix.alias("suffix")).agg(
        F.count(F.lit(1)).alias("attachments"),
        F.sum("size").alias("encoded"),
        F.sum(F.octet_length("content")).alias("decoded"),
    )


def host_inventory(hosts: DataFrame) -> DataFrame:
    """Nodes per distribution with their processors; hosts need ``node, cpu_count, distribution``."""
    return hosts.groupBy("distribution").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("cpu_count").alias("cpus")
    )


def uid_collisions(hosts: DataFrame) -> DataFrame:
    """Server ids that more than one node carries; hosts need ``node, port, mac``."""
    return (
        metrics.server_uid(hosts)
        .groupBy("server_uid")
        .agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first_node"))
        .filter("nodes > 1")
    )

