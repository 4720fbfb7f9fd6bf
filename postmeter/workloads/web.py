"""Web-log, URL and listing queries; log lines are rendered from ``events`` and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import dates, urls
from postmeter.operators import weblog as w
from postmeter.plans import jobs
from postmeter.sources.corpus import pick
from postmeter.sources.tables import table, texts
from postmeter.workloads.metrics import endpoint_lists
from postmeter.workloads.registry import query

SUFFIXES = [".html", ".PNG", ".js", ".tar.gz", ".odd", ""]
STATUSES = [200, 304, 404, 503]
RULES = "+10.0.0.0/16,-10.0.0.64/26,+10.0.0.70,-10.0.0.5/24"

LOG = f"""log AS (
  SELECT event_id, user_id, '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS ip, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END AS "user",
    date_trunc('second', ts) AS ts, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
    '/' || event_type || '//../' || (event_id % 40) || ['.html', '.PNG', '.js', '.tar.gz', '.odd', ''][CAST(event_id % 6 AS INT) + 1] AS raw_path,
    '/' || event_type || '/' || (event_id % 40) || ['.html', '.PNG', '.js', '.tar.gz', '.odd', ''][CAST(event_id % 6 AS INT) + 1] AS path,
    [200, 304, 404, 503][CAST(event_id % 4 AS INT) + 1] AS status, event_id % 10000 AS bytes,
    ['text/html', 'image/png', 'application/x-javascript', 'application/x-tgz', 'text/plain', 'text/plain'][CAST(event_id % 6 AS INT) + 1] AS mime_type,
    ['OK', 'Not Modified', 'Not Found', 'Server Error'][CAST(event_id % 4 AS INT) + 1] AS reason,
    CASE WHEN user_id >= 250 THEN 1 WHEN user_id % 250 = 70 THEN 1 WHEN user_id % 250 BETWEEN 64 AND 127 THEN 0 ELSE 1 END AS access
  FROM events)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a request per event."""
    e = F.col("event_id")
    u = F.col("user_id")
    path = F.concat(F.lit("/"), "event_type", F.lit("//%2e./"), e % 40, pick(SUFFIXES, e))
    uri = F.concat(path, F.lit("?page="), e % 5, F.lit("&q=a+b%20"), u, F.lit("&flag&page=x"), e % 3)
    return texts(spark, sf, "events").select(
        e.alias("event_id"),
        F.concat(F.lit("10.0."), F.floor(u / 250), F.lit("."), u % 250).alias("ip"),
        F.when(u % 3 == 0, F.concat(F.lit("u"), u)).alias("user"),
        F.date_trunc("second", "ts").alias("ts"),
        F.when(e % 2 == 0, "GET").otherwise("POST").alias("method"),
        uri.alias("uri"),
        F.lit("1.1").alias("version"),
        pick(STATUSES, e).alias("status"),
        (e % 10000).alias("bytes"),
        F.when(e % 5 != 0, "http://r.example/a b").alias("referer"),
        F.when(e % 7 != 0, F.concat(F.lit('agent "q" '), e % 9)).alias("agent"),
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return w.render_access_log(requests(spark, sf))


@query("w1_access_log", f"""
WITH {LOG}
SELECT event_id, ip, "user", CAST(epoch(ts) AS BIGINT) AS at, method, status, bytes, CASE WHEN event_id % 5 <> 0 THEN 'http://r.example/a b' END AS referer,
  CASE WHEN event_id % 7 <> 0 THEN 'agent "q" ' || (event_id % 9) END AS agent FROM log""")
def access_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.parse_access_log(log_lines(spark, sf), "line")
    return rows.select("event_id", "ip", "user", F.unix_seconds("ts").alias("at"), "method", "status", "bytes", "referer", "agent")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.clean_requests(log_lines(spark, sf), "line", RULES, {"tar.gz": "application/x-tgz"})


@query("j1_log_outcome", """
SELECT CASE event_id % 13 WHEN 0 THEN 'empty' WHEN 1 THEN 'missing' WHEN 2 THEN 'no date' WHEN 3 THEN 'no request' WHEN 4 THEN 'other form' ELSE 'parsed' END AS outcome,
  count(*) AS lines FROM events GROUP BY 1""")
def log_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Five in thirteen lines are damaged, each in its own way; all of them are counted."""
    k, line = F.col("event_id") % 13, F.col("line")
    damaged = (
        F.when(k == 0, F.lit(" "))
        .when(k == 2, F.regexp_replace(line, r"\[[^\]]*\] ", ""))
        .when(k == 3, F.replace(line, F.lit(" HTTP/1.1"), F.lit("")))
        .when(k == 4, F.regexp_replace(line, r"( HTTP/1\.1\").*$", "$1"))
        .when(k != 1, line)
    )
    return jobs.log_outcome(log_lines(spark, sf).select(damaged.alias("line")), "line")


@query("j1_traffic_report", f"""
WITH {LOG}
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, path, mime_type, reason, access, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT ip) AS addresses
FROM log GROUP BY ALL""")
def traffic(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.traffic_report(cleaned(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("j1_top_paths", f"""
WITH {LOG}
SELECT * FROM (SELECT day, path, requests, row_number() OVER (PARTITION BY day ORDER BY requests DESC, path) AS place FROM (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, path, count(*) AS requests FROM log GROUP BY ALL)) WHERE place <= 5""")
def top_paths(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.busiest_paths(cleaned(spark, sf), 5).withColumn("day", F.col("day").cast("string"))


@query("j1_parameter_use", """
SELECT name, count(*) AS uses, count(DISTINCT value) AS "values" FROM (
  SELECT 'page' AS name, 'x' || (event_id % 3) AS value FROM events
  UNION ALL SELECT 'q', 'a+b ' || user_id FROM events UNION ALL SELECT 'flag', 'flag' FROM events) GROUP BY name""")
def parameter_use(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.parameter_use(cleaned(spark, sf))


@query("w4_query_var", """
SELECT 'p' || (event_id % 5) AS page, 'a b ' || (user_id % 10) AS q, CASE WHEN event_id % 3 = 0 THEN 'only body' END AS extra, count(*) AS requests FROM events GROUP BY ALL""")
def query_var(spark: SparkSession, sf: str) -> DataFrame:
    """First values, names without case, and a variable that only the body may have."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("xpage=no&PAGE=p"), e % 5, F.lit("&q=a+b%20"), u % 10, F.lit("&page=later")).alias("query"),
        F.when(e % 3 == 0, "extra=only+body").otherwise("other=1").alias("body"),
    )
    for name in ("page", "q", "extra"):
        rows = w.query_var(rows, name, out=name)
    return rows.groupBy("page", "q", "extra").agg(F.count(F.lit(1)).alias("requests"))


@query("w2_w3_percent_round_trip", """
SELECT lang, count(*) AS documents, count(*) AS server_restored, count(*) AS mail_restored,
  sum(2 * (strlen(text) - length(regexp_replace(text, '[^A-Za-z0-9._$,;~()-]', '', 'g'))) + strlen(text)) AS server_bytes,
  sum(2 * (strlen(text) - length(regexp_replace(text, '[^A-Za-z0-9!''()*._-]', '', 'g'))) + strlen(text)) AS mail_bytes
FROM documents GROUP BY lang""")
def percent(spark: SparkSession, sf: str) -> DataFrame:
    """Texts escaped in both styles and decoded again."""
    t = F.col("text")
    rows = texts(spark, sf, "documents").select(
        "lang", t, urls.percent_encode(t, "server").alias("s"), urls.percent_encode(t, "mail").alias("m")
    )
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(urls.percent_decode(F.col("s")) == t).alias("server_restored"),
        F.count_if(urls.percent_decode(F.col("m")) == t).alias("mail_restored"),
        F.sum(F.octet_length("s")).alias("server_bytes"),
        F.sum(F.octet_length("m")).alias("mail_bytes"),
    )


@query("w6_url_catalogue", """
SELECT scheme, host, port, error, count(*) AS urls, count(DISTINCT path) AS paths FROM (
  SELECT split_part(url, '://', 1) AS scheme, split_part(split_part(url, '://', 2), '/', 1) AS host, NULL::INT AS port,
    substr(split_part(split_part(url, '://', 2), '?', 1), length(split_part(split_part(url, '://', 2), '/', 1)) + 1) AS path, NULL::VARCHAR AS error FROM pages
  UNION ALL SELECT 'https', 'h' || (page_id % 3) || '.example', 8000 + page_id % 2, '/a b', NULL FROM pages
  UNION ALL SELECT '', '', NULL, '', 'No protocol separator' FROM pages
  UNION ALL SELECT 'http', 'h', NULL, '/x', 'Port can only contain digits' FROM pages) GROUP BY ALL""")
def url_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses, addresses with user and port, and two kinds that cannot be read."""
    k = F.col("page_id")
    more = F.array(
        F.col("url"),
        F.concat(F.lit("HTTPS://me:p%40w@h"), k % 3, F.lit(".example:"), 8000 + k % 2, F.lit("/a%20b?c=d")),
        F.lit("no-scheme"),
        F.lit("http://h:80x/x"),
    )
    rows = texts(spark, sf, "pages").select(F.explode(more).alias("url"))
    out = jobs.url_catalogue(rows, "url")
    return out


@query("j2_endpoint_outcome", """
SELECT CASE c_custkey % 8 WHEN 6 THEN 'unknown scheme' WHEN 7 THEN 'no host' ELSE 'parsed' END AS outcome, count(*) AS addresses FROM customer GROUP BY 1""")
def endpoint_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.endpoint_outcome(endpoint_lists(spark, sf), "urls")


@query("j2_endpoint_catalogue", """
SELECT scheme, host, port, count(*) AS endpoints, count(DISTINCT path) AS paths FROM (
  SELECT CASE c_custkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'http' ELSE 'smtps' END AS scheme, 'h' || c_nationkey AS host,
    CASE c_custkey % 3 WHEN 0 THEN 3307 WHEN 1 THEN 80 ELSE 587 END AS port, CASE c_custkey % 3 WHEN 0 THEN '/n' || c_custkey ELSE '/' END AS path FROM customer) GROUP BY ALL""")
def endpoint_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    url = (
        F.when(k % 3 == 0, F.concat(F.lit("mysql://h"), n, F.lit(":3307/n"), k))
        .when(k % 3 == 1, F.concat(F.lit("http://h"), n))
        .otherwise(F.concat(F.lit("smtps://h"), n))
    )
    lists = table(spark, sf, "customer").select(F.concat(url, F.lit(",mysql://,bad")).alias("urls"))
    return jobs.endpoint_catalogue(lists, "urls")


@query("j2_reply_texts", """
SELECT reply, count(*) AS replies FROM (SELECT split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS reply FROM pages) GROUP BY 1""")
def reply_texts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.reply_texts(texts(spark, sf, "pages"), "html")


@query("w7_normalise_path", """
SELECT '/' || event_type || '/' || (event_id % 4) || '\\x' AS path, count(*) AS requests FROM events GROUP BY 1""")
def normalise_path(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.concat(F.lit("/..//"), "event_type", F.lit("/....\\/"), e % 4, F.lit("\\..x"))
    rows = table(spark, sf, "events").select(urls.normalise_path(raw).alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("requests"))


@query("w8_mime_type", """
SELECT mime_type, count(*) AS parts FROM (SELECT ['text/html', 'image/jpeg', 'text/x-own', 'text/plain', 'text/plain', 'application/x-gunzip'][CAST(p_partkey % 6 AS INT) + 1] AS mime_type FROM part) GROUP BY 1""")
def mime_type(spark: SparkSession, sf: str) -> DataFrame:
    names = [".HTM", ".jpeg", ".own.js", ".unknown", "/.css", ".a.gz"]
    rows = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 6 == 4, F.lit(".css")).otherwise(F.concat("p_name", pick(names, F.col("p_partkey")))).alias("path")
    )
    return w.mime_type(rows, "path", {"own.js": "text/x-own"}).groupBy("mime_type").agg(F.count(F.lit(1)).alias("parts"))


@query("w9_ip_access", f"""
WITH {LOG}
SELECT ip, access, count(*) AS requests FROM log GROUP BY ALL""")
def ip_access(spark: SparkSession, sf: str) -> DataFrame:
    rows = w.ip_access(requests(spark, sf), "ip", RULES)
    return rows.groupBy("ip", "access").agg(F.count(F.lit(1)).alias("requests"))


@query("w10_glob_match", """
SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 3 WHEN p_name LIKE '%gear' THEN length(p_name) ELSE -1 END AS match_length, 
  length(p_brand) + 1 AS star, length(p_brand) + length(p_type) + 2 AS wide FROM part""")
def glob_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("path", F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type"))
    named = w.glob_match(rows, "p_name", "RED|**gear$")
    both = w.glob_match(w.glob_match(named, "path", "/b?and*", "star"), "path", "/**", "wide")
    return both.select("p_partkey", "match_length", "star", "wide")


@query("w11_http_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) + 3661 END AS epoch FROM orders""")
def http_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate") + F.expr("interval 3661 seconds")
    layouts = ["dd/MMM/yyyy HH:mm:ss", "dd MMM yyyy HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss"]
    k = F.col("o_orderkey") % 5
    text = F.lit("not a date")
    for i, layout in enumerate(layouts):
        text = F.when(k == i, F.date_format(d, layout)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", dates.http_date(text).alias("epoch"))


@query("w13_parse_requests", """
SELECT method, uri, query, host, count(*) AS requests FROM (
  SELECT CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'MKCOL' END AS method, '/' || event_type || '/x y' AS uri, CASE WHEN event_id % 3 = 0 THEN 'a=' || (event_id % 7) END AS query,
    'h' || (user_id % 5) AS host FROM events WHERE event_id % 11 <> 0) GROUP BY ALL""")
def parse_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request texts; one in eleven has a method no server accepts."""
    e = F.col("event_id")
    raw = F.concat(
        F.lit("\r\n "),
        F.when(e % 11 == 0, "BREW").when(e % 2 == 0, "GET").otherwise("MKCOL"),
        F.lit(" /"), "event_type", F.lit("//x%20y"),
        F.when(e % 3 == 0, F.concat(F.lit("?a="), e % 7)).otherwise(""),
        F.lit(" HTTP/1.1\r\nHOST: h"), F.col("user_id") % 5, F.lit("\r\nAccept: */*\r\n\r\nbody"),
    )
    rows = w.parse_requests(table(spark, sf, "events").select(raw.alias("raw")), "raw")
    host = urls.request_header(F.col("headers"), "Host")
    return rows.groupBy("method", "uri", "query", host.alias("host")).agg(F.count(F.lit(1)).alias("requests"))


@query("w16_listing", """
SELECT p_name || p_partkey AS name, p_partkey % 10 = 0 AS is_dir,
  CASE WHEN p_partkey % 10 = 0 THEN '[DIRECTORY]' WHEN s < 1024 THEN CAST(s AS VARCHAR) WHEN s < 1048576 THEN printf('%.1fk', s / 1024.0::DOUBLE)
    WHEN s < 1073741824 THEN printf('%.1fM', s / 1048576.0::DOUBLE) ELSE printf('%.1fG', s / 1073741824.0::DOUBLE) END AS shown_size
FROM (SELECT *, p_partkey * p_partkey * p_size AS s FROM part)""")
def listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        F.concat("p_name", k).alias("name"), (k % 10 == 0).alias("is_dir"), (k * k * F.col("p_size")).alias("size"), k.alias("mtime")
    )
    return w.listing(rows, "size", desc=True).select("name", "is_dir", "shown_size")


@query("w17_unchanged", """
SELECT o_orderkey AS path, '"' || printf('%x', CAST(epoch(o_orderdate) AS BIGINT)) || '.' || CAST(floor(o_totalprice) AS BIGINT) || '"' AS tag,
  o_orderkey % 4 IN (0, 2) AS unchanged FROM orders""")
def unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter has its tag, a quarter another tag, a quarter a date kept, and a quarter is new."""
    k = F.col("o_orderkey") % 4
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("path"), F.unix_seconds("o_orderdate").alias("mtime"), F.floor("o_totalprice").alias("size"), k.alias("k"), "o_orderdate"
    )
    tag = urls.validator_tag(F.col("mtime"), F.col("size"))
    seen = base.filter("k < 3").select(
        "path",
        F.when(F.col("k") == 0, F.upper(tag)).when(F.col("k") == 1, F.lit('"0.0"')).alias("tag"),
        F.when(F.col("k") == 2, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("since"),
    )
    return w.unchanged(base.select("path", "mtime", "size"), seen).select("path", "tag", "unchanged")


@query("w18_reason", """
SELECT status, CASE status WHEN 200 THEN 'OK' WHEN 201 THEN 'Created' WHEN 204 THEN 'No Content' ELSE 'Server Error' END AS reason, count(*) AS requests
FROM (SELECT 200 + event_id % 9 AS status FROM events) GROUP BY ALL""")
def reason(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("event_id") % 9 + 200).alias("status"))
    return w.reason(rows).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("requests"))


@query("w19_rewrite_paths", """
SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN '/one' || substr(path, 9) WHEN p_type = 'SMALL' THEN '/small' ELSE '/root' || path END AS target
FROM (SELECT *, '/' || p_brand || '/' || p_type AS path FROM part)""")
def rewrite_paths(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("path"))
    return w.rewrite_paths(rows, "path", [("/brand#1", "/one"), ("**/small$", "/small")], "/root").select("p_partkey", "target")
