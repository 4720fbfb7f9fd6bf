"""Fleet-metric queries (samples come from ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import fixed
from postmeter.operators import metrics as m
from postmeter.sources import nodes as src
from postmeter.sources.tables import TICK_SECONDS, metrics, table, texts, tick_of, ticks
from postmeter.workloads.registry import query

METRICS = """metrics AS (
  SELECT 'n' || user_id AS node, upper(event_type) AS metric, ts, event_id AS id,
         CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS value,
         CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS tick
  FROM events)"""

CHANGES = METRICS + """, changes AS (
  SELECT * FROM (
    SELECT *, lag(value) OVER w AS prev, row_number() OVER w AS rn FROM metrics
    WINDOW w AS (PARTITION BY node, metric ORDER BY ts, id))
  WHERE rn = 1 OR value IS DISTINCT FROM prev)"""

BATCHES = METRICS + """, batches AS (
  SELECT node, tick,
         CAST(floor((row_number() OVER (PARTITION BY node ORDER BY tick) - 1) / 10) + 2 AS BIGINT) AS batch
  FROM (SELECT DISTINCT node, tick FROM metrics))"""


@query("m10_changes_only", f"""
WITH {CHANGES}
SELECT node, metric, epoch_us(ts) AS ts_us, id, value FROM changes""")
def changes(spark: SparkSession, sf: str) -> DataFrame:
    return m.changes_only(metrics(spark, sf)).select(
        "node", "metric", F.unix_micros("ts").alias("ts_us"), "id", "value"
    )


@query("m10_change_ratio", f"""
WITH {CHANGES}
SELECT s.node AS node, s.samples AS samples, c.changes AS changes
FROM (SELECT node, count(*) AS samples FROM metrics GROUP BY node) s
JOIN (SELECT node, count(*) AS changes FROM changes GROUP BY node) c USING (node)""")
def change_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Changes against samples per node: how much the change-only history saves."""
    base = metrics(spark, sf)
    samples = base.groupBy("node").agg(F.count(F.lit(1)).alias("samples"))
    kept = m.changes_only(base).groupBy("node").agg(F.count(F.lit(1)).alias("changes"))
    return samples.join(kept, "node")


@query("s1_read_nodes", """
SELECT 'orders' AS node, o_orderkey AS id, o_totalprice AS amount FROM orders
UNION ALL SELECT 'lines', l_orderkey, l_extendedprice FROM lineitem""")
def read_nodes(spark: SparkSession, sf: str) -> DataFrame:
    both = src.read_nodes(spark, {"orders": f"{sf}/orders.parquet", "lines": f"{sf}/lineitem.parquet"})
    return both.select(
        "node",
        F.coalesce("o_orderkey", "l_orderkey").alias("id"),
        F.coalesce("o_totalprice", "l_extendedprice").alias("amount"),
    )


ENDPOINTS = """urls AS (
  SELECT c_custkey AS k,
    CASE c_custkey % 8
      WHEN 0 THEN 'mysql://10.0.' || (c_custkey // 250) || '.' || (c_custkey % 250) || ':' || (3306 + c_custkey % 5) || '/n' || c_custkey
      WHEN 1 THEN 'mysql://db' || c_nationkey || '.example/n' || c_custkey
      WHEN 2 THEN 'http://h' || c_nationkey || '.example:8080/feedback'
      WHEN 3 THEN 'https://h' || c_nationkey || '.example'
      WHEN 4 THEN 'smtp://mail' || c_nationkey || '.example'
      WHEN 5 THEN 'smtps://mail' || c_nationkey || '.example/'
      WHEN 6 THEN 'ftp://x' || c_nationkey || '/y'
      ELSE 'mysql://:3306/n' || c_custkey END AS url
  FROM customer)"""


def endpoint_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Comma lists of node and sink addresses, one list per nation and key block."""
    k = F.col("c_custkey")
    n = F.col("c_nationkey").cast("string")
    url = (
        F.when(k % 8 == 0, F.concat(F.lit("mysql://10.0."), F.floor(k / 250), F.lit("."), k % 250,
                                    F.lit(":"), 3306 + k % 5, F.lit("/n"), k))
        .when(k % 8 == 1, F.concat(F.lit("mysql://db"), n, F.lit(".example/n"), k))
        .when(k % 8 == 2, F.concat(F.lit("http://h"), n, F.lit(".example:8080/feedback")))
        .when(k % 8 == 3, F.concat(F.lit("https://h"), n, F.lit(".example")))
        .when(k % 8 == 4, F.concat(F.lit("smtp://mail"), n, F.lit(".example")))
        .when(k % 8 == 5, F.concat(F.lit("smtps://mail"), n, F.lit(".example/")))
        .when(k % 8 == 6, F.concat(F.lit("ftp://x"), n, F.lit("/y")))
        .otherwise(F.concat(F.lit("mysql://:3306/n"), k))
    )
    rows = table(spark, sf, "customer").select(F.floor(k / 10).alias("block"), k.alias("k"), url.alias("url"))
    return rows.groupBy("block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), ",").alias("urls")
    )


@query("s2_parse_endpoints", f"""
WITH {ENDPOINTS}, parsed AS (
  SELECT k // 10 AS block, url,
    CASE WHEN k % 8 IN (0, 1) THEN 'mysql' WHEN k % 8 = 2 THEN 'http' WHEN k % 8 = 3 THEN 'https'
         WHEN k % 8 = 4 THEN 'smtp' ELSE 'smtps' END AS scheme,
    split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1) AS host,
    CASE k % 8 WHEN 0 THEN 3306 + k % 5 WHEN 1 THEN 3306 WHEN 2 THEN 8080 WHEN 3 THEN 443 WHEN 4 THEN 25 ELSE 587 END AS port,
    CASE WHEN k % 8 IN (0, 1) THEN '/n' || k WHEN k % 8 = 2 THEN '/feedback' ELSE '/' END AS path
  FROM urls WHERE k % 8 < 6)
SELECT block, url, scheme, host, port, path, replace(path, '/', '') AS node FROM parsed""")
def parse_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return src.parse_endpoints(endpoint_lists(spark, sf), "urls").select(
        "block", "url", "scheme", "host", F.col("port").cast("bigint").alias("port"), "path", "node"
    )


@query("m1_collect_metrics", """
SELECT part, type, count(*) AS rows, count(DISTINCT metric) AS names FROM (
  SELECT 0 AS part, 1 AS type, p_brand AS metric FROM part
  UNION ALL SELECT 1, 2, event_type FROM events
  UNION ALL SELECT 2, 3, p_name || ' version' FROM part
  UNION ALL SELECT 2, 3, p_name || ' used' FROM part
  UNION ALL SELECT 3, 4, s_name FROM supplier)
GROUP BY part, type""")
def collect(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    variables = part.select(F.col("p_brand").alias("metric"), F.col("p_type").alias("value"))
    status = table(spark, sf, "events").select(
        F.col("event_type").alias("metric"), F.col("value").cast("string").alias("value")
    )
    plugins = m.plugin_metrics(
        part.select(F.col("p_name").alias("name"), F.col("p_size").alias("version"), F.col("p_partkey").alias("used"))
    ).select("metric", "value")
    misc = table(spark, sf, "supplier").select(
        F.col("s_name").alias("metric"), F.col("s_acctbal").cast("string").alias("value")
    )
    union = m.collect_metrics((variables, 1), (status, 2), (plugins, 3), (misc, 4))
    return union.groupBy("part", F.col("type").cast("int").alias("type")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("metric").alias("names")
    )


VARIABLES = """variables AS (
  SELECT p_partkey, lower(p_type) || CASE p_partkey % 7
    WHEN 0 THEN '_size' WHEN 1 THEN '_timeout' WHEN 2 THEN '_length_max' WHEN 3 THEN 'Xsize'
    WHEN 4 THEN '' WHEN 5 THEN '_format' ELSE '%size' END AS name FROM part
  UNION ALL
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AUTO_INCREMENT_' WHEN 1 THEN 'autoXincrement'
    WHEN 2 THEN 'innodbXf' WHEN 3 THEN 'version' WHEN 4 THEN 'logXbin' ELSE 'sqlmode' END || p_size FROM part)"""
LIKES = " OR ".join(f"name ILIKE '{p}' ESCAPE '\\'" for p in fixed.variable_patterns("agent"))


@query("m2_like_any", f"WITH {VARIABLES} SELECT p_partkey, name FROM variables WHERE {LIKES}")
def like_any(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    suffix = F.element_at(
        F.array(*map(F.lit, ["_size", "_timeout", "_length_max", "Xsize", "", "_format", "%size"])),
        (k % 7 + 1).cast("int"),
    )
    prefix = F.element_at(
        F.array(*map(F.lit, ["AUTO_INCREMENT_", "autoXincrement", "innodbXf", "version", "logXbin", "sqlmode"])),
        (k % 6 + 1).cast("int"),
    )
    names = part.select("p_partkey", F.concat(F.lower("p_type"), suffix).alias("name")).unionByName(
        part.select("p_partkey", F.concat(prefix, F.col("p_size")).alias("name"))
    )
    return m.like_any(names, "name", fixed.variable_patterns("agent"))


@query("m3_plugin_metrics", """
WITH p AS (
  SELECT p_partkey AS node, p_name AS name, p_partkey * 37 % 65536 AS version, coalesce(c, 0) AS used
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
SELECT node, name || ' version' AS metric, (version // 256) || '.' || (version % 256) AS value FROM p
UNION ALL SELECT node, name || ' used', CAST(used AS VARCHAR) FROM p""")
def plugins(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    rows = table(spark, sf, "part").join(used, F.col("l_partkey") == F.col("p_partkey"), "left")
    wide = rows.select(
        F.col("p_partkey").alias("node"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") * 37 % 65536).cast("int").alias("version"),
        F.coalesce("c", F.lit(0)).alias("used"),
    )
    return m.plugin_metrics(wide).select("node", "metric", "value")


HOSTS = """hosts AS (
  SELECT 'h' || s_suppkey AS node, s_suppkey AS k, s_suppkey % 64 + 1 AS cpu_count,
         CAST(floor(s_acctbal) AS BIGINT) * 1048576 AS mem_total, 1700000000 + s_suppkey AS now,
         CASE WHEN s_suppkey % 5 = 0 THEN NULL
              WHEN s_suppkey % 3 = 0 THEN 'lsb: Distro ' || s_nationkey
              ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'red: Release ' ELSE 'suse: Release ' END || s_nationkey END AS distribution
  FROM supplier)"""
HOST_ROWS = HOSTS + """, facts AS (
  SELECT node, 'Cpu_count' AS metric, CAST(cpu_count AS VARCHAR) AS value FROM hosts
  UNION ALL SELECT node, 'Mem_total', CAST(mem_total AS VARCHAR) FROM hosts
  UNION ALL SELECT node, 'Now', CAST(now AS VARCHAR) FROM hosts
  UNION ALL SELECT node, 'Uname_distribution', distribution FROM hosts WHERE distribution IS NOT NULL)"""


def release_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two release files per host, of which one host in five has none that counts."""
    s = table(spark, sf, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    lsb = F.concat(F.lit('DISTRIB_ID=Distro\nDISTRIB_DESCRIPTION="Distro '), n, F.lit('"\nX=1\n'))
    other = F.concat(F.lit("Release "), n, F.lit("\nsecond line\n"))
    files = F.array(
        F.when((k % 3 == 0) & (k % 5 != 0), F.struct(F.lit("/etc/lsb-release").alias("path"), lsb.alias("content"))),
        F.when(k % 5 != 0, F.struct(
            F.when(k % 2 == 0, F.lit("/etc/red-release")).otherwise(F.lit("/etc/suse_version")).alias("path"),
            other.alias("content"))),
        F.struct(F.lit("/etc/hosts").alias("path"), F.lit("127.0.0.1 x\n").alias("content")),
    )
    return s.select(F.concat(F.lit("h"), k).alias("host"), F.inline(F.array_compact(files)))


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    wide = s.select(
        F.concat(F.lit("h"), "s_suppkey").alias("node"),
        (F.col("s_suppkey") % 64 + 1).alias("cpu_count"),
        (F.floor("s_acctbal") * 1048576).alias("mem_total"),
        (F.lit(1700000000) + F.col("s_suppkey")).alias("now"),
    )
    known = m.distribution(release_files(spark, sf)).withColumnRenamed("host", "node")
    return wide.join(known, "node", "left")


@query("m4_host_metrics", f"WITH {HOST_ROWS} SELECT * FROM facts")
def host_rows(spark: SparkSession, sf: str) -> DataFrame:
    return m.host_metrics(hosts(spark, sf)).select("node", "metric", "value")


@query("m5_distribution", f"WITH {HOSTS} SELECT node AS host, distribution FROM hosts WHERE distribution IS NOT NULL")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    return m.distribution(release_files(spark, sf))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Latest value per node, tick and metric; odd-length names count as host rows."""
    base = metrics(spark, sf).withColumn("tick", tick_of(F.col("ts")))
    kind = F.when(F.length("metric") % 2 == 1, fixed.TYPE_HOST).otherwise(fixed.TYPE_PLUGIN)
    return m.latest_values(base.withColumn("type", kind), ["node", "tick"])


LATEST = METRICS + """, latest AS (
  SELECT node, tick, metric, max_by(value, (ts, id)) AS value FROM metrics GROUP BY ALL)"""


@query("m6_metrics_json", f"""
WITH {LATEST}
SELECT node, tick, '{{"information":[' || coalesce(string_agg('{{"name":"' || metric || '","value":"' || value || '"}}', ',' ORDER BY metric)
   FILTER (WHERE length(metric) % 2 = 1), '') || ']}}' AS document
FROM latest GROUP BY node, tick""")
def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    return m.metrics_json(reports(spark, sf), ["node", "tick"])


@query("m7_metrics_tsv", f"""
WITH {LATEST}
SELECT node, tick, string_agg(metric || chr(9) || value || chr(10), '' ORDER BY metric) || chr(10) AS document
FROM latest GROUP BY node, tick""")
def metrics_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return m.metrics_tsv(reports(spark, sf), ["node", "tick"])


HEALTH = METRICS + """, facts AS (
  SELECT node, tick, ts, id, CASE metric WHEN 'ERROR' THEN 'SLAVE_RUNNING' WHEN 'CLICK' THEN 'WSREP_ON' ELSE 'WSREP_LOCAL_STATE' END AS metric,
    CASE WHEN metric IN ('ERROR', 'CLICK') THEN CASE WHEN id % 4 = 0 THEN 'OFF' ELSE 'ON' END ELSE CAST(id % 3 + 2 AS VARCHAR) END AS value
  FROM metrics),
newest AS (SELECT node, tick, metric, max_by(value, (ts, id)) AS value FROM facts GROUP BY ALL),
health AS (
  SELECT node, tick, bool_or(metric = 'SLAVE_RUNNING' AND value = 'ON') AS replication_up,
    bool_or(metric = 'WSREP_ON' AND value = 'ON') AND bool_or(metric = 'WSREP_LOCAL_STATE' AND value = '4') AS cluster_up
  FROM newest GROUP BY node, tick)"""


def health_states(spark: SparkSession, sf: str) -> DataFrame:
    base = metrics(spark, sf)
    name = (
        F.when(F.col("metric") == "ERROR", "SLAVE_RUNNING")
        .when(F.col("metric") == "CLICK", "WSREP_ON")
        .otherwise("WSREP_LOCAL_STATE")
    )
    value = F.when(
        F.col("metric").isin("ERROR", "CLICK"), F.when(F.col("id") % 4 == 0, "OFF").otherwise("ON")
    ).otherwise((F.col("id") % 3 + 2).cast("string"))
    rows = base.select(
        "node", "ts", "id", tick_of(F.col("ts")).alias("tick"), name.alias("metric"), value.alias("value"),
        F.lit(2).alias("type"),
    )
    return m.health(m.latest_values(rows, ["node", "tick"]), ["node", "tick"])


@query("m8_health", f"""
WITH {HEALTH}
SELECT node, tick, replication_up, cluster_up, CASE WHEN replication_up THEN 200 ELSE 503 END AS replication_status,
  CASE WHEN cluster_up THEN 200 ELSE 503 END AS cluster_status FROM health""")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return health_states(spark, sf)


@query("m9_snapshot", f"""
WITH {LATEST}
SELECT node, tick, metric, value FROM latest""")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to maps and back."""
    base = metrics(spark, sf).withColumn("tick", tick_of(F.col("ts")))
    return m.from_snapshot(m.to_snapshot(base, ["node", "tick"]))


@query("m11_fill_forward", f"""
WITH {METRICS}, marks AS (
  SELECT node, metric, ts, 0 AS mark, id, value FROM metrics
  UNION ALL SELECT s.node, s.metric, make_timestamp(t.tick * 21600000000), 1, NULL, NULL
  FROM (SELECT DISTINCT node, metric FROM metrics) s JOIN (SELECT DISTINCT node, tick FROM metrics) t USING (node))
SELECT node, metric, epoch_us(ts) AS ts_us, known AS value FROM (
  SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY node, metric ORDER BY ts, mark, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM marks)
WHERE mark = 1 AND known IS NOT NULL""")
def fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    base = metrics(spark, sf)
    # Small tables with a large product: a fixed number keeps their partitions from being merged.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    series = base.select("node", "metric").distinct().repartition(parts, "node")
    wanted = series.join(ticks(spark, sf).repartition(parts, "node"), "node").select(
        "node", "metric", F.timestamp_micros(F.col("tick") * TICK_SECONDS * 1_000_000).alias("ts")
    )
    return m.fill_forward(m.changes_only(base), wanted).select(
        "node", "metric", F.unix_micros("ts").alias("ts_us"), "value"
    )


@query("m12_recent", f"""
WITH {METRICS}
SELECT node, metric, epoch_us(ts) AS ts_us, id, value FROM (
  SELECT *, dense_rank() OVER (PARTITION BY node ORDER BY ts DESC) AS r FROM metrics) WHERE r <= 10""")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return m.recent(metrics(spark, sf), 10).select(
        "node", "metric", F.unix_micros("ts").alias("ts_us"), "id", "value"
    )


@query("m13_assign_batch", f"WITH {BATCHES} SELECT node, tick, batch FROM batches")
def assign_batch(spark: SparkSession, sf: str) -> DataFrame:
    return m.assign_batch(ticks(spark, sf), 10)


SECTION_VALUES = ", ".join(f"('{n}', '{s}', {e})" for n, s, e, _ in fixed.SECTIONS)
DUE = BATCHES + f""", sections(section, suffix, every) AS (VALUES {SECTION_VALUES}), due AS (
  SELECT node, batch, section, suffix FROM (SELECT DISTINCT node, batch FROM batches), sections
  WHERE section = 'history' OR batch % every = 0)"""


def due(spark: SparkSession, sf: str) -> DataFrame:
    closed = m.assign_batch(ticks(spark, sf), 10).select("node", "batch").distinct()
    return m.due_sections(closed)


@query("m14_due_sections", f"WITH {DUE} SELECT node, batch, section FROM due")
def due_sections(spark: SparkSession, sf: str) -> DataFrame:
    return due(spark, sf).select("node", "batch", "section")


CONTENTS = """contents AS (
  SELECT DISTINCT '/history_n' || user_id AS name, 'h' || user_id AS content FROM events WHERE user_id % 5 <> 0
  UNION ALL SELECT DISTINCT '/template_n' || user_id || '_status', 's' || user_id FROM events WHERE user_id % 3 <> 0
  UNION ALL SELECT DISTINCT '/template_n' || user_id || '_slave', 'r' || user_id FROM events)"""


def contents(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select("user_id").distinct()
    u = F.col("user_id")
    rows = F.array(
        F.when(u % 5 != 0, F.struct(F.concat(F.lit("/history_n"), u).alias("name"), F.concat(F.lit("h"), u).alias("content"))),
        F.when(u % 3 != 0, F.struct(F.concat(F.lit("/template_n"), u, F.lit("_status")).alias("name"), F.concat(F.lit("s"), u).alias("content"))),
        F.struct(F.concat(F.lit("/template_n"), u, F.lit("_slave")).alias("name"), F.concat(F.lit("r"), u).alias("content")),
    )
    return users.select(F.inline(F.array_compact(rows))).withColumn("content_type", F.lit("text/html"))


@query("m15_delivery_plan", f"""
WITH {DUE}, {CONTENTS}
SELECT node, batch, section, d.name AS name, content, sink FROM (
  SELECT *, CASE WHEN section = 'history' THEN '/history_' || node ELSE '/template_' || node || '_' || suffix END AS name FROM due) d
JOIN contents c ON c.name = d.name, (VALUES ('smtp://a.example'), ('smtp://b.example')) s(sink)""")
def delivery_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = m.delivery_plan(due(spark, sf), ["smtp://a.example", "smtp://b.example"], contents(spark, sf))
    return plan.select("node", "batch", "section", "name", "content", "sink")


@query("m16_lookup_content", f"""
WITH {CONTENTS}, requests AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/history_n' || user_id WHEN 2 THEN '/template_n' || user_id || '_status' ELSE '/none' END AS uri FROM events)
SELECT event_id, CASE WHEN uri = '' THEN 'index.html' ELSE uri END AS name, coalesce(content, 'help') AS content, c.name IS NOT NULL AS found
FROM requests LEFT JOIN contents c ON c.name = uri""")
def lookup_content(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    uri = (
        F.when(e % 4 == 0, "")
        .when(e % 4 == 1, F.concat(F.lit("/history_n"), u))
        .when(e % 4 == 2, F.concat(F.lit("/template_n"), u, F.lit("_status")))
        .otherwise("/none")
    )
    requests = table(spark, sf, "events").select("event_id", uri.alias("uri"))
    return m.lookup_content(requests, contents(spark, sf)).select("event_id", "name", "content", "found")


KINDS = ["query", "explain", "schema", "replication", "variable", "status"]


def kinded(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 6 + 1).cast("int"))
    return metrics(spark, sf).withColumn("kind", kind)


@query("m17_resample", f"""
WITH {METRICS}, kinded AS (
  SELECT *, ['query', 'explain', 'schema', 'replication', 'variable', 'status'][CAST(id % 6 AS INT) + 1] AS kind,
    CAST([12000, 30000, 12000, 500, 3000, 200][CAST(id % 6 AS INT) + 1] AS BIGINT) AS every FROM metrics)
SELECT node, metric, kind, CAST(floor(epoch_us(ts) / (every * 1000000)) * every AS BIGINT) AS bucket,
  max_by(value, (ts, id)) AS value, count(*) AS samples
FROM kinded GROUP BY 1, 2, 3, 4""")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    """Cadences scaled by 100: the samples here are hours apart, not seconds."""
    slow = {k: v * 100 for k, v in fixed.CADENCE.items()}
    return m.resample(kinded(spark, sf), slow)


@query("m17_rejects", """
SELECT CASE WHEN event_id % 10 < 2 THEN 'unknown_kind' ELSE 'no_time' END AS reason, count(*) AS samples FROM events WHERE event_id % 10 < 3 GROUP BY 1""")
def resample_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of kinds without a cadence, and samples without a time."""
    k = F.col("id") % 10
    damaged = kinded(spark, sf).withColumns(
        {"kind": F.when(k == 0, "odd").when(k != 1, F.col("kind")), "ts": F.when(k != 2, F.col("ts"))}
    )
    return m.resample_rejects(damaged, fixed.CADENCE).groupBy("reason").agg(F.count(F.lit(1)).alias("samples"))


@query("m18_server_uid", """
SELECT s_suppkey AS k, to_base64(unhex(sha1(from_hex(
  printf('%02X%02X', (3306 + s_suppkey) % 256, (3306 + s_suppkey) // 256) || printf('%012X', s_suppkey * 7919 + 123456789))))) AS server_uid
FROM supplier""")
def server_uid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        k.alias("k"),
        (k + 3306).cast("int").alias("port"),
        F.regexp_replace(F.lpad(F.hex(k * 7919 + 123456789), 12, "0"), "(..)(?=.)", "$1:").alias("mac"),
    )
    return m.server_uid(rows).select("k", "server_uid")


@query("m19_anonymise", """
SELECT c_custkey, sha256('salt' || c_name) AS c_name, sha256('salt' || c_mktsegment) AS c_mktsegment FROM customer""")
def anonymise(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = m.anonymise(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "salt")
    return out.select("c_custkey", "c_name", "c_mktsegment")


@query("m19_dictionary", """
SELECT DISTINCT sha256('salt' || x) AS hash, x AS clear FROM (SELECT c_name AS x FROM customer UNION ALL SELECT c_mktsegment FROM customer)""")
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    _, words = m.anonymise(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "salt")
    return words


@query("m20_encrypt", "SELECT doc_id, text, false AS plain FROM documents")
def encrypt(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip through the encrypted column."""
    docs = texts(spark, sf, "documents").select("doc_id", "text", F.col("text").alias("clear"))
    hidden = m.encrypt(docs, "text", "key").withColumn("plain", F.col("text") == F.col("clear"))
    return m.decrypt(hidden, "text", "key").select("doc_id", "text", "plain")


@query("m21_reply_text", """
SELECT page_id, CASE WHEN instr(h, '<h1>') > 0 AND instr(substr(h, instr(h, '<h1>') + 4), '</h1>') > 0
  THEN split_part(substr(h, instr(h, '<h1>') + 4), '</h1>', 1) END AS reply
FROM (SELECT page_id, decode(CASE WHEN octet_length(encode(html)) <= 1023 THEN encode(html) ELSE
   encode(left(html, list_max(list_filter(range(0, 1024), lambda i: octet_length(encode(left(html, i))) <= 1023)))) END) AS h FROM pages)""")
def reply_text(spark: SparkSession, sf: str) -> DataFrame:
    return m.reply_text(texts(spark, sf, "pages"), "html", limit=1023).select("page_id", "reply")


@query("m22_by_group", """
SELECT c_mktsegment AS "group", node, CAST(GROUPING(c_mktsegment) * 2 + GROUPING(node) AS BIGINT) AS level, count(*) AS samples, count(DISTINCT event_type) AS metrics
FROM (SELECT 'n' || user_id AS node, user_id, event_type FROM events) JOIN customer ON c_custkey = user_id
GROUP BY ROLLUP (c_mktsegment, node)""")
def by_group(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "customer").select(
        F.concat(F.lit("n"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("group")
    )
    return m.by_group(
        metrics(spark, sf), tags,
        [F.count(F.lit(1)).alias("samples"), F.countDistinct("metric").alias("metrics")],
    )


@query("m23_alerts", f"""
WITH {HEALTH}
SELECT node, tick, c_name AS contact FROM (
  SELECT *, lag(replication_up) OVER (PARTITION BY node ORDER BY tick) AS before FROM health)
LEFT JOIN customer ON 'n' || c_custkey = node WHERE before AND NOT replication_up""")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    states = health_states(spark, sf).withColumn(
        "ts", F.timestamp_micros(F.col("tick") * TICK_SECONDS * 1_000_000)
    )
    contacts = table(spark, sf, "customer").select(
        F.concat(F.lit("n"), "c_custkey").alias("node"), F.col("c_name").alias("contact")
    )
    return m.alerts(states, contacts, "replication_up").select("node", "tick", "contact")

