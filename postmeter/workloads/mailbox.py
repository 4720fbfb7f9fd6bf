"""Mailbox-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import codecs, mail
from postmeter.operators import headers as h
from postmeter.operators import mailbox as mb
from postmeter.sources import corpus, nodes
from postmeter.sources.tables import table
from postmeter.workloads.registry import query

STATE = """state AS (
  SELECT 'lang/' || lang AS folder, num, CAST(num + (num - 1) // 6 AS BIGINT) AS uid, flags, doc_id AS modseq, doc_id FROM (
    SELECT d.doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id) AS num,
      coalesce(q, 0) + coalesce(t, 0) * 16 + CASE WHEN d.doc_id % 9 = 0 THEN 4 ELSE 0 END + CASE WHEN d.doc_id % 11 = 0 THEN 2 ELSE 0 END AS flags
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id))"""


def flat(df: DataFrame) -> DataFrame:
    """Folders as text, uids as numbers where they are numbers."""
    return df.withColumn("folder", F.concat_ws("/", "folder"))


def state(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.mailbox_state(spark, sf)


@query("e60_flags", f"""
WITH {STATE}
SELECT folder, uid || ':2,' || CASE WHEN flags & 16 <> 0 THEN 'F' ELSE '' END || CASE WHEN flags & 1 <> 0 THEN 'S' ELSE '' END || CASE WHEN flags & 4 <> 0 THEN 'T' ELSE '' END AS file_name,
  flags & 21 AS flags, CAST(uid AS VARCHAR) AS id,
  array_to_string(list_filter([CASE WHEN flags & 16 <> 0 THEN '\\Flagged' END, CASE WHEN flags & 4 <> 0 THEN '\\Deleted' END, CASE WHEN flags & 1 <> 0 THEN '\\Seen' END], lambda x: x IS NOT NULL), ' ') AS keywords
FROM state WHERE flags <> 2
UNION ALL SELECT folder, CAST(uid AS VARCHAR), 0, CAST(uid AS VARCHAR), '' FROM state WHERE flags = 2""")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    """File names written from flags and read back; being recent is not part of a name."""
    names = mb.encode_flags(state(spark, sf)).select("folder", "file_name")
    read = mb.decode_flags(names)
    return flat(read).select("folder", "file_name", "flags", "id", F.array_join("keywords", " ").alias("keywords"))


UPDATES = """updates AS (
  SELECT folder, uid, ['set', 'add', 'remove'][CAST(uid % 3 AS INT) + 1] AS mode, 5 AS mask FROM state WHERE uid % 4 = 0)"""


@query("e61_update_flags", f"""
WITH {STATE}, {UPDATES}
SELECT s.folder AS folder, s.uid AS uid, CASE mode WHEN 'set' THEN mask WHEN 'add' THEN flags | mask WHEN 'remove' THEN flags & ~mask ELSE flags END AS flags
FROM state s LEFT JOIN updates u ON s.folder = u.folder AND s.uid = u.uid""")
def update_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = state(spark, sf)
    n = F.col("uid").cast("bigint")
    updates = s.filter(n % 4 == 0).select(
        "folder", "uid", corpus.pick(["set", "add", "remove"], n).alias("mode"), F.lit(5).alias("mask")
    )
    out = flat(mb.update_flags(s, updates))
    return out.select("folder", F.col("uid").cast("bigint").alias("uid"), "flags")


@query("e62_expunge", f"""
WITH {STATE}
SELECT folder, uid, row_number() OVER (PARTITION BY folder ORDER BY num) AS num, false AS removed FROM state WHERE flags & 4 = 0
UNION ALL SELECT folder, uid, num, true FROM state WHERE flags & 4 <> 0""")
def expunge(spark: SparkSession, sf: str) -> DataFrame:
    kept, removed = mb.expunge(state(spark, sf))
    both = kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))
    return flat(both).select("folder", F.col("uid").cast("bigint").alias("uid"), "num", "removed")


@query("e63_copy", f"""
WITH {STATE}
SELECT folder, count(*) AS messages, min(num) AS lo, max(num) AS hi, count(DISTINCT num) AS numbers, sum(flags) AS flags FROM (
  SELECT folder, num, flags FROM state
  UNION ALL SELECT 'lang/en', (SELECT max(num) FROM state WHERE folder = 'lang/en') + row_number() OVER (ORDER BY doc_id), flags FROM state WHERE folder <> 'lang/en' AND flags & 1 = 1)
GROUP BY folder""")
def copy(spark: SparkSession, sf: str) -> DataFrame:
    """Seen messages of the other folders copied into one; numbers go on without a gap."""
    s = state(spark, sf)
    chosen = s.filter((F.element_at("folder", 2) != "en") & (F.col("flags").bitwiseAND(1) == 1))
    out = mb.copy(s, chosen, ["lang", "en"], modseq=10**9)
    return flat(out).groupBy("folder").agg(
        F.count(F.lit(1)).alias("messages"), F.min("num").alias("lo"), F.max("num").alias("hi"),
        F.countDistinct("num").alias("numbers"), F.sum("flags").alias("flags"),
    )


@query("e64_folder_status", f"""
WITH {STATE}
SELECT folder, count(*) AS messages, count(CASE WHEN flags & 1 = 0 THEN 1 END) AS unseen, count(CASE WHEN flags & 2 <> 0 THEN 1 END) AS recent,
  max(uid) + 1 AS next_uid, max(modseq) AS highest_modseq FROM state GROUP BY folder""")
def folder_status(spark: SparkSession, sf: str) -> DataFrame:
    return flat(mb.folder_status(state(spark, sf)))


@query("e65_diff_listing", f"""
WITH {STATE}
SELECT folder, uid, event FROM (SELECT folder, uid, CASE WHEN uid % 10 = 0 THEN 'removed' WHEN uid % 10 = 1 THEN 'added' WHEN uid % 10 = 2 THEN 'flags' END AS event FROM state) WHERE event IS NOT NULL""")
def diff_listing(spark: SparkSession, sf: str) -> DataFrame:
    s = state(spark, sf)
    n = F.col("uid").cast("bigint") % 10
    new = s.filter(n != 0).withColumn("flags", F.when(n == 2, F.col("flags").bitwiseXOR(1)).otherwise(F.col("flags")))
    out = mb.diff_listing(s.filter(n != 1), new)
    return flat(out).select("folder", F.col("uid").cast("bigint").alias("uid"), "event")


FOLDERS = """folders AS (
  SELECT DISTINCT unnest([n_name, n_name || '/' || c_mktsegment, n_name || '/' || c_mktsegment || '/' || (c_custkey % 5)]) AS folder
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """Three levels: nation, segment, and a block of customers."""
    names = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    path = F.array("n_name", "c_mktsegment", (F.col("c_custkey") % 5).cast("string"))
    levels = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.slice(path, 1, n))
    return names.select(F.explode(levels).alias("folder")).distinct()


@query("e66_folder_tree", f"""
WITH {FOLDERS}
SELECT p.folder AS parent, f.folder AS folder, len(string_split(f.folder, '/')) - len(string_split(p.folder, '/')) AS distance
FROM folders f JOIN folders p ON starts_with(f.folder, p.folder || '/')""")
def folder_tree(spark: SparkSession, sf: str) -> DataFrame:
    return flat(mb.folder_tree(folders(spark, sf))).withColumn("parent", F.concat_ws("/", "parent"))


@query("e66_has_children", f"""
WITH {FOLDERS}
SELECT p.folder AS folder, count(CASE WHEN NOT contains(substr(f.folder, length(p.folder) + 2), '/') THEN f.folder END) AS direct, count(f.folder) AS subfolders
FROM folders p LEFT JOIN folders f ON starts_with(f.folder, p.folder || '/') GROUP BY 1""")
def has_children(spark: SparkSession, sf: str) -> DataFrame:
    return flat(mb.has_children(folders(spark, sf)))


@query("e67_rename_folder", f"""
WITH {FOLDERS}
SELECT CASE WHEN folder = 'NATION_1' OR starts_with(folder, 'NATION_1/') THEN 'Old/First' || substr(folder, 9) ELSE folder END AS folder FROM folders""")
def rename_folder(spark: SparkSession, sf: str) -> DataFrame:
    return flat(mb.rename_folder(folders(spark, sf), ["NATION_1"], ["Old", "First"]))


@query("e68_folder_names", """
SELECT doc_id, regexp_replace(text, '[\\r\\n\\t]', ' ', 'g') AS name FROM documents""")
def folder_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names encoded for the store and read back."""
    clean = F.regexp_replace("text", r"[\r\n\t]", " ")
    stored = table(spark, sf, "documents").select("doc_id", codecs.folder_name_encoded(clean).alias("name"))
    return mb.folder_names(stored).select("doc_id", F.col("text").alias("name"))


@query("e69_folder_attributes", """
SELECT c_mktsegment AS segment, contains_messages, has_children, special_use, count(*) AS folders FROM (
  SELECT c_mktsegment, c_custkey % 4 <> 0 AS contains_messages, c_custkey % 3 = 0 AS has_children,
    CASE c_custkey % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'junk' WHEN 2 THEN 'trash' ELSE 'none' END AS special_use FROM customer) GROUP BY ALL""")
def folder_attributes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    listed = F.array_compact(
        F.array(
            F.when(k % 4 == 0, "\\NoSelect"),
            F.when(k % 3 == 0, "\\HasChildren").otherwise("\\HasNoChildren"),
            F.when(k % 5 == 0, "\\All").when(k % 5 == 1, "\\Junk").when(k % 5 == 2, "\\Trash"),
            F.when(k % 5 == 0, "\\Sent"),
        )
    )
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), listed.alias("flags"))
    return mb.folder_attributes(rows).groupBy("segment", "contains_messages", "has_children", "special_use").agg(
        F.count(F.lit(1)).alias("folders")
    )


RANGES = """ranges AS (
  SELECT k, min(n) AS lo, max(n) AS hi FROM (
    SELECT k, n, n - dense_rank() OVER (PARTITION BY k ORDER BY n) AS g FROM (SELECT DISTINCT l_suppkey AS k, l_orderkey AS n FROM lineitem)) GROUP BY k, g)"""


@query("e70_to_ranges", f"WITH {RANGES} SELECT k, lo, hi FROM ranges")
def to_ranges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("n"))
    return mb.to_ranges(lines, ["k"], "n", width=4096)


@query("e70_uid_ranges", f"""
WITH {STATE}
SELECT folder, CAST(min(uid) AS VARCHAR) AS lo, CAST(max(uid) AS VARCHAR) AS hi FROM (
  SELECT folder, uid, uid - row_number() OVER (PARTITION BY folder ORDER BY uid) AS g FROM state) WHERE folder <> 'lang/de' GROUP BY folder, g
UNION ALL SELECT folder, 'x' || uid, 'x' || uid FROM state WHERE folder = 'lang/de'""")
def uid_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """One folder has uids that are no numbers and keeps them one by one."""
    s = state(spark, sf).withColumn(
        "uid", F.when(F.element_at("folder", 2) == "de", F.concat(F.lit("x"), "uid")).otherwise(F.col("uid"))
    )
    return flat(mb.uid_ranges(s, ["folder"]))


@query("e71_render_ranges", f"""
WITH {RANGES}, lines AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY lo) - 1) // 1000 AS line FROM ranges)
SELECT k, CAST(line AS BIGINT) AS line, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || ':' || hi END, ',' ORDER BY lo) AS ranges FROM lines GROUP BY k, line""")
def render_ranges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("n"))
    return mb.render_ranges(mb.to_ranges(lines, ["k"], "n"), ["k"])


@query("e71_expand_ranges", "SELECT DISTINCT l_suppkey AS k, l_orderkey AS n FROM lineitem")
def expand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("n"))
    return mb.expand_ranges(mb.render_ranges(mb.to_ranges(lines, ["k"], "n"), ["k"])).select("k", "n")


@query("e72_select_set", f"""
WITH {STATE}, sets AS (SELECT DISTINCT 'lang/' || lang AS folder, doc_id AS lo, doc_id + 5 + doc_id % 7 AS hi FROM documents)
SELECT folder, uid, num FROM state s WHERE EXISTS (SELECT 1 FROM sets r WHERE r.folder = s.folder AND s.num BETWEEN r.lo AND r.hi)""")
def select_set(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    sets = table(spark, sf, "documents").select(
        F.array(F.lit("lang"), "lang").alias("folder"), d.alias("lo"), (d + 5 + d % 7).alias("hi")
    )
    out = mb.select_set(state(spark, sf), sets, width=64)
    return flat(out).select("folder", F.col("uid").cast("bigint").alias("uid"), "num")


@query("e73_since_uid", f"""
WITH {STATE}
SELECT folder, uid FROM state s WHERE uid >= 100 OR uid = (SELECT max(uid) FROM state t WHERE t.folder = s.folder)""")
def since_uid(spark: SparkSession, sf: str) -> DataFrame:
    out = mb.since_uid(state(spark, sf), 100, include_last=True)
    return flat(out).select("folder", F.col("uid").cast("bigint").alias("uid"))


@query("e74_fetch", """
SELECT 'd' || doc_id AS msg_key, 'lang/' || lang AS folder, 'multipart/mixed' AS content_type, 'normal' AS importance, source || '@' || lang || '.example' AS x_from FROM documents""")
def fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Content info, importance and one named header; bodies are not parsed."""
    rows = h.with_headers(corpus.document_messages(spark, sf))
    first = lambda name: mail.header_first("headers", name)
    wide = rows.select(
        "folder", F.col("msg_key").alias("num"), "headers",
        mail.main_value(first("content-type")).alias("content_type"),
        mail.importance(first("x-priority"), first("importance")).alias("importance"),
    )
    got = mb.fetch(wide, ["content_info", "importance"], {"x_from": first("from")})
    return flat(got).withColumnRenamed("num", "msg_key")


@query("e74_fetch_envelope", """
SELECT 'c' || conv_id || '.t' || turn AS msg_key, CASE WHEN role = 'user' THEN 'user' || conv_id || '@d' || (conv_id % 5) || '.example' ELSE 'assistant@corpus.example' END AS "from",
  'c' || conv_id || '.t' || turn || '@corpus.example' AS message_id, CASE WHEN turn % 3 = 0 THEN 4 ELSE 1 END AS recipients, 'Re: conversation ' || conv_id AS subject FROM conversations""")
def fetch_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The envelope group: sender, all recipients, subject, date and id."""
    rows = h.envelope(corpus.conversation_messages(spark, sf)).withColumn("num", F.col("msg_key"))
    got = mb.fetch(rows, ["envelope"])
    count = lambda c: F.size(F.coalesce(c, F.array()))
    return got.select(
        F.col("num").alias("msg_key"), F.col("from.address").alias("from"), "message_id",
        (count("to") + count("cc") + count("bcc")).alias("recipients"), "subject",
    )


@query("s4_parse_listing", """
SELECT o_custkey AS k, CAST(o_orderkey AS BIGINT) AS number, 'uid ' || o_orderkey || '  x' AS value FROM orders""")
def parse_listing(spark: SparkSession, sf: str) -> DataFrame:
    """One listing per customer and block of orders; repeats behind the first entry do not count."""
    o = table(spark, sf, "orders")
    line = F.concat(F.lit(" "), "o_orderkey", F.lit(" \tuid "), "o_orderkey", F.lit("  x\r\n"), "o_orderkey", F.lit(" again\r\n7\r\n"))
    lists = o.select("o_custkey", (F.col("o_orderkey") % 16).alias("block"), "o_orderkey", line.alias("line"))
    packed = lists.groupBy(F.col("o_custkey").alias("k"), "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "").alias("response")
    )
    return nodes.parse_listing(packed, "response").select("k", "number", "value")
