"""Mail header queries; every one reads rendered raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import dates, mail
from postmeter.operators import headers as h
from postmeter.sources import corpus
from postmeter.sources.tables import table
from postmeter.workloads.registry import query

ROLE = "CASE WHEN role = 'user' THEN {u} ELSE {a} END"
USER = "'user' || conv_id || '@d' || (conv_id % 5) || '.example'"
BOT = "'assistant@corpus.example'"
ZONE_TEXT = "['+0000', '-0500', '+0530', 'EST', 'Z'][CAST(({i}) % 5 AS INT) + 1]"
ZONE_MIN = "[0, -300, 330, -300, 0][CAST(({i}) % 5 AS INT) + 1]"
SENT = "(1704067200 + conv_id * 3600 + turn * 60)"


def mail_date(seconds: str, index: str) -> str:
    return (
        f"strftime(make_timestamp(({seconds} + {ZONE_MIN.format(i=index)} * 60) * 1000000), '%a, %d %b %Y %H:%M:%S') "
        f"|| ' ' || {ZONE_TEXT.format(i=index)}"
    )


def hop(frm: str, by: str, secs: str) -> str:
    return (
        f"'from ' || {frm} || ' (helo for me) by ' || {by} || ' with ESMTP id q' || conv_id || 'x' || turn || "
        f"' for <to@corpus.example>; ' || {mail_date(f'({SENT} + {secs})', 'turn')}"
    )


HOP1 = hop("'video.example'", "'mx.corpus.example'", "90 + turn")
HOP2 = hop("'host' || (conv_id % 3) || '.example'", "'relay.example'", "30")
MID = "'c' || conv_id || '.t' || {n} || '@corpus.example'"
REFS = "list_transform(range(0, turn), lambda n: '<c' || conv_id || '.t' || n || '@corpus.example>')"

HEADERS = f"""c AS (SELECT *, 'c' || conv_id || '.t' || turn AS msg_key FROM conversations), headers AS (
  SELECT msg_key, 'From' AS name, {ROLE.format(u=f"'\"User, ' || conv_id || '\" <' || {USER} || '>'", a="'Assistant (the bot) <assistant@corpus.example>'")} AS value FROM c
  UNION ALL SELECT msg_key, 'To', {ROLE.format(a=f"'\"User, ' || conv_id || '\" <' || {USER} || '>'", u="'Assistant (the bot) <assistant@corpus.example>'")} FROM c
  UNION ALL SELECT msg_key, 'Cc', 'team: a' || conv_id || '@x.example, "B, C" <b@y.example>; z' || turn || '@z.example' FROM c WHERE turn % 3 = 0
  UNION ALL SELECT msg_key, 'Subject', 'Re: conversation ' || conv_id FROM c
  UNION ALL SELECT msg_key, 'Date', {mail_date(SENT, 'conv_id + turn')} FROM c
  UNION ALL SELECT msg_key, 'Message-ID', '<' || {MID.format(n='turn')} || '>' FROM c
  UNION ALL SELECT msg_key, 'In-Reply-To', '<' || {MID.format(n='(turn - 1)')} || '>' FROM c WHERE turn > 0
  UNION ALL SELECT msg_key, 'References', array_to_string({REFS}, ' ') FROM c WHERE turn > 0
  UNION ALL SELECT msg_key, 'Received', {HOP1} FROM c WHERE turn % 2 = 0
  UNION ALL SELECT msg_key, 'Received', {HOP2} FROM c WHERE turn % 2 = 0
  UNION ALL SELECT msg_key, 'Return-Path', '<' || {USER} || '>' FROM c WHERE turn % 3 <> 2
  UNION ALL SELECT msg_key, 'X-Priority', ((conv_id + turn) % 7) || ' (grade)' FROM c WHERE (conv_id + turn) % 4 = 1
  UNION ALL SELECT msg_key, 'Importance', ['low', 'High', 'odd'][CAST(conv_id % 3 AS INT) + 1] FROM c WHERE (conv_id + turn) % 4 <> 3
  UNION ALL SELECT msg_key, 'Disposition-Notification-To', {USER} || CASE WHEN turn % 5 = 1 THEN ', copy@d.example' ELSE '' END FROM c WHERE turn % 4 = 1
  UNION ALL SELECT msg_key, 'Mime-Version', '1.0' FROM c)"""


@query("e1_explode_headers", f"""
WITH {HEADERS}
SELECT msg_key, name, value FROM headers""")
def explode_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = h.explode_headers(corpus.conversation_messages(spark, sf).drop("folder"))
    return rows.filter(~F.col("name").startswith("Content-")).select("msg_key", "name", "value")


@query("e2_header_first", f"""
WITH {HEADERS}
SELECT msg_key, min_by(value, CASE WHEN value LIKE 'from video%' THEN 0 ELSE 1 END) AS value FROM headers WHERE name = 'Received' GROUP BY msg_key""")
def header_first(spark: SparkSession, sf: str) -> DataFrame:
    return h.field(corpus.conversation_messages(spark, sf), "received").select("msg_key", "value")


@query("e2_header_all", f"""
WITH {HEADERS}
SELECT msg_key, string_agg(value, ' | ' ORDER BY CASE WHEN value LIKE 'from video%' THEN 0 ELSE 1 END) AS "values" FROM headers WHERE name = 'Received' GROUP BY msg_key""")
def header_all(spark: SparkSession, sf: str) -> DataFrame:
    found = h.field_all(corpus.conversation_messages(spark, sf), "RECEIVED")
    return found.select("msg_key", F.array_join("values", " | ").alias("values"))


@query("e3_envelope", f"""
SELECT 'c' || conv_id || '.t' || turn AS msg_key,
  {ROLE.format(u="'User, ' || conv_id", a="'Assistant'")} AS from_name,
  {ROLE.format(u=USER, a=BOT)} AS from_address,
  {ROLE.format(u="'Assistant'", a="'User, ' || conv_id")} AS to_name,
  CASE WHEN turn % 3 = 0 THEN 3 ELSE 0 END AS cc_count,
  'Re: conversation ' || conv_id AS subject,
  CASE WHEN turn % 2 = 0 THEN {SENT} + 90 + turn ELSE {SENT} END AS date_s,
  {SENT} AS header_date_s
FROM conversations""")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    e = h.envelope(corpus.conversation_messages(spark, sf))
    return e.select(
        "msg_key",
        F.col("from.name").alias("from_name"),
        F.col("from.address").alias("from_address"),
        _mailbox_name("to").alias("to_name"),
        F.coalesce(F.size("cc"), F.lit(0)).alias("cc_count"),
        "subject",
        F.unix_seconds("date").alias("date_s"),
        F.unix_seconds("header_date.ts").alias("header_date_s"),
    )


def _mailbox_name(col: str):
    return mail.mailbox(F.get(col, F.lit(0))["address"])["name"]


KINDS = """CASE name WHEN 'From' THEN 'mailbox' WHEN 'To' THEN 'address_list' WHEN 'Cc' THEN 'address_list' WHEN 'Date' THEN 'datetime'
  WHEN 'Received' THEN 'relay' WHEN 'Return-Path' THEN 'path' WHEN 'Message-ID' THEN 'message_id' WHEN 'In-Reply-To' THEN 'message_id_sequence'
  WHEN 'References' THEN 'message_id_sequence' WHEN 'Disposition-Notification-To' THEN 'mailbox_list' ELSE 'text' END"""


@query("e4_typed_headers", f"""
WITH {HEADERS}
SELECT kind, count(*) AS fields, sum(CASE WHEN kind = 'text' THEN length(value) ELSE 0 END) AS text_chars,
  sum(CASE kind WHEN 'address_list' THEN CASE WHEN name = 'Cc' THEN 3 ELSE 1 END
      WHEN 'mailbox_list' THEN CASE WHEN value LIKE '%,%' THEN 2 ELSE 1 END ELSE 0 END) AS addresses,
  sum(CASE WHEN kind = 'message_id_sequence' THEN len(string_split(value, ' ')) ELSE 0 END) AS ids
FROM (SELECT *, {KINDS} AS kind FROM headers) GROUP BY kind""")
def typed_headers(spark: SparkSession, sf: str) -> DataFrame:
    flat = h.explode_headers(corpus.conversation_messages(spark, sf))
    typed = h.typed_headers(flat.filter(~F.col("name").startswith("Content-")))
    return typed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("fields"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("text_chars"),
        F.coalesce(F.sum(F.size("addresses")), F.lit(0)).alias("addresses"),
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids"),
    )


@query("e5_decode_words", """
SELECT lang, source, count(*) AS messages, count(DISTINCT s) AS subjects, sum(length(s)) AS chars, min(s) AS first_subject
FROM (SELECT lang, source, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM documents) GROUP BY lang, source""")
def decode_words(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects that travelled as encoded words, per language and sender."""
    parsed = h.with_headers(corpus.subject_messages(spark, sf)).select(
        mail.header_first("headers", "subject").alias("subject"), mail.header_first("headers", "from").alias("sender")
    )
    rows = h.decode_words(parsed, "subject").select(
        F.regexp_extract("sender", "@([^.]*)", 1).alias("lang"),
        F.regexp_extract("sender", "^([^@]*)", 1).alias("source"),
        F.btrim("subject", F.lit(" \t\r\n")).alias("s"),
    )
    return rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("s").alias("subjects"),
        F.sum(F.char_length("s")).alias("chars"),
        F.min("s").alias("first_subject"),
    )


ASCII_COUNT = "(length(regexp_replace({t}, '[^\\x00-\\x7F]', '', 'g')) - len(regexp_extract_all({t}, '=\\?')) - CASE WHEN {t} LIKE '%=' THEN 1 ELSE 0 END)"


@query("e6_word_choice", f"""
SELECT lang, choice, count(*) AS documents FROM (
  SELECT lang, CASE WHEN NOT (length(s) <> strlen(s) OR regexp_matches(s, '[\\r\\n]') OR s LIKE '%=?%' OR s LIKE '%?=%') THEN 'none'
    WHEN floor(100 * {ASCII_COUNT.format(t='s')} / strlen(s)) < 60 THEN 'B' ELSE 'Q' END AS choice
  FROM (SELECT lang, text AS s FROM documents)) GROUP BY lang, choice""")
def word_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Encoding chosen for each subject, read back from the raw message."""
    flat = h.explode_headers(corpus.subject_messages(spark, sf))
    choice = F.when(~F.col("value").startswith("=?"), "none").otherwise(F.regexp_extract("value", r"^=\?[^?]*\?([BQ])\?", 1))
    lang = F.regexp_extract(F.element_at("folder", 2), "(.*)", 1)
    return (
        flat.filter(F.lower("name") == "subject")
        .groupBy(lang.alias("lang"), choice.alias("choice"))
        .agg(F.count(F.lit(1)).alias("documents"))
    )


@query("e8_explode_addresses", f"""
WITH c AS (SELECT *, 'c' || conv_id || '.t' || turn AS msg_key FROM conversations)
SELECT msg_key, 0 AS pos, 'team' AS "group", '' AS name, 'a' || conv_id || '@x.example' AS email FROM c WHERE turn % 3 = 0
UNION ALL SELECT msg_key, 1, 'team', 'B, C', 'b@y.example' FROM c WHERE turn % 3 = 0
UNION ALL SELECT msg_key, 2, NULL, '', 'z' || turn || '@z.example' FROM c WHERE turn % 3 = 0""")
def explode_addresses(spark: SparkSession, sf: str) -> DataFrame:
    cc = h.field(corpus.conversation_messages(spark, sf), "cc")
    return h.explode_addresses(cc.drop("folder"), "value")


@query("e9_split_mailbox", f"""
SELECT {ROLE.format(u="'User, ' || conv_id", a="'Assistant'")} AS name, {ROLE.format(u=USER, a=BOT)} AS email, count(*) AS messages
FROM conversations GROUP BY 1, 2""")
def split_mailbox(spark: SparkSession, sf: str) -> DataFrame:
    senders = h.field(corpus.conversation_messages(spark, sf), "from")
    return h.explode_addresses(senders, "value").groupBy("name", "email").agg(F.count(F.lit(1)).alias("messages"))


@query("e10_domain_volume", f"""
SELECT split_part(a, '@', 2) AS domain, count(*) AS messages, count(DISTINCT split_part(a, '@', 1)) AS senders
FROM (SELECT {ROLE.format(u=USER, a=BOT)} AS a FROM conversations) GROUP BY 1""")
def domain_volume(spark: SparkSession, sf: str) -> DataFrame:
    senders = h.field(corpus.conversation_messages(spark, sf), "from")
    parts = h.split_address(h.explode_addresses(senders, "value"), "email")
    return parts.groupBy("domain").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("local").alias("senders")
    )


@query("e11_idna_domain", """
SELECT DISTINCT c_custkey, 'kunde' || (c_custkey % 100) || '.example' AS domain, 'kunde' || (c_custkey % 100) || '.example' AS other_form FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT c_custkey, 'xn--kln-sna.example', 'köln.example' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'bücher.example', 'xn--bcher-kva.example' FROM customer WHERE c_custkey % 4 = 2""")
def idna_domain(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    domain = (
        F.when(k % 4 == 0, "xn--kln-sna.example")
        .when(k % 4 == 2, "bücher.example")
        .otherwise(F.concat(F.lit("kunde"), k % 100, F.lit(".example")))
    )
    return h.idna_domain(table(spark, sf, "customer").select(k, domain.alias("domain")), "domain")


@query("e12_mail_date", f"""
SELECT 'c' || conv_id || '.t' || turn AS msg_key, {SENT} AS utc, {ZONE_MIN.format(i='(conv_id + turn)')} AS zone_min FROM conversations""")
def mail_date_query(spark: SparkSession, sf: str) -> DataFrame:
    d = h.field(corpus.conversation_messages(spark, sf), "date")
    return d.select("msg_key", dates.mail_date(F.col("value")).alias("d")).select(
        "msg_key", F.unix_seconds("d.ts").alias("utc"), F.col("d.zone_min").alias("zone_min")
    )


@query("e13_calendar", f"""
WITH t AS (SELECT make_timestamp(({SENT} + {ZONE_MIN.format(i='(conv_id + turn)')} * 60) * 1000000) AS l FROM conversations)
SELECT CAST(week(l) AS BIGINT) AS iso_week, CASE WHEN week(l) = 1 AND month(l) = 12 THEN 53 ELSE week(l) END AS plain_week,
  dayofweek(l) AS weekday, year(l) = 2024 AS leap, day(last_day(l)) AS month_days, count(*) AS messages
FROM t GROUP BY ALL""")
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    d = h.field(corpus.conversation_messages(spark, sf), "date")
    rows = d.select(dates.mail_date(F.col("value")).alias("d")).select("d.*")
    return h.calendar(rows, "ts", "zone_min").groupBy("iso_week", "plain_week", "weekday", "leap", "month_days").agg(
        F.count(F.lit(1)).alias("messages")
    )


@query("e14_message_ids", f"SELECT 'c' || conv_id || '.t' || turn AS msg_key, {MID.format(n='turn')} AS id FROM conversations")
def message_ids(spark: SparkSession, sf: str) -> DataFrame:
    return h.thread_keys(corpus.conversation_messages(spark, sf)).select("msg_key", "id")


@query("e15_reference_edges", f"""
SELECT {MID.format(n='turn')} AS id, 'references' AS field, n AS pos, {MID.format(n='n')} AS ref
FROM (SELECT *, unnest(range(0, turn)) AS n FROM conversations)
UNION ALL SELECT {MID.format(n='turn')}, 'in-reply-to', 0, {MID.format(n='(turn - 1)')} FROM conversations WHERE turn > 0""")
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    return h.reference_edges(corpus.conversation_messages(spark, sf)).select("id", "field", "pos", "ref")


@query("e16_threads", f"""
SELECT {MID.format(n='0')} AS root, count(*) AS size, max(turn) AS depth, min({SENT}) AS first_s, max({SENT}) AS last_s
FROM conversations GROUP BY conv_id""")
def threads(spark: SparkSession, sf: str) -> DataFrame:
    return h.threads(corpus.conversation_messages(spark, sf)).select(
        "root", "size", "depth", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s")
    )


@query("e17_received_hops", f"""
SELECT 'c' || conv_id || '.t' || turn AS msg_key, n AS pos,
  CASE n WHEN 0 THEN 'video.example' ELSE 'host' || (conv_id % 3) || '.example' END || ' (helo for me)' AS "from",
  CASE n WHEN 0 THEN 'mx.corpus.example' ELSE 'relay.example' END AS "by", 'ESMTP' AS "with", 'q' || conv_id || 'x' || turn AS id,
  '<to@corpus.example>' AS "for", {SENT} + CASE n WHEN 0 THEN 90 + turn ELSE 30 END AS at, CASE n WHEN 0 THEN 60 + turn END AS delay
FROM (SELECT *, unnest([0, 1]) AS n FROM conversations WHERE turn % 2 = 0)""")
def received_hops(spark: SparkSession, sf: str) -> DataFrame:
    return h.received_hops(corpus.conversation_messages(spark, sf)).select(
        "msg_key", "pos", "from", "by", F.array_join("with", ",").alias("with"), "id", "for",
        F.unix_seconds("ts").alias("at"), "delay",
    )


@query("e18_return_path", """
SELECT 'c' || conv_id || '.t' || turn AS msg_key, CASE WHEN turn % 3 <> 2 THEN 'user' || conv_id END AS local,
  CASE WHEN turn % 3 <> 2 THEN 'd' || (conv_id % 5) || '.example' END AS domain FROM conversations""")
def return_path(spark: SparkSession, sf: str) -> DataFrame:
    return h.return_path(corpus.conversation_messages(spark, sf).drop("folder"))


@query("e19_importance", """
SELECT importance, count(*) AS messages FROM (
  SELECT CASE WHEN (conv_id + turn) % 4 = 1 THEN CASE (conv_id + turn) % 7 WHEN 1 THEN 'highest' WHEN 2 THEN 'high' WHEN 4 THEN 'low' WHEN 5 THEN 'lowest' ELSE 'normal' END
    WHEN (conv_id + turn) % 4 = 3 THEN 'normal'
    ELSE CASE conv_id % 3 WHEN 0 THEN 'lowest' WHEN 1 THEN 'highest' ELSE 'normal' END END AS importance FROM conversations) GROUP BY 1""")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return h.importance(corpus.conversation_messages(spark, sf)).groupBy("importance").agg(
        F.count(F.lit(1)).alias("messages")
    )
