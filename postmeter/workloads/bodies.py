"""Mail body, part, text and attachment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.functions import codecs, mail, text
from postmeter.operators import bodies as b
from postmeter.operators import compose as c
from postmeter.operators import headers as h
from postmeter.sources import corpus
from postmeter.sources.tables import table, texts
from postmeter.workloads.registry import query


def path_text(col: str):
    return F.concat_ws(".", F.transform(col, lambda x: x.cast("string")))


def document_parts(spark: SparkSession, sf: str) -> DataFrame:
    return b.explode_parts(corpus.document_messages(spark, sf))


def page_parts(spark: SparkSession, sf: str) -> DataFrame:
    return b.explode_parts(corpus.page_messages(spark, sf))


# The tree of a page message: alternative of plain text and related(html, object, unused object).
PAGE_TREE = """tree(part_path, depth, type, subtype, n_children) AS (VALUES
  ('', 0, 'multipart', 'alternative', 2), ('0', 1, 'text', 'plain', 0), ('1', 1, 'multipart', 'related', 3),
  ('1.0', 2, 'text', 'html', 0), ('1.1', 2, 'image', 'png', 0), ('1.2', 2, 'image', 'gif', 0))"""


@query("e30_explode_parts", f"""
WITH {PAGE_TREE}
SELECT 'p' || page_id AS msg_key, part_path, depth, type, subtype FROM pages, tree""")
def explode_parts(spark: SparkSession, sf: str) -> DataFrame:
    return page_parts(spark, sf).select("msg_key", path_text("part_path").alias("part_path"), "depth", "type", "subtype")


@query("e30_nested_parts", f"""
WITH d AS (SELECT doc_id, text, CAST(doc_id % {corpus.NESTED} + 1 AS BIGINT) AS d FROM documents), l AS (SELECT *, unnest(range(1, d + 1)) AS k FROM d)
SELECT 'n' || doc_id AS msg_key, rtrim(repeat('1.', d - k), '.') AS part_path, CAST(d - k AS INT) AS depth, 'multipart' AS type, 'mixed' AS subtype, 2 AS n_children,
  'prolog ' || k AS prolog, 'epilog ' || k AS epilog, NULL AS digest FROM l
UNION ALL SELECT 'n' || doc_id, repeat('1.', d - k) || '0', CAST(d - k + 1 AS INT), 'text', 'plain', 0, NULL, NULL, md5('level ' || k) FROM l
UNION ALL SELECT 'n' || doc_id, rtrim(repeat('1.', d), '.'), CAST(d AS INT), 'text', 'plain', 0, NULL, NULL, md5(text) FROM d""")
def nested_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of one to seven levels, with what stands in front of the first part and behind the last one."""
    parts = b.explode_parts(corpus.nested_messages(spark, sf))
    return parts.select(
        "msg_key", path_text("part_path").alias("part_path"), "depth", "type", "subtype", "n_children", "prolog", "epilog",
        F.md5(text.octets_to_bytes(F.col("body"))).alias("digest"),
    )


CRLF_TEXT = "regexp_replace({t}, '\\r\\n|\\r|\\n', chr(13) || chr(10), 'g')"


@query("e31_part_tree", f"""
WITH {PAGE_TREE}
SELECT part_path, depth, n_children, CASE WHEN depth = 0 THEN NULL WHEN depth = 1 THEN '' ELSE '1' END AS parent_path, count(*) AS parts
FROM pages, tree GROUP BY ALL""")
def part_tree(spark: SparkSession, sf: str) -> DataFrame:
    tree = b.part_tree(page_parts(spark, sf))
    return tree.groupBy(
        path_text("part_path").alias("part_path"), "depth", "n_children",
        F.when(F.col("depth") > 0, path_text("parent_path")).alias("parent_path"),
    ).agg(F.count(F.lit(1)).alias("parts"))


@query("e32_media_type", f"""
WITH {PAGE_TREE}
SELECT type, subtype, count(*) AS parts FROM (SELECT type, subtype FROM pages, tree UNION ALL SELECT 'text', 'plain' FROM documents
  UNION ALL SELECT 'text', 'plain' FROM documents UNION ALL SELECT 'multipart', 'mixed' FROM documents) GROUP BY type, subtype""")
def media_type(spark: SparkSession, sf: str) -> DataFrame:
    parts = page_parts(spark, sf).unionByName(document_parts(spark, sf))
    return b.media_type(parts).groupBy("type", "subtype").agg(F.count(F.lit(1)).alias("parts"))


@query("e33_decode_parts", f"""
SELECT 'd' || doc_id AS msg_key, '0' AS part_path, md5({CRLF_TEXT.format(t='text')}) AS digest FROM documents
UNION ALL SELECT 'd' || doc_id, '1', md5(text) FROM documents""")
def decode_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every body decoded from its raw message, against the source text."""
    leaves = b.decode_parts(document_parts(spark, sf)).filter("n_children = 0")
    return leaves.select("msg_key", path_text("part_path").alias("part_path"), F.md5("content").alias("digest"))


LOW = "length(regexp_replace({t}, '[^\\x00-\\x7E]', '', 'g'))"
CHOICE = (
    "CASE WHEN strlen({t}) = 0 THEN 'base64' "
    "WHEN " + LOW + " = strlen({t}) THEN CASE WHEN regexp_matches({t}, '[^\\n]{{79}}') OR contains({t}, chr(10) || '.') THEN 'quoted-printable' ELSE '7bit' END "
    "WHEN strlen({t}) - " + LOW + " <= strlen({t}) // 5 THEN 'quoted-printable' ELSE 'base64' END"
)


@query("e34_encode_parts", f"""
SELECT doc_id, md5({CRLF_TEXT.format(t='text')}) AS digest, true AS lines_ok FROM documents""")
def encode_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Encode by choice and decode again; encoded lines stay within 76 columns."""
    docs = texts(spark, sf, "documents").select("doc_id", text.to_crlf(F.col("text")).alias("t"))
    chosen = docs.withColumn("encoding", text.choose_encoding(F.col("t")))
    out = b.encode_parts(chosen, "t")
    octet = text.octets(F.col("t"))
    back = codecs.transfer_bytes(octet, codecs.encoding_name(F.col("encoding")))
    return out.select(
        "doc_id", F.md5(back).alias("digest"),
        ((F.col("encoding") == "7bit") | ~F.rlike("t", F.lit(r"(?:\A|\n)[^\n]{78}"))).alias("lines_ok"),
    )


@query("e35_choose_encoding", f"SELECT doc_id, {CHOICE.format(t='text')} AS encoding FROM documents")
def choose_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", text.choose_encoding(F.col("text")).alias("encoding"))


@query("e36_to_utf8", """
SELECT doc_id, text = regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g') AS latin,
  md5(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')) AS from_latin, md5(text) AS from_utf16 FROM documents""")
def to_utf8(spark: SparkSession, sf: str) -> DataFrame:
    """Texts stored in two charsets and read back, one natively and one through Python."""
    docs = texts(spark, sf, "documents")
    safe = F.regexp_replace("text", r"[^\x00-\xFF]", "?")
    stored = docs.select(
        "doc_id", (safe == F.col("text")).alias("latin"),
        F.encode(safe, "ISO-8859-1").alias("l"), F.encode("text", "UTF-16LE").alias("u"),
        F.lit("ISO-8859-1").alias("lc"), F.lit("utf-16-le").alias("uc"),
    )
    read = b.to_utf8(b.to_utf8(stored, "l", "lc", "lt"), "u", "uc", "ut")
    return read.select("doc_id", "latin", F.md5(F.col("lt").cast("binary")).alias("from_latin"), F.md5(F.col("ut").cast("binary")).alias("from_utf16"))


@query("e37_utf8_quality", """
SELECT lang, count(*) AS documents, sum(length(text)) AS code_points, count(*) - count(CASE WHEN doc_id % 10 = 0 THEN 1 END) AS valid, 0 AS boms
FROM documents GROUP BY lang""")
def utf8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """One document in ten gets a broken byte at its end; the repair adds one character each."""
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))).otherwise(
        F.col("text").cast("binary")
    )
    q = b.utf8_quality(texts(spark, sf, "documents").select("doc_id", "lang", broken.alias("data")), "data")
    return q.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("code_points") - F.when(F.col("valid"), 0).otherwise(1)).alias("code_points"),
        F.count_if("valid").alias("valid"),
        F.count_if("bom").alias("boms"),
    )


@query("e38_normalise_lines", f"""
SELECT lang, count(*) AS documents, sum(length({CRLF_TEXT.format(t='text')})) AS crlf_chars,
  sum(length(replace({CRLF_TEXT.format(t='text')}, chr(13) || chr(10), chr(10)))) AS lf_chars,
  sum(length(regexp_replace(text, '\\n\\.', chr(10) || '..', 'g'))) AS stuffed_chars,
  count(*) AS restored FROM documents GROUP BY lang""")
def normalise_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    docs = texts(spark, sf, "documents").select(
        "lang", "text", text.to_crlf(t).alias("crlf"), text.to_lf(text.to_crlf(t)).alias("lf"), text.stuff_dots(t).alias("dots")
    )
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.char_length("crlf")).alias("crlf_chars"),
        F.sum(F.char_length("lf")).alias("lf_chars"),
        F.sum(F.char_length("dots")).alias("stuffed_chars"),
        F.count_if(text.unstuff_dots(F.col("dots")) == t).alias("restored"),
    )


@query("e39_attachments", f"""
WITH {PAGE_TREE}
SELECT subtype, type = 'image' AS with_inline, false AS without_inline, count(*) AS parts FROM pages, tree GROUP BY ALL""")
def attachments(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with a content id count as attachments only when inline objects are asked for."""
    parts = page_parts(spark, sf)
    with_inline = b.attachments(parts, inline=True).withColumnRenamed("is_attachment", "with_inline")
    both = b.attachments(with_inline).withColumnRenamed("is_attachment", "without_inline")
    return both.groupBy("subtype", "with_inline", "without_inline").agg(F.count(F.lit(1)).alias("parts"))


@query("e40_attachment_inventory", """
SELECT 'd' || doc_id AS msg_key, '1' AS part_path, source || '-' || doc_id || '.txt' AS name, 'copy of ' || doc_id AS description,
  'text' AS type, 'plain' AS subtype, CASE WHEN n = 0 THEN 0 ELSE n + 2 * ((n - 1) // 76) END AS size, false AS is_message
FROM (SELECT *, CAST(ceil(strlen(text) / 3.0) * 4 AS BIGINT) AS n FROM documents)""")
def attachment_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return b.attachment_inventory(document_parts(spark, sf)).withColumn("part_path", path_text("part_path"))


@query("e41_text_parts", """
SELECT 'p' || page_id AS msg_key, part_path, kind FROM pages, (VALUES ('0', 'plain'), ('1.0', 'html')) t(part_path, kind)
UNION ALL SELECT 'd' || doc_id, '0', 'plain' FROM documents""")
def text_parts(spark: SparkSession, sf: str) -> DataFrame:
    both = page_parts(spark, sf).unionByName(document_parts(spark, sf))
    return b.text_parts(both).select("msg_key", path_text("part_path").alias("part_path"), "kind")


@query("e42_embedded_objects", """
SELECT 'p' || page_id AS msg_key, '1.0' AS html_path, '1.1' AS object_path, 'id' AS rule, 'p' || page_id || '@x' AS ref FROM pages""")
def embedded_objects(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.embedded_objects(page_parts(spark, sf))
    return rows.withColumns({"html_path": path_text("html_path"), "object_path": path_text("object_path")})


@query("e43_plain_alternative", "SELECT 'p' || page_id AS msg_key, '1.0' AS html_path, '0' AS plain_path FROM pages")
def plain_alternative(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.plain_alternative(page_parts(spark, sf))
    return rows.withColumns({"html_path": path_text("html_path"), "plain_path": path_text("plain_path")})


@query("e44_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents")
def digests(spark: SparkSession, sf: str) -> DataFrame:
    return b.digests(texts(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "md5", "sha1")


@query("e44_duplicates", "SELECT sha1(text) AS sha1, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return b.duplicates(texts(spark, sf, "documents"), "text", "doc_id")


@query("e45_compose", """
SELECT 'd' || doc_id AS msg_key, source || '@' || lang || '.example' AS sender, md5(text) AS attachment, false AS failed FROM documents
UNION ALL SELECT 'x' || doc_id, NULL, NULL, true FROM documents""")
def compose(spark: SparkSession, sf: str) -> DataFrame:
    """Composed, parsed again, and compared with the source; rows without recipient fail."""
    messages = corpus.document_messages(spark, sf)
    sender = mail.header_first("headers", "from")
    parts = b.decode_parts(b.explode_parts(messages))
    files = parts.filter(F.col("disposition") == "attachment").select("msg_key", F.md5("content").alias("attachment"))
    good = h.with_headers(messages).select("msg_key", sender.alias("sender")).join(files, "msg_key")
    none = texts(spark, sf, "documents").select(F.concat(F.lit("x"), "doc_id").alias("msg_key"), F.lit("").alias("to"), F.col("text").alias("plain"))
    bad = c.compose(none).select(
        "msg_key", F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("attachment"), F.col("error").isNotNull().alias("failed")
    )
    return good.withColumn("failed", F.lit(False)).unionByName(bad)


@query("e46_receipt_requests", """
WITH c AS (SELECT *, 'c' || conv_id || '.t' || turn AS msg_key, 'user' || conv_id || '@d' || (conv_id % 5) || '.example' AS u FROM conversations WHERE turn % 4 = 1)
SELECT msg_key, u AS address, turn % 3 = 2 OR turn % 5 = 1 AS confirm FROM c
UNION ALL SELECT msg_key, 'copy@d.example', true FROM c WHERE turn % 5 = 1""")
def receipt_requests(spark: SparkSession, sf: str) -> DataFrame:
    return b.receipt_requests(corpus.conversation_messages(spark, sf)).select("msg_key", "address", "confirm")


@query("e47_receipts", """
SELECT 'o' || o_orderkey AS msg_key, CASE WHEN o_orderkey % 15 <> 0 THEN 'o' || o_orderkey || '@shop.example' END AS original_id,
  'manual-action' AS action_mode, 'MDN-sent-' || CASE WHEN o_orderkey % 2 = 0 THEN 'manually' ELSE 'automatically' END AS sending_mode,
  CASE WHEN o_orderkey % 6 = 0 THEN 'deleted' ELSE 'displayed' END AS type,
  CASE WHEN o_orderkey % 6 = 0 THEN 'error|warning' ELSE '' END AS modifiers
FROM orders WHERE o_orderkey % 3 = 0""")
def receipts(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.receipts(b.explode_parts(corpus.receipt_messages(spark, sf)))
    return rows.select("msg_key", "original_id", "action_mode", "sending_mode", "type", F.array_join("modifiers", "|").alias("modifiers"))


@query("e47_receipt_rate", """
SELECT o_custkey % 50 AS sender, count(*) AS sent, count(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 <> 0 THEN 1 END) AS answered
FROM orders GROUP BY 1""")
def receipt_rate(spark: SparkSession, sf: str) -> DataFrame:
    got = b.receipts(b.explode_parts(corpus.receipt_messages(spark, sf)))
    sent = table(spark, sf, "orders").select(
        F.concat(F.lit("o"), "o_orderkey", F.lit("@shop.example")).alias("id"), (F.col("o_custkey") % 50).alias("sender")
    )
    return b.receipt_rate(got, sent, "sender")


@query("e48_delivery_codes", """
SELECT domain, code, enhanced, count(*) AS replies FROM (
  SELECT o_orderkey % 7 AS domain, CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 250 ELSE 550 END AS code,
    CASE o_orderkey % 4 WHEN 0 THEN '2.1.5' WHEN 1 THEN '5.1.1' WHEN 2 THEN '0.0.0' ELSE '4.2.0' END AS enhanced FROM orders) GROUP BY ALL""")
def delivery_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    reply = (
        F.when(k == 0, "250-first line\r\n250 2.1.5 Ok\r\n")
        .when(k == 1, "550 5.1.1 No such user\r\n")
        .when(k == 2, "250-plain\r\n250 done")
        .otherwise("550-mixed\r\n450 4.2.0 later\r\n")
    )
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 7).alias("domain"), reply.alias("reply"))
    return b.delivery_codes(rows).groupBy("domain", "code", "enhanced").agg(F.count(F.lit(1)).alias("replies"))


ASCII = "(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) - len(regexp_extract_all(text, '=\\?')) - CASE WHEN text LIKE '%=' THEN 1 ELSE 0 END)"


@query("e49_text_quality", f"""
SELECT lang, source, count(*) AS documents, sum(strlen(text)) AS bytes, sum({ASCII}) AS ascii,
  count(CASE WHEN {ASCII} = strlen(text) THEN 1 END) AS seven_bit,
  sum(length(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS trimmed,
  sum(length(replace(replace(text, '\\', '\\\\'), '"', '\\"'))) AS quoted
FROM documents GROUP BY lang, source""")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = b.text_quality(texts(spark, sf, "documents"), "text")
    return q.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.sum("ascii").alias("ascii"),
        F.count_if("is_7bit").alias("seven_bit"), F.sum("trimmed").alias("trimmed"), F.sum("quoted").alias("quoted"),
    )


@query("e7_header_params", """
SELECT 'd' || doc_id AS msg_key, '1' AS part_path, 'filename' AS key, source || '-' || doc_id || '.txt' AS value FROM documents
UNION ALL SELECT 'd' || doc_id, '1', 'name', source || '-' || doc_id || '.txt' FROM documents
UNION ALL SELECT 'd' || doc_id, '0', 'charset', 'utf-8' FROM documents""")
def header_params(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of every part as rows; boundaries are left out."""
    parts = document_parts(spark, sf)
    maps = F.array(mail.header_params(F.col("content_type")), mail.header_params(F.col("disposition_value")))
    rows = parts.select("msg_key", path_text("part_path").alias("part_path"), F.explode(maps).alias("m"))
    return rows.select("msg_key", "part_path", F.explode("m").alias("key", "value")).filter("key <> 'boundary'")
