"""Mail derived from the given tables: every message is rendered to raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmeter.operators import compose as c
from postmeter.operators import headers as h
from postmeter.operators import sliced
from postmeter.sources.tables import table, texts

# Zones a message date cycles through, with their offset in minutes.
ZONES = [("+0000", 0), ("-0500", -300), ("+0530", 330), ("EST", -300), ("Z", 0)]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def mail_date_text(seconds: Column, index: Column) -> Column:
    """Instant as a mail date in a zone chosen by ``index``."""
    local = F.timestamp_seconds(seconds + pick([m for _, m in ZONES], index) * 60)
    return F.concat(
        F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" "), pick([z for z, _ in ZONES], index)
    )


EPOCH_2024 = 1704067200


def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One message per turn, with references to all earlier turns."""
    t = texts(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    mid = lambda n: F.concat(F.lit("<c"), conv, F.lit(".t"), n, F.lit("@corpus.example>"))
    user = F.concat(F.lit('"User, '), conv, F.lit('" <user'), conv, F.lit("@d"), conv % 5, F.lit(".example>"))
    bot = F.lit("Assistant (the bot) <assistant@corpus.example>")
    is_user = F.col("role") == "user"
    group = F.concat(
        F.lit("team: a"), conv, F.lit('@x.example, "B, C" <b@y.example>; z'), turn, F.lit("@z.example")
    )
    earlier = F.when(turn > 0, F.array_join(F.transform(F.sequence(F.lit(0), turn - 1), mid), " "))
    sent = F.lit(EPOCH_2024) + conv * 3600 + turn * 60
    header = lambda name, value, when=None: F.when(
        F.lit(True) if when is None else when, F.struct(F.lit(name).alias("name"), value.alias("value"))
    )
    hop = lambda frm, by, secs: F.concat(
        F.lit("from "), frm, F.lit(" (helo for me) by "), by, F.lit(" with ESMTP id q"), conv, F.lit("x"), turn,
        F.lit(" for <to@corpus.example>; "), mail_date_text(sent + secs, turn),
    )
    extra = F.array(
        header("Received", hop(F.lit("video.example"), F.lit("mx.corpus.example"), 90 + turn), turn % 2 == 0),
        header("Received", hop(F.concat(F.lit("host"), conv % 3, F.lit(".example")), F.lit("relay.example"), 30), turn % 2 == 0),
        header("Return-Path", F.concat(F.lit("<user"), conv, F.lit("@d"), conv % 5, F.lit(".example>")), turn % 3 != 2),
        header("X-Priority", F.concat((conv + turn) % 7, F.lit(" (grade)")), (conv + turn) % 4 == 1),
        header("Importance", pick(["low", "High", "odd"], conv), (conv + turn) % 4 != 3),
        header(
            "Disposition-Notification-To",
            F.concat(F.lit("user"), conv, F.lit("@d"), conv % 5, F.lit(".example"), F.when(turn % 5 == 1, ", copy@d.example").otherwise("")),
            turn % 4 == 1,
        ),
    )
    rows = t.select(
        F.concat(F.lit("c"), conv, F.lit(".t"), turn).alias("msg_key"),
        F.array(F.lit("conv"), (conv % 7).cast("string")).alias("folder"),
        F.when(is_user, user).otherwise(bot).alias("from_"),
        F.when(is_user, bot).otherwise(user).alias("to"),
        F.when(turn % 3 == 0, group).alias("cc"),
        F.concat(F.lit("Re: conversation "), conv).alias("subject"),
        mail_date_text(sent, conv + turn).alias("date"),
        mid(turn).alias("message_id"),
        F.when(turn > 0, mid(turn - 1)).alias("in_reply_to"),
        earlier.alias("references"),
        F.col("text").alias("plain"),
        extra.alias("extra"),
    )
    return c.compose(rows).drop("error")


def subject_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A message for each document with the whole text as its subject, in encoded words."""
    rows = texts(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("msg_key"),
        F.array(F.lit("lang"), "lang").alias("folder"),
        F.concat("source", F.lit("@"), "lang", F.lit(".example")).alias("from_"),
        F.lit("archive@corpus.example").alias("to"),
        F.col("text").alias("subject"),
        F.lit("see the subject").alias("plain"),
    )
    return c.compose(h.encode_words(rows, "subject", chunk=200)).drop("error")


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A text and an attachment of the same text; the subject names it in encoded words."""
    d = texts(spark, sf, "documents")
    name = F.concat("source", F.lit("-"), "doc_id", F.lit(".txt"))
    file = F.struct(
        name.alias("name"),
        F.lit("text/plain").alias("type"),
        F.concat(F.lit("copy of "), "doc_id").alias("description"),
        F.col("text").cast("binary").alias("content"),
    )
    rows = d.select(
        F.concat(F.lit("d"), "doc_id").alias("msg_key"),
        F.array(F.lit("lang"), "lang").alias("folder"),
        F.concat("source", F.lit("@"), "lang", F.lit(".example")).alias("from_"),
        F.lit("archive@corpus.example").alias("to"),
        F.concat(F.lit("é "), "doc_id").alias("subject"),
        F.col("text").alias("plain"),
        F.array(file).alias("attachments"),
    )
    return c.compose(h.encode_words(rows, "subject")).drop("error")


# Multiparts around the attachment of a nested message: one to so many.
NESTED = 7


def nested_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A text as an attachment inside one to seven multiparts, each with a text part of its own, a prolog and an epilog."""
    d = texts(spark, sf, "documents")
    depth = (F.col("doc_id") % NESTED + 1).cast("int")
    inner_first = F.sequence(F.lit(1), depth)
    begin = lambda k: F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="b'), k, F.lit('x"\r\n\r\nprolog '), k, F.lit("\r\n--b"), k,
        F.lit("x\r\nContent-Type: text/plain\r\n\r\nlevel "), k, F.lit("\r\n--b"), k, F.lit("x\r\n"),
    )
    end = lambda k: F.concat(F.lit("\r\n--b"), k, F.lit("x--\r\nepilog "), k)
    name = F.concat("source", F.lit("-"), "doc_id", F.lit(".txt"))
    leaf = F.concat(
        F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Disposition: attachment; filename="), name, F.lit("\r\n\r\n"), F.col("text")
    )
    return d.select(
        F.concat(F.lit("n"), "doc_id").alias("msg_key"),
        F.concat(
            F.lit("From: archive@corpus.example\r\n"), F.array_join(F.transform(F.reverse(inner_first), begin), ""), leaf,
            F.array_join(F.transform(inner_first, end), ""),
        ).alias("raw"),
    )


def page_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Html with an embedded object and a plain alternative."""
    p = texts(spark, sf, "pages")
    k = F.col("page_id")
    obj = F.struct(
        F.concat(F.lit("p"), k, F.lit("@x")).alias("id"),
        F.lit("image/png").alias("type"),
        F.encode(F.col("url"), "UTF-8").alias("content"),
    )
    unused = F.struct(
        F.lit("unused@x").alias("id"), F.lit("image/gif").alias("type"), F.encode(F.lit("none"), "UTF-8").alias("content")
    )
    rows = p.select(
        F.concat(F.lit("p"), k).alias("msg_key"),
        F.array(F.lit("page"), (k % 3).cast("string")).alias("folder"),
        F.lit("crawler@corpus.example").alias("from_"),
        F.lit("archive@corpus.example").alias("to"),
        F.concat(F.lit("Page "), k).alias("subject"),
        F.concat(F.lit("page "), k).alias("plain"),
        F.concat("html", F.lit('<img src="cid:p'), k, F.lit('@x">')).alias("html"),
        F.array(obj, unused).alias("embedded"),
    )
    return c.compose(rows).drop("error")


def mailbox_state(spark: SparkSession, sf: str) -> DataFrame:
    """``folder, num, uid, flags, modseq``: one message per document; every seventh uid is skipped."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    flags = (
        F.coalesce("q", F.lit(0))
        + F.coalesce("t", F.lit(0)) * 16
        + F.when(F.col("doc_id") % 9 == 0, 4).otherwise(0)
        + F.when(F.col("doc_id") % 11 == 0, 2).otherwise(0)
    )
    rows = d.join(lab, "doc_id", "left").select(
        F.array(F.lit("lang"), "lang").alias("folder"), "doc_id", flags.cast("int").alias("flags")
    )
    ranked = sliced.row_numbers(rows, ["folder"], ["doc_id"], sliced.number_slice(F.col("doc_id"), 1 << 20), "r")
    r = F.col("r").cast("bigint")
    return ranked.select(
        "folder",
        r.alias("num"),
        (r + F.floor((r - 1) / 6)).cast("string").alias("uid"),
        "flags",
        F.col("doc_id").alias("modseq"),
    )


def receipt_messages(spark: SparkSession, sf: str) -> DataFrame:
    """A message for each order: a receipt for every third, one in five without the original id, else plain mail."""
    k = F.col("o_orderkey")
    o = texts(spark, sf, "orders")
    b = F.concat(F.lit("=_r"), k)
    notice = F.concat(
        F.lit("Reporting-UA: reader.example\r\n"),
        F.when(k % 15 != 0, F.concat(F.lit("Original-Message-ID: <o"), k, F.lit("@shop.example>\r\n"))).otherwise(""),
        F.lit("Disposition: manual-action/MDN-sent-"),
        F.when(k % 2 == 0, "manually").otherwise("automatically"),
        F.lit("; "),
        F.when(k % 6 == 0, "deleted/error, warning").otherwise("displayed"),
        F.lit("\r\n"),
    )
    human = c.part([("Content-Type", F.lit("text/plain"))], F.lit("The message was shown."))
    machine = c.part([("Content-Type", F.lit("message/disposition-notification"))], notice)
    raw = F.concat(
        c.field("From", F.concat(F.lit("reader"), F.col("o_custkey") % 50, F.lit("@c.example"))),
        c.field("To", F.lit("shop@shop.example")),
        c.field(
            "Content-Type",
            F.concat(F.lit("multipart/report; report-type=disposition-notification; boundary="), F.lit('"'), b, F.lit('"')),
        ),
        F.lit("\r\n"),
        c.multipart([human, machine], b),
    )
    plain = F.concat(
        c.field("From", F.concat(F.lit("reader"), F.col("o_custkey") % 50, F.lit("@c.example"))),
        c.field("Subject", F.concat(F.lit("order "), k)),
        F.lit("\r\nThe message was shown.\r\n"),
    )
    return o.select(F.concat(F.lit("o"), k).alias("msg_key"), F.when(k % 3 == 0, raw).otherwise(plain).alias("raw"))
