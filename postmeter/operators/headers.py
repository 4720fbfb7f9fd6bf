"""Mail headers: ingest and projection.

``messages`` has ``msg_key`` and ``raw`` (string or binary). ``with_headers`` adds
the parsed header as an array, so envelope, ids, hops and importance are
projections of the message row and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter.functions import codecs, dates, fixed, mail, text


def with_headers(messages: DataFrame, keep_body: bool = False) -> DataFrame:
    """Replace ``raw`` by ``headers`` (and ``body``, an octet string, if asked for)."""
    keep = [c for c in messages.columns if c != "raw"]
    split = mail.split_message(text.octets(F.col("raw")))
    rows = messages.select(*keep, split.alias("__m"))
    cols = [mail.header_fields(F.get("__m", F.lit(0))).alias("headers")]
    if keep_body:
        cols.append(F.coalesce(F.get("__m", F.lit(1)), F.lit("")).alias("body"))
    return text.settled(rows.select(*keep, *cols), ["headers", "body"] if keep_body else ["headers"])


def explode_headers(messages: DataFrame) -> DataFrame:
    """One row per header field."""
    keep = [c for c in messages.columns if c != "raw"]
    return with_headers(messages).select(*keep, F.inline_outer("headers")).filter("pos is not null")


def field(messages: DataFrame, name: str) -> DataFrame:
    """First value of a field of each message that has it, read off the row: no explode, no shuffle."""
    keep = [c for c in messages.columns if c != "raw"]
    value = mail.header_first("headers", name).alias("value")
    return with_headers(messages).select(*keep, value).filter("value is not null")


def field_all(messages: DataFrame, name: str) -> DataFrame:
    """All values of a field of each message that has it, in order, read off the row: no explode, no shuffle."""
    keep = [c for c in messages.columns if c != "raw"]
    values = mail.header_all("headers", name).alias("values")
    return with_headers(messages).select(*keep, values).filter(F.size("values") > 0)


def header(headers: DataFrame, name: str, all: bool = False, key: str = "msg_key") -> DataFrame:
    """First value of a field per message of a flat header table, or all values in order."""
    hits = headers.filter(F.lower("name") == name.lower()).groupBy(key)
    if not all:
        return hits.agg(F.min_by("value", "pos").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return hits.agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def envelope(
    messages: DataFrame, ingest_ts: Column | None = None, host: str = "localhost", rare: bool = False
) -> DataFrame:
    """From, Reply-To, To, Cc, Bcc, Subject, id and date.

    The date is that of the first Received field, else of Date, else ``ingest_ts``;
    both header dates are kept. With ``rare`` subjects in any charset are read, and only those
    that need it reach Python.
    """
    keep = [c for c in messages.columns if c != "raw"]
    names = ("from", "reply-to", "to", "cc", "bcc", "subject", "received", "date", "message-id")
    # The values come out in a projection of their own: each is looked up once.
    values = with_headers(messages).select(
        *keep, *[mail.header_first("headers", n).alias("__" + n.replace("-", "_")) for n in names]
    )
    values = decode_words(values, "__subject", rare)
    rows = values.select(
        *keep,
        mail.mailbox(F.col("__from")).alias("from"),
        mail.mailbox(F.col("__reply_to")).alias("reply_to"),
        *[mail.address_list(F.col(f"__{n}")).alias(n) for n in ("to", "cc", "bcc")],
        F.col("__subject").alias("subject"),
        mail.message_id(F.col("__message_id")).alias("message_id"),
        dates.mail_date(mail.received_date(F.col("__received")), ingest_ts).alias("received_date"),
        dates.mail_date(F.col("__date"), ingest_ts).alias("header_date"),
        F.col("__received").isNotNull().alias("has_received"),
    )
    now = ingest_ts if ingest_ts is not None else F.lit(None).cast("timestamp")
    return rows.withColumn(
        "date",
        F.when(F.col("has_received"), F.col("received_date.ts")).otherwise(
            F.coalesce("header_date.ts", now)
        ),
    )


def typed_headers(headers: DataFrame) -> DataFrame:
    """Add the value type of each field and its typed reading."""
    types = F.create_map(*[F.lit(x) for kv in fixed.HEADER_TYPES.items() for x in kv])
    kind = F.coalesce(types[F.lower("name")], F.lit("text"))
    v = F.col("value")
    return headers.withColumn("kind", kind).select(
        *headers.columns,
        "kind",
        F.when(F.col("kind") == "text", mail.decoded(v)).alias("text"),
        F.when(F.col("kind") == "mailbox", mail.mailbox(v)).alias("mailbox"),
        F.when(F.col("kind").isin("address_list", "mailbox_list"), mail.address_list(v)).alias("addresses"),
        F.when(F.col("kind") == "datetime", dates.mail_date(v)).alias("date"),
        F.when(F.col("kind") == "relay", mail.received(v)).alias("relay"),
        F.when(F.col("kind") == "path", mail.return_path(v)).alias("path"),
        F.when(F.col("kind") == "message_id", mail.message_id(v)).alias("id"),
        F.when(F.col("kind") == "message_id_sequence", mail.message_ids(v)).alias("ids"),
        F.when(F.col("kind").isin("media_type", "disposition", "encoding"), F.lower(mail.main_value(v))).alias("main"),
        F.when(F.col("kind").isin("media_type", "disposition"), mail.header_params(v)).alias("params"),
        F.when(F.col("kind") == "receipt_disposition", mail.receipt_disposition(v)).alias("receipt"),
    )


def decode_words(df: DataFrame, col: str, rare: bool = False) -> DataFrame:
    """Decode encoded words. With ``rare`` any charset works; only values that need it reach Python."""
    value = F.col(col)
    if not rare:
        return df.withColumn(col, mail.decoded(value))
    needs = mail.has_rare_words(value)
    out = df.withColumn("__rare", mail.rare_words(F.when(needs, value)))
    return out.withColumn(col, F.coalesce("__rare", mail.decoded(value))).drop("__rare")


def encode_words(df: DataFrame, col: str, charset: str = "utf-8", chunk: int = 15) -> DataFrame:
    """Header text to encoded words where needed, whole characters per word."""
    value = F.col(col)
    pieces = F.regexp_extract_all(value, F.lit(rf"(?s).{{1,{chunk}}}"), F.lit(0))

    def words(kind: Column) -> Column:
        # The kind comes from the whole text, so it is found once and not once a word.
        return F.transform(
            pieces,
            lambda p: F.concat(
                F.lit(f"=?{charset}?"),
                kind,
                F.lit("?"),
                F.when(kind == "B", codecs.base64_text(p)).otherwise(codecs.word_q(p)),
                F.lit("?="),
            ),
        )

    encoded = F.array_join(text.bound(text.choose_word_encoding(value, charset), words), "\r\n ")
    return df.withColumn(col, F.when(text.word_needs_encoding(value, charset), encoded).otherwise(value))


def explode_addresses(df: DataFrame, col: str) -> DataFrame:
    """One row per mailbox: position, group, display name, address."""
    keep = [c for c in df.columns if c != col]
    rows = df.select(*keep, F.posexplode(mail.address_list(F.col(col))).alias("pos", "a"))
    return rows.withColumn("m", mail.mailbox(F.col("a.address"))).select(
        *keep, "pos", F.col("a.group").alias("group"), F.col("m.name").alias("name"), F.col("m.address").alias("email")
    )


def split_address(df: DataFrame, col: str, host: str = "localhost") -> DataFrame:
    return df.withColumn("__a", mail.address_parts(F.col(col), host)).select(*df.columns, "__a.local", "__a.domain")


@F.pandas_udf(T.StringType())
def _idna(label: pd.Series) -> pd.Series:
    """``xn--`` labels to text and labels with other than ASCII characters to ``xn--``."""

    def one(s):
        if s is None:
            return None
        try:
            if s[:4].lower() == "xn--":
                return s[4:].encode("ascii").decode("punycode")
            if not s.isascii():
                return "xn--" + s.encode("punycode").decode("ascii")
        except UnicodeError:
            pass
        return s

    return label.map(one)


def idna_domain(df: DataFrame, col: str, out: str = "other_form") -> DataFrame:
    """Add the other form of each domain, label by label; plain ASCII labels stay as they are.

    Only distinct domains with such a label reach Python, then they are joined back.
    """
    domain = F.col(col)
    special = F.rlike(domain, F.lit(r"(?i)(?:^|\.)xn--|[^\x00-\x7F]"))
    labels = (
        df.filter(special)
        .select(domain.alias("__d"))
        .distinct()
        .select("__d", F.posexplode(F.split("__d", r"\.")).alias("__i", "__l"))
        .withColumn("__l", _idna("__l"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("__i", "__l")))
    forms = labels.groupBy("__d").agg(F.array_join(F.transform(ordered, lambda x: x["__l"]), ".").alias("__f"))
    return (
        df.join(forms, domain == F.col("__d"), "left").withColumn(out, F.coalesce("__f", domain)).drop("__d", "__f")
    )


def calendar(df: DataFrame, ts: str, zone: str | None = None) -> DataFrame:
    """Week, weekday, leap year and month length of an instant, on its local clock if a zone is given."""
    t = dates.local_time(F.col(ts), F.col(zone)) if zone else F.col(ts)
    return df.withColumns(
        {
            "local_ts": t,
            "iso_week": dates.week(t),
            "plain_week": dates.week(t, iso=False),
            "weekday": F.dayofweek(t) - 1,
            "leap": dates.is_leap(t),
            "month_days": dates.days_in_month(t),
        }
    )


def reference_edges(messages: DataFrame, fields: Sequence[str] = ("references", "in-reply-to")) -> DataFrame:
    """Message → referenced id, in order, per field."""
    h = "headers"
    own = mail.message_id(mail.header_first(h, "message-id"))
    keep = [c for c in messages.columns if c != "raw"]
    lists = F.array(
        *[
            F.struct(F.lit(f).alias("field"), mail.message_ids(mail.header_first(h, f)).alias("ids"))
            for f in fields
        ]
    )
    rows = with_headers(messages).select(*keep, own.alias("id"), F.inline(lists))
    return rows.select(*keep, "id", "field", F.posexplode("ids").alias("pos", "ref"))


def thread_keys(messages: DataFrame) -> DataFrame:
    """Thread root and depth per message, from its own header alone.

    The root is the first reference, else the first In-Reply-To, else the message itself.
    """
    h = "headers"
    keep = [c for c in messages.columns if c != "raw"]
    rows = with_headers(messages).select(
        *keep,
        mail.message_id(mail.header_first(h, "message-id")).alias("id"),
        mail.message_ids(mail.header_first(h, "references")).alias("refs"),
        mail.message_ids(mail.header_first(h, "in-reply-to")).alias("replied"),
        dates.mail_date(mail.header_first(h, "date"))["ts"].alias("ts"),
    )
    return rows.select(
        *keep,
        "id",
        F.coalesce(F.get("refs", F.lit(0)), F.get("replied", F.lit(0)), F.col("id")).alias("root"),
        F.size("refs").alias("depth"),
        "ts",
    )


def threads(messages: DataFrame) -> DataFrame:
    """Size, depth and time span per thread; partial sums are merged before the shuffle."""
    return thread_keys(messages).groupBy("root").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("depth").alias("depth"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def received_hops(messages: DataFrame) -> DataFrame:
    """One row per Received field, newest first, with the delay since the hop before it."""
    keep = [c for c in messages.columns if c != "raw"]
    # Hops are listed newest first, so the hop before is the next value of the same message.
    values = mail.header_all("headers", "received")
    pairs = "inline(transform(hops, (v, i) -> struct(i as pos, v as value, get(hops, i + 1) as older)))"
    rows = with_headers(messages).select(*keep, values.alias("hops")).select(*keep, F.expr(pairs))
    parsed = rows.select(
        *keep,
        "pos",
        mail.received(F.col("value")).alias("r"),
        dates.mail_date(mail.received_date(F.col("value")))["ts"].alias("ts"),
        dates.mail_date(mail.received_date(F.col("older")))["ts"].alias("older_ts"),
    )
    return parsed.select(
        *keep,
        "pos",
        *[F.col(f"r.{k}").alias(k) for k in ("from", "by", "via", "with", "id", "for")],
        "ts",
        (F.unix_seconds("ts") - F.unix_seconds("older_ts")).alias("delay"),
    )


def return_path(messages: DataFrame) -> DataFrame:
    keep = [c for c in messages.columns if c != "raw"]
    rows = with_headers(messages).select(
        *keep, mail.return_path(mail.header_first("headers", "return-path")).alias("p")
    )
    return rows.select(*keep, F.col("p.local").alias("local"), F.col("p.domain").alias("domain"))


def importance(messages: DataFrame) -> DataFrame:
    h = "headers"
    keep = [c for c in messages.columns if c != "raw"]
    return with_headers(messages).select(
        *keep,
        mail.importance(mail.header_first(h, "x-priority"), mail.header_first(h, "importance")).alias("importance"),
    )
