"""Compose raw messages from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.functions import codecs, text

CRLF = "\r\n"
FOLD_AT = 78


def fold(line: Column) -> Column:
    """Fold a header line at blanks so that lines stay within the limit where they can.

    The pattern tries every place of a text, so it only sees lines with a blank inside: encoded words have none.
    """
    pattern = rf"(?=[^\r\n]{{{FOLD_AT - 1}}})([^\r\n]{{1,{FOLD_AT - 2}}}) (?=\S)"
    folded = lambda t: F.when(F.rlike(t, F.lit(r"[^\r\n] \S")), F.regexp_replace(t, pattern, "$1\r\n ")).otherwise(t)
    return F.array_join(F.transform(F.split(line, "\n"), folded), "\n")


def field(name: str, value: Column) -> Column:
    """``Name: value`` with its line end; a null value gives nothing."""
    return F.coalesce(F.concat(fold(F.concat(F.lit(f"{name}: "), value)), F.lit(CRLF)), F.lit(""))


def encoded_body(body: Column, encoding: Column) -> Column:
    """Text with CRLF line ends under a transfer encoding."""
    return (
        F.when(encoding == "base64", codecs.base64_text(body, 76))
        .when(encoding == "quoted-printable", codecs.quoted_printable(body))
        .otherwise(body)
    )


def part(headers: list[tuple[str, Column]], body: Column) -> Column:
    """One part: its fields, an empty line, its body."""
    return F.concat(*[field(n, v) for n, v in headers], F.lit(CRLF), body)


def multipart(parts: list[Column], boundary: Column) -> Column:
    """Body of a multipart; null parts are left out."""
    open_, close = F.concat(F.lit("--"), boundary, F.lit(CRLF)), F.concat(F.lit("--"), boundary, F.lit("--" + CRLF))
    return F.concat(
        *[F.coalesce(F.concat(open_, p, F.lit(CRLF)), F.lit("")) for p in parts], close
    )


def compose(df: DataFrame) -> DataFrame:
    """Rows to ``raw``; rows without a recipient get an ``error`` instead.

    Columns used when present: ``from_``, ``to``, ``cc``, ``bcc``, ``subject``, ``date``,
    ``plain``, ``html``, ``attachments array<struct<name,type,description,content>>``,
    ``embedded array<struct<id,type,content>>`` (objects the html shows), and further
    fields as ``extra array<struct<name,value>>``.
    One part stands alone, two texts are alternatives, attachments make it mixed.
    """
    have = set(df.columns)
    missing_ = {c: F.lit(None).cast("string") for c in _TEXT_INPUTS if c not in have}
    rows = df.withColumns(missing_) if missing_ else df
    # One projection per step: what a later step uses twice is computed once.
    rows = rows.withColumns({"__plain": text.to_crlf(F.col("plain")), "__html": text.to_crlf(F.col("html"))})
    rows = rows.withColumns(
        {
            "__plain_enc": text.choose_encoding(F.col("__plain")),
            "__html_enc": text.choose_encoding(F.col("__html")),
            "__b": F.concat(F.lit("=_"), F.sha1(F.concat_ws("|", "subject", "plain", "html"))),
        }
    )
    rows = rows.withColumns(
        {"__plain_part": _text_part("plain"), "__html_part": _text_part("html")}
    )
    if "embedded" in have:
        rows = rows.withColumn("__html_part", _related(F.col("__html_part"), F.concat("__b", F.lit("_r"))))
    alternative = _wrapped(
        "alternative", F.concat("__b", F.lit("_a")), [F.col("__plain_part"), F.col("__html_part")]
    )
    both = F.col("plain").isNotNull() & F.col("html").isNotNull()
    rows = rows.withColumn(
        "__texts", F.when(both, alternative).otherwise(F.coalesce("__plain_part", "__html_part"))
    )
    if "attachments" in have:
        rows = rows.withColumn("__files", F.transform(F.coalesce("attachments", F.array()), _file_part))
        mixed = F.concat("__b", F.lit("_m"))
        lone = (F.size("__files") == 1) & F.col("__texts").isNull()
        rows = rows.withColumn(
            "__body",
            F.when(F.size("__files") == 0, F.col("__texts"))
            .when(lone, F.get("__files", F.lit(0)))
            .otherwise(_wrapped("mixed", mixed, [F.col("__texts")], F.col("__files"))),
        )
    else:
        rows = rows.withColumn("__body", F.col("__texts"))
    extra = F.lit("")
    if "extra" in have:
        lines = F.transform(
            F.array_compact("extra"),
            lambda e: F.concat(fold(F.concat(e["name"], F.lit(": "), e["value"])), F.lit(CRLF)),
        )
        extra = F.array_join(lines, "")
    head = F.concat(
        *[field(name, F.col(c)) for name, c in _FIELDS], extra, field("Mime-Version", F.lit("1.0"))
    )
    missing = text.trim_blanks(F.concat_ws("", "to", "cc", "bcc")) == ""
    keep = [c for c in df.columns if c not in _INPUTS]
    return rows.select(
        *keep,
        F.when(~missing, F.concat(head, F.coalesce("__body", F.lit(CRLF)))).alias("raw"),
        F.when(missing, "no recipient").alias("error"),
    )


_FIELDS = [
    ("From", "from_"),
    ("To", "to"),
    ("Cc", "cc"),
    ("Bcc", "bcc"),
    ("Subject", "subject"),
    ("Date", "date"),
    ("Message-ID", "message_id"),
    ("In-Reply-To", "in_reply_to"),
    ("References", "references"),
]
_TEXT_INPUTS = [c for _, c in _FIELDS] + ["plain", "html"]
_INPUTS = {*_TEXT_INPUTS, "attachments", "embedded", "extra"}


def _text_part(kind: str) -> Column:
    fields = [
        ("Content-Type", F.lit(f"text/{kind}; charset=utf-8")),
        ("Content-Transfer-Encoding", F.col(f"__{kind}_enc")),
    ]
    return F.when(
        F.col(f"__{kind}").isNotNull(), part(fields, encoded_body(F.col(f"__{kind}"), F.col(f"__{kind}_enc")))
    )


def _wrapped(subtype: str, boundary: Column, parts: list[Column], more: Column | None = None) -> Column:
    """A multipart with its own header; ``more`` is an array of further parts."""
    head = field("Content-Type", F.concat(F.lit(f'multipart/{subtype}; boundary="'), boundary, F.lit('"')))
    rest = F.lit("")
    if more is not None:
        rest = F.array_join(
            F.transform(more, lambda p: F.concat(F.lit("--"), boundary, F.lit(CRLF), p, F.lit(CRLF))), ""
        )
    closing = F.concat(F.lit("--"), boundary, F.lit("--" + CRLF))
    opened = [
        F.coalesce(F.concat(F.lit("--"), boundary, F.lit(CRLF), p, F.lit(CRLF)), F.lit("")) for p in parts
    ]
    return F.concat(head, F.lit(CRLF), *opened, rest, closing)


def _related(html: Column, boundary: Column) -> Column:
    objects = F.transform(
        F.coalesce("embedded", F.array()),
        lambda o: part(
            [
                ("Content-Type", o["type"]),
                ("Content-Transfer-Encoding", F.lit("base64")),
                ("Content-ID", F.concat(F.lit("<"), o["id"], F.lit(">"))),
            ],
            codecs.base64_text(o["content"], 76),
        ),
    )
    return F.when(F.size("embedded") > 0, _wrapped("related", boundary, [html], objects)).otherwise(html)


def _file_part(a: Column) -> Column:
    name = F.concat(F.lit('"'), text.quote(a["name"]), F.lit('"'))
    return part(
        [
            ("Content-Type", F.concat(a["type"], F.lit("; name="), name)),
            ("Content-Description", a["description"]),
            ("Content-Transfer-Encoding", F.lit("base64")),
            ("Content-Disposition", F.concat(F.lit("attachment; filename="), name)),
        ],
        codecs.base64_text(a["content"], 76),
    )
