"""Transfer and word codecs. Inputs are text (UTF-8) or octet strings; results of decoding are bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter.functions.text import octets_to_bytes

# Names under which each transfer encoding is known.
ENCODING_ALIASES = {
    "base64": "base64",
    "quoted-printable": "quoted-printable",
    "uuencode": "uuencode",
    "7bit": "identity",
    "8bit": "identity",
    "binary": "identity",
    "7-bit": "identity",
    "8-bit": "identity",
    "bmoted-printable": "quoted-printable",
}

_HEX_PAIR = "[0-9A-Fa-f]{2}"


def base64_text(data: Column, wrap: int | None = None) -> Column:
    """Base64 on one line, or in CRLF lines of ``wrap`` characters."""
    flat = F.replace(F.base64(data.cast("binary")), F.lit("\r\n"), F.lit(""))
    if wrap is None:
        return flat
    return F.regexp_replace(flat, f"(.{{{wrap}}})(?=.)", "$1\r\n")


def base64_bytes(text: Column) -> Column:
    """Decode up to the first ``=``; blanks are skipped, a lone last digit is dropped."""
    digits = F.substring_index(text, "=", 1)
    for blank in "\r\n \t":
        digits = F.replace(digits, F.lit(blank), F.lit(""))
    digit = "[A-Za-z0-9+/]"
    return F.unbase64(F.regexp_extract(digits, rf"\A((?:{digit}{{4}})*+(?:{digit}{{2,3}}+)?+)", 1))


def _percent(data: Column) -> Column:
    """Every byte outside ``A-Za-z0-9*-._`` as ``%XX``; blanks too."""
    return F.replace(F.url_encode(data), F.lit("+"), F.lit("%20"))


# Percent escapes of all bytes but printable ASCII and line ends; ``=`` and ``?`` stay escaped as well.
_KEPT_ESCAPES = "%(3D|3F|7F|0[0-9BCEF]|1[0-9A-F]|[89A-F][0-9A-F])"


def quoted_printable(text: Column, wrap: int | None = 74) -> Column:
    """Encode text lines; ``=``, ``?``, tabs, trailing blanks and a leading dot are escaped."""
    # Escapes that stay are taken out of the way of one pass that undoes the others.
    body = F.url_decode(F.regexp_replace(F.url_encode(text), _KEPT_ESCAPES, "=$1"))
    body = F.regexp_replace(body, r" (?=[\r\n]|\z)", "=20")
    body = F.regexp_replace(body, r"(\n|\A)\.", "$1=2E")
    if wrap is None:
        return body
    # A soft break falls once a line has reached its columns, never inside an
    # escape. A dot that a break puts first on a line is escaped and counts three.
    whole = r"(?:(?<==)[0-9A-F]{2}|(?<==[0-9A-F])[0-9A-F])?"
    columns = wrap - 1
    line = rf"(?:\G|(?<=\n))((?:\.[^\r\n]{{{columns - 3}}}|[^.\r\n][^\r\n]{{{columns - 1}}}){whole})"
    body = F.regexp_replace(body, line, "$1=\r\n")
    return F.regexp_replace(body, r"=\r\n\.", "=\r\n=2E")


def quoted_printable_bytes(text: Column, header: bool = False) -> Column:
    """Decode; soft breaks vanish, and in headers ``_`` is a blank."""
    body = F.replace(text, F.lit("_"), F.lit(" ")) if header else text
    body = F.regexp_replace(body, r"=\r?(?:\n|\z)", "")

    def piece(p: Column, i: Column) -> Column:
        # Behind each equals sign: two hex digits, then plain text.
        plain = lambda c: F.hex(F.encode(c, "ISO-8859-1"))
        escaped = F.concat(F.substring(p, 1, 2), plain(F.substr(p, F.lit(3))))
        return (
            F.when(i == 0, plain(p))
            .when(F.rlike(p, F.lit(rf"\A{_HEX_PAIR}")), escaped)
            .otherwise(plain(F.concat(F.lit("="), p)))
        )

    return F.unhex(F.array_join(F.transform(F.split(body, "="), piece), ""))


def word_q(text: Column) -> Column:
    """``Q`` data of a header word: letters, digits and ``!*+-/`` stay, a blank is ``_``."""
    # Characters a word keeps.
    out = _percent(text)
    for ch in "!+/":
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    out = F.replace(F.replace(out, F.lit("."), F.lit("%2E")), F.lit("_"), F.lit("%5F"))
    return F.replace(F.replace(out, F.lit("%20"), F.lit("_")), F.lit("%"), F.lit("="))


@F.pandas_udf(T.BinaryType())
def uudecode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """uuencoded octet strings to bytes; the ``begin`` and ``end`` lines are optional."""
    import binascii

    def one(text: str | None) -> bytes | None:
        if text is None:
            return None
        out = []
        for line in text.replace("\r\n", "\n").split("\n"):
            if line.startswith("begin ") or not line.strip():
                continue
            if line in ("end", "`"):
                break
            size = (ord(line[0]) - 32) & 63
            data = line[: 1 + (size * 4 + 2) // 3].encode("latin-1", "replace")
            out.append(binascii.a2b_uu(data))
        return b"".join(out)

    for part in parts:
        yield part.map(one)


def encoding_name(name: Column) -> Column:
    """Codec behind a Content-Transfer-Encoding value; unknown names give null."""
    known = F.create_map(*[F.lit(x) for kv in ENCODING_ALIASES.items() for x in kv])
    return F.when(F.coalesce(F.btrim(name), F.lit("")) == "", F.lit("identity")).otherwise(known[F.lower(F.btrim(name))])


def transfer_bytes(body: Column, encoding: Column) -> Column:
    """Octet string to bytes by codec name; uuencode is left null here (see ``uudecode``)."""
    return (
        F.when(encoding == "base64", base64_bytes(body))
        .when(encoding == "quoted-printable", quoted_printable_bytes(body))
        .when(encoding == "identity", octets_to_bytes(body))
    )


@F.pandas_udf(T.StringType())
def decode_rare(data: pd.Series, charset: pd.Series) -> pd.Series:
    """Charsets without a native decoder; bad sequences become ``?``, unknown charsets read as UTF-8."""
    import codecs

    def one(raw, name):
        if raw is None or name is None:
            return None
        try:
            codecs.lookup(name)
            text = bytes(raw).decode(name, "replace")
        except LookupError:
            return bytes(raw).decode("utf-8", "replace")
        return text.replace("�", "?")

    return pd.Series([one(r, n) for r, n in zip(data, charset)], dtype="object")


def text_of(data: Column, charset: Column, rare: bool = False) -> Column:
    """Bytes to text by charset. ASCII and UTF-8 are repaired, Latin-1 is exact.

    With ``rare`` other charsets go through Python; otherwise they read as UTF-8.
    """
    name = F.lower(F.coalesce(charset, F.lit("us-ascii")))
    utf8 = F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit("?"))
    latin = F.decode(data, "ISO-8859-1")
    simple = F.when(name.isin("iso-8859-1", "latin1"), latin)
    if not rare:
        return F.coalesce(simple, utf8)
    native = name.isin("us-ascii", "ascii", "utf-8", "utf8", "iso-8859-1", "latin1")
    return F.when(native, F.coalesce(simple, utf8)).otherwise(
        decode_rare(F.when(~native, data), F.when(~native, name))
    )


def folder_name_text(name: Column) -> Column:
    """Modified UTF-7 folder name to text: ``&...-`` runs are UTF-16 in base64 with commas."""
    tokens = F.regexp_extract_all(name, F.lit(r"&[^-]*-?|[^&]+"), F.lit(0))
    decoded = F.transform(
        tokens,
        lambda t: F.when(t == "&-", F.lit("&"))
        .when(
            t.startswith("&"),
            F.decode(
                base64_bytes(F.replace(F.regexp_extract(t, "^&([^-]*)", 1), F.lit(","), F.lit("/"))), "UTF-16BE"
            ),
        )
        .otherwise(t),
    )
    return F.array_join(decoded, "")


def folder_name_encoded(text: Column) -> Column:
    """Text to modified UTF-7."""
    tokens = F.regexp_extract_all(text, F.lit(r"&|[^\x20-\x7E]+|[\x20-\x25\x27-\x7E]+"), F.lit(0))
    encoded = F.transform(
        tokens,
        lambda t: F.when(t == "&", F.lit("&-"))
        .when(
            F.rlike(t, F.lit(r"\A[^\x20-\x7E]")),
            F.concat(
                F.lit("&"),
                F.replace(F.rtrim(base64_text(F.encode(t, "UTF-16BE")), F.lit("=")), F.lit("/"), F.lit(",")),
                F.lit("-"),
            ),
        )
        .otherwise(t),
    )
    return F.array_join(encoded, "")
