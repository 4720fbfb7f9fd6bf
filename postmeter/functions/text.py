"""Text and octet rules shared by the mail and web operators.

Raw mail is handled as an *octet string*: each byte of the message is one
character in the range U+0000..U+00FF. Regular expressions then see bytes, sizes
are byte sizes, and nothing is lost when a message is not valid UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n"

# Size from which a text is sent as base64 without inspection, and
# the longest line that a 7-bit body may have.
LINE_LIMIT = 78


def lit_or_col(value: Column | str | None) -> Column:
    """Columns pass through, everything else becomes a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def settled(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same rows with these columns computed, once each.

    The optimizer puts the expressions of a column back into every filter, join key and projection
    behind it, so that a parse runs again for each of them and plans grow. It does not look through a
    generator; the outer form keeps it from testing for empty arrays below.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline_outer(F.array(F.struct(*cols)))).select(*df.columns)


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def octets(raw: Column) -> Column:
    """Bytes (or a string's UTF-8 bytes) as an octet string."""
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def octets_to_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def octets_to_text(text: Column) -> Column:
    """Octet string read as UTF-8; bad sequences are replaced."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


def ascii_chars(text: Column) -> Column:
    """Characters up to U+007F."""
    return F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))


def counted_ascii(text: Column) -> Column:
    """ASCII characters, not counting an ``=`` that precedes ``?`` or ends the text."""
    return ascii_chars(text) - F.regexp_count(text, F.lit(r"=(?:(?=\?)|\z)"))


def is_7bit(text: Column) -> Column:
    return counted_ascii(text) == F.octet_length(text)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def needs_quoting(text: Column, specials: str) -> Column:
    return F.translate(text, specials, "") != text


def quote(text: Column, specials: str = '"\\', escape: str = "\\") -> Column:
    """Put ``escape`` before each of the special characters."""
    out = text
    for ch in sorted(set(specials), key=lambda c: c != escape):
        out = F.replace(out, F.lit(ch), F.lit(escape + ch))
    return out


def unquote(text: Column) -> Column:
    """Strip one pair of double quotes and the backslash escapes inside."""
    inner = F.substr(text, F.lit(2), F.char_length(text) - 2)
    quoted = (F.char_length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"'))
    return F.when(quoted, unescape(inner)).otherwise(text)


def unescape(text: Column) -> Column:
    """Drop each backslash and keep the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.?)", "$1")


def charset_encoding(charset: Column) -> Column:
    """Encoding forced by a charset family, else null."""
    name = F.lower(charset)
    # Single-byte Latin families use quoted-printable, the
    # escape-switched families use base64.
    return (
        F.when(name.contains("iso-8859") | name.contains("iso8859"), F.lit("quoted-printable"))
        .when(name.contains("iso-2022") | name.contains("iso2022"), F.lit("base64"))
    )


def choose_encoding(
    text: Column, charset: Column | str | None = "utf-8", inspect_below: int | None = None
) -> Column:
    """Transfer encoding for a text body; works on UTF-8 strings and octet strings of ASCII.

    The whole text is looked at; with ``inspect_below`` texts of that size or more are base64 unseen.
    """
    size = F.octet_length(text)
    # Bytes below 127: ASCII without DEL.
    low = F.char_length(F.regexp_replace(text, r"[^\x00-\x7E]+", ""))
    high = size - low
    long_line = F.rlike(text, F.lit(r"(?:\A|\n)[^\n]{%d}" % (LINE_LIMIT + 1))) | text.contains("\n.")
    by_content = (
        F.when((size == 0) | (size >= inspect_below if inspect_below else F.lit(False)), F.lit("base64"))
        .when(high == 0, F.when(long_line, F.lit("quoted-printable")).otherwise(F.lit("7bit")))
        .when(high <= F.floor(size / 5), F.lit("quoted-printable"))
        .otherwise(F.lit("base64"))
    )
    return F.coalesce(charset_encoding(lit_or_col(charset)), by_content)


def word_needs_encoding(text: Column, charset: Column | str | None = "utf-8", lang: Column | str | None = None) -> Column:
    return (
        charset_encoding(lit_or_col(charset)).isNotNull()
        | ~is_ascii(text)
        | F.rlike(text, F.lit(r"[\r\n]|=\?|\?="))
        | (F.coalesce(lit_or_col(lang), F.lit("")) != "")
    )


def choose_word_encoding(text: Column, charset: Column | str | None = "utf-8") -> Column:
    """``B`` or ``Q`` for a header word."""
    size = F.octet_length(text)
    percent = F.when(size == 0, F.lit(100)).otherwise(F.floor(counted_ascii(text) * 100 / size))
    forced = charset_encoding(lit_or_col(charset))
    return (
        F.when(forced == "quoted-printable", F.lit("Q"))
        .when(forced.isNotNull(), F.lit("B"))
        .when(percent < 60, F.lit("B"))
        .otherwise(F.lit("Q"))
    )


def to_crlf(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n|\r|\n", "\r\n")


def to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def stuff_dots(text: Column) -> Column:
    """Double a dot that starts a line after the first; a first line of one dot is doubled too."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\.", "\n.."), r"\A\.(?=[\r\n])", "..")


def unstuff_dots(text: Column) -> Column:
    return F.replace(text, F.lit("\n.."), F.lit("\n."))


def utf8_valid(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def utf8_repaired(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))


def has_bom(data: Column) -> Column:
    return F.hex(F.substring(data.cast("binary"), 1, 3)) == "EFBBBF"
