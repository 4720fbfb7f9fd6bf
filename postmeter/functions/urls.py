"""URL, path, glob and access-log rules as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmeter.functions import fixed
from postmeter.functions.text import bound, trim_blanks

# Characters that url_encode escapes although a style keeps them, per style.
_KEPT = {
    # The server keeps these besides letters and digits.
    "server": "._-$,;~()",
    # The mail library keeps printable ASCII but for reserved and unsafe characters.
    "mail": "!'()*-._",
}
_BUILTIN_KEPT = "*-._"


def percent_decode(text: Column, form: bool = False) -> Column:
    """Decode each valid ``%XX``; in form mode ``+`` is a space. Bad sequences stay as they are."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    if not form:
        safe = F.replace(safe, F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def percent_encode(text: Column, style: str = "server") -> Column:
    """Escape bytes: ``server`` style in lower-case hex, ``mail`` style in upper-case hex."""
    kept = _KEPT[style]
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for ch in kept:
        if ch not in _BUILTIN_KEPT:
            out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    for ch in _BUILTIN_KEPT:
        if ch not in kept:
            out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    if style == "mail":
        return out
    lowered = F.transform(
        F.split(out, "%"),
        lambda s, i: F.when(i == 0, s).otherwise(
            F.concat(F.lower(F.substring(s, 1, 2)), F.substr(s, F.lit(3)))
        ),
    )
    return F.array_join(lowered, "%")


def _variable(data: Column, name: str) -> Column:
    pattern = rf"(?is)(?:^|&){re.escape(name)}=([^&]*)"
    return F.when(F.rlike(data, F.lit(pattern)), percent_decode(F.regexp_extract(data, pattern, 1), form=True))


def query_var(query: Column, body: Column, name: str) -> Column:
    """First value of a variable in the query string, else in the body, else null."""
    return F.coalesce(_variable(query, name), _variable(body, name))


def query_params(query: Column) -> Column:
    """All parameters as a map; a name without value maps to itself, the last duplicate wins."""
    items = F.split(F.coalesce(query, F.lit("")), "&")
    pairs = F.transform(
        items,
        lambda s: F.struct(
            percent_decode(F.regexp_extract(s, r"(?s)^([^=]*)", 1)).alias("key"),
            percent_decode(
                F.when(s.contains("="), F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).otherwise(s)
            ).alias("value"),
        ),
    )
    # Equal keys lie side by side when sorted, the last one at the end.
    numbered = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value")))
    last = bound(
        F.array_sort(numbered),
        lambda s: F.filter(s, lambda p, i: ~F.coalesce(F.get(s, i + 1)["key"] == p["key"], F.lit(False))),
    )
    in_order = F.array_sort(F.transform(last, lambda p: F.struct(p["at"].alias("at"), p["key"].alias("key"), p["value"].alias("value"))))
    entries = F.transform(in_order, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    empty = F.coalesce(query, F.lit("")) == ""
    return F.map_from_entries(F.when(empty, F.slice(entries, 1, 0)).otherwise(entries))


def normalise_path(path: Column) -> Column:
    """After each slash or backslash, drop the slashes, backslashes and ``..`` that follow."""
    return F.regexp_replace(path, r"([/\\])(?:[/\\]|\.\.)+", "$1")


def mime_type(path: Column, extra: dict[str, str] | None = None) -> Column:
    """MIME type by suffix; extra suffixes come first, unknown ones are plain text."""
    lowered = F.lower(path)
    known = F.create_map(*[F.lit(x) for kv in fixed.MIME_TYPES.items() for x in kv])
    suffix = F.regexp_extract(lowered, r"(?s).(\.[^.]*)$", 1)
    out = F.coalesce(known[suffix], F.lit("text/plain"))
    for ext, kind in reversed(list((extra or {}).items())):
        out = F.when(lowered.endswith(ext.lower()), F.lit(kind)).otherwise(out)
    return out


def reason(status: Column) -> Column:
    texts = F.create_map(*[x for k, v in fixed.REASONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(texts[status.cast("int")], F.lit(fixed.DEFAULT_REASON))


def ip_number(ip: Column) -> Column:
    """Dotted address as a number, null when it is not one."""
    octet = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    pattern = "^" + r"\.".join([octet] * 4) + "$"
    parts = [F.regexp_extract(ip, pattern, i).try_cast("bigint") for i in range(1, 5)]
    return ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]


def _glob_alternative(pattern: str) -> str:
    """One glob alternative as a regular expression anchored at the start.

    Stars are greedy and backtrack; a closing star takes the longest run at once.
    """
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "?":
            out += "."
        elif ch == "$":
            return out + r"\z"
        elif ch == "*":
            wide = pattern[i + 1 : i + 2] == "*"
            out += ".*" if wide else "[^/]*"
            i += wide
        else:
            out += re.escape(ch)
        i += 1
    return out


def glob_length(text: Column, pattern: str) -> Column:
    """Length of the match of a glob at the start of the text, or -1.

    Alternatives are tried in order; one that matches nothing passes on to the next.
    """

    def length(alternative: str) -> Column:
        regex = rf"(?is)\A(?:{_glob_alternative(alternative)})"
        return F.when(
            F.rlike(text, F.lit(regex)), F.char_length(F.regexp_extract(text, regex, 0))
        ).otherwise(F.lit(-1))

    first, *others = pattern.split("|", 1)
    if not others:
        return length(first)
    return F.when(length(first) > 0, length(first)).otherwise(glob_length(text, others[0]))


def split_url(url: Column) -> Column:
    """``struct(scheme, username, password, host, port, path, query, error)``."""
    has_scheme = url.contains("://")
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    is_file = scheme == "file"
    authority = F.when(is_file, F.lit("")).otherwise(F.regexp_extract(rest, r"(?s)^([^/]*)", 1))
    after = trim_blanks(F.when(is_file, rest).otherwise(F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)))
    has_user = authority.contains("@")
    user = F.when(has_user, F.regexp_extract(authority, r"(?s)^(.*)@", 1)).otherwise(F.lit(""))
    host_part = F.regexp_extract(authority, r"(?s)([^@]*)$", 1)
    host = trim_blanks(F.regexp_extract(host_part, r"(?s)^([^:]*)", 1))
    port = trim_blanks(F.regexp_extract(host_part, r"(?s)^[^:]*:(.*)$", 1))
    raw_path = F.regexp_extract(after, r"(?s)^([^?]*)", 1)
    path = F.when(raw_path == "/", F.lit("")).otherwise(raw_path)
    query = F.when(after.contains("?"), F.regexp_extract(after, r"(?s)^[^?]*\?(.*)$", 1))
    error = (
        F.when(~has_scheme, "No protocol separator")
        .when(scheme == "", "No protocol specified")
        .when((host == "") & ~is_file, "No host specified")
        .when(F.rlike(port, F.lit(r"[^0-9]")), "Port can only contain digits")
    )
    return F.struct(
        scheme.alias("scheme"),
        percent_decode(F.regexp_extract(user, r"(?s)^([^:]*)", 1)).alias("username"),
        percent_decode(F.regexp_extract(user, r"(?s)^[^:]*:(.*)$", 1)).alias("password"),
        percent_decode(host).alias("host"),
        F.nullif(port.try_cast("int"), F.lit(0)).alias("port"),
        percent_decode(path).alias("path"),
        query.alias("query"),
        error.alias("error"),
    )


# The fields of an access-log line.
LOG_LINE = (
    r'^(\S+) - (\S+) \[([^\]]*)\] "(\S+) (.*) HTTP/([^ "]*)" (-?[0-9]+) (-?[0-9]+) (-|"(?:.*?)") (-|"(?:.*)")$'
)
LOG_FIELDS = ["ip", "user", "date", "method", "uri", "version", "status", "bytes", "referer", "agent"]


def access_log_line(ip, user, date, method, uri, version, status, size, referer, agent) -> Column:
    """Render one line; missing header values become a dash."""

    def header(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("-"))

    def dash(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))

    return F.concat(
        ip, F.lit(" - "), dash(user), F.lit(" ["), F.date_format(date, "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "'), dash(method), F.lit(" "), dash(uri), F.lit(" HTTP/"), version, F.lit('" '),
        status.cast("string"), F.lit(" "), size.cast("string"), F.lit(" "), header(referer), F.lit(" "), header(agent),
    )


_SEP = "\x01"


def access_log_pieces(line: Column) -> Column:
    """The fields of one line in one pass; a line of another form gives an array of another size."""
    in_one = F.split(
        F.regexp_replace(line, LOG_LINE, _SEP.join(f"${i + 1}" for i in range(len(LOG_FIELDS)))), _SEP
    )
    # A line that holds the separator itself is cut group by group.
    each = F.array(*[F.regexp_extract(line, LOG_LINE, i + 1) for i in range(len(LOG_FIELDS))])
    none = F.array().cast("array<string>")
    return F.when(~line.contains(_SEP), in_one).otherwise(F.when(F.rlike(line, F.lit(LOG_LINE)), each).otherwise(none))


def access_log_fields(pieces: Column) -> Column:
    """Typed fields; dashes of user and headers become null."""
    field = {name: F.get(pieces, F.lit(i)) for i, name in enumerate(LOG_FIELDS)}

    def value(c: Column) -> Column:
        return F.when(c != "-", F.substr(c, F.lit(2), F.char_length(c) - 2))

    return F.struct(
        field["ip"].alias("ip"),
        F.nullif(field["user"], F.lit("-")).alias("user"),
        F.try_to_timestamp(field["date"], F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        field["method"].alias("method"),
        field["uri"].alias("uri"),
        field["version"].alias("version"),
        field["status"].try_cast("int").alias("status"),
        field["bytes"].try_cast("bigint").alias("bytes"),
        value(field["referer"]).alias("referer"),
        value(field["agent"]).alias("agent"),
    )


def request_fields(raw: Column) -> Column:
    """Request text to ``struct(method, uri, version, query, headers)``; null when malformed."""
    text = F.regexp_replace(raw, r"\A[ \t\r\n\x0B\f]+", "")
    first = r"\A([^ ]+) +([^ ]+) +HTTP/([^\r\n]*)"
    method = F.regexp_extract(text, first, 1)
    target = F.regexp_extract(text, first, 2)
    lines = F.filter(
        F.split(F.regexp_extract(text, r"(?s)\A[^\r\n]*[\r\n]*(.*?)(?:\r?\n\r?\n.*)?\z", 1), r"[\r\n]+"),
        lambda s: F.rlike(s, F.lit("^[^: ]")),
    )
    headers = F.transform(
        lines,
        lambda s: F.struct(
            F.regexp_extract(s, r"^([^: ]*)", 1).alias("name"),
            F.regexp_extract(s, r"^[^: ]*[: ]*(.*)$", 1).alias("value"),
        ),
    )
    good = method.isin(*fixed.HTTP_METHODS)
    return F.when(
        good,
        F.struct(
            method.alias("method"),
            normalise_path(percent_decode(F.regexp_extract(target, r"^([^?]*)", 1))).alias("uri"),
            F.regexp_extract(text, first, 3).alias("version"),
            F.when(target.contains("?"), F.regexp_extract(target, r"^[^?]*\?(.*)$", 1)).alias("query"),
            headers.alias("headers"),
        ),
    )


def request_header(headers: Column, name: str) -> Column:
    """First header of that name, ignoring case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(hits, F.lit(0))["value"]


def human_size(size: Column, is_dir: Column) -> Column:
    """Size as a listing shows it."""

    def tenth(divisor: int) -> Column:
        # One decimal, ties to the even digit, in whole numbers so that nothing is lost.
        scaled = size.cast("bigint") * 10
        rest = F.pmod(scaled, F.lit(divisor))
        down = ((scaled - rest) / divisor).cast("bigint")
        up = (rest * 2 > divisor) | ((rest * 2 == divisor) & (down % 2 == 1))
        n = down + up.cast("bigint")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    return (
        F.when(is_dir, F.lit("[DIRECTORY]"))
        .when(size < 1024, size.cast("string"))
        .when(size < 0x100000, F.concat(tenth(1024), F.lit("k")))
        .when(size < 0x40000000, F.concat(tenth(1048576), F.lit("M")))
        .otherwise(F.concat(tenth(1073741824), F.lit("G")))
    )


def validator_tag(mtime: Column, size: Column) -> Column:
    """``"<seconds in hex>.<size>"`` with the quotes."""
    return F.concat(F.lit('"'), F.lower(F.hex(mtime)), F.lit("."), size.cast("string"), F.lit('"'))

