"""Header-field rules as column expressions.

A parsed header is ``array<struct<pos int, name string, value string>>`` on the
message row. Looking a field up is then a filter inside the row: no join, no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter.functions import codecs
from postmeter.functions.text import bound, is_ascii, octets_to_text, trim_blanks, unescape

# Where a header ends, for a text with a line feed put in front: an empty line, or
# a blank line at the top or behind lines that are no fields. A blank line behind a
# field is a fold of that field. Groups are possessive: a header may have any number of lines.
_BAD = r"(?![^\s:]*[ \t]*:)[^\s][^\n]*\n(?:[ \t]+[^\s][^\n]*\n)*+"
HEADER_END = rf"\n(?:\r?\n|{_BAD}[ \t]+\r?\n)|\A\n[ \t]+\r?\n"
_FOLD = r"(?:\r?\n[ \t]+)++"
_FIELD = r"^(?![ \t])[^\s:]*[ \t]*:"


def split_message(text: Column) -> Column:
    """Octet string to ``[head, body]``; the body is missing when no line ends the header.

    The end is looked for once: a split with a limit would go on through the whole body.
    """

    def cut(whole: Column) -> Column:
        parts = lambda end, at: F.array(F.substr(whole, F.lit(1), at - 1), F.substr(whole, at + F.char_length(end)))
        return bound(
            F.regexp_extract(whole, HEADER_END, 0),
            lambda end: F.when(end == "", F.array(whole)).otherwise(
                bound(F.regexp_instr(whole, F.lit(HEADER_END)), lambda at: parts(end, at))
            ),
        )

    return F.when(text.isNotNull(), bound(F.concat(F.lit("\n"), text), cut))


def header_fields(head: Column) -> Column:
    """Unfold, keep the lines that are fields, number them, trim the values."""
    lines = F.filter(
        F.split(F.regexp_replace(head, _FOLD, " "), "\n"), lambda line: F.rlike(line, F.lit(_FIELD))
    )

    def one(line: Column, i: Column) -> Column:
        value = trim_blanks(F.substr(line, F.instr(line, F.lit(":")) + 1))
        return F.struct(
            i.alias("pos"),
            F.rtrim(F.substring_index(line, ":", 1), F.lit(" \t")).alias("name"),
            F.when(is_ascii(value), value).otherwise(octets_to_text(value)).alias("value"),
        )

    return F.transform(lines, one)


def _is_named(name: str) -> str:
    # Names of another length are passed over before their case is looked at.
    return f"h -> char_length(h.name) = {len(name)} and lower(h.name) = '{name.lower()}'"


def header_all(headers: str, name: str) -> Column:
    """All values of a field, in order, from the header column of that name."""
    return F.expr(f"transform(filter({headers}, {_is_named(name)}), h -> h.value)")


def header_first(headers: str, name: str) -> Column:
    return F.expr(f"get(filter({headers}, {_is_named(name)}), 0).value")


# Encoded words -------------------------------------------------------------

_WORD = r"=\?[^?\n]*\?[^?\n]*\?(?:(?!\?=)[^\n])*+\?="
# A text in pieces: encoded words, what stands between them, and equals signs that begin no word.
_TOKEN = rf"{_WORD}|[^=]++|="
_KNOWN_CHARSETS = r"(?i)us-ascii|ascii|utf-8|utf8|iso-8859-1|latin1"
_RARE_WORD = rf"=\?(?!(?:{_KNOWN_CHARSETS})[*?])[^?\n]*\?[BbQq][^?\n]*\?"


def _decode_word(word: Column) -> Column:
    def decode(parts: Column) -> Column:
        charset = F.substring_index(F.get(parts, F.lit(0)), "*", 1)
        kind = F.upper(F.substring(F.get(parts, F.lit(1)), 1, 1))
        data = F.get(parts, F.lit(2))
        raw = F.when(kind == "B", codecs.base64_bytes(data)).when(
            kind == "Q", codecs.quoted_printable_bytes(data, header=True)
        )
        return F.coalesce(codecs.text_of(raw, charset), word)

    return bound(F.split(F.substr(word, F.lit(3), F.char_length(word) - 4), r"\?", 3), decode)


def unfold(text: Column) -> Column:
    return trim_blanks(F.regexp_replace(text, r"\r?\n[ \t\r\n]*", " "))


def decoded(text: Column) -> Column:
    """Decode encoded words; blanks between two of them vanish, other blanks stay.

    Charsets that need Python read as UTF-8 here; ``rare_words`` covers them.
    """
    is_word = lambda t: t.startswith("=?")

    def pieces(tokens: Column) -> Column:
        between = lambda t, i: (
            F.rlike(t, F.lit(r"\A\s+\z")) & is_word(F.get(tokens, F.greatest(i - 1, F.lit(0)))) & F.coalesce(is_word(F.get(tokens, i + 1)), F.lit(False))
        )
        kept = F.filter(tokens, lambda t, i: ~between(t, i))
        return F.array_join(F.transform(kept, lambda t: F.when(is_word(t), _decode_word(t)).otherwise(t)), "")

    flat = unfold(text)
    return F.when(text.contains("=?"), bound(F.regexp_extract_all(flat, F.lit(_TOKEN), F.lit(0)), pieces)).otherwise(flat)


def has_rare_words(text: Column) -> Column:
    return F.rlike(text, F.lit(_RARE_WORD))


@F.pandas_udf(T.StringType())
def rare_words(text: pd.Series) -> pd.Series:
    """Encoded words in any charset Python knows; called only for values that need it."""
    import base64
    import quopri
    import re

    word = re.compile(r"=\?([^?*\n]*)(?:\*[^?\n]*)?\?([^?\n]*)\?((?:(?!\?=)[^\n])*)\?=")
    gap = re.compile(rf"({_WORD})\s+(?={_WORD})")

    def decode(m):
        charset, kind, data = m.groups()
        if kind[:1] in "Bb":
            digits = re.sub(r"\s|=.*", "", data)
            raw = base64.b64decode(digits + "=" * (-len(digits) % 4))
        elif kind[:1] in "Qq":
            raw = quopri.decodestring(data.replace("_", " ").encode("latin-1", "replace"))
        else:
            return m.group(0)
        try:
            return raw.decode(charset, "replace").replace("�", "?")
        except LookupError:
            return raw.decode("utf-8", "replace")

    return text.map(lambda t: t if t is None else word.sub(decode, gap.sub(r"\1", " ".join(t.split()))))


# Parameters ----------------------------------------------------------------

_PARAM = r';\s*([^;=]*?)\s*=\s*("(?:[^"\\]|\\.)*+"?|[^;]*)'


def main_value(value: Column) -> Column:
    """Value before its parameters; it ends at a blank too."""
    return F.regexp_extract(value, r"^\s*([^;\s]*)", 1)


def header_params(value: Column) -> Column:
    """Parameters as a map.

    Quoted values are unescaped, starred sections are joined in order of
    appearance, and a starred parameter replaces a plain one of the same name.
    """
    tokens = F.regexp_extract_all(F.regexp_extract(value, r"(?s)(;.*)$", 1), F.lit(_PARAM), F.lit(0))
    name_of = lambda t: F.regexp_extract(t, _PARAM, 1)
    raw_of = lambda t: F.regexp_extract(t, _PARAM, 2)
    chunks = F.transform(
        tokens,
        lambda t: F.struct(
            F.regexp_replace(name_of(t), r"(?:\*[0-9]*)?\*?$", "").alias("base"),
            F.rlike(name_of(t), F.lit(r"\*$|\*[0-9]*\*?$")).alias("extended"),
            name_of(t).endswith("*").alias("encoded"),
            F.when(
                raw_of(t).startswith('"'),
                unescape(F.regexp_replace(raw_of(t), r'(?s)^"((?:[^"\\]|\\.)*+)"?.*$', "$1")),
            )
            .otherwise(trim_blanks(raw_of(t)))
            .alias("data"),
        ),
    )
    good = F.filter(chunks, lambda c: (c["base"] != "") & (c["data"] != ""))

    def text_of(kept: Column, lead_at: Column) -> Column:
        lead = F.get(kept, lead_at - 1)["data"]
        charset = F.lower(F.regexp_extract(lead, r"^([^']*)'", 1))
        # The first encoded section carries charset'language' in front of its text.
        escaped = F.transform(
            kept,
            lambda c, i: F.when(
                c["encoded"],
                F.regexp_replace(
                    F.when(i + 1 == lead_at, F.regexp_replace(c["data"], r"^[^']*'(?:[^']*')?", "")).otherwise(
                        c["data"]
                    ),
                    r"%(?![0-9A-Fa-f]{2})",
                    "%25",
                ),
            ).otherwise(F.replace(decoded(c["data"]), F.lit("%"), F.lit("%25"))),
        )

        def read(body: Column) -> Column:
            utf8 = F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
            as_qp = F.regexp_replace(F.replace(body, F.lit("="), F.lit("%3D")), r"%([0-9A-Fa-f]{2})", "=$1")
            latin = F.decode(codecs.quoted_printable_bytes(as_qp), "ISO-8859-1")
            return F.when(charset.isin("iso-8859-1", "latin1"), latin).otherwise(utf8)

        return bound(F.array_join(escaped, ""), read)

    def value_of(mine: Column) -> Column:
        first = F.array_position(F.transform(mine, lambda c: c["extended"]), F.lit(True))
        kept = F.when(first > 0, F.slice(mine, first.cast("int"), F.size(mine))).otherwise(F.slice(mine, -1, 1))
        position = lambda k: F.nullif(F.array_position(F.transform(k, lambda c: c["encoded"]), F.lit(True)), F.lit(0)).cast("int")
        return bound(kept, lambda k: bound(position(k), lambda at: text_of(k, at)))

    # Chunks of one name lie side by side when sorted, in their order.
    numbered = F.transform(
        good,
        lambda c, i: F.struct(c["base"].alias("base"), i.alias("at"), c["extended"].alias("extended"), c["encoded"].alias("encoded"), c["data"].alias("data")),
    )

    def groups(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i)["base"] != F.get(ordered, F.greatest(i - 1, F.lit(0)))["base"]))
        return bound(
            begins,
            lambda b: F.transform(
                b, lambda at, j: F.slice(ordered, at + 1, F.coalesce(F.get(b, j + 1), F.size(ordered)) - at)
            ),
        )

    entry = lambda g: F.struct(F.get(g, F.lit(0))["base"].alias("key"), value_of(g).alias("value"))
    return F.map_from_entries(F.transform(bound(F.array_sort(numbered), groups), entry))


def receipt_disposition(value: Column) -> Column:
    """``struct(action_mode, sending_mode, type, modifiers)`` of a receipt: ``action/sending; type/modifier, modifier``."""
    mode = trim_blanks(F.regexp_extract(value, r"^([^;]*)", 1))
    rest = F.regexp_extract(value, r"^[^;]*;(.*)$", 1)
    modifiers = F.filter(
        F.transform(F.split(F.regexp_extract(rest, r"^[^/]*/(.*)$", 1), ","), trim_blanks), lambda m: m != ""
    )
    return F.struct(
        F.regexp_extract(mode, r"^([^/]*)", 1).alias("action_mode"),
        F.regexp_extract(mode, r"^[^/]*/(.*)$", 1).alias("sending_mode"),
        trim_blanks(F.regexp_extract(rest, r"^([^/]*)", 1)).alias("type"),
        modifiers.alias("modifiers"),
    )


def param(value: Column, name: str) -> Column:
    """One plain parameter, by name without case; for structural fields such as a boundary."""
    pattern = rf';\s*(?i:{name})\s*=\s*("(?:[^"\\]|\\.)*+"?|[^;]*)'
    raw = F.regexp_extract(value, pattern, 1)
    text = F.when(
        raw.startswith('"'), unescape(F.regexp_replace(raw, r'(?s)^"((?:[^"\\]|\\.)*+)"?.*$', "$1"))
    ).otherwise(trim_blanks(raw))
    return F.nullif(text, F.lit(""))


# Addresses -----------------------------------------------------------------

_QUOTED = r'"(?:[^"\\]|\\.)*+"'
# Comments within comments that a pattern follows; deeper ones are flattened first.
_COMMENT_DEPTH = 4


def _comment(depth: int) -> str:
    inner = "|" + _comment(depth - 1) if depth > 1 else ""
    return rf"\((?:[^()\\]|\\.{inner})*+\)"


COMMENT = _comment(_COMMENT_DEPTH)
_MARK = "\x02"
# Text in which a comma, colon or semicolon does not separate addresses.
_PROTECTED = rf'{_QUOTED}|{COMMENT}|<[^>]*+>?|=\?(?:(?!\?=).)*+(?:\?=)?|\\.'


def flat_comments(text: Column) -> Column:
    """Comments nested deeper than the patterns follow lose their inner parentheses.

    One scan with a running depth; texts with few parentheses are left as they are.
    """
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){_QUOTED}|\\.|[()]|[^()\\\"]++|.") , F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, token: Column) -> Column:
        depth, out = state["depth"], state["out"]
        opened, closed = token == "(", (token == ")") & (depth > 0)
        level = F.when(opened, depth + 1).otherwise(depth)
        kept = F.when((opened | closed) & (level > _COMMENT_DEPTH), out).otherwise(F.array_append(out, token))
        return F.struct(F.when(closed, depth - 1).otherwise(level).alias("depth"), kept.alias("out"))

    flat = F.aggregate(tokens, start, step, lambda state: F.array_join(state["out"], ""))
    return F.when(F.regexp_count(text, F.lit("[(]")) > _COMMENT_DEPTH, flat).otherwise(text)


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(flat_comments(text), rf"({_QUOTED}|\\.)|{COMMENT}", "$1")


def address_list(text: Column) -> Column:
    """Address list to ``array<struct<group, address>>``; groups are flattened one level."""
    marked = F.regexp_replace(flat_comments(text), rf"(?s)({_PROTECTED})|([,;:])", f"$1{_MARK}$2")

    def clean(s: Column) -> Column:
        return trim_blanks(F.replace(s, F.lit(_MARK), F.lit("")))

    def pieces(s: Column) -> Column:
        return F.split(s, f"{_MARK},")

    def one_run(run: Column) -> Column:
        # Up to the first colon: plain addresses and, last, the name of a group.
        sides = F.split(run, f"{_MARK}:", 2)
        left = pieces(F.get(sides, F.lit(0)))
        grouped = F.size(sides) > 1
        plain = F.when(grouped, F.slice(left, 1, F.size(left) - 1)).otherwise(left)
        name = F.when(grouped, clean(F.element_at(left, -1)))
        members = pieces(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        return F.concat(
            F.transform(plain, lambda a: F.struct(F.lit(None).cast("string").alias("group"), clean(a).alias("address"))),
            F.transform(
                members,
                lambda a: F.struct(
                    name.alias("group"), clean(F.regexp_replace(a, f"(?s)^.*{_MARK}:", "")).alias("address")
                ),
            ),
        )

    runs = F.split(marked, f"{_MARK};(?:{_MARK},)?")
    return F.filter(F.flatten(F.transform(runs, one_run)), lambda a: a["address"] != "")


def mailbox(text: Column) -> Column:
    """``struct(name, address)`` of one mailbox."""
    s = trim_blanks(strip_comments(text))
    quoted = s.startswith('"')
    q_pattern = r'(?s)^"((?:[^"\\]|\\.)*+)"?(.*)$'
    q_name = unescape(F.regexp_extract(s, q_pattern, 1))
    q_rest = F.regexp_extract(s, q_pattern, 2)
    before = F.regexp_extract(s, r"(?s)^((?:[^<@\\]|\\.)*+)", 1)
    after = F.regexp_extract(s, r"(?s)^(?:[^<@\\]|\\.)*+(.*)$", 1)
    name = F.when(quoted, q_name).otherwise(trim_blanks(unescape(before)))
    rest = F.when(quoted, trim_blanks(q_rest)).otherwise(after)
    is_local = F.when(quoted, q_rest.startswith("@")).otherwise(after.startswith("@"))
    bare = F.concat(F.when(quoted, q_name).otherwise(unescape(before)), F.regexp_extract(rest, r"^([^\s]*)", 1))
    inner = F.regexp_extract(rest, r"(?s)^<?([^>]*)", 1)
    # An angle bracket inside the brackets means the address only starts there.
    extra = F.regexp_extract(inner, r"(?s)^(.*)<", 1)
    address = F.regexp_replace(F.regexp_extract(inner, r"(?s)([^<]*)$", 1), r"[ \t\r\n]+", "")
    brackets = rest.contains(">")
    swapped = ~is_local & (address == "") & ~brackets
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(is_local | swapped, F.lit(""))
            .otherwise(decoded(F.concat(name, F.regexp_replace(extra, r"\s+", ""))))
            .alias("name"),
            F.when(is_local, bare).when(swapped, name).otherwise(unescape(address)).alias("address"),
        ),
    )


def address_parts(address: Column, host: Column | str = "localhost") -> Column:
    """``struct(local, domain)``; anything unreadable is ``invalid@invalid``."""
    s = trim_blanks(strip_comments(address))
    pattern = r'(?s)^((?:"(?:[^"\\]|\\["\\])*+"|[^@\s"])(?:(?<=\.)"(?:[^"\\]|\\["\\])*+"|[^@\s])*+)(@?)(\S*)'
    local = F.regexp_replace(F.regexp_extract(s, pattern, 1), r'(?<=^|\.)"((?:[^"\\]|\\.)*+)"', "$1")
    at = F.regexp_extract(s, pattern, 2)
    domain = F.regexp_extract(s, pattern, 3)
    bad = (local == "") | ((at == "@") & (domain == "")) | (F.octet_length(local) + F.octet_length(domain) > 255)
    invalid = F.struct(F.lit("invalid").alias("local"), F.lit("invalid").alias("domain"))
    host_col = host if isinstance(host, Column) else F.lit(host)
    return F.when(
        address.isNotNull(),
        F.when(bad, invalid).otherwise(
            F.struct(
                unescape(local).alias("local"),
                F.when(at == "", host_col).otherwise(domain).alias("domain"),
            )
        ),
    )


# Ids, paths, importance ----------------------------------------------------


def message_id(text: Column) -> Column:
    """``left@right`` of the first angle brackets outside comments, or of the bare token."""
    s = F.regexp_replace(flat_comments(text), rf"(\\.)|{COMMENT}", "$1")
    opened = F.regexp_extract(s, r"(?s)^(?:[^<\\]|\\.)*+<(.*)$", 1)
    has = F.rlike(s, F.lit(r"(?s)^(?:[^<\\]|\\.)*+<."))
    plain = F.regexp_extract(s, r"^\s*(.*)$", 1)
    body = F.when(has, opened).otherwise(plain)
    left = F.regexp_extract(body, r"(?s)^([^@>]*)", 1)
    tail = F.regexp_extract(body, r"(?s)^[^@>]*[@>](.*)$", 1)
    right = F.when(has, F.regexp_extract(tail, r"(?s)^([^>]*)", 1)).otherwise(F.regexp_extract(tail, r"(?s)^([^>\s]*)", 1))
    return F.when(right == "", left).otherwise(F.concat(left, F.lit("@"), right))


def message_ids(text: Column) -> Column:
    """Ids in order, one per run without blanks."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda t: t != "")
    return F.transform(tokens, message_id)


def return_path(text: Column) -> Column:
    """``struct(local, domain)``; without ``@`` all of it is the domain."""
    inner = F.when(
        F.rlike(text, F.lit(r"^\s*<")), trim_blanks(F.regexp_extract(text, r"(?s)^\s*<([^>]*)", 1))
    ).otherwise(text)
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(inner.contains("@"), F.regexp_extract(inner, r"(?s)^([^@]*)@", 1)).otherwise("").alias("local"),
            F.when(inner.contains("@"), F.regexp_extract(inner, r"(?s)^[^@]*@(.*)$", 1)).otherwise(inner).alias("domain"),
        ),
    )


def importance(x_priority: Column, importance: Column) -> Column:
    digit = F.regexp_extract(x_priority, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    by_priority = (
        F.when(digit == 1, "highest")
        .when(digit == 2, "high")
        .when(digit == 4, "low")
        .when(digit == 5, "lowest")
        .otherwise("normal")
    )
    word = F.lower(trim_blanks(importance))
    return (
        F.when(x_priority.isNotNull(), by_priority)
        .when(word == "low", "lowest")
        .when(word == "high", "highest")
        .otherwise("normal")
    )


# Received ------------------------------------------------------------------

_KEYWORDS = ["from", "by", "via", "with", "id", "for"]


def received_date(text: Column) -> Column:
    """Date text of a Received value: what follows its last semicolon."""
    return F.when(text.contains(";"), F.regexp_extract(text, r"(?s);([^;]*)$", 1))


def received(text: Column) -> Column:
    """``struct(from, by, via, with array, id, for, date)`` of one Received value.

    A keyword is a whole word outside comments; words before the first keyword do not count.
    """
    body = F.regexp_extract(text, r"(?s)^(.*);", 1)
    date = F.regexp_extract(text, r"(?s);([^;]*)$", 1)
    flat = F.concat(F.lit(" "), trim_blanks(F.regexp_replace(body, r"\s+", " ")), F.lit(" "))
    # Keywords outside comments get a mark in front; each run then starts with its keyword.
    marked = F.regexp_replace(flat_comments(flat), rf"(?i)({COMMENT})|(?<= )(from|by|via|with|id|for)(?= )", f"$1{_MARK}$2")
    runs = F.filter(
        F.split(marked, f"{_MARK}(?=(?i:from|by|via|with|id|for) )"), lambda r, i: i > 0
    )

    def values(word: str) -> Column:
        mine = F.filter(runs, lambda r: F.lower(F.substring_index(r, " ", 1)) == word)
        return F.transform(
            mine, lambda r: trim_blanks(F.replace(F.substr(r, F.lit(len(word) + 1)), F.lit(_MARK), F.lit("")))
        )

    def last(word: str) -> Column:
        return F.get(F.reverse(values(word)), F.lit(0))

    return F.when(
        text.contains(";"),
        F.struct(
            *[(values(w) if w == "with" else last(w)).alias(w) for w in _KEYWORDS], date.alias("date")
        ),
    )
