"""Access logs, requests, paths and listings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions import dates, urls


def parse_access_log(df: DataFrame, col: str) -> DataFrame:
    """Log lines to columns; lines of another form give no row, see ``access_log_rejects``."""
    keep = [c for c in df.columns if c != col]
    pieces = df.select(*keep, urls.access_log_pieces(F.col(col)).alias("__p"))
    return (
        pieces.filter(F.size("__p") == len(urls.LOG_FIELDS))
        .select(*keep, urls.access_log_fields(F.col("__p")).alias("__l"))
        .select(*keep, "__l.*")
    )


def access_log_reject(line: Column) -> Column:
    """Why a log line is not parsed, or null. The reason names the first part that is missing."""
    quoted = F.rlike(line, F.lit(r'"[^"]* [^"]* HTTP/[^"]*"'))
    return (
        F.when(line.isNull(), "missing")
        .when(F.trim(line) == "", "empty")
        .when(F.size(urls.access_log_pieces(line)) == len(urls.LOG_FIELDS), F.lit(None))
        .when(~F.rlike(line, F.lit(r"\[[^\]]*\]")), "no date")
        .when(~quoted, "no request")
        .otherwise("other form")
    )


def access_log_rejects(df: DataFrame, col: str) -> DataFrame:
    """The lines that ``parse_access_log`` leaves out, with the reason."""
    return df.withColumn("reason", access_log_reject(F.col(col))).filter("reason is not null")


def render_access_log(df: DataFrame, col: str = "line") -> DataFrame:
    """Columns back to log lines."""
    line = urls.access_log_line(*[F.col("ts" if c == "date" else c) for c in urls.LOG_FIELDS])
    used = {"ts" if c == "date" else c for c in urls.LOG_FIELDS}
    return df.select(*[c for c in df.columns if c not in used], line.alias(col))


def parse_requests(df: DataFrame, col: str) -> DataFrame:
    """Request texts to columns; malformed ones give no row, see ``request_rejects``."""
    keep = [c for c in df.columns if c != col]
    return (
        df.select(*keep, urls.request_fields(F.col(col)).alias("__r"))
        .filter(F.col("__r").isNotNull())
        .select(*keep, "__r.*")
    )


def request_reject(raw: Column) -> Column:
    """Why a request is malformed, or null."""
    line = F.regexp_extract(raw, r"\A[ \t\r\n\x0B\f]*([^\r\n]*)", 1)
    return (
        F.when(raw.isNull(), "missing")
        .when(line == "", "empty")
        .when(urls.request_fields(raw).isNotNull(), F.lit(None))
        .when(~F.contains(line, F.lit(" HTTP/")), "no version")
        .otherwise("no target")
    )


def request_rejects(df: DataFrame, col: str) -> DataFrame:
    """The requests that ``parse_requests`` leaves out, with the reason."""
    return df.withColumn("reason", request_reject(F.col(col))).filter("reason is not null")


def query_var(df: DataFrame, name: str, query: str = "query", body: str = "body", out: str = "value") -> DataFrame:
    return df.withColumn(out, urls.query_var(F.col(query), F.col(body), name))


def split_url(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("__u", urls.split_url(F.col(col))).select(*df.columns, "__u.*")


def mime_type(df: DataFrame, path: str, types: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumn("mime_type", urls.mime_type(F.col(path), dict(types or {})))


def reason(df: DataFrame, status: str = "status") -> DataFrame:
    return df.withColumn("reason", urls.reason(F.col(status)))


_RULE = re.compile(r"([+-])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?")


def access_rules(text: str) -> list[tuple[int, str, int, int]] | None:
    """``+net/mask,-net/mask`` settings as (position, flag, net, bits); None if an entry is malformed."""
    rules = []
    for pos, entry in enumerate(text.removesuffix(",").split(",")):
        m = _RULE.match(entry)
        if not m:
            return None
        octets, bits = [int(m.group(i)) for i in range(2, 6)], int(m.group(6) or 32)
        if max(octets) > 255 or bits > 32:
            return None
        net = 0
        for o in octets:
            net = net * 256 + o
        rules.append((pos, m.group(1), net, bits))
    return rules


def ip_access(df: DataFrame, ip: str, rules: str | None) -> DataFrame:
    """Add ``access``: 1 allowed, 0 denied, -1 when the rule text is malformed.

    The last matching rule wins. The rules are a literal map from masked net to position
    and flag; an address is masked once per mask length in use and looked up, in its row.
    An empty list denies all.
    """
    if rules is None:
        return df.withColumn("access", F.lit(1))
    if not rules:
        return df.withColumn("access", F.lit(0))
    parsed = access_rules(rules)
    if parsed is None:
        return df.withColumn("access", F.lit(-1))
    number = urls.ip_number(F.col(ip))
    last = {(bits, net): pos * 2 + (flag == "+") for pos, flag, net, bits in parsed}
    found = []
    for bits in sorted({bits for bits, _ in last}):
        size = 1 << (32 - bits)
        nets = F.create_map(
            *[x for (b, net), rank in last.items() if b == bits for x in (F.lit(net).cast("bigint"), F.lit(rank))]
        )
        found.append(F.try_element_at(nets, (F.floor(F.col("__n") / size) * size).cast("bigint")))
    rank = F.greatest(*found, F.lit(-2)) if len(found) == 1 else F.greatest(*found)
    return (
        df.withColumn("__n", number)
        .withColumn("access", F.coalesce(F.pmod(F.nullif(rank, F.lit(-2)), F.lit(2)), F.lit(0)).cast("int"))
        .drop("__n")
    )


def glob_match(df: DataFrame, col: str, pattern: str, out: str = "match_length") -> DataFrame:
    return df.withColumn(out, urls.glob_length(F.col(col), pattern))


def rewrite_paths(
    df: DataFrame, path: str, rules: Sequence[tuple[str, str]], root: str, out: str = "target"
) -> DataFrame:
    """The first rule that matches something replaces what it matched; else the path goes under the root."""
    p = F.col(path)
    target: Column = F.concat(F.lit(root), p)
    for pattern, replacement in reversed(rules):
        length = urls.glob_length(p, pattern)
        target = F.when(length > 0, F.concat(F.lit(replacement), F.substr(p, length + 1))).otherwise(target)
    return df.withColumn(out, target)


def listing(df: DataFrame, key: str = "name", desc: bool = False) -> DataFrame:
    """Directories first, then by name, size or date; sizes in readable form."""
    column = {"name": "name", "size": "size", "date": "mtime"}[key]
    order = F.desc(column) if desc else F.asc(column)
    return df.withColumn("shown_size", urls.human_size(F.col("size"), F.col("is_dir"))).orderBy(
        F.desc("is_dir"), order
    )


def unchanged(new: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``unchanged``: same tag as before, or not newer than the date kept from the last copy.

    ``new`` has ``path, mtime, size``; ``seen`` has ``path, tag, since`` (web date text).
    """
    tag = urls.validator_tag(F.col("mtime"), F.col("size"))
    known = seen.select("path", F.col("tag").alias("__tag"), F.col("since").alias("__since"))
    same = (F.lower("__tag") == tag) | (F.col("__since").isNotNull() & (F.col("mtime") <= dates.http_date(F.col("__since"))))
    return (
        new.join(known, "path", "left")
        .withColumn("tag", tag)
        .withColumn("unchanged", F.coalesce(same, F.lit(False)))
        .drop("__tag", "__since")
    )


def top_paths(counts: DataFrame, k: int, day: str = "day", n: str = "requests") -> DataFrame:
    """The ``k`` busiest paths per day; ties go by path. The limit is applied before the shuffle."""
    w = Window.partitionBy(day).orderBy(F.desc(n), "path")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
