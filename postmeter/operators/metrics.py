"""Fleet metrics: union, filter, change-only history, batches, delivery, health.

Long-form metrics have the columns ``node, metric, ts, id, value``; reports add
``type``. ``(ts, id)`` is the order of samples and ``id`` breaks ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions import fixed
from postmeter.operators import sliced

# Width of a time slice. One node may produce a third of all samples, so a slice
# has to stay small enough for one task at the busiest node.
SLICE_SECONDS = 6 * 3600


def collect_metrics(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Bag union of metric tables, each with its type code, keeping the order of the parts."""
    tagged = [
        df.withColumn("type", F.lit(code).cast("tinyint")).withColumn("part", F.lit(i))
        for i, (df, code) in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, tagged)


def like_any(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose name matches a LIKE pattern, ignoring case; no pattern keeps all rows."""
    if not patterns:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.col(col).ilike(p) for p in patterns]))


def plugin_metrics(df: DataFrame) -> DataFrame:
    """``name, version, used`` rows to a version row and a usage row each."""
    version = F.concat_ws(
        ".",
        F.shiftright(F.col("version"), 8).cast("string"),
        F.col("version").bitwiseAND(255).cast("string"),
    )
    rows = F.array(
        F.struct(F.concat("name", F.lit(" version")).alias("metric"), version.alias("value")),
        F.struct(
            F.concat("name", F.lit(" used")).alias("metric"),
            F.col("used").cast("string").alias("value"),
        ),
    )
    keep = [c for c in df.columns if c not in ("name", "version", "used")]
    return df.select(*keep, F.inline(rows)).withColumn("type", F.lit(fixed.TYPE_PLUGIN).cast("tinyint"))


def host_metrics(df: DataFrame) -> DataFrame:
    """Wide host table to fact rows; facts that are not known give no row."""
    facts = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(col).cast("string").alias("value"))
            for col, name in fixed.HOST_FACTS
            if col in df.columns
        ]
    )
    keep = [c for c in df.columns if c not in dict(fixed.HOST_FACTS)]
    return (
        df.select(*keep, F.inline(facts))
        .filter(F.col("value").isNotNull())
        .withColumn("type", F.lit(fixed.TYPE_HOST).cast("tinyint"))
    )


def distribution(files: DataFrame) -> DataFrame:
    """Release files ``host, path, content`` to one distribution text per host.

    An LSB file with a description wins; then the four file masks in order.
    """
    name = F.regexp_extract("path", r"^/etc/([^/]+)$", 1)
    description = F.regexp_extract("content", r"DISTRIB_DESCRIPTION=([^\n]*)", 1)
    unquoted = F.regexp_replace(description, r'^"(.*)"$', "$1")
    is_lsb = (F.col("path") == "/etc/lsb-release") & F.col("content").contains("DISTRIB_DESCRIPTION=")
    rank = (
        F.when(is_lsb, 0)
        .when(name.endswith("-version"), 1)
        .when(name.endswith("-release"), 2)
        .when(name.endswith("_version"), 3)
        .when(name.endswith("_release"), 4)
    )
    stem = F.regexp_replace(name, r"[-_](version|release)$", "")
    first_line = F.regexp_extract("content", r"\A([^\n]*)", 1)
    text = F.when(is_lsb, F.concat(F.lit("lsb: "), unquoted)).otherwise(
        F.concat(stem, F.lit(": "), first_line)
    )
    return (
        files.select("host", rank.alias("r"), "path", text.alias("t"))
        .filter(F.col("r").isNotNull())
        .groupBy("host")
        .agg(F.min_by("t", F.struct("r", "path")).alias("distribution"))
    )


def latest_values(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and metric, so that a later collect is bounded by the metric names."""
    return df.groupBy(*keys, "metric").agg(
        F.max_by("value", F.struct("ts", "id")).alias("value"),
        F.max_by("type", F.struct("ts", "id")).alias("type"),
    )


def metrics_json(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON document per key from its host rows, entries ordered by name.

    ``report`` holds one row per key and metric (see ``latest_values``).
    """
    entry = F.struct(F.col("metric").alias("name"), F.col("value").alias("value"))
    entries = F.sort_array(F.collect_list(F.when(F.col("type") == fixed.TYPE_HOST, entry)))
    return report.groupBy(*keys).agg(
        F.to_json(F.struct(entries.alias("information"))).alias("document")
    )


def metrics_tsv(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``name<TAB>value`` lines per key, ordered by name, closed by an empty line; a null value is empty."""
    line = F.concat("metric", F.lit("\t"), F.coalesce("value", F.lit("")), F.lit("\n"))
    lines = F.sort_array(F.collect_list(F.struct("metric", line.alias("line"))))
    return report.groupBy(*keys).agg(
        F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit("\n")).alias(
            "document"
        )
    )


def health(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replication and cluster flags, with the status code each is served as."""

    def seen(name: str, value: str) -> Column:
        return F.coalesce(
            F.max((F.col("metric") == name) & (F.col("value") == value)), F.lit(False)
        )

    return report.groupBy(*keys).agg(
        seen("SLAVE_RUNNING", "ON").alias("replication_up"),
        (seen("WSREP_ON", "ON") & seen("WSREP_LOCAL_STATE", "4")).alias("cluster_up"),
    ).select(
        *keys,
        "replication_up",
        "cluster_up",
        F.when(F.col("replication_up"), 200).otherwise(503).alias("replication_status"),
        F.when(F.col("cluster_up"), 200).otherwise(503).alias("cluster_status"),
    )


def to_snapshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to one name→value map per key; the newest value of a name stays.

    A row without a name is no entry of the map.
    """
    newest = df.filter(F.col("metric").isNotNull()).groupBy(*keys, "metric").agg(
        F.max_by("value", F.struct("ts", "id")).alias("value")
    )
    return newest.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("snapshot")
    )


def from_snapshot(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c != "snapshot"]
    return df.select(*keep, F.explode("snapshot").alias("metric", "value"))


def changes_only(
    df: DataFrame,
    keys: Sequence[str] = ("node", "metric"),
    ts: str = "ts",
    tiebreak: str = "id",
    value: str = "value",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Samples that differ from the one before them in their series; first samples stay."""
    seen = sliced.previous(
        df, keys, [ts, tiebreak], F.col(value), sliced.time_slice(F.col(ts), slice_seconds), "__prev"
    )
    same = F.col("__prev").isNotNull() & F.col("__prev.v").eqNullSafe(F.col(value))
    return seen.filter(~same).drop("__prev")


def fill_forward(
    changes: DataFrame,
    ticks: DataFrame,
    keys: Sequence[str] = ("node", "metric"),
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Value of each series at each tick, from its change-only rows.

    ``ticks`` holds the series keys and ``ts``; a change at a tick's instant counts.
    """
    marks = changes.select(*keys, "ts", F.lit(0).alias("mark"), "id", F.struct("value").alias("v"))
    wanted = ticks.select(
        *keys, "ts", F.lit(1).alias("mark"), F.lit(None).cast("bigint").alias("id"),
        F.lit(None).cast("struct<value:string>").alias("v"),
    )
    filled = sliced.last_known(
        marks.unionByName(wanted),
        keys,
        ["ts", "mark", "id"],
        F.col("v"),
        sliced.time_slice(F.col("ts"), slice_seconds),
        "known",
    )
    return filled.filter("mark = 1 and known is not null").select(
        *keys, "ts", F.col("known.value").alias("value")
    )


#: Ranks up to which Spark limits the rows of a window before the shuffle.
_LIMITED = 1000


def recent(
    df: DataFrame, n: int = 10, keys: Sequence[str] = ("node",), tick: str = "ts", slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Rows of the last ``n`` ticks per node.

    Up to a thousand ticks the limit is applied before the shuffle. Beyond, the different ticks are
    numbered in slices, and the rows are filtered by the oldest tick of their node.
    """
    if n <= _LIMITED:
        rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(tick)))
        return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
    is_time = dict(df.dtypes)[tick].startswith("timestamp")
    back = -(F.unix_micros(F.col(tick).cast("timestamp")) if is_time else F.col(tick))
    width = slice_seconds * 1_000_000 if is_time else slice_seconds
    ticks = df.filter(F.col(tick).isNotNull()).select(*keys, back.alias("__back")).distinct()
    numbered = sliced.row_numbers(ticks, keys, ["__back"], F.floor(F.col("__back") / width), "__n")
    oldest = numbered.filter(F.col("__n") <= n).groupBy(F.struct(*keys).alias("__k")).agg(F.max("__back").alias("__oldest"))
    kept = df.withColumns({"__k": F.struct(*keys), "__back": back}).join(oldest, "__k")
    return kept.filter(F.col("__back") <= F.col("__oldest")).select(*df.columns)


def assign_batch(ticks: DataFrame, n: int = 10, width: int = 1024) -> DataFrame:
    """Batch number of each distinct ``(node, tick)``; the first closed batch is number 2."""
    distinct = ticks.select("node", "tick").distinct()
    ranked = sliced.row_numbers(
        distinct, ["node"], ["tick"], sliced.number_slice(F.col("tick"), width), "rank"
    )
    return ranked.select(
        "node", "tick", (F.floor((F.col("rank") - 1) / n) + 2).cast("bigint").alias("batch")
    )


def schedule(
    every: Mapping[str, int] | None = None, switches: Mapping[str, bool] | None = None
) -> list[tuple[str, str, int, bool]]:
    """The report sections as ``(section, suffix, every, enabled)`` settings."""
    every, switches = every or {}, switches or {}
    return [
        (name, suffix, every.get(name, n), switches.get(switch, True))
        for name, suffix, n, switch in fixed.SECTIONS
    ]


def due_sections(
    batches: DataFrame, sections: Sequence[tuple[str, str, int, bool]] | None = None
) -> DataFrame:
    """Sections to send with each batch. The settings are literals, so nothing is joined."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("section"),
                F.lit(suffix).alias("suffix"),
                F.lit(every).alias("every"),
                F.lit(enabled).alias("enabled"),
            )
            for name, suffix, every, enabled in (sections or schedule())
        ]
    )
    due = (F.col("batch") % F.col("every") == 0) & F.col("enabled")
    return (
        batches.select(*batches.columns, F.inline(rows))
        .filter((F.col("section") == "history") | due)
        .select(*batches.columns, "section", "suffix")
    )


def content_name(node: Column, suffix: Column) -> Column:
    return F.when(suffix == "history", F.concat(F.lit("/history_"), node)).otherwise(
        F.concat(F.lit("/template_"), node, F.lit("_"), suffix)
    )


def delivery_plan(due: DataFrame, sinks: Sequence[str], contents: DataFrame) -> DataFrame:
    """Each due section of each node for each sink, where its content exists.

    The content is looked up before the sinks, a list of settings, multiply the rows.
    """
    named = due.withColumn("name", content_name(F.col("node"), F.col("suffix")))
    found = named.join(contents, "name")
    return found.select(*found.columns, F.explode(F.array(*map(F.lit, sinks))).alias("sink"))


def lookup_content(requests: DataFrame, contents: DataFrame) -> DataFrame:
    """Content for each request; an empty name asks for the index, a miss gets the help row."""
    name = F.when(F.col("uri") == "", F.lit("index.html")).otherwise(F.col("uri"))
    found = contents.select(
        F.col("name").alias("__name"), "content", "content_type", F.lit(True).alias("__hit")
    )
    joined = requests.withColumn("name", name).join(found, F.col("name") == F.col("__name"), "left")
    return joined.select(
        *requests.columns,
        "name",
        F.coalesce("content", F.lit("help")).alias("content"),
        F.coalesce("content_type", F.lit("text/html")).alias("content_type"),
        F.col("__hit").isNotNull().alias("found"),
    )


#: Why a sample belongs to no interval.
RESAMPLE_REJECTS = ("unknown_kind", "no_time")


def resample_reject(cadence: Mapping[str, int], kind: str = "kind") -> Column:
    """Why a sample belongs to no interval, or null."""
    known = F.coalesce(F.col(kind).isin(list(cadence)), F.lit(False))
    return F.when(~known, "unknown_kind").when(F.col("ts").isNull(), "no_time")


def resample(df: DataFrame, cadence: Mapping[str, int], kind: str = "kind") -> DataFrame:
    """Last sample of each series per sampling interval of its kind; see ``resample_rejects`` for the rest."""
    every = F.create_map(*[F.lit(x) for pair in cadence.items() for x in pair])[F.col(kind)].cast("bigint")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (every * 1_000_000)) * every
    return (
        df.filter(resample_reject(cadence, kind).isNull())
        .withColumn("bucket", bucket)
        .groupBy("node", "metric", kind, "bucket")
        .agg(
            F.max_by("value", F.struct("ts", "id")).alias("value"),
            F.count(F.lit(1)).alias("samples"),
        )
    )


def resample_rejects(df: DataFrame, cadence: Mapping[str, int], kind: str = "kind") -> DataFrame:
    """The samples that ``resample`` leaves out, with the reason."""
    return df.withColumn("reason", resample_reject(cadence, kind)).filter("reason is not null")


def server_uid(df: DataFrame, port: str = "port", mac: str = "mac") -> DataFrame:
    """base64(sha1(port, two bytes, low first, then the six address bytes))."""
    low = F.lpad(F.hex(F.col(port).bitwiseAND(255).cast("bigint")), 2, "0")
    high = F.lpad(F.hex(F.shiftright(port, 8).bitwiseAND(255).cast("bigint")), 2, "0")
    address = F.regexp_replace(mac, "[^0-9A-Fa-f]", "")
    digest = F.unhex(F.sha1(F.unhex(F.concat(low, high, address))))
    return df.withColumn("server_uid", F.base64(digest))


def anonymise(df: DataFrame, cols: Sequence[str], salt: Column | str) -> tuple[DataFrame, DataFrame]:
    """Replace columns by salted SHA-256 and return the hash→text dictionary apart."""
    salt_col = salt if isinstance(salt, Column) else F.lit(salt)

    def hashed(c: str) -> Column:
        return F.sha2(F.concat(salt_col, F.col(c).cast("string")), 256)

    out = df.withColumns({c: hashed(c) for c in cols})
    pairs = F.array(
        *[F.struct(hashed(c).alias("hash"), F.col(c).cast("string").alias("clear")) for c in cols]
    )
    dictionary = df.select(F.inline(pairs)).filter("clear is not null").distinct()
    return out, dictionary


def encrypt(df: DataFrame, col: str, key: Column | str) -> DataFrame:
    """AES (GCM) under the SHA-256 of the key text, as base64."""
    k = F.unhex(F.sha2(key if isinstance(key, Column) else F.lit(key), 256))
    return df.withColumn(col, F.base64(F.aes_encrypt(F.col(col), k)))


def decrypt(df: DataFrame, col: str, key: Column | str) -> DataFrame:
    k = F.unhex(F.sha2(key if isinstance(key, Column) else F.lit(key), 256))
    return df.withColumn(col, F.try_aes_decrypt(F.unbase64(col), k).cast("string"))


def reply_text(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """Text of the first ``<h1>`` pair, else null; with ``limit`` only that many bytes are read."""
    raw = F.col(col).cast("binary")
    head = F.decode(F.substring(raw, 1, limit) if limit else raw, "ISO-8859-1")
    found = F.regexp_extract(head, r"(?s)<h1>(.*?)</h1>", 1)
    text = F.make_valid_utf8(F.encode(found, "ISO-8859-1").cast("string"))
    return df.withColumn("reply", F.when(F.rlike(head, F.lit(r"(?s)<h1>.*?</h1>")), text))


def by_group(df: DataFrame, tags: DataFrame, measures: Sequence[Column]) -> DataFrame:
    """Tag rows by node and roll up per node, per group and in total."""
    return df.join(tags, "node", "left").rollup("group", "node").agg(
        F.grouping_id().alias("level"), *measures
    )


def alerts(
    states: DataFrame, contacts: DataFrame, flag: str, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Ticks where a node's flag turned from up to down, with whom to notify."""
    before = sliced.previous(
        states, ["node"], ["ts"], F.col(flag), sliced.time_slice(F.col("ts"), slice_seconds), "__prev"
    )
    down = before.filter(F.col("__prev.v") & ~F.col(flag)).drop("__prev")
    return down.join(contacts, "node", "left")
