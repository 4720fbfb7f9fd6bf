"""Mailbox state: flags, numbering, folders, sets of messages.

State has the columns ``folder array<string>, num, uid, flags, modseq``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions import codecs, fixed
from postmeter.operators import sliced

# Message numbers per slice; a folder may hold a third of all messages.
NUMBER_WIDTH = 1 << 20


def flag_mask(letters: Column) -> Column:
    """Flag letters of a file name as bits."""
    upper = F.upper(letters)
    bits = [F.when(F.contains(upper, F.lit(c)), b).otherwise(0) for c, b in fixed.FLAG_LETTERS.items()]
    return reduce(lambda a, b: a + b, bits)


def file_id_flags(name: Column) -> Column:
    """``struct(id, flags)`` of a message file name; the separator is the last colon, else the last dash."""
    by_colon, by_dash = r"(?s)^(.*):([^:]*)$", r"(?s)^(.*)-([^-]*)$"
    has_colon, has_dash = F.contains(name, F.lit(":")), F.contains(name, F.lit("-"))
    pick = lambda i: F.when(has_colon, F.regexp_extract(name, by_colon, i)).when(
        has_dash, F.regexp_extract(name, by_dash, i)
    )
    return F.struct(
        F.coalesce(pick(1), name).alias("id"), F.coalesce(flag_mask(pick(2)), F.lit(0)).cast("int").alias("flags")
    )


def flag_letters(flags: Column) -> Column:
    """Bits as the info part of a file name."""
    return F.concat(
        F.lit("2,"),
        *[F.when(flags.bitwiseAND(b) != 0, c).otherwise("") for c, b in fixed.FLAG_LETTERS.items()],
    )


def flag_keywords(flags: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(flags.bitwiseAND(b) != 0, F.lit(k)) for b, k in fixed.FLAG_KEYWORDS])
    )


def keyword_flags(keywords: Column) -> Column:
    lowered = F.transform(keywords, F.lower)
    bits = [
        F.when(F.array_contains(lowered, k.lower()), b).otherwise(0) for b, k in fixed.FLAG_KEYWORDS
    ]
    return reduce(lambda a, b: a + b, bits)


def decode_flags(df: DataFrame, name: str = "file_name") -> DataFrame:
    f = file_id_flags(F.col(name))
    return df.withColumns({"id": f["id"], "flags": f["flags"], "keywords": flag_keywords(f["flags"])})


def encode_flags(df: DataFrame, uid: str = "uid", flags: str = "flags") -> DataFrame:
    """File name; a message that is only recent has no info part."""
    f = F.col(flags)
    info = F.when(f == fixed.FLAG_BITS["RECENT"], F.lit("")).otherwise(F.concat(F.lit(":"), flag_letters(f)))
    return df.withColumn("file_name", F.concat(F.col(uid), info))


def update_flags(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``folder, uid, mode, mask[, seq]`` rows; modes are set, add and remove.

    Several updates of a message are applied in the order of ``seq``, then mode and mask. Each is
    "keep these bits, then set those"; such steps fold into one before the join.
    """
    seq = F.col("seq") if "seq" in updates.columns else F.lit(0)
    m = F.col("mask").cast("int")
    keep = F.when(F.col("mode") == "set", 0).when(F.col("mode") == "remove", F.bitwise_not(m)).otherwise(-1)
    put = F.when(F.col("mode").isin("set", "add"), m).otherwise(0)
    steps = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "mode", m.alias("mask"), keep.alias("k"), put.alias("p"))))
    start = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("p"))
    folded = F.aggregate(
        steps,
        start,
        lambda a, s: F.struct(
            a["k"].bitwiseAND(s["k"]).alias("k"), a["p"].bitwiseAND(s["k"]).bitwiseOR(s["p"]).alias("p")
        ),
    )
    each = updates.groupBy("folder", "uid").agg(folded.alias("__u"))
    new = F.col("flags").bitwiseAND(F.coalesce("__u.k", F.lit(-1))).bitwiseOR(F.coalesce("__u.p", F.lit(0)))
    kind = dict(state.dtypes)["flags"]
    return state.join(each, ["folder", "uid"], "left").withColumn("flags", new.cast(kind)).select(*state.columns)


def delete(state: DataFrame, chosen: Column) -> DataFrame:
    """Mark messages as deleted."""
    bit = F.lit(fixed.FLAG_BITS["DELETED"])
    return state.withColumn("flags", F.when(chosen, F.col("flags").bitwiseOR(bit)).otherwise(F.col("flags")))


def is_deleted(flags: Column) -> Column:
    return flags.bitwiseAND(fixed.FLAG_BITS["DELETED"]) != 0


def expunge(state: DataFrame, width: int = NUMBER_WIDTH) -> tuple[DataFrame, DataFrame]:
    """Drop deleted messages and renumber the rest 1..n per folder; returns (kept, removed)."""
    kept = sliced.row_numbers(
        state.filter(~is_deleted(F.col("flags"))),
        ["folder"], ["num"], sliced.number_slice(F.col("num"), width), "__n",
    )
    kept = kept.withColumn("num", F.col("__n").cast("bigint")).select(*state.columns)
    return kept, state.filter(is_deleted(F.col("flags")))


def append(state: DataFrame, rows: DataFrame, width: int = NUMBER_WIDTH) -> DataFrame:
    """Add ``folder, source, flags, modseq`` rows behind the last number of their folder.

    New ids are hashes of folder and source. Rows are numbered along a hash of the
    source in slices of the hash range, so a busy folder is spread.
    """
    last = state.groupBy("folder").agg(F.max("num").alias("last"))
    placed = rows.withColumn("__h", F.pmod(F.xxhash64("source"), F.lit(1 << 40)))
    numbered = sliced.row_numbers(
        placed, ["folder"], ["__h", "source"], F.floor(F.col("__h") / (1 << 30)), "__n"
    )
    new = numbered.join(last, "folder", "left").select(
        "folder",
        (F.coalesce("last", F.lit(0)) + F.col("__n")).cast("bigint").alias("num"),
        F.sha1(F.concat_ws("/", F.concat_ws("/", "folder"), "source")).alias("uid"),
        "flags",
        "modseq",
    )
    return state.unionByName(new.select(*state.columns))


def copy(state: DataFrame, chosen: DataFrame, dest: Sequence[str], modseq: int) -> DataFrame:
    """Copy messages to a folder with new ids, flags kept."""
    # The folder depends on the row as far as the optimizer knows, so it stays a join key.
    target = F.when(F.col("uid").isNotNull(), F.array(*map(F.lit, dest)))
    rows = chosen.select(
        target.alias("folder"),
        F.concat_ws("/", F.concat_ws("/", "folder"), "uid").alias("source"),
        "flags",
        F.lit(modseq).cast("bigint").alias("modseq"),
    )
    return append(state, rows)


def folder_status(state: DataFrame) -> DataFrame:
    """Counts and high marks per folder."""
    f = F.col("flags")
    return state.groupBy("folder").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(f.bitwiseAND(fixed.FLAG_BITS["SEEN"]) == 0).alias("unseen"),
        F.count_if(f.bitwiseAND(fixed.FLAG_BITS["RECENT"]) != 0).alias("recent"),
        (F.max(F.col("uid").try_cast("bigint")) + 1).alias("next_uid"),
        F.max("modseq").alias("highest_modseq"),
    )


def diff_listing(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("folder", "uid")) -> DataFrame:
    """Events between two listings by id: added, removed, flags."""
    a = old.select(*keys, F.col("flags").alias("old_flags"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col("flags").alias("new_flags"), F.lit(True).alias("__b"))
    event = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(~F.col("old_flags").eqNullSafe(F.col("new_flags")), "flags")
    )
    return (
        a.join(b, list(keys), "full_outer")
        .withColumn("event", event)
        .filter(F.col("event").isNotNull())
        .select(*keys, "event", "old_flags", "new_flags")
    )


def folder_tree(folders: DataFrame) -> DataFrame:
    """Every folder with each of its ancestors present in the listing, and how far apart they are.

    Ancestors are prefixes of the path, at most as many as it has components.
    """
    own = folders.select("folder").distinct()
    prefixes = own.filter(F.size("folder") > 1).select(
        "folder", F.explode(F.sequence(F.lit(1), F.size("folder") - 1)).alias("n")
    )
    pairs = prefixes.select(
        "folder", F.slice("folder", 1, F.col("n")).alias("parent"), (F.size("folder") - F.col("n")).alias("distance")
    )
    return pairs.join(own.select(F.col("folder").alias("parent")), "parent", "left_semi").select(
        "parent", "folder", "distance"
    )


def has_children(folders: DataFrame) -> DataFrame:
    """Folders with the number of their direct and all subfolders."""
    below = folder_tree(folders).groupBy("parent").agg(
        F.count_if(F.col("distance") == 1).alias("direct"), F.count(F.lit(1)).alias("subfolders")
    )
    own = folders.select("folder").distinct()
    return own.join(below.withColumnRenamed("parent", "folder"), "folder", "left").na.fill(0, ["direct", "subfolders"])


def rename_folder(df: DataFrame, old: Sequence[str], new: Sequence[str], col: str = "folder") -> DataFrame:
    """Move a folder and all below it."""
    path = F.col(col)
    n = len(old)
    inside = F.slice(path, 1, n) == F.array(*map(F.lit, old))
    moved = F.concat(F.array(*map(F.lit, new)), F.slice(path, n + 1, F.size(path)))
    return df.withColumn(col, F.when(inside, moved).otherwise(path))


def folder_names(df: DataFrame, col: str = "name") -> DataFrame:
    return df.withColumn("text", codecs.folder_name_text(F.col(col)))


def folder_attributes(df: DataFrame, flags: str = "flags", children_known: bool = True) -> DataFrame:
    """Server flags, in order, to type, child flag and special use; later flags win."""
    lowered = F.transform(F.col(flags), F.lower)
    uses = F.create_map(*[F.lit(x) for kv in fixed.SPECIAL_USES.items() for x in kv])
    special = F.filter(F.transform(lowered, lambda f: uses[f]), lambda u: u.isNotNull())
    child_flags = F.filter(lowered, lambda f: f.isin("\\noinferiors", "\\hasnochildren", "\\haschildren"))
    last_child = F.get(F.reverse(child_flags), F.lit(0))
    closed = F.array_contains(lowered, "\\noselect")
    return df.withColumns(
        {
            "contains_messages": ~closed,
            "no_open": closed,
            "has_children": F.coalesce(last_child == "\\haschildren", F.lit(not children_known)),
            "special_use": F.coalesce(F.get(F.reverse(special), F.lit(0)), F.lit("none")),
        }
    )


def to_ranges(df: DataFrame, keys: Sequence[str], n: str, width: int = NUMBER_WIDTH) -> DataFrame:
    """Numbers to the least list of ranges per key.

    Islands are found inside slices of the number line. Only islands that touch
    the edge of their slice, two per slice at most, go on to be joined up. Inside a slice the
    numbers are sorted once and only ends of islands are kept: no table of numbers is held.
    """
    numbers = df.select(*keys, F.col(n).cast("bigint").alias("n")).filter("n is not null")
    w = Window.partitionBy(*keys, "s").orderBy("n")
    ends = (
        numbers.withColumn("s", F.floor(F.col("n") / width))
        .withColumns({"begins": F.coalesce(F.col("n") > F.lag("n").over(w) + 1, F.lit(True)), "ends": F.coalesce(F.lead("n").over(w) > F.col("n") + 1, F.lit(True))})
        .filter("begins or ends")
    )
    # Behind the begin of an island its end comes next; a lone number is both.
    islands = (
        ends.withColumn("hi", F.when(F.col("ends"), F.col("n")).otherwise(F.lead("n").over(w)))
        .filter("begins")
        .select(*keys, "s", F.col("n").alias("lo"), "hi")
    )
    touches = (F.col("lo") == F.col("s") * width) | (F.col("hi") == F.col("s") * width + width - 1)
    inner = islands.filter(~touches).select(*keys, "lo", "hi")
    across = Window.partitionBy(*keys).orderBy("lo")
    starts = F.coalesce(F.col("lo") != F.lag("hi").over(across) + 1, F.lit(True)).cast("int")
    joined = (
        islands.filter(touches)
        .withColumn("b", starts)
        .withColumn("r", F.sum("b").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "r")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(*keys, "lo", "hi")
    )
    return inner.unionByName(joined)


def uid_ranges(df: DataFrame, keys: Sequence[str], uid: str = "uid", width: int = NUMBER_WIDTH) -> DataFrame:
    """Ranges of uids; a set with a uid that is no number stays a list of single uids."""
    numeric = F.rlike(F.col(uid), F.lit(r"\A[0-9]+\z"))
    plain = df.groupBy(*keys).agg(F.bool_and(numeric).alias("__all"))
    tagged = df.join(plain, list(keys))
    ranged = to_ranges(
        tagged.filter("__all").withColumn("__n", F.col(uid).try_cast("bigint")), keys, "__n", width
    ).select(*keys, F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))
    single = tagged.filter("not __all").select(*keys, F.col(uid).alias("lo"), F.col(uid).alias("hi"))
    return ranged.unionByName(single)


def render_ranges(ranges: DataFrame, keys: Sequence[str], per_line: int = 1000) -> DataFrame:
    """Ranges to ``a:b,c`` texts of at most ``per_line`` ranges each, numbered by ``line``."""
    numbered = sliced.row_numbers(
        ranges, keys, ["lo"], sliced.number_slice(F.col("lo"), NUMBER_WIDTH), "__n"
    )
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(
        F.concat(F.col("lo").cast("string"), F.lit(":"), F.col("hi").cast("string"))
    )
    items = F.sort_array(F.collect_list(F.struct("lo", one.alias("t"))))
    return numbered.groupBy(*keys, F.floor((F.col("__n") - 1) / per_line).alias("line")).agg(
        F.array_join(F.transform(items, lambda x: x["t"]), ",").alias("ranges")
    )


def expand_ranges(df: DataFrame, col: str = "ranges") -> DataFrame:
    """``a:b,c`` texts back to numbers."""
    keep = [c for c in df.columns if c != col]
    one = df.select(*keep, F.explode(F.split(F.col(col), ",")).alias("t"))
    lo = F.regexp_extract("t", r"^([0-9]+)", 1).cast("bigint")
    hi = F.regexp_extract("t", r"([0-9]+)$", 1).cast("bigint")
    return one.select(*keep, F.explode(F.sequence(lo, hi)).alias("n"))


def select_set(state: DataFrame, ranges: DataFrame, n: str = "num", width: int = NUMBER_WIDTH) -> DataFrame:
    """Messages inside any ``folder, lo, hi`` range.

    A message is inside when the largest ``hi`` among ranges that start at or before
    it reaches it: a running maximum over the number line, so neither the ranges nor
    their size matter and nothing is broadcast.
    """
    marks = ranges.select("folder", F.col("lo").alias("__at"), F.lit(0).alias("__m"), F.col("hi").alias("__hi"))
    rows = state.select(
        "folder", F.col(n).alias("__at"), F.lit(1).alias("__m"), F.lit(None).cast("bigint").alias("__hi"),
        F.struct(*state.columns).alias("__row"),
    )
    both = rows.unionByName(marks, allowMissingColumns=True)
    covered = sliced.running_max(
        both, ["folder"], ["__at", "__m"], F.col("__hi"), sliced.number_slice(F.col("__at"), width), "__top"
    )
    return covered.filter((F.col("__m") == 1) & (F.col("__top") >= F.col("__at"))).select("__row.*")


def since_uid(state: DataFrame, uid: int, include_last: bool = False) -> DataFrame:
    """Messages from a uid on; with ``include_last`` the last message of a folder always comes."""
    number = F.col("uid").try_cast("bigint")
    if not include_last:
        return state.filter(number >= uid)
    last = state.groupBy("folder").agg(F.max(number).alias("__last"))
    joined = state.join(last, "folder")
    return joined.filter((number >= uid) | (number == F.col("__last"))).drop("__last")


# Columns behind each attribute group.
FETCH_GROUPS: Mapping[str, Sequence[str]] = {
    "envelope": ("from", "reply_to", "to", "cc", "bcc", "subject", "date", "message_id"),
    "structure": ("structure",),
    "content_info": ("content_type",),
    "flags": ("flags",),
    "size": ("size",),
    "full_header": ("header_text",),
    "uid": ("uid",),
    "importance": ("importance",),
}


def fetch(state: DataFrame, attributes: Sequence[str], headers: Mapping[str, Column] | None = None) -> DataFrame:
    """Project attribute groups and named headers; the full header replaces the envelope.

    Columns that are not asked for are pruned down to the scan.
    """
    wanted = [a for a in attributes if not (a == "envelope" and "full_header" in attributes)]
    cols = [c for a in wanted for c in FETCH_GROUPS[a]]
    if missing := [c for c in cols if c not in state.columns]:
        raise ValueError(f"the state has no columns {missing}")
    extra = [c.alias(name) for name, c in (headers or {}).items()]
    return state.select("folder", "num", *cols, *extra)
