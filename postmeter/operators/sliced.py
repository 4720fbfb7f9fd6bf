"""Ordered windows that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task. If
one key holds a third of the rows that task never ends. The functions here cut
each key into *slices* that follow the order (a time span, a span of numbers),
run the window inside a slice, and carry one small row per slice across the
slices of a key. Results equal those of the plain window; no row is dropped.

``slice_by`` must not decrease along ``order``, so rows that tie in the first
order column must share a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.functions.text import settled

KEY, SLICE = "__key", "__slice"


def time_slice(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def number_slice(n: Column, width: int) -> Column:
    return F.floor(n / width)


def _prepare(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    """Add the key as one struct, which is never null and joins by plain equality.

    Window and join then ask for the same partitioning, so the rows move once.
    """
    return df.withColumns({KEY: F.struct(*keys), SLICE: slice_by})


def _carry(df: DataFrame, summary: Column, fold) -> DataFrame:
    """One row per (key, slice) with ``fold`` of the summaries of all earlier slices."""
    per_slice = df.groupBy(KEY, SLICE).agg(summary.alias("__s"))
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(KEY, SLICE, fold(F.col("__s")).over(before).alias("__carry"))


def _attach(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, [KEY, SLICE], "left")


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    slice_by: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: ``struct(v)`` of the row before this one, null for the first row.

    Only the first row of a slice needs a value from outside: that of the last row of the slice
    before. These edge rows, two a slice at most, go through a window over the key; all others are
    done. Both branches take whole rows, so they read the same exchange and the source once.
    """
    w = Window.partitionBy(KEY, SLICE).orderBy(*order)
    boxed = _prepare(df, keys, slice_by).withColumn("__v", F.struct(value.alias("v")))
    seen = boxed.withColumns({"__p": F.lag("__v").over(w), "__last": F.lead(F.lit(True)).over(w).isNull()})
    first = F.col("__p").isNull()
    across = Window.partitionBy(KEY).orderBy(SLICE, *order)
    edges = seen.filter(first | F.col("__last")).withColumn("__q", F.lag("__v").over(across))
    carried = edges.filter(first).withColumn("__p", F.col("__q")).drop("__q")
    both = seen.filter(~first).unionByName(carried)
    return both.withColumn(name, F.col("__p")).drop("__v", "__p", "__last", KEY, SLICE)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    slice_by: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the newest non-null ``value`` at or before this row.

    The last row of a slice knows what the slice ends with, so nothing is grouped. Both branches take
    whole rows, so they read the same exchange and the source once.
    """
    w = Window.partitionBy(KEY, SLICE).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _prepare(df, keys, slice_by).withColumn("__v", value)
    seen = rows.withColumns(
        {"__p": F.last("__v", ignorenulls=True).over(up_to), "__last": F.lead(F.lit(True)).over(w).isNull()}
    )
    seen = settled(seen, seen.columns)
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.filter("__last").select(KEY, SLICE, F.last("__p", ignorenulls=True).over(before).alias("__carry"))
    out = _attach(seen, carried)
    return out.withColumn(name, F.coalesce("__p", "__carry")).drop("__v", "__p", "__last", "__carry", KEY, SLICE)


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    slice_by: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the largest ``value`` at or before this row."""
    w = Window.partitionBy(KEY, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = _prepare(df, keys, slice_by).withColumn("__v", value)
    carried = _carry(rows, F.max("__v"), F.max)
    out = _attach(rows.withColumn("__p", F.max("__v").over(w)), carried)
    return out.withColumn(name, F.greatest("__p", "__carry")).drop("__v", "__p", "__carry", KEY, SLICE)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str
) -> DataFrame:
    """Add ``name``: 1..n along ``order`` within the key."""
    w = Window.partitionBy(KEY, SLICE).orderBy(*order)
    rows = _prepare(df, keys, slice_by)
    carried = _carry(rows, F.count(F.lit(1)), F.sum)
    out = _attach(rows.withColumn("__p", F.row_number().over(w)), carried)
    return out.withColumn(name, F.col("__p") + F.coalesce("__carry", F.lit(0))).drop(
        "__p", "__carry", KEY, SLICE
    )
