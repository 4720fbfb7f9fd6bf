"""Sharding by vector bin packing.

Units are groups of equal texts; only groups that exceed a shard are split. A unit's
vector is its share of bytes, tokens and rows. It goes to the shard where the dot product with
what the shard has room for is highest, large units first. Large units, bounded in number, are
placed in one pass; the others are placed by many tasks at once, each with its share of every
shard's remaining room, so no task sees more than its own units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.shared import numbered, stored

SHARDS = 24
#: A unit above this part of a shard is placed with the large ones, SHARDS * 3 * LARGE at most.
LARGE = 100
#: Parts for each shard that a group would fill, where it exceeds one.
SPLIT = 40
UNITS_PER_TASK = 50_000


def place(units: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each unit (rows of shares), largest first, and the room that is left."""
    room = room.copy()
    shard = np.empty(len(units), np.int32)
    for i in np.argsort(-units.max(axis=1), kind="stable"):
        s = shard[i] = int((room @ units[i]).argmax())
        room[s] -= units[i]
    return shard, room


def shards(df: DataFrame, key: str = "doc_id", text: str = "text", count: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row.

    ``size`` is the UTF-8 bytes of the text plus 8. Equal texts share a shard unless their group
    exceeds one in bytes, tokens or rows; then it is dealt out over many in fortieths. Ties between
    shards go to the lower one, ties between units by the order of their group. An empty table
    gives no rows; other columns are left out, whatever their names. Null texts are a group of their own, apart from empty ones.
    ``slot`` numbers the rows of a shard from 0 without gaps.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows, _ = stored(
        df.select(
            F.monotonically_increasing_id().alias("id"),
            F.col(key).alias("key"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("crc"),
            (F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
            F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b"")).alias("group"),
        )
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    share = [max(1.0, (x or 0) / count) for x in total]
    groups = rows.groupBy("group").agg(F.count("*").alias("n"), F.max("size").alias("s"), F.max("tokens").alias("t"))
    most = F.greatest(F.col("n") * F.col("s") / share[0], F.col("n") * F.col("t") / share[1], F.col("n") / share[2])
    # Fewer than three groups per shard exceed one, as each measure of all shards is shared by all groups.
    split = groups.filter((most > 1) & (F.col("n") > 1)).withColumn("parts", F.ceil(most * SPLIT)).select(
        "group", F.least("parts", "n").cast("int").alias("parts")
    )
    parted = rows.join(split, "group", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    )
    units, _ = stored(
        parted.groupBy("group", "part").agg(
            (F.sum("size") / share[0]).alias("b"), (F.sum("tokens") / share[1]).alias("t"), (F.count("*") / share[2]).alias("r")
        )
    )
    large = F.greatest("b", "t", "r") > 1 / LARGE
    heavy = units.filter(large).orderBy("group", "part").toPandas()
    placed, room = place(heavy[["b", "t", "r"]].to_numpy(float).reshape(-1, 3), np.ones((count, 3)))
    light = units.filter(~large)
    sums = light.agg(F.sum("b"), F.sum("t"), F.sum("r"), F.count("*")).first()
    rest = np.array([x or 1.0 for x in sums[:3]])

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A task holds its own units, about UNITS_PER_TASK.
        own = [p for p in parts if len(p)]
        if own:
            frame = pd.concat(own)
            units = frame[["b", "t", "r"]].to_numpy(float)
            frame["shard"], _ = place(units, room * (units.sum(axis=0) / rest))
            yield frame[["group", "part", "shard"]]

    kind = "group binary, part int, shard int"
    tasks = max(1, math.ceil(sums[3] / UNITS_PER_TASK))
    where = light.repartition(tasks, "group", "part").mapInPandas(deal, kind)
    if len(heavy):
        where = where.union(
            df.sparkSession.createDataFrame(heavy[["group", "part"]].assign(shard=placed), kind)
        )
    sharded = parted.join(where, ["group", "part"]).select("key", "size", "crc", "shard")
    return numbered(sharded, "shard", "slot").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )
