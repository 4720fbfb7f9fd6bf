"""Helpers of the operators: stored tables, connected components, pairs within sorted runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, only a local session gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return str(spark.sparkContext.getCheckpointDir())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The frame written to the shared folder and read again, and a call that removes it.

    Cuts the lineage: a lost executor costs the tasks in hand, not what came before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)

    return spark.read.schema(df.schema).parquet(path), lambda: _delete(spark, path)


def bucketed(df: DataFrame, by: str, count: int) -> tuple[DataFrame, Callable[[], None]]:
    """The frame stored in the shared folder in buckets of ``by``, and a call that removes the table and its files.

    Groups of ``by`` are then read as they lie, pass after pass, without a shuffle.
    """
    spark = df.sparkSession
    count = max(1, min(count, 100_000))
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/llm/{name}"
    df.repartition(count, by).write.bucketBy(count, by).option("path", path).option("compression", "zstd").saveAsTable(name)

    def remove() -> None:
        spark.sql(f"DROP TABLE {name}")
        _delete(spark, path)

    return spark.table(name), remove


#: Texts that a task turns into Python objects at a time.
TEXTS = 1024


def release() -> None:
    """Gives memory back: a worker that is used again keeps what its largest batch took."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def releasing(f: Callable) -> Callable:
    """A function on one group or a pair of groups that gives memory back when it returns."""
    from inspect import signature

    def one(rows):
        try:
            return f(rows)
        finally:
            release()

    def two(rows, others):
        try:
            return f(rows, others)
        finally:
            release()

    return one if len(signature(f).parameters) == 1 else two


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: the smallest node that each linked node reaches.

    Alternates the large star and the small star until the links are stars. Each step is an
    aggregated minimum and an equality join, so a hub is a skewed join that AQE can split; no
    list of neighbours is built. Each round is written to the shared folder.
    """

    def mark(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 32)))).first()
        return row[0], row[1] or 0

    edges, remove = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = mark(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        new, clean = stored(small.filter("a <> b").distinct())
        remove()
        edges, remove, last, seen = new, clean, seen, mark(new)
        if seen == last:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(
                F.col("a").alias("node"), "root"
            ).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shrink(values: np.ndarray, delta: bool = False) -> bytes:
    """Compressed numbers, byte planes apart; sorted ones as differences."""
    if delta:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unshrink(data: bytes, kind: str, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if delta else values


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts in a row, and the offsets of the texts; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pc.fill_null(texts.cast(pa.large_binary()), b"").combine_chunks()
    if not len(whole):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = whole.buffers()
    offsets = np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def run_pairs(sizes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within consecutive runs of the given sizes, about ``most`` at a time."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    after = ends - np.arange(len(ends)) - 1
    total = np.cumsum(after)
    start = 0
    while start < len(after):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        count = after[start:stop]
        if n := int(count.sum()):
            i = np.repeat(np.arange(start, stop), count)
            step = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
            yield i, i + 1 + step
        start = stop


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` indices reaches over the links ``a[k], b[k]``."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def whole_runs(batches: Iterator, key: str) -> Iterator:
    """Arrow tables that never cut a run of equal keys, from batches sorted by key.

    Holds a batch and the run at its end.
    """
    import pyarrow as pa

    kept: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut or (kept and kept[-1].column(key)[-1].as_py() != keys[0]):
            # A change of key within the batch or just before it ends what is kept.
            if kept and not cut:
                yield pa.Table.from_batches(kept)
                kept = [batch]
                continue
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Adds ``name``, a number from 0 without gaps within each value of ``by``.

    ``by`` is an integer of few values. Each task counts its own rows; the counts of tasks are
    summed up per value and joined back, so a value may hold any share of the rows.
    """
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import Window

    def count(batches: Iterator) -> Iterator:
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(by).to_numpy(zero_copy_only=False)
            local = np.empty(len(values), np.int64)
            for v in np.unique(values).tolist():
                at = np.flatnonzero(values == v)
                local[at] = seen.get(v, 0) + np.arange(len(at))
                seen[v] = seen.get(v, 0) + len(at)
            columns = [*batch.columns, pa.array(np.full(len(values), part, np.int64)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_local"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    rows, _ = stored(df.mapInArrow(count, f"{schema}, _part long, _local long"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(by, "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return (
        rows.join(parts.select(by, "_part", "_before"), [by, "_part"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .select(*df.columns, name)
    )
