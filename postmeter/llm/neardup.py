"""Embedding near-duplicates from randomly rotated binary codes.

A unit vector is rotated at random and kept as the signs of its components, with the inner
product of code and vector as correction factor. Code times rotated vector over the factor is
an unbiased estimate of the cosine, with an error bound; pairs whose upper bound misses the
threshold are dropped, the others are computed anew in double precision.

Candidates come from tables of random hyperplane signs. The number of bits follows the number
of vectors, the number of tables the recall asked for at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.shared import components, roots, run_pairs, stored, whole_runs

#: Rows of a bucket compared in one task; a larger bucket is dealt out as pairs of such blocks.
BLOCK = 2048
#: Standard errors of the estimate within which a pair is recomputed.
SURE = 6.0


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 1) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=8)
def planes(dim: int, bits: int, tables: int, seed: int = 2) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables)).astype(np.float32)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes of the rotated unit vectors, and the correction factors."""
    turned = unit.astype(np.float32) @ rotation(unit.shape[1])
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), factor


def estimate(code: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine of each coded vector with the rotated vector beside it, and its error bound."""
    dim = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    value = np.einsum("ij,ij->i", signs, turned) / math.sqrt(dim) / factor
    rest = np.sqrt(np.maximum(0, 1 - factor**2)) / factor
    return value, SURE * rest / math.sqrt(max(1, dim - 1))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _index(bits: int, tables: int):
    """A row for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.array([len(v) for v in batch.column("v")])
            for dim in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                x = _matrix(part.column("v"))
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                code, factor = encode(unit)
                signs = (unit.astype(np.float32) @ planes(int(dim), bits, tables)).reshape(len(x), tables, bits) > 0
                bands = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("node"), part.column("copies"), part.column("v"),
                            pa.array([c.tobytes() for c in code]), pa.array(factor.astype(np.float32)),
                            pa.array([b.tobytes() for b in bands]), pa.array(np.full(len(x), t, np.int32)),
                            pa.array(bands[:, t] * 65536 + dim % 65536),
                        ],
                        ["node", "copies", "v", "code", "factor", "bands", "t", "bucket"],
                    )

    return run


def _compare(threshold: float, tables: int):
    """Within each block pair: (a, b, n), links as trees with n 0 and numbers of links with a = b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "run"):
            table = table.combine_chunks()
            lengths = np.array([len(v) for v in table.column("v").chunk(0)])
            keys = table.column("run").to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                part = table.take(pa.array(at)).combine_chunks()
                own = keys[at]
                cuts = np.flatnonzero(np.diff(own)) + 1
                sizes = np.diff(np.concatenate([[0], cuts, [len(own)]]))
                if sizes.max() < 2:
                    continue
                get = lambda c, part=part: part.column(c).to_numpy()
                node, copies, t, home, pair = (get(c) for c in ("node", "copies", "t", "home", "pair"))
                x = _matrix(part.column("v").chunk(0))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned = x.astype(np.float32) @ rotation(int(dim))
                flat = lambda c, kind, part=part: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
                code = flat("code", np.uint8).reshape(len(own), -1)
                bands = flat("bands", np.int64).reshape(len(own), tables)
                factor = get("factor")
                links, count = [], np.zeros(len(own), np.int64)
                for i, j in run_pairs(sizes, most=1 << 16):
                    # A pair belongs to its first common table; blocks of a pair meet each other only.
                    keep = (t[i] == t[j]) & ((home[i] != home[j]) | ~pair[i])
                    i, j = i[keep], j[keep]
                    keep = (bands[i] == bands[j]).argmax(axis=1) == t[i]
                    i, j = i[keep], j[keep]
                    value, bound = estimate(code[i], factor[i], turned[j])
                    keep = value + bound >= threshold
                    i, j = i[keep], j[keep]
                    keep = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                    i, j = i[keep], j[keep]
                    count += np.bincount(i, copies[j], len(own)).astype(np.int64)
                    count += np.bincount(j, copies[i], len(own)).astype(np.int64)
                    low, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                    root = roots(len(low), place[: len(i)], place[len(i) :])
                    moved = np.flatnonzero(root != np.arange(len(low)))
                    links.append((low[root[moved]], low[moved]))
                a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([node[a], node[some]])),
                        pa.array(np.concatenate([node[b], node[some]])),
                        pa.array(np.concatenate([np.zeros(len(a), np.int64), count[some]])),
                    ],
                    ["a", "b", "n"],
                )

    return run


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, recall: float = 0.9995
) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    ``n_links`` counts the other rows at the threshold or above, equal vectors included.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing; vectors of different lengths do not either. A row without a key links like any
    other; a component takes the smallest key it has. ``recall`` is what the tables reach for
    pairs at the threshold itself; nearer pairs are found more surely. An empty table gives no rows;
    other columns are left out, whatever their names.
    """
    fine = "size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = df.select(F.col(key), F.col(vector).alias("v")).withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    distinct, _ = stored(
        rows.filter("fine").groupBy("v").agg(F.count("*").alias("copies"), F.min(key).alias("low"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    total = distinct.count()
    bits = min(40, max(8, math.ceil(math.log2(max(2, total)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same))
    index = distinct.select("node", "copies", "v").mapInArrow(
        _index(bits, tables),
        f"node long, copies long, v {dict(rows.dtypes)['v']}, code binary, factor float, bands binary, t int, bucket long",
    )
    # Sizes need the buckets alone; only those above a block are dealt out further.
    large = (
        index.select("t", "bucket").groupBy("t", "bucket").count().filter(F.col("count") > BLOCK)
        .select("t", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    )
    dealt = (
        index.join(large, ["t", "bucket"], "left").na.fill(1, ["parts"])
        .withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumn("run", F.xxhash64("t", "bucket", F.least("home", "other"), F.greatest("home", "other")))
        .withColumn("pair", F.col("home") != F.col("other"))
        .drop("bucket", "parts", "other")
    )
    found, _ = stored(
        dealt.repartition("run").sortWithinPartitions("run").mapInArrow(
            _compare(threshold, tables), "a long, b long, n long"
        )
    )
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    reached = components(found.filter("n = 0").select("a", "b"))
    nodes, _ = stored(
        distinct.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(counts, "node", "left").select("v", "copies", "low", "root", F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    known = nodes.join(lowest, "root").select("v", (F.col("copies") - 1 + F.col("linked")).alias("n_links"), "component_id")
    linked = rows.filter("fine").join(known, "v").select(key, "n_links", "component_id")
    alone = rows.filter("NOT fine").select(key, F.lit(0).cast("long"), F.col(key))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
