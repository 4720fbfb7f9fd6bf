"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three
bits, one half differs in at most one, so the halves share a variant in which one bit is a
wildcard. Each distinct fingerprint is indexed under its 64 variants; those that meet under a
variant are compared. A meeting of many is cut again by the variants of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.shared import TEXTS, components, release, roots, run_pairs, stored, whole_runs

BITS = 3
#: Beyond this many fingerprints under one variant, the variants of the other half are used too.
CUT_AGAIN = 2048

_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 (seed 42) of the 3-word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < 3:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:], strict=False)]
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    if len(raw) < 256:
        ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(raw[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long; a null or empty text has fingerprint zero."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found: list[int] = []
            for at in range(0, len(batch), TEXTS):
                values = map(fingerprint, batch.slice(at, TEXTS).to_pylist())
                found += [v - (1 << 64 if v >> 63 else 0) for v in values]
            yield pa.array(found, pa.int64())
        release()

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(of, "long")(F.coalesce(F.col(text), F.lit(""))))


def _linked(fps: np.ndarray, sizes: np.ndarray, again: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of fingerprints that link within runs of the given sizes, as trees."""
    large = sizes > CUT_AGAIN
    ends = np.cumsum(sizes)
    if again and large.any():
        for start, end in zip((ends - sizes)[large], ends[large], strict=True):
            own = fps[start:end]
            # The half that the run shares has two values at most; the other one is cut.
            halves = [own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)]
            other = max(halves, key=lambda h: len(np.unique(h)))
            for quarter in range(2):
                part = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
                for bit in range(16):
                    masked = part & ~np.uint64(1 << bit)
                    order = np.argsort(masked, kind="stable")
                    counts = np.unique(masked, return_counts=True)[1]
                    for i, j in _linked(own[order], counts, again=False):
                        yield start + order[i], start + order[j]
        keep = np.repeat(~large, sizes)
        at = np.flatnonzero(keep)
        for i, j in _linked(fps[keep], sizes[~large], again=False):
            yield at[i], at[j]
        return
    for i, j in run_pairs(sizes):
        near = np.bitwise_count(fps[i] ^ fps[j]) <= BITS
        if near.any():
            i, j = i[near], j[near]
            low, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = roots(len(low), place[: len(i)], place[len(i) :])
            moved = np.flatnonzero(root != np.arange(len(low)))
            yield low[root[moved]], low[moved]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_runs(batches, "variant"):
        keys, fps = (table.column(c).to_numpy() for c in ("variant", "fp"))
        cuts = np.flatnonzero(np.diff(keys)) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(keys)]]))
        for i, j in _linked(fps.view(np.uint64), sizes):
            yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["a", "b"])


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Distinct ``fp`` values to pairs (a, b) of one class that connect all those within three bits.

    The pairs of a variant form trees, each to the first of its tree, so their number is at most that of the index rows.
    """
    half = "shiftrightunsigned(fp, 32 * int(v / 32)) & 4294967295"
    variants = fps.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("v")).selectExpr(
        "fp", f"shiftleft(bigint(v), 32) + (({half}) & ~shiftleft(1L, v % 32)) AS variant"
    )
    return (
        variants.repartition("variant")
        .sortWithinPartitions("variant")
        .mapInArrow(_link_runs, "a long, b long")
        .distinct()
    )


def _rooted(prints: DataFrame, low: Column) -> DataFrame:
    """(fp, low, root) for each distinct fingerprint, stored; ``root`` names its class."""
    classes = prints.groupBy("fp").agg(low.alias("low"))
    links = components(link_fingerprints(classes.select("fp")))
    rooted, _ = stored(
        classes.join(links, classes.fp == links.node, "left").select(
            "fp", "low", F.coalesce("root", "fp").alias("root")
        )
    )
    return rooted


def simhash_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the smallest key whose fingerprint is reached over links.

    Equal fingerprints are one node, so copies are never paired. Null keys are not chosen as
    a class's key unless it has no other. Repeated rows return one row each. Null and empty texts
    have fingerprint zero and link like any other; a bit set in exactly half of the shingles is 0. An
    empty table gives no rows; other columns are left out, whatever their names.
    """
    prints, _ = stored(with_fingerprint(df.select(F.col(key), F.col(text).alias("_t")), "_t").select(key, "fp"))
    rooted = _rooted(prints, F.min(key))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(
        key, "fp", "component_id"
    )


def one_per_class(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each class, with the columns of the input.

    Rows are told apart by a stored number, so keys may be null or repeated: of the rows with
    the smallest key of a class one stays, and a null key only where the class has no other.
    """
    rows, _ = stored(df.withColumn("_llm_row", F.monotonically_increasing_id()))
    own = rows.select("_llm_row", F.col(key).alias("_k"), F.col(text).alias("_t"))
    prints, _ = stored(with_fingerprint(own, "_t").select("_llm_row", "_k", "fp"))
    rooted = _rooted(prints, F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_llm_row")))
    kept = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low._llm_row"))
    return rows.join(kept, "_llm_row", "left_semi").select(*df.columns)
