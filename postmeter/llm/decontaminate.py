"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles. A window can only occur where its rarest shingle
does, so that one shingle is its prefix. Corpus and prefixes meet by an equality join; the
place of the shingle gives the window's start, which must leave room for the window on both
sides, and the words are then compared one for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmeter.llm.shared import TEXTS, release, stored

WINDOW = 13
SHINGLE = 5
#: The filter of benchmark shingles has this many slots whatever the benchmark's size.
SLOT_BITS = 22

_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_seen = _Hashes()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash for each run of k words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    if len(_seen) > 1 << 18:
        _seen.clear()
    own = np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ own[i : len(words) - k + 1 + i]) * _STEP
        total ^= total >> np.uint64(29)
    return total


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, window, n, k, offset, shingle): each shingle of each window."""
    for batch in batches:
        out: list[tuple] = []
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for item, text in zip(batch.column("item").to_pylist(), texts, strict=True):
            words = words_of(text)
            n = min(WINDOW, len(words))
            k = min(SHINGLE, n)
            hashes = shingle_hashes(words, k).view(np.int64).tolist() if n else []
            for start in range(len(words) - n + 1 if n else 0):
                window = b" ".join(words[start : start + n]).decode()
                out.extend((item, window, n, k, o, hashes[start + o]) for o in range(n - k + 1))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["item", "window", "n", "k", "offset", "shingle"],
        )


def _find(lengths: list[int], slots: bytes):
    """Places of each document's shingles that pass the filter, with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(slots, np.uint8)
        kind = pa.list_(
            pa.struct([("pos", pa.int32()), ("shingle", pa.int64()), ("first", pa.int32()), ("near", pa.list_(pa.string()))])
        )
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            counts, found = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                places = []
                for k in lengths:
                    hashes = shingle_hashes(words, k)
                    slot = hashes >> np.uint64(64 - SLOT_BITS)
                    hit = np.flatnonzero(full[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    for p, h in zip(hit.tolist(), hashes[hit].view(np.int64).tolist(), strict=True):
                        first = max(0, p - WINDOW + k)
                        near = [w.decode() for w in words[first : p + WINDOW]]
                        places.append({"pos": p, "shingle": h, "first": first, "near": near})
                counts.append(len(words))
                found.append(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(found, kind)], ["row", "n_words", "places"]
            )
        _seen.clear()
        release()

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside an occurrence of a window of 13 item words (the whole item
    if shorter); a document is contaminated if they are a twentieth of its words or more. Null
    or empty texts have no words, items without words match nothing. An item whose id is null
    hits like any other, but is not among the ids counted in ``n_items`` and hashed. Repeated rows
    are judged each for themselves. Empty tables give no rows, or none contaminated; other columns are
    left out, whatever their names.
    """
    shingles, _ = stored(
        benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
        .mapInArrow(_windows, "item string, window string, n int, k int, offset int, shingle long")
    )
    # At most five lengths and 2^22 slots, whatever the benchmark holds.
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())
    slot = F.shiftrightunsigned("shingle", 64 - SLOT_BITS).cast("int").alias("slot")
    used = shingles.select(slot).distinct().toPandas()["slot"].to_numpy(dtype=np.int64)
    slots = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    np.bitwise_or.at(slots, used >> 3, (1 << (used & 7)).astype(np.uint8))
    found, _ = stored(
        docs.select(F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("id")).alias("row"),
                    F.col(text).alias("text"))
        .mapInArrow(
            _find(lengths, slots.tobytes()),
            f"row struct<key: {dict(docs.dtypes)[key]}, id: long>, n_words long,"
            " places array<struct<pos: int, shingle: long, first: int, near: array<string>>>",
        )
    )
    hits = found.select("row.id", "n_words", F.explode("places").alias("p")).select("id", "n_words", "p.*")
    rarity = hits.groupBy("shingle").count()
    rarest = F.min_by(F.struct("offset", "shingle"), F.struct("count", "shingle", "offset")).alias("p")
    prefix = (
        shingles.select("window", "n", "offset", "shingle").distinct()
        .join(rarity, "shingle", "left").na.fill(0, ["count"]).groupBy("window", "n").agg(rarest)
        .join(shingles.groupBy("window").agg(F.collect_set("item").alias("items")), "window")
        .select("window", "n", "p.*", "items")
    )
    matched = (
        hits.join(prefix, "shingle").withColumn("start", F.expr("pos - offset"))
        .filter("start >= 0 AND start + n <= n_words")
        .filter("concat_ws(' ', slice(near, start - first + 1, n)) = window")
        .select("id", "start", F.expr("start + n").alias("end"), "items")
    )
    before = Window.partitionBy("id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matched.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    each = covered.groupBy("id").agg(
        F.sum(F.expr("greatest(0, end - greatest(start, reached))")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = found.select("row.key", "row.id", "n_words").join(each, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key has no contaminated row, with the columns of the input."""
    bad = contamination(docs, benchmark, key).filter("contaminated").select(F.col(key).alias("_llm_key")).distinct()
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_llm_key")), "left_anti")


def without_contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated themselves, whatever their keys, with the columns of the input."""
    rows, _ = stored(docs.withColumn("_llm_row", F.monotonically_increasing_id()))
    bad = contamination(rows, benchmark, "_llm_row").filter("contaminated").select("_llm_row")
    return rows.join(bad, "_llm_row", "left_anti").select(*docs.columns)
