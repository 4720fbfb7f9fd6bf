"""Substring dedup by bucket-pointer refinement.

A byte goes if a string of 50 bytes that covers it also starts in an earlier document. As in a
suffix array, places are first put into buckets by q-gram, and the buckets are refined by the
bucket identifiers of later offsets: the identifier of 2q bytes is made of those at offsets 0
and q, again and again up to 32. An identifier is a hash of the bytes, so that all tasks agree
on it without a common sort. They stand in for bucket pointers: computed once per
text and never updated or fed back. Three steps settle more and more windows of 50 bytes:

1. A window's bucket is the smallest 32-gram identifier in it, which neighbouring windows share,
   so a tenth of the places is exchanged. Buckets of a single document are settled.
2. A run of windows of one bucket is refined by the identifiers at its first, middle and last
   offset. A run that an earlier document holds too is covered as a whole; if all runs of a
   bucket are equal, the first of them is settled as well.
3. What is left, mostly at the ends of shared passages, is refined window by window.

A batch notes the places of the runs of step 2, so that the texts are hashed as a whole in the
first two steps only; after them the bytes of the runs that are left do.

Documents are dealt into batches in the order of their keys. A batch sends the distinct
identifiers that it holds, split by range, and gets bits back for each. However often a string
occurs, a batch sends it once, so there is no hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmeter.llm.shared import bucketed, releasing, shrink, stored, text_bytes, unshrink

LENGTH = 50
GRAM = 32
#: Text of a batch, and text whose identifiers make a range, in bytes. A batch sends a row to each range.
BATCH_BYTES = 2_000_000
RANGE_BYTES = 8_000_000
#: Places hashed at a time, so that they stay in the processor's cache.
CHUNK = 1 << 14
#: Cuts of the key order that the driver holds; more batches divide these evenly.
CUTS = 2000

_A = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(0).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Factors of the doublings.
_POWERS = {1 << i: np.uint64(pow(int(_A), 1 << i, 1 << 64)) for i in range(GRAM.bit_length() - 1)}
#: Windows that can share a smallest identifier at one place; longer runs are cut at this length.
WIDTH = LENGTH - GRAM + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of stretches in a row, and the stretch of each."""
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) + np.repeat(start - (np.cumsum(size) - size), size), own


def identifiers(raw: np.ndarray) -> np.ndarray:
    """The 32-gram identifier at each place, by five doublings."""
    h = _BYTES[raw]
    k = 1
    while k < GRAM:
        longer = h[:-k] * _POWERS[k]
        longer += h[k:]
        h = longer
        k *= 2
    return _mix(h)


def smallest(h: np.ndarray) -> np.ndarray:
    """For each window of 50 bytes the smallest identifier in it."""
    k = 1
    while 2 * k <= WIDTH:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (WIDTH - k)], h[WIDTH - k :])


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the index of each pair among them."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return one[order][new], two[order][new], index


def _lowest(index: np.ndarray, rank: np.ndarray, count: int) -> np.ndarray:
    out = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(out, index, rank)
    return out


def _rank(keys: pd.Series) -> np.ndarray:
    return keys.rank(method="dense", na_option="bottom").to_numpy().astype(np.int64)


class Batch:
    """Windows of a batch's texts, in runs that share a bucket within a document."""

    def __init__(self, keys: pd.Series, texts: pa.ChunkedArray) -> None:
        raw, offsets = text_bytes(texts)
        # All texts are hashed in a row; windows that reach into the next text are left out below.
        self.grams = np.empty(max(0, len(raw) - GRAM + 1), np.uint64)
        low = np.empty(max(0, len(raw) - LENGTH + 1), np.uint64)
        for start in range(0, len(low), CHUNK):
            h = identifiers(raw[start : start + CHUNK + LENGTH - 1])
            self.grams[start : start + len(h)] = h
            low[start : start + CHUNK] = smallest(h)
        sizes = np.diff(offsets)
        wide = np.flatnonzero(sizes >= LENGTH)
        begins = offsets[wide]
        ends = begins + sizes[wide] - LENGTH + 1
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[begins] = True
        new[ends[ends < len(low)]] = True
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(low)))
        document = np.searchsorted(begins, head, "right") - 1  # of each run, among those with windows
        inside = head < np.append(ends, 0)[document]
        head, size, document = head[inside], size[inside], document[inside]
        # A run of repeated bytes is cut, so that three identifiers cover a run.
        step, run = _spread(np.zeros_like(size), -(-size // WIDTH))
        self.head = head[run] + step * WIDTH
        self.size = np.minimum(size[run] - step * WIDTH, WIDTH)
        # Smallest ones crowd at zero; mixed again they spread evenly over the ranges.
        self.low = _mix(low[self.head])
        self.rank = _rank(keys)[wide[document[run]]]
        self.values, self.bucket = np.unique(self.low, return_inverse=True)

    def shared(self) -> np.ndarray:
        """Whether several documents of the batch hold a bucket."""
        low = _lowest(self.bucket, self.rank, len(self.values))
        return low < -_lowest(self.bucket, -self.rank, len(self.values))

    def contexts(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bucket, refined identifier) of the runs, and the index of each run among them."""
        start, size = self.head[runs], self.size[runs]
        last = self.grams[start + size + LENGTH - GRAM - 1]
        middle = self.grams[start + np.minimum(GRAM, size + LENGTH - GRAM - 1)]
        refined = _mix(self.grams[start] + _mix(middle + _mix(last + size.astype(np.uint64))))
        # With the 64 bits of the bucket, 40 more tell runs apart.
        return _distinct(self.low[runs], refined >> np.uint64(24))


def strings(raw: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of the windows of runs; distinct identifiers of their 50 bytes, in 64 and 16 bits, and the index of each among them."""
    window, run = _spread(head, size)
    h = identifiers(raw[_spread(head, size + LENGTH - 1)[0]]) if len(run) else np.empty(0, np.uint64)
    at = np.arange(len(run)) + (LENGTH - 1) * run
    near, far = h[at], h[at + LENGTH - GRAM]
    return window, *_distinct(_mix(near + _mix(far)), _mix(far + _mix(near)) >> np.uint64(48))


SENT = "batch int, part int, one binary, two binary, more binary"
BITS = "batch int, part int, n int, bits binary"


def _split(batch: int, parts: int, one: np.ndarray, two: np.ndarray | None = None, more: np.ndarray | None = None,
           drop: int = 0, note: np.ndarray | None = None) -> pa.Table:
    """Sorted identifiers cut into ``parts`` ranges, a row for each that has some; ``drop`` low bits are not sent.

    A note to the batch itself has a part of its own, below zero.
    """
    step = (1 << 64) // parts
    cuts = np.searchsorted(one, np.array([i * step for i in range(1, parts)], np.uint64))
    cuts = np.concatenate([[0], cuts, [len(one)]])
    rows = [
        (batch, p, shrink(one[i:j] >> np.uint64(drop), True), b"" if two is None else shrink(two[i:j]),
         b"" if more is None else np.packbits(more[i:j]).tobytes())
        for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j
    ]
    if note is not None and len(note):
        rows.append((batch, -1 - batch, shrink(note), b"", b""))
    kinds = {"batch": pa.int32(), "part": pa.int32(), "one": pa.binary(), "two": pa.binary(), "more": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def _answers(rows: pd.DataFrame, judge: Callable) -> pd.DataFrame:
    """``judge(rows, one, sizes)`` gives rows of bits, a column for each identifier."""
    rows = rows.sort_values("batch")
    own = [unshrink(d, "<u8", True) for d in rows["one"]]
    sizes = [len(x) for x in own]
    bits = np.atleast_2d(judge(rows, np.concatenate(own), sizes))
    ends = np.cumsum(sizes)
    packed = [np.packbits(bits[:, e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pd.DataFrame({"batch": rows["batch"], "part": rows["part"], "n": sizes, "bits": packed})


def _in_several(rows: pd.DataFrame) -> pd.DataFrame:
    """Which buckets several documents hold."""

    def judge(rows: pd.DataFrame, one: np.ndarray, sizes: list[int]) -> np.ndarray:
        more = np.concatenate([_bits(b, n, 1)[0] for b, n in zip(rows["more"], sizes, strict=True)])
        _, run = np.unique(one, return_inverse=True)
        return ((np.bincount(run) > 1) | (np.bincount(run, more) > 0))[run]

    return _answers(rows, judge)


def _in_lower_batch(rows: pd.DataFrame) -> pd.DataFrame:
    """Which pairs a batch of smaller keys holds too, and which have a bucket of several pairs. Notes go back as they are."""
    if rows["part"].iloc[0] < 0:
        return pd.DataFrame({"batch": rows["batch"], "part": rows["part"], "n": 0, "bits": rows["one"]})

    def judge(rows: pd.DataFrame, one: np.ndarray, sizes: list[int]) -> np.ndarray:
        two = np.concatenate([unshrink(d, "<u8") for d in rows["two"]])
        order = np.lexsort((np.arange(len(one)), two, one))  # rows stand in the order of batches
        bucket = np.append(False, np.diff(one[order]) == 0)
        pair = bucket & np.append(False, np.diff(two[order]) == 0)
        run = np.cumsum(~bucket) - 1
        out = np.empty((2, len(one)), bool)
        out[0, order] = pair
        out[1, order] = (np.bincount(run, ~pair) > 1)[run]
        return out

    return _answers(rows, judge)


def _bits(packed: bytes, n: int, layers: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=layers * n).astype(bool).reshape(layers, n)


def _gather(flags: pd.DataFrame, step: int) -> np.ndarray:
    """The bits of a batch's sorted identifiers from the answers of the ranges."""
    flags = flags[(flags["step"] == step) & (flags["part"] >= 0)].sort_values("part")
    layers = 1 if step == 1 else 2
    bits = [_bits(b, n, layers) for b, n in zip(flags["bits"], flags["n"], strict=True)]
    return np.concatenate([np.empty((layers, 0), bool), *bits], axis=1)


def _refined(batch: Batch, flags: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of the runs whose bucket several documents hold, and a note of the runs."""
    runs = np.flatnonzero(_gather(flags, 1)[0][batch.bucket])
    one, two, index = batch.contexts(runs)
    later = batch.rank[runs] > _lowest(index, batch.rank[runs], len(one))[index]
    return one, two, np.concatenate([np.diff(batch.head[runs], prepend=0), index, 2 * batch.size[runs] + later])


def _undecided(flags: pd.DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Heads and sizes of runs that an earlier document holds as a whole, and of runs to be looked at window by window."""
    notes = flags[(flags["step"] == 2) & (flags["part"] < 0)]["bits"]
    gap, index, rest = np.concatenate([np.empty(0, np.int64), *[unshrink(x, "<i8") for x in notes]]).reshape(3, -1)
    head, size = np.cumsum(gap), rest >> 1
    lower, varied = _gather(flags, 2)
    held = lower[index] | (rest & 1 > 0)
    left = ~held & varied[index]
    return (head[held], size[held]), (head[left], size[left])


def _batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Batch numbers in the order of the keys; equal keys share one, null keys the last."""
    wanted = min(batches, CUTS)
    cuts = docs.select(F.percentile_approx(key, [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted)).first()[0]
    bounds = docs.agg(F.min(key), F.max(key)).first()
    if cuts is None:
        return F.lit(0)
    cuts = sorted({bounds[0], *cuts})
    each = math.ceil(batches / len(cuts))
    known = F.array(*[F.lit(c) for c in cuts])
    ends = F.array(*[F.lit(c) for c in [*cuts[1:], bounds[1] + 1]])
    slot = F.size(F.filter(known, lambda x: x <= F.col(key)))
    share = (F.col(key) - F.get(known, slot - 1)) / (F.get(ends, slot - 1) - F.get(known, slot - 1))
    number = (slot - 1) * each + F.least(F.floor(share * each), F.lit(each - 1))
    return F.when(F.col(key).isNull(), len(cuts) * each).otherwise(number).cast("int")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: key, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. Rows that share a key are not earlier than each other; null keys come
    after all others and not before each other. Keys are numbers. An empty table gives no rows, and
    other columns are left out, whatever their names. A task holds a batch of texts, about
    ``BATCH_BYTES``, or a single longer document, at some thirty bytes per byte.
    """
    found = _dedup(docs.select(key, text), key, text, keep=False)
    return found.select(F.col("c0").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The columns of the input, the text without the characters whose bytes all go.

    Rows of which nothing is left go too; texts that were null or empty stay. ``length`` names a
    column that holds the number of characters and follows the text.
    """
    found = _dedup(docs, key, text, keep=True).filter("NOT (n_bytes > 0 AND n_removed = n_bytes)")
    own = []
    for i, (name, kind) in enumerate(docs.dtypes):
        column = F.col(f"c{i}")
        if name == length:
            chars = F.length(f"c{docs.columns.index(text)}")
            column = F.when(F.col("n_removed") > 0, chars).otherwise(column).cast(kind)
        own.append(column.alias(name))
    return found.select(*own)


def _dedup(docs: DataFrame, key: str, text: str, keep: bool) -> DataFrame:
    """The input's columns as c0, c1, ... and the counts."""
    columns = docs.columns
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    parts = max(16, math.ceil(size / RANGE_BYTES))
    # The names of the input are set aside: they may clash with those added.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    k, t = (f"c{columns.index(c)}" for c in (key, text))
    plain = plain.withColumn("batch", _batch_of(plain, k, batches))
    # Each pass reads the batches as they lie.
    table, forget = bucketed(plain, "batch", batches)

    def number(rows: pa.Table) -> int:
        return rows.column("batch")[0].as_py()

    def opened(rows: pa.Table) -> Batch:
        return Batch(rows.column(k).to_pandas(), rows.column(t))

    def first(rows: pa.Table) -> pa.Table:
        batch = opened(rows)
        # A bucket that is wrongly kept is settled by the next step, so a few bits more than places tell apart do.
        return _split(number(rows), parts, batch.values, more=batch.shared(), drop=max(0, 64 - 12 - size.bit_length()))

    def second(rows: pa.Table, flags: pa.Table) -> pa.Table:
        one, two, note = _refined(opened(rows), flags.to_pandas())
        return _split(number(rows), parts, one, two, note=note)

    def third(rows: pa.Table, flags: pa.Table) -> pa.Table:
        _, left = _undecided(flags.to_pandas())
        _, one, two, _ = strings(text_bytes(rows.column(t))[0], *left)
        return _split(number(rows), parts, one, two)

    texts = table.select("batch", k, t).groupBy("batch")
    removers = []
    flags, remove = stored(
        texts.applyInArrow(releasing(first), SENT).groupBy("part").applyInPandas(releasing(_in_several), BITS).withColumn("step", F.lit(1))
    )
    removers.append(remove)
    for step, ask in ((2, second), (3, third)):
        sent = texts.cogroup(flags.groupBy("batch")).applyInArrow(releasing(ask), SENT)
        known, remove = stored(sent.groupBy("part").applyInPandas(releasing(_in_lower_batch), BITS).withColumn("step", F.lit(step)))
        removers.append(remove)
        flags = flags.union(known)

    kinds = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    wanted = StructType.fromDDL(f"{kinds}, {added}")

    def last(rows: pa.Table, flags: pa.Table) -> pa.Table:
        raw, offsets = text_bytes(rows.column(t))
        answers = flags.to_pandas()
        (head, size), left = _undecided(answers)
        window, one, _, index = strings(raw, *left)
        rank = _rank(rows.column(k).to_pandas())[np.searchsorted(offsets, window, "right") - 1]
        window = window[_gather(answers, 3)[0][index] | (_lowest(index, rank, len(one))[index] < rank)]
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, np.append(head, window), 1)
        np.add.at(edge, np.append(head + size - 1, window) + LENGTH, -1)
        covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        starts[begins] = covered[begins]
        spans = np.diff(np.searchsorted(np.flatnonzero(starts), offsets))
        before = np.append(0, np.cumsum(~covered))[offsets]
        rest, sizes, kept = raw[~covered], np.diff(offsets), np.diff(before)
        hashes = [hashlib.sha256(rest[i:j]).hexdigest() for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        columns = [rows.column(c) for c in rows.column_names if c != "batch"]
        if keep:
            old, texts = columns[int(t[1:])].combine_chunks(), []
            changed = kept < sizes
            for i in np.flatnonzero(changed).tolist():
                own, hit = raw[offsets[i] : offsets[i + 1]], covered[offsets[i] : offsets[i + 1]]
                char = np.flatnonzero((own & 0xC0) != 0x80)
                stay = ~np.logical_and.reduceat(hit, char)
                texts.append(own[np.repeat(stay, np.diff(np.append(char, len(own))))].tobytes().decode())
            columns[int(t[1:])] = pc.replace_with_mask(old, pa.array(changed), pa.array(texts, old.type))
        columns += [pa.array(c) for c in (sizes, sizes - kept, spans, pa.array(hashes, pa.string()))]
        return pa.Table.from_arrays(columns, wanted.names)

    both = table.groupBy("batch").cogroup(flags.groupBy("batch"))
    result, _ = stored(both.applyInArrow(releasing(last), wanted))
    for remove in (*removers, forget):
        remove()
    return result
