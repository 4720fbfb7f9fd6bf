"""Best-fit packing through a configuration linear program.

Only the histogram of piece lengths reaches the driver, one count per length up to the
capacity. A configuration is what one sequence holds. The covering program over all
configurations is solved by multiplicative weights: lengths carry weights, a knapsack dynamic
program finds the configuration that is worth most, and the weights of what it covers sink. The
fractional solution is rounded down, the rest is solved again, and what remains in the end is
packed best-fit by counts. Pieces find their sequence by their number within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.bytelevel import byte_level
from postmeter.llm.shared import numbered

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int, end: int) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each row's tokens and the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        last = np.array([end], "<u4").tobytes()
        encode = byte_level(path, special=True).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, out = [], []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = ids.astype("<u4").tobytes() + last
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(i)
                        out.append((n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                n, start, length, crc = (list(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(n, pa.int32()),
                     *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                    ["k", "piece", "start", "length", "ids_crc32"],
                )

    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(docs.dtypes)[key]
    return plain.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(weights: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each length make the sequence of the largest weight (unbounded knapsack)."""
    lengths = np.flatnonzero(weights > 0)
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own = weights[lengths]
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        if k:
            gain = value[room - lengths[:k]] + own[:k]
            best = int(gain.argmax())
            if gain[best] > value[room - 1]:
                value[room], choice[room] = gain[best], lengths[best]
                continue
        value[room] = value[room - 1]
    held = np.zeros(capacity + 1, np.int64)
    room = capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            held[choice[room]] += 1
            room -= choice[room]
    return held


def solve(counts: np.ndarray, capacity: int, rounds: int = 100) -> list[tuple[np.ndarray, float]]:
    """Configurations with their fractional numbers, covering the counts on average.

    A length's weight starts a little above its share of the capacity, as long pieces leave
    fewer choices, and sinks by multiplication with what covers it.
    """
    start = np.where(counts > 0, (np.arange(capacity + 1) / capacity) ** 1.2, 0.0)
    weights, covered = start, np.zeros(capacity + 1)
    step = float((counts * np.arange(capacity + 1)).sum()) / capacity / rounds
    found = []
    for _ in range(rounds):
        held = np.minimum(best_configuration(weights, capacity), counts)
        found.append((held, step))
        covered += held * step
        weights = start * np.exp(-2.0 * np.minimum(covered / np.maximum(counts, 1), 20))
    return found


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing over counts: sequences of the same content are handled together."""
    by_room: dict[int, list[list]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if by_room.get(r)), capacity)
            if room < capacity:
                held, number = by_room[room].pop()
            else:
                held, number = np.zeros(capacity + 1, np.int64), left
            each = min(room // length, left)
            taken = min(number, left // each)
            if taken < number and room < capacity:
                by_room[room].append([held, number - taken])
            more = held.copy()
            more[length] += each
            by_room.setdefault(room - each * length, []).append([more, taken])
            left -= each * taken
    return [(held, number) for group in by_room.values() for held, number in group]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences of each, holding all counts exactly.

    Full configurations are taken as often as their rounded number and the counts allow, those
    with the longest pieces first.
    """
    left, out = counts.copy(), []
    lengths = np.arange(capacity + 1)
    for _ in range(4):
        before = int(left.sum())
        if before <= capacity:
            break
        solved = solve(left, capacity)
        for held, number in sorted(solved, key=lambda x: -int(lengths[x[0] > 0].max(initial=0))):
            used = held > 0
            if int((held * lengths).sum()) == capacity:
                whole = min(int(number), int((left[used] // held[used]).min()))
                if whole:
                    out.append((held, whole))
                    left = left - held * whole
        if left.sum() > 0.95 * before:
            break
    return out + best_fit(left, capacity)


def _places(made: list[tuple[np.ndarray, int]], capacity: int):
    """For each length: from which number on a configuration takes over, how many it holds, its
    first sequence and the offset of its first piece of that length."""
    table: dict[int, list[list[int]]] = {}
    base = 0
    at = np.zeros(capacity + 1, np.int64)
    for held, number in made:
        offset = 0
        for length in np.flatnonzero(held).tolist():
            each = int(held[length])
            table.setdefault(length, []).append([int(at[length]), each, base, offset])
            at[length] += each * number
            offset += each * length
        base += number
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
    capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A row is its tokens and the end token; a null or empty text is the end token alone. Repeated
    rows are packed each for themselves. An empty table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cuts = numbered(pieces(docs, key, text, path, capacity, end), "length", "number")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cuts.groupBy("length").count().collect():  # a row for each length at most
        counts[length] = n
    table = _places(plan(counts, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rows = table[n]
                first, each, base, start = rows[np.searchsorted(rows[:, 0], number[at], "right") - 1].T
                sequence[at] = base + (number[at] - first) // each
                offset[at] = start + (number[at] - first) % each * n
            names = [*batch.schema.names[:5], "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    kind = dict(docs.dtypes)[key]
    return cuts.mapInArrow(
        place, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("k", key)
