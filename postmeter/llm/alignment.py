"""Alignment of two tokenizations of the same text by pointer jumping.

Tokens of both vocabularies cover the same bytes. Each points to the farthest-right token of the
other side that it overlaps, the one that holds its last byte; where tokens of both sides end at
the same byte, one of them is the end of the chain and points to itself. Replacing every pointer
by its pointer's pointer doubles the way it leads, so that after a few rounds over whole arrays
each token points to the last token of its group. Groups are the shortest stretches that both
vocabularies cut alike.

Texts are handled in blocks of some megabytes. A block keeps its distinct pairs of ids with the
number of its documents that link them; these are summed over the corpus and come back to the
blocks through joins on the pair, each pair once a block, so a frequent pair is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.bytelevel import byte_level as byte_level_ids
from postmeter.llm.shared import release, shrink, stored, unshrink

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Bytes of text that are aligned at a time; one longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Links of a group from which on they are counted by id instead of one by one.
LARGE_GROUP = 1 << 16


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.a = byte_level_ids(byte_level, special=False)
        self.b = SentencePieceProcessor(model_file=pieces)
        self.bytes_a = self.a.bytes
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none for a text that is empty or that either side does not give back byte by byte."""
        none = np.zeros(0, np.int64)
        out = []
        for text, a in zip(texts, self.a.encode([" " + t for t in texts]), strict=True):
            b, whole = self.b.encode(text), b" " + text.encode()
            same = (
                text
                and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
                and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            )
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else (none, none))
        return out


@lru_cache(maxsize=1)
def _pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both sides, numbered from 0, from the tokens' end offsets over the same bytes."""
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of the other side that holds the last byte
    over_b = np.searchsorted(ends_a, ends_b)
    last = ends_b[over_a] == ends_a
    to = np.concatenate([np.where(last, np.arange(n), n + over_a), over_b])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    number = np.cumsum(last) - 1
    return number[to[:n]], number[to[n:]]


def _links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """(group, id of A, id of B, how often) of all links; one entry for each link outside large groups."""
    large = size_a * size_b > LARGE_GROUP
    each = np.where(large[of_a], 0, size_b[of_a])
    first_b = np.cumsum(size_b) - size_b
    at = np.repeat(np.arange(len(a)), each)
    step = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
    parts = [(of_a[at], a[at], b[first_b[of_a[at]] + step], np.ones(len(at), np.int64))]
    first_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(large).tolist():
        x, nx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        n = len(x) * len(y)
        parts.append((np.full(n, g), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


@lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below n as digits from the left, with room for one more character, and their lengths."""
    width = len(str(n - 1)) + 1
    shown = np.zeros((n, width), np.uint8)
    size = np.ones(n, np.int64)
    for digits in range(1, width):
        low, high = (10 ** (digits - 1) if digits > 1 else 0), min(n, 10**digits)
        v = np.arange(low, high)
        size[low:high] = digits
        for i in range(digits):
            shown[low:high, digits - 1 - i] = 48 + v // 10**i % 10
    return shown, size


def _written(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, largest: int):
    """``a1,a2|b1;a3|b2`` of all groups as bytes, ``;`` behind each, and where each group ends in them."""
    n = len(a) + len(b)
    place_a = np.arange(len(a)) + (np.cumsum(size_b) - size_b)[of_a]
    place_b = np.arange(len(b)) + np.cumsum(size_a)[of_b]
    ids = np.empty(n, np.int64)
    ids[place_a], ids[place_b] = a, b
    mark = np.full(n, ord(","), np.uint8)
    ends = np.cumsum(size_a + size_b)
    mark[ends - 1], mark[ends - size_b - 1] = ord(";"), ord("|")
    shown, sizes = _decimals(largest)
    text, size = shown[ids], sizes[ids]
    text[np.arange(n), size] = mark
    return text[np.arange(text.shape[1]) <= size[:, None]], np.cumsum(size + 1)[ends - 1]


def align(encoded: list[tuple[np.ndarray, np.ndarray]], sizes: list[np.ndarray]) -> dict:
    """Facts of each document of a block, its distinct pairs of ids and where documents hold them."""
    held = [i for i, (a, _) in enumerate(encoded) if len(a)]
    count = {side: np.array([len(e[k]) for e in encoded], np.int64) for k, side in ((0, "n_a"), (1, "n_b"))}
    n = len(encoded)
    facts = count | {"n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64)}
    digest = [""] * n
    none = np.zeros(0, np.int64)
    if not held:
        return facts | {"groups_sha256": digest, "pair": none, "docs": none, "doc": none, "at": none, "times": none}
    a, b = (np.concatenate([encoded[i][k] for i in held]) for k in (0, 1))
    of_a, of_b = groups(np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b]))
    size_a, size_b = np.bincount(of_a), np.bincount(of_b)
    # Documents end where both sides end, so each group lies in one of them.
    doc_of = np.repeat(np.array(held), count["n_a"][held])[np.cumsum(size_a) - 1]
    facts["n_groups"] = np.bincount(doc_of, minlength=n)
    facts["n_links"] = np.bincount(doc_of, size_a * size_b, minlength=n).astype(np.int64)
    text, ends = _written(a, b, of_a, of_b, size_a, size_b, max(len(s) for s in sizes))
    stop = ends[np.cumsum(facts["n_groups"][held]) - 1]
    for i, start, end in zip(held, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
        digest[i] = hashlib.sha256(text[start : end - 1]).hexdigest()
    group, x, y, times = _links(a, b, of_a, of_b, size_a, size_b)
    width = len(sizes[0]) * len(sizes[1])
    keys = doc_of[group] * width + x * len(sizes[1]) + y
    if (times == 1).all():
        keys, times = np.unique(keys, return_counts=True)
    else:
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        times = np.add.reduceat(times[order], first)
    pair, at, docs = np.unique(keys % width, return_inverse=True, return_counts=True)
    return facts | {"groups_sha256": digest, "pair": pair, "docs": docs, "doc": keys // width, "at": at, "times": times}


def _shrunk(found: dict) -> list[bytes]:
    if not len(found["at"]):
        return []
    return [shrink(found["doc"], True), shrink(found["at"].astype(np.int32)), shrink(found["times"].astype(np.int64))]


_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, key: str, text: str, byte_level: str, pieces: str, block_bytes: int) -> DataFrame:
    """One row per block: facts of its documents, its pairs, and which document holds which pair how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = _pair(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32

        def made(keys: list[pa.Array], encoded: list) -> pa.RecordBatch:
            nonlocal number
            found = align(encoded, pair.sizes)
            kept = pa.concat_arrays(keys)
            number += 1
            columns = {
                "block": pa.array([number], pa.int64()),
                "k": pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
                **{c: pa.array([found[c]], pa.list_(pa.int64())) for c in _FACTS},
                "groups_sha256": pa.array([found["groups_sha256"]]),
                "pair": pa.array([found["pair"]], pa.list_(pa.int64())),
                "docs": pa.array([found["docs"]], pa.list_(pa.int64())),
                "held": pa.array([_shrunk(found)], pa.list_(pa.binary())),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        keys: list[pa.Array] = []
        encoded: list = []
        size = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            for i, t in enumerate(texts):
                size += len(t.encode()) + 64
                if size >= block_bytes or i + 1 == len(texts):
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    encoded += pair.encode(texts[start : i + 1])
                    start = i + 1
                    if size >= block_bytes:
                        yield made(keys, encoded)
                        keys, encoded, size = [], [], 0
        if keys:
            yield made(keys, encoded)
        release()

    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    facts = ", ".join(f"{c} array<long>" for c in _FACTS)
    return plain.mapInArrow(
        run, f"block long, k array<{kind}>, {facts}, groups_sha256 array<string>, pair array<long>, docs array<long>, held array<binary>"
    )


def align_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", byte_level: str | None = None, pieces: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary over a blank and the text, B the pieces over the text. A link
    joins a token of A and one of B in the same group. The count of a pair of ids is the number of
    rows that link it; ``n_best`` are the links whose count is the highest of their A id, ties
    included, ``count_sum`` adds up the counts of all links. Null and empty texts, and texts that a
    vocabulary does not give back byte by byte, have no tokens: zeros and an empty digest. Repeated
    rows and rows of one key are documents of their own, null keys stay. An empty table gives no
    rows. Other columns are left out, whatever their names.
    """
    if byte_level is None or pieces is None:
        import public_tokenizers

        byte_level, pieces = byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES)
    blocks, _ = stored(_blocks(docs, key, text, byte_level, pieces, block_bytes))
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=pieces).get_piece_size()
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select(
        "block", "at", F.col("x.pair").alias("pair"), F.col("x.docs").alias("docs")
    )
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("c"))
    of_a = F.expr(f"pair div {width}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("c").alias("most"))
    known = counts.withColumn("a", of_a).join(most, "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
    answers = pairs.join(known, "pair").select(F.col("block").alias("of"), "at", "c", "best")
    kind = dict(docs.dtypes)[key]

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        row = {c: own.column(c).combine_chunks()[0].values for c in ("k", *_FACTS, "groups_sha256", "held")}
        n = len(row["k"])
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if told.num_rows:
            at = told.column("at").to_numpy()
            count, is_best = np.empty(len(at), np.int64), np.empty(len(at), bool)
            count[at] = told.column("c").to_numpy()
            is_best[at] = told.column("best").to_numpy()
            doc, pair, times = (b.as_py() for b in row["held"])
            doc, pair, times = unshrink(doc, "<i8", True), unshrink(pair, "<i4"), unshrink(times, "<i8")
            np.add.at(best, doc, np.where(is_best[pair], times, 0))
            np.add.at(total, doc, count[pair] * times)
        return pa.table(
            [row["k"], *(row[c] for c in _FACTS), pa.array(best), pa.array(total), row["groups_sha256"]],
            ["k", *_FACTS, "n_best", "count_sum", "groups_sha256"],
        )

    own = blocks.select("block", "k", *_FACTS, "groups_sha256", "held")
    return (
        own.groupBy("block").cogroup(answers.groupBy("of"))
        .applyInArrow(finish, f"k {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        .withColumnRenamed("k", key)
    )
