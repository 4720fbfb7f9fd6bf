"""LM scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions in the context of the bytes before it. A node of
the tree is a context of 0 to ``DEPTH`` bytes and a prefix of the byte's bits; it mixes its own
Krichevsky-Trofimov estimate with what the longer contexts say, by their weights on the
training text. All depths take part, and the code length of a text is the sum over its bytes.

Texts are dealt into batches. A batch sends its distinct byte strings of ``DEPTH`` + 1 and its
distinct words with their training counts, split by the two nearest context bytes or by hash.
The trees below those two bytes are built where the counts meet; only the top of the tree, at
most 256 x 255 nodes, passes through the driver. The answers go back to the batches. What is
gathered grows with the corpus, and no table of the model is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.shared import bucketed, shrink, stored, text_bytes, unshrink

DEPTH = 5
BATCH_BYTES = 4_000_000
PART_BYTES = 12_000_000
#: Texts of a batch; their numbers take 16 bits beside a string. Batches vary by chance.
BATCH_TEXTS = 1 << 15
#: Strings made at a time, so that they stay in the processor's cache.
CHUNK = 1 << 14
#: Stands for the end of a text among the words; no word holds white space.
END = b"\n"

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SENT = "batch int, slot int, n long, ids binary, counts binary"


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings as sorted numbers, where each begins among all of them, and the text of each of all.

    There is one for each byte and end of text: nearest context byte first, the byte itself last. The
    context before a text is zero bytes, and its end is coded as a zero byte.
    """
    cuts = offsets.tolist()
    joined = b"".join([bytes(DEPTH), *[raw[i:j].tobytes() + b"\0" for i, j in zip(cuts[:-1], cuts[1:], strict=True)], bytes(8)])
    count = len(raw) + len(cuts) - 1
    # Read as little-endian numbers, the bytes before a place stand nearest first.
    before = np.ndarray((count,), "<u8", joined, strides=(1,))
    last = np.frombuffer(joined, np.uint8, count, DEPTH)
    text = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint16), np.diff(offsets) + 1)
    code = np.empty(count, np.uint64)
    context = ((1 << 8 * DEPTH) - 1) << 24
    for start in range(0, count, CHUNK):
        part = slice(start, start + CHUNK)
        h = before[part] << np.uint64(24)
        h &= np.uint64(context)
        h |= last[part].astype(np.uint64) << np.uint64(16)
        h |= text[part]
        code[part] = h
    begins = offsets[:-1] + np.arange(len(cuts) - 1)
    for seen in range(DEPTH):
        # The bytes of the text before are no context.
        at = begins[np.diff(offsets) >= seen] + seen
        code[at] &= np.uint64(~(((1 << 8 * (DEPTH - seen)) - 1) << 24) & ((1 << 64) - 1))
    code.sort()
    text = code.astype(np.uint16)
    code >>= np.uint64(16)
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if count else np.empty(0, np.int64)
    return code[starts], starts, text


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words in order, the index of each word of the texts among them, and how many each text has."""
    low = _LOWER[raw]
    inside = _IN_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[begins] = inside[begins]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    low = low[inside]
    found = _binaries(np.append(np.flatnonzero(first[inside]), len(low)), low).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), place[found.indices.to_numpy()], counts


def _binaries(ends: np.ndarray, data: np.ndarray | bytes) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(7))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Of counts below ``SMALL``: log gamma at half above, and at one above.
SMALL = 1 << 12
_HALF, _ONE = (log_gamma(np.arange(SMALL) + x) for x in (0.5, 1.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of the counts under the Krichevsky-Trofimov estimator."""
    total = zeros + ones
    cut = [np.minimum(x, SMALL - 1).astype(np.int64) for x in (zeros, ones, total)]
    out = _HALF[cut[0]] + _HALF[cut[1]] - _ONE[cut[2]]
    large = total >= SMALL
    zeros, ones, total = zeros[large], ones[large], total[large]
    out[large] = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(total + 1.0)
    return out - math.log(math.pi)


class Tree:
    """The part of the tree below two nearest context bytes, for the given sorted strings and counts.

    For a depth and a bit the nodes stand in the order of the strings cut to that depth, so they are
    runs and need no sort; only the strings are made distinct again for each depth.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        #: By depth: the strings with so many context bytes, and the index of each longer one among them.
        self.keys, self.up = {DEPTH: keys}, {}
        times = {DEPTH: counts.astype(np.float64)}
        for depth in range(DEPTH - 1, 1, -1):
            longer = self.keys[depth + 1]
            cut = (longer >> np.uint64(16) << np.uint64(8)) | (longer & np.uint64(255))
            self.keys[depth], self.up[depth] = np.unique(cut, return_inverse=True)
            times[depth] = np.bincount(self.up[depth], times[depth + 1], len(self.keys[depth]))
        #: By depth and bit: the node of each string, and the nodes' counts and shares.
        self.index, self.zeros, self.ones, self.share = {}, {}, {}, {}
        self.top = np.zeros((3, 1 << 16))
        self.found = np.zeros(1 << 16, bool)
        for bit in range(8):
            for depth in range(DEPTH, 1, -1):
                one, code = self.decision(depth, bit)
                node = (self.keys[depth] >> np.uint64(8) << np.uint64(8)) | code
                new = np.append(True, node[1:] != node[:-1])[: len(node)]
                index = (np.cumsum(new) - 1).astype(np.int32)
                starts = np.flatnonzero(new)
                ones = np.bincount(index, times[depth] * one, len(starts))
                zeros = np.bincount(index, times[depth] * ~one, len(starts))
                own = log_kt(zeros, ones)
                if depth == DEPTH:
                    weighted, share = own, np.ones(len(starts))
                else:
                    # A longer context's node leads to the one whose context lacks its last byte.
                    rest = np.bincount(index[self.up[depth][below]], weighted, len(starts))
                    weighted = np.logaddexp(own, rest) + math.log(0.5)
                    share = np.exp(math.log(0.5) + own - weighted)
                below = starts
                at = depth, bit
                self.index[at], self.zeros[at], self.ones[at], self.share[at] = index, zeros, ones, share
            group = ((node[starts] >> np.uint64(16) << np.uint64(8)) | code[starts]).astype(np.int64)
            self.top += [np.bincount(group, x, 1 << 16) for x in (zeros, ones, weighted)]
            self.found[group] = True

    def decision(self, depth: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the strings at a depth: whether the bit of the last byte is one, and the bits before it behind a one."""
        last = self.keys[depth] & np.uint64(255)
        return (last >> np.uint64(7 - bit)) & np.uint64(1) > 0, np.uint64(1 << bit) | (last >> np.uint64(8 - bit))

    def tops(self) -> pd.DataFrame:
        """(byte, code, zeros, ones, weighted) summed up for the nearest context byte."""
        found = np.flatnonzero(self.found)
        return pd.DataFrame(
            {"byte": (found >> 8).astype(np.int32), "code": (found & 255).astype(np.int32),
             "zeros": self.top[0][found], "ones": self.top[1][found], "weighted": self.top[2][found]}
        )

    def log10(self, top: np.ndarray) -> np.ndarray:
        """Log10 probability of each string's last byte. ``top``: see ``top_of``."""
        out = np.ones(len(self.keys[DEPTH]))
        for bit in range(8):
            # What is known at a depth is ``fixed + part * p``, where p is what the longer contexts say.
            one, code = self.decision(2, bit)
            fixed, part = np.zeros(len(code)), np.ones(len(code))
            for row in (np.full(len(code), 256), (self.keys[2] >> np.uint64(16)).astype(np.int64)):
                zeros, ones, share = top[:, row, code.astype(np.int64)]
                fixed += part * share * (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
                part *= 1 - share
            for depth in range(2, DEPTH + 1):
                at = depth, bit
                if depth > 2:
                    fixed, part = fixed[self.up[depth - 1]], part[self.up[depth - 1]]
                one, _ = self.decision(depth, bit)
                total = self.zeros[at] + self.ones[at] + 1.0
                share = self.share[at]
                says = np.stack([share * (self.zeros[at] + 0.5) / total, share * (self.ones[at] + 0.5) / total])
                i = self.index[at]
                fixed += part * says[one.astype(np.int8), i]
                part *= (1 - share)[i]
            out *= fixed
        return np.log10(out)


def top_of(rows: list) -> np.ndarray:
    """Counts and weights of the nodes with one context byte, and in row 256 with none."""
    zeros, ones, rest = np.zeros((257, 256)), np.zeros((257, 256)), np.zeros((257, 256))
    for byte, code, n0, n1, weighted in rows:
        zeros[byte, code], ones[byte, code], rest[byte, code] = n0, n1, weighted
    zeros[256], ones[256] = zeros[:256].sum(axis=0), ones[:256].sum(axis=0)
    own = log_kt(zeros, ones)
    weighted = np.logaddexp(own, rest) + math.log(0.5)
    rest[256] = weighted[:256].sum(axis=0)
    weighted = np.logaddexp(own, rest) + math.log(0.5)
    return np.stack([zeros, ones, np.exp(math.log(0.5) + own - weighted)])


def _by_slot(slots: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The places in the order of their slots, and for each slot that has some where its places begin and end."""
    order = np.argsort(slots.astype(np.min_scalar_type(parts)), kind="stable")
    ends = np.cumsum(np.bincount(slots, minlength=parts))
    return order, [(p, i, j) for p, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if i < j]


def _gram_slots(keys: np.ndarray, parts: int) -> np.ndarray:
    pair = keys >> np.uint64(8 * (DEPTH - 1))
    return ((pair * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % parts


def _word_slots(words: pa.Array, parts: int) -> np.ndarray:
    """By a polynomial in the bytes of each word."""
    raw, offsets = text_bytes(pa.chunked_array([words]))
    sizes = np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _MULTIPLIER))
    step = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    total = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[step], offsets[:-1])
    return (((total ^ (total >> np.uint64(29))) * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % parts


def _with_end(words: pa.Array) -> pa.Array:
    return pa.concat_arrays([words, pa.array([END], pa.large_binary())])


def score_texts(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``score`` is the log10 probability that the tree learned from the rows of ``training`` gives
    to the whole text and its end; ``base_score`` that of its words and end by add-one counts.
    A null text is empty: its end alone is scored. Rows for which ``training`` is null do not
    train. Without training rows every decision has probability one half. Repeated rows train and are
    scored each for themselves; answers travel as 32-bit floats, so scores are good to about 1e-7 a
    token. An empty table gives no rows; other columns are left out, whatever their names.
    """
    docs = docs.select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(training, F.lit(False)).alias("train"),
        F.monotonically_increasing_id().alias("id"),
    )
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)) + F.count("*"), F.count("*")).first()
    batches, parts = max(1, math.ceil(size / BATCH_BYTES), math.ceil(rows / BATCH_TEXTS)), max(32, math.ceil(size / PART_BYTES))
    table, forget = bucketed(
        docs.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).drop("id"), "batch", batches
    )

    def send(rows: pa.Table) -> pa.Table:
        out, batch = [], rows.column("batch")[0].as_py()
        raw, offsets = text_bytes(rows.column("t"))
        trains = rows.column("train").to_numpy()
        keys, starts, text = grams(raw, offsets)
        counts = np.add.reduceat(trains[text], starts, dtype="<u4")
        order, slices = _by_slot(_gram_slots(keys, parts), parts)
        keys, counts = keys[order], counts[order]
        for slot, i, j in slices:
            out.append((batch, slot, j - i, shrink(keys[i:j], True), shrink(counts[i:j])))
        distinct, index, sizes = words(raw, offsets)
        seen = np.bincount(index[np.repeat(trains, sizes)], minlength=len(distinct))
        distinct, seen = _with_end(distinct), np.append(seen, np.count_nonzero(trains))
        order, slices = _by_slot(_word_slots(distinct, parts), parts)
        data, ends = text_bytes(pa.chunked_array([distinct.take(pa.array(order))]))
        seen = seen[order]
        for slot, i, j in slices:
            ids = zstandard.ZstdCompressor(level=1).compress(data[ends[i] : ends[j]].tobytes())
            counts = np.append(np.diff(ends[i : j + 1]), seen[i:j]).astype("<u4")
            out.append((batch, parts + slot, j - i, ids, shrink(counts)))
        kinds = {"batch": pa.int32(), "slot": pa.int32(), "n": pa.int64(), "ids": pa.binary(), "counts": pa.binary()}
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    sent, forget_sent = bucketed(table.groupBy("batch").applyInArrow(send, SENT), "slot", 2 * parts)

    def tree(rows: pd.DataFrame) -> tuple[Tree, list[np.ndarray]]:
        own = [unshrink(d, "<u8", True) for d in rows["ids"]]
        keys, index = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(index, np.concatenate([unshrink(d, "<u4") for d in rows["counts"]]), len(keys))
        return Tree(keys, counts), np.split(index, np.cumsum([len(x) for x in own])[:-1])

    def vocabulary(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
        """The training count of each distinct word, and the indices of the batches' words among them."""
        lists, seen = [], []
        for n, ids, counts in zip(rows["n"], rows["ids"], rows["counts"], strict=True):
            sizes, own = unshrink(counts, "<u4").reshape(2, n)
            lists.append(_binaries(np.append(0, np.cumsum(sizes, dtype=np.int64)), zstandard.ZstdDecompressor().decompress(ids)))
            seen.append(own)
        found = pa.concat_arrays(lists).dictionary_encode()
        index = found.indices.to_numpy()
        total = np.bincount(index, np.concatenate(seen), len(found.dictionary)).astype("<i8")
        return total, np.split(index, np.cumsum(rows["n"])[:-1])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["slot"].iloc[0] < parts:
            return tree(rows)[0].tops()
        total, _ = vocabulary(rows)
        sums = {"byte": [-1], "code": [0], "zeros": [float(total.sum())], "ones": [float(np.count_nonzero(total))]}
        return pd.DataFrame(sums | {"weighted": [0.0]})

    learned = sent.groupBy("slot").applyInPandas(learn, "byte int, code int, zeros double, ones double, weighted double")
    # A row for each of 256 x 255 nodes at most, and one for the words.
    rows = learned.groupBy("byte", "code").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()
    train_tokens, distinct_tokens = next(((int(r[2]), int(r[3])) for r in rows if r[0] < 0), (0, 0))
    top = top_of([r for r in rows if r[0] >= 0])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        slot = int(rows["slot"].iloc[0])
        if slot < parts:
            made, own = tree(rows)
            values = made.log10(top).astype("<f4")
            data = [shrink(values[i]) for i in own]
        else:
            total, lists = vocabulary(rows)
            data = [shrink(total[i]) for i in lists]
        return pd.DataFrame({"batch": rows["batch"], "slot": slot, "values": data})

    answers, _ = stored(sent.groupBy("slot").applyInPandas(answer, "batch int, slot int, values binary"))

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        raw, offsets = text_bytes(rows.column("t"))
        values = dict(zip(found.column("slot").to_pylist(), found.column("values").to_pylist(), strict=True))
        keys, starts, text = grams(raw, offsets)
        order, slices = _by_slot(_gram_slots(keys, parts), parts)
        logs = np.empty(len(keys))
        for slot, i, j in slices:
            logs[order[i:j]] = unshrink(values[slot], "<f4")
        sums = np.bincount(text, np.repeat(logs, np.diff(np.append(starts, len(text)))), len(rows))
        distinct, index, sizes = words(raw, offsets)
        order, slices = _by_slot(_word_slots(_with_end(distinct), parts), parts)
        counts = np.empty(len(order), np.int64)
        for slot, i, j in slices:
            counts[order[i:j]] = unshrink(values[parts + slot], "<i8")
        base = np.log10((counts + 1) / (train_tokens + distinct_tokens + 1))
        text = np.repeat(np.arange(len(rows)), sizes)
        known = np.bincount(text[counts[index] > 0], minlength=len(rows)) + (counts[-1] > 0)
        columns = [
            rows.column("k"), sizes + 1, known, np.full(len(rows), train_tokens),
            np.bincount(text, base[index], len(rows)) + base[-1], sums,
        ]
        return pa.table(dict(zip(("k", "n_tokens", "n_known", "train_tokens", "base_score", "score"), columns, strict=True)))

    kind = dict(docs.dtypes)["k"]
    scored, _ = stored(
        table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
            score, f"k {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )
    )
    forget()
    forget_sent()
    return scored.withColumnRenamed("k", key)
