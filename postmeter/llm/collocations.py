"""Phrase collocations by multikey quicksort of suffix pointers.

Every place of a text is a suffix: the words from there on, as far as its piece and the longest
phrase go. Blocks of text are cut into words once and kept as word numbers; a word that is too
rare in its language ends a suffix, as no frequent phrase can hold it. Suffixes are routed by
their leading words: sampled suffixes cut the sorted order into ranges of like size, so that a
frequent word or pair of words is spread over as many ranges as it needs, and equal suffixes of a
block travel as one with a weight. In a range, pointers go through a three-way quicksort, word
after word to the last one: what equals the pivot is the set of places of one phrase, its weight
the phrase's count, and a part whose weight is below the threshold is given up unsorted. Phrases
across the edge of a range are counted on both sides and summed up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmeter.llm.shared import shrink, stored, unshrink

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Suffixes that a range holds on average, and of how many blocks and how many of each the cuts are a sample.
RANGE_SUFFIXES = 1_000_000
SAMPLE_BLOCKS, SAMPLE_SUFFIXES = 4096, 64
#: Words of blocks that a part of the vocabulary sums up on average.
PART_WORDS = 1_000_000
#: Parts that the first places of a language are chosen from before they meet in one task.
PARTS = 64

_BREAKS = "[.,;:!?\n\x0b\x0c\r]"
_BREAK = "\n"


def words_of(texts: pa.Array) -> pa.DictionaryArray:
    """The words of all texts in order, A-Z in lower case, a line feed behind each piece."""
    lower = pc.ascii_lower(texts)
    marked = pc.replace_substring_regex(lower, _BREAKS, f" {_BREAK} ")
    ended = pc.binary_join_element_wise(marked, *(pa.scalar(x, marked.type) for x in (_BREAK, " ")))
    words = pc.split_pattern_regex(ended, "[ \t]+").flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()


def _blocks(docs: DataFrame, text: str, lang: str, block_bytes: int) -> DataFrame:
    """One row per block and language: its words, how often each occurs, and the text as places in them from 1, 0 a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, langs = batch.column(0).cast(pa.large_string()), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block_bytes, "right")))
                own = langs.slice(start, stop - start)
                for name in pc.unique(own).to_pylist():
                    found = words_of(texts.slice(start, stop - start).filter(pc.equal(own, name)))
                    known = found.dictionary.to_pylist()
                    at = found.indices.to_numpy() + 1
                    if _BREAK in known:
                        at[at == known.index(_BREAK) + 1] = 0
                    counts = np.bincount(at, minlength=len(known) + 1)[1:]
                    number += 1
                    if len(at):
                        row = [number, name, known, counts, len(known), shrink(at.astype(np.int32))]
                        types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "lang", "words", "counts", "n_words", "at"]
                        )
                start = stop

    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"))
    return plain.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, n_words long, at binary")


def suffixes(ids: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes of two words and more, one a column, cut to the longest phrase; 0 from where a suffix ends."""
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    at = np.flatnonzero((ids > 0) & (padded[1 : len(ids) + 1] > 0))
    out = np.zeros((longest, len(at)), np.int32)
    alive = np.ones(len(at), bool)
    for d in range(longest):
        word = padded[at + d]
        alive &= word > 0
        out[d] = np.where(alive, word, 0)
    return out


def in_order(rows: np.ndarray) -> np.ndarray:
    """The order of columns by their first word, then the second, and so on."""
    packed = [rows[i].astype(np.int64) << 32 | (rows[i + 1] if i + 1 < len(rows) else 0) for i in range(0, len(rows), 2)]
    return np.lexsort(packed[::-1])


def merged(rows: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, equal columns as one with the sum of their weights."""
    order = in_order(rows)
    rows, weight = rows[:, order], weight[order]
    if not rows.shape[1]:
        return rows, weight
    first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)]))
    return rows[:, first], np.add.reduceat(weight, first)


def below(rows: np.ndarray, mark: np.ndarray) -> int:
    """How many of the sorted columns come before ``mark``."""
    low, high = 0, rows.shape[1]
    for d, word in enumerate(mark):
        part = rows[d, low:high]
        low, high = low + int(np.searchsorted(part, word, "left")), low + int(np.searchsorted(part, word, "right"))
        if low == high:
            break
    return low


def frequent_prefixes(rows: np.ndarray, weight: np.ndarray, least: int, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length from 2: a column that starts with each phrase of at least that weight, and the weight.

    The quicksort handles all parts of all depths at once: a round takes a pivot for each part,
    deals its pointers into less, equal and greater, and keeps the parts that are heavy enough.
    """
    longest = len(rows)
    found: list[list] = [[] for _ in range(longest + 1)]
    pointers, sizes, depth = np.arange(rows.shape[1]), np.array([rows.shape[1]]), np.zeros(1, np.int64)
    rng = np.random.default_rng(seed)
    while len(pointers):
        part = np.repeat(np.arange(len(sizes)), sizes)
        word = rows[depth[part], pointers]
        starts = np.cumsum(sizes) - sizes
        pivot = word[starts + (rng.random(len(sizes)) * sizes).astype(np.int64)]
        against = pivot[part]
        kept = []
        for side in (word < against, word == against, word > against):
            at = np.flatnonzero(side)
            mass = np.bincount(part[at], weight[pointers[at]], minlength=len(sizes)).astype(np.int64)
            size = np.bincount(part[at], minlength=len(sizes))
            deeper = depth
            go = mass >= least
            if len(kept) == 1:
                go &= pivot > 0
                deeper = depth + 1
                for d in np.unique(deeper[go]).tolist():
                    if d >= 2:
                        here = go & (deeper == d)
                        first = (np.cumsum(size) - size)[here]
                        found[d].append((pointers[at[first]], mass[here]))
                go &= deeper < longest
            kept.append((pointers[at[go[part[at]]]], size[go], deeper[go]))
        pointers, sizes, depth = (np.concatenate(c) for c in zip(*kept, strict=True))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return [tuple(np.concatenate(c) for c in zip(*f, strict=True)) if f else none for f in found[2:]]


def phrases_of(rows: np.ndarray, weight: np.ndarray, least: int, low: np.ndarray | None, high: np.ndarray | None):
    """(words, count) of the frequent phrases of a range, and of those that may go on beyond its marks, whatever their count."""
    out = []
    edges = {tuple(m[:d].tolist()) for m in (low, high) if m is not None for d in range(2, len(rows) + 1) if m[:d].all()}
    for e in edges:
        here = (rows[: len(e)] == np.array(e)[:, None]).all(0)
        if here.any():
            out.append((list(e), int(weight[here].sum())))
    for d, (at, mass) in enumerate(frequent_prefixes(rows, weight, least), 2):
        words = rows[:d, at].T.tolist()
        out += [(w, m) for w, m in zip(words, mass.tolist(), strict=True) if tuple(w) not in edges]
    return out


def _vocabulary(blocks: DataFrame, least: int, part_words: int) -> tuple[DataFrame, DataFrame]:
    """The frequent words with their counts and numbers, and for each block where it has them.

    Blocks send their different words by a hash, compressed, a row for each part of the hash range;
    a part sums up its words and answers with numbers for those that are frequent in their language.
    """
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-total // part_words))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, words, counts in zip(*(batch.column(c) for c in ("block", "lang", "words", "counts")), strict=True):
                known, counts = words.values, counts.values.to_numpy()
                texts = known.to_pylist()
                part = np.fromiter((zlib.crc32(w.encode()) % parts for w in texts), np.int64, len(texts))
                part[counts == 0] = -1
                rows = []
                for p in np.unique(part[part >= 0]).tolist():
                    at = np.flatnonzero(part == p)
                    own = _BREAK.join([texts[i] for i in at.tolist()]).encode()
                    rows.append((p, [zstandard.ZstdCompressor(level=1).compress(own), shrink(at.astype(np.int32), True), shrink(counts[at])]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in rows], pa.int32()), pa.array([block.as_py()] * len(rows), pa.int64()),
                        pa.array([lang.as_py()] * len(rows), pa.string()), pa.array([c for _, c in rows], pa.list_(pa.binary())),
                    ], ["part", "block", "lang", "sent"],
                )

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        sent = table.column("sent").to_pylist()
        texts = [zstandard.ZstdDecompressor().decompress(x[0]).decode() for x in sent]
        words = pc.split_pattern(pa.array(texts, pa.large_string()), _BREAK)
        sizes = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        width = len(coded.dictionary)
        both = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes) * width + coded.indices.to_numpy()
        counts = np.concatenate([unshrink(x[2], "<i8") for x in sent])
        different, at = np.unique(both, return_inverse=True)
        f = np.bincount(at, counts).astype(np.int64)
        often = f >= least
        ids = np.where(often, (np.cumsum(often) - 1) * parts + part + 1, 0)
        if len(ids) and ids.max() >= 1 << 31:
            raise OverflowError("more frequent words than numbers of 32 bits; raise part_words")
        told, ends = [], np.cumsum(sizes)
        for block, x, end, n in zip(table.column("block").to_pylist(), sent, ends.tolist(), sizes.tolist(), strict=True):
            own = ids[at[end - n : end]]
            known = own > 0
            told.append((block, [shrink(unshrink(x[1], "<i4", True)[known]), shrink(own[known].astype(np.int32))] if known.any() else []))
        listed = []
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            here = often & (different // width == i)
            if here.any():
                listed.append((lang, coded.dictionary.take(pa.array(different[here] % width)).to_pylist(), f[here], ids[here]))
        return pa.table(
            [
                pa.array([b for b, _ in told] + [None] * len(listed), pa.int64()),
                pa.array([a for _, a in told] + [None] * len(listed), pa.list_(pa.binary())),
                pa.array([None] * len(told) + [r[0] for r in listed], pa.string()),
                *(pa.array([None] * len(told) + [r[i] for r in listed], pa.list_(t)) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int32()))),
            ], ["block", "answer", "lang", "word", "f", "id"],
        )

    sent = blocks.select("block", "lang", "words", "counts").mapInArrow(send, "part int, block long, lang string, sent array<binary>")
    told, _ = stored(
        sent.groupBy("part").applyInArrow(judge, "block long, answer array<binary>, lang string, word array<string>, f array<long>, id array<int>")
    )
    listed = told.filter("block IS NULL").select("lang", F.inline(F.arrays_zip("word", "f", "id")))
    return listed, told.filter("block IS NOT NULL AND size(answer) > 0").select(F.col("block").alias("of"), "answer")


def _coded(blocks: DataFrame, told: DataFrame, longest: int) -> DataFrame:
    """(block, ids, n, sample): word numbers of the whole corpus, 0 for a break or a rare word."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        at = unshrink(own.column("at")[0].as_py(), "<i4")
        ids = np.zeros(int(at.max()) + 1, np.int32)
        for answer in told.column("answer").to_pylist():
            ids[unshrink(answer[0], "<i4") + 1] = unshrink(answer[1], "<i4")
        ids = ids[at]
        ids = ids[(ids > 0) | (np.concatenate([[0], ids[:-1]]) > 0)]  # one 0 says as much as several
        rows = suffixes(ids, longest)
        number = own.column("block")[0].as_py()
        some = np.random.default_rng(number).integers(0, max(1, rows.shape[1]), SAMPLE_SUFFIXES if rows.shape[1] else 0)
        row = [number, shrink(ids) if len(ids) else b"", rows.shape[1], rows[:, some].T.tobytes()]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "ids", "n", "sample"])

    return blocks.select("block", "at").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(
        run, "block long, ids binary, n long, sample binary"
    )


def _marks(coded: DataFrame, longest: int, range_suffixes: int) -> np.ndarray:
    """Where ranges begin: suffixes of a bounded sample, in order."""
    total = coded.agg(F.sum("n")).first()[0] or 0
    wanted = -(-total // range_suffixes) - 1
    rows = coded.filter("n > 0").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).select("sample").collect()
    if wanted < 1 or not rows:
        return np.zeros((0, longest), np.int32)
    sample = np.concatenate([np.frombuffer(r.sample, np.int32).reshape(-1, longest) for r in rows]).T
    sample, _ = merged(sample, np.ones(sample.shape[1], np.int64))
    at = np.linspace(0, sample.shape[1], min(wanted, sample.shape[1]) + 2)[1:-1].astype(np.int64)
    return sample[:, np.unique(at)].T


def _phrases(coded: DataFrame, longest: int, least: int, range_suffixes: int) -> DataFrame:
    """(ids, f) of all phrases of two words and more that occur often enough."""
    marks = _marks(coded, longest, range_suffixes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                rows = suffixes(unshrink(data, "<i4"), longest) if data else np.zeros((longest, 0), np.int32)
                rows, weight = merged(rows, np.ones(rows.shape[1], np.int64))
                cuts = [0, *(below(rows, m) for m in marks), rows.shape[1]]
                full = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
                parts = [slice(cuts[i], cuts[i + 1]) for i in full]
                if full:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full, pa.int32()),
                            pa.array(
                                [[shrink(rows[0, p], True), *(shrink(np.ascontiguousarray(r[p])) for r in rows[1:]), shrink(weight[p])]
                                 for p in parts], pa.list_(pa.binary()),
                            ),
                        ], ["range", "columns"],
                    )

    def mine(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        parts = [c.as_py() for c in table.column("columns")]
        rows = np.stack([np.concatenate([unshrink(p[d], "<i4", d == 0) for p in parts]) for d in range(longest)])
        weight = np.concatenate([unshrink(p[longest], "<i8") for p in parts])
        found = phrases_of(rows, weight, least, marks[i - 1] if i else None, marks[i] if i < len(marks) else None)
        return pa.table(
            [pa.array([w for w, _ in found], pa.list_(pa.int32())), pa.array([m for _, m in found], pa.int64())], ["ids", "f"]
        )

    routed = coded.select("ids").mapInArrow(route, "range int, columns array<binary>")
    found = routed.groupBy("range").applyInArrow(mine, "ids array<int>, f long")
    return found.groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP,
    block_bytes: int = BLOCK_BYTES, range_suffixes: int = RANGE_SUFFIXES, part_words: int = PART_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score.

    A phrase of 2 to ``longest`` words within a piece is a candidate if it occurs ``least`` times.
    Its score is that of the lowest cut, 1000 a n / (l r) rounded down, ties to the first cut;
    it goes if a longer candidate that holds it occurs as often. Ties in score go by count, then
    by the phrase's bytes. A null language is ``und``, a null text empty; repeated rows count each.
    An empty table, or one without frequent phrases, gives no rows. Other columns are left out,
    whatever their names.
    """
    blocks, _ = stored(_blocks(docs, text, lang, block_bytes))
    size = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("c"))
    size = size.groupBy("lang").agg(F.sum("c").alias("n"))
    vocabulary, told = _vocabulary(blocks, least, part_words)
    coded, _ = stored(_coded(blocks, told, longest))
    phrases, _ = stored(_phrases(coded, longest, least, range_suffixes))

    counts = phrases.unionByName(vocabulary.select(F.array("id").alias("ids"), "f"))
    sides = phrases.select(
        "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    ).withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    both = sides.join(counts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(
        counts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right"
    )
    # The first word tells the language, whose size the score needs.
    sized = vocabulary.join(size, "lang").select(F.col("id").alias("first"), "lang", "n")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("first", F.get("ids", F.lit(0))).join(sized, "first").withColumns(
        {"p": F.lit(1000).cast("decimal(5,0)") * F.col("a").cast("decimal(14,0)"), "q": wide("l") * wide("r")}
    )
    scored = scored.withColumn("score", F.expr("(cast(p as decimal(19,0)) * cast(n as decimal(19,0))) div q"))
    lowest = scored.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter(F.size("ids") > 2)
    inside = F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))
    held = longer.select(F.explode(inside).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = lowest.join(held, "ids", "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = kept.join(spelled.select("ids", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")), "ids")
    named = named.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's first places lie among the first places of its parts.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = named.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
