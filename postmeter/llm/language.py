"""Language ID with a blended-spectrum string kernel.

The kernel of two texts counts the byte n-grams of 1 to 4 that both hold, each length
normalised. Nyström landmarks turn it into a feature map, one-versus-rest kernel ridge
regression learns the languages, and texts are scored in blocks by matrix products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents that training may take; the rest of the corpus is only scored.
SAMPLE_ROWS = 3000
#: Hashes are ranked within slices by so many leading bits.
PART_BITS = 12
LANDMARKS = 192
GRAMS = 6000
LENGTHS = (1, 2, 3, 4)
SLOTS = 1 << 18
UNKNOWN = "und"



@dataclass(frozen=True)
class Model:
    grams: np.ndarray
    table: np.ndarray
    spans: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    languages: tuple[str, ...]


def codes(text: str, n: int) -> np.ndarray:
    """Each byte n-gram as a number that also holds its length."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint64)
    out = np.full(max(0, len(raw) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | raw[i : len(raw) - n + 1 + i]
    return out


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams that most landmarks hold, a table from slot to n-gram, and each length's span."""
    chosen: dict[int, list[int]] = {n: [] for n in LENGTHS}
    taken: set[int] = set()
    for n in LENGTHS:
        seen = Counter(c for t in texts for c in np.unique(codes(t, n)).tolist())
        # One n-gram for a slot; the more frequent ones come first.
        for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            slot = int(_slot(np.array([c], np.uint64))[0])
            if len(chosen[n]) >= GRAMS // len(LENGTHS):
                break
            if slot not in taken:
                taken.add(slot)
                chosen[n].append(c)
    grams = np.array([c for n in LENGTHS for c in chosen[n]], np.uint64)
    spans = np.repeat(np.arange(len(LENGTHS)), [len(chosen[n]) for n in LENGTHS])
    table = np.zeros(SLOTS, np.int32)
    table[_slot(grams)] = np.arange(len(grams))
    return grams, table, spans


def presence(texts: list[str], grams: np.ndarray, table: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """A row for each text: 1 for held n-grams, each length scaled to norm 1."""
    out = np.zeros((len(texts), len(grams)), np.float32)
    for row, text in zip(out, texts, strict=True):
        for n in LENGTHS:
            code = codes(text, n)
            at = table[_slot(code)]
            row[at[grams[at] == code]] = 1
    for k in range(len(LENGTHS)):
        own = spans == k
        out[:, own] /= np.sqrt(np.maximum(1, out[:, own].sum(axis=1, keepdims=True)))
    return out


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model | None:
    """Kernel ridge regression, one language against the rest, on the landmarks' feature map.

    Each text is also learned as two pieces of a few words, as short texts occur.
    """
    languages = tuple(sorted({lang for _, lang in sample}))
    if not languages:
        return None
    rng = np.random.default_rng(4)
    texts, target = [], []
    for text, lang in sample:
        words = text.split()
        pieces = [text]
        for _ in range(2):
            at = int(rng.integers(0, max(1, len(words))))
            pieces.append(" ".join(words[at : at + int(rng.integers(1, 7))]))
        texts += pieces
        target += [languages.index(lang)] * len(pieces)
    by_language = [[i for i in range(0, len(texts), 3) if target[i] == k] for k in range(len(languages))]
    each = max(2, landmarks // len(languages))
    marks = [texts[i] for own in by_language for i in own[:each]]
    grams, table, spans = vocabulary(marks)
    points = presence(marks, grams, table, spans)
    kernel = (points @ points.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.concatenate(
        [presence(texts[i : i + 256], grams, table, spans) @ points.T for i in range(0, len(texts), 256)]
    ) @ root
    y = np.where(np.arange(len(languages))[None, :] == np.array(target)[:, None], 1.0, -1.0)
    mean, centre = x.mean(axis=0), y.mean(axis=0)
    x -= mean
    w = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (y - centre))
    return Model(grams, table, spans, points.T.copy(), (root @ w).astype(np.float32), centre - mean @ w, languages)


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    kernel = presence(texts, model.grams, model.table, model.spans) @ model.landmarks
    margin = kernel @ model.weights + model.bias
    best = margin.argmax(axis=1)
    sure = np.clip((1 + margin[np.arange(len(texts)), best]) / 2, 0, 1)
    return [model.languages[k] for k in best], sure


def sample(docs: DataFrame, text: str, lang: str, rows: int) -> list[tuple[str, str]]:
    """At most ``rows`` different (text, language), ordered by a hash of the text.

    The languages take turns, each by the order of the hash, so none is left out while there are
    fewer languages than rows, and what a rare one leaves goes to the others. Hashes are ranked
    alone, by slices of which only the first ones are needed; copies count once.
    """
    known = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    known = known.withColumn("h", F.xxhash64("t"))
    hashes = known.select("l", "h").distinct().withColumn("part", F.shiftright("h", 64 - PART_BITS))
    before = Window.partitionBy("l").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = hashes.groupBy("l", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    first = hashes.join(parts.filter(F.col("before") < rows).select("l", "part"), ["l", "part"])
    chosen = first.withColumn("turn", turn).orderBy("turn", "h", "l").limit(rows).select("l", "h")
    found = known.join(chosen, ["l", "h"], "left_semi").distinct().collect()
    return [(r.t, r.l) for r in sorted(found, key=lambda r: (r.h, r.t, r.l))]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on at most ``sample_rows`` different texts that have a language, spread over the languages."""
    return fit(sample(docs, text, lang, sample_rows))


def languages(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row, over the whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned; number signs
    of any script are no letters. Ties go to the language that sorts first; repeated rows are each
    scored, an empty table gives no rows, other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                found, sure = predict([texts[i] for i in part], model)
                score[part] = sure
                for i, name in zip(part, found, strict=True):
                    named[i] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named), pa.array(score)], ["k", "l", "s"])

    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return plain.mapInArrow(run, f"k {kind}, l string, s double").select(
        F.col("k").alias(key), F.col("l").alias("lang_pred"), F.col("s").alias("score")
    )
