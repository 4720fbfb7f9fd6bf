"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary words and one on words that a frequency
test finds in excess in toxic texts. A window of a text is a single word with its bounds; what the toxic dictionary saves on it against the ordinary one
tells them apart. Shares and counts of windows beyond several thresholds are calibrated into a
score by logistic regression on labelled documents that no dictionary has seen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmeter.llm.shared import TEXTS, release

#: Labelled documents of each class that training may take; the rest of the corpus is only scored.
SAMPLE_ROWS = 2000
THRESHOLDS = (2, 3, 4, 5, 6)
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
LEVEL, MIN_MATCH = 9, 4
#: Windows whose lengths a task keeps while it runs.
KEPT = 1 << 18


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple:
    made = []
    for content in (ordinary, toxic):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), min_match=MIN_MATCH,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        d.precompute_compress(compression_params=p)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return tuple(made)


class _Savings(dict):
    """Bytes that the toxic dictionary saves on a window against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        super().__init__()
        self.both = _compressors(ordinary, toxic)

    def __missing__(self, word: bytes) -> int:
        # zstandard leaves blocks of a few bytes as they are; a repeated word costs a match more.
        window = b" " + (word + b" ") * max(2, -(-24 // (len(word) + 1)))
        one, two = self.both
        value = len(one.compress(window)) - len(two.compress(window))
        if len(self) < KEPT:
            self[word] = value
        return value


@lru_cache(maxsize=2)
def _savings(ordinary: bytes, toxic: bytes) -> _Savings:
    return _Savings(ordinary, toxic)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def features(words: list[bytes], savings: _Savings) -> np.ndarray:
    saved = np.fromiter(map(savings.__getitem__, words), np.int64, len(words))
    counts = np.array([(saved >= t).sum() for t in THRESHOLDS], float)
    most = max(0, saved.max()) if len(saved) else 0
    return np.concatenate([counts / max(1, len(words)) * 100, np.log1p(counts), [min(most, 12), math.log1p(len(words))]])


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little to train on, the distinct samples themselves."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=16, d=6, f=20, accel=1, split_point=1.0)
        return trained.as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 16


def _apart(texts: Iterable[list[bytes]]) -> list[list[bytes]]:
    """Texts without those that share a quarter of their sampled word triples with an earlier one."""
    seen: set[int] = set()
    kept = []
    for words in texts:
        triples = sorted({zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:24]
        if 4 * sum(t in seen for t in triples) < len(triples):
            seen.update(triples)
            kept.append(words)
    return kept


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Dictionaries (ordinary, toxic). The toxic one is trained on the words that toxic texts hold in excess."""
    toxic, ordinary = _apart(toxic), _apart(ordinary)
    in_toxic, in_ordinary = (Counter(w for t in texts for w in set(t)) for texts in (toxic, ordinary))
    n, m = len(toxic), len(ordinary)
    excess = {}
    for word, k in in_toxic.items():
        usual = (in_ordinary[word] + 1) / (m + 1)
        if k >= 4 and len(word) >= 3 and k / n >= 6 * usual and (k - n * usual) / math.sqrt(n * usual + 1) > 3:
            excess[word] = k
    excess = excess or {w: k for w, k in in_toxic.items() if w not in in_ordinary} or {b"-": 1}
    often = Counter(w for t in ordinary for w in t)
    windows = [[b" " + w + b" "] * min(k, 500) for w, k in sorted(excess.items())]
    plain = [[b" " + w + b" "] * min(k, 50) for w, k in sorted(often.items()) if k >= 2]
    rng = np.random.default_rng(3)
    both = []
    for samples, size in ((plain, ORDINARY_BYTES), (windows, TOXIC_BYTES)):
        flat = [s for group in samples for s in group]
        both.append(dictionary([flat[i] for i in rng.permutation(len(flat))[:200_000]], size))
    return both[0], both[1]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> tuple[float, ...]:
    """Weights and intercept by Newton steps on standardised features."""
    mean, scale = np.average(x, 0, weight), np.sqrt(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight)) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    keep = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + keep * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep) + 1e-9, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return (*(w[:-1] / scale), float(w[-1] - (w[:-1] * mean / scale).sum()))


def score(words: list[bytes], model: Model) -> float:
    f = features(words, _savings(model.ordinary, model.toxic))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(f @ model.weights[:-1]) + model.weights[-1]))))


def _scores(texts: pa.Array, model: Model | None) -> list[float]:
    parts = (texts.slice(at, TEXTS).to_pylist() for at in range(0, len(texts), TEXTS))
    return [score(words_of(t), model) if model else 0.0 for part in parts for t in part]


def train(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on at most ``sample_rows`` labelled documents of each class, chosen by a hash.

    Half of them trains the dictionaries, half calibrates. None if a class has under two. An id
    with several labels is toxic if one says so; of several rows of an id one text trains. Ties in
    the hash go to the smaller id; other columns are left out, whatever their names.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    sizes = dict(known.groupBy((F.col("y") > 0).cast("int")).count().collect())
    chosen = None
    for y in (0, 1):
        part = known.filter((F.col("y") > 0) == F.lit(bool(y))).orderBy(F.xxhash64(key), key).limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    # At most twice sample_rows ids, and one text of each, however many rows have it.
    texts = docs.select(F.col(key), F.col(text).alias("t"))
    one = texts.join(F.broadcast(chosen), key).groupBy(key, "y").agg(F.min("t").alias("t"))
    rows = one.select("t", "y", F.xxhash64(key).alias("h")).collect()
    rows.sort(key=lambda r: (r.h, r.y, r.t or ""))
    split: dict[tuple[int, int], list[list[bytes]]] = {(h, y): [] for h in (0, 1) for y in (0, 1)}
    for n, r in enumerate(rows):
        split[n % 2, int(r.y > 0)].append(words_of(r.t))
    if not all(split.values()):
        return None
    ordinary, toxic = train_dictionaries(split[0, 1], split[0, 0])
    savings = _savings(ordinary, toxic)
    held = [(w, y) for y in (0, 1) for w in split[1, y]]
    x = np.array([features(w, savings) for w, _ in held])
    y = np.array([y for _, y in held], float)
    share = [sizes.get(c, 0) / max(1, len(split[1, c])) for c in (0, 1)]
    weight = np.where(y > 0, share[1], share[0])
    return Model(ordinary, toxic, fit_logistic(x, y, weight / weight.mean()))


def toxicity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row; the whole text counts. Null is scored as empty text.

    Without a model (too few labels) the score is 0. Repeated rows are each scored, an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["k", "score"])
        _savings.cache_clear()
        release()

    kind = dict(docs.dtypes)[key]
    plain = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return plain.mapInArrow(run, f"k {kind}, score double").select(F.col("k").alias(key), "score")


def without_toxic(docs: DataFrame, model: Model | None, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose text scores below the limit, with the columns of the input."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(np.array(_scores(part, model)) < limit, pa.bool_())
        _savings.cache_clear()
        release()

    # Only the text goes to Python, and only the verdict comes back.
    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(run, "boolean")(F.col(text)))
