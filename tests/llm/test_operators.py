"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from postmeter.llm import (
    decontaminate,
    language,
    licenses,
    modelling,
    neardup,
    packing,
    sharding,
    shared,
    simhash,
    substrings,
    toxicity,
)
from postmeter.llm.bytelevel import byte_level

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans(licenses.UPPER, licenses.LOWER)


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def closure(nodes, links):
    """Smallest node that each reaches."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


# 1 ---------------------------------------------------------------------------------------------


def test_licenses_places(docs):
    base = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for r in licenses.scan_licenses(docs.select("doc_id", "text")).collect():
        own = words(r.text)
        hits = sorted((i, n) for n, p in base.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        assert r.n_words == len(own) and r.n_base == len(hits)
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({n for _, n in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(hits)


def test_licenses_method(spark, docs, empty):
    text = "x " + "redistribution and use in source and binary forms are allowed, mit only"
    df = spark.createDataFrame([(1, text), (2, "mit license under the"), (3, "gnu general public license version 3")], "a int, text string")
    got = {r.a: r for r in licenses.scan_licenses(df).collect()}
    assert got[1].labels == "bsd" and 0 < got[1].score < 1 and [tuple(p) for p in got[1].places] == [("bsd", 1)]
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "gpl-3" and got[3].score < 1  # the notice begins in front of the text
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs).count() == docs.count()


def test_licenses_is_native(docs):
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("InMemoryRelation")[0])


# 2 ---------------------------------------------------------------------------------------------


def vectors(spark, n=300, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, dim))
    x = np.concatenate([base, *[base + s * rng.standard_normal(base.shape) for s in (0.02, 0.1, 0.2, 0.25, 0.3)]])
    rows = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, [1.0, None], 1), (904, [], None)]
    rows += [(905, [float("inf")] * dim, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, rows[0][1], 7), (908, rows[0][1], 7)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


@pytest.mark.parametrize("block", [2048, 40])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    df, rows = vectors(spark)
    if block == 40:  # one bucket for all: dealt out as pairs of blocks
        monkeypatch.setattr(neardup.math, "log2", lambda n: 0)
        monkeypatch.setattr(neardup, "planes", lambda dim, bits, tables: np.zeros((dim, bits * tables), np.float32))
    fine = []
    for i, (_, v, _) in enumerate(rows):
        v = None if v is None or any(c is None for c in v) else np.array(np.array(v, np.float32), float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            fine.append((i, v / np.linalg.norm(v)))
    links = [(a, b) for k, (a, x) in enumerate(fine) for b, y in fine[:k] if len(x) == len(y) and x @ y >= 0.95]
    count = Counter(k for pair in links for k in pair)
    root = closure([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    want = sorted((r[0], count[i], root[r[0]], r[0] == root[r[0]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == want


def test_near_duplicates_empty(spark):
    df, _ = vectors(spark)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.near_duplicates(df.filter("vec_id BETWEEN 900 AND 905")).filter("kept AND n_links = 0").count() == 6


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    y = x + rng.standard_normal(x.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    code, factor = neardup.encode(x)
    value, bound = neardup.estimate(code, factor, y.astype(np.float32) @ neardup.rotation(64))
    error = value - np.einsum("ij,ij->i", x, y)
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).all()


# 3 ---------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    syllables = ["ka", "lo", "mi", "ter", "san", "du", "vel", "pri"]

    def text(bad):
        own = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(80)]
        for _ in range(3 * bad):
            own[rng.integers(80)] = str(rng.choice(["horrid", "wretch", "vermin"]))
        return " ".join(own)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, "toxic")
    got = {r.doc_id: r.score for r in toxicity.toxicity(df, model).collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in rows if i >= 400]
    assert np.mean(held) > 0.95
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in odd)
    assert toxicity.toxicity(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0), "toxic")
    assert none is None and {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}


# 4 ---------------------------------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    rows = [(i, f"p{i // 2} " * (1 + i // 2 * 37 % 20)) for i in range(3000)] + [(i, "copy of one text") for i in range(3000, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shards(df).toPandas()
    sums = got.groupby("shard").agg(bytes=("size", "sum"), rows=("size", "count"), last=("slot", "max"), slots=("slot", "nunique"))
    assert len(got) == len(rows) and len(sums) == sharding.SHARDS
    assert (sums["last"] + 1 == sums["rows"]).all() and (sums["slots"] == sums["rows"]).all()
    for c in ("bytes", "rows"):
        assert sums[c].max() < 1.03 * sums[c].mean() and sums[c].min() > 0.97 * sums[c].mean()
    texts = dict(rows)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got.to_dict("records"))
    shards = defaultdict(set)
    for i, s in zip(got["doc_id"], got["shard"], strict=True):
        shards[texts[i]].add(s)
    assert all(len(s) == 1 for t, s in shards.items() if t != "copy of one text")
    odd = sharding.shards(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r["shard"] < 24 for r in odd)
    assert {r["size"] for r in odd if r["doc_id"] in (3, 4)} == {8}
    assert sharding.shards(empty).count() == 0


# 5 ---------------------------------------------------------------------------------------------


def brute_substrings(rows, n=50):
    rows = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            first[w] = min(first.get(w, math.inf), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((None if i == math.inf else i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2_000_000, 5_000])
def test_substrings(docs, spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "BATCH_BYTES", size)
    rng = np.random.default_rng(7)
    shared_text = ["".join(rng.choice(list("abcdé \n"), 90)) for _ in range(6)]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):
        parts = [str(rng.choice(shared_text)) if rng.random() < 0.4 else "".join(rng.choice(list("xyzü "), 70)) for _ in range(4)]
        rows.append((100 + i * 10**15, "".join(parts)[int(rng.integers(40)) :]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup_substrings(df).collect()), key=str) == brute_substrings(rows)


def test_substrings_keep_columns(docs, empty):
    kept = substrings.without_repeats(docs, length="n_chars")
    assert kept.columns == docs.columns and substrings.without_repeats(empty).count() == 0
    got = {(r.doc_id, r.source): r for r in kept.collect()}
    assert got[4, None].text is None and got[3, None].text == "" and got[1, None].n_chars is None
    assert (2, "s") not in got and got[6, None].n_chars == len(got[6, None].text) < 60


def test_substrings_hash_what_is_left(monkeypatch):
    """Texts are hashed as a whole in two steps; the steps after them see the runs that are left."""
    chars = np.random.default_rng(3).integers(97, 123, (6, 4000), dtype=np.uint8)
    chars[3:, 1000:1500] = chars[:3, 500:1000]
    texts = [c.tobytes().decode() for c in chars] + ["", None, "short"]
    column = pa.chunked_array([texts[:4], texts[4:]], pa.string())
    raw, offsets = shared.text_bytes(column)
    assert raw.tobytes() == b"".join((t or "").encode() for t in texts)
    assert offsets.tolist() == [0, *np.cumsum([len(t or "") for t in texts]).tolist()]
    batch = substrings.Batch(pd.Series(range(9)), column)
    monkeypatch.setattr(substrings, "CHUNK", 64)
    cut = substrings.Batch(pd.Series(range(9)), column)
    assert all((getattr(batch, n) == getattr(cut, n)).all() for n in ("grams", "head", "size", "low", "rank"))
    asked = [substrings._split(0, 2, batch.values, more=batch.shared()).to_pandas()]
    flags = substrings._in_several(asked[0]).assign(step=1)
    one, two, note = substrings._refined(batch, flags)
    sent = substrings._split(0, 2, one, two, note=note).to_pandas()
    for _, rows in sent.groupby("part"):
        flags = pd.concat([flags, substrings._in_lower_batch(rows).assign(step=2)])
    seen = []
    monkeypatch.setattr(substrings, "identifiers", lambda r, f=substrings.identifiers: seen.append(len(r)) or f(r))
    (head, size), left = substrings._undecided(flags)
    window, *_ = substrings.strings(raw, *left)
    whole = {int(w) for h, n in zip(head, size, strict=True) for w in range(h, h + n)}
    found = whole | set(window.tolist())
    wanted = {4000 * i + 1000 + j for i in (3, 4, 5) for j in range(451)}
    assert whole <= wanted <= found and 0 < sum(seen) < 0.1 * len(raw)


# 6 ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    grams = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [b" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(docs, spark):
    for r in docs.select("text").distinct().collect():
        assert simhash.fingerprint(r.text) == brute_fingerprint(r.text)
    h = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert simhash.fingerprint("A b C") == h % (1 << 64)


@pytest.mark.parametrize("again", [2048, 4])
def test_simhash_links(spark, monkeypatch, again):
    monkeypatch.setattr(simhash, "CUT_AGAIN", again)
    rng = np.random.default_rng(9)
    fps = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 12).tolist() + [0]:
        for _ in range(30):
            flips = rng.choice(64, int(rng.integers(0, 6)), replace=False)
            v = base % 2**64
            for f in flips.tolist():
                v ^= 1 << f
            fps.add(v - 2**64 if v >> 63 else v)
    fps = sorted(fps)
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 3]
    found = [tuple(r) for r in links.collect()]
    assert closure(fps, found) == closure(fps, pairs)
    got = {r.node: r.root for r in shared.components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == closure(fps, pairs)


def test_simhash_classes(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    n = range(len(rows))
    root = closure(n, [(a, b) for a in n for b in n if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    low = {r: min((rows[k].doc_id for k in n if root[k] == r and rows[k].doc_id is not None), default=None) for r in set(root.values())}
    want = sorted(((rows[k].doc_id, prints[k] % 2**64, low[root[k]]) for k in n), key=str)
    got = simhash.simhash_classes(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    kept = simhash.one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))
    assert simhash.one_per_class(empty).count() == 0


def unlike(n, seed=3):
    """Texts of which no two are near copies."""
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)) for _ in range(n)]


def test_simhash_null_and_repeated_keys(spark):
    a, b, c, d, e = unlike(5)
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (8, e)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in simhash.one_per_class(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (None, c), (7, d), (7, e)], key=str)


# 7 ---------------------------------------------------------------------------------------------


def test_contamination(docs, spark, empty):
    items = [(1, "The river runs past the OLD mill, and the miller counts his sacks before the first frost"), (20, "x"),
             (3, "under the mit license"), (3, "nothing of the kind at all"), (4, None), (5, ""), (None, "x"), (6, "word1 and 1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, t in items:
        own = words(t)
        n = min(13, len(own))
        if i is not None:
            windows += [(str(i), own[s : s + n]) for s in range(len(own) - n + 1) if n]
    want = []
    for r in docs.select("doc_id", "text").collect():
        own, hit, found = words(r.text), set(), set()
        for i, w in windows:
            for s in range(len(own) - len(w) + 1):
                if own[s : s + len(w)] == w:
                    hit.update(range(s, s + len(w)))
                    found.add(i)
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((r.doc_id, len(own), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(own)))
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.without_contaminated(docs, bench)
    bad = {w[0] for w in want if w[5]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want} - bad
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_contamination_by_items_without_id(spark):
    leak, both, clean = unlike(3)
    df = spark.createDataFrame([(1, leak), (2, both), (3, clean)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, leak), (None, both), (9, both)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(df, bench).collect())
    sha = [hashlib.sha256(t).hexdigest() for t in (b"", b"9")]
    assert got == [(1, 40, 40, 0, sha[0], True), (2, 40, 40, 1, sha[1], True), (3, 40, 0, 0, sha[0], False)]
    assert [r.doc_id for r in decontaminate.without_contaminated_rows(df, bench).collect()] == [3]


def test_contaminated_rows_go_alone(docs, spark, empty):
    import corpus_pipeline

    bad, *clean = unlike(4)
    rows = [(None, bad), (None, clean[0]), (None, None), (7, bad), (7, clean[1]), (8, clean[2]), (8, clean[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    kept = [tuple(r) for r in decontaminate.without_contaminated_rows(df, bench).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != bad], key=str)
    assert decontaminate.without_contaminated_rows(docs, bench).columns == docs.columns
    assert decontaminate.without_contaminated_rows(empty, bench).count() == 0
    folder = tempfile.mkdtemp(prefix="bench-")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.contaminated(spark, df, folder).count() == 5


# 8 ---------------------------------------------------------------------------------------------


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(docs).toPandas()
    ids = [tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.select("text").collect()]
    want = Counter()
    for own in ids:
        for n, (s, k) in enumerate(packing.cut(len(own))):
            want[n, s, k, zlib.crc32(np.array(own[s : s + k], "<u4").tobytes())] += 1
    assert Counter(map(tuple, got[["piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    assert packing.pack(empty).count() == 0


def test_encoder_on_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "a  b\n\n c", "\n x\t\ty ", "it's  1,000  z", "a\x0b b", "   ", "Übergrößenträger ça, ǅ ʼn z²Ⅷ x_y don't ÿ×÷.", " \u00adsoft\u0301 ﬁn", "x   y", "<|endoftext|> a", "a \u2003b\u3000 c\u1680 d\u2028\n e\u205f f\u202f\n", "é à\r\n\r\nü"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [ids.astype("<u4").tobytes() for ids in byte_level(path, special=True).encode(texts)] == want


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(11)
    counts = np.zeros(1025, np.int64)
    for n in np.minimum(1024, rng.lognormal(5.3, 1.0, 20000).astype(int) + 1):
        counts[n] += 1
    made = packing.plan(counts)
    held = sum(h * n for h, n in made)
    assert (held == counts).all() and all((h * np.arange(1025)).sum() <= 1024 for h, _ in made)
    assert sum(n for _, n in made) <= 1.005 * (counts * np.arange(1025)).sum() / 1024 + 1


def test_knapsack():
    weights = np.zeros(21)
    weights[[3, 5, 7]] = 3.1, 5.4, 7.2
    held = packing.best_configuration(weights, 20)
    best = max(a * 3.1 + b * 5.4 + c * 7.2 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert math.isclose((held * weights).sum(), best) and (held * np.arange(21)).sum() <= 20


# 9 ---------------------------------------------------------------------------------------------


class BruteTree:
    """Context-tree weighting node by node, by its definition."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for context, y in self.symbols(texts):
            for d in range(depth + 1):
                for b in range(8):
                    self.counts[context[:d], (1 << b) | (y >> (8 - b))][y >> (7 - b) & 1] += 1
        self.below = defaultdict(set)
        for context, code in list(self.counts):
            if context:
                self.below[context[:-1], code].add((context, code))

    def symbols(self, texts):
        for t in texts:
            raw = b"\0" * self.depth + t + b"\0"
            for i in range(self.depth, len(raw)):
                yield raw[i - self.depth : i][::-1], raw[i]

    def kt(self, node):
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(self, node):
        if len(node[0]) == self.depth:
            return self.kt(node)
        rest = sum(self.weighted(n) for n in self.below.get(node, ()))
        return math.log(0.5) + np.logaddexp(self.kt(node), rest)

    def log10(self, text):
        total = 0.0
        for context, y in self.symbols([text]):
            for b in range(8):
                code, p = (1 << b) | (y >> (8 - b)), None
                for d in range(self.depth, -1, -1):
                    node = (context[:d], code)
                    n = self.counts.get(node, (0, 0))
                    own = (n[y >> (7 - b) & 1] + 0.5) / (sum(n) + 1)
                    share = 1.0 if p is None else math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
                    p = own if p is None else share * own + (1 - share) * p
                total += math.log10(p)
        return total


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_scores(docs, spark, empty, monkeypatch, size):
    monkeypatch.setattr(modelling, "BATCH_BYTES", size)
    rows = [tuple(r) for r in docs.select("doc_id", "text").filter("length(text) < 400 OR text IS NULL").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = [(t or "").encode() for i, t in rows if i is not None and i % 3]
    tree, counts = BruteTree(seen, modelling.DEPTH), Counter()
    for t in seen:
        counts.update([*t.lower().split(), "end"])
    n = sum(counts.values())
    got = sorted(map(tuple, modelling.score_texts(df, df.doc_id % 3 != 0).collect()), key=str)
    want = []
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in own)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), n, base, tree.log10((t or "").encode())))
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-4)


def test_scores_without_training(docs, empty):
    from pyspark.sql import functions as F

    assert modelling.score_texts(empty, F.lit(True)).count() == 0
    got = modelling.score_texts(docs, F.lit(None).cast("boolean")).filter("doc_id = 3").first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (1, 0, 0)
    assert got.base_score == 0 and math.isclose(got.score, 8 * math.log10(0.5), rel_tol=1e-6)


def test_modelling_work_per_string(monkeypatch):
    """Strings and words of a batch against plain Python; the tree makes each string distinct once for a depth."""
    rng = np.random.default_rng(5)
    texts = ["", None, "a", "\x00\x00", "Ab\x0b\x1cÉ É x\tab\r\n", "".join(rng.choice(list("abcd \n"), 40_000))] + ["xy z"] * 3
    raw, offsets = shared.text_bytes(pa.chunked_array([texts[:3], texts[3:]], pa.string()))
    whole = [(t or "").encode() for t in texts]
    wanted = []
    for i, t in enumerate(whole):
        padded = bytes(modelling.DEPTH) + t + b"\0"
        for p in range(modelling.DEPTH, len(padded)):
            wanted.append((int.from_bytes(padded[p - modelling.DEPTH : p][::-1] + padded[p : p + 1]), i))
    keys, starts, text = modelling.grams(raw, offsets)
    assert sorted(wanted) == list(zip(np.repeat(keys, np.diff(np.append(starts, len(text)))).tolist(), text.tolist(), strict=True))
    distinct, index, sizes = modelling.words(raw, offsets)
    split = [t.lower().split() for t in whole]
    assert distinct.to_pylist() == sorted({w for ws in split for w in ws}) and sizes.tolist() == [len(ws) for ws in split]
    assert [distinct[i].as_py() for i in index.tolist()] == [w for ws in split for w in ws]
    asked = []
    monkeypatch.setattr(np, "unique", lambda x, *a, f=np.unique, **b: asked.append(len(x)) or f(x, *a, **b))
    tree = modelling.Tree(keys, np.diff(np.append(starts, len(text))))
    assert sum(asked) < modelling.DEPTH * len(keys)
    assert tree.tops()[["zeros", "ones"]].to_numpy().sum() == 8 * len(text)


def test_modelling_large_counts():
    zeros, ones = np.array([0.0, 3.0, 5000.0, 4095.0, 1e9]), np.array([0.0, 4.0, 0.0, 1.0, 7.0])
    wanted = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(zeros, ones, strict=True)]
    assert modelling.log_kt(zeros, ones) == pytest.approx(wanted, rel=1e-6, abs=1e-9)


# 10 --------------------------------------------------------------------------------------------


def test_language(spark, docs, empty):
    rng = np.random.default_rng(4)
    stems = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["schu", "ver", "ung", "ein"], "cc": ["ção", "lhe", "nte", "ou"]}
    rows = [
        (i, " ".join("".join(rng.choice(stems[s], 2)) for _ in range(int(rng.integers(1, 60)))), s)
        for i in range(600)
        for s in [list(stems)[i % 3]]
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.filter("doc_id < 300"))
    got = {r.doc_id: r.lang_pred for r in language.languages(df.drop("lang"), model).collect()}
    assert np.mean([got[i] == s for i, _, s in rows if i >= 300]) > 0.97
    odd = {r.doc_id: r for r in language.languages(docs, model).collect() if r.doc_id}
    assert {odd[i].lang_pred for i in (3, 4, 10)} == {"und"} and odd[7].lang_pred in stems and 0 <= odd[7].score <= 1
    signs = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² 7", "Ⅷ", "①", "٣", "_-·", "7 ª", "x"])], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language.languages(signs, model).collect()}
    assert {found[i] for i in range(5)} == {"und"} and "und" not in (found[5], found[6])
    assert language.languages(empty, model).count() == 0
    assert language.train(empty) is None
    assert {r.lang_pred for r in language.languages(docs, None).collect()} == {"und"}


def test_language_sample_is_spread(spark):
    texts = unlike(40)
    hashed = spark.createDataFrame([(t,) for t in texts], "t string").orderBy(F.xxhash64("t")).collect()
    low, *rest = [r.t for r in hashed]
    rows = [(low, "aa")] * 50 + [(t, "aa") for t in rest[:35]] + [(t, "bb") for t in rest[35:]]
    df = spark.createDataFrame([*rows, (None, "cc"), (low, None)], "text string, lang string").repartition(4)
    got = language.sample(df, "text", "lang", 20)
    count = Counter(s for _, s in got)
    assert len(got) == len(set(got)) == 20 and count == {"aa": 16, "bb": 4}
    assert language.train(df, sample_rows=20).languages == ("aa", "bb")
    assert set(language.sample(df, "text", "lang", 100)) == set(rows)


# helpers ---------------------------------------------------------------------------------------


def test_run_pairs():
    sizes = np.array([1, 4, 2, 7])
    got = [(int(a), int(b)) for i, j in shared.run_pairs(sizes, most=5) for a, b in zip(i, j, strict=True)]
    ends = np.cumsum(sizes)
    want = [(a, b) for e, n in zip(ends, sizes, strict=True) for a in range(e - n, e) for b in range(a + 1, e)]
    assert sorted(got) == sorted(want)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}}


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id", "int(id % 7 = 0) AS v").repartition(5)
    for v, n in ((0, 857), (1, 143)):
        got = sorted(r.number for r in shared.numbered(df, "v", "number").filter(f"v = {v}").collect())
        assert got == list(range(n))


def test_toxicity_takes_one_text_of_an_id(spark):
    """A labelled id that a third of all rows share sends one text to training."""
    rows = [(i, f"plain words {i}" if i % 2 else f"horrid vermin {i}") for i in range(40)] + [(3, f"copy {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.train(df, labels, "toxic") is not None
    texts = df.join(labels, "doc_id").groupBy("doc_id", F.col("toxic").alias("y")).agg(F.min("text").alias("t"))
    assert toxicity.train(df, labels, "toxic") == toxicity.train(texts.selectExpr("doc_id", "t AS text"), labels, "toxic")
