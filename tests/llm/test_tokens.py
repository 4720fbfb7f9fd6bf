"""Chat formatting, token alignment and collocations against brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmeter.llm import alignment, chat, collocations
from postmeter.llm.licenses import LOWER, UPPER

LOWERED = str.maketrans(UPPER, LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 --------------------------------------------------------------------------------------------

AWKWARD = ["", "<|im_end|>", "<|", "<\\|im_start|>", "<<|im_end|>", "<\\\\|x", "a\n<|im_start|>user\nb<", "{role}{text}", "\\", "|>"]


def test_escape_round_trip():
    rng = random.Random(1)
    texts = AWKWARD + ["".join(rng.choice("<|\\a\n>") for _ in range(rng.randrange(12))) for _ in range(3000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        for role in ("assistant", "user", t):
            said = "assistant" if role == "assistant" else role
            pairs = chat.written(said, t, chat.CHAT)
            assert chat.read_turn(pairs, chat.CHAT) == (said, t, t if said == "assistant" else "")
    assert len({chat.escape(t) for t in texts}) == len(set(texts))
    with pytest.raises(ValueError):
        chat.read_turn([("<|im_start|>user\n<|im_start|>x<|im_end|>\n", False)], chat.CHAT)


def allowed(roles):
    state, fits, states = "start", [], []
    for r in roles:
        nxt = chat.CHAT.steps.get(state, {}).get(r)
        fits.append(nxt is not None)
        state = nxt or (r if r in chat.CHAT.steps else "refused")
        states.append(state)
    return fits, states


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "odd", None]), rng.choice([*AWKWARD, None, "long " * 50]))
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2] if t != 17 else "user", f"turn {t}") for t in range(30)]
    rows += [(None, t, ["user", "assistant"][t % 2], "x<|") for t in range(25)]
    rows += [(101, None, "user", "no turn"), (101, 0, "assistant", "b"), (101, 0, "assistant", "b"), (101, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in "k s n at state segments accepted c x i".split():
        df = df.withColumn(c, df.role)
    return rows, df


@pytest.mark.parametrize("cut", [4096, 7])
def test_chat(talks, cut):
    rows, df = talks
    formatted, long = chat.format_turns(df, slice_turns=cut, share=2)
    assert set(long) == (set() if cut == 4096 else set(long)) and len(long) <= 2
    talk = defaultdict(list)
    for r in rows:
        talk[r[0]].append(r)
    for k in talk:
        talk[k].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    seen = defaultdict(list)
    for r in formatted.collect():
        seen[r.conv_id].append(r)
    assert seen.keys() == talk.keys()
    for k, own in talk.items():
        got = sorted(seen[k], key=lambda r: (r.s is not None, r.s or 0, r.n))
        fits, states = allowed([r[2] or "" for r in own])
        assert [r.accepted for r in got] == fits and [r.state for r in got] == states
        text = "".join(s.text for r in got for s in r.segments)
        assert text.count("<|im_start|>") == len(own) == text.count("<|im_end|>")
    for r in chat.digests(formatted, long).collect():
        own = talk[r.conv_id]
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(s) for x in own for s, _ in chat.written(x[2] or "", x[3] or "", chat.CHAT))
        assert r.valid == all(allowed([x[2] or "" for x in own])[0])
    assert chat.digests(formatted, long).count() == len(talk)


def test_chat_long_ones_are_cut(spark):
    """A third of all turns in one conversation lies in slices; states go on across them."""
    rows = [(1, t, ["user", "assistant"][t % 2], "t") for t in range(500)] + [(i, 0, "user", "t") for i in range(2, 1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted, long = chat.format_turns(df, slice_turns=50, share=100)
    assert long == [1]
    assert formatted.filter("conv_id = 1").select("s").distinct().count() == 10
    assert formatted.filter("not accepted").count() == 0
    none, long = chat.format_turns(df.limit(0))
    assert chat.digests(none, long).count() == 0


# 12 --------------------------------------------------------------------------------------------


def by_hand(pair, text):
    """Tokens of both sides and their groups, cut at the offsets where both sides end."""
    if not text:
        return [], [], []
    whole = (" " + text).encode()
    a = pair.a.own.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    ta, tb = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
    if b"".join(ta) != whole or b"".join(tb) != whole:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
    cuts, out, start = sorted(set(ends_a) & set(ends_b)), [], 0
    for c in cuts:
        out.append(([i for i, e in zip(a, ends_a) if start < e <= c], [i for i, e in zip(b, ends_b) if start < e <= c]))
        start = c
    return a, b, out


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as p

    return alignment.Pair(p.path(alignment.BYTE_LEVEL), p.path(alignment.PIECES))


TEXTS = [
    None, "", " ", "x", "the the the", "naïve café 漢字 🙂🙂 \x00\x07", "a  b\n\n\tc   ", "<|endoftext|> <s> </s>", "▁hidden", "ﬁ ½ Å é",
    "a" * 3000, "Ωmega " * 40, "internationalisation of tokenization " * 30, "\r\n 12345 67,890.5", "=" * 700 + "-" * 333,
]


def test_alignment(spark, pair, docs, empty, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "x"), (None, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for c in "k block pair docs at of c a best held n_a count_sum x t".split():
        df = df.withColumn(c, df.text)
    given = [(r.doc_id, r.text) for r in df.collect()]
    facts, held = [], Counter()
    for _, t in given:
        a, b, cut = by_hand(pair, t)
        links = Counter((x, y) for ga, gb in cut for x in ga for y in gb)
        held.update(links.keys())
        facts.append((a, b, cut, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    want = []
    for (k, _), (a, b, cut, links) in zip(given, facts, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cut)
        best = sum(n for (x, y), n in links.items() if held[x, y] == most[x])
        want.append((k, len(a), len(b), len(cut), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), sha(text) if a else ""))
    assert sum(1 for w in want if w[1] == 0) >= 4 and any(w[1] != w[3] for w in want)
    order = lambda r: tuple((x is not None, x) for x in r)
    for size in (alignment.BLOCK_BYTES, 500):
        got = [tuple(r) for r in alignment.align_tokens(df, block_bytes=size).collect()]
        assert sorted(got, key=order) == sorted(want, key=order)
    assert alignment.align_tokens(df.limit(0)).count() == 0 and alignment.align_tokens(empty).count() == 0


def test_pointer_jumping_and_large_groups(pair, monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends_a, ends_b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, n + 1)), n)) for _ in range(2))
        cuts = np.intersect1d(ends_a, ends_b)
        a, b = alignment.groups(ends_a, ends_b)
        assert (a == np.searchsorted(cuts, ends_a)).all() and (b == np.searchsorted(cuts, ends_b)).all()
    encoded = pair.encode([t or "" for t in TEXTS])
    plain = alignment.align(encoded, pair.sizes)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    counted = alignment.align(encoded, pair.sizes)
    for k in plain:
        assert np.array_equal(plain[k], counted[k]), k


def test_fast_ids_are_the_tokenizers(pair):
    """Random strings of all characters that go the fast way, and of some that do not, special strings included."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from postmeter.llm.bytelevel import byte_level

    rng = random.Random(8)
    common = [*map(chr, range(0x2B0)), *map(chr, range(0x391, 0x460)), *map(chr, range(0x2010, 0x2028)), "€", "<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choices(common, k=rng.randrange(30))) for _ in range(8000)]
    texts += [a + c + b for c in common for a in ("", " ", "x", "1", ".", "\n") for b in (" ", "x", "'s")] + TEXTS[2:]
    own = Tokenizer.from_file(p.path(alignment.BYTE_LEVEL))
    for special in (True, False):
        own.encode_special_tokens = not special
        want = [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in byte_level(p.path(alignment.BYTE_LEVEL), special).encode(texts)] == want


# 13 --------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least, top, longest=5):
    import re

    size, f = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    drop = set()
    for (lang, p), n in f.items():
        for k in range(2, len(p)):
            drop.update((lang, p[i : i + k]) for i in range(len(p) - k + 1) if 100 * n >= 100 * f[lang, p[i : i + k]])
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in drop:
            cuts = [(1000 * a * size[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    found = []
    for lang, own in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            found.append((lang, rank, p.decode(), -a, left, right, size[lang], -s))
    return sorted(found)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    words = ["the", "of", "Mill", "río", "a\x0b", "x", "tab\tbed", "end.", "no,", "Ça", "漢", "\x00"] + [f"w{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))), rng.choice(["en", "de", "fr", None])) for _ in range(700)]
    rows += [("one two three four five six seven", "en")] * 60 + [("a b a b a b", "de")] * 30
    return rows + [(None, "en"), (None, None), ("", "xx"), ("   \t ", "en"), (" ".join(["of"] * 4000), "en"), ("UPPER upper ÄÖ", "und")]


@pytest.mark.parametrize("block, span", [(8 << 20, 1_000_000), (6000, 1500)])
def test_collocations(spark, prose, block, span):
    df = spark.createDataFrame(prose, "text string, lang string")
    for c in "block words word at id f n a rank phrase ids first".split():
        df = df.withColumn(c, df.lang)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=20, top=40, block_bytes=block, range_suffixes=span, part_words=span).collect())
    want = phrases_by_hand(prose, 20, 40)
    assert got == want and {r[0] for r in want} == {"en", "de", "fr", "und"}
    assert collocations.collocations(df.limit(0)).count() == 0


def test_prefixes_in_any_order():
    rng = np.random.default_rng(4)
    for least in (1, 5, 40):
        rows = rng.integers(0, 4, (5, 900)).astype(np.int32)
        for d in range(1, 5):
            rows[d][rows[d - 1] == 0] = 0
        weight = rng.integers(1, 4, 900)
        want = defaultdict(int)
        for col, w in zip(rows.T.tolist(), weight.tolist(), strict=True):
            for d in range(2, 6):
                if all(col[:d]):
                    want[tuple(col[:d])] += w
        want = {k: v for k, v in want.items() if v >= least}
        got = {}
        for d, (at, mass) in enumerate(collocations.frequent_prefixes(rows, weight, least), 2):
            got |= {tuple(w): m for w, m in zip(rows[:d, at].T.tolist(), mass.tolist(), strict=True)}
        assert got == want
        sorted_rows, sums = collocations.merged(rows, weight)
        at = np.array(sorted_rows[:, 100])
        assert collocations.below(sorted_rows, at) == 100 and sums.sum() == weight.sum()


def test_exact_beyond_64_bits(spark):
    """Products of counts are decimals: the largest of them has over a hundred bits."""
    big = 4 * 10**12
    got = spark.sql(
        f"SELECT (cast(cast(1000 as decimal(5,0)) * cast({big}L as decimal(14,0)) as decimal(19,0)) * cast({big * 10**3 + 7}L as decimal(19,0)))"
        f" div (cast({big}L as decimal(19,0)) * cast({big + 3}L as decimal(19,0))) AS s"
    ).first().s
    assert got == 1000 * big * (big * 10**3 + 7) // (big * (big + 3))
