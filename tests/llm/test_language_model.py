"""The language model against a plain version of the whole, exact posteriors of its tables, and the corner cases of the contract."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import language_model as lm
from quarry.llm import queries

WIDE = (1 << 64) - 1


def slow_noise(key, step):
    x = (key + (step + 1) * 0x9E3779B97F4A7C15) & WIDE
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & WIDE
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & WIDE
    return ((x ^ x >> 31) >> 11) * 2.0**-53


def slow_tables(c, a, key, seed, steps=12):
    if c <= 1:
        return c
    b = 2 * a + c - 0.5
    t = min(c, max(1, round(b - math.sqrt(max(0.0, b * b - 2 * (c - 1) - 4 * a * c)))))
    kept = []
    for step in range(steps):
        if slow_noise(key, seed * 2 * steps + 2 * step) * (2 * c - t - 1) < t - 1:
            t -= 1
        if slow_noise(key, seed * 2 * steps + 2 * step + 1) * (a + c - 1 - t / 2) < a:
            t += 1
        if 2 * step >= steps:
            kept.append(t)
    return sum(kept) / len(kept)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def words_of(text):
    return (text or "").encode().lower().split()


def slow_scores(docs, n_dishes):
    """{id: (held_out, n_tokens, n_known, train_tokens, base_score, score)}; the words without a dish are those of the lowest counts."""
    train = [words_of(t) for i, t in docs if not held(i)]
    count = Counter(w for ws in train for w in ws)
    total, distinct = sum(count.values()) + len(train), len(count) + bool(train)
    levels, least, room = Counter(math.floor(math.log2(c) * 16) for w, c in count.items() if len(w) <= 64), 1 << 62, n_dishes - 2
    for level in sorted(levels, reverse=True):
        room -= levels[level]
        if room < 0:
            break
        least = min(c for w, c in count.items() if math.floor(math.log2(c) * 16) == level and len(w) <= 64)
    dishes = sorted((w for w, c in count.items() if c >= least and len(w) <= 64), key=lambda w: (-count[w], w))
    number = {w: i + 2 for i, w in enumerate(dishes)}
    size = len(dishes) + 2
    coded = lambda ws: [number.get(w, 0) for w in ws] + [1]
    pairs = Counter()
    for ws in train:
        cs = coded(ws)
        pairs.update(zip([1, *cs[:-1]], cs, strict=True))
    context = Counter()
    for (v, _), c in pairs.items():
        context[v] += c
    t = {p: 1 for p in pairs}
    models = []
    for turn in range(4):
        by_context, by_word = Counter(), Counter()
        for (v, w), x in t.items():
            by_context[v] += x
            by_word[w] += x
        root = {w: 1 for w in by_word}
        for again in range(4):
            mass = (1 + sum(root.values()) / 2) / size
            root = {w: slow_tables(math.ceil(round(by_word[w], 6)), mass, w, 1000 + 4 * turn + again) for w in by_word}
        open_ = (1 + sum(root.values()) / 2) / size
        p0 = [(max(0, by_word[w] - root.get(w, 0) / 2) + open_) / (1 + sum(by_word.values())) for w in range(size)]
        give = [1 + by_context[v] / 2 for v in range(size)]
        t = {(v, w): slow_tables(c, give[v] * p0[w], v * size + w, turn) for (v, w), c in pairs.items()}
        models.append((give, p0, t))
    assert len(train) == 0 or sum(p0) == pytest.approx(1)

    def probability(v, w):
        c = pairs[v, w]
        return sum(((c - t[v, w] / 2 if c else 0) + give[v] * p0[w]) / (1 + context[v]) for give, p0, t in models[2:]) / 2

    rest = {w: c for w, c in count.items() if w not in number}
    assert all(c == 1 for c in rest.values())  # so each has one table
    share = (1 + len(rest) / 2) / (len(rest) + 1)
    out = {}
    for i, text in docs:
        ws, cs = words_of(text), coded(words_of(text))
        counts = [count[w] for w in ws] + [len(train)]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in counts)
        score = sum(math.log10(probability(v, w)) for v, w in zip([1, *cs[:-1]], cs, strict=True))
        score += sum(math.log10((rest.get(w, 0.5) - 0.5 + share) / (1 + sum(rest.values()))) for w in ws if w not in number)
        out[i] = (held(i), len(cs), sum(c > 0 for c in counts), total, base, score)
    return out


@pytest.mark.parametrize("dishes", [120, lm.DISHES])
def test_whole_model_equals_the_plain_version(spark, sf, dishes):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()
    docs = [(r.doc_id, r.text[:1500]) for r in rows] if dishes < 1000 else [(r.doc_id, r.text) for r in rows]
    if dishes < 1000:  # frequent words, and rare ones that occur once
        docs = [(i, " ".join(w if zlib.crc32(w.encode()) % 9 == 0 and len(w) < 4 else f"{w}-{i}-{k}" if k % 7 == 0 else "the" for k, w in enumerate(t.split()))) for i, t in docs]
    want = slow_scores(docs, dishes)
    got = {r.doc_id: tuple(r)[1:] for r in lm.with_scores(spark.createDataFrame(docs, "doc_id long, text string"), dishes=dishes).collect()}
    assert any(r[0] for r in want.values()) and {i: r[:4] for i, r in got.items()} == {i: r[:4] for i, r in want.items()}
    for i, r in want.items():
        assert got[i][4:] == pytest.approx(r[4:], rel=1e-6)


def test_tables_follow_the_exact_posterior():
    # p(t | c) is proportional to S(c, t) mass^t, with S(c + 1, t) = S(c, t - 1) + (c - t / 2) S(c, t)
    for c, mass in ((2, 0.3), (5, 1.7), (12, 0.05), (40, 6.0), (200, 25.0)):
        s = [0.0, 1.0] + [0.0] * (c + 1)
        for n in range(1, c):
            s = [0.0] + [(s[t - 1] + (n - t / 2) * s[t]) for t in range(1, c + 2)]
            top = max(s)
            s = [x / top for x in s] + [0.0]
        p = np.array([x * mass**t for t, x in enumerate(s)][: c + 1])
        want = (p * np.arange(c + 1)).sum() / p.sum()
        got = lm.tables(np.full(4000, c), np.full(4000, mass), np.arange(4000, dtype=np.uint64), 3, steps=12 + 4 * c).mean()
        assert got == pytest.approx(want, rel=0.02)


def test_probabilities_sum_to_one(spark):
    counts = np.array([5, 3, 9, 4, 1])
    model = lm.Model(np.array([2.0, 1, 3, 2, 1]), np.array([3.0, 1, 2, 2, 1]), counts, 2)
    assert model.root.sum() == pytest.approx(1)
    v = np.array([2, 2, 2])
    keys = v * 5 + np.array([0, 1, 3])
    n, seated = np.array([4, 3, 2]), np.array([1.0, 1, 1])
    every = np.arange(10, 15)
    full_n, full_t = np.zeros(5, dtype=int), np.zeros(5)
    full_n[keys - 10], full_t[keys - 10] = n, seated
    assert model.probability(every, full_n, full_t).sum() == pytest.approx(1)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 1 << 61, 999))
    assert (lm._unpacked_sorted(lm._packed_sorted(x)) == x).all()
    assert lm._unpacked(lm._packed(np.zeros(0, dtype=np.int64))).tolist() == []


def test_many_shards_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    one = {r.doc_id: r.score for r in lm.with_scores(docs).collect()}
    monkeypatch.setattr(lm, "_SHARD", 1000)
    monkeypatch.setattr(lm, "HOT", 5)
    many = {r.doc_id: r.score for r in lm.with_scores(docs).collect()}
    assert many == pytest.approx(one, rel=1e-6)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (None, "Who knows", 4), (4, "who knows", 5), (4, "who knows", 6), (4, "WHO else " * 30_000, 7), (27, "never " + "x" * 100, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.with_scores(docs).collect()))
    known = 0 if held(27) else 2
    assert got == [(0, 3, 3), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 3, 3), (4, 3, 3), (4, 60_001, 60_001), (27, 3, 1 + known)]
    assert lm.with_scores(docs.limit(0)).count() == 0
    alone = next(i for i in range(100) if held(i))
    (only,) = lm.with_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert (only.held_out, only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (True, 3, 0, 0, 0.0) and only.score < 0


def test_held_out_text_is_better_predicted_than_by_the_base(spark):
    found = queries.op12_language_model(spark, "/root/testdata/sf0.01")
    by = {r.held_out: (r.base, r.model) for r in lm.perplexity(found).collect()}
    assert by[True][1] < by[True][0] and by[False][1] < by[False][0]


class Shared:
    def __init__(self, value):
        self.value = value


def test_parts_of_texts_come_back_by_chunk_and_add_up():
    """Rows asked and answered go with chunks and shards, not with texts and shards; sums equal scoring every pair by itself."""
    rng = np.random.default_rng(4)
    size, shards = 50, 7
    planes = lambda c: np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes()
    texts = {int(1000 + i): np.r_[rng.integers(2, size, rng.integers(0, 30)), lm.END] for i in range(300)}
    keys, counts = np.unique(np.concatenate([lm._pairs(c, size) for c in list(texts.values())[::2]]), return_counts=True)
    by_context, by_word = np.bincount(keys // size, minlength=size), np.bincount(keys % size, minlength=size)
    models = [lm.Model(by_context.astype(float), by_word.astype(float), np.bincount(keys // size, weights=counts, minlength=size), 2)]
    hot = keys[counts > 2], np.log10(lm._averaged(models, keys[counts > 2], counts[counts > 2]))
    frames = [lm.pd.DataFrame({"rid": list(texts), "codes": [planes(c) for c in texts.values()]})]
    asked = lm.pd.concat(lm._ask(size, shards, Shared(hot))(iter(frames)))
    assert len(asked) == 1 + shards
    dealt = lm._shards(keys, shards)
    told = []
    for s in range(shards):
        at = dealt == s
        pairs = lm.pd.DataFrame({"shard": [s], "keys": [lm._packed_sorted(keys[at])], "counts": [lm._packed(counts[at])]})
        told.append(lm._answer(Shared(models))(asked[asked["shard"] == s], pairs))
    told = lm.pd.concat(told)
    assert len(told) == len(asked)
    got = lm._add_up(told).set_index("rid")["part"]
    known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    for rid, c in texts.items():
        own = lm._pairs(c, size)
        want = np.log10(lm._averaged(models, own, np.array([known.get(int(k), 0) for k in own]))).sum()
        assert got[rid] == pytest.approx(want, rel=1e-9)
