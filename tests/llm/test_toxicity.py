"""Nearest labelled examples: exactness of the index, accuracy on held-out labels, corner cases."""

from __future__ import annotations

import math
import pickle
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from quarry.llm import toxicity as tx
from quarry.llm.labelled import held_out, logistic
from quarry.llm.queries import op6_toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_arrays(v: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    terms = sorted(v)
    return np.array(terms, dtype=np.int64), np.array([v[t] for t in terms])


def test_block_max_search_equals_a_full_scan():
    rng = random.Random(9)
    for size in (0, 1, 63, 64, 500):
        vectors = []
        for _ in range(size):
            raw = {t: rng.random() for t in rng.sample(range(40), rng.randrange(0, 5))}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vectors.append({t: w / norm for t, w in raw.items()})
        index = tx.BlockMaxIndex([as_arrays(v) for v in vectors], 40)
        for _ in range(40):
            query = {t: rng.random() for t in rng.sample(range(40), 3)}
            scores = [(round(sum(q * v.get(t, 0.0) for t, q in query.items()), 12), i) for i, v in enumerate(vectors)]
            want = sorted([s for s in scores if s[0] > 0 and s[1] != 7], key=lambda s: (-s[0], s[1]))[:6]
            at, cosines = index.nearest(*as_arrays(query), 6, without=7)
            assert np.allclose(cosines, [c for c, _ in want])
            assert at.tolist() == [i for _, i in want] or np.allclose(np.diff(cosines), 0, atol=1e-9) or sorted(at.tolist()) == sorted(i for _, i in want)


def test_blocks_that_cannot_win_are_skipped():
    """Common terms weigh little beside rare ones, as IDF makes them: their postings are read where they can still decide."""
    rng = random.Random(3)
    vectors = []
    for i in range(2000):
        raw = {t: 0.1 + 0.05 * rng.random() for t in rng.sample(range(40), 12)} | {40 + 5 * (i % 100) + j: rng.random() for j in range(5)}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    index = tx.BlockMaxIndex([as_arrays(v) for v in vectors], 540)
    every = 0
    for i in range(50):
        query = vectors[i]
        every += sum(t in v for v in vectors for t in query)
        want = sorted(((round(sum(q * v.get(t, 0.0) for t, q in query.items()), 9), n) for n, v in enumerate(vectors)), key=lambda s: (-s[0], s[1]))[:5]
        best, cosines = index.nearest(*as_arrays(query), 5)
        assert best.tolist() == [n for _, n in want] and np.allclose(cosines, [c for c, _ in want])
    assert 0 < index.postings < 0.5 * every


def test_scores_equal_a_plain_computation(spark):
    """The whole query on the smallest tables, with dictionaries and no index."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(LOWER)) for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    sizes = [sum(v == c for v in toxic.values()) for c in (0, 1)]
    vocab = {w for i in toxic for w in texts[i]}
    df = Counter(w for t in texts.values() for w in set(t))
    n = [Counter(w for i, v in toxic.items() if v == c for w in set(texts[i])) for c in (0, 1)]

    def weight(w):
        rf = math.log2(2 + n[1][w] * sizes[0] / sizes[1] / max(1, n[0][w])) if n[0][w] + n[1][w] >= 3 else 1.0
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1e-3) * rf

    def unit(words):
        raw = {w: (1 + math.log(k)) * weight(w) for w, k in Counter(words).items() if w in vocab}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}, norm

    units = {i: unit(texts[i])[0] for i in toxic}

    def near(u, without=None):
        cos = sorted(((round(sum(x * v.get(w, 0.0) for w, x in u.items()), 9), str(i)) for i, v in units.items() if i != without), key=lambda c: (-c[0], c[1]))
        return [c for c in cos if c[0] > 0][:15]

    def evidence(found, norm):
        mass = sum(c * c for c, _ in found)
        return [sum(c * c * toxic[int(i)] for c, i in found) / mass if mass else 0.0, sum(c for c, _ in found) / len(found) if found else 0.0, math.log1p(norm)]

    ids = sorted(toxic, key=str)
    x = np.array([evidence(near(units[i], i), unit(texts[i])[1]) for i in ids])
    beta = logistic(x, np.array([toxic[i] for i in ids], dtype=float), np.ones(len(ids)))
    blank = [toxic[i] for i in ids if not texts[i]]
    got = op6_toxicity(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        u, norm = unit(texts[r.doc_id])
        found = near(u)
        want = 1 / (1 + math.exp(-float(np.dot(beta[:-1], evidence(found, norm)) + beta[-1]))) if found else (sum(blank) + 0.5) / (len(blank) + 1)
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = tx.fit(docs, labels)
    judged = tx.with_toxicity(docs.join(labels, "doc_id").where(held_out("doc_id")), model).select("toxic", "toxicity.score").collect()
    hit = sum(r.score >= 0.5 for r in judged if r.toxic) / sum(r.toxic for r in judged)
    false = sum(r.score >= 0.5 for r in judged if not r.toxic) / sum(not r.toxic for r in judged)
    assert hit > 0.85 and false < 0.02
    assert abs(sum(r.score for r in judged) - sum(r.toxic for r in judged)) < 0.25 * sum(r.toxic for r in judged)


def test_corner_cases(spark):
    docs = spark.createDataFrame(
        [(i, "bad vile words here" if i % 2 else "kind calm words here", "mine") for i in range(40)] + [(50, None, "n"), (51, "", None), (None, "bad vile", "u"), (52, "bad " * 100_000, "long"), (53, "unseen", "x"), (53, "unseen", "x")],
        "doc_id long, text string, toxicity string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 0), (51, 0), (None, 1), (3, 1), (7, None)], "doc_id long, toxic int")
    got = {(r.doc_id, r.text and r.text[:8]): r.toxicity.score for r in tx.with_toxicity(docs, tx.fit(docs, labels)).collect()}
    assert len(got) == 45 and all(0 <= s <= 1 for s in got.values())
    assert got[1, "bad vile"] > 0.5 and got[None, "bad vile"] > 0.5 and got[52, "bad bad "] > 0.5
    assert got[2, "kind cal"] < 0.5 and got[50, None] == got[51, ""] == got[53, "unseen"] < 0.5
    none = tx.fit(docs, labels.limit(0))
    assert {r.toxicity.score for r in tx.with_toxicity(docs, none).collect()} == {0.5}
    assert tx.with_toxicity(docs.limit(0), none).count() == 0


def test_texts_without_toxic_wording_are_compared_too(spark):
    docs = spark.createDataFrame([(i, "bad vile words here" if i % 2 else "kind calm words here") for i in range(40)] + [(50, "kind calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxicity for r in tx.with_toxicity(docs, tx.fit(docs, labels)).collect()}
    assert got[50].neighbours and all(int(i) % 2 == 0 for i in got[50].neighbours) and got[50].score < 0.5 < got[1].score


def test_the_driver_keeps_words_in_a_row_and_no_object_for_each(spark):
    words = lambda i: [f"w{i:03}x{k:03}" for k in range(400)] + ["every", "é"]
    docs = spark.createDataFrame([(i, "" if i == 7 else " ".join(words(i))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    tracemalloc.start()
    model = tx.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    known = sorted((str(i) for i in range(400) if zlib.crc32(str(i).encode()) % 5), key=str)
    want: dict = {}
    for i in known:
        for w in sorted(w.encode() for w in (words(int(i)) if i != "7" else [])):
            want.setdefault(w, len(want))
    assert model.ids == known and len(want) > 100_000
    sent = pickle.loads(pickle.dumps(model))
    assert sent.vocab.ids() == want and sent.vocab.size == len(want)
    assert peak < 25, peak  # 35 MB with a dictionary and lists of words; 16 MB without
