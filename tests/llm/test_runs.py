"""Periodic runs against a search of every period, and the corner cases of the contract."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, runs


def slow_runs(words):
    """The runs by comparing words for every period."""
    n, kept = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                kept.setdefault((i, j - i + q), q)
            i = j
    return sorted((i, length, q) for (i, length), q in kept.items())


def as_codes(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def random_words(rng):
    """Few different words, with repeated pieces put in, some next to one another."""
    alphabet = rng.choice([1, 2, 2, 3, 5, 40])
    words = []
    while len(words) < rng.randrange(1, 90):
        piece = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 9))]
        words += piece * rng.choice([1, 1, 3, 4, 6])
        words += piece[: rng.randrange(len(piece) + 1)]
    return words


def test_random_words_equal_the_slow_search():
    rng = random.Random(7)
    for _ in range(1500):
        words = random_words(rng)
        assert [tuple(r) for r in runs.runs(as_codes(words)).tolist()] == slow_runs(words), words


@pytest.mark.parametrize("period, length", [(1, 5), (1, 6), (2, 7), (2, 8), (3, 11), (3, 12), (1, 50_000), (7_001, 30_000), (12_345, 49_380)])
def test_one_run_between_other_words(period, length):
    rng = np.random.default_rng(period)
    body = np.resize(np.arange(period), length)
    words = np.r_[np.arange(10**6, 10**6 + 50), body, np.arange(2 * 10**6, 2 * 10**6 + 50 + rng.integers(9))]
    want = [[50, length, period]] if length >= max(6, 4 * period) else []
    assert runs.runs(as_codes(words.tolist())).tolist() == want


def test_collapsed_keeps_the_first_period():
    words = b"x a b a b a b a b a y y y y y y z".split()
    found = runs.runs(as_codes(words))
    assert found.tolist() == [[1, 9, 2], [10, 6, 1]]
    assert runs.collapsed(words, found) == b"x a b y z"


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        a, p = h // 10 % n, 0
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_whole_query_equals_the_slow_version(spark, sf):
    want = {r.doc_id: slow_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12_000}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(want) > 180 and any(r[1] for r in want.values())
    assert {i: got[i] for i in want} == want


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "no no no no no no", "d"), (4, "no no no no no no", "d"), (None, "a b " * 5, None), (5, "w " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, periodic string").withColumn("_row", F.lit(1)).withColumn("text.x", F.lit(2))
    got = runs.with_runs(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.text, r["text.x"]) for r in got] == [
        (None, 10, [(0, 10, 2)], "a b", 2), (1, 0, [], "", 2), (2, 0, [], "", 2), (3, 0, [], "", 2),
        (4, 6, [(0, 6, 1)], "no", 2), (4, 6, [(0, 6, 1)], "no", 2), (5, 200_000, [(0, 200_000, 1)], "w", 2),
    ]
    assert runs.with_runs(docs.limit(0)).count() == 0
