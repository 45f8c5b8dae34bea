"""SimHash components against brute force, and the corner cases of the contract."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.graph import components


def slow_fingerprint(text):
    toks = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if t]
    if not toks:
        return 0
    shingles = [" ".join(toks)] if len(toks) < 3 else [" ".join(toks[i : i + 3]) for i in range(len(toks) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: {id: fingerprint} -> {id: smallest id reachable}."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    want = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


@pytest.mark.parametrize("crowded", [2, 8, 256])
def test_links_reach_the_same_components_however_crowded_the_buckets(spark, crowded):
    rng = random.Random(crowded)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)} | set(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.component for r in components(simhash.links(fps, crowded)).collect()}
    by_root = {}
    for p in signed:
        by_root.setdefault(got.get(p, p), set()).add(p)
    roots = slow_components({p: p & (1 << 64) - 1 for p in signed})
    want = {}
    for p, r in roots.items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_corner_cases(spark):
    rows = [(7, "a b c d", "x"), (3, "A B\tC\nD", "y"), (9, None, None), (5, "", "z"), (5, "", "z"), (None, "a b c d", "n"), (1, "w " * 200_000, "long"), (2, "é", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    same = f"{slow_fingerprint('a b c d'):016x}"
    assert {(7, same, 3), (3, same, 3), (None, same, 3), (9, "0" * 16, 5), (5, "0" * 16, 5)} <= got
    assert simhash.near_duplicates(docs).count() == len(rows)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, "n"), (1, "long"), (2, "one"), (3, "y"), (5, "z")]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_texts_under_repeated_ids_are_not_lost(spark):
    a, b = "one text about apples and pears in the garden", "quite another story of ships and winds on seas"
    rows = [(1, a, "k1", 1), (1, b, "k2", 2), (2, b, "k3", 3), (1, a, "k1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, _id int")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b)])


def test_few_edges_take_few_jobs_and_many_the_same_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    links = spark.createDataFrame(pairs, "a long, b long")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    got, jobs = [], []
    for few in (1 << 15, 200, 0):
        sc.setJobGroup(f"components {few}", "")
        got.append(sorted((r.node, r.component) for r in components(links, few=few).collect()))
        jobs.append(len(tracker.getJobIdsForGroup(f"components {few}")))
    sc.setJobGroup("", "")
    low = {x: x for p in pairs for x in p if p[0] != p[1]}
    while any(low[a] != low[b] for a, b in pairs if a != b):
        for a, b in pairs:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    assert got[0] == got[1] == got[2] == sorted(low.items())
    assert jobs[0] < jobs[2] / 2, jobs
    assert components(links.limit(0)).collect() == []
