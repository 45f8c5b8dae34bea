"""Near copies against brute force over all pairs of exact shingle sets."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from quarry.llm import near_copies
from quarry.llm.simhash import fingerprint, fingerprint_of


def slow_set(text):
    toks = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if t]
    return {tuple(toks[i : i + 5]) for i in range(max(1, len(toks) - 4))} if toks else set()


def slow_pairs(sets):
    """All pairs of ids with a similarity of at least 0.8."""
    index, out = defaultdict(list), set()
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in index[s]).items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                out.add((j, i))
        for s in sets[i]:
            index[s].append(i)
    empty = sorted(i for i in sets if not sets[i])
    return out | {(empty[0], i) for i in empty[1:]}


def slow_components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_the_stage_keeps_no_near_copy_that_exact_similarity_finds(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: slow_set(r.text) for r in docs.collect()}
    want = set(slow_components(sets, slow_pairs(sets)).values())
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf).collect()} == want


def test_small_changes_are_found_and_corner_cases_kept(spark):
    base = [f"w{i}" for i in range(200)]
    changed = " ".join([*base[:60], "new", *base[61:140], "other", *base[141:]])  # similarity 0.90
    chained = " ".join([*base[:60], "new", *base[61:140], "other", *base[141:180], "third", *base[181:190], "last", *base[191:]])
    far = " ".join(w if i % 20 else "z" for i, w in enumerate(base))
    rows = [(7, " ".join(base), "x"), (3, changed, "y"), (11, chained, "c"), (4, far, "far"), (9, None, None), (5, "", "z"), (5, "", "z"), (6, "a b", "s"), (None, "A B", "n"), (8, "A  b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = near_copies.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.component_id) for r in kept.collect()) == [(0, "n"), (3, "y"), (4, "far"), (5, "z"), (6, "s")]
    assert near_copies.near_copies(docs).count() == len(rows)
    assert near_copies.keep_one_of_each(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """A large group of near copies at all distances from its middle: components equal brute force however buckets are taken."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 5)):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: slow_set(t) for i, t in enumerate(texts)}
    want = slow_components(sets, slow_pairs(sets))
    assert 1 < len(set(want.values())) < 100
    for crowd, rounds in ((2, 2), (2, 0), (1000, 1)):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, crowd=crowd, rounds=rounds).collect()}
        assert got == want


def test_fingerprints_find_near_copies_by_themselves_and_the_similarity_decides(spark):
    """Without MinHash: texts within two bits are candidates through deletion variants, also along a chain; candidates that are
    not similar enough stay apart."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = {1: " ".join(base), 2: " ".join([*base, "end"]), 3: " ".join(["start", *base, "end"]), 4: " ".join(base[::-1])}
    texts |= {5: "a b c d e " * 400, 6: "a b c d e " * 400 + "f g h"}  # one fingerprint, sets of 5 and 8 shingles
    fps = {i: fingerprint(t.encode(), near_copies.WORDS) for i, t in texts.items()}
    own = {i: fingerprint_of(near_copies.hashed(t.encode())) for i, t in texts.items()}
    apart = lambda a, b: ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()
    assert apart(own[1], own[2]) <= 2 and apart(own[2], own[3]) <= 2 and own[5] == own[6] and fps[5] == fps[6]
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, minima=False).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert fingerprint_of(near_copies.hashed(None)) == 0
