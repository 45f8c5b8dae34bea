"""Pfair mixing against a slot-by-slot model, and its deviation bound."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from quarry.llm import mixing


def slow(sizes, weights, block):
    """[(phase, source, block of the source)] slot by slot."""
    left = {s: -(-n // block) for s, n in sizes.items()}
    used, out, phase = defaultdict(int), [], 0
    while any(left.values()):
        active = {s: weights.get(s, 1) for s in left if left[s]}
        total, start, done = sum(active.values()), len(out), dict.fromkeys(active, 0)
        while all(left[s] for s in active):
            t = len(out) - start
            due = [(-(-(done[s] + 1) * total // w), s) for s, w in sorted(active.items()) if done[s] * total // w <= t]
            s = min(due)[1]
            out.append((phase, s, used[s]))
            used[s] += 1
            done[s] += 1
            left[s] -= 1
        phase += 1
    return out


@pytest.mark.parametrize("block", [1, 3])
def test_equals_slot_by_slot_model(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    sizes, weights = {"a": 41, "b": 17, "c": 5, "d": 1}, {"a": 3, "b": 4}
    ids = [(f"{s}{i}", s, "t", 7) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(ids, "doc_id string, source string, text string, slot int")
    got = mixing.mix(docs, weights, block=block).collect()
    want = slow(sizes, weights, block)
    order = {s: sorted((x[0] for x in ids if x[1] == s), key=lambda i: hashlib.md5(i.encode()).hexdigest()) for s in sizes}
    expected = set()
    for slot, (phase, s, b) in enumerate(want):
        for k, i in enumerate(order[s][b * block : (b + 1) * block]):
            expected.add((i, phase, b, slot, slot * block + k))
    assert {(r.doc_id, r.phase, r.block, r.slot, r.position) for r in got} == expected and len(got) == len(ids)


def test_every_prefix_of_a_phase_is_within_a_block_of_its_share(spark):
    sizes, weights = {"a": 300, "b": 200, "c": 90, "d": 60, "e": 7}, {"a": 13, "b": 7, "c": 5, "d": 2, "e": 1}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id int, source string")
    slots = sorted((r.slot, r.phase, r.source) for r in mixing.mix(docs, weights, block=1, text_col=None).collect())
    assert [s for s, _, _ in slots] == list(range(sum(sizes.values())))
    for phase in {p for _, p, _ in slots}:
        run = [s for _, p, s in slots if p == phase]
        active = {s for _, p, s in slots if p >= phase}
        total, seen = sum(weights[s] for s in active), dict.fromkeys(active, 0)
        for t, s in enumerate(run, 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * weights[x] / total) < 1 for x in active)


def test_corner_cases(spark):
    rows = [(None, None, "x"), (1, None, None), (1, None, None), (2, "", "y" * 100_000), (3, "s", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, {"s": 2}, block=2).collect()
    assert len(got) == 5 and len({r.position for r in got}) == 5
    assert mixing.mix(docs.limit(0), {"s": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": 0})


@pytest.mark.parametrize("seed", range(40))
def test_simulation_equals_slot_by_slot_model(seed):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(rng.randrange(1, 9))]
    weights = {s: rng.randrange(1, 6) for s in names}
    sizes = {s: rng.randrange(1, rng.choice([3, 30])) for s in names}
    got = {}
    for s, phase, start, total, first, took, weight, slots in mixing.simulate(names, [weights[s] for s in names], [sizes[s] for s in names]):
        for b in range(took):
            got[start + b // weight * total + slots[b % weight]] = (phase, s, first + b)
    assert [got[k] for k in range(len(got))] == slow(sizes, weights, 1)


def test_both_ways_make_the_same_mix_and_no_number_of_sources_is_refused(spark):
    docs = spark.createDataFrame([(i, f"s{i * i % 23}", "p", "w") for i in range(400)], "doc_id int, source string, phases string, _source string")
    one, two = (sorted(map(tuple, mixing.mix(docs, {"s1": 4, "s3": 3}, block=2, text_col=None, max_sources=m).collect())) for m in (500, 5))
    assert one == two and len(one) == 400 and {r[2:4] for r in one} == {("p", "w")}
    many = spark.createDataFrame([(i, f"s{i % 700}") for i in range(1500)], "doc_id int, source string")
    got = mixing.mix(many, {"s5": 40}, block=1, text_col=None).collect()
    assert sorted(r.position for r in got) == list(range(1500))
