"""Joins of ranges and filters by equality against the plain predicate."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import intervals
from quarry.operators import search as se
from quarry.operators.questions import FILTERS, _passes, filter_chunks, filter_columns, passing_groups

CHUNK = "chunk_id string, stage string, gas_agent array<string>, targets array<string>, T_K double, T_min_K double, T_max_K double, P_MPa double, P_min_MPa double, P_max_MPa double, coal_name string, tenant_id int"
QUESTION = "qid int, f_stage string, f_gas_agent array<string>, f_targets array<string>, f_T struct<lo:double,hi:double>, f_P struct<lo:double,hi:double>, f_coal_name string, f_tenant_id int"


def some(rng, make, share=0.6):
    return make() if rng.random() < share else None


def spans(rng, top):
    lo = round(rng.uniform(-top / 50, top), rng.choice([0, 2]))
    return lo, round(lo + rng.choice([0, 1, 16, 16.5, top / 3, top * 5]) * rng.random(), 2)


def random_rows(rng, n, m):
    stages, gases, targets, coals = ["pyrolysis", "gasification", "\x00", "*"], ["steam", "oxygen", "air"], ["tar", "phenol"], ["A", "B"]
    pick = lambda xs: [rng.choice(xs) for _ in range(rng.randrange(4))]
    chunks, asked = [], []
    for i in range(n):
        numbers = []
        for top in (2000, 20):
            lo, hi = spans(rng, top)
            point, both = some(rng, lambda: (lo + hi) / 2), some(rng, lambda: (lo, hi))  # noqa: B023
            numbers += [point, *(both or (None, None))]
        chunks.append((f"c{i}", some(rng, lambda: rng.choice(stages[:3])), some(rng, lambda: pick(gases)), some(rng, lambda: pick(targets)), *numbers, some(rng, lambda: rng.choice(coals)), some(rng, lambda: rng.randrange(3))))
    for q in range(m):
        share = rng.choice([0, 0.2, 0.5])
        asked.append((q, some(rng, lambda: rng.choice(stages), share), some(rng, lambda: pick(gases), share), some(rng, lambda: pick(targets), share), some(rng, lambda: spans(rng, 2000), share), some(rng, lambda: spans(rng, 20), share), some(rng, lambda: rng.choice(coals), share / 2), some(rng, lambda: rng.randrange(3), share / 2)))
    return chunks, asked


@pytest.mark.parametrize("seed", [1, 2])
def test_filters_find_what_the_plain_predicate_finds(spark, seed):
    chunks, asked = random_rows(random.Random(seed), 300, 120)
    c, q = spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(asked, QUESTION)
    filters, _ = filter_columns(q, c)
    assert filters == [*FILTERS, "f_tenant_id"]
    want = sorted((r.qid, r.chunk_id) for r in c.join(F.broadcast(q), _passes(filters)).select("qid", "chunk_id").collect())
    got = sorted((r.qid, r.chunk_id) for r in filter_chunks(c, q).select("qid", "chunk_id").collect())
    assert len(want) > 1000 and got == want
    assert filter_chunks(c, q).columns == [*c.columns, "qid"]


def test_no_nested_loop_in_any_search_plan(spark):
    chunks, asked = random_rows(random.Random(3), 40, 12)
    c = spark.createDataFrame(chunks, CHUNK).withColumns({"text": F.lit("a b"), "embedding": F.array(F.lit(1.0), F.lit(0.5))})
    q = spark.createDataFrame(asked, QUESTION).withColumns({"rewritten": F.lit("b c"), "q_embedding": F.array(F.lit(1.0), F.lit(0.0))})
    for df in (filter_chunks(c, q), passing_groups(c, q), se._seen_by(c, q, "embedding"), se.hybrid_search(q, c, 5, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_meet_once_on_any_level(spark):
    rng = random.Random(5)
    rows = [(i, *spans(rng, 500)) for i in range(200)]
    a, b = spark.createDataFrame(rows[:120], "i int, lo double, hi double"), spark.createDataFrame(rows[120:], "j int, lo2 double, hi2 double")
    own, theirs = (F.col("lo"), F.col("hi")), (F.col("lo2"), F.col("hi2"))
    keyed = a.withColumn("key", F.explode(intervals.cells(*own, intervals.levels(b, *theirs, 8.0), 8.0)))
    other = b.withColumn("key", F.explode(intervals.cells(*theirs, intervals.levels(a, *own, 8.0), 8.0)))
    met = keyed.join(other, "key").where(intervals.first_meeting(F.col("key.level"), F.col("key.cell"), own, theirs, 8.0) & (F.col("lo") <= F.col("hi2")) & (F.col("hi") >= F.col("lo2")))
    want = sorted((x[0], y[0]) for x in rows[:120] for y in rows[120:] if x[1] <= y[2] and x[2] >= y[1])
    assert sorted((r.i, r.j) for r in met.collect()) == want and want
