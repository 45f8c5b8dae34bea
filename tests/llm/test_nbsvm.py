"""Naive Bayes support vectors: the solver, the n-grams, accuracy on held-out labels, corner cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from quarry.llm import nbsvm
from quarry.llm.labelled import held_out
from quarry.llm.queries import op7_quality_classifier


def test_solver_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = nbsvm.dual_coordinate_descent([(np.arange(4), r) for r in x], y, np.full(60, 0.5), 4, epochs=3000)
    loss = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum()
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=5)) + 1e-6 for _ in range(300))


def test_shapes_and_grams():
    assert [nbsvm.shape(w) for w in (b"the&&&", b"NO!!", b"a1-2", "é".encode())] == [b"a&", b"A!", b"a9-9", b"a"]
    grams = nbsvm.Grams()
    assert len(grams(b"Go go go")) == len(grams(b"Go go")) + 2  # one pair and one run of three more
    assert set(grams(b"one two")) < set(grams(b"one two 3!"))
    assert len(grams(None)) == len(grams(b"")) == 0


def test_ratios_are_those_of_all_labelled_texts(spark):
    """The model of the whole query against counts in plain Python, and its scores against sums by hand."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5}
    grams, n = nbsvm.Grams(), [Counter(), Counter()]
    for i, y in known.items():
        n[y].update(set(grams(texts[i]).tolist()))
    sizes = [sum(v == c for v in known.values()) for c in (0, 1)]
    model = nbsvm.fit(docs, labels)
    for g in set(n[0]) | set(n[1]):
        want = math.log((n[1][g] + 1) / (sizes[1] + 2)) - math.log((n[0][g] + 1) / (sizes[0] + 2))
        assert abs(model.ratio[g] - want) < 1e-9
    assert np.count_nonzero(model.ratio) <= len(set(n[0]) | set(n[1]))
    for r in op7_quality_classifier(spark, sf).collect():
        values = {g: model.ratio[g] for g in grams(texts[r.doc_id]).tolist()}
        norm = math.sqrt(sum(v * v for v in values.values())) or 1.0
        margin = sum(model.weights[g] * v / norm for g, v in values.items()) + model.weights[-1]
        want = 1 / (1 + math.exp(-(model.scale[0] * margin + model.scale[1])))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = nbsvm.fit(docs, labels)
    judged = nbsvm.with_quality(docs.join(labels, "doc_id").where(held_out("doc_id")), model).select("quality", "quality_score").collect()
    for q in (0, 1):
        own = [(r.quality_score >= 0.3) == bool(q) for r in judged if r.quality == q]
        assert sum(own) / len(own) > 0.95


def test_corner_cases(spark):
    docs = spark.createDataFrame(
        [(i, "one fine line of words" if i % 2 else "BAD!! BAD!! BAD!!", "mine") for i in range(60)] + [(70, None, "n"), (71, "", None), (None, "BAD!!", "u"), (72, "fine " * 100_000, "l"), (73, "x", "x"), (73, "x", "x")],
        "doc_id long, text string, quality_score string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, 0), (None, 1), (3, 1), (9, None)], "doc_id long, quality int")
    got = {(r.doc_id, r.text and r.text[:5]): r.quality_score for r in nbsvm.with_quality(docs, nbsvm.fit(docs, labels)).collect()}
    assert len(got) == 65 and all(0 <= s <= 1 for s in got.values())
    assert got[1, "one f"] > 0.5 > got[2, "BAD!!"] and got[None, "BAD!!"] < 0.5
    assert got[70, None] == got[71, ""]
    none = nbsvm.fit(docs, labels.limit(0))
    assert {r.quality_score for r in nbsvm.with_quality(docs, none).collect()} == {0.5}
    assert nbsvm.with_quality(docs.limit(0), none).count() == 0
