"""Nearest vectors through cells against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quarry.operators import search as se
from quarry.operators import vectors as vx


def rows(n, groups, seed, dims=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dims)).round(3).tolist()) for i in range(n)]


@pytest.mark.parametrize("cut", [20_000, 7])
def test_exact_mode_equals_the_scan(spark, monkeypatch, cut):
    monkeypatch.setattr(vx, "_SLICE", cut)
    made = rows(400, 9, 1) + [(1000 + i, [1.0] * 12) for i in range(30)] + [(2000, None), (2001, [0.0] * 12)]
    chunks = spark.createDataFrame(made, "chunk_id int, embedding array<double>")
    probes = chunks.where("chunk_id % 13 = 0 OR chunk_id >= 1998").selectExpr("chunk_id AS qid", "embedding")
    want = sorted((r.qid, r.chunk_id, r.cosine, r["rank"]) for r in se.knn_topk(probes, chunks, 6).collect())
    index = vx.VectorIndex(chunks)
    assert sorted((r.qid, r.chunk_id, r.cosine, r["rank"]) for r in index.search(probes, 6).collect()) == want and len(want) > 200
    assert index.search(probes.limit(0), 6).count() == 0 and vx.VectorIndex(chunks.limit(0)).search(probes, 6).count() == 0


def test_probes_are_spread_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(vx, "_ASKED", 10)
    p = pd.DataFrame({"qid": range(7), "v": [np.full(3, float(i)) for i in range(7)]})
    use, slices = np.random.default_rng(4).random((7, 5)) < 0.8, np.array([1, 3, 0, 2, 1])
    got = list(vx._spread(p, use, slices))
    assert max(map(len, got)) == 10 and all((np.stack(g["v"])[:, 0] == g["qid"]).all() for g in got)
    rows = sorted(x for g in got for x in g[["qid", "cell", "slice"]].itertuples(index=False, name=None))
    assert rows == [(q, c, s) for q in range(7) for c in range(5) if use[q, c] for s in range(slices[c])]
    assert [len(x) for x in vx._pieces([p], 3)] == [3, 3, 1]


def test_recall_of_a_tenth_of_the_cells(spark):
    chunks = spark.createDataFrame(rows(3000, 60, 2), "chunk_id int, embedding array<double>")
    probes = chunks.where("chunk_id % 20 = 0").selectExpr("chunk_id AS qid", "embedding")
    index = vx.VectorIndex(chunks)
    assert len(index.centres) == 55 and vx.recall(index.search(probes, 5), index.search(probes, 5, cells=5)) >= 0.9


def test_a_task_keeps_its_best_over_all_batches(spark):
    chunks = spark.createDataFrame(rows(600, 5, 3), "chunk_id int, embedding array<double>").coalesce(1)
    probes = chunks.where("chunk_id < 20").selectExpr("chunk_id AS qid", "embedding")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for size in ("17", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append(sorted(map(tuple, se.knn_topk(probes, chunks, 4).collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] and len(got[0]) == 80
