"""Ranking, search routes, context and evaluation on small corpora."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import search as se
from quarry.operators.context import answer_gate, build_context
from quarry.operators.questions import filter_chunks, filters_of, parse_queries, relax_filters, rewrite_queries

CHUNK = "chunk_id string, parent_id string, is_parent boolean, heading_path string, source_file string, page int, section string, stage string, gas_agent array<string>, targets array<string>, T_K double, T_min_K double, T_max_K double, P_MPa double, P_min_MPa double, P_max_MPa double, coal_name string, text string, embedding array<float>"


def chunk(i, source, text, stage=None, gas=None, targets=None, t=None, p=None, section="results", parent="", vector=(1.0, 0.0)):
    return (i, parent or i, not parent, "M > E" if not parent else "", source, 1, section, stage, gas, targets, t, None, None, p, None, None, None, text, list(vector))


C1 = chunk("c1", "a.pdf", "Steam gasification at 1200 K and 2 MPa produces NH3 and HCN.", "gasification", ["steam"], ["NH3", "HCN"], 1200.0, 2.0)
C2 = chunk("c2", "b.pdf", "Pyrolysis at 800 C produces tar and phenols.", "pyrolysis", None, ["phenols"], 1073.15, 0.1)
ASK = "steam gasification 1200K 2MPa NH3"


def asked(spark, *raws, mode="hard_only"):
    rows = [(str(i), r, [1.0, 0.0]) for i, r in enumerate(raws)]
    return filters_of(rewrite_queries(parse_queries(spark.createDataFrame(rows, "qid string, raw string, q_embedding array<float>"))), mode)


def test_bm25_equals_the_formula(spark):
    rng = random.Random(4)
    texts = {f"c{i:02d}": " ".join(rng.choices("abcde", k=rng.randrange(0, 9))) for i in range(30)}
    queries = {"q1": "a b a", "q2": "e zz", "q3": ""}
    cand = [(q, c) for q in queries for c in texts if rng.random() < 0.7]
    qs = spark.createDataFrame(list(queries.items()), "qid string, rewritten string")
    rows = spark.createDataFrame([(q, c, texts[c]) for q, c in cand], "qid string, chunk_id string, text string")
    got = {(r.qid, r.chunk_id): (r.score, r.rank) for r in se.bm25_rank(qs, rows).collect()}
    for q, asked_ in queries.items():
        docs = {c: texts[c].split() for x, c in cand if x == q}
        avg = sum(map(len, docs.values())) / len(docs)
        score = {}
        for c, toks in docs.items():
            s = 0.0
            for term in re.findall(r"\w+", asked_):
                n, f = sum(term in d for d in docs.values()), toks.count(term)
                if f:
                    s += math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks) / avg))
            score[c] = round(s, 6)
        order = sorted(docs, key=lambda c: (-score[c], c))
        for rank, c in enumerate(order, 1):
            assert abs(got[q, c][0] - score[c]) < 2e-6
        assert sorted(got[q, c][1] for c in docs) == list(range(1, len(docs) + 1))


def test_knn_and_fusion(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>")
    probes = spark.createDataFrame([("q", [2.0, 0.0]), ("p", [0.0, 3.0])], "qid string, embedding array<float>")
    for most in (1, 10):
        got = [(r.qid, r.chunk_id, r.cosine, r["rank"]) for r in se.knn_topk(probes, rows, 2, most_probes=most).orderBy("qid", "rank").collect()]
        assert got == [("p", "b", 1.0, 1), ("p", "c", 0.707107, 2), ("q", "a", 1.0, 1), ("q", "c", 0.707107, 2)]
    lists = [spark.createDataFrame([("q", c, i) for i, c in enumerate(x, 1)], "qid string, chunk_id string, rank int") for x in ("ab", "bc")]
    assert [r.chunk_id for r in se.rrf_fuse(lists).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.chunk_id for r in se.rrf_fuse(lists, mode="vector").orderBy("rank").collect()] == ["b", "c"]


def test_single_stage_route(spark):
    chunks = spark.createDataFrame([C1, C2, chunk("r", "refs.pdf", "steam gasification NH3 references", section="references"), *[chunk(f"a{i}", "x.pdf", f"steam gasification NH3 {i}") for i in range(3)]], CHUNK)
    queries = spark.createDataFrame([("q", ASK, [1.0, 0.0])], "qid string, raw string, q_embedding array<float>")
    got = [(r.chunk_id, r.source_file) for r in se.retrieve(queries, chunks, max_per_source=1).orderBy("rank").collect()]
    assert got[0] == ("c1", "a.pdf") and [s for _, s in got].count("x.pdf") == 1 and ("r", "refs.pdf") not in got
    scores = spark.createDataFrame([("q", "a1", 9.0), ("q", "c1", 1.0)], "qid string, chunk_id string, relevance_score double")
    again = se.retrieve(queries, chunks, max_per_source=0, scores=scores).orderBy("rank").collect()
    assert [r.chunk_id for r in again][:2] == ["a1", "c1"] and [r["rank"] for r in again] == list(range(1, len(again) + 1))


def test_rows_without_metadata_are_not_lost(spark):
    chunks = spark.createDataFrame([chunk("c1", "a", "气化产生NH3"), chunk("c2", "b", "热解产生酚类")], CHUNK)
    q = asked(spark, "气化 NH3 1200K")
    ranked = spark.createDataFrame([("0", "c1", 1), ("0", "c2", 2)], "qid string, chunk_id string, rank int")
    assert se.soft_rank(ranked, chunks, q).count() == 2


def test_two_stage_route_and_fallback(spark):
    p1 = chunk("p1", "a.pdf", "steam gasification NH3 overview", "gasification", ["steam"], ["NH3"], 1200.0, 2.0)
    kids = [chunk(f"k{i}", "a.pdf", f"steam gasification NH3 detail {i}", "gasification", ["steam"], ["NH3"], 1200.0 + i, 2.0, parent="p1") for i in range(3)]
    far = chunk("k9", "b.pdf", "steam gasification NH3 cold", "gasification", ["steam"], ["NH3"], 400.0, 2.0, parent="p9")
    chunks = spark.createDataFrame([p1, *kids, far], CHUNK)
    out = se.two_stage_search(asked(spark, ASK, "only NH3 steam gasification 410 K"), chunks).collect()
    first = [r for r in out if r.qid == "0"]
    assert {r.chunk_id for r in first} == {"k0", "k1", "k2"} and not any(r.two_stage_fallback for r in first) and {r.heading_path for r in first} == {"M > E"}
    second = [r for r in out if r.qid == "1"]
    assert {r.chunk_id for r in second} == {"k0", "k1", "k2", "k9"} and all(r.two_stage_fallback and r.parent_hits == 0 for r in second)
    queries = spark.createDataFrame([("q", ASK, [1.0, 0.0])], "qid string, raw string, q_embedding array<float>")
    final = se.retrieve_batch(queries, chunks, max_per_source=2).collect()
    assert len(final) == 2 and sorted(r["rank"] for r in final) == [1, 2] and all((r.parent_hits, r.child_hits, r.relax_steps) == (1, 3, 0) for r in final)
    both = spark.createDataFrame([("q",), ("none",)], "qid string")
    trace = {r.qid: r for r in se.retrieval_trace(both, se.retrieve_batch(queries, chunks, max_per_source=2)).collect()}
    assert trace["q"].final == 2 and trace["q"].citations[0] == f"a.pdf [M > E] #{trace['q'].score_top[0].chunk_id}" and trace["none"].final == 0 and not trace["none"].citations


def test_search_over_filters_equals_ranking_of_the_listed_candidates(spark):
    rng = random.Random(8)
    words = ["steam", "gasification", "NH3", "tar", "coal", "of"]
    rows = [chunk(f"c{i:03d}", f"s{i % 4}", " ".join(rng.choices(words, k=rng.randrange(0, 7))), rng.choice(["gasification", "pyrolysis", None]), rng.choice([["steam"], None]), None, rng.choice([400.0, 1200.0, None])) for i in range(150)]
    chunks = spark.createDataFrame(rows, CHUNK)
    for mode, zeros, block in (("full", True, 7), ("full", False, 3), ("hard_only", False, 4096)):
        q = asked(spark, ASK, "only steam gasification of tar", "coal tar NH3", "nothing known", mode=mode)
        listed = se.bm25_rank(q, filter_chunks(chunks, q).select("qid", "chunk_id"), k=9, texts=chunks).collect()
        got = se.bm25_search(q, chunks, 9, zeros=zeros, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, [r for r in listed if zeros or r.score > 0]))


def test_equality_filters_and_relaxation_rules(spark):
    chunks = spark.createDataFrame([C1, C2], CHUNK).withColumn("tenant_id", F.when(F.col("chunk_id") == "c1", "t1"))
    q = asked(spark, "steam tar").withColumn("f_tenant_id", F.lit("t1"))
    assert [r.chunk_id for r in se.bm25_search(q, chunks, 5).collect()] == ["c1"]
    none = q.select("qid").limit(0)
    relaxed = relax_filters(q, none, none, rules=(("tenant_id",), ("T_range_K",), ("stage",)), max_steps=1).first()
    assert relaxed.f_tenant_id is None and relaxed.relax_steps == 1 and relaxed.two_stage_fallback
    assert relax_filters(q, none, none, max_steps=0).first().f_tenant_id == "t1"


def test_context_and_answers(spark):
    rows = [("q", 1, "c1", "", "a", 1, "H1", "same "), ("q", 2, "c2", "", "a", 1, "H2", "other"), ("q", 3, "c3", "", "a", 1, "H1", "SAME"), ("q", 4, "c4", "", "a", 1, "H1", "third"), ("p", 1, "c1", "", "a", 1, None, "x")]
    ranked = spark.createDataFrame(rows, "qid string, rank int, chunk_id string, parent_id string, source_file string, page int, heading_path string, text string")
    got = {r.qid: r for r in build_context(ranked).collect()}
    assert got["q"].markdown == "## H1\n- [S1] same\n- [S3] third\n## H2\n- [S2] other" and list(got["q"].used_chunks) == ["c1", "c2", "c4"] and got["q"].dropped == 1
    assert got["p"].markdown == "## a\n- [S1] x"
    said = {r.qid: r.reason for r in answer_gate(spark.createDataFrame([("q",), ("p",), ("n",)], "qid string"), build_context(ranked)).collect()}
    assert said == {"q": "answered", "p": "insufficient_evidence", "n": "no_results"}


def test_gold_and_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "c1", "Dir/Paper.pdf", 3), ("q", 2, "c2", "x", 4), ("q", 3, "c3", "y", 5), ("p", 1, "c9", None, None)], "qid string, rank int, chunk_id string, source_file string, page int")
    gold = spark.createDataFrame([("q", "t", "", [("paper", 3, ""), ("", 5, None), (None, None, "c2")]), ("p", "t", "", []), ("o", "t", "", None)], ev.GOLD)
    matched = ev.match_gold(ranked, gold)
    assert {(r.chunk_id, r.is_hit) for r in matched.collect()} == {("c1", True), ("c2", True), ("c3", True), ("c9", False)}
    assert tuple(ev.eval_precision_recall_mrr(matched, gold, 2).first()) == (round(2 / 6, 6), round(1 / 3, 6), round(1 / 3, 6))
    rate = ev.citation_rate(spark.createDataFrame([("[1] and [2]",), ("",), (None,)], "answer string"))
    assert [round(r.citation_rate, 4) for r in rate.collect()] == [0.3333, 0.0, 0.0]
    said = spark.createDataFrame([("x ### Response: {\"a\": 1}",), ("[1, 2] tail",), ("[1]",), (None,)], "text string")
    assert tuple(ev.json_parse_rate(said).first()) == (4, 0.5)


def test_training_sets(spark):
    pairs = spark.createDataFrame([(f"i{k}", "x" if k % 7 else None, "o") for k in range(40)] + [("i1", "x", "o")], "instruction string, input string, output string")
    train, val = ev.build_train_val(pairs, 0.2)
    assert val.count() == int(35 * 0.2) and train.count() + val.count() == 35
    other = ev.build_train_val(pairs, 0.2, seed=1)[1]
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in val.collect()}
    assert ev.format_training_text(pairs.limit(1)).first().text.startswith("### Instruction:\n")


def test_table_health(spark):
    good = spark.createDataFrame([(True, [0.5, 0.5])], "is_parent boolean, embedding array<double>")
    assert ev.validate_chunks(good, 2, {"is_parent": "boolean"}).first().ok
    bad = ev.validate_chunks(good.where(F.lit(False)), 2, {"is_parent": "string", "x": "int"}).first()
    assert not bad.ok and len(bad.errors) == 5


def test_the_index_reads_the_same_tokens(spark):
    from quarry.functions.text import tokenize
    from quarry.operators import postings

    texts = ["", "Pyrolysis at 900 K, S/C=1.5 of co_al", "气化Gas化 鿿龦 K900 İx ÉA ſs 㐀", "A_b-C\nd"]
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(tokenize("text")).collect()]
    assert [[t.lower() for t in postings._TOKEN.findall(x)] for x in texts] == want


def test_negative_zero_is_zero_to_filters(spark):
    from quarry.operators.questions import FILTERED, filter_group

    kinds = {"stage": "string", "coal_name": "string", "gas_agent": "array<string>", "targets": "array<string>"}
    rows = spark.createDataFrame([(-0.0,), (0.0,)], "T_K double").select(*[F.col(c) if c == "T_K" else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in FILTERED])
    assert rows.select(filter_group(rows, list(FILTERED))).distinct().count() == 1
