"""Ranking: BM25, vector top-k, rank fusion, soft scores, caps, and the two-stage search made of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import postings
from quarry.operators.layout import is_reference_like
from quarry.operators.questions import RELAXED, _passes, filter_columns, filter_group, filters_of, parse_queries, passing_groups, range_overlap, relax_filters, rewrite_queries
from quarry.scratch import materialize

DIGITS = 6


def _ranked(df: DataFrame, order: list[Column], by: str = "qid") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))


def top_k(df: DataFrame, k: int, order: list[Column], by: str = "qid") -> DataFrame:
    """The first k rows of each group with ``rank``. Spark keeps k rows a group in every task before it shuffles."""
    return _ranked(df, order, by).where(F.col("rank") <= k)


def _question_terms(queries: DataFrame, query_col: str) -> DataFrame:
    return queries.select("qid", F.explode(tokenize(query_col)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_rank(queries: DataFrame, candidates: DataFrame, text_col: str = "text", query_col: str = "rewritten", k1: float = 1.5, b: float = 0.75, zeros: bool = True, k: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): BM25 with the statistics of each question's own candidates.

    ``candidates``: (qid, chunk_id, text), or without text where ``texts`` (chunk_id, text) has it once a chunk; they are read
    three times, so a table serves better than a plan. A term repeated in the question counts again. With ``zeros`` candidates
    without any term stay at 0, else they go. Scores are rounded; ties are in the order of chunk_id. For candidates that are
    all chunks passing a filter, ``bm25_search`` does the same without listing them."""
    terms = _question_terms(queries, query_col)
    chunks = candidates.select("chunk_id", text_col).distinct() if texts is None else texts.select("chunk_id", text_col)
    chunks = chunks.join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")
    tokens = materialize(chunks.select("chunk_id", tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("t")), "tokens")
    pairs = candidates.select("qid", "chunk_id")
    stats = pairs.join(tokens.select("chunk_id", F.size("t").alias("dl")), "chunk_id").groupBy("qid").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = tokens.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = tf.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    hits = materialize(tf.join(pairs, "chunk_id").join(terms, ["qid", "term"]), "hits")
    df = hits.groupBy("qid", "term").agg(F.count("*").alias("df"))
    known = df.join(stats, "qid").withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).select("qid", "term", "idf", "avgdl")
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    scored = hits.join(known, ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))
    if zeros:
        scored = pairs.distinct().join(scored, ["qid", "chunk_id"], "left")
    scored = scored.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), DIGITS))
    order = [F.desc("score"), F.asc("chunk_id")]
    return top_k(scored, k, order) if k else _ranked(scored, order)


def _blocks(rows: DataFrame, most: int) -> list[DataFrame]:
    """The questions in ``rows`` (qid) in parts of about ``most``, by hash, for one broadcast each."""
    n = max(1, -(-rows.select("qid").distinct().count() // most))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def _best_rows(key_order: np.ndarray, score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of ``rows`` the k of highest score, ties by key order."""
    if len(rows) > k:
        cut = np.partition(score[rows], len(rows) - k)[len(rows) - k]
        rows = rows[score[rows] >= cut]
    return rows[np.lexsort((key_order[rows], -score[rows]))[:k]]


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, text_col: str = "text", query_col: str = "rewritten", k1: float = 1.5, b: float = 0.75, zeros: bool = False, block: int = postings.BLOCK) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best chunks by BM25 of those that pass each question's filters; the statistics are
    those of all that pass. Chunks are inverted once and blocks that cannot hold a result are not scored (``postings``). Ties are
    in the order of chunk_id."""
    terms = materialize(_question_terms(queries, query_col), "terms")
    found = postings.search(queries, chunks, terms, k, text_col, k1, b, zeros, block)
    return top_k(found, k, [F.desc("score"), F.asc("chunk_id")])


def knn_topk(probes: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", most_probes: int = 10_000, allowed: str | None = None) -> DataFrame:
    """(qid, key, cosine, rank): the exact k nearest rows of every probe (qid, vector).

    Probes are broadcast in blocks of about ``most_probes``, fetched one after the other; each Arrow batch is one matrix
    product, and a task keeps k rows a probe over all its batches, whatever their size. With ``allowed``, an array column of
    ``chunks`` with the qids that may see a row, others are left out. Zero or null vectors match nothing. ``VectorIndex`` looks
    into a part of the rows only."""
    ids = chunks.schema[key].dataType.simpleString()
    qtype = probes.schema["qid"].dataType.simpleString()
    spark, out = chunks.sparkSession, None
    for part in _blocks(probes.select("qid", F.col(vector).alias("v")).where("v IS NOT NULL"), most_probes):
        block = sorted(((r.qid, r.v) for r in part.toLocalIterator() if any(r.v)), key=lambda r: str(r[0]))
        matrix = np.array([v for _, v in block], dtype=np.float64).reshape(len(block), -1 if block else 1)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([q for q, _ in block], matrix / np.where(norms == 0, 1, norms)))

        def nearest(batches, shared=shared):
            names, unit = shared.value
            place = {q: i for i, q in enumerate(names)}
            held: list[pd.DataFrame] = []

            def kept() -> list[pd.DataFrame]:
                every = pd.concat(held, ignore_index=True)
                return [every.sort_values(["q", "cosine", "key"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)]

            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf) or not len(names):
                    continue
                vs = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                length = np.linalg.norm(vs, axis=1)
                cos = np.round((vs @ unit.T) / np.where(length == 0, 1, length)[:, None], DIGITS)
                cos[length == 0] = -np.inf
                if allowed is not None:
                    mask = np.zeros(cos.shape, dtype=bool)
                    for i, qs in enumerate(pdf["allowed"]):
                        mask[i, [place[q] for q in qs if q in place]] = True
                    cos[~mask] = -np.inf
                keys = pdf["key"].to_numpy()
                order = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
                best = [_best_rows(order, cos[:, j], np.flatnonzero(cos[:, j] > -np.inf), k) for j in range(len(names))]
                rows, q = np.concatenate(best), np.repeat(np.arange(len(names)), [len(x) for x in best])
                held.append(pd.DataFrame({"q": q, "key": keys[rows], "cosine": cos[rows, q]}))
                if sum(map(len, held)) > 4 * k * len(names):
                    held = kept()
            last = kept()[0] if held else ()
            if len(last):
                yield pd.DataFrame({"qid": [names[q] for q in last["q"]], "key": last["key"].to_numpy(dtype=object), "cosine": last["cosine"].to_numpy()})

        cols = [F.col(key).alias("key"), F.col(vector).alias("v"), *([F.col(allowed).alias("allowed")] if allowed else [])]
        part = chunks.select(*cols).mapInPandas(nearest, f"qid {qtype}, key {ids}, cosine double")
        out = part if out is None else out.unionByName(part)
    return top_k(out.withColumnRenamed("key", key), k, [F.desc("cosine"), F.asc(key)])


def _seen_by(chunks: DataFrame, queries: DataFrame, vector: str) -> DataFrame:
    """(chunk_id, vector, allowed): the chunks that pass some question's filters, with the qids they pass."""
    _, read = filter_columns(queries, chunks)
    allowed = passing_groups(chunks, queries).groupBy("group").agg(F.collect_set("qid").alias("allowed"))
    return chunks.select("chunk_id", vector, filter_group(chunks, read).alias("group")).join(materialize(allowed, "allowed"), "group").drop("group")


def rrf_fuse(lists: list[DataFrame], k: int = 60, mode: str = "rrf", key: str = "chunk_id") -> DataFrame:
    """(qid, key, score, rank) from ranked lists (qid, key, rank): the sum of 1 / (k + rank). ``mode`` bm25 or vector takes the
    first or second list alone. Ties keep the order of the first list, then the second."""
    used = lists if mode == "rrf" else [lists[0] if mode == "bm25" else lists[1]]
    tagged = [x.select("qid", key, F.col("rank").alias("r"), F.lit(i).alias("list")) for i, x in enumerate(used)]
    every = reduce(DataFrame.unionByName, tagged)
    first = [F.min(F.when(F.col("list") == i, F.col("r"))).alias(f"r{i}") for i in range(len(used))]
    fused = every.groupBy("qid", key).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), *first)
    order = [F.desc("score"), *[F.asc_nulls_last(f"r{i}") for i in range(len(used))], F.asc(key)]
    return _ranked(fused, order).select("qid", key, "score", "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k_candidates: int, k_final: int, mode: str = "rrf", vector: str = "embedding", restrict: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): filtered lexical and vector candidates, fused, the first ``k_final``.

    ``queries``: qid, rewritten, filters (``filters_of``) and a query vector. ``restrict`` (qid, parent_id) leaves only
    children of these parents."""
    probes = queries.select("qid", F.col("q_embedding").alias(vector))
    if restrict is None:
        lexical = bm25_search(queries, chunks, k_candidates)
        near = knn_topk(probes, _seen_by(chunks, queries, vector), k_candidates, vector=vector, allowed="allowed")
    else:
        filters, read = filter_columns(queries, chunks)
        own = chunks.select("chunk_id", "parent_id", *read).join(restrict.select("qid", "parent_id").distinct(), "parent_id")
        passed = own.join(queries.select("qid", *filters), "qid").where(_passes(filters)).select("qid", "chunk_id")
        passed = materialize(passed, "passed")
        lexical = bm25_rank(queries, passed, zeros=False, k=k_candidates, texts=chunks)
        seen = chunks.select("chunk_id", vector).join(passed.groupBy("chunk_id").agg(F.collect_set("qid").alias("allowed")), "chunk_id")
        near = knn_topk(probes, seen, k_candidates, vector=vector, allowed="allowed")
    return rrf_fuse([lexical, near], mode=mode).where(F.col("rank") <= k_final)


def two_stage_search(
    queries: DataFrame, chunks: DataFrame, k: int = 6, parent_candidates: int = 200, parent_final: int = 60, child_candidates: int = 300, child_final: int = 30,
    mode: str = "rrf", rules: tuple[tuple[str, ...], ...] = RELAXED, max_steps: int = 2,
) -> DataFrame:
    """Ranked children (qid, chunk_id, rank, heading_path, two_stage_fallback, relax_steps and the parents found): children of
    the best parents; questions without parents or children search again without that restriction and relaxed."""
    parents = materialize(hybrid_search(queries, chunks.where("is_parent"), parent_candidates, parent_final, mode), "parents")
    best = parents.select("qid", F.col("chunk_id").alias("parent_id"))
    children = chunks.where("NOT is_parent")
    own = materialize(hybrid_search(queries, children, child_candidates, max(child_final, k), mode, restrict=best), "children")
    relaxed = materialize(relax_filters(queries, parents, own, rules, max_steps), "relaxed")
    ranked = own.join(relaxed.select("qid"), "qid", "left_anti").withColumns({"two_stage_fallback": F.lit(False), "relax_steps": F.lit(0)})
    if not relaxed.isEmpty():
        again = hybrid_search(relaxed, children, child_candidates, max(child_final, k), mode)
        ranked = ranked.unionByName(again.join(relaxed.select("qid", "two_stage_fallback", "relax_steps"), "qid"))
    headings = chunks.where("is_parent").select(F.col("chunk_id").alias("parent_id"), F.col("heading_path").alias("parent_heading"))
    headings = headings.join(best, "parent_id").select("qid", "parent_id", "parent_heading")
    placed = ranked.join(chunks.select("chunk_id", "parent_id", "heading_path"), "chunk_id").join(headings, ["qid", "parent_id"], "left")
    found = parents.groupBy("qid").agg(F.count("*").alias("parent_hits"))
    out = placed.withColumn("heading_path", F.coalesce("parent_heading", "heading_path")).join(found, "qid", "left")
    return out.select("qid", "chunk_id", "rank", "heading_path", "two_stage_fallback", "relax_steps", F.coalesce("parent_hits", F.lit(0)).alias("parent_hits"))


def _constraint_score(c: Column) -> Column:
    weight = F.greatest(F.lit(0.1), c["confidence"])
    t = range_overlap(F.col("T_K"), F.col("T_min_K"), F.col("T_max_K"), c["lo"], c["hi"])
    p = range_overlap(F.col("P_MPa"), F.col("P_min_MPa"), F.col("P_max_MPa"), c["lo"], c["hi"])
    same = F.lower(F.coalesce("stage", F.lit(""))) == F.lower(c["str_value"])
    held = F.when(c["name"] == "targets", F.col("targets")).otherwise(F.col("gas_agent"))
    hits = F.size(F.array_intersect(F.coalesce(held, F.array().cast("array<string>")), c["set_value"]))
    said = F.contains(F.lower(F.coalesce("coal_name", F.lit(""))), F.lower(c["str_value"]))
    value = (
        F.when(c["ctype"] == "range", F.when(F.when(c["name"] == "T_range_K", t).otherwise(p), 1.0).otherwise(-0.3))
        .when(c["ctype"] == "enum", F.when(same, 1.0).otherwise(-0.3))
        .when(c["ctype"] == "set", F.when(hits > 0, hits / F.greatest(F.size(c["set_value"]), F.lit(1))).otherwise(-0.2))
        .when(c["ctype"] == "text", F.when(said, 0.5).otherwise(0.0))
        .otherwise(0.0)
    )
    return value * weight


#: Sections that are no evidence.
NOISE = ("references", "acknowledgements", "contents", "appendix")


def soft_rank(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, drop_sections: tuple[str, ...] = NOISE, drop_reference_like: bool = True) -> DataFrame:
    """(qid, chunk_id, score, rank): soft constraints plus 1 / rank, without noise sections and reference lists."""
    soft = queries.select("qid", F.filter("constraints", lambda c: c["priority"] == "soft").alias("soft"))
    cols = ["chunk_id", "section", "stage", "gas_agent", "targets", "T_K", "T_min_K", "T_max_K", "P_MPa", "P_min_MPa", "P_max_MPa", "coal_name", "text"]
    rows = ranked.select("qid", "chunk_id", F.col("rank").alias("before")).join(chunks.select(*cols), "chunk_id").join(soft, "qid")
    rows = rows.where(~F.lower(F.trim(F.coalesce("section", F.lit("unknown")))).isin(*drop_sections)) if drop_sections else rows
    rows = rows.where(~is_reference_like("text")) if drop_reference_like else rows
    score = F.aggregate("soft", F.lit(0.0), lambda s, c: s + _constraint_score(c)) + 1.0 / F.col("before")
    return _ranked(rows.withColumn("score", F.round(score, DIGITS)), [F.desc("score"), F.asc("before")]).select("qid", "chunk_id", "score", "rank")


def apply_rerank_scores(ranked: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The first k results of a question in the order of external scores (qid, chunk_id, relevance_score), then the rest as
    they were; a question without scores keeps its order."""
    out = ranked.join(scores.select("qid", "chunk_id", "relevance_score"), ["qid", "chunk_id"], "left")
    head = (F.col("rank") <= k) & F.col("relevance_score").isNotNull()
    order = [F.desc(head), F.desc(F.when(head, F.col("relevance_score"))), F.asc("old_rank")]
    return _ranked(out.withColumnRenamed("rank", "old_rank").withColumn("rank", F.col("old_rank")), order).drop("relevance_score", "old_rank")


def cap_per_source(ranked: DataFrame, k: int, max_per_source: int = 2, source: str = "source_file") -> DataFrame:
    """The first k results with at most ``max_per_source`` of one source (no cap at 0 or below)."""
    out = ranked
    if max_per_source > 0:
        nth = F.row_number().over(W.partitionBy("qid", F.coalesce(source, F.lit("unknown"))).orderBy("rank"))
        out = out.withColumn("_nth", nth).where(F.col("_nth") <= max_per_source).drop("_nth")
    return _ranked(out, [F.asc("rank")]).where(F.col("rank") <= k)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 6, candidates: int | None = None, max_per_source: int = 2, where_mode: str = "hard_only", scores: DataFrame | None = None, fuse: bool = True) -> DataFrame:
    """The single-stage route for a table of questions (qid, raw, q_embedding): parse, rewrite, the ``candidates`` (``k`` where
    not given) nearest vectors of the chunks that pass, BM25 over these, fusion of both ranks, soft scores, external scores,
    cap. Beside the results each row has the numbers of its question's trace."""
    asked = materialize(filters_of(rewrite_queries(parse_queries(queries)), where_mode), "asked")
    probes = asked.select("qid", F.col("q_embedding").alias("embedding"))
    near = materialize(knn_topk(probes, _seen_by(chunks, asked, "embedding"), candidates or k, allowed="allowed"), "near")
    first = near
    if fuse:
        lexical = bm25_rank(asked, near.select("qid", "chunk_id"), texts=chunks)
        first = rrf_fuse([near, lexical])
    ranked = materialize(soft_rank(first, chunks, asked), "ranked")
    counted = near.groupBy("qid").agg(F.count("*").alias("vector_candidates")).join(ranked.groupBy("qid").agg(F.count("*").alias("postfiltered")), "qid", "left")
    if scores is not None:
        ranked = apply_rerank_scores(ranked, scores, k)
    held = ranked.join(chunks.select("chunk_id", "source_file", "page", "section"), "chunk_id").join(counted, "qid")
    return cap_per_source(held, k, max_per_source)


def retrieve_batch(queries: DataFrame, chunks: DataFrame, k: int = 6, max_per_source: int = 2, where_mode: str = "hard_only", scores: DataFrame | None = None, mode: str = "rrf", rules: tuple[tuple[str, ...], ...] = RELAXED, max_steps: int = 2) -> DataFrame:
    """The two-stage route: parents, children, relaxation, soft scores, external scores, cap. ``queries``: qid, raw and
    q_embedding; ``chunks``: parents and children with an embedding. Returns the ranked children with their place and the
    numbers of their question's trace: parent_hits, child_hits, relax_steps, postfiltered."""
    asked = materialize(filters_of(rewrite_queries(parse_queries(queries)), where_mode), "asked")
    staged = materialize(two_stage_search(asked, chunks, k, mode=mode, rules=rules, max_steps=max_steps), "staged")
    ranked = materialize(soft_rank(staged, chunks, asked), "ranked")
    counted = staged.groupBy("qid").agg(F.count("*").alias("child_hits")).join(ranked.groupBy("qid").agg(F.count("*").alias("postfiltered")), "qid", "left")
    if scores is not None:
        ranked = apply_rerank_scores(ranked, scores, k)
    place = staged.select("qid", "chunk_id", "heading_path", "two_stage_fallback", "relax_steps", "parent_hits")
    held = ranked.join(place, ["qid", "chunk_id"]).join(chunks.select("chunk_id", "source_file", "page"), "chunk_id").join(counted, "qid")
    return cap_per_source(held, k, max_per_source)


def retrieval_trace(queries: DataFrame, results: DataFrame, top: int = 3) -> DataFrame:
    """One row for each question (qid): the counts that ``results`` (of ``retrieve`` or ``retrieve_batch``) have for it, and its
    ``top`` scores and citations; zeros and empty lists for a question without results."""
    numbers = [c for c in ("vector_candidates", "parent_hits", "child_hits", "relax_steps", "postfiltered") if c in results.columns]
    heading = F.concat(F.lit(" ["), F.nullif(F.col("heading_path"), F.lit("")), F.lit("]")) if "heading_path" in results.columns else F.lit("")
    cited = F.concat(F.coalesce("source_file", F.lit("unknown")), F.coalesce(heading, F.lit("")), F.lit(" #"), F.col("chunk_id").cast("string"))
    own = results.where(F.col("rank") <= top).select("qid", F.struct("rank", "chunk_id", "score", cited.alias("cited")).alias("r"))
    own = own.groupBy("qid").agg(F.sort_array(F.collect_list("r")).alias("r"))
    counts = results.groupBy("qid").agg(F.count("*").alias("final"), *[F.max(c).alias(c) for c in numbers])
    out = queries.select("qid").join(counts, "qid", "left").join(own, "qid", "left")
    tops = F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    return out.select(
        "qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*numbers, "final"]],
        F.coalesce(tops, F.expr("filter(array(struct(cast(null AS string) AS chunk_id, cast(null AS double) AS score)), x -> false)")).alias("score_top"),
        F.coalesce(F.col("r.cited"), F.expr("cast(array() AS array<string>)")).alias("citations"),
    )
