"""Quality of retrieval and extraction, ingest statistics, table health and training sets."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.helpers import json_parses
from quarry.operators.layout import is_reference_like
from quarry.operators.questions import range_overlap
from quarry.operators.search import knn_topk

GOLD = "qid STRING, query STRING, expected_stage STRING, expected_sources ARRAY<STRUCT<source_file: STRING, page: INT, chunk_id: STRING>>"


def match_gold(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``ranked`` plus is_hit: a chunk id that is expected, else a source that contains an expected one, on its page if one is
    given; an expected page alone decides by the page."""
    src = F.lower(F.coalesce("source_file", F.lit("")))

    def hit(g):
        named = F.coalesce(g["source_file"], F.lit("")) != ""
        by_id = F.coalesce((g["chunk_id"] != "") & (g["chunk_id"] == F.col("chunk_id").cast("string")), F.lit(False))
        inside = F.when(named, F.contains(src, F.lower(g["source_file"]))).otherwise(F.lit(True))
        return by_id | (inside & F.when(g["page"].isNotNull(), F.coalesce(g["page"] == F.col("page"), F.lit(False))).otherwise(named))

    rows = ranked.join(gold.select("qid", "expected_sources"), "qid", "left")
    return rows.withColumn("is_hit", F.coalesce(F.exists("expected_sources", hit), F.lit(False))).drop("expected_sources")


def eval_precision_recall_mrr(matched: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row: precision (hits over questions times k), recall (questions with a hit) and mean reciprocal rank."""
    per = matched.where((F.col("rank") <= k) & F.col("is_hit")).groupBy("qid").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    total = F.greatest(F.count("*"), F.lit(1))
    return gold.select("qid").join(per, "qid", "left").agg(
        F.round(F.coalesce(F.sum("hits"), F.lit(0)) / (total * k), 6).alias("precision_at_k"),
        F.round(F.count("hits") / total, 6).alias("recall_at_k"),
        F.round(F.coalesce(F.sum(1.0 / F.col("first")), F.lit(0.0)) / total, 6).alias("mrr"),
    )


def eval_retrieval_report(matched: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(metric, k, value), means over all questions: Recall, FilterPrecision, Diversity and ReferencesHit at each k,
    ParentsRecall and ChildrenRecall. ``matched`` carries the chunk columns; ``queries`` the parsed constraints."""
    parsed = queries.select("qid", "q_stage", "q_gas_agent", "q_targets", "q_T", "q_P")
    rows = matched.join(parsed, "qid")
    lo, hi = (lambda c: F.col(f"{c}.lo")), (lambda c: F.col(f"{c}.hi"))
    checks = [
        F.when(F.col("q_stage") != "unknown", F.coalesce(F.col("stage") == F.col("q_stage"), F.lit(False))),
        F.when(F.col("q_gas_agent").isNotNull(), F.coalesce(F.arrays_overlap("gas_agent", "q_gas_agent"), F.lit(False))),
        F.when(F.col("q_targets").isNotNull(), F.coalesce(F.arrays_overlap("targets", "q_targets"), F.lit(False))),
        F.when(F.col("q_T").isNotNull(), range_overlap(F.col("T_K"), F.col("T_min_K"), F.col("T_max_K"), lo("q_T"), hi("q_T"))),
        F.when(F.col("q_P").isNotNull(), range_overlap(F.col("P_MPa"), F.col("P_min_MPa"), F.col("P_max_MPa"), lo("q_P"), hi("q_P"))),
    ]
    applied = F.array_compact(F.array(*checks))
    rows = rows.withColumn("_ok", (F.size(applied) > 0) & F.forall(applied, lambda x: x)).withColumn("_ref", (F.lower(F.coalesce("section", F.lit(""))) == "references") | is_reference_like("text"))
    sizes = rows.groupBy("qid").agg(F.max("rank").alias("_n"))
    at = rows.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k").join(sizes, "qid")
    per = at.groupBy("qid", "k").agg(
        F.max(F.col("is_hit").cast("int")).alias("recall"), (F.count_if("_ok") / F.least("k", F.max("_n"))).alias("filter"),
        F.count_distinct(F.nullif("source_file", F.lit(""))).alias("diversity"), F.max(F.col("_ref").cast("int")).alias("references"),
    )
    total = queries.select("qid").distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    sums = per.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("recall", "filter", "diversity", "references")]).crossJoin(F.broadcast(total))
    named = {"Recall": "recall", "FilterPrecision": "filter", "Diversity": "diversity", "ReferencesHit": "references"}
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(c) / F.col("total")).alias("value")) for m, c in named.items()])
    report = sums.select("k", F.explode(pairs).alias("p")).select("p.metric", "k", F.round("p.value", 6).alias("value"))
    most = max(ks)
    children = report.where((F.col("metric") == "Recall") & (F.col("k") == most)).select(F.lit("ChildrenRecall").alias("metric"), "k", "value")
    if "parent_hits" not in matched.columns:
        return report.unionByName(children)
    found = matched.where("parent_hits > 0").agg(F.count_distinct("qid").alias("n")).crossJoin(F.broadcast(total))
    parents = found.select(F.lit("ParentsRecall").alias("metric"), F.lit(most).alias("k"), F.round(F.col("n") / F.col("total"), 6).alias("value"))
    return report.unionByName(children).unionByName(parents)


def result_distribution(ranked: DataFrame, key: str) -> DataFrame:
    """(qid, distribution, diversity): how often each value of ``key`` is among a question's results; empty ones are
    ``unknown``."""
    named = ranked.select("qid", F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias("v"))
    counts = named.groupBy("qid", "v").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("distribution"), F.count("*").alias("diversity"))


def citation_rate(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """``answers`` plus citation_rate: numbered markers over six, at most 1."""
    return answers.withColumn("citation_rate", F.least(F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"\[[0-9]+\]")) / 6.0, F.lit(1.0)))


def json_parse_rate(predictions: DataFrame, text_col: str = "text") -> DataFrame:
    """(samples, json_parse_rate): how many responses are strict JSON."""
    mark = "### Response:"
    text = F.coalesce(text_col, F.lit(""))
    said = F.when(F.contains(text, F.lit(mark)), F.expr(f"substring({text_col}, instr({text_col}, '{mark}') + {len(mark)})")).otherwise(text)
    return predictions.select(json_parses(F.trim(said)).alias("ok")).agg(F.count("*").alias("samples"), F.round(F.count_if("ok") / F.greatest(F.count("*"), F.lit(1)), 6).alias("json_parse_rate"))


def ingest_stats(diff: DataFrame, pages: DataFrame, chunks: DataFrame, dropped: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(one row of totals, tables of counts): files by status, pages with metadata, chunks and their mean length, chunks with
    gas or target; counts by document type, language, dropped section and file."""
    files = diff.agg(F.count("*").alias("files_scanned"), *[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("new", "changed", "metadata_only", "unchanged", "removed")])
    of_pages = pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("stage") != "unknown").alias("pages_with_stage"), F.count_if(F.col("gas_agent").isNotNull()).alias("pages_with_gas"),
        F.count_if(F.coalesce("T_K", "T_min_K").isNotNull()).alias("pages_with_T"), F.count_if(F.coalesce("P_MPa", "P_min_MPa").isNotNull()).alias("pages_with_P"),
    )
    gas, target = F.col("gas_agent").isNotNull(), F.col("targets").isNotNull()
    of_chunks = chunks.agg(
        F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("mean_chunk_chars"), F.count_if(gas).alias("chunks_with_gas"),
        F.count_if(target).alias("chunks_with_target"), F.count_if(gas | target).alias("chunks_with_any"),
    )
    tables = {c: pages.groupBy(c).agg(F.count("*").alias("n")) for c in ("doc_type", "language") if c in pages.columns}
    tables |= {"dropped_by_section": dropped, "chunks_per_file": chunks.groupBy("source_file").agg(F.count("*").alias("n"))}
    return files.crossJoin(of_pages).crossJoin(of_chunks), tables


def validate_chunks(chunks: DataFrame, expected_dims: int, required: Mapping[str, str], min_docs: int = 1, vector: str = "embedding") -> DataFrame:
    """One row (doc_count, embedding_dims, ok, errors): enough rows, required columns and types, vectors of one length, and a
    search with a stored vector that finds a row."""
    errors = [f"missing field: {c}" if c not in chunks.columns else f"field type mismatch: {c}={dict(chunks.dtypes)[c]} expected={t}" for c, t in required.items() if dict(chunks.dtypes).get(c) != t]
    size = F.size(vector) if vector in chunks.columns else F.lit(None).cast("int")
    hits = 0
    if vector in chunks.columns:
        probe = chunks.where(F.size(vector) == expected_dims).select(F.lit("self").alias("qid"), vector).limit(1)
        hits = knn_topk(probe, chunks.where(F.size(vector) == expected_dims).select(F.lit(0).alias("chunk_id"), vector), 1, vector=vector).where("cosine > 0").count()
    one = chunks.agg(F.count("*").alias("doc_count"), F.max(size).alias("embedding_dims"), F.min(size).alias("_least"))
    found = [
        F.when(F.col("doc_count") < min_docs, F.concat(F.lit("doc_count="), F.col("doc_count").cast("string"), F.lit(f" < {min_docs}"))),
        F.when((F.coalesce("embedding_dims", F.lit(-1)) != expected_dims) | (F.col("_least") != expected_dims), F.concat(F.lit("embedding dims mismatch: "), F.coalesce(F.col("embedding_dims").cast("string"), F.lit("none")), F.lit(f" expected={expected_dims}"))),
        F.when(F.lit(hits == 0), "self-search returned no hits"),
    ]
    every = F.concat(F.array(*[F.lit(e) for e in errors]).cast("array<string>"), F.array_compact(F.array(*found)))
    return one.withColumn("errors", every).select("doc_count", "embedding_dims", (F.size("errors") == 0).alias("ok"), "errors")


def build_train_val(pairs: DataFrame, val_ratio: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, val) of complete pairs in a seeded hash order: the lowest max(1, n * ratio) hashes validate.

    The cut is found from the counts of 65,536 buckets of the hash; only the pairs of the bucket it falls in are ordered, by
    hash alone, and texts stay where they are."""
    key = F.md5(F.concat_ws("\x01", F.lit(str(seed)), "instruction", "input", "output"))
    whole = pairs.where("instruction IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL").withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 4))
    counts = sorted((r["_b"], r["_c"]) for r in whole.groupBy("_b").agg(F.count("*").alias("_c")).collect())
    upto = list(accumulate(c for _, c in counts))
    n_val = max(1, int(upto[-1] * val_ratio)) if counts else 0
    edge, before = next(((b, total - c) for (b, c), total in zip(counts, upto) if total >= n_val), ("", 0))
    hashes = whole.where(F.col("_b") == edge).groupBy("_h").agg(F.count("*").alias("_c"))
    starts = hashes.withColumn("_start", F.lit(before) + F.coalesce(F.sum("_c").over(W.partitionBy(F.substring("_h", 1, 4)).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = whole.where(F.col("_b") == edge).withColumn("_n", F.row_number().over(W.partitionBy("_h").orderBy("_h"))).join(starts.select("_h", "_start"), "_h")
    chosen = F.col("_start") + F.col("_n") <= n_val
    parts = [whole.where(F.col("_b") > edge).select(*pairs.columns), whole.where(F.col("_b") < edge).select(*pairs.columns)]
    return tuple(part.unionByName(inside.where(keep).select(*pairs.columns)) for part, keep in zip(parts, (~chosen, chosen)))


def format_training_text(pairs: DataFrame) -> DataFrame:
    """``pairs`` plus text: instruction, input and response under their headings."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    text = F.concat(F.lit("### Instruction:\n"), part("instruction"), F.lit("\n\n### Input:\n"), part("input"), F.lit("\n\n### Response:\n"), part("output"))
    return pairs.withColumn("text", text)
