"""Cited context and answers for ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import format_citation

#: What is said without enough evidence, and before the citations.
REFUSAL = "无法可靠回答：证据不足。请补充更明确的工况/目标污染物证据。"
NOTHING = "未检索到相关证据。建议：放宽条件（温度/压力范围）或减少过滤条件（气化剂/阶段）。"
ANSWER = "基于检索证据，结论如下：\n\n- 关键结论请结合证据片段核验 "
EVIDENCE_ONLY = "（当前未启用LLM生成答案，以下为检索到的证据片段，供你人工总结/核对）\n\n"


def build_context(ranked: DataFrame, max_chunks: int = 8, deduplicate: bool = True) -> DataFrame:
    """(qid, markdown, citations, used_chunks, dropped): the first ``max_chunks`` results of each question without repeated
    texts, numbered S1.., grouped by heading (else parent, else source) in the order of first appearance.

    ``ranked``: qid, rank, chunk_id, parent_id, source_file, page, heading_path, text."""
    head = ranked.where(F.col("rank") <= max_chunks).withColumn("_key", F.lower(F.trim(F.coalesce("text", F.lit("")))))
    again = F.row_number().over(W.partitionBy("qid", "_key").orderBy("rank")) > 1
    head = head.withColumn("_again", again & F.lit(deduplicate))
    kept = head.where(~F.col("_again"))
    group = F.coalesce(F.nullif("heading_path", F.lit("")), F.nullif("parent_id", F.lit("")), F.nullif("source_file", F.lit("")), F.lit("unknown"))
    kept = kept.withColumns({"_n": F.row_number().over(W.partitionBy("qid").orderBy("rank")), "_group": group})
    kept = kept.withColumn("_first", F.min("_n").over(W.partitionBy("qid", "_group")))
    line = F.concat(F.when(F.col("_n") == F.col("_first"), F.concat(F.lit("## "), F.col("_group"), F.lit("\n"))).otherwise(""), F.lit("- [S"), F.col("_n").cast("string"), F.lit("] "), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, 500))
    cite = F.struct("_n", F.concat(F.lit("S"), F.col("_n").cast("string")).alias("sid"), "source_file", "page", "heading_path", "chunk_id")
    packed = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_first", "_n", line.alias("line")))).alias("l"), F.array_sort(F.collect_list(cite)).alias("c"))
    dropped = head.groupBy("qid").agg(F.count_if("_again").alias("dropped"))
    strip = F.transform("c", lambda z: F.struct(z["sid"].alias("sid"), z["source_file"].alias("source_file"), z["page"].alias("page"), z["heading_path"].alias("heading_path"), z["chunk_id"].alias("chunk_id")))
    out = packed.select("qid", F.array_join(F.transform("l", lambda z: z["line"]), "\n").alias("markdown"), strip.alias("citations"), F.transform("c", lambda z: z["chunk_id"]).alias("used_chunks"))
    return out.join(dropped, "qid")


def answer_gate(queries: DataFrame, context: DataFrame, min_evidence: int = 2, output_format: str = "markdown") -> DataFrame:
    """(qid, answer_text, reason): refused with fewer than ``min_evidence`` chunks, else an answer that cites them; questions
    without any result say so."""
    rows = queries.select("qid").join(context, "qid", "left")
    n = F.coalesce(F.size("used_chunks"), F.lit(0))
    sids = F.transform("citations", lambda c: c["sid"])
    if output_format == "json":
        text = F.to_json(F.struct(F.lit("evidence").alias("summary"), sids.alias("citations")))
    else:
        text = F.concat(F.lit(ANSWER), F.array_join(F.transform(sids, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " "), F.lit("\n"))
    said = F.when(F.col("used_chunks").isNull(), F.lit(NOTHING)).when(n < min_evidence, F.lit(REFUSAL)).otherwise(text)
    reason = F.when(F.col("used_chunks").isNull(), "no_results").when(n < min_evidence, "insufficient_evidence").otherwise("answered")
    return rows.select("qid", said.alias("answer_text"), reason.alias("reason"))


def evidence_block(ranked: DataFrame, max_chars: int = 900) -> DataFrame:
    """(qid, block): numbered citations with excerpts, in rank order. ``ranked`` also has title and page_label."""
    cite = format_citation(F.col("title"), F.col("source_file"), F.col("page_label"), F.col("page"), F.col("chunk_id"))
    item = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), cite, F.lit("\n"), F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, max_chars))
    rows = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("i"))
    return rows.select("qid", F.concat(F.lit(EVIDENCE_ONLY), F.array_join(F.transform("i", lambda z: z["item"]), "\n\n")).alias("block"))
