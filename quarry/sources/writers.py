"""Exports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORT = ["record_id", "source_file", "stage", "coal_name", "reactor_type", "T_K", "P_MPa", "gas_agent_json", "ratios_json", "pollutants_json", "created_at", "updated_at"]


def export_rows(records: DataFrame, limit: int = 2000) -> DataFrame:
    """The newest records in the export's columns, nested values as JSON."""
    newest = records.orderBy(F.desc("updated_at"), F.asc("record_id")).limit(limit)
    return newest.withColumns({f"{c}_json": F.to_json(c) for c in ("gas_agent", "ratios", "pollutants")}).select(*EXPORT)


def export_records(records: DataFrame, path: str, limit: int = 2000) -> None:
    """One CSV with a header."""
    export_rows(records, limit).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_train_val(train: DataFrame, val: DataFrame, root: str) -> None:
    """Two folders of JSON lines."""
    train.write.mode("overwrite").json(f"{root}/train")
    val.write.mode("overwrite").json(f"{root}/val")


def query_log_rows(results: DataFrame, queries: DataFrame, backend: str = "spark", mode: str = "two_stage") -> DataFrame:
    """One log row for each question: the text, its constraints and the top chunks and sources as JSON."""
    top = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_file"))).alias("t"), F.count_distinct("source_file").alias("diversity_k"))
    rows = queries.select("qid", F.col("raw").alias("query"), F.to_json("constraints").alias("constraints_json")).join(top, "qid", "left")
    chunk_ids, sources = F.to_json(F.transform("t", lambda z: z["chunk_id"])), F.to_json(F.transform("t", lambda z: z["source_file"]))
    return rows.select("qid", "query", "constraints_json", chunk_ids.alias("top_chunk_ids_json"), sources.alias("top_source_files_json"), F.coalesce("diversity_k", F.lit(0)).alias("diversity_k"), F.lit(backend).alias("backend"), F.lit(mode).alias("mode"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows with the time of writing; a run's log, metrics and ingest rows all go this way."""
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def run_metric_rows(metrics: DataFrame, run_id: str, index_name: str, doc_count: int) -> DataFrame:
    """One row for an evaluation run."""
    return metrics.select(F.lit(run_id).alias("run_id"), F.lit(index_name).alias("index_name"), F.lit(doc_count).alias("doc_count"), "precision_at_k", "recall_at_k", "mrr")


def ingest_run_rows(stats: DataFrame, run_id: str, status: str = "ok") -> DataFrame:
    """One row for an ingest run, its statistics as JSON."""
    return stats.select(F.lit(run_id).alias("run_id"), F.to_json(F.struct("*")).alias("stats_json"), F.lit(status).alias("status"))
