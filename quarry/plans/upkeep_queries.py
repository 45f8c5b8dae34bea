"""Incremental upkeep, evaluation and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.metadata import extract_metadata
from quarry.operators import evaluate as ev
from quarry.operators import incremental as inc
from quarry.operators.search import _ranked
from quarry.plans.metadata_queries import SQL_META, tagged
from quarry.plans.search_queries import SQL_ASKED as _ASKED
from quarry.plans.search_queries import asked, questions
from quarry.plans.views import CHUNKS, FILES, MANIFEST, said, table, view
from quarry.scratch import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_SQL = f"files AS ({said(FILES)}), manifest AS ({said(MANIFEST)})"
_STATUS = """CASE WHEN f.path IS NULL THEN 'removed' WHEN m.path IS NULL THEN 'new' WHEN f.mtime_ns = m.mtime_ns AND f.size = m.size THEN 'unchanged'
  WHEN f.sha256 = m.sha256 THEN 'metadata_only' ELSE 'changed' END"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.diff_manifest(view(spark, sf_dir, FILES), view(spark, sf_dir, MANIFEST))


QUERIES["diff_manifest"] = _diff
ORACLE["diff_manifest"] = f"""WITH {_SQL} SELECT coalesce(f.path, m.path) AS path, {_STATUS} AS status, f.sha256 AS sha256, m.sha256 AS old_sha256,
  coalesce(f.mtime_ns, m.mtime_ns) AS mtime_ns, coalesce(f.size, m.size) AS size FROM files f FULL JOIN manifest m ON f.path = m.path"""


def removed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are gone."""
    return inc.removed_paths(view(spark, sf_dir, MANIFEST), view(spark, sf_dir, FILES))


QUERIES["removed_paths"] = removed_paths
ORACLE["removed_paths"] = f"WITH {_SQL} SELECT path FROM manifest EXCEPT SELECT path FROM files"


def delete_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks of their orders, without the orders of the last priority; how many chunks each order keeps."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("active").alias("status"), "o_orderpriority")
    kept, marked = inc.delete_by_document(chunks, documents, documents.where("o_orderpriority LIKE '5%'"))
    n = kept.groupBy("document_id").agg(F.count("*").alias("n"))
    return marked.join(n, "document_id", "left").select("document_id", "status", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES["delete_by_document"] = delete_by_document
ORACLE["delete_by_document"] = """SELECT o_orderkey AS document_id, CASE WHEN o_orderpriority LIKE '5%' THEN 'removed' ELSE 'active' END AS status,
  CASE WHEN o_orderpriority LIKE '5%' THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n FROM orders"""


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table after two batches of new texts, the later one winning."""
    rows = view(spark, sf_dir, CHUNKS)
    batch = lambda n, section: rows.where(F.col("section") == section).withColumns({"text": F.concat(F.lit(f"{n}:"), "text"), "batch": F.lit(n)})
    new = batch(1, "methods").unionByName(batch(2, "methods").where("page < 20")).unionByName(batch(2, "results"))
    out = inc.upsert(rows.where("section <> 'results'").withColumn("batch", F.lit(0)), new, "chunk_id", ("batch",))
    return out.select("chunk_id", "batch", F.md5("text").alias("text_md5"))


QUERIES["upsert_chunks"] = upsert_chunks
ORACLE["upsert_chunks"] = f"""WITH c AS ({said(CHUNKS)}),
b AS (SELECT chunk_id, CASE WHEN section = 'results' OR (section = 'methods' AND page < 20) THEN 2 WHEN section = 'methods' THEN 1 ELSE 0 END AS batch, text FROM c)
SELECT chunk_id, CAST(batch AS INT) AS batch, md5(CASE WHEN batch > 0 THEN CAST(batch AS VARCHAR) || ':' ELSE '' END || text) AS text_md5 FROM b"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")
    key = inc.cache_key(F.col("doc_id").cast("string"), F.lit("m"), F.lit("v1"), "text")
    payload = F.when(F.col("doc_id") % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"stage":"s'), (F.col("doc_id") % 4).cast("string"), F.lit('"}')))
    return docs.select(key.alias("cache_key"), payload.alias("payload_json"), F.lit(1).cast("long").alias("created_at"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cached payload, null for a miss."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    hits, misses = inc.cache_lookup(docs, _cache(spark, sf_dir), "m", "v1", "stage STRING")
    return hits.select("chunk_id", F.col("payload.stage").alias("stage")).unionByName(misses.select("chunk_id", F.lit(None).cast("string").alias("stage")))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a run that renews the broken payloads."""
    cache = _cache(spark, sf_dir)
    new = cache.where("payload_json = '{broken'").withColumns({"payload_json": F.lit("{}"), "created_at": F.lit(2).cast("long")})
    return inc.cache_upsert(cache, new).groupBy("payload_json", "created_at").agg(F.count("*").alias("n"))


QUERIES |= {"cache_lookup": cache_lookup, "cache_upsert": cache_upsert}
ORACLE["cache_lookup"] = "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 's' || CAST(doc_id % 4 AS VARCHAR) END AS stage FROM documents"
ORACLE["cache_upsert"] = """SELECT CASE WHEN doc_id % 5 = 0 THEN '{}' ELSE '{"stage":"s' || CAST(doc_id % 4 AS VARCHAR) || '"}' END AS payload_json,
  CAST(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS created_at, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2"""


def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as models: the brands of small parts are known, all parts are new."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("embedding_model"), F.col("p_size").alias("embedding_dim"), F.lit("v1").alias("embedding_version"))
    return inc.distinct_models(parts.where("embedding_dim < 10").distinct(), parts)


QUERIES["distinct_models"] = distinct_models
ORACLE["distinct_models"] = "SELECT DISTINCT p_brand AS embedding_model, p_size AS embedding_dim, 'v1' AS embedding_version FROM part"


# ---------------------------------------------------------------------------------------------------------- evaluation
def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expected source for each question, in some with a page."""
    n = F.col("qid").cast("int")
    source = F.struct(F.concat(F.lit("PAPER_"), (n * 2 % 50).cast("string"), F.lit(".")).alias("source_file"), F.when(n % 4 == 0, n % 40).cast("int").alias("page"), F.lit("").alias("chunk_id"))
    by_page = F.struct(F.lit("").alias("source_file"), F.when(n % 3 == 0, F.lit(7)).cast("int").alias("page"), F.lit("").alias("chunk_id"))
    return questions(spark, sf_dir).select("qid", F.col("raw").alias("query"), F.lit("").alias("expected_stage"), F.array(source, by_page).alias("expected_sources"))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks ranked for every question by their distance in key order: a fixed ranking to evaluate. The order asks for keys
    only, so just the chunks that have a place are tagged."""
    rows = view(spark, sf_dir, CHUNKS)
    paper = lambda n: F.concat(F.lit("paper_"), (F.col("qid").cast("int") * n % 50).cast("string"), F.lit(".pdf"))
    q = questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(F.array(paper(2), paper(3)))).alias("source_file"))
    picked = rows.join(q, "source_file")
    return extract_metadata(_ranked(picked, [F.asc(F.md5(F.concat("qid", "chunk_id")))]).where("rank <= 10"))


_TOP = f"""{SQL_META}, qs AS (SELECT CAST(n_nationkey AS VARCHAR) AS qid, n_nationkey AS n FROM nation),
ranked AS (SELECT qid, n, meta.*, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || chunk_id)) AS rank FROM meta JOIN qs
  ON source_file IN ('paper_' || CAST(n * 2 % 50 AS VARCHAR) || '.pdf', 'paper_' || CAST(n * 3 % 50 AS VARCHAR) || '.pdf') QUALIFY rank <= 10),
hits AS (SELECT *, (contains(source_file, 'paper_' || CAST(n * 2 % 50 AS VARCHAR) || '.') AND (n % 4 <> 0 OR page = n % 40)) OR (n % 3 = 0 AND page = 7) AS is_hit FROM ranked)"""


def match_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the ranked chunks are expected."""
    return ev.match_gold(_top(spark, sf_dir), gold(spark, sf_dir)).select("qid", "chunk_id", "rank", "is_hit")


def eval_precision_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and reciprocal rank of that ranking."""
    g = gold(spark, sf_dir)
    return ev.eval_precision_recall_mrr(ev.match_gold(_top(spark, sf_dir), g), g, 10)


def eval_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report at 1, 3 and 5."""
    matched = materialize(ev.match_gold(_top(spark, sf_dir), gold(spark, sf_dir)), "matched")
    return ev.eval_retrieval_report(matched, asked(spark, sf_dir))


QUERIES |= {"match_gold": match_gold, "eval_precision_recall_mrr": eval_precision_recall_mrr, "eval_retrieval_report": eval_retrieval_report}
ORACLE["match_gold"] = f"WITH {_TOP} SELECT qid, chunk_id, CAST(rank AS INT) AS rank, is_hit FROM hits"
ORACLE["eval_precision_recall_mrr"] = f"""WITH {_TOP}, p AS (SELECT qid, count(*) AS h, min(rank) AS first FROM hits WHERE is_hit GROUP BY qid), t AS (SELECT count(*) AS n FROM nation)
SELECT round((SELECT coalesce(sum(h), 0) FROM p) / (n * 10), 6) AS precision_at_k, round((SELECT count(*) FROM p) / n, 6) AS recall_at_k, round((SELECT coalesce(sum(CAST(1 AS DOUBLE) / first), 0) FROM p) / n, 6) AS mrr FROM t"""

ORACLE["eval_retrieval_report"] = f"""WITH {_TOP}, {_ASKED},
c AS (SELECT h.qid, h.rank, h.is_hit, h.source_file, h.section,
    list_filter([CASE WHEN a.q_stage <> 'unknown' THEN h.stage = a.q_stage END, CASE WHEN q_gas IS NOT NULL THEN coalesce(list_has_any(gas_agent, q_gas), false) END, CASE WHEN q_targets IS NOT NULL THEN coalesce(list_has_any(targets, q_targets), false) END,
      CASE WHEN t_lo IS NOT NULL THEN coalesce(CASE WHEN T_min_K IS NOT NULL THEN greatest(T_min_K, t_lo) <= least(T_max_K, t_hi) ELSE T_K BETWEEN t_lo AND t_hi END, false) END,
      CASE WHEN p_lo IS NOT NULL THEN coalesce(CASE WHEN P_min_MPa IS NOT NULL THEN greatest(P_min_MPa, p_lo) <= least(P_max_MPa, p_hi) ELSE P_MPa BETWEEN p_lo AND p_hi END, false) END], lambda x: x IS NOT NULL) AS checks
  FROM hits h JOIN asked a USING (qid)),
k AS (SELECT unnest([1, 3, 5]) AS k),
per AS (SELECT c.qid, k, max(is_hit::INT) AS r, count(*) FILTER (len(checks) > 0 AND list_bool_and(checks)) / least(k, max(n)) AS f, count(DISTINCT source_file) AS d, max((section = 'references')::INT) AS x
  FROM c JOIN k ON rank <= k JOIN (SELECT qid, max(rank) AS n FROM c GROUP BY qid) z ON z.qid = c.qid GROUP BY c.qid, k),
s AS (SELECT k, sum(r) / (SELECT count(*) FROM nation) AS r, sum(f) / (SELECT count(*) FROM nation) AS f, sum(d) / (SELECT count(*) FROM nation) AS d, sum(x) / (SELECT count(*) FROM nation) AS x FROM per GROUP BY k)
SELECT 'Recall' AS metric, CAST(k AS INT) AS k, round(r, 6) AS value FROM s UNION ALL SELECT 'FilterPrecision', k, round(f, 6) FROM s UNION ALL SELECT 'Diversity', k, round(d, 6) FROM s
UNION ALL SELECT 'ReferencesHit', k, round(x, 6) FROM s UNION ALL SELECT 'ChildrenRecall', k, round(r, 6) FROM s WHERE k = 5"""


def result_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a language's documents spread over sources."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("qid"), "source")
    out = ev.result_distribution(docs, "source")
    pairs = F.transform(F.array_sort(F.map_entries("distribution")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("qid", F.array_join(pairs, ",").alias("distribution"), "diversity")


QUERIES["result_distribution"] = result_distribution
ORACLE["result_distribution"] = """WITH c AS (SELECT lang AS qid, source, count(*) AS n FROM documents GROUP BY lang, source)
SELECT qid, string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS distribution, count(*) AS diversity FROM c GROUP BY qid"""


def citation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation markers in the conversations, put where commas stand."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", ",", " [1]").alias("answer"))
    return ev.citation_rate(rows).select("conv_id", "turn", F.round("citation_rate", 6).alias("citation_rate"))


QUERIES["citation_rate"] = citation_rate
ORACLE["citation_rate"] = "SELECT conv_id, turn, round(least((length(coalesce(text, '')) - length(replace(coalesce(text, ''), ',', ''))) / CAST(6 AS DOUBLE), 1), 6) AS citation_rate FROM conversations"


def json_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as responses, every tenth with trailing text."""
    text = F.concat(F.lit("### Response: "), "props", F.when(F.col("event_id") % 10 == 0, " and more").otherwise(""))
    return ev.json_parse_rate(table(spark, sf_dir, "events").select(text.alias("text")))


QUERIES["json_parse_rate"] = json_parse_rate
ORACLE["json_parse_rate"] = "SELECT count(*) AS samples, round(count(*) FILTER (json_valid(props) AND event_id % 10 <> 0) / count(*), 6) AS json_parse_rate FROM events"


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run over the manifest view and the chunk view."""
    counted = ["source_file", "section", "stage", "gas_agent", "targets", "T_K", "T_min_K", "P_MPa", "P_min_MPa", "text"]
    chunks = materialize(tagged(spark, sf_dir).select(*counted), "tagged")  # proofs and confidences are not counted, so not made
    dropped = chunks.where("section = 'references'").groupBy("section").agg(F.count("*").alias("n"))
    return ev.ingest_stats(_diff(spark, sf_dir), chunks, chunks, dropped)[0]


QUERIES["ingest_stats"] = ingest_stats
ORACLE["ingest_stats"] = f"""WITH {_SQL}, {SQL_META}, d AS (SELECT {_STATUS} AS status FROM files f FULL JOIN manifest m ON f.path = m.path)
SELECT * FROM (SELECT count(*) AS files_scanned, {", ".join(f"count(*) FILTER (status = '{s}') AS files_{s}" for s in ("new", "changed", "metadata_only", "unchanged", "removed"))} FROM d),
 (SELECT count(*) AS pages, count(*) FILTER (stage <> 'unknown') AS pages_with_stage, count(gas_agent) AS pages_with_gas, count(T_K) AS pages_with_T, count(P_MPa) AS pages_with_P,
    count(*) AS chunks, round(avg(length(text)), 6) AS mean_chunk_chars, count(gas_agent) AS chunks_with_gas, count(targets) AS chunks_with_target,
    count(*) FILTER (gas_agent IS NOT NULL OR targets IS NOT NULL) AS chunks_with_any FROM meta)"""


def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the vector table as a chunk table."""
    out = ev.validate_chunks(table(spark, sf_dir, "embeddings"), 64, {"vec_id": "bigint", "is_parent": "boolean", "label": "string"})
    return out.select("doc_count", "embedding_dims", "ok", F.array_join("errors", "; ").alias("errors"))


QUERIES["validate_chunks"] = validate_chunks
ORACLE["validate_chunks"] = "SELECT count(*) AS doc_count, CAST(max(len(embedding)) AS INT) AS embedding_dims, false AS ok, 'missing field: is_parent; field type mismatch: label=int expected=string' AS errors FROM embeddings"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("input"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "t"], "left").select(F.concat(F.lit("Answer turn "), F.col("t").cast("string")).alias("instruction"), "input", "output")


_PAIRS = """pairs AS (SELECT 'Answer turn ' || CAST(u.turn AS VARCHAR) AS instruction, u.text AS input, a.text AS output FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1)"""


def build_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete pair with the side it falls on."""
    train, val = ev.build_train_val(pairs(spark, sf_dir))
    named = lambda df, side: df.select(F.md5(F.concat_ws("|", "instruction", "input", "output")).alias("pair_md5"), F.lit(side).alias("side"))
    return named(train, "train").unionByName(named(val, "val"))


QUERIES["build_train_val"] = build_train_val
ORACLE["build_train_val"] = f"""WITH {_PAIRS},
k AS (SELECT *, md5(concat_ws(chr(1), '42', instruction, input, output)) AS h FROM pairs WHERE input IS NOT NULL AND output IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS n, count(*) OVER () AS total FROM k)
SELECT md5(concat_ws('|', instruction, input, output)) AS pair_md5, CASE WHEN n <= greatest(1, total // 10) THEN 'val' ELSE 'train' END AS side FROM r"""


def format_training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts of all pairs."""
    return ev.format_training_text(pairs(spark, sf_dir)).select(F.md5("text").alias("text_md5"), F.length("text").alias("n"))


QUERIES["format_training_text"] = format_training_text
ORACLE["format_training_text"] = f"""WITH {_PAIRS}, t AS (SELECT '### Instruction:' || chr(10) || trim(instruction, ' ') || chr(10) || chr(10) || '### Input:' || chr(10) || trim(coalesce(input, ''), ' ') || chr(10) || chr(10)
  || '### Response:' || chr(10) || trim(coalesce(output, ''), ' ') AS text FROM pairs) SELECT md5(text) AS text_md5, CAST(length(text) AS INT) AS n FROM t"""
