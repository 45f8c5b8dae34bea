"""Text functions over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import helpers, text
from quarry.plans.views import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_DASHED = "replace(text, 'e ', concat('e-', chr(10)))"


def _docs(spark: SparkSession, sf_dir: str, dashed: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.withColumn("text", F.expr(_DASHED)) if dashed else docs


def _scalar(name: str, make, sql: str | None, dashed: bool = False) -> None:
    """Register a column of the documents' text and its SQL over ``text``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _docs(spark, sf_dir, dashed).select("doc_id", make().alias("value"))

    run.__doc__ = f"{name} of every document."
    QUERIES[name] = run
    if sql:
        source = f"(SELECT doc_id, source, {_DASHED if dashed else 'text'} AS text FROM documents)"
        ORACLE[name] = f"SELECT doc_id, {sql} AS value FROM {source}"


_JOIN = r"regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')"
_scalar(
    "detect_language", lambda: text.detect_language("text"),
    "CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) > 0 AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' "
    "WHEN len(regexp_extract_all(text, '[一-鿿]')) >= greatest(2 * len(regexp_extract_all(text, '[A-Za-z]')), 1) THEN 'zh' ELSE 'en' END",
)
_scalar("normalize_text", lambda: text.normalize_text("text"), r"trim(regexp_replace(regexp_replace(text, '-\n([\p{L}\p{N}_])', '\1', 'g'), '[\s\p{Z}\x0B\x85]+', ' ', 'g'))", True)
_scalar(
    "basic_clean", lambda: text.basic_clean("text"),
    rf"array_to_string(list_filter(list_transform(string_split(replace(replace({_JOIN}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))",
    True,
)
_scalar("markdown_whitespace", lambda: text.markdown_whitespace("text"), r"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')")
_scalar("fix_hyphenation", lambda: text.fix_hyphenation("text"), r"regexp_replace(text, '([A-Za-z]{2,})-\n([A-Za-z]{2,})', '\1\2', 'g')", True)
_scalar(
    "normalize_bullets", lambda: text.normalize_bullets(F.expr("replace(replace(text, '| ', concat(chr(10), '• ')), 'Th', concat(chr(10), '(12) Th'))")),
    r"array_to_string(list_transform(string_split(replace(replace(text, '| ', chr(10) || '• '), 'Th', chr(10) || '(12) Th'), chr(10)), lambda x: "
    r"CASE WHEN regexp_matches(trim(x, ' '), '^[•·‣◦]') THEN '- ' || regexp_replace(trim(x, ' '), '^[•·‣◦]\s*', '') "
    r"WHEN regexp_matches(trim(x, ' '), '^\(?[0-9]+\)|^[0-9]+\.\s+') THEN regexp_replace(trim(x, ' '), '^\(?([0-9]+)\)\s*', '\1. ') ELSE x END), chr(10))",
)
_scalar("count_tokens", lambda: text.count_tokens("text"), r"CAST(len(regexp_extract_all(text, '[一-鿿]|[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')) AS INT)")
_scalar("tokenize", lambda: F.array_join(text.tokenize("text"), " "), "array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]'), lambda x: lower(x)), ' ')")
_scalar("stable_id", lambda: text.stable_id("source", "doc_id", "text"), "substr(sha256(concat_ws('||', source, CAST(doc_id AS VARCHAR), text)), 1, 24)")
_scalar("cache_key", lambda: text.cache_key(F.col("doc_id").cast("string"), F.lit("m"), F.lit("v1"), "text"), "sha1(concat_ws('||', CAST(doc_id AS VARCHAR), 'm', 'v1', sha1(text)))")
_scalar("fallback_chunk_id", lambda: text.fallback_chunk_id("chunk", "source", "doc_id", "text"), "concat_ws(':', 'chunk', sha1(source), CAST(doc_id AS VARCHAR), substr(sha1(text), 1, 12))")
_scalar(
    "evidence_snippet", lambda: F.when(F.instr("text", "or") > 0, text.evidence_snippet("text", F.instr("text", "or") - 1, F.instr("text", "or") + 1)),
    "CASE WHEN strpos(text, 'or') > 0 THEN trim(replace(substr(text, CAST(greatest(0, strpos(text, 'or') - 61) AS BIGINT) + 1, CAST(least(length(text), strpos(text, 'or') + 61) - greatest(0, strpos(text, 'or') - 61) AS BIGINT)), chr(10), ' '), ' ') END",
)
_scalar(
    "format_citation", lambda: text.format_citation(F.substring("text", 1, 80), F.col("source"), F.when(F.col("doc_id") % 3 == 0, "p. iv"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 40), F.col("doc_id").cast("string")),
    "CASE WHEN trim(substr(text, 1, 80), ' ') = '' THEN '' WHEN length(trim(substr(text, 1, 80), ' ')) > 60 THEN rtrim(substr(trim(substr(text, 1, 80), ' '), 1, 57), ' ') || '...' || ' — ' ELSE trim(substr(text, 1, 80), ' ') || ' — ' END "
    "|| source || CASE WHEN doc_id % 3 = 0 THEN ' (p. iv)' WHEN doc_id % 2 = 0 THEN ' (page ' || CAST(doc_id % 40 + 1 AS VARCHAR) || ')' ELSE '' END || ' #' || CAST(doc_id AS VARCHAR)",
)
_scalar("merge_wrapped_lines", lambda: helpers.merge_wrapped_lines("text"), None)
_scalar("split_sentences", lambda: helpers.split_sentences("text"), None)
_scalar("lexical_embedding", lambda: helpers.lexical_embedding("text"), None)
_scalar("sanitize_unicode", lambda: helpers.sanitize_unicode("text"), None)


def sanitize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts there are and how many sanitising changes."""
    rows = _docs(spark, sf_dir).withColumn("clean", helpers.sanitize_unicode("text"))
    return rows.agg(F.count("text").alias("strings_seen"), F.count_if(F.col("text") != F.col("clean")).alias("strings_changed"))


QUERIES["sanitize_counts"] = sanitize_counts


def convert_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversion of every line item's numbers."""
    q = F.col("l_quantity")
    species = F.when(F.col("l_partkey") % 2 == 0, "NH3").when(F.col("l_partkey") % 3 == 0, "NOx").otherwise("SO2")
    kinds = ("c_to_k", "k_to_c", "bar_to_mpa", "atm_to_mpa", "mol_percent_to_ppmv", "ppmv_to_mol_percent")
    plain = [F.round(text.convert_units(q, k), 6).alias(k) for k in kinds]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *plain, F.round(text.convert_units(q, "mg_nm3_to_ppmv", species), 6).alias("mg_nm3_to_ppmv"))


QUERIES["convert_units"] = convert_units
ORACLE["convert_units"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + 273.15, 6) AS c_to_k, round(l_quantity - 273.15, 6) AS k_to_c,
  round(l_quantity * CAST(0.1 AS DOUBLE), 6) AS bar_to_mpa, round(l_quantity * CAST(0.101325 AS DOUBLE), 6) AS atm_to_mpa,
  round(l_quantity * 10000, 6) AS mol_percent_to_ppmv, round(l_quantity / 10000, 6) AS ppmv_to_mol_percent,
  round(l_quantity * (CAST(22.414 AS DOUBLE) / CASE WHEN l_partkey % 2 = 0 THEN CAST(17.031 AS DOUBLE) WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(64.066 AS DOUBLE) END), 6) AS mg_nm3_to_ppmv
FROM lineitem"""
