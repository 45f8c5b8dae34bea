"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import collocations, decontaminate, language_model, licenses, line_dedup, mixing, nbsvm, pii, quality_rules, runs, simhash, toxicity, urls
from quarry.llm.labelled import held_out
from quarry.llm.oracle import ORACLE
from quarry.scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and robust outliers of all documents."""
    counted = quality_rules.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    found = quality_rules.outliers(materialize(counted.drop("text"), "statistics"))
    stats = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *stats, "base_failed", "kept", F.round("distance", 3).alias("distance"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of all pages without the boilerplate of their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    site = F.nullif(urls.url_host("url"), F.lit(""))
    out = line_dedup.drop_boilerplate(pages, site, line_dedup.visible_lines("html"))
    return out.select("page_id", urls.url_host("url").alias("host"), "n_lines", "n_dropped", F.array_join("kept_lines", "\n").alias("text"))


#: (rule, verdict); fixed values.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "text string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


#: Target weights; every other source has weight 1.
SOURCE_WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every document in the mix of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS, text_col=None)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.neighbours").alias("evidence"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return nbsvm.with_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.with_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words("contamination.spans")
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.with_licenses(docs, licenses.build(docs))
    plain = [F.col(f"license.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word")]
    joined = [F.array_join(f"license.{c}", ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", *plain, *joined, F.col("license.score").alias("score"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.digest(list(pii.BASE)), 256).alias("base_sha256"), pii.digest(pii.KINDS).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language in all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return language_model.with_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), hash_col=hashed)
    best, n = runs.longest(), F.size("periodic.runs").cast("long")
    return found.select(
        "doc_id",
        n.alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(runs.digest(), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.text"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of (spark, folder of tables)."""
    return {
        "op1_simhash": op1_simhash,
        "op2_quality_rules": op2_quality_rules,
        "op3_line_dedup": op3_line_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_decontamination": op8_decontamination,
        "op9_license_scan": op9_license_scan,
        "op10_pii": op10_pii,
        "op11_collocations": op11_collocations,
        "op12_language_model": op12_language_model,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """The queries whose results DuckDB can state."""
    return dict(ORACLE)
