"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

toxicity -> line deduplication -> near-duplicates -> benchmark decontamination -> mixing. All stages but the last return the
columns of ``documents``; the last adds the place of each document in the mix.

In every stage a null in any column, an empty or very long text, a repeated row, an empty table and columns of any other name
have a defined result: null and empty texts have no words, lines or hits, and are copies of each other; texts are read whole;
an empty table gives an empty one; other columns pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from quarry.llm.queries import SOURCE_WEIGHTS, table
from quarry.llm.tokens import packed, unpacked
from quarry.scratch import materialize

TOXIC = 0.5
#: A line goes from a source when over this share of its documents, and at least so many, have it. A document that would lose
#: over the last share of its text is looked at again: if another such document shares that much of the text with it, its lines
#: are common because it was copied, and the next stage needs them.
LINE_RATIO, LINE_PAGES, LINE_COPIED = 0.01, 10, 0.8
_SEEDS = 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``, unchanged. Texts without words get the share of toxic labels among such
    texts; repeated rows are judged alike; a column ``toxicity`` stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(packed(docs), F.col("text").alias("text"))
    return unpacked(toxicity.with_toxicity(rows, model).where(F.col("toxicity.score") < TOXIC), docs.columns, {})


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that too many documents of its source have; ``n_chars`` follows the text. A document that
    would lose more than ``LINE_COPIED`` of its text stays whole if lines that make up this share of the longer text are shared
    with another such document; the next stage settles such copies. Whatever else is mostly common lines loses them. A null source
    is no site: its documents, null texts and lines without a word stay as they are."""
    rows = docs.select(packed(docs), "source", F.col("text").alias("text"))
    lines = line_dedup.text_lines("text")
    size = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y))
    cut = line_dedup.drop_boilerplate(rows.select("source", "text"), "source", lines, LINE_RATIO, LINE_PAGES)
    mostly = (F.col("n_dropped") > 0) & (size("kept_lines") < (1 - LINE_COPIED) * size(lines))
    gone = F.transform(F.array_except(lines, F.col("kept_lines")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))
    doubtful = cut.select(near_copies.digest("text").alias("key"), F.when(mostly, gone).alias("gone"), size(lines).alias("size"))
    copied = _copied(materialize(doubtful, "doubtful").where("gone IS NOT NULL")).withColumn("copied", F.lit(True))
    keyed = rows.withColumn("key", near_copies.digest("text")).join(copied, "key", "left").select("_row", "source", "text", "copied")
    out = line_dedup.drop_boilerplate(keyed, "source", lines, LINE_RATIO, LINE_PAGES)
    text = F.when((F.col("n_dropped") > 0) & F.col("copied").isNull(), F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    return _with_text(unpacked(out, docs.columns, {"text": text}), F.col("text"), docs.columns)


def _copied(rows: DataFrame) -> DataFrame:
    """The keys of ``rows`` (key, gone: hashes and lengths of lines, size of the text) that share lines of ``LINE_COPIED`` of the
    longer text with a row of another key, or their key with another row. Rows whose lines have one of ``_SEEDS`` smallest hashes
    in common are held against one of them."""
    nodes = materialize(rows.groupBy("key").agg(F.any_value("gone").alias("gone"), F.any_value("size").alias("size"), F.count("*").alias("rows")), "doubtful")
    least = F.array(*[F.array_min(F.transform("gone", lambda x, seed=seed: F.xxhash64(x["h"], F.lit(seed)))) for seed in range(_SEEDS)])
    at = nodes.select("key", "gone", "size", F.posexplode(least).alias("seed", "least"))
    lead = at.groupBy("seed", "least").agg(F.count("*").alias("n"), F.max_by(F.struct("key", "gone", "size"), F.struct(F.size("gone"), "key")).alias("lead")).where("n > 1")
    met = at.join(lead.drop("n"), ["seed", "least"]).where(F.col("key") != F.col("lead.key"))
    shared = F.aggregate(F.array_intersect("gone", "lead.gone"), F.lit(0), lambda s, x: s + x["n"])
    linked = met.where(shared >= F.lit(LINE_COPIED) * F.greatest("size", "lead.size"))
    linked = linked.select(F.explode(F.array("key", "lead.key")).alias("key"))
    return materialize(linked.unionByName(nodes.where("rows > 1").select("key")).distinct(), "copied")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: candidates by SimHash fingerprints through deletion variants
    and, further apart, by MinHash, each checked for a Jaccard similarity of 0.8 of five-word shingles. Different texts under one id are all kept, rows that repeat id and text once; rows without an id stay."""
    return near_copies.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with benchmark items; those that are mostly such passages go. Documents without
    a hit stay byte for byte; ``n_chars`` follows the text; repeated rows are treated alike."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(out, F.col("text"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its phase, block, slot and position in the mix. A null source is a source of its own; rows that repeat
    id and text get places of their own."""
    return mixing.mix(docs, SOURCE_WEIGHTS)


def _with_text(df: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    out = df.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: Near copies and nearest neighbours cannot be stated in SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared scratch folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
