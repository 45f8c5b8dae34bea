"""Files into page tables. Pages have source_file, page, section, title, doc_type, language, parser and text where known."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.helpers import html_to_text, paragraphs, sanitize_unicode
from quarry.functions.text import detect_language, normalize_text
from quarry.operators.evaluate import GOLD
from quarry.scratch import materialize


def _suffix(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _listed(spark: SparkSession, roots: list[str], include: list[str], exclude: list[str]) -> DataFrame:
    """(path, mtime_ns, size, content); content is read only where it is used."""
    want, leave = [e.lower().lstrip(".") for e in include], [e.lower().lstrip(".") for e in exclude]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    files = files.where(_suffix().isin(*want) & ~_suffix().isin(*leave))
    return files.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")


def scan_files(spark: SparkSession, roots: list[str], include: list[str], exclude: list[str] = (), manifest: DataFrame | None = None, most_paths: int = 10_000) -> DataFrame:
    """(path, mtime_ns, size, sha256) of the files below ``roots`` with a wanted extension.

    With a ``manifest`` (path, mtime_ns, size, sha256) files whose time and size it has are not opened: the listing alone is
    compared with it, and only the others are read and hashed, by their paths where these are at most ``most_paths``, else by
    reading the roots."""
    listing = _listed(spark, roots, include, exclude)
    hashed = lambda df: df.select("path", "mtime_ns", "size", F.sha2("content", 256).alias("sha256"))
    if manifest is None:
        return hashed(listing)
    key = ["path", "mtime_ns", "size"]
    known = listing.select(*key).join(manifest.where("sha256 IS NOT NULL").select(*key, "sha256").dropDuplicates(key), key, "left")
    known = materialize(known, "listing")
    paths = [r["path"] for r in known.where("sha256 IS NULL").select("path").limit(most_paths + 1).collect()]
    kept = known.where("sha256 IS NOT NULL")
    if not paths:
        return kept
    if len(paths) > most_paths:
        return kept.unionByName(hashed(listing.join(known.where("sha256 IS NULL").select("path"), "path", "left_semi")))
    return kept.unionByName(hashed(_listed(spark, [escaped(x) for x in paths], include, exclude)))


def escaped(path: str) -> str:
    """A path that names itself where patterns are expected."""
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", path)


def load_text(files: DataFrame) -> DataFrame:
    """One page for each paragraph of (path, text): line_range, the last ``#`` title seen so far. Paragraphs are cut within the
    row of their file, so nothing is shuffled."""
    found = files.select("path", F.explode(paragraphs("text")).alias("p"))
    text = normalize_text("p.text")
    out = found.withColumns({"title": F.trim(F.regexp_replace("p.title", "^#+", "")), "text": text})
    return out.select(F.col("path").alias("source_file"), F.array("p.first", "p.last").alias("line_range"), F.lit("body").alias("section"), "title", _suffix().alias("doc_type"), detect_language("text").alias("language"), F.lit("text").alias("parser"), "text")


def load_csv_rows(rows: DataFrame, block: int = 50) -> DataFrame:
    """One page for each ``block`` rows of an ordered row table (path, n from 1, cells)."""
    keyed = rows.withColumns({"b": F.floor((F.col("n") - 1) / block), "line": F.array_join("cells", ", ", "")})
    packed = keyed.groupBy("path", "b").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls"))
    text = normalize_text(F.array_join(F.transform("ls", lambda z: z["line"]), "\n"))
    out = packed.withColumn("text", text)
    return out.select(F.col("path").alias("source_file"), F.array("first", "last").alias("row_range"), F.lit("rows").alias("section"), F.lit("csv").alias("doc_type"), detect_language("text").alias("language"), F.lit("csv").alias("parser"), "text")


def load_json_records(files: DataFrame) -> DataFrame:
    """One page for each record of (path, text): lines of .jsonl, elements of an array, or a single object. Records that are
    no JSON give no page."""
    text = F.trim("text")
    jsonl = _suffix() == "jsonl"
    parts = F.when(jsonl, F.split("text", "\r\n|[\n\r]")).when(F.startswith(text, F.lit("[")), F.from_json(text, "ARRAY<STRING>")).otherwise(F.array(text))
    rows = files.select("path", jsonl.alias("jsonl"), F.posexplode(parts).alias("record_id", "raw")).where(F.trim("raw") != "").where(F.try_parse_json("raw").isNotNull())
    rows = rows.withColumn("text", normalize_text("raw"))
    return rows.select(F.col("path").alias("source_file"), "record_id", F.lit("record").alias("section"), F.when(F.col("jsonl"), "jsonl").otherwise("json").alias("doc_type"), detect_language("text").alias("language"), F.lit("json").alias("parser"), "text")


def load_html(pages: DataFrame, path: str = "url", html: str = "html") -> DataFrame:
    """Visible text and title of HTML pages; other columns are kept."""
    out = pages.withColumn("_h", html_to_text.asNondeterministic()(html)).withColumns({"text": F.col("_h.text"), "title": F.col("_h.title")})
    return out.withColumns({"source_file": F.col(path), "section": F.lit("body"), "doc_type": F.lit("html"), "language": detect_language("text"), "parser": F.lit("html")}).drop("_h", html)


_CACHED = "text STRING, page_content STRING, content STRING, metadata MAP<STRING, STRING>"


def read_page_cache(lines: DataFrame, col: str = "value", blanks: bool = False) -> DataFrame:
    """(text, metadata) of cached JSON lines: the first non-empty of text, page_content and content; blank, corrupt and, without
    ``blanks``, empty lines are skipped; metadata that is no object is empty. With ``blanks`` every line that is JSON gives a
    row, its text as it stands: empty where one of the keys is, null where none is there."""
    rows = lines.where(F.trim(col) != "").where(F.try_parse_json(col).isNotNull()).withColumn("_r", F.from_json(col, _CACHED))
    plain = lambda key: F.nullif(F.get_json_object(col, f"$.{key}"), F.lit(""))
    keys = ("text", "page_content", "content")
    text = F.coalesce(*[plain(k) for k in keys], *([F.get_json_object(col, f"$.{k}") for k in keys] if blanks else []))
    empty = F.create_map().cast("map<string,string>")
    out = rows.select(text.alias("text"), F.coalesce("_r.metadata", empty).alias("metadata"))
    return out if blanks else out.where(F.trim("text") != "")


def page_cache_lines(pages: DataFrame, text_col: str = "text", sanitise: bool = True) -> DataFrame:
    """Cache lines of pages: sanitised text under both keys, the rest as metadata; blank pages go. Without ``sanitise`` every page
    has a line, with its text as it stands."""
    clean = pages.withColumn(text_col, sanitize_unicode(text_col)).where(F.trim(text_col) != "") if sanitise else pages
    rest = [c for c in pages.columns if c != text_col]
    return clean.select(F.to_json(F.struct(F.col(text_col).alias("text"), F.col(text_col).alias("page_content"), F.struct(*rest).alias("metadata"))).alias("value"))


def write_page_cache(pages: DataFrame, path: str, sanitise: bool = True) -> None:
    """The lines as text files."""
    page_cache_lines(pages, sanitise=sanitise).write.mode("overwrite").text(path)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from JSON lines; a missing list of sources is empty."""
    empty = F.array().cast("array<struct<source_file:string,page:int,chunk_id:string>>")
    return spark.read.schema(GOLD).json(path).where("query IS NOT NULL").withColumn("expected_sources", F.coalesce("expected_sources", empty))


def union_pages(*pages: DataFrame) -> DataFrame:
    """All pages in one table; columns a loader lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)
