"""Pages: repeated headers and footers, layout to Markdown, reference lists, sections, heading paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.helpers import merge_wrapped_lines
from quarry.functions.text import fix_hyphenation, markdown_whitespace, normalize_bullets


def _norm_lines(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.filter(lines, lambda x: x != "")


def _edges(lines: Column, head_n: int, tail_n: int) -> Column:
    n = F.size(lines)
    head = F.slice(lines, F.lit(1), F.lit(head_n))
    tail = F.slice(lines, F.greatest(F.lit(1), n - tail_n + 1), F.lit(tail_n)) if tail_n > 0 else F.slice(lines, 1, 0)
    return F.concat(head, tail)


def find_common_header_footer(pages: DataFrame, doc: str = "source", text_col: str = "text", head_n: int = 3, tail_n: int = 3, min_ratio: float = 0.6, min_len: int = 6, max_len: int = 120) -> DataFrame:
    """(doc, line, n): lines among the first and last of a document's pages, on at least two and ``min_ratio`` of them. Only
    these lines of a page are shuffled, summed beforehand."""
    total = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    lines = pages.select(doc, F.explode(_edges(_norm_lines(text_col), head_n, tail_n)).alias("line"))
    counts = lines.where(F.length("line").between(min_len, max_len)).groupBy(doc, "line").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= 2).join(total, doc).where(F.col("n") / F.col("pages") >= min_ratio).select(doc, "line", "n")


def remove_header_footer(pages: DataFrame, common: DataFrame, doc: str = "source", text_col: str = "text", head_n: int = 3, tail_n: int = 3) -> DataFrame:
    """``pages`` without common lines in head and tail positions; pages left empty go. A document's common lines number at
    most (head_n + tail_n) / ratio, so they join as one array."""
    sets = common.groupBy(F.col(doc).alias("_doc")).agg(F.collect_set("line").alias("_common"))
    joined = pages.join(sets, pages[doc] == sets["_doc"], "left").withColumn("_lines", _norm_lines(text_col))
    n = F.size("_lines")
    kept = F.filter("_lines", lambda x, i: ~(((i < head_n) | (i >= n - tail_n)) & F.array_contains("_common", x)))
    text = F.when(F.col("_common").isNull() | (n == 0), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).drop("_doc", "_common", "_lines").where(F.trim(text_col) != "")


def collapse_repeated_headers(pages: DataFrame, doc: str = "source", text_col: str = "text", min_repeat: int = 2) -> DataFrame:
    """``pages`` without first lines, and last lines, that at least ``min_repeat`` pages of the document share."""
    lines = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    rows = pages.withColumn("_lines", lines).withColumns({"_first": F.trim(F.get("_lines", F.lit(0))), "_last": F.trim(F.when(F.size("_lines") > 0, F.element_at("_lines", F.size("_lines"))))})

    def noisy(which: str) -> DataFrame:
        many = rows.where(F.col(which) != "").groupBy(doc, which).agg(F.count("*").alias("n")).where(F.col("n") >= min_repeat)
        return many.select(F.col(doc).alias(f"d{which}"), F.col(which).alias(f"v{which}"))

    heads, feet = noisy("_first"), noisy("_last")
    out = rows.join(heads, (rows[doc] == heads["d_first"]) & (rows["_first"] == heads["v_first"]), "left")
    out = out.join(feet.select("d_last", "v_last"), (out[doc] == feet["d_last"]) & (F.col("_last") == feet["v_last"]), "left")
    head = F.when(F.col("v_first").isNotNull(), 1).otherwise(0)
    # A page of one line that is a header has no last line left.
    foot = F.when(F.col("v_last").isNotNull() & (F.size("_lines") - head > 0), 1).otherwise(0)
    kept = F.slice("_lines", head + 1, F.size("_lines") - head - foot)
    return out.withColumn(text_col, F.regexp_replace(F.array_join(kept, "\n"), r"(?U)^\s+|\s+$", "")).drop("_lines", "_first", "_last", "d_first", "v_first", "d_last", "v_last")


def layout_to_markdown(spans: DataFrame, max_depth: int = 4, min_ratio: float = 1.15, two_columns: float = 180.0) -> DataFrame:
    """(doc, page, text): Markdown of text lines (doc, page, x, y, size, text), headings by font size against the document's
    median, two columns left before right where a page of over three lines is wide enough, then the text cleaning."""
    lines = spans.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    body = lines.where("size > 0").groupBy("doc").agg(F.percentile("size", F.lit(0.5)).alias("body"))
    wide = lines.groupBy("doc", "page").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = lines.join(body, "doc", "left").withColumn("body", F.coalesce("body", F.lit(10.0))).join(wide, ["doc", "page"])
    right = (F.col("n") > 3) & (F.col("hi") - F.col("lo") > two_columns) & (F.col("x") > (F.col("lo") + F.col("hi")) / 2)
    ratio = F.col("size") / F.greatest("body", F.lit(1.0))
    level = F.when(F.col("size") >= F.col("body") * min_ratio, F.when(ratio >= 1.55, 1).when(ratio >= 1.35, 2).when(ratio >= 1.2, 3).otherwise(4))
    t = F.col("text")
    bullet = F.concat(F.lit("- "), F.regexp_replace(t, r"^[•·\-* ]+", ""))
    number = F.concat(F.substring(t, 1, 2), F.lit(". "), F.trim(F.expr("substring(text, 4)")))
    said = (
        F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(max_depth))), F.lit(" "), t))
        .when(F.regexp_like(t, F.lit(r"^(•|·|- |\* )")), bullet)
        .when(F.regexp_like(t, F.lit(r"^[0-9]{2}[.)]")), number)
        .otherwise(t)
    )
    ordered = placed.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(right.cast("int").alias("c"), "y", "x", said.alias("md")))).alias("ls"))
    pages = ordered.select("doc", "page", F.array_join(F.transform("ls", lambda z: z["md"]), "\n").alias("text"))
    pages = pages.withColumn("text", merge_wrapped_lines(fix_hyphenation("text")))
    pages = pages.withColumn("text", markdown_whitespace(normalize_bullets("text")))
    return collapse_repeated_headers(pages, "doc").where("text <> ''")


#: Fixed values.
DOI = r"(?i)\bdoi\b|\b10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+"
YEAR = r"\b(19|20)[0-9]{2}\b"
JOURNAL = r"(?i)\b(J\.|Vol\.|pp\.|Fuel|Energy\s*&\s*Fuels|Combustion|Proceedings)\b"
CITED = r"^[0-9]+\.\s+|^[A-Z][a-z]+\s+[A-Z]\."
SECTIONS = [
    ("abstract", r"\babstract\b|摘要"),
    ("introduction", r"\bintroduction\b|引言|绪论"),
    ("methods", r"\bexperimental\b|\bmaterials?\b|\bmethods?\b|实验|方法"),
    ("conditions", r"\bconditions?\b|\boperating\b|工况|操作条件|实验条件"),
    ("results", r"\bresults?\b|结果"),
    ("discussion", r"\bdiscussion\b|讨论"),
    ("conclusion", r"\bconclusions?\b|结论"),
    ("references", r"\breferences?\b|参考文献|文献"),
    ("acknowledgements", r"\backnowledg(e)?ments?\b|致谢"),
    ("appendix", r"\bappendix\b|附录"),
    ("contents", r"\btable\s+of\s+contents\b|目录"),
    ("table", r"\btable\b|表\s*[0-9]+"),
    ("figure", r"\bfigure\b|图\s*[0-9]+"),
]


def reference_features(text: str | Column) -> dict[str, Column]:
    """Counts in the first 1200 characters that mark a reference list."""
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, 1200)
    lines = F.filter(F.transform(F.split(head, "\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "doi_count": F.regexp_count(head, F.lit(DOI)),
        "year_count": F.regexp_count(head, F.lit(YEAR)),
        "journal_hits": F.regexp_count(head, F.lit(JOURNAL)),
        "citation_line_count": F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(CITED)))),
        "line_count": F.size(lines),
    }


def is_reference_like(text: str | Column) -> Column:
    """Whether the start of a text looks like a list of references; false for null."""
    f = reference_features(text)
    cited, doi, year, journal = f["citation_line_count"], f["doi_count"], f["year_count"], f["journal_hits"]
    return F.coalesce((cited >= 4) | ((doi >= 1) & (year >= 3)) | ((journal >= 3) & (year >= 4)) | ((year >= 8) & (cited >= 2)), F.lit(False))


def infer_section(text: str | Column) -> Column:
    """``references`` for reference lists, else the first section whose words occur in the first 1200 characters, else null."""
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, 1200)
    by_word = [F.when(F.regexp_like(head, F.lit(f"(?i){p}")), F.lit(name)) for name, p in SECTIONS]
    return F.when(is_reference_like(text), "references").otherwise(F.coalesce(*by_word))


_ANY_CHAR = r"[^\n\r\u0085\u2028\u2029]"
_HEADING = re.compile(rf"(#{{1,6}})\s+({_ANY_CHAR}*\S)\s*", re.ASCII)


def sections(text: str, max_depth: int) -> list[tuple[int, int, str, str]]:
    """(number, level, path, lines) of the text before, between and after the headings of one document."""
    found, titles, level, lines = [], [""] * (max_depth + 1), 0, []
    number = 0

    def close() -> None:
        if lines:
            path = " > ".join(t for t in titles[1:] if t)
            found.append((number, level, path or "(root)", "\n".join(lines)))

    for line in re.split("\r\n|[\n\r]", text):
        heading = _HEADING.fullmatch(line) if line.startswith("#") else None
        if heading is None or len(heading[1]) > max_depth:
            lines.append(line)
            continue
        close()
        level, number, lines = len(heading[1]), number + 1, []
        titles[level:] = [heading[2].strip(" "), *[""] * (max_depth - level)]
    close()
    return found


_SECTION = T.StructType([T.StructField("section_ord", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("content", T.StringType())])


def parse_markdown_sections(docs: DataFrame, doc: str = "doc_id", text_col: str = "text", max_depth: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, *keep, section_ord, level, heading_path, content): text between headings of up to ``max_depth`` marks. The path
    joins the current heading of each level; a heading clears the deeper ones; empty sections go.

    A row is a whole document, and its headings are followed within the row: nothing is shuffled."""

    @F.pandas_udf(T.ArrayType(_SECTION))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sections(t or "", max_depth), na_action=None)

    rows = docs.select(doc, *keep, F.explode(cut.asNondeterministic()(F.col(text_col).cast("string"))).alias("s")).select(doc, *keep, "s.*")
    return rows.withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).where("content <> ''")
