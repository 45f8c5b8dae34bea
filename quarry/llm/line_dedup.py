"""Line deduplication by site-relative frequency, in DataFrame functions only.

For every host, the pages that contain a line are divided by the pages of the host; lines above a ratio are boilerplate of
that host. Lines are counted by the 128-bit digest of their trimmed text, once a page, summed before the shuffle. The
dropped lines of one host number at most (lines of a page) / ratio, so they travel as one array a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import packed, unpacked
from quarry.scratch import materialize

_BLOCKS = "p|div|br|li|ul|ol|nav|article|footer|header|h[1-6]|title|section|table|tr|td|th|body|head|html|main|aside|blockquote|pre"
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&amp;": "&"}


def visible_lines(html: str | Column) -> Column:
    """Lines of visible text: scripts, styles and comments go, block tags end a line, other tags vanish, blanks collapse."""
    text = F.col(html) if isinstance(html, str) else html
    for gone in (r"(?is)<script.*?</script[^>]*>", r"(?is)<style.*?</style[^>]*>", r"(?s)<!--.*?-->", rf"(?i)</?({_BLOCKS})([ \t\r\n/][^>]*)?>"):
        text = F.regexp_replace(text, gone, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in _ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.split(F.regexp_replace(text, r"[ \t\r\x0B\x0C]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: str | Column) -> Column:
    """Lines of a plain text, as they are."""
    return F.split(F.col(text) if isinstance(text, str) else text, "\n")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.regexp_replace(line, r"^[ \t\r\x0B\x0C]+|[ \t\r\x0B\x0C]+$", "")))


def _worded(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"[^ \t\r\x0B\x0C]"))


def _keys(lines: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(lines, _worded), _key))


def boilerplate(rows: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, gone): for each host with any, the digests of lines in at least ``min_pages`` of its pages and in more than
    ``max_ratio`` of them. ``rows``: host (null: no site) and lines."""
    sited = rows.where(F.col("host").isNotNull()).select("host", "lines")
    pages = sited.groupBy("host").agg(F.count("*").alias("pages"))
    counts = sited.select("host", F.explode(_keys(F.col("lines"))).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") >= min_pages).join(pages, "host").where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return materialize(over.groupBy("host").agg(F.collect_list("key").alias("gone")), "boilerplate")


def drop_boilerplate(
    pages: DataFrame, host: str | Column, lines: Column, max_ratio: float = 0.2, min_pages: int = 3, whole_above: float | None = None
) -> DataFrame:
    """``pages`` plus kept_lines, n_lines (lines with a word) and n_dropped.

    A line of a host goes when at least ``min_pages`` pages and more than ``max_ratio`` of the host's pages have it. Lines
    without a word never go. With ``whole_above``, a page that would lose more than this share of its characters keeps all
    lines: it is a copy of other pages, which is for document-level deduplication to settle. A null host is no site, its
    pages stay whole; a null text has no lines (kept_lines null). Repeated rows count as pages of their own. Pages of any
    length are read whole. An empty table gives an empty result. Columns of the new names are replaced; others may have any name.
    """
    host = F.col(host) if isinstance(host, str) else host
    rows = pages.select(packed(pages), host.alias("host"), lines.alias("lines"))
    out = rows.join(boilerplate(rows, max_ratio, min_pages), "host", "left")
    # the intersection is made through a hash set, so a page meets its host's digests once and not once for every line
    out = out.withColumn("own", F.when(F.col("gone").isNotNull(), F.array_intersect(_keys(F.col("lines")), "gone")))
    out = out.withColumn("gone", F.when(F.size("own") > 0, F.filter("lines", lambda x: _worded(x) & F.array_contains("own", _key(x)))))
    if whole_above is not None:
        size = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x))
        out = out.withColumn("gone", F.when(size("gone") <= whole_above * size("lines"), F.col("gone")))
    some = F.coalesce(F.size("gone") > 0, F.lit(False))
    kept = F.when(some, F.filter("lines", lambda x: ~F.array_contains("gone", x))).otherwise(F.col("lines"))
    n_lines = F.coalesce(F.size(F.filter("lines", _worded)), F.lit(0)).cast("long")
    n_gone = F.when(some, F.size("gone")).otherwise(0).cast("long")
    return unpacked(out, pages.columns, {"kept_lines": kept, "n_lines": n_lines, "n_dropped": n_gone})
