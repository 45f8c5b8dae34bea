"""URL filters: a broadcast trie over reversed host labels and path segments, longest matching rule first."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tokens import packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: str | Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null and other texts."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null and other texts."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


class Trie:
    """Rules ``host + path`` with a verdict. A rule fits its host and its subdomains where the path starts with the rule's."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        """rules: (rule text such as ``example.org/en/1``, verdict). Of equal texts a block entry wins."""
        self.root: dict = {}
        for text, verdict in rules:
            host, slash, path = text.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            ends, key = node, ""
            if slash:
                *whole, key = path.split("/")
                ends = node.setdefault("path", {})
                for segment in whole:
                    ends = ends.setdefault("segments", {}).setdefault(segment, {})
            held = ends.setdefault("ends", {})
            if key not in held or verdict == "block":
                held[key] = (text, verdict)
                ends["sizes"] = sorted({*ends.get("sizes", ()), len(key)})

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule text, verdict) of the longest rule that fits, of equally long ones a block, then the last text; (None, None)
        without one."""
        best: tuple[str | None, str | None] = (None, None)
        order = lambda r: (len(r[0]), r[1] == "block", r[0])
        node = self.root
        segments = path[1:].split("/") if path.startswith("/") else None
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            for rule in self._fits(node, segments):
                if best[0] is None or order(rule) > order(best):
                    best = rule
        return best

    @staticmethod
    def _fits(node: dict, segments: list[str] | None):
        if "" in (ends := node.get("ends", {})):
            yield ends[""]
        if segments is None or "path" not in node:
            return
        at = node["path"]
        for k, segment in enumerate(segments):
            for size in at.get("sizes", ()):  # the starts of the segment that are as long as some rule's
                if size <= len(segment) and (rule := at["ends"].get(segment[:size])):
                    yield rule
            at = at.get("segments", {}).get(segment) if k < len(segments) - 1 else None
            if at is None:
                return


def _by_join(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """The same verdicts for rule tables beyond the broadcast bound: one equality join on the hosts above each host."""
    split = rules.select("text", "verdict", F.substring_index("text", "/", 1).alias("on"), F.expr("substr(text, length(substring_index(text, '/', 1)) + 1)").alias("start"))
    above = F.expr("transform(sequence(1, size(split(_host, '[.]'))), k -> substring_index(_host, '.', -k))")
    best = F.max(F.struct(F.length("text").alias("n"), (F.col("verdict") == "block").alias("b"), "text", "verdict")).alias("best")
    hits = (
        keyed.select("_host", "_path").distinct().withColumn("on", F.explode(above)).join(split, "on")
        .where(F.expr("startswith(_path, start)")).groupBy("_host", "_path").agg(best)
    )
    return keyed.join(hits, ["_host", "_path"], "left").withColumn("_rule", F.struct(F.col("best.text").alias("rule"), F.col("best.verdict").alias("verdict"))).drop("best")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """``pages`` plus host, path, rule and verdict.

    ``rules`` has text (``host/path``) and verdict (allow or block); null ones are no rules. Up to ``max_rules`` rules make
    a trie that is broadcast; more are joined by host. The longest rule text that fits decides, of equal ones a block, then the
    last text in order; without one rule is null and the verdict is ``default``. Null urls and texts without ``://`` have an empty host and path
    and fit no rule; urls of any length are read whole; repeated rows are judged alike. Columns named like the new ones are
    replaced, others may have any name; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    stated = rules.where("text IS NOT NULL AND verdict IS NOT NULL").select("text", "verdict")
    keyed = pages.select(packed(pages), url_host(url_col).alias("_host"), url_path(url_col).alias("_path"))
    first = stated.limit(max_rules + 1).collect()
    if len(first) > max_rules:
        out = _by_join(keyed, stated)
    else:
        trie = spark.sparkContext.broadcast(Trie((r.text, r.verdict) for r in first))

        @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
        def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([trie.value.find(h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

        out = keyed.withColumn("_rule", look_up("_host", "_path"))
    new = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", F.lit(default))}
    return unpacked(out, pages.columns, new)
