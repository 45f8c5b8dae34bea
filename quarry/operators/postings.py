"""Lexical search over an inverted index with block maxima.

Chunks in the order of what filters read are cut into blocks of up to ``BLOCK``. The index has a row for each term of a block
(places and counts of the term, and the largest count and shortest chunk, which bound its part of any score) and a row for each
block (keys, lengths and filter groups of its chunks). Questions meet term rows by equality on the term; the bounds of a question's
terms in a block add up to what no chunk of the block can exceed. The two blocks of the highest bound give each question a score
that its k-th result has at least; only blocks whose bound reaches it are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.questions import filter_columns, filter_group, passing_groups
from quarry.scratch import materialize

BLOCK = 1 << 12
DIGITS = 6
#: Questions that meet one block in a task.
_TOGETHER = 2_000
#: The tokens of ``functions.text.tokenize`` before they are lower-cased.
_TOKEN = re.compile("[A-Za-z0-9_]+|[\u4e00-\u9fff]")


def _invert(block: int, columns: list[str]):
    def rows(p: pd.DataFrame, number: int) -> pd.DataFrame:
        tokens = [_TOKEN.findall(text) for text in p["text"]]
        lengths = np.fromiter(map(len, tokens), dtype=np.int32, count=len(p))
        codes: dict[str, int] = {}
        terms = np.fromiter((codes.setdefault(t.lower(), len(codes)) for ts in tokens for t in ts), dtype=np.int64, count=int(lengths.sum()))
        both, tf = np.unique(terms * len(p) + np.repeat(np.arange(len(p)), lengths), return_counts=True)
        term, place = both // len(p), (both % len(p)).astype(np.int32)
        ends = np.flatnonzero(np.diff(term, append=-1)) + 1
        names, out = list(codes), []
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            own = place[a:b]
            out.append((number, names[term[a]], own.tobytes(), tf[a:b].astype(np.int32).tobytes(), int(tf[a:b].max()), int(lengths[own].min()), b - a, None, None, None, None))
        out.append((number, None, None, None, None, None, len(p), int(lengths.sum()), p["chunk_id"].tolist(), lengths.tobytes(), p["gid"].tolist()))
        return pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= block:
                every = pd.concat(held, ignore_index=True)
                yield rows(every.iloc[:block], number)
                held, n, number = [every.iloc[block:]], n - block, number + 1
        if n:
            yield rows(pd.concat(held, ignore_index=True), number)

    return run


def invert(chunks: DataFrame, group: Column, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The index: term rows (term not null) and block rows, written once. ``group`` is a text that is equal for chunks which every
    filter treats alike; its order keeps such chunks together."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"block long, term string, places binary, tfs binary, max_tf int, min_dl int, n int, dl long, keys array<{kind}>, lengths binary, groups array<binary>"
    rows = chunks.select("chunk_id", group.alias("group"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("group", "chunk_id").sortWithinPartitions("group", "chunk_id")
    columns = [c.split()[0] for c in schema.split(", ")]
    return materialize(rows.select("chunk_id", F.unhex(F.md5("group")).alias("gid"), "text").mapInPandas(_invert(block, columns), schema), "index")


def _mask(groups: dict, codes: np.ndarray, allowed) -> np.ndarray:
    ok = np.zeros(len(groups), dtype=bool)
    ok[[groups[g] for g in allowed]] = True
    return ok[codes]


def _opened(p: pd.DataFrame) -> tuple[pd.Series, np.ndarray, dict, dict, np.ndarray]:
    """(block row, lengths, postings by term, numbers of groups, group number of each chunk)."""
    head = p[p["keys"].notna()].iloc[0]
    own = p[p["term"].notna()]
    posts = {t: (np.frombuffer(x, dtype=np.int32), np.frombuffer(y, dtype=np.int32)) for t, x, y in zip(own["term"], own["places"], own["tfs"], strict=True)}
    groups: dict = {}
    codes = np.fromiter((groups.setdefault(g, len(groups)) for g in head["groups"]), dtype=np.int64, count=len(head["groups"]))
    return head, np.frombuffer(head["lengths"], dtype=np.int32), posts, groups, codes


def _count(p: pd.DataFrame) -> pd.DataFrame:
    """Of the chunks that a question may see: their number and length, and how many have each of its terms."""
    _, lengths, posts, groups, codes = _opened(p)
    out = []
    for qid, terms, allowed in p.loc[p["allowed"].notna(), ["qid", "terms", "allowed"]].itertuples(index=False):
        mask = _mask(groups, codes, allowed)
        out.append((qid, None, int(mask.sum()), int(lengths[mask].sum())))
        out += [(qid, t, int(mask[posts[t][0]].sum()), 0) for t in terms if t in posts]
    return pd.DataFrame(out, columns=["qid", "term", "n", "dl"])


def _score(k: int, k1: float, b: float, zeros: bool):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        head, lengths, posts, groups, codes = _opened(p)
        keys, out = np.array(head["keys"]), []
        order = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
        for r in p[p["terms"].notna()].itertuples(index=False):
            full = np.zeros(len(keys))
            for t, w in zip(r.terms, r.ws, strict=True):
                if t in posts:
                    place, tf = posts[t]
                    full[place] += w * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[place] / r.avgdl)))
            full = np.round(full, DIGITS)
            good = np.ones(len(keys), dtype=bool) if r.allowed is None else _mask(groups, codes, r.allowed)
            rows = np.flatnonzero(good & (full >= r.least) & (zeros | (full > 0)))
            if len(rows) > k:
                cut = np.partition(full[rows], len(rows) - k)[len(rows) - k]
                rows = rows[full[rows] >= cut]
                rows = rows[np.lexsort((order[rows], -full[rows]))[:k]]
            out += [(r.qid, keys[i], full[i]) for i in rows.tolist()]
        return pd.DataFrame(out, columns=["qid", "chunk_id", "score"])

    return run


def _by_block(index: DataFrame, asks: DataFrame, slices: int) -> DataFrame:
    """Index rows of the blocks that ``asks`` name, with these, ready to be grouped by block and slice of the questions."""
    used = index.join(asks.select("block").distinct(), "block", "left_semi")
    used = used.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))) if slices > 1 else F.lit(0))
    mine = asks.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
    return used.unionByName(mine, allowMissingColumns=True)


def search(queries: DataFrame, chunks: DataFrame, terms: DataFrame, k: int, text_col: str = "text", k1: float = 1.5, b: float = 0.75, zeros: bool = False, block: int = BLOCK) -> DataFrame:
    """(qid, chunk_id, score): rows of which the k best of every question are the k best of all chunks that pass its filters, by BM25
    with the statistics of these chunks; ``terms``: (qid, term, qtf). With ``zeros`` chunks without a term fill the places that are left."""
    filters, read = filter_columns(queries, chunks)
    questions = materialize(queries.select("qid", *filters), "questions")
    filtered = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(True)) for f in filters], F.lit(False))
    qids = questions.select("qid", filtered.alias("filtered"))
    index = invert(chunks, filter_group(chunks, read), text_col, block)
    blocks = index.where("term IS NULL")
    used = materialize(index.where("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi"), "used")
    rows = blocks.unionByName(used)
    slices = 1 + questions.count() // _TOGETHER
    qkind, ckind = queries.schema["qid"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()

    passing = passing_groups(chunks, questions.where(filtered)).select("qid", F.unhex(F.md5("group")).alias("gid"))
    spots = blocks.select("block", F.explode(F.array_distinct("groups")).alias("gid"))
    allowed = materialize(spots.join(passing, "gid").groupBy("qid", "block").agg(F.collect_list("gid").alias("allowed")), "allowed")
    own = terms.groupBy("qid").agg(F.collect_list("term").alias("terms"))
    asks = allowed.join(own, "qid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    counted = _by_block(rows, asks, slices).groupBy("block", "slice").applyInPandas(lambda p: _count(p), f"qid {qkind}, term string, n long, dl long")
    counted = materialize(counted.groupBy("qid", "term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")), "counted")

    total = blocks.agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
    stats = counted.where("term IS NULL").select("qid", "n", (F.col("dl") / F.col("n")).alias("avgdl"))
    every = qids.where("NOT filtered").select("qid", F.lit(total["n"] or 0).cast("long").alias("n"), F.lit((total["dl"] or 0) / (total["n"] or 1)).alias("avgdl"))
    found = counted.where("term IS NOT NULL").select("qid", "term", F.col("n").alias("df"))
    found = found.unionByName(qids.where("NOT filtered").join(terms, "qid").join(used.groupBy("term").agg(F.sum("n").alias("df")), "term").select("qid", "term", "df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = stats.where("n > 0").unionByName(every).join(found.where("df > 0"), "qid").join(terms, ["qid", "term"])
    weights = materialize(weights.select("qid", "term", "avgdl", (F.col("qtf") * idf).alias("w")), "weights")

    most = F.col("w") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_dl") / F.col("avgdl")))
    bounds = used.join(weights, "term").groupBy("qid", "block").agg(F.sum(most).alias("bound"))
    bounds = bounds.join(qids, "qid").join(allowed, ["qid", "block"], "left").where("NOT filtered OR allowed IS NOT NULL")
    weighed = weights.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"), F.max("avgdl").alias("avgdl"))
    bounds = materialize(bounds.join(weighed, "qid").select("qid", "block", "bound", "allowed", "terms", "ws", "avgdl"), "bounds")
    result = f"qid {qkind}, chunk_id {ckind}, score double"

    def scored(asks: DataFrame, zeros: bool = False) -> DataFrame:
        return _by_block(rows, asks, slices).groupBy("block", "slice").applyInPandas(_score(k, k1, b, zeros), result)

    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("at", best).where("at <= 2").drop("at", "bound").withColumn("least", F.lit(0.0))
    first = materialize(scored(first), "first")
    at = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score")))
    least = first.withColumn("at", at).where(F.col("at") == k).select("qid", F.col("score").alias("least"))
    rest = bounds.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("bound") + 10.0**-DIGITS >= F.col("least"))
    hits = materialize(scored(rest.drop("bound")), "hits")
    if not zeros:
        return hits
    short = qids.join(hits.groupBy("qid").agg(F.count("*").alias("m")), "qid", "left").where(F.coalesce("m", F.lit(0)) < k).select("qid", "filtered")
    short = materialize(short, "short")
    # filtered questions take zeros from the blocks they may see, the others from the first chunks of all
    empty = allowed.join(short, "qid", "left_semi").withColumns({"terms": F.array().cast("array<string>"), "ws": F.array().cast("array<double>"), "avgdl": F.lit(1.0), "least": F.lit(0.0)})
    filled = _by_block(rows, empty, slices).groupBy("block", "slice").applyInPandas(_score(2 * k, k1, b, True), result)
    keys = [r["chunk_id"] for r in chunks.select("chunk_id").orderBy("chunk_id").limit(2 * k).collect()]
    all_of = F.array(*[F.lit(x) for x in keys]).cast(f"array<{ckind}>")
    filled = filled.unionByName(short.where("NOT filtered").select("qid", F.explode(all_of).alias("chunk_id"), F.lit(0.0).alias("score")))
    return hits.unionByName(filled.select("qid", "chunk_id", F.lit(0.0).alias("score")).join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti"))
