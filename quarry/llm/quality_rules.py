"""Quality rules: word statistics of whole texts, then robust multivariate outliers within each language and source.

The statistics are turned into a vector on variance-stabilised scales. For every (language, source) the location and
scatter are minimum-covariance-determinant estimates: from three deterministic starts, concentration steps take the share
of vectors nearest to the current estimate and estimate anew, until the determinant of the scatter falls no further; the
start with the lowest determinant counts. A text goes when its squared Mahalanobis distance exceeds a chi-square quantile.

A step is two grouped sums over all vectors: the first counts vectors on a fine logarithmic scale of distances, the second
adds up moments. The nearest share is exact in weight: vectors in the last place of the scale that is needed count with the
fraction that is left, so all subsets weigh the same and their determinants compare. Nothing of a group's size meets in one
task. Equal vectors count once: thousands of copies of one text are no evidence about a source's spread. Every scatter has
the squares of ``FLOORS`` added on its diagonal, so it is never singular, however few or alike the vectors are.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tokens import packed, small_batches, unpacked, utf8
from quarry.scratch import materialize

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_stops"]
#: Transformed statistics and the least standard deviation each is given: finer differences are no sign of quality.
FLOORS = {"size": 0.5, "word_len": 0.08, "symbols": 0.04, "dup_lines": 0.12, "repeats": 0.15, "upper": 0.08, "stops": 0.06}
SHARE = 0.75
ROUNDS = 30
BINS = 64  # to an octave of squared distance
LEAST = 35  # five vectors a dimension
_WS, _SYMBOLS, _STOPS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b".,;:!?"
_UPPER = bytes(range(65, 91))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(text: bytes | None) -> tuple[int, ...]:
    """STATS of one text; null counts as empty."""
    text = text or b""
    words = text.split()
    code_points = len(text) - _count(text, bytes(range(0x80, 0xC0)))
    seen: set[bytes] = set()
    dups = 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip(_WS):
            seen.add(line)
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) < len(windows):
        times, to = Counter(windows), 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeats += at + 5 - max(to, at)
                to = at + 5
    return len(words), code_points - _count(text, _WS), _count(text, _SYMBOLS), dups, repeats, _count(text, _UPPER), _count(text, _STOPS)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATS)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``stats`` (STATS, longs). Null and empty texts give zeros."""
    small_batches(docs.sparkSession)
    return docs.withColumn("stats", _statistics(utf8(text_col)))


def _vector() -> dict[str, Column]:
    """The transformed statistics of the struct column ``stats``."""
    n = {c: F.col("stats")[c] for c in STATS}
    words, chars = F.greatest(n["n_words"], F.lit(1)), F.greatest(n["word_chars"], F.lit(1))
    return {
        "size": F.log(words),
        "word_len": F.log(chars / words),
        "symbols": F.sqrt(n["n_symbols"] / chars),
        "dup_lines": F.sqrt(n["n_dup_lines"] / words),
        "repeats": F.sqrt(n["n_repeat_words"] / words),
        "upper": F.sqrt(n["n_upper"] / chars),
        "stops": F.sqrt(n["n_stops"] / chars),
    }


NAMES = list(FLOORS)
_P = len(NAMES)


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    """Its inverse by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(share: float, p: int = _P) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal vectors estimate that of all."""
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


_STATE = "pool string, start string, m array<double>, w array<double>, logdet double"


def _estimate(moments: DataFrame, share: float, floors: list[float]) -> DataFrame:
    """Weighted moments (pool, start, n, c, s, ss) about ``c`` -> location ``m``, inverse scatter ``w`` (upper triangle) and the
    logarithm of the scatter's determinant."""
    factor, floor, pairs, p = consistency(share, len(floors)) if share < 1 else 1.0, np.diag(np.square(floors)), _pairs(len(floors)), len(floors)

    def solve(batches):
        for pdf in batches:
            rows = []
            for pool, start, n, c, s, ss in zip(pdf["pool"], pdf["start"], pdf["n"], pdf["c"], pdf["s"], pdf["ss"]):
                shift = np.asarray(s) / n
                cov = np.zeros((p, p))
                for (i, j), v in zip(pairs, ss):
                    cov[i, j] = cov[j, i] = v / n - shift[i] * shift[j]
                scatter = factor * cov + floor
                inv = np.linalg.inv(scatter)
                rows.append((pool, start, list(np.asarray(c) + shift), [inv[i, j] for i, j in pairs], float(np.linalg.slogdet(scatter)[1])))
            yield pd.DataFrame(rows, columns=["pool", "start", "m", "w", "logdet"])

    return moments.mapInPandas(solve, _STATE)


def _distance(v: str, m: str, w: str, p: int) -> Column:
    """Squared Mahalanobis distance of the array ``v`` to location ``m`` with inverse scatter ``w``."""
    d = [F.col(v)[i] - F.col(m)[i] for i in range(p)]
    return reduce(lambda a, b: a + b, [F.col(w)[k] * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_pairs(p))])


def _sums(rows: DataFrame, weight: Column, about: str, p: int) -> DataFrame:
    """Weighted moments of the array ``v`` about ``about``, for each pool and start."""
    d = [F.col("v")[i] - F.col(about)[i] for i in range(p)]
    sums = [F.sum(weight).alias("n"), *[F.sum(weight * x).alias(f"s{i}") for i, x in enumerate(d)], *[F.sum(weight * d[i] * d[j]).alias(f"q{i}_{j}") for i, j in _pairs(p)]]
    summed = rows.groupBy("pool", "start", F.col(about).alias("c")).agg(*sums)
    return summed.select("pool", "start", "n", "c", F.array(*[f"s{i}" for i in range(p)]).alias("s"), F.array(*[f"q{i}_{j}" for i, j in _pairs(p)]).alias("ss"))


def _concentrate(vectors: DataFrame, now: DataFrame, share: float, floors: list[float]) -> DataFrame:
    """One concentration step from every state of ``now``: the estimate of the vectors nearest to it, ``share`` of all in weight."""
    p = len(floors)
    placed = vectors.join(now.select("pool", "start", "m", "w"), "pool")
    placed = placed.withColumn("bin", F.floor(BINS * F.log2(F.greatest(_distance("v", "m", "w", p), F.lit(1e-9)))))
    bins = placed.groupBy("pool", "start", "bin").agg(F.count("*").alias("n"))
    to_here = W.partitionBy("pool", "start").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    cut = bins.withColumn("before", F.coalesce(F.sum("n").over(to_here), F.lit(0))).withColumn("h", F.ceil(share * F.sum("n").over(W.partitionBy("pool", "start"))))
    edge = cut.where((F.col("before") < F.col("h")) & (F.col("before") + F.col("n") >= F.col("h"))).select("pool", "start", F.col("bin").alias("edge"), ((F.col("h") - F.col("before")) / F.col("n")).alias("part"))
    edge = materialize(now.join(edge, ["pool", "start"]), "edge")
    placed = vectors.join(edge, "pool").withColumn("bin", F.floor(BINS * F.log2(F.greatest(_distance("v", "m", "w", p), F.lit(1e-9))))).where("bin <= edge")
    weight = F.when(F.col("bin") < F.col("edge"), F.lit(1.0)).otherwise(F.col("part"))
    return materialize(_estimate(_sums(placed, weight, "m", p), share, floors), "mcd")


def _starts(vectors: DataFrame, floors: list[float]) -> DataFrame:
    """Three starts for every pool, all at the medians: scatter by median absolute deviations alone, by the correlation of
    the hyperbolic tangents of the standardised vectors, and by that of their spatial signs."""
    p = len(floors)
    pairs = _pairs(p)
    med = materialize(vectors.groupBy("pool").agg(F.array(*[F.percentile_approx(F.col("v")[i], 0.5, 10000) for i in range(p)]).alias("med")), "medians")
    mad = vectors.join(med, "pool").groupBy("pool", "med").agg(F.array(*[F.sqrt(F.pow(1.4826 * F.percentile_approx(F.abs(F.col("v")[i] - F.col("med")[i]), 0.5, 10000), 2) + F.lit(floors[i] ** 2)) for i in range(p)]).alias("scale"))
    mad = materialize(mad, "scales")
    z = vectors.join(mad, "pool").withColumn("z", F.array(*[(F.col("v")[i] - F.col("med")[i]) / F.col("scale")[i] for i in range(p)]))
    size = F.sqrt(reduce(lambda a, b: a + b, [F.col("z")[i] * F.col("z")[i] for i in range(p)]))
    kinds = {"tanh": lambda i: F.tanh(F.col("z")[i]), "sign": lambda i: F.col("z")[i] / F.greatest(F.col("size"), F.lit(1e-9))}
    sums = {k: F.array(*[F.sum(f(i) * f(j)) for i, j in pairs]).alias(k) for k, f in kinds.items()}
    summed = materialize(z.withColumn("size", size).groupBy("pool", "med", "scale").agg(F.count("*").alias("n"), *sums.values()), "starts")

    def solve(batches):
        for pdf in batches:
            rows = []
            for pool, m, scale, *kinds in zip(pdf["pool"], pdf["med"], pdf["scale"], pdf["tanh"], pdf["sign"]):
                for name, sums in zip(("mad", "tanh", "sign"), (None, *kinds)):
                    r = np.eye(p)
                    if sums is not None:
                        full = np.zeros((p, p))
                        for (i, j), x in zip(pairs, sums):
                            full[i, j] = full[j, i] = x
                        spread = np.sqrt(np.maximum(np.diag(full), 1e-12))
                        r = 0.99 * full / np.outer(spread, spread)
                        np.fill_diagonal(r, 1.0)
                    scatter = r * np.outer(scale, scale)
                    inv = np.linalg.inv(scatter)
                    rows.append((pool, name, list(m), [inv[i, j] for i, j in pairs], float("inf")))
            yield pd.DataFrame(rows, columns=["pool", "start", "m", "w", "logdet"])

    return materialize(summed.mapInPandas(solve, _STATE), "start")


def mcd_estimates(vectors: DataFrame, share: float = SHARE, rounds: int = ROUNDS, floors: list[float] | None = None, reweight: bool = True) -> DataFrame:
    """(pool, m, w, logdet) for every pool of ``vectors`` (pool and the array ``v``, distinct rows).

    Two concentration steps from each start; the one of the lowest determinant goes on, until no pool's determinant falls
    (at most ``rounds`` steps: a step is taken back where it does not lower it). With ``reweight``, one last estimate of all
    vectors within the 0.975 quantile."""
    floors = list(FLOORS.values()) if floors is None else floors
    p = len(floors)
    tried = _concentrate(vectors, _concentrate(vectors, _starts(vectors, floors), share, floors), share, floors)
    best = F.min(F.struct("logdet", "start", "m", "w")).alias("b")
    now = materialize(tried.groupBy("pool").agg(best).select("pool", "b.start", "b.m", "b.w", "b.logdet"), "best")
    moving = now
    for _ in range(rounds):
        after = _concentrate(vectors, moving, share, floors)
        old = now.select("pool", F.col("logdet").alias("old"))
        moving = materialize(after.join(old, "pool").where(F.col("logdet") < F.col("old") - 1e-7).drop("old"), "lower")
        if moving.isEmpty():
            break
        now = materialize(now.join(moving.select("pool"), "pool", "left_anti").unionByName(moving), "mcd")
    if not reweight:
        return now
    inside = vectors.join(now, "pool").where(_distance("v", "m", "w", p) <= chi2_quantile(0.975, p))
    return materialize(_estimate(_sums(inside, F.lit(1.0), "m", p), 0.975, floors), "mcd")


def _pools(rows: DataFrame, least: int) -> DataFrame:
    """The pool of each row's (lang, source): its own when that has ``least`` different vectors; else what its language has
    over, when that is as many; else what all languages have over, however few."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= least, F.concat_ws("\x01", F.lit("own"), "lang", "source"))
    rest = F.sum(F.when(own.isNull(), F.col("n"))).over(W.partitionBy("lang"))
    by_lang = sizes.withColumn("pool", own).withColumn("rest", rest)
    return by_lang.select("lang", "source", F.coalesce("pool", F.when(F.col("rest") >= least, F.concat_ws("\x01", F.lit("lang"), "lang")), F.lit("all")).alias("pool"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = 0.99999, least: int = LEAST) -> DataFrame:
    """``docs`` plus ``stats`` (STATS), ``base_failed``, ``distance`` (squared; null where the base rules failed) and ``kept``:
    base passed and the distance within the chi-square ``quantile``.

    A (language, source) of at least ``least`` different vectors has its own estimate; smaller ones of a language share one,
    and what is still smaller shares one over all languages, so every text that passes the base rules is judged. Null and
    empty texts fail the base rules. A null language or source is a group of its own. Rows that repeat are judged alike. Very
    long texts are read whole. An empty table gives an empty result. Columns of the new names are replaced; others may have
    any name.
    """
    return outliers(with_statistics(docs, text_col), lang_col, source_col, quantile, least)


def outliers(counted: DataFrame, lang_col: str = "lang", source_col: str = "source", quantile: float = 0.99999, least: int = LEAST) -> DataFrame:
    """``judge`` for rows that have their ``stats`` already; they are read twice, so a table serves better than a plan."""
    n = {c: F.col("stats")[c] for c in STATS}
    failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
    key = {name: F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(name) for name, c in (("lang", lang_col), ("source", source_col))}
    keyed = counted.select(packed(counted), *key.values(), failed.alias("failed"), F.array(*_vector().values()).alias("v"))
    rows = materialize(keyed.where("NOT failed").select("lang", "source", "v").distinct(), "vectors")
    pools = materialize(_pools(rows, least), "pools")
    vectors = materialize(rows.join(pools, ["lang", "source"]).select("pool", "v").distinct(), "pooled")
    found = materialize(pools.join(mcd_estimates(vectors), "pool").select("lang", "source", "m", "w"), "found")
    out = keyed.join(found, ["lang", "source"], "left").withColumn("d", F.when(~F.col("failed"), _distance("v", "m", "w", _P)))
    kept = ~F.col("failed") & F.coalesce(F.col("d") <= chi2_quantile(quantile, _P), F.lit(False))
    return unpacked(out, counted.columns, {"base_failed": F.col("failed"), "distance": F.col("d"), "kept": kept})
