"""Periodic runs of words, found with a dictionary of basic factors.

Level k of the dictionary names, for every word, the factor of 2^k words that begins there; equal factors have equal names. A
run of period q holds factors of 2^k words, q <= 2^k < 2q, each of which occurs next exactly q words later. So the next
occurrence of every factor within twice its length proposes a period where three occurrences stand in arithmetic progression;
proposals of one period at neighbouring words are one. Each is extended to both sides by the names of all levels, and equal
extensions count once. No text is compared word by word for a period it does not propose.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tokens import blank_words, packed, small_batches, unpacked, utf8

LEAST_LENGTH, LEAST_EXPONENT = 6, 4

_FIELDS = ("start", "length", "period")
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in _FIELDS])
_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("runs", T.ArrayType(_RUN))])


def _levels(codes: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of 1, 2, 4, ... words by their first word, up to the last level at which two factors are equal."""
    levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    while True:
        below, half = levels[-1], 1 << (len(levels) - 1)
        if len(below) <= half:
            return levels
        pairs = below[:-half] * (len(codes) + 1) + below[half:]
        found, names = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return levels
        levels.append(names.astype(np.int64))


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int, back: bool) -> np.ndarray:
    """How many words from a and from b on (``back``: before a and before b) are equal, for each pair; a < b."""
    total = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, size = levels[k], 1 << k
        while True:  # a long run takes the top level several times, any other level once
            x, y = (a - total - size, b - total - size) if back else (a + total, b + total)
            fits = (x >= 0) & (y + size <= n)
            fits[fits] = names[x[fits]] == names[y[fits]]
            if not fits.any():
                break
            total[fits] += size
            if k < len(levels) - 1:
                break
    return total


def runs(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run of ``codes`` by start, then period: periods are the smallest ones, lengths
    at least ``LEAST_LENGTH`` and ``LEAST_EXPONENT`` periods."""
    n = len(codes)
    out = [np.zeros((0, 3), dtype=np.int64)]
    if n < LEAST_LENGTH:
        return out[0]
    levels = _levels(codes)
    for k, names in enumerate(levels):
        order = np.argsort(names, kind="stable")
        step = np.full(len(names), 0, dtype=np.int64)  # words to the next occurrence, 0 where there is none near
        same = names[order[:-1]] == names[order[1:]]
        step[order[:-1][same]] = (order[1:] - order[:-1])[same]
        step[step > 2 << k] = 0
        at = np.flatnonzero(step)
        at = at[step[at + step[at]] == step[at]]
        if not len(at):
            continue
        period = step[at]
        first = np.r_[True, (np.diff(at) != 1) | (np.diff(period) != 0)]
        at, period = at[first], period[first]
        left = _common(levels, at, at + period, n, back=True)
        length = left + _common(levels, at, at + period, n, back=False) + period
        good = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
        out.append(np.stack([(at - left)[good], length[good], period[good]], axis=1))
    return np.unique(np.concatenate(out)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without the repetitions: what a run has after its first period goes."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])


def reordered(words: list[bytes], h: int | None) -> list[bytes]:
    """The words read as the contract fixes it: in one document of ten, by the hash of its id, the rest from a word on repeats."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _judged(words: list[bytes]) -> tuple:
    seen: dict[bytes, int] = {}
    found = runs(np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words)))
    return len(words), collapsed(words, found), [dict(zip(_FIELDS, r, strict=True)) for r in found.tolist()]


@F.pandas_udf(_RESULT)
def _runs(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
    rows = [_judged(reordered(blank_words(t), None if pd.isna(h) else int(h))) for t, h in zip(texts, hashes, strict=True)]
    return pd.DataFrame(rows, columns=["n_words", "text", "runs"])


def with_runs(docs: DataFrame, text_col: str = "text", hash_col: Column | None = None) -> DataFrame:
    """``docs`` plus ``periodic``: n_words, text (the words without repetitions, joined by a space) and runs, an array of (start,
    length, period) by start, then period.

    A run is a stretch of words in which words one period apart are equal, which no neighbouring word extends; its period is the
    smallest. With ``hash_col`` the words are first read as ``reordered`` does; without it, or where it is null, as they stand.
    A null text has no words, a text without words no runs. Texts of any length are read whole, one row at a time; repeated rows
    are judged alike; an empty table gives an empty result. A column named periodic is replaced, others may have any name.
    """
    small_batches(docs.sparkSession)
    hashed = F.lit(None).cast("long") if hash_col is None else hash_col
    out = docs.select(packed(docs), _runs(utf8(text_col), hashed).alias("_runs"))
    text = F.col("_runs.text").cast("string")
    return unpacked(out, docs.columns, {"periodic": F.col("_runs").withField("text", text)})


def longest(runs_col: str = "periodic.runs") -> Column:
    """(start, length, period) of the longest run (ties: smallest start, then period); null without any."""
    best = F.array_max(F.transform(runs_col, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("long"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["long"]).alias("period")))


def digest(runs_col: str = "periodic.runs") -> Column:
    """All runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs_col, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in _FIELDS]), F.lit("\n"))), "")
