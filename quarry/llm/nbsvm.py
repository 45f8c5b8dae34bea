"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

N-grams are single words and runs of one to three word shapes, where a shape says which kinds of characters follow each
other and whether a word repeats the one before. Every n-gram takes part: it is known by its place in a table of 2^18, so
the table's size is fixed and no n-gram is left out; n-grams that share a place share its counts. The model is fitted by
dual coordinate descent on a bounded sample; the log-count ratios come from all labelled rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.labelled import class_sizes, known_labels, logistic, sample_of_each_class, with_labels
from quarry.llm.tokens import small_batches, utf8
from quarry.scratch import materialize

BITS = 18
_KINDS = bytes(0x61 if c >= 0x80 or 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x39 if 0x30 <= c <= 0x39 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shape(word: bytes) -> bytes:
    """Kinds of characters in order, runs shortened to one: ``the&&&`` -> ``a&``, ``NO!!`` -> ``A!``."""
    return _RUN.sub(rb"\1", word.translate(_KINDS))


def _place(kind: int, *parts: np.ndarray) -> np.ndarray:
    """The table places of n-grams of hashed parts."""
    x = np.full(len(parts[0]), kind, dtype=np.uint64)
    for part, odd in zip(parts, _ODD):
        x = (x ^ part) * odd
        x ^= x >> np.uint64(29)
    return (x * _ODD[3]) >> np.uint64(64 - BITS)


class Grams:
    """Text -> the sorted table places of its n-grams. Hashes of words seen before are looked up."""

    def __init__(self):
        self._known: dict[bytes, tuple[int, int]] = {}

    def _hashes(self, word: bytes) -> tuple[int, int]:
        got = xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(word))
        self._known[word] = got
        return got

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = [] if text is None else text.split()
        if not words:
            return np.zeros(0, dtype=np.int64)
        if len(self._known) > 300_000:
            self._known.clear()
        known = self._known
        both = np.array([known.get(w) or self._hashes(w) for w in words], dtype=np.uint64)
        word, form = both[:, 0], both[:, 1].copy()
        form[1:][word[1:] == word[:-1]] ^= _ODD[0]  # a word repeated at once has a shape of its own
        grams = [_place(0, np.unique(word)), _place(1, np.unique(form)), _place(2, form[:-1], form[1:]), _place(3, form[:-2], form[1:-1], form[2:])]
        return np.unique(np.concatenate(grams)).astype(np.int64)

    def __reduce__(self):
        return Grams, ()


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, n_terms: int, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i); rows: (term ids, values), y: +1 or -1."""
    w = np.zeros(n_terms + 1)
    alpha = np.zeros(len(rows))
    diag = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            ids, values = rows[i]
            g = y[i] * (float(w[ids] @ values) + w[-1]) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[ids] += step * y[i] * values
                w[-1] += step * y[i]
                alpha[i] = new
                worst = max(worst, abs(step) * math.sqrt(diag[i]))
        if worst < 1e-4:
            break
    return w


@dataclass
class Model:
    """Log-count ratios and weights by table place; its size is fixed."""

    ratio: np.ndarray
    weights: np.ndarray
    scale: np.ndarray

    def row(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, unit vector of log-count ratios) of a text's n-grams."""
        values = self.ratio[grams]
        norm = math.sqrt(float(values @ values))
        return grams, values / norm if norm else values

    def margin(self, grams: np.ndarray) -> float:
        places, values = self.row(grams)
        return float(self.weights[places] @ values + self.weights[-1])

    def score(self, grams: np.ndarray) -> float:
        x = self.scale[0] * self.margin(grams) + self.scale[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x)))))


def log_count_ratios(n: np.ndarray, sizes: tuple[int, int], smoothing: float = 1.0) -> np.ndarray:
    """Log of the share of class 1 that has an n-gram over that of class 0; 0 where no labelled text has it."""
    share = [(n[c] + smoothing) / (sizes[c] + 2 * smoothing) for c in (0, 1)]
    return np.where(n[0] + n[1] > 0, np.log(share[1] / share[0]), 0.0)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    examples: int = 3000, cost: float = 1.0, smoothing: float = 1.0,
) -> Model:
    """A model from the labels that may be learnt from.

    Class counts, and so the log-count ratios, cover all labelled rows and all their n-grams. The hinge-loss model and its
    calibration see about ``examples`` texts of each class (a bounded sample by hash of the id), weighted back to the class
    sizes in the calibration; every third of them is kept for the calibration alone.
    """
    small_batches(docs.sparkSession)
    known = known_labels(labels, label, id_col)
    sizes = class_sizes(docs, known, id_col)
    rows = with_labels(docs, known, id_col, text_col)
    grams = Grams()

    def count(batches):
        seen = np.zeros((2, 1 << BITS), dtype=np.int64)
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                seen[int(y), grams(text)] += 1
        here = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"place": here, "n0": seen[0, here], "n1": seen[1, here]})

    got = rows.select("text", "y").mapInPandas(count, "place int, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, 1 << BITS))
    for y in (0, 1):
        n[y, got["place"].to_numpy()] = got[f"n{y}"].to_numpy()
    ratio = log_count_ratios(n, sizes, smoothing)
    model = Model(ratio, np.zeros((1 << BITS) + 1), np.zeros(2))
    if not sizes[0] or not sizes[1]:
        model.scale[1] = 3.0 * ((sizes[1] > 0) - (sizes[0] > 0))
        return model

    @F.pandas_udf(T.BinaryType())
    def places(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams(t).astype("<i4").tobytes(), na_action=None)

    picked = sample_of_each_class(rows, examples, sizes).select(F.xxhash64("id").alias("h"), "y", places("text").alias("ids"))
    held = materialize(picked, "examples").toArrow()
    sample = sorted(zip(*[held[c].to_pylist() for c in ("h", "y", "ids")]))
    y, part = np.array([c for _, c, _ in sample]), np.arange(len(sample)) % 3
    vectors = [model.row(np.frombuffer(ids, "<i4")) for _, _, ids in sample]
    share = {c: sizes[c] / max(1, (y == c).sum()) for c in (0, 1)}
    fit_on = [i for i in range(len(y)) if part[i] or len(y) < 30]
    each = {c: len(fit_on) / 2 / max(1, sum(y[i] == c for i in fit_on)) for c in (0, 1)}
    model.weights = dual_coordinate_descent([vectors[i] for i in fit_on], np.where(y[fit_on] > 0, 1.0, -1.0), np.array([cost * each[y[i]] for i in fit_on]), 1 << BITS)
    rest = [i for i in range(len(y)) if not part[i] or len(y) < 30]
    margins = np.array([[float(model.weights[ids] @ v + model.weights[-1])] for ids, v in (vectors[i] for i in rest)])
    weight = np.array([share[y[i]] for i in rest])
    model.scale = logistic(margins, y[rest].astype(float), weight * len(rest) / weight.sum())
    return model


def with_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``quality_score`` (0 to 1), a function of the text alone, so repeated rows are scored alike. Null and empty
    texts, and those without any n-gram of a labelled text, get the score of the bias. Texts are read whole whatever their
    length. An empty table gives an empty result; a column ``quality_score`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    grams = Grams()

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.score(grams(t)), na_action=None).astype("float64")

    return docs.withColumn("quality_score", score.asNondeterministic()(utf8(text_col)))
