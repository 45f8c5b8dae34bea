"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all words of the labelled examples; a word's weight also has its relevance frequency, that is
how much more of the toxic texts than of the others hold it. The examples form an inverted index in blocks, with the largest
weight of every common word in each block. A text's neighbours under exact cosine are found by adding up its rare words,
then the maxima of its common words to a bound for every block, and going on with the blocks whose bound reaches the k-th
best sum. Votes weighted by similarity are calibrated on the examples themselves,
each judged without itself.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.labelled import class_sizes, known_labels, logistic, sample_of_each_class, with_labels
from quarry.llm.tokens import alnum_words, small_batches, utf8
from quarry.scratch import materialize

BLOCK = 16
COMMON = 4  # a term in more than one of so many examples is common
_NONE = np.zeros(0, dtype=np.int64)


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end), one range after the other, and the length of each range."""
    size = end - start
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total), size


class BlockMaxIndex:
    """Exact cosine search over unit vectors (term ids, weights). The examples are put in an order that brings those with
    the same frequent terms together, and cut into blocks of ``BLOCK``, for which the common terms, those in more than one of
    ``COMMON`` examples, keep their maxima; ``postings`` counts what searches have read."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size, self.blocks, self.postings = len(vectors), -(-len(vectors) // BLOCK), 0
        self.times = np.bincount(np.concatenate([t for t, _ in vectors]) if vectors else _NONE, minlength=n_terms)
        common = np.argsort(-self.times, kind="stable")[:64]
        bit = {int(t): 1 << (63 - i) for i, t in enumerate(common)}
        heads = [sum(bit.get(t, 0) for t in np.intersect1d(t, common).tolist()) for t, _ in vectors]
        self.order = np.array(sorted(range(self.size), key=lambda i: (heads[i], i)), dtype=np.int64)
        self.place = np.argsort(self.order)
        placed = [vectors[i] for i in self.order]
        by = np.argsort(np.concatenate([t for t, _ in placed]) if vectors else _NONE, kind="stable")
        self.docs = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in placed])[by] if vectors else _NONE
        self.weights = np.concatenate([w for _, w in placed])[by] if vectors else np.zeros(0)
        self.start = np.concatenate([[0], np.cumsum(self.times)])  # postings of each term
        often = np.flatnonzero(self.times > self.size // COMMON) if self.size else _NONE
        self.row = np.full(n_terms, -1, dtype=np.int64)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.size))  # postings of the common terms, as rows
        for r, t in enumerate(often.tolist()):
            here = slice(self.start[t], self.start[t + 1])
            self.dense[r, self.docs[here]] = self.weights[here]
        self.edges = np.arange(0, self.size, BLOCK)
        self.tops = np.maximum.reduceat(self.dense, self.edges, axis=1) if len(often) else np.zeros((0, self.blocks))  # maxima by block

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k examples of highest positive cosine, best first, ties by position; ``without`` is
        left out.

        The telling terms, those of short posting lists, are added up first. What the common terms can add to the examples
        of a block is bounded by their maxima in it, so only blocks with an example whose sum and bound together reach the
        k-th best sum matter. No other example can be among the k, so the result is exact. Common terms are rows of a matrix:
        where few blocks are open only these are read, else the rows are added whole, which is faster than picking."""
        common = self.row[terms] >= 0
        rare = terms[~common]
        at, size = _ranges(self.start[rare], self.start[rare + 1])
        scores = np.bincount(self.docs[at], np.repeat(values[~common], size) * self.weights[at], minlength=self.size).astype(np.float64, copy=False)
        self.postings += len(at)
        if 0 <= without < self.size:
            scores[self.place[without]] = -2.0
        rows, own = self.row[terms[common]], values[common]
        if len(rows):
            bound = own @ self.tops[rows] + 1e-9
            reached = max(0.0, np.partition(scores, -k)[-k]) if len(scores) > k else 0.0
            most = np.maximum.reduceat(scores, self.edges)
            open_ = np.flatnonzero(most + bound >= reached)
            self.postings += len(open_) * BLOCK * len(rows)
            if 4 * len(open_) < self.blocks:
                here = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                here = here[here < self.size]
                scores[here] += own @ self.dense[np.ix_(rows, here)]
            else:
                part = np.empty(self.size)
                for r, v in zip(rows.tolist(), own.tolist()):
                    scores += np.multiply(self.dense[r], v, out=part)
        found = np.flatnonzero(scores > 0)
        if len(found) > 4 * k:
            found = found[scores[found] >= np.partition(scores, -k)[-k] - 1e-11]
        cosines, positions = np.round(scores[found], 12), self.order[found]
        top = np.lexsort((positions, -cosines))[:k]
        return positions[top], cosines[top]


class Vocabulary:
    """The words of the examples by number. What is broadcast are the words in a row; each Python worker builds the dictionary
    once, at first use, and the driver none."""

    def __init__(self, words: bytes, size: int):
        self._words, self.size, self._ids = words, size, None

    def ids(self) -> dict[bytes, int]:
        if self._ids is None:
            self._ids = {w: i for i, w in enumerate(self._words.split())}
            self._words = b""
        return self._ids

    def __reduce__(self):
        return Vocabulary, (self._words or b" ".join(self._ids or ()), self.size)


@dataclass
class Model:
    """Everything a task needs to score texts; its size is bounded by the words of the examples."""

    vocab: Vocabulary
    weight_of: np.ndarray
    index: BlockMaxIndex
    ids: list
    toxic: np.ndarray
    weight: np.ndarray
    k: int
    scale: np.ndarray
    without: float
    _seen: dict = field(default_factory=dict)  # copies of a text are judged once

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(term ids, times) of the words that some example has."""
        get = self.vocab.ids().get
        found = [(i, n) for w, n in Counter(alnum_words(text)).items() if (i := get(w)) is not None]
        terms, times = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return terms, times

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(term ids ascending, unit weights, length before); weights are (1 + log times) x IDF x relevance frequency."""
        raw = (1 + np.log(times)) * self.weight_of[terms]
        by = np.argsort(terms)
        terms, raw = terms[by], raw[by]
        norm = math.sqrt(float(raw @ raw))
        return terms, raw / norm if norm else raw, norm

    def evidence(self, near: tuple[np.ndarray, np.ndarray], norm: float) -> list[float]:
        """What is calibrated: the similarity-weighted share of toxic neighbours (an example's weight makes up for sampling
        its class), their mean cosine, and how much of a text was there to compare."""
        at, cosines = near
        mass = cosines * cosines * self.weight[at]
        total = float(mass.sum())
        return [float(mass @ self.toxic[at]) / total, float(cosines.mean()), math.log1p(norm)] if total else [0.0, 0.0, math.log1p(norm)]

    def score(self, text: bytes | None) -> tuple[float, list, list]:
        """(score, ids of the neighbours, their cosines)."""
        key = xxhash.xxh128_digest(text or b"")
        if key not in self._seen:
            if len(self._seen) > 20_000:
                self._seen.clear()
            self._seen[key] = self._judge(*self.counts(text))
        return self._seen[key]

    def _judge(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, list, list]:
        terms, values, norm = self.unit(terms, times)
        near = self.index.nearest(terms, values, self.k)
        if not len(near[0]):
            return self.without, [], []
        x = float(np.dot(self.scale[:-1], self.evidence(near, norm)) + self.scale[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), [self.ids[i] for i in near[0]], near[1].tolist()


def relevance(n0: np.ndarray, n1: np.ndarray, sizes: tuple[int, int], least: int = 3) -> np.ndarray:
    """Relevance frequency log2(2 + odds): how many times as often toxic texts hold a word, each class as large as the
    other; 1 for words in fewer than ``least`` labelled texts."""
    odds = n1 * (sizes[0] / max(1, sizes[1])) / np.maximum(1, n0)
    return np.where(n0 + n1 >= least, np.log2(2 + odds), 1.0)


def _numbered(rows: pa.ChunkedArray) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of ``rows`` (words joined by spaces), and the numbers of all words one after the other. A word's number is
    its place among the first occurrences. No word becomes an object of the driver's Python."""
    words = pc.list_flatten(pc.split_pattern(rows, pattern=" ")).combine_chunks()
    words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    every, n = words.dictionary, len(words.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), every), b" ")
    return Vocabulary(joined[0].as_py(), n), np.array(words.indices, dtype=np.int32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = 3000, k: int = 15) -> Model:
    """A model from the labels that may be learnt from.

    The index holds about ``examples`` labelled texts of each class (a bounded sample by hash of the id); all their words
    are terms. Document frequencies cover all of ``docs`` and class counts all labelled rows."""
    small_batches(docs.sparkSession)
    known = known_labels(labels, label, id_col)
    sizes = class_sizes(docs, known, id_col)

    @F.pandas_udf(T.StructType([T.StructField("words", T.BinaryType()), T.StructField("times", T.BinaryType())]))
    def counted(texts: pd.Series) -> pd.DataFrame:
        every = [sorted(Counter(alnum_words(t)).items()) for t in texts]
        return pd.DataFrame([(b" ".join(w for w, _ in x), np.array([n for _, n in x], dtype="<i4").tobytes()) for x in every], columns=["words", "times"])

    picked = sample_of_each_class(with_labels(docs, known, id_col, text_col), examples, sizes)
    picked = materialize(picked.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "y", counted("text").alias("v")).select("id", "y", "v.*"), "examples").toArrow()
    picked = picked.sort_by([(c, "ascending") for c in ("id", "y", "words", "times")])
    ids, y = picked["id"].to_pylist(), picked["y"].to_numpy().astype(float)
    times = np.frombuffer(b"".join(picked["times"].to_pylist()), "<i4")
    ends = np.cumsum(pc.binary_length(picked["times"]).to_numpy() // 4, dtype=np.int64)
    here = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    vocab, terms = _numbered(picked["words"])
    del picked
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def frequencies(batches):
        ids, total = shared.value.ids(), 0
        seen = np.zeros((3, len(ids)), dtype=np.int64)
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                at = [i for w in set(alnum_words(text)) if (i := ids.get(w)) is not None]
                seen[0, at] += 1
                if y >= 0:
                    seen[1 + int(y), at] += 1
            total += len(pdf)
        here = np.flatnonzero(seen[0])
        yield pd.DataFrame({"term": [-1, *here], "n": [total, *seen[0, here]], "n0": [0, *seen[1, here]], "n1": [0, *seen[2, here]]})

    every = with_labels(docs, known, id_col, text_col, "left").select("text", F.coalesce("y", F.lit(-1)).alias("y"))
    got = every.mapInPandas(frequencies, "term int, n long, n0 long, n1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]).toArrow()
    table = np.zeros((3, vocab.size + 1))
    for i, c in enumerate(("n", "n0", "n1")):
        table[i, got["term"].to_numpy()] = got[c].to_numpy()
    shared.destroy()
    idf = np.log((1 + table[0, -1]) / (1 + table[0, :-1])) + 1e-3
    weight = np.where(y > 0, sizes[1] / max(1, y.sum()), sizes[0] / max(1, len(y) - y.sum()))
    blank = np.array([x.start == x.stop for x in here], dtype=bool)
    empty0, empty1 = float(weight[blank & (y == 0)].sum()), float(weight[blank & (y == 1)].sum())
    model = Model(vocab, idf * relevance(table[1, :-1], table[2, :-1], sizes), BlockMaxIndex([], vocab.size), ids, y, weight, k, np.zeros(4), (empty1 + 0.5) / (empty0 + empty1 + 1.0))
    del got, table
    values, norms = np.empty(len(terms)), np.empty(len(here))
    for i, x in enumerate(here):
        terms[x], values[x], norms[i] = model.unit(terms[x], times[x])
    model.index = BlockMaxIndex([(terms[x], values[x]) for x in here], vocab.size)
    if here:
        seen = np.array([model.evidence(model.index.nearest(terms[x], values[x], k, without=i), norms[i]) for i, x in enumerate(here)])
        model.scale = logistic(seen, y, weight * len(y) / weight.sum())
    return model


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``toxicity``: score (0 to 1), neighbours (ids of the nearest examples) and cosines.

    The score depends on the text alone, so repeated rows are scored alike. Null and empty texts, and those without any word
    of an example, have no neighbours and get the share of toxic labels among examples without words. Texts are read whole
    whatever their length. An empty table gives an empty result; a column ``toxicity`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("neighbours", T.ArrayType(T.StringType())), T.StructField("cosines", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t) for t in texts], columns=["score", "neighbours", "cosines"])

    return docs.withColumn("toxicity", score.asNondeterministic()(utf8(text_col)))
