"""What the two classifiers share: labelled rows, bounded samples of examples, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import utf8

#: Bytes that a row of (id, label) takes in a broadcast hash table, beside a text id.
_ROW_BYTES = 64


def held_out(id_col: str) -> Column:
    """Whether a row's label is never learnt from: crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str, id_col: str, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(_id, y): ids with a 0/1 ``label`` that may be learnt from. Several labels of one id count by majority, a tie as 1.

    The table is marked for broadcast only where its size, as counted, is below ``broadcast_bytes``; beyond it Spark joins
    as it sees fit."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    size = known.agg(F.sum(F.lit(_ROW_BYTES) + F.length(F.col("_id").cast("string"))).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(known) if size <= broadcast_bytes else known


def with_labels(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, how: str = "inner") -> DataFrame:
    """(id, text as bytes, y) of the documents; with ``how`` left also those without a label."""
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return rows.join(known, rows["id"] == known["_id"], how).select("id", "text", "y")


def class_sizes(docs: DataFrame, known: DataFrame, id_col: str) -> tuple[int, int]:
    """(labelled documents of class 0, of class 1)."""
    ids = docs.select(F.col(id_col).alias("id"))
    got = {r.y: r.n for r in ids.join(known, ids["id"] == known["_id"]).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return got.get(0, 0), got.get(1, 0)


def sample_of_each_class(rows: DataFrame, examples: int, sizes: tuple[int, int], id_col: str = "id") -> DataFrame:
    """About ``examples`` rows of each class, or all of a smaller one: those whose hashed id falls below the share wanted.
    Repeatable, without sorting or moving rows; never more than four times as many, however often ids repeat."""
    at = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    part = [rows.where(F.col("y") == c).where(at < F.lit(int(min(1.0, examples / max(1, n)) * (1 << 30)))).limit(4 * examples) for c, n in enumerate(sizes)]
    return part[0].unionByName(part[1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, intercept last, of the weighted logistic regression of y on the columns of x, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    slight = ridge * np.eye(len(beta))
    slight[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + slight, x.T @ (weight * (p - y)) + slight @ beta)
        beta -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return beta
