"""Nearest vectors through cells.

Centres are fitted to a sample of bounded size; then every row is placed in the cell of its nearest centre, with its distance from
it. A probe looks into its nearest cells first. In exact mode the distance of its k-th find there rules out cells by the triangle
inequality (no row of a cell is nearer than the centre's distance less the cell's radius); in approximate mode a fixed number of
cells is all it sees. Vectors have length one, so the order of distances is that of cosines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.scratch import materialize

DIGITS = 6
#: Rows the centres are fitted to, at most, and centres, at most.
SAMPLE, CENTRES = 20_000, 1_024
_SLICE = 20_000
#: Rows of one batch of probes with their cells, at most some more: every row carries a vector.
_ASKED = 1 << 14
#: Rows compared with all centres at a time, and probes compared with all rows of a slice.
_ROWS, _PROBES = 512, 32


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T))


def _fit(x: np.ndarray, n: int, steps: int = 12) -> np.ndarray:
    """Means of ``n`` groups of the rows of ``x`` by Lloyd's steps from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(steps):
        own = _distances(x, centres).argmin(axis=1)
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _pieces(batches, size: int):
    for p in batches:
        for i in range(0, len(p), size):
            yield p.iloc[i : i + size]


def _spread(p: pd.DataFrame, use: np.ndarray, slices: np.ndarray):
    """(cell, slice, qid, v) for each probe and cell in ``use`` and each slice of the cell, in bounded batches: a probe for which no
    cell is ruled out has as many rows as there are cells."""
    at, cell = np.nonzero(use)
    times = slices[cell]
    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, cell = np.repeat(at, times), np.repeat(cell, times)
    qids, vs = p["qid"].to_numpy(), p["v"].to_numpy()
    for i in range(0, len(at), _ASKED):
        own = at[i : i + _ASKED]
        yield pd.DataFrame({"cell": cell[i : i + _ASKED].astype(np.int32), "slice": part[i : i + _ASKED].astype(np.int32), "qid": qids[own], "v": vs[own]})


class VectorIndex:
    """Rows (cell, slice, key, v) in a table, and for each cell its centre, radius and number of slices."""

    def __init__(self, chunks: DataFrame, key: str = "chunk_id", vector: str = "embedding", centres: int | None = None):
        """Rows with a null, empty or zero vector match nothing and are left out. ``centres``: about the square root of the rows,
        where not given."""
        spark = chunks.sparkSession
        length = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x * x)
        rows = chunks.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col(vector).isNotNull() & (length > 0))
        rows = materialize(rows, "vectors")
        self.key, self.kind, self.size = key, chunks.schema[key].dataType.simpleString(), rows.count()
        n = centres or min(CENTRES, max(1, round(self.size**0.5)))
        share = min(1.0, SAMPLE / max(1, self.size))
        hashed = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30))
        sample = rows.where(hashed < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toPandas()
        self.centres = _fit(_unit(sample["v"]), min(n, len(sample))) if len(sample) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(self.centres)

        def place(batches):
            for p in _pieces(batches, _ROWS):
                d = _distances(_unit(p["v"]), shared.value)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "r": d[np.arange(len(p)), cell], "key": p["key"], "v": p["v"]})

        if self.size and not len(self.centres):
            raise ValueError("no row fell into the sample")
        kind = rows.schema["v"].dataType.simpleString()
        placed = materialize(rows.mapInPandas(place, f"cell int, r double, key {self.kind}, v {kind}"), "cells")
        found = placed.groupBy("cell").agg(F.max("r").alias("radius"), F.count("*").alias("n")).collect()
        self.radius, self.slices = np.full(len(self.centres), -1.0), np.zeros(len(self.centres), dtype=np.int64)
        for r in found:
            self.radius[r["cell"]], self.slices[r["cell"]] = r["radius"], -(-r["n"] // _SLICE)
        counts = F.array(*[F.lit(int(max(1, s))) for s in self.slices]) if len(self.slices) else F.array(F.lit(1))
        self.rows = placed.withColumn("slice", F.pmod(F.xxhash64(F.col("key").cast("string")), F.get(counts, F.col("cell"))).cast("int"))

    def search(self, probes: DataFrame, k: int, vector: str = "embedding", cells: int | None = None) -> DataFrame:
        """(qid, key, cosine, rank) for probes (qid, vector): the k nearest rows, ties by key; of the ``cells`` nearest cells alone where
        that is given."""
        qtype, vtype = probes.schema["qid"].dataType.simpleString(), probes.schema[vector].dataType.simpleString()
        order = W.partitionBy("qid").orderBy(F.desc("cosine"), "key")
        result = f"qid {qtype}, key {self.kind}, cosine double"
        if not len(self.centres):
            empty = probes.sparkSession.createDataFrame([], result).withColumn("rank", F.row_number().over(order))
            return empty.withColumnRenamed("key", self.key)
        shared = probes.sparkSession.sparkContext.broadcast((self.centres, self.radius, self.slices))
        first = cells or 2

        def look(step: int):
            """The cells of each probe: the nearest ones (0), or the others that may hold a nearer row (1)."""

            def run(batches):
                centres, radius, slices = shared.value
                for p in _pieces(batches, _ROWS):
                    d = _distances(_unit(p["v"]), centres)
                    d[:, radius < 0] = np.inf
                    rank = d.argsort(axis=1, kind="stable").argsort(axis=1)
                    use = (rank < first) if step == 0 else (rank >= first) & (d - radius <= p["far"].to_numpy()[:, None])
                    yield from _spread(p, use & np.isfinite(d), slices)

            return run

        def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(held):
                return pd.DataFrame({"qid": [], "key": [], "cosine": []})
            held = held.sort_values("key", kind="stable")
            keys, unit = held["key"].to_numpy(dtype=object), _unit(held["v"])
            qids, out = asked["qid"].to_numpy(dtype=object), []
            for at in range(0, len(asked), _PROBES):
                cos = np.round(_unit(asked["v"].iloc[at : at + _PROBES]) @ unit.T, DIGITS)
                least = np.partition(cos, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(cos), -np.inf)
                r, c = np.nonzero(cos >= least[:, None])
                order = np.lexsort((c, -cos[r, c], r))
                r, c = r[order], c[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[best], c[best]
                out.append(pd.DataFrame({"qid": qids[at + r], "key": keys[c], "cosine": cos[r, c]}))
            return pd.concat(out, ignore_index=True)

        def met(asked: DataFrame) -> DataFrame:
            """Probes of one cell meet its rows in lots of a bounded size, so neither side of a group grows with the tables."""
            lot = F.pmod(F.xxhash64(F.col("qid").cast("string"), F.lit("lot")), F.lit(lots)).cast("int")
            held = self.rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))) if lots > 1 else F.lit(0))
            both = asked.withColumn("lot", lot).groupBy("cell", "slice", "lot").cogroup(held.groupBy("cell", "slice", "lot"))
            return both.applyInPandas(lambda a, b: nearest(a, b), result)

        length = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x)
        asked = materialize(probes.select("qid", F.col(vector).alias("v")).where(F.col("v").isNotNull()).where(length > 0), "probes")
        lots = max(1, -(-asked.count() // _SLICE))
        schema = f"cell int, slice int, qid {qtype}, v {vtype}"
        found = materialize(met(asked.mapInPandas(look(0), schema)), "found")
        if cells is None:
            kth = found.withColumn("at", F.row_number().over(order)).where(F.col("at") == k)
            # |a - b| of unit vectors is sqrt(2 - 2 cos); a rounded cosine is at most half a unit too high
            kth = kth.select("qid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("cosine") - 10.0**-DIGITS))).alias("far"))
            rest = asked.join(kth, "qid", "left").select("qid", "v", F.coalesce("far", F.lit(3.0)).alias("far"))
            found = found.unionByName(met(rest.mapInPandas(look(1), schema)))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.withColumnRenamed("key", self.key)


def recall(exact: DataFrame, found: DataFrame, key: str = "chunk_id") -> float:
    """The share of the exact results that ``found`` has."""
    both = exact.select("qid", key).join(found.select("qid", key).withColumn("_f", F.lit(1)), ["qid", key], "left")
    return both.agg(F.avg(F.coalesce("_f", F.lit(0))).alias("r")).first()["r"]
