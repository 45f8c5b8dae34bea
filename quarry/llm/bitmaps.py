"""Hash maps of a fixed number of bits: sets of hashes small enough to broadcast whatever the size of the input.

A map never misses what is in the set; by chance it holds more, so whoever asks it must be right with more rows too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MiB.
BITS = 25
MASK = (1 << BITS) - 1
_BLOCK = 15


def low_bits(x: Column) -> Column:
    """The place of a 64-bit hash in a map."""
    return x.bitwiseAND(F.lit(MASK))


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the map has each of these places (uint64)."""
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0


def bitmap(at: DataFrame) -> np.ndarray:
    """The map with the places ``at`` (one column, long) set: tasks make blocks of it, the driver joins 1,024 of them."""

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for p in parts:
            spot = p["at"].to_numpy(np.int64)
            np.bitwise_or.at(made, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
        rows = made.reshape(-1, 1 << (_BLOCK - 3))
        some = np.flatnonzero(rows.any(axis=1))
        yield pd.DataFrame({"block": some.astype(np.int32), "bits": [rows[i].tobytes() for i in some]})

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        made = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in p["bits"]])
        return pd.DataFrame({"block": p["block"].iloc[:1], "bits": [made.tobytes()]})

    schema = "block int, bits binary"
    out = np.zeros((1 << (BITS - _BLOCK), 1 << (_BLOCK - 3)), dtype=np.uint8)
    for r in at.toDF("at").mapInPandas(blocks, schema).groupBy("block").applyInPandas(joined, schema).collect():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)
