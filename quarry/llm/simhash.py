"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most two bits have a half that differs in
at most one, so both index the same half with that one bit struck out. The index holds, for every distinct fingerprint,
each half under each of its 32 one-bit wildcards; equal keys are candidates and the full distance decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.graph import components
from quarry.llm.tokens import lower_blank_words, packed, small_batches, unpacked, utf8
from quarry.scratch import materialize

WORDS = 3
SEED = 42
DISTANCE = 2
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Signed 64-bit SimHash over word shingles, repeats included; zero for a text without words."""
    toks = lower_blank_words(text)
    if not toks:
        return 0
    n = max(1, len(toks) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        part = [b" ".join(toks[i : i + words]) for i in range(at, min(n, at + _BLOCK))]
        ones += _ones(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype="<u8", count=len(part)))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The same of shingles that are hashed already (unsigned 64 bits, repeats included); zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        ones += _ones(hashes[at : at + _BLOCK])
    return _majority(ones, len(hashes))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None).astype("int64")


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint_bits") -> DataFrame:
    """``docs`` with the SimHash of the whole text as a signed long; null and blank texts get zero."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, _fingerprints(utf8(text_col)))


def _variants(fps: DataFrame) -> DataFrame:
    """(slot, key, fp): 64 rows for each fingerprint; slot = struck-out bit, key = its half without that bit."""
    half = F.when(F.col("slot") < 32, F.lit(0xFFFFFFFF)).otherwise(F.lit(-0x100000000)).cast("long")
    return (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot"))
        .withColumn("bit", F.expr("shiftleft(1L, slot)"))
        .select("slot", F.col("fp").bitwiseAND(half).bitwiseAND(F.bitwise_not("bit")).alias("key"), "fp")
    )


def _near(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(fps: DataFrame, crowded: int = 256) -> DataFrame:
    """Links (a, b), a < b, that join every pair of distinct fingerprints (column ``fp``) within two bits.

    The index is dealt by key once. Buckets up to ``crowded`` fingerprints are then joined with the distance as join
    condition. The fingerprints of larger buckets are looked up again by all pairs of struck-out bits: such a bucket holds
    at most four fingerprints, all within two bits, so each needs a link to the smallest only and no set of pairs grows
    with the square of a bucket. Both ways are exact.
    """
    size = F.count("*").over(W.partitionBy("slot", "key"))
    shared = materialize(_variants(fps).withColumn("n", size).where("n > 1"), "buckets")
    some = shared.where(F.col("n") <= crowded)
    pairs = (
        some.select("slot", "key", F.col("fp").alias("a"))
        .join(some.select("slot", "key", F.col("fp").alias("b")), ["slot", "key"])
        .where((F.col("a") < F.col("b")) & _near("a", "b"))
        .select("a", "b")
    )
    strike = F.expr("transform(filter(sequence(0, 4095), x -> x div 64 < x % 64), x -> struct(x div 64 AS i, x % 64 AS j))")
    dense = (
        shared.where(F.col("n") > crowded)
        .select("fp")
        .distinct()
        .select("fp", F.explode(strike).alias("s"))
        .select("fp", "s", F.expr("fp & ~(shiftleft(1L, cast(s.i AS INT)) | shiftleft(1L, cast(s.j AS INT)))").alias("key"))
        .groupBy("s", "key")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return pairs.unionByName(dense).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every fingerprint in ``rows`` (_id, fp); a component is named by its lowest fingerprint."""
    classes = materialize(rows.groupBy("fp").agg(F.min("_id").alias("low")), "classes")
    joined = components(links(classes.select("fp")))
    placed = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "placed")
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    return materialize(placed.join(lowest, "component").select("fp", "component", "component_id"), "lowest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, fingerprint, component_id, fingerprint_bits).

    ``component_id`` is the smallest non-null id reachable through links of at most two bits, its own included; equal
    fingerprints are linked, so copies collapse before any join. Repeated ids give repeated rows; a null id keeps its row
    and takes no part in the minimum (a component of null ids only has a null component_id). Texts that are null or have
    no words share fingerprint zero. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = with_fingerprint(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "fp")
    rows = materialize(rows.select("_id", "fp"), "fingerprints")
    return rows.join(_classes(rows).drop("component"), "fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("fp").alias("fingerprint_bits"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay when one of each near-duplicate component is kept: the row with the smallest id,
    of several such rows the one with the lowest fingerprint and then the lowest text.

    All columns of ``docs`` are returned as they were, whatever their names. Rows that repeat an id with texts of different
    components lose none of these texts. Rows with a null id cannot be named by a component and stay as they are. Null and
    empty texts are copies of each other; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), _fingerprints(utf8(text_col)).alias("fp"), F.col(text_col).alias("_text"))
    rows = materialize(rows, "fingerprints")
    named = rows.where("_id IS NOT NULL")
    classes = _classes(named.select("_id", "fp"))
    first = named.select("_id", "fp").join(classes, "fp").where("_id = component_id")
    winners = materialize(first.groupBy("component").agg(F.min("_id").alias("_id"), F.min("fp").alias("fp")).drop("component"), "winners")
    best = named.join(winners, ["_id", "fp"], "left_semi").groupBy("_id", "fp").agg(F.min_by("_row", "_text").alias("a"), F.any_value("_row").alias("b"))
    kept = best.select(F.coalesce("a", "b").alias("_row")).unionByName(rows.where("_id IS NULL").select("_row"))
    return unpacked(kept, docs.columns, {})
