"""Near copies by SimHash fingerprints, with an exact check of the Jaccard similarity of word shingles.

Every text has a fingerprint over its shingles; deletion-variant signatures (``simhash.links``) link all fingerprints within two
bits, and texts with linked fingerprints share a bucket of candidates. At a similarity of 0.8 fingerprints lie about ten of
64 bits apart, which no key of a few bits can find, so texts further apart than the fingerprints reach have buckets by MinHash
beside these: 20 bands of 5 minima each, so a pair at 0.8 is missed once in 2,800 times and a closer one less often. The shingle
sets of candidates only are then compared exactly, whichever way they were found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bitmaps import bitmap, holds, low_bits
from quarry.llm.graph import components
from quarry.llm.simhash import fingerprint_of, links
from quarry.llm.tokens import lower_blank_words, packed, small_batches, unpacked, utf8
from quarry.scratch import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: The band of buckets by fingerprint; those by MinHash count from 0.
_BY_FINGERPRINT = -1
_SEEDS = np.random.default_rng(42).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BLOCK = 1 << 12


def hashed(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles in order; a shorter text is one shingle, a text without words has none."""
    toks = lower_blank_words(text)
    if not toks:
        return np.zeros(0, dtype="<u8")
    n = max(1, len(toks) - words + 1)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(toks[i : i + words])) for i in range(n)), dtype="<u8", count=n)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(hashed(text, words))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        x = (hashes[at : at + _BLOCK, None] ^ _SEEDS) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX
        np.minimum(low, x.min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(row.tobytes()) for row in low.reshape(BANDS, ROWS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


_SIGNATURE = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SIGNATURE)
def _signatures(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        every = hashed(t)
        own = np.unique(every)
        rows.append((len(own), fingerprint_of(every), bands(own)))
    return pd.DataFrame(rows, columns=["n", "fp", "bands"])


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(key, n, band, sig): every text of ``nodes`` in the bucket of its own fingerprint and in that of each lower one it has a
    link with, so texts within two bits share a bucket."""
    fps = materialize(nodes.where("n > 0").select("fp").distinct(), "fingerprints")
    lower = links(fps).select(F.col("b").alias("fp"), F.col("a").alias("sig"))
    at = materialize(lower.unionByName(fps.select("fp", F.col("fp").alias("sig"))), "lower")
    return nodes.where("n > 0").join(at, "fp").select("key", "n", F.lit(_BY_FINGERPRINT).alias("band"), "sig")


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, n, set) of the texts (key, _text) whose keys are ``wanted``: a task makes sets only of texts that a hash map of these
    keys lets pass, and only sets are dealt out."""
    place = low_bits(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long"))
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def made(text: pd.Series, at: pd.Series) -> pd.Series:
        may = holds(bits.value, at.to_numpy(np.uint64))
        return pd.Series([shingles(t).view("<i8") if m else None for t, m in zip(text, may, strict=True)])

    found = texts.select("key", made("_text", place).alias("set")).where("set IS NOT NULL")
    return found.groupBy("key").agg(F.any_value("set").alias("set")).join(wanted, "key", "left_semi").select("key", F.size("set").alias("n"), "set")


def digest(text_col: str) -> Column:
    """The 128 bits that stand for a text; null is like an empty text."""
    return F.unhex(F.md5(F.coalesce(utf8(text_col), F.lit(b""))))


def _may(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= F.lit(SIMILARITY) * F.greatest(a, b) - F.lit(1e-9)


def _enough(common: Column, na: str, nb: str) -> Column:
    """Whether so many common shingles make sets of these sizes similar enough."""
    return common >= F.lit(SIMILARITY) * (F.col(na) + F.col(nb) - common) - F.lit(1e-9)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with a Jaccard similarity of at least ``SIMILARITY``."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa"), F.col("n").alias("na")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb"), F.col("n").alias("nb")), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(_enough(F.col("common"), "na", "nb")).select("a", "b")


def _merged(placed: DataFrame, found: DataFrame) -> DataFrame:
    """``placed`` (key, component) after the links ``found`` (a, b) between keys: only components are linked, not keys."""
    ends = [placed.select(F.col("key").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    edges = found.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    moved = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return materialize(placed.join(moved, "component", "left").select("key", F.coalesce("to", "component").alias("component")), "components")


def _open(buckets: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of buckets whose texts are not all in one component yet, with their components."""
    held = buckets.join(placed, "key")
    several = held.groupBy("band", "sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return materialize(held.join(several.select("band", "sig"), ["band", "sig"]), "open")


def _with_leads(held: DataFrame, weight: Column) -> DataFrame:
    """(a, b): every text of an open bucket with the bucket's text of the highest weight, where these may be linked anew."""
    lead = held.groupBy("band", "sig").agg(F.max_by(F.struct("key", "n", "component"), F.struct(weight, "key")).alias("l"))
    pairs = held.join(lead, ["band", "sig"]).where((F.col("component") != F.col("l.component")) & _may("n", "l.n"))
    return pairs.select(F.col("l.key").alias("a"), F.col("key").alias("b")).distinct()


def _rest(held: DataFrame, sets: DataFrame, crowd: int) -> DataFrame:
    """All pairs (a, b) of the open buckets that may still be linked.

    Buckets of up to ``crowd`` texts are paired within. In larger ones a text is first held against all others at once: it
    cannot share more shingles with any text of another component than it has shingles that occur in other components at all.
    Texts outside the bucket's largest component for which these are too few, whatever the other set, have no link there. The
    others are paired with the texts of other components where the shingles that either has in common with any are enough for
    both sets; two texts of the largest component never meet."""
    sized = held.join(held.groupBy("band", "sig").agg(F.count("*").alias("size"), F.min("n").alias("least")), ["band", "sig"])
    small = sized.where(F.col("size") <= crowd)
    one = small.select("band", "sig", F.col("key").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    two = small.select("band", "sig", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = one.join(two, ["band", "sig"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may("na", "nb")).select("a", "b").distinct()

    large = materialize(sized.where(F.col("size") > crowd), "crowded")
    if large.isEmpty():
        return pairs
    parts = large.select("key", "component").distinct().join(sets.select("key", "set"), "key").select("key", "component", F.explode("set").alias("s"))
    spread = materialize(parts.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("s"), "spread")

    def common(keys: DataFrame) -> DataFrame:
        own = sets.join(keys, "key", "left_semi")
        alone = own.select("key", F.explode("set").alias("s")).join(spread, "s", "left_anti").groupBy("key").agg(F.count("*").alias("alone"))
        return materialize(own.select("key", "n").join(alone, "key", "left").select("key", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")), "common")

    each = large.groupBy("band", "sig", "component").agg(F.count("*").alias("m"))
    main = each.groupBy("band", "sig").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    outside = materialize(large.join(main, ["band", "sig"]).where("component <> main"), "outside")
    out_keys = outside.select("key").distinct()
    shared = common(out_keys)
    able = outside.join(shared, "key").withColumn("other", F.greatest("least", F.col("common").cast("int")))
    able = materialize(able.where(_enough(F.col("common"), "n", "other")), "able")
    near = large.join(able.select("band", "sig").distinct(), ["band", "sig"], "left_semi")
    shared = shared.unionByName(common(near.select("key").distinct().join(out_keys, "key", "left_anti")))
    mine = able.select("band", "sig", F.col("key").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("common").alias("sa"))
    other = near.join(shared, "key").select("band", "sig", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("common").alias("sb"))
    found = mine.join(other, ["band", "sig"]).where((F.col("ca") != F.col("cb")) & _enough(F.least("sa", "sb"), "na", "nb"))
    return pairs.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64, rounds: int = 2, minima: bool = True) -> DataFrame:
    """One row per input row: (id, key, component, component_id); ``key`` is the digest of the text.

    ``component_id`` is the smallest non-null id reachable through links between texts of similarity 0.8. Candidates are texts
    in one bucket by fingerprint or, unless ``minima`` is false (to measure the fingerprints alone), by MinHash. Equal texts are
    one node. Texts that are null or have no words are copies of each other. In ``rounds`` rounds every text is compared
    with one lead of each of its buckets that is in another component: first the text that shares most buckets with others,
    then a text by hash. What is left apart goes through ``_rest``, so large groups of copies take few comparisons and no
    link between components is left out.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text")).withColumn("key", digest("_text"))
    rows = materialize(texts.select("_id", "key", _signatures("_text").alias("s")).select("_id", "key", "s.n", "s.fp", "s.bands"), "signatures")
    nodes = rows.groupBy("key").agg(F.min("_id").alias("low"), *[F.any_value(c).alias(c) for c in ("n", "fp", "bands")])
    nodes = materialize(nodes, "nodes")
    index = _by_fingerprint(nodes)
    if minima:
        index = index.unionByName(nodes.select("key", "n", F.posexplode("bands").alias("band", "sig")))
    found = index.groupBy("band", "sig").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(index.join(found, ["band", "sig"]), "buckets")
    central = buckets.groupBy("key").agg(F.sum("size").alias("central"))
    buckets = materialize(buckets.drop("size").join(central, "key"), "central")
    wanted = central.select("key")
    sets = materialize(_sets(texts.select("key", "_text"), wanted), "sets")
    placed = materialize(wanted.select("key", F.col("key").alias("component")), "components")
    for turn in range(rounds):
        weight = F.col("central") if turn == 0 else F.xxhash64("key", F.lit(turn))
        found = materialize(_similar(_with_leads(_open(buckets, placed), weight), sets), "links")
        if not found.isEmpty():
            placed = _merged(placed, found)
    found = materialize(_similar(_rest(_open(buckets, placed), sets, crowd), sets), "links")
    placed = _merged(placed, found)

    empty = F.when(F.col("n") == 0, F.lit(b"")).otherwise(F.col("key"))
    placed = materialize(nodes.join(placed, "key", "left").select("key", "low", F.coalesce("component", empty).alias("component")), "placed")
    lowest = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = materialize(placed.join(lowest, "component").select("key", "component", "component_id"), "lowest")
    return rows.select("_id", "key").join(classes, "key").select(F.col("_id").alias(id_col), "key", "component", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay when one of each component of near copies is kept: a row with the smallest id.

    All columns of ``docs`` are returned as they were, whatever their names. Rows that repeat an id with texts of different
    components lose none of these texts; of rows that repeat id and text one stays. Rows with a null id cannot be named by a
    component and stay. Null texts and texts without words are copies of each other; long texts are compared whole. An empty
    table gives an empty result.
    """
    found = near_copies(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
    winners = materialize(found.groupBy("component").agg(F.min(id_col).alias("_id"), F.min("key").alias("_key")).drop("component"), "winners")
    rows = docs.select(packed(docs), F.col(id_col).alias("_id"), digest(text_col).alias("_key"))
    named = rows.join(winners, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return unpacked(named.unionByName(rows.where("_id IS NULL")), docs.columns, {})
