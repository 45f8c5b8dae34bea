"""Language-model scores by a hierarchical Pitman-Yor model.

Every word that can precede another has a restaurant whose customers are the words that follow it. Tables of all these context
restaurants are the customers of one parent, the root restaurant, whose base is uniform over dishes. Dishes are the most frequent
words, the end of a text, and one dish for all other words, which one further restaurant over the counts of these words divides;
that one keeps a share for words never seen.

Seating is sampled by Gibbs steps on the number of tables t of a dish with c customers: a customer leaves, alone at a table or
not, and is seated again at a table of the dish or a new one. With a discount of 1/2 the chance to sit alone, given c and t, is
exactly (t - 1) / (2 c - t - 1) (a ratio of generalised Stirling numbers), so a step needs neither table sizes nor, for a pair of
words that occurs once, any sampling at all. All context restaurants take their steps at the same time, with the parent's
predictive of the round before; then the root takes its steps. Rounds after the first ones are kept, and the predictive
probability of a word is averaged over them.

What is broadcast is bounded by the number of dishes (``DISHES``, words of up to ``LONGEST_WORD`` bytes): the words, and one
number for each of them per quantity and round. Pairs of words are dealt out by a hash of the pair, as sorted keys that tasks
have summed before. The pairs of every text meet their counts there, the most frequent ones (at most ``HOT``) in the task that
reads the text; what each shard gives to the texts of a chunk comes back as one row, and chunks add theirs up. A text has at most
one part for each shard and for each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import lower_blank_words, small_batches, utf8
from quarry.scratch import materialize

DISHES = 1 << 18
LONGEST_WORD = 64
HOT = 1 << 17
DISCOUNT, CONCENTRATION = 0.5, 1.0
BURN_IN, KEPT = 2, 2
STEPS = 12
#: Add-constant of the base score.
ADDED = 0.1

REST, END = 0, 1
_SHARD = 1 << 19  # tokens of training text a shard of pairs, at most
_SHARDS = 256  # shards at least: a text meets most of them, so its parts do not multiply as shards are added
_ROW = 1 << 12  # pairs a row
_HELD = 1 << 20
_IDX = 26  # bits for the place of a text among those a task holds

_GOLD, _WIDE = 0x9E3779B97F4A7C15, (1 << 64) - 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _MIX1
    x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


def _noise(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the step only, so a task that runs again draws the same."""
    return (_mixed(keys + np.uint64((step + 1) * _GOLD & _WIDE)) >> np.uint64(11)) * 2.0**-53


def tables(customers: np.ndarray, mass: np.ndarray, keys: np.ndarray, seed: int, steps: int = STEPS) -> np.ndarray:
    """The number of tables of each dish, averaged over the second half of ``steps`` Gibbs steps.

    ``mass``: (concentration + discount x tables of the restaurant) x probability of the dish at the parent. The chain begins where
    leaving and opening a table are equally likely."""
    c, a = customers.astype(np.float64), mass.astype(np.float64)
    b = 2 * a + c - 0.5
    t = np.clip(np.round(b - np.sqrt(np.maximum(0.0, b * b - 2 * (c - 1) - 4 * a * c))), 1, np.maximum(1, c))
    total, kept = np.zeros(len(c)), 0
    for step in range(steps):
        at = seed * 2 * steps + 2 * step
        t -= _noise(keys, at) * (2 * c - t - 1) < t - 1
        t += _noise(keys, at + 1) * (a + c - 1 - DISCOUNT * t) < a
        if 2 * step >= steps:
            total, kept = total + t, kept + 1
    return np.where(c <= 1, c, total / kept)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, so that leading zeros cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _packed_sorted(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=0))


def _unpacked_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(x))


class Vocabulary:
    """The dishes: their words and counts, and the totals of all training text."""

    def __init__(self, words: list[bytes], counts: list[int], n_texts: int, n_tokens: int, n_distinct: int):
        rest = n_tokens - n_texts - sum(counts)
        self.words, self.size = words, len(words) + 2
        self.counts = np.array([rest, n_texts, *counts], dtype=np.int64)
        self.n_tokens, self.n_distinct = n_tokens, n_distinct
        self.rest_words = n_distinct - len(words) - (n_texts > 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the base probability of tokens with these counts."""
        return np.log10((counts + ADDED) / (self.n_tokens + ADDED * (self.n_distinct + 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for w in lower_blank_words(text):
                held[w] = held.get(w, 0) + 1
        if len(held) > _HELD // 2:
            yield given()
            held = {}
    yield given()


def _vocabulary(words: DataFrame, n_texts: int, dishes: int) -> tuple[Vocabulary, int]:
    """The words whose counts lie at or above the lowest level of counts (sixteen a doubling) at which all of them have a place, and
    that level."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    levels = words.where(F.length("word") <= LONGEST_WORD).groupBy(level.alias("level")).agg(F.count("*").alias("m"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    least, room = 1 << 62, dishes - 2
    for r in levels:
        if (room := room - r["m"]) < 0:
            break
        least = r["least"]
    found = words.where((F.col("c") >= least) & (F.length("word") <= LONGEST_WORD)).orderBy(F.desc("c"), "word").collect()
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    return Vocabulary([bytes(r["word"]) for r in found], [r["c"] for r in found], n_texts, (total["n"] or 0) + n_texts, total["v"] + (n_texts > 0)), least


_CODED = "n_tokens long, n_known long, base double, codes binary, rare array<binary>, times array<long>"


def _coded(vocabulary):
    """Texts as numbers of dishes; words without a dish beside them, with their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        number = {w: i + 2 for i, w in enumerate(voc.words)}
        base = voc.base(voc.counts)
        known = voc.counts > 0
        base[REST], known[REST] = 0.0, False
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(3).to_pylist():
                words = lower_blank_words(text)
                codes = np.array([number.get(w, REST) for w in words] + [END], dtype=np.int64)
                rare: dict[bytes, int] = {}
                for i in np.flatnonzero(codes == REST).tolist():
                    rare[words[i]] = rare.get(words[i], 0) + 1
                planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes()
                out.append((len(codes), int(known[codes].sum()), float(base[codes].sum()), planes, list(rare), list(rare.values())))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "held_out", "rid", *[f.split()[0] for f in _CODED.split(", ")]])

    return run


def _codes(planes: bytes) -> np.ndarray:
    low = np.frombuffer(planes, dtype=np.uint8).reshape(3, -1).astype(np.int64)
    return low[0] | low[1] << 8 | low[2] << 16


def _pairs(codes: np.ndarray, size: int) -> np.ndarray:
    """A key for each token: the token before it (the end of a text before the first) and the token."""
    return np.r_[END, codes[:-1]] * size + codes


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(keys.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % shards


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in order)."""
    shard = _shards(keys, shards)
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.diff(shard[order], append=-1)) + 1
    for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
        yield int(shard[order[a]]), order[a:b]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


_PAIRS = "shard int, keys binary, counts binary"


def _count_pairs(size: int, shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[list, list] = ([], [])
        n = 0

        def given() -> Iterator[pd.DataFrame]:
            if held[0]:
                keys, counts = _summed(*held)
                rows = [(s, _packed_sorted(keys[at]), _packed(counts[at])) for s, at in _dealt(keys, shards)]
                yield pd.DataFrame(rows, columns=["shard", "keys", "counts"])

        for p in batches:
            for at in range(0, len(p), 64):
                keys, counts = np.unique(np.concatenate([_pairs(_codes(c), size) for c in p["codes"].iloc[at : at + 64]]), return_counts=True)
                held[0].append(keys)
                held[1].append(counts)
                n += len(keys)
                if n > 2 * _HELD:
                    keys, counts = _summed(*held)
                    held, n = ([keys], [counts]), len(keys)
                    if n > _HELD:
                        yield from given()
                        held, n = ([], []), 0
        yield from given()

    return run


def _merge_pairs(p: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one shard: those that occur more than once with their counts, the others (counts null) by themselves."""
    keys, counts = _summed([_unpacked_sorted(x) for x in p["keys"]], [_unpacked(x) for x in p["counts"]])
    rows = []
    for some, own in ((counts > 1, True), (counts == 1, False)):
        k, c = keys[some], counts[some]
        for at in range(0, len(k), _ROW):
            rows.append((p["shard"].iloc[0], _packed_sorted(k[at : at + _ROW]), _packed(c[at : at + _ROW]) if own else None))
    return pd.DataFrame(rows, columns=["shard", "keys", "counts"])


class Model:
    """What one kept round gives: the mass that each context hands to the root, and the root's predictive."""

    def __init__(self, context_tables: np.ndarray, root_customers: np.ndarray, counts: np.ndarray, seed: int):
        size = len(counts)
        self.seed, self.served = seed, CONCENTRATION + counts.astype(np.float64)
        self.mass = CONCENTRATION + DISCOUNT * context_tables
        seated = root_customers > 0
        n = np.ceil(root_customers)
        t = seated.astype(np.float64)
        for turn in range(4):
            mass = (CONCENTRATION + DISCOUNT * t.sum()) / size
            t = np.where(seated, tables(np.maximum(n, 1), np.full(size, mass), np.arange(size, dtype=np.uint64), 1000 + 4 * seed + turn), 0)
        self.root = (np.maximum(0, root_customers - DISCOUNT * t) + (CONCENTRATION + DISCOUNT * t.sum()) / size) / (CONCENTRATION + root_customers.sum())

    def tables(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Tables of pairs in their context restaurants."""
        size = len(self.root)
        return tables(counts, self.mass[keys // size] * self.root[keys % size], keys.astype(np.uint64), self.seed)

    def probability(self, keys: np.ndarray, counts: np.ndarray, seated: np.ndarray) -> np.ndarray:
        """Predictive probability of the second word of each pair after the first."""
        size = len(self.root)
        v, w = keys // size, keys % size
        return (np.where(counts > 0, counts - DISCOUNT * seated, 0) + self.mass[v] * self.root[w]) / self.served[v]


def _averaged(models: list[Model], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(keys))
    for m in models:
        seated = np.minimum(counts, 1).astype(np.float64)
        several = counts > 1
        seated[several] = m.tables(keys[several], counts[several])
        total += m.probability(keys, counts, seated)
    return total / len(models)


def _seat(size: int, model):
    """Tables of all pairs of a task's rows, by context and by word; without a model one table for each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_context, by_word = np.zeros(size), np.zeros(size)
        for p in batches:
            for packed, c in zip(p["keys"], p["counts"], strict=True):
                keys = _unpacked_sorted(packed)
                t = np.ones(len(keys)) if c is None or model is None else model.value.tables(keys, _unpacked(c))
                by_context += np.bincount(keys // size, weights=t, minlength=size)
                by_word += np.bincount(keys % size, weights=t, minlength=size)
        some = np.flatnonzero(by_context + by_word)
        yield pd.DataFrame({"dish": some, "by_context": by_context[some], "by_word": by_word[some]})

    return run


def _sampled(pairs: DataFrame, voc: Vocabulary) -> list[Model]:
    """The models of the kept rounds. Each round is one job over the pairs; what comes back is two numbers a dish."""
    spark, kept, model = pairs.sparkSession, [], None
    for turn in range(BURN_IN + KEPT):
        sums = pairs.mapInPandas(_seat(voc.size, model), "dish long, by_context double, by_word double")
        got = sums.groupBy("dish").agg(F.sum("by_context").alias("by_context"), F.sum("by_word").alias("by_word")).toPandas()
        arrays = [np.zeros(voc.size) for _ in range(2)]
        for a, c in zip(arrays, ("by_context", "by_word"), strict=True):
            a[got["dish"].to_numpy(np.int64)] = got[c].to_numpy(np.float64).round(6)
        found = Model(*arrays, voc.counts, turn)
        if turn >= BURN_IN:
            kept.append(found)
        model = spark.sparkContext.broadcast(found)
    return kept


def _hot_pairs(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent pairs: all those above the lowest count that at most ``most`` pairs exceed, by levels of
    counts (four a doubling)."""

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros(256, dtype=np.int64)
        for p in batches:
            for c in p["counts"]:
                m += np.bincount(np.floor(4 * np.log2(_unpacked(c))).astype(np.int64), minlength=256)
        yield pd.DataFrame({"level": np.flatnonzero(m), "m": m[m > 0]})

    several = pairs.where("counts IS NOT NULL")
    found = several.mapInPandas(levels, "level long, m long").groupBy("level").agg(F.sum("m").alias("m")).orderBy(F.desc("level")).collect()
    least = 256
    for r in found:
        if (most := most - r["m"]) < 0:
            break
        least = r["level"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for packed, c in zip(p["keys"], p["counts"], strict=True):
                keys, counts = _unpacked_sorted(packed), _unpacked(c)
                top = np.floor(4 * np.log2(counts)) >= least
                yield pd.DataFrame({"key": keys[top], "n": counts[top]})

    got = several.mapInPandas(run, "key long, n long").toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


_ENTRIES = "shard int, chunk long, keys binary, places binary, times binary, rids binary, parts binary"


def _ask(size: int, shards: int, hot):
    """The pairs of a task's texts, chunk by chunk: one row a shard with the pairs to score there and the places of their texts in the
    chunk, and one row with the texts themselves and the sums of those pairs that are in ``hot``. A chunk is named by its first text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys_hot, logs = hot.value
        names = [c.split()[0] for c in _ENTRIES.split(", ")]
        held: list[np.ndarray] = []
        rids: list[int] = []
        n = 0

        def given() -> Iterator[pd.DataFrame]:
            if not held:
                return
            both, times = np.unique(np.concatenate(held), return_counts=True)
            keys, place = both >> _IDX, both & ((1 << _IDX) - 1)
            own, sums = np.array(rids, dtype="<i8"), np.zeros(len(rids))
            if len(keys_hot):
                at = np.minimum(np.searchsorted(keys_hot, keys), len(keys_hot) - 1)
                met = keys_hot[at] == keys
                sums = np.bincount(place[met], weights=logs[at[met]] * times[met], minlength=len(own))
                keys, place, times = keys[~met], place[~met], times[~met]
            rows = [(int(_shards(own[:1], shards)[0]), rids[0], None, None, None, own.tobytes(), sums.astype("<f8").tobytes())]
            for s, at in _dealt(keys, shards) if len(keys) else ():
                rows.append((s, rids[0], _packed_sorted(keys[at]), _packed(place[at]), _packed(times[at]), None, None))
            yield pd.DataFrame(rows, columns=names)

        for p in batches:
            for rid, c in zip(p["rid"], p["codes"], strict=True):
                keys = _pairs(_codes(c), size)
                held.append(keys << _IDX | len(rids))
                rids.append(rid)
                n += len(keys)
                if n > _HELD:
                    yield from given()
                    held, rids, n = [], [], 0
        yield from given()

    return run


_ANSWERS = "chunk long, shard int, rids binary, places binary, parts binary"


def _answer(models):
    """Scores of the pairs asked for in one shard: for every chunk the sums of its texts, by their places in it."""

    def run(asked: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        known = [_unpacked_sorted(x) for x in pairs["keys"]]
        counts = [np.ones(len(k), dtype=np.int64) if c is None else _unpacked(c) for k, c in zip(known, pairs["counts"], strict=True)]
        keys = np.concatenate([*known, np.array([np.iinfo(np.int64).max])])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([*counts, [0]]).astype(np.int64)[order]
        rows = []
        for shard, chunk, packed, places, times, rids, parts in asked.itertuples(index=False):
            if rids is not None:
                rows.append((chunk, shard, rids, None, parts))
                continue
            wanted = _unpacked_sorted(packed)
            found, back = np.unique(wanted, return_inverse=True)
            at = np.searchsorted(keys, found)
            logs = np.log10(_averaged(models.value, found, np.where(keys[at] == found, counts[at], 0)))[back]
            sums = np.bincount(_unpacked(places), weights=logs * _unpacked(times))
            some = np.flatnonzero(sums)
            rows.append((chunk, shard, None, _packed_sorted(some), sums[some].astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWERS.split(", ")])

    return run


def _add_up(p: pd.DataFrame) -> pd.DataFrame:
    """(rid, part) of the texts of one chunk, added in the order of shards."""
    texts = p["rids"].notna()
    whole = p[texts].iloc[0]
    rids, total = np.frombuffer(whole["rids"], dtype="<i8"), np.frombuffer(whole["parts"], dtype="<f8").copy()
    for places, parts in p.loc[~texts].sort_values("shard")[["places", "parts"]].itertuples(index=False):
        total[_unpacked_sorted(places)] += np.frombuffer(parts, dtype="<f8")
    return pd.DataFrame({"rid": rids, "part": total})


def _rest_scores(words: DataFrame, voc: Vocabulary, least: int) -> tuple[DataFrame, float]:
    """(word, c, log10 probability within the words without a dish), and that of a word never seen."""
    rest = words.where((F.col("c") < least) | (F.length("word") > LONGEST_WORD))
    slots, customers = voc.rest_words + 1, float(voc.counts[REST])

    def seated(total: float):
        @F.pandas_udf("double")
        def run(word_hash: pd.Series, c: pd.Series) -> pd.Series:
            mass = np.full(len(c), (CONCENTRATION + DISCOUNT * total) / slots)
            return pd.Series(tables(c.to_numpy(np.int64), mass, word_hash.to_numpy(np.int64).astype(np.uint64), 2000))

        return run(F.xxhash64("word"), "c")

    t = float(voc.rest_words)
    for _ in range(2):
        t = round(rest.agg(F.sum(seated(t)).alias("t")).first()["t"] or 0.0, 6)
    share = (CONCENTRATION + DISCOUNT * t) / slots
    p = (F.col("c") - F.lit(DISCOUNT) * F.col("t") + F.lit(share)) / F.lit(CONCENTRATION + customers)
    scored = rest.withColumn("t", seated(t)).select("word", "c", F.log10(p).alias("log_p"))
    return scored, float(np.log10(share / (CONCENTRATION + customers)))


def held_out(id_col: str):
    """Whether a text is never learnt from: crc32 of the id as text is divisible by ten; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def with_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dishes: int = DISHES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the log10 probability of the words of a text and its end. Everything that is counted is counted over all texts
    whose id does not hold them out (rows without an id are learnt from). Null and empty texts are an end alone; repeated rows are
    learnt from and scored as often as they stand, those of one id each by its own text; texts of any length are read whole. An
    empty table gives an empty result; with no text to learn from every word is unseen. Other columns play no part.
    """
    if not 2 < dishes <= DISHES:
        raise ValueError(f"dishes must lie between 3 and {DISHES}")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), utf8(text_col).alias("text"))
    train = texts.where("NOT held_out")
    words = train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    words = materialize(words, "words")
    voc, least = _vocabulary(words, train.count(), dishes)
    vocabulary = spark.sparkContext.broadcast(voc)

    kind = texts.schema["id"].dataType.simpleString()
    numbered = texts.select("id", "held_out", F.monotonically_increasing_id().alias("rid"), "text")
    coded = materialize(numbered.mapInArrow(_coded(vocabulary), f"id {kind}, held_out boolean, rid long, {_CODED}"), "coded")

    shards = max(_SHARDS, 1 + voc.n_tokens // _SHARD)
    counted = coded.where("NOT held_out").select("codes").mapInPandas(_count_pairs(voc.size, shards), _PAIRS)
    pairs = materialize(counted.groupBy("shard").applyInPandas(_merge_pairs, _PAIRS), "pairs")
    models = _sampled(pairs, voc)
    keys, counts = _hot_pairs(pairs, HOT)
    hot = spark.sparkContext.broadcast((keys, np.log10(_averaged(models, keys, counts))))
    shared = spark.sparkContext.broadcast(models)
    asked = coded.select("rid", "codes").mapInPandas(_ask(voc.size, shards, hot), _ENTRIES)
    told = asked.groupBy("shard").cogroup(pairs.groupBy("shard")).applyInPandas(_answer(shared), _ANSWERS)
    parts = told.groupBy("chunk").applyInPandas(_add_up, "rid long, part double")

    scored, unseen = _rest_scores(words, voc, least)
    rare = coded.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(scored, "word", "left")
    base = F.log10((F.coalesce("c", F.lit(0)) + F.lit(ADDED)) / F.lit(voc.n_tokens + ADDED * (voc.n_distinct + 1)))
    rest = met.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * base).alias("more"),
        F.sum(F.col("times") * F.coalesce("log_p", F.lit(unseen))).alias("within"),
    )
    rows = coded.select("id", "held_out", "rid", "n_tokens", "n_known", "base").join(parts, "rid", "left").join(rest, "rid", "left")
    none = F.lit(0.0)
    return rows.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(voc.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"),
        (F.coalesce("part", none) + F.coalesce("within", none)).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, base, model): perplexities of held-out and learnt text."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per_token("base_score").alias("base"), per_token("score").alias("model"))
