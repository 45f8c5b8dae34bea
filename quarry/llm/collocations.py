"""Phrase collocations by best-first branch-and-bound growth.

The score of a phrase is the least, over its cuts in two, of 2,000,000 a / (l + r): a, l and r count the phrase and its two
parts. Any phrase that begins with the prefix p occurs at most f(p) times, its first word f(w) times and what follows that word
at least as often as the phrase, so no phrase below p scores above

    bound(p) = floor(2,000,000 f(p) / (f(w) + f(p))).

Words and pairs are counted in full. Longer phrases grow only from prefixes whose bound reaches a threshold of their language,
best first: the threshold starts at the score of a candidate some way beyond the wanted rank and falls until that many
candidates at or above it are known to survive. A candidate at or above the threshold has a bound at or above it, so both what
extends it to the right (by growth from it) and what extends it to the left (by growth towards it) is counted, and its survival
is settled.

Counts are summed in every task before they are dealt out. Texts are read three times: for the words; for the hashes of pairs
of frequent words, of which those that occur often enough are kept; and for the stretches of words in which every pair has such a
hash, from which phrases are counted by their words. The tests look into hash maps of a fixed number of bits, so what is broadcast
does not grow with the text. A hash that says yes by chance costs rows, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.bitmaps import MASK, bitmap, holds, low_bits
from quarry.llm.tokens import small_batches, utf8
from quarry.scratch import materialize

LEAST_COUNT = 30
LONGEST = 4
WANTED = 2000
SCALE = 2_000_000
#: A candidate goes when a longer one around it has at least this many hundredths of its count.
COVERED = 80
NO_LANGUAGE = "und"

_PIECES = b".,;:!?\x0a\x0b\x0c\x0d"
_CUT = 0xFF  # no byte of UTF-8
_TABLE = bytes(_CUT if c in _PIECES else c for c in range(256))
#: Rows that a task holds before it passes counts on, and rows of one batch that it passes on.
_HELD, _PASSED = 1 << 20, 1 << 16
#: Bytes of stretches that a task counts at once, and those it holds (with 100 for each stretch).
_CHUNK, _HELD_BYTES = 1 << 22, 1 << 26
#: Words of text a shard of pairs.
_SHARD = 1 << 20


def piece_words(text: bytes) -> list[bytes]:
    """Words in order, with the byte 0xFF between pieces."""
    return text.lower().translate(_TABLE).replace(b"\xff", b" \xff ").split()


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\x00" + word, 42)


class _Words:
    """Words of one language in a task: a number for each, and its hash. Number 0 stands for everything that cannot be frequent
    and for the end of a piece."""

    def __init__(self, lang: str, frequent: np.ndarray | None):
        self.lang, self.frequent = lang, frequent
        self.numbers: dict[bytes, int] = {b"\xff": 0}
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h = _hash(self.lang, word)
        at = h & MASK
        number = 0
        if self.frequent is None or self.frequent[at >> 3] >> (at & 7) & 1:
            number = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self.numbers[word] = number
        return number

    def codes(self, text: bytes) -> np.ndarray:
        get, miss = self.numbers.get, self.__missing__
        out = [miss(w) if (n := get(w)) is None else n for w in piece_words(text)]
        return np.array(out + [0], dtype=np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, batch by batch."""
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text or b"")
        yield by


_COUNTS = "lang string, phrase binary, n long"


def _rows(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    """What a task holds by language, in batches; nothing is held any more after them."""
    while held:
        lang, counts = held.popitem()
        left = iter(counts.items())
        while some := list(islice(left, _PASSED)):
            phrases, n = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter[bytes]] = {}
    for by in _texts(batches):
        for lang, texts in by.items():
            mine = held.setdefault(lang, Counter())
            for text in texts:
                mine.update(piece_words(text))
            mine.pop(b"\xff", None)
        if sum(map(len, held.values())) > _HELD:
            yield from _rows(held)
    yield from _rows(held)


class _Numbers(dict):
    """A number for each word met; 0 is the break between stretches."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _phrases(size: int, heads, tails):
    """A task's counts of phrases of ``size`` words in stretches (lang, phrase, n): those whose first or last words but one may be in
    ``heads`` or ``tails`` (hash maps), or all of them where both are null. Phrases get numbers word by word within a chunk, so only
    distinct ones are looked at as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        asked: dict[tuple[str, bytes], int] = {}
        gathered: dict[str, tuple[list[bytes], list[int]]] = {}

        def may(lang: str, part: bytes) -> int:
            if (known := asked.get((lang, part))) is None:
                at = _hash(lang, part) & MASK
                known = asked[lang, part] = sum(2**i for i, bits in enumerate((heads, tails)) if bits is not None and bits.value[at >> 3] >> (at & 7) & 1)
            return known

        def count(lang: str, stretches: list[bytes], times: list[int]) -> int:
            """Add what has been gathered; the number of new phrases."""
            words = b" \xff ".join(stretches).split(b" ")
            numbers = _Numbers({b"\xff": 0})
            codes = np.array([numbers[w] for w in words] + [0], dtype=np.int64)
            breaks = codes == 0
            at = np.flatnonzero(~breaks)
            names = codes[at]
            for k in range(1, size):  # names has the phrases of k words, which begin at these places
                follows = codes[at + k] > 0
                if k == size - 1 and (heads or tails):
                    first = np.unique(names, return_index=True)[1] if k == 1 else start
                    flags = np.zeros(names.max(initial=0) + 1, dtype=np.uint8)
                    flags[names[first]] = [may(lang, b" ".join(words[i : i + k])) for i in at[first].tolist()]
                    placed = np.zeros(len(codes) + 1, dtype=np.uint8)
                    placed[at] = flags[names]
                    follows &= (placed[at] & 1 | placed[at + 1] & 2) > 0
                at = at[follows]
                _, start, names = np.unique(names[follows] * len(numbers) + codes[at + k], return_index=True, return_inverse=True)
            if not len(at):
                return 0
            n = np.bincount(names, weights=np.array(times)[(np.cumsum(breaks) - breaks)[at]]).astype(np.int64)
            counts = held.setdefault(lang, {})
            before = len(counts)
            for i, m in zip(at[start].tolist(), n.tolist(), strict=True):
                phrase = b" ".join(words[i : i + size])
                counts[phrase] = counts.get(phrase, 0) + m
            return len(counts) - before

        length = rows = 0
        for batch in batches:
            for lang, stretch, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                stretches, times = gathered.setdefault(lang, ([], []))
                stretches.append(stretch)
                times.append(n)
                length += len(stretch)
            if length > _CHUNK:
                rows += sum(count(lang, *x) for lang, x in gathered.items())
                gathered, length = {}, 0
                if len(asked) > _HELD // 4:
                    asked.clear()
                if rows > _HELD // 2:
                    yield from _rows(held)
                    rows = 0
        for lang, x in gathered.items():
            count(lang, *x)
        yield from _rows(held)

    return run


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits for two words in order, from their hashes."""
    x = (a >> np.uint64(7) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _adjacent(mine: _Words, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words in order, hash of each word with the next, whether both may be frequent)."""
    codes = np.concatenate([mine.codes(t) for t in texts])
    hashes = np.array(mine.hashes, dtype=np.uint64)[codes]
    return codes, _pair_hash(hashes[:-1], hashes[1:]), (codes[:-1] > 0) & (codes[1:] > 0)


_PAIRS = "shard int, hashes binary, counts binary"


def _count_pairs(frequent: np.ndarray, shards: int):
    """A task's counts of pairs of words that may both be frequent, by hash (of language and words): a row for each of ``shards``
    equal ranges of hashes."""
    edges = np.arange(1, shards, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = _merged(held, counts)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                columns = [pa.array([i for i, _, _ in some], pa.int32()), *(pa.array([x[a:b].tobytes() for _, a, b in some], pa.binary()) for x in (keys, n))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "hashes", "counts"])

        for by in _texts(batches):
            for lang, texts in by.items():
                mine = words.setdefault(lang, _Words(lang, frequent))
                _, pairs, both = _adjacent(mine, texts)
                held.append(pairs[both])
                counts.append(np.ones(len(held[-1]), dtype=np.int64))
                size += len(held[-1])
                if sum(len(w.numbers) for w in words.values()) > _HELD:
                    words.clear()
            if size > 2 * _HELD:
                keys, n = _merged(held, counts)
                held, counts, size = [keys], [n], len(keys)
                if size > _HELD:
                    yield from given()
                    held, counts, size = [], [], 0
        yield from given()

    return run


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every)
    every, n = every[order], n[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, dtype=np.int64)
    return every[first], np.add.reduceat(n, first) if len(every) else n


def _frequent_pairs(p: pd.DataFrame) -> pd.DataFrame:
    """The hashes of one range that occur often enough."""
    keys, n = _merged([np.frombuffer(x, dtype=np.uint64) for x in p["hashes"]], [np.frombuffer(x, dtype=np.int64) for x in p["counts"]])
    return pd.DataFrame({"h": keys[n >= LEAST_COUNT].view(np.int64)})


def _stretches(frequent: np.ndarray, pairs: np.ndarray):
    """A task's distinct stretches of two or more words in which every pair may be frequent, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        held: dict[str, dict[bytes, int]] = {}
        size = 0
        for by in _texts(batches):
            for lang, texts in by.items():
                mine = words.setdefault(lang, _Words(lang, frequent))
                codes, found, both = _adjacent(mine, texts)
                good = both & holds(pairs, found & np.uint64(MASK))
                edge = np.diff(np.r_[0, good.astype(np.int8), 0])
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
                names, counts = mine.words, held.setdefault(lang, {})
                for i, j in zip(first.tolist(), last.tolist(), strict=True):
                    stretch = b" ".join([names[c] for c in codes[i:j].tolist()])
                    seen = counts.get(stretch, 0)
                    counts[stretch] = seen + 1
                    size += 0 if seen else len(stretch) + 100
                if sum(len(w.numbers) for w in words.values()) > _HELD:
                    words.clear()
            if size > _HELD_BYTES:
                yield from _rows(held)
                size = 0
        yield from _rows(held)

    return run


def _spark_hash(word: str | Column) -> Column:
    return F.xxhash64(F.concat("lang", F.lit("\x00"), word))


def _score(a: str, parts: Column) -> Column:
    """floor(2,000,000 a / parts), exact beyond 64 bits."""
    wide = F.lit(SCALE).cast("decimal(38,0)") * F.col(a).cast("decimal(19,0)")
    return F.call_function("div", wide.cast("decimal(38,0)"), parts.cast("decimal(38,0)")).cast("long")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST_COUNT)


def _first(phrase: str, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


class _Growth:
    """What has been counted so far: words, pairs and the phrases grown from expanded prefixes."""

    def __init__(self, texts: DataFrame):
        spark = self.spark = texts.sparkSession
        counted = texts.mapInArrow(_count_words, _COUNTS).withColumn("phrase", F.col("phrase").cast("string"))
        words = materialize(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "words")
        self.totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        self.words = words.where(F.col("f") >= LEAST_COUNT)
        frequent = spark.sparkContext.broadcast(bitmap(self.words.select(low_bits(_spark_hash("phrase")))))
        shards = 1 + (self.totals.agg(F.sum("n").alias("n")).first()["n"] or 0) // _SHARD
        hashed = texts.mapInArrow(lambda b: _count_pairs(frequent.value, shards)(b), _PAIRS).groupBy("shard").applyInPandas(_frequent_pairs, "h long")
        pairs = spark.sparkContext.broadcast(bitmap(hashed.select(low_bits(F.col("h")))))
        found = texts.mapInArrow(lambda b: _stretches(frequent.value, pairs.value)(b), _COUNTS).withColumn("phrase", F.col("phrase").cast("string"))
        self.stretches = materialize(found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "stretches")
        self.counts = {1: self.words, 2: materialize(self._counted(2, None, None), "pairs")}
        self.known: DataFrame = self._scored(self.counts[2], 2)

    def _scored(self, phrases: DataFrame, size: int) -> DataFrame:
        """(lang, phrase, f, first, l, r, score, size) of phrases whose parts are all counted."""
        out = phrases
        for k in range(1, size):
            left = self.counts[k].select("lang", F.col("phrase").alias(f"p{k}"), F.col("f").alias(f"l{k}"))
            right = self.counts[size - k].select("lang", F.col("phrase").alias(f"s{k}"), F.col("f").alias(f"r{k}"))
            out = out.withColumn(f"p{k}", _first("phrase", k)).withColumn(f"s{k}", _first("phrase", k - size))
            out = out.join(left, ["lang", f"p{k}"]).join(right, ["lang", f"s{k}"])
        cuts = [F.struct(_score("f", F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), f"l{k}", f"r{k}") for k in range(1, size)]
        best = F.least(*[c.cast("struct<score:bigint,k:int,l:bigint,r:bigint>") for c in cuts]) if size > 2 else cuts[0].cast("struct<score:bigint,k:int,l:bigint,r:bigint>")
        out = out.withColumn("best", best)
        return out.select("lang", "phrase", "f", F.col("l1").alias("first"), "best.l", "best.r", "best.score", F.lit(size).alias("size"))

    def grow(self, threshold: DataFrame) -> None:
        """Count all phrases of three and more words that begin with a prefix whose bound reaches the threshold of its language, or
        end with a candidate that reaches it; ``threshold``: (lang, least)."""
        known = self.known.where("size = 2")
        for size in range(3, LONGEST + 1):
            below = known.join(threshold, "lang")
            bound = _score("f", F.col("first") + F.col("f"))
            heads = below.where(bound >= F.col("least")).select("lang", "phrase")
            tails = below.where(F.col("score") >= F.col("least")).select("lang", "phrase")
            grown = self.counts[size] = materialize(self._counted(size, heads, tails), "grown")
            if size > 3:  # the parts of a longer phrase are counted whether or not they have grown themselves
                parts = grown.select("lang", F.explode(F.array(_first("phrase", 1 - size), _first("phrase", size - 1))).alias("phrase")).distinct()
                missing = materialize(parts.join(self.counts[size - 1], ["lang", "phrase"], "left_anti"), "missing")
                if not missing.isEmpty():
                    # a phrase is counted if its own first words are asked for; which ones are wanted is settled by the join
                    more = self._counted(size - 1, missing.select("lang", _first("phrase", size - 2).alias("phrase")), None)
                    more = more.join(missing, ["lang", "phrase"], "left_semi")
                    self.counts[size - 1] = materialize(self.counts[size - 1].unionByName(more), "parts")
            known = materialize(self._scored(grown, size), "scored")
            self.known = self.known.where(F.col("size") < size).unionByName(known)

    def _counted(self, size: int, heads: DataFrame | None, tails: DataFrame | None) -> DataFrame:
        """(lang, phrase, f) of frequent phrases of ``size`` words that begin with one of ``heads`` or end with one of ``tails``
        (lang, phrase), and by chance of others; of all phrases without either."""
        shared = [None if x is None else self.spark.sparkContext.broadcast(bitmap(x.select(low_bits(_spark_hash("phrase"))))) for x in (heads, tails)]
        rows = self.stretches.select("lang", F.col("phrase").cast("binary").alias("phrase"), "n")
        counted = rows.mapInArrow(_phrases(size, *shared), _COUNTS).withColumn("phrase", F.col("phrase").cast("string"))
        return _summed(counted)


def _survivors(known: DataFrame, threshold: DataFrame) -> DataFrame:
    """The candidates that reach the threshold and lie in no longer candidate with nearly their count. A longer candidate around
    one holds one that is longer by a single word and at least as frequent, so only those are looked at."""
    able = known.join(threshold, "lang").where(F.col("score") >= F.col("least")).drop("least")
    longer = known.where("size > 2")
    parts = longer.select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return able.join(most, ["lang", "phrase"], "left").where((F.col("most").isNull()) | (F.lit(100) * F.col("most") < F.lit(COVERED) * F.col("f"))).drop("most")


def _place(known: DataFrame, place: int) -> DataFrame:
    """(lang, least): the score of the candidate at this place of its language. Scores are whole numbers up to half of ``SCALE``,
    so the ordered table is bounded however many candidates there are."""
    levels = known.groupBy("lang", "score").agg(F.count("*").alias("m"))
    run = F.sum("m").over(W.partitionBy("lang").orderBy(F.desc("score")))
    return levels.withColumn("run", run).where(F.col("run") >= place).groupBy("lang").agg(F.max("score").alias("least"))


def _ranked(found: DataFrame, wanted: int, slices: int = 256) -> DataFrame:
    """The first rows of every language; first those of each slice by a hash of the phrase, so no task orders a whole language."""
    order = [F.desc("score"), F.desc("f"), "phrase"]
    part = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= wanted)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= wanted)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", wanted: int = WANTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``wanted`` phrases of two to four words of every language.

    Texts are cut into pieces at punctuation and line ends, pieces into words at spaces and tabs; A-Z is lower-cased. Candidates
    occur ``LEAST_COUNT`` times in a language; those within a longer candidate that has ``COVERED`` hundredths of their count are
    dropped. Order: score, then a, both descending, then the phrase by its bytes. A null language is ``und``; null and empty texts
    have no words; repeated rows count as often as they stand; texts of any length are read whole. An empty table, or one without
    a frequent phrase, gives an empty result. Other columns play no part.
    """
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    texts = docs.select(lang.alias("lang"), utf8(text_col).alias("text"))
    growth = _Growth(texts)
    langs = materialize(growth.counts[2].select("lang").distinct(), "langs")
    beyond = 2 * wanted
    while True:
        # with fewer candidates than ``beyond`` every prefix grows
        threshold = materialize(langs.join(_place(growth.known, beyond), "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least")), "threshold")
        growth.grow(threshold)
        known = materialize(growth.known, "known")
        found = materialize(_survivors(known, threshold), "survivors")
        settled = found.groupBy("lang").agg(F.count("*").alias("m"))
        open_ = threshold.where("least > 0").join(settled, "lang", "left").where(F.coalesce("m", F.lit(0)) < wanted)
        if open_.isEmpty():
            break
        beyond *= 4
    best = _ranked(found, wanted).join(growth.totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
