"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are taken in blocks of bounded size; their words are broadcast and every worker builds the automaton of a block once.
Documents stream through it word by word, each step keeping the longest match that ends there. Where that match reaches
the window length, or ends with a whole shorter item, the words of the window are hit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.tokens import alnum_words, packed, small_batches, unpacked, utf8
from quarry.scratch import materialize

WINDOW = 10
BLOCK_BYTES = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """Suffix automaton over the word sequences of many items; states are ints, 0 is the root."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab, self.link, self.length = window, {}, [-1], [0]
        self._children: list[dict[int, int]] = [{}]
        items = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items]
        for _, seq in items:
            at = 0
            for c in seq:
                at = self._extend(at, c)
        self.wide = len(self.vocab) + 1
        self.step = {s * self.wide + c: t for s, kids in enumerate(self._children) for c, t in kids.items()}
        del self._children
        self._mark(items)

    def _new(self, length: int, link: int, kids: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._children.append(kids)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        kids = self._children
        if c not in kids[last]:
            cur = self._new(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in kids[p]:
                kids[p][c] = cur
                p = self.link[p]
            if p >= 0:
                self.link[cur] = self._exact(p, c)
            return cur
        return self._exact(last, c)

    def _exact(self, p: int, c: int) -> int:
        """The state of exactly (longest string of p) + c, split off its class if that holds longer strings."""
        kids = self._children
        q = kids[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(kids[q]))
        self.link[q] = clone
        while p >= 0 and kids[p].get(c) == q:
            kids[p][c] = clone
            p = self.link[p]
        return clone

    def _mark(self, items: list[tuple[str, list[int]]]) -> None:
        """windows: state -> items with that window; whole: state -> (words, item) of items shorter than a window."""
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, seq in items:
            at = 0
            for n, c in enumerate(seq, 1):
                at = self.step[at * self.wide + c]
                if n >= self.window:
                    self.windows.setdefault(self.of_window(at), set()).add(name)
            if 0 < len(seq) < self.window:
                self.whole.setdefault(at, []).append((len(seq), name))
        self.ends = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.whole else self.ends[self.link[s]]

    def of_window(self, state: int) -> int:
        """The suffix state that holds the last ``window`` words matched."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(merged hit spans as [start, end) word positions, items with an occurring window, longest match)."""
        step, wide, link, length, ends, window = self.step.get, self.wide, self.link, self.length, self.ends, self.window
        found: set[str] = set()
        hits: list[tuple[int, int]] = []
        state = size = longest = 0
        for at, c in enumerate(map(self.vocab.get, words), 1):
            if c is None:
                state = size = 0
                continue
            to = step(state * wide + c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = step(state * wide + c)
            if to is None:
                continue
            state, size = to, size + 1
            if size > longest:
                longest = size
            if size >= window:
                hits.append((at - window, at))
                found |= self.windows.get(self.of_window(state), set())
            end = ends[state]
            while end:
                for n, name in self.whole[end]:
                    if n <= size:
                        hits.append((at - n, at))
                        found.add(name)
                end = ends[link[end]]
        return merge(hits), found, longest


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.IntegerType()),
    ]
)


class Items:
    """The items of one block. What is broadcast are their words; each Python worker builds the automaton once, at first use."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self._items, self._window, self._automaton = items, window, None

    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(self._items, self._window)
        return self._automaton

    def __reduce__(self):
        return Items, (self._items, self._window)


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Callable[[int], Broadcast]]:
    """The number of blocks of about ``block_bytes``, and what broadcasts one; items without an id or words are no items."""
    spark = items.sparkSession
    named = items.select(F.col(id_col).cast("string").alias("id"), utf8(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def send(k: int) -> Broadcast:
        part = named if blocks == 1 else named.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        return spark.sparkContext.broadcast(Items([(r.id, alnum_words(bytes(r.text))) for r in part.toLocalIterator()], window))

    return blocks, send


def _scanner(shared: Broadcast):
    @F.pandas_udf(_FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        automaton, rows = shared.value.automaton(), []
        for text in texts:
            words = alnum_words(text)
            spans, found, longest = automaton.scan(words)
            rows.append((len(words), spans, sorted(found), longest))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items", "longest"])

    return scan.asNondeterministic()  # so that no filter above makes it run twice


def with_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` plus column ``contamination``: n_words, spans ([start, end) in words, ascending, possibly overlapping when
    the items fill several blocks), items (ids whose windows occur, sorted) and longest (longest matching run of words).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A window is ``window`` consecutive
    words of an item; a shorter item is one window. Null and empty texts have no words and no hits; empty items tables
    give no hits; repeated items count by id, repeated rows are found alike; texts of any length are read whole. A column
    named ``contamination`` in ``docs`` is replaced. With several blocks of items the documents are read once for each,
    so no worker ever holds more than one block's automaton.
    """
    small_batches(docs.sparkSession)
    blocks, send = _blocks(items, item_id, item_text, window, block_bytes)
    if blocks == 1:
        return docs.withColumn("contamination", _scanner(send(0))(utf8(text_col)))
    rows = materialize(docs.select(packed(docs), F.expr("uuid()").alias("n"), utf8(text_col).alias("text")), "numbered")
    parts = []
    for k in range(blocks):
        shared = send(k)
        found = rows.select("n", _scanner(shared)("text").alias("c")).select("n", "c.*")
        parts.append(materialize(found if k == 0 else found.where("longest > 0"), "hits"))
        shared.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("n").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    found = F.struct(*[F.col(c) for c in ("n_words", "spans", "items", "longest")])
    return unpacked(rows.join(every, "n"), docs.columns, {"contamination": found})


def hit_words(spans: str | Column) -> Column:
    """Number of words covered by ascending [start, end) spans that may overlap."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x[1] - F.greatest(s["to"], x[0]))).alias("n"), F.greatest(s["to"], x[1]).alias("to")
        ),
        lambda s: s["n"],
    )


def _without(text: bytes, spans: Iterable[tuple[int, int]]) -> bytes:
    """The text without the words of the spans."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    for a, b in reversed(merge(spans)):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text


@F.pandas_udf(T.BinaryType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or not len(s) else _without(t, [tuple(x) for x in s]) for t, s in zip(texts, spans)])


def _settled(text: bytes, spans: list[tuple[int, int]], automaton: Automaton) -> bytes:
    """The text without hit spans. A cut can bring an item together that was interrupted, so it repeats until none is left."""
    while spans:
        text = _without(text, spans)
        spans, _, _ = automaton.scan(alnum_words(text))
    return text


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with its own columns: hit spans cut out of the text; a document of which more than ``max_coverage`` of the
    words are hit is removed. Documents without a hit, null and empty ones too, stay byte for byte; rows that repeat are
    treated alike; an empty table gives an empty result; other columns may have any name.

    The coverage is that of the spans of all blocks of items on the text as it came; their union is cut, and again in what
    is left, until no block reports a hit."""
    blocks, send = _blocks(items, item_id, item_text, window, block_bytes)
    small_batches(docs.sparkSession)
    if blocks > 1:
        return _by_rounds(docs, items, text_col, max_coverage, item_id, item_text, window, block_bytes)
    kept = T.StructType([T.StructField("keep", T.BooleanType()), T.StructField("text", T.BinaryType())])
    one = send(0)

    @F.pandas_udf(kept)
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows, automaton = [], one.value.automaton()
        for text in texts:
            words = alnum_words(text)
            spans, _, _ = automaton.scan(words)
            hit = sum(b - a for a, b in spans)
            rows.append((hit <= max_coverage * len(words), _settled(text, spans, automaton) if hit else text))
        return pd.DataFrame(rows, columns=["keep", "text"])

    out = docs.select(packed(docs), cut.asNondeterministic()(utf8(text_col)).alias("cut")).where("cut.keep")
    return unpacked(out, docs.columns, {text_col: F.col("cut.text").cast("string")})


def _by_rounds(docs: DataFrame, items: DataFrame, text_col: str, max_coverage: float, *how) -> DataFrame:
    """Round by round over all blocks; documents without a hit leave. Every further round cuts words, so the rounds end."""
    done, first = [], True
    now = docs.select(packed(docs), F.col(text_col).cast("string").alias("text"))
    while True:
        now = materialize(with_contamination(now, items, "text", *how).select("_row", "text", "contamination.n_words", "contamination.spans"), "round")
        done.append(now.where("size(spans) = 0").select("_row", "text"))
        now = now.where("size(spans) > 0")
        if first:
            now = now.where(hit_words("spans") <= F.lit(max_coverage) * F.col("n_words"))
        if now.isEmpty():
            return unpacked(reduce(DataFrame.unionByName, done), docs.columns, {text_col: F.col("text")})
        first, now = False, now.select("_row", _cut(F.col("text").cast("binary"), "spans").cast("string").alias("text"))
