"""Suffix-automaton decontamination against brute force."""

from __future__ import annotations

import random
import re

from quarry.llm import decontaminate as dc


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(words, items, window):
    hit, found = set(), set()
    for name, seq in items:
        n = min(len(seq), window)
        for k in range(len(seq) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == seq[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return hit, found


def test_automaton_equals_brute_force_on_few_letters():
    rng = random.Random(3)
    for _ in range(300):
        window = rng.choice([2, 3, 5])
        items = [(str(k), rng.choices([b"a", b"b", b"c"], k=rng.randrange(9))) for k in range(rng.randrange(5))]
        doc = rng.choices([b"a", b"b", b"c", b"x"], weights=[4, 4, 4, 1], k=rng.randrange(60))
        spans, found, longest = dc.Automaton(items, window).scan(doc)
        hit, want = slow(doc, items, window)
        assert {p for a, b in spans for p in range(a, b)} == hit
        assert found == want
        runs = [k for _, s in items for i in range(len(s)) for j in range(i, len(s)) for k in [j - i + 1] if any(doc[p : p + k] == s[i : j + 1] for p in range(len(doc)))]
        assert longest == max(runs, default=0)


def tables(spark):
    long = " ".join(f"w{i}" for i in range(14))
    items = spark.createDataFrame([("i1", long, 1), ("i2", "Short Item", 2), ("i3", None, 3), ("i4", "", 4), (None, "lost words here", 5), ("i2", "Short Item", 2)], "item_id string, text string, contamination int")
    docs = spark.createDataFrame(
        [(1, "x " * 30 + long + " y" * 30, "k"), (2, "a short, ITEM ends b c d", None), (3, None, "n"), (4, "", "e"), (4, "", "e"), (None, "w1 w2 w3", "u"), (5, long, "all"), (6, "short " + long + " item and much of other text follows here so that this one stays in the table", "nested"), (7, "z " * 300_000 + "short item", "long")],
        "doc_id long, text string, contamination string",
    )
    return docs, items


def test_spans_items_and_corner_cases(spark):
    docs, items = tables(spark)
    one = {(r.doc_id, r.contamination.n_words, tuple(map(tuple, r.contamination.spans)), tuple(r.contamination["items"])) for r in dc.with_contamination(docs, items).collect()}
    assert (1, 74, ((30, 44),), ("i1",)) in one and (2, 7, ((1, 3),), ("i2",)) in one
    assert {(3, 0, (), ()), (4, 0, (), ()), (None, 3, (), ()), (7, 300_002, ((300_000, 300_002),), ("i2",))} <= one
    many = dc.with_contamination(docs, items, block_bytes=20)
    assert {(r.doc_id, r.h, tuple(r.i)) for r in many.select("doc_id", dc.hit_words("contamination.spans").alias("h"), "contamination.items").toDF("doc_id", "h", "i").collect()} == {
        (d, sum(b - a for a, b in s), i) for d, _, s, i in one
    }
    assert dc.with_contamination(docs, items.limit(0)).where("size(contamination.items) > 0").count() == 0
    assert dc.with_contamination(docs.limit(0), items).count() == 0


def test_cuts_leave_clean_texts_alone_and_no_window_behind(spark):
    docs, items = tables(spark)
    for block in (20, 1 << 20):
        out = dc.decontaminate(docs, items, block_bytes=block)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert set(got) == {1, 2, 3, 4, None, 6, 7}
        assert got[2] == "a  ends b c d" and got[None] == "w1 w2 w3" and got[3] is None
        seqs = [("i1", [f"w{i}" for i in range(14)]), ("i2", ["short", "item"])]
        assert not any(slow(words_of(t), seqs, 10)[0] for i, t in got.items() if i != 7)


def test_whole_table_equals_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = {}
    for r in items.collect():
        w = words_of(r.text)
        for k in range(max(1, len(w) - 9)):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(r.item_id))
    want = {}
    for r in docs.collect():
        w, hit, found = words_of(r.text), set(), set()
        for i in range(len(w) - 9):
            if names := grams.get(tuple(w[i : i + 10])):
                hit.update(range(i, i + 10))
                found |= names
        want[r.doc_id] = (len(w), len(hit), sorted(found))
    got = {r.doc_id: (r.n, r.h, list(r.i)) for r in dc.with_contamination(docs, items).selectExpr("doc_id", "contamination").select("doc_id", "contamination.n_words", dc.hit_words("contamination.spans"), "contamination.items").toDF("doc_id", "n", "h", "i").collect()}
    assert got == want and any(h for _, h, _ in want.values())


def test_blocks_of_items_decide_like_one(spark):
    items = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdefgh"]
    table = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    nested = items[0]
    for t in items[1:]:  # each item interrupted by the one before: one cut at a time brings the next together
        head, tail = t.split(" ", 6)[:6], t.split(" ", 6)[6]
        nested = " ".join(head) + " " + nested + " " + tail
    docs = spark.createDataFrame(
        [(1, " ".join(items) + " x" * 60, "spread"), (2, items[0] + " mid " + items[5] + " y" * 60, "cut"), (3, nested + " z" * 400, "nested"), (4, None, "n"), (5, " ".join(items[:2]) + " x" * 20, "two")],
        "doc_id long, text string, source string",
    )
    got = [{(r.doc_id, r.text, r.source) for r in dc.decontaminate(docs, table, block_bytes=size).collect()} for size in (1 << 20, 250, 60)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[1]} == {2, 3, 4}
    assert all("7" not in (r[1] or "") for r in got[1])


def test_any_column_names(spark):
    docs, items = tables(spark)
    named = docs.selectExpr("doc_id", "text", "contamination AS spans", "'c' AS cut", "'k' AS n", "'r' AS _row")
    for block in (20, 1 << 20):
        got = dc.decontaminate(named, items, block_bytes=block)
        assert got.columns == named.columns
        assert {(r.cut, r.n, r._row) for r in got.collect()} == {("c", "k", "r")} and got.count() == 8
