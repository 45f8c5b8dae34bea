"""Site-relative line frequency against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import line_dedup as ld


def slow(rows, ratio, least):
    """rows: [(host, text)] -> kept lines of each row."""
    pages, having = Counter(), defaultdict(Counter)
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    for host, text in rows:
        if host is not None:
            pages[host] += 1
            having[host].update({trim(x) for x in (text or "").split("\n") if trim(x)} if text is not None else ())
    gone = {h: {k for k, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in having.items()}
    return [None if t is None else [x for x in t.split("\n") if trim(x) not in gone.get(h, ())] for h, t in rows]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    lines = [" a", "a", "b\t", "c", "", " ", "d e", "é", "f"]
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([None, "", *["\n".join(rng.choices(lines, k=rng.randrange(1, 5))) for _ in range(9)]])) for _ in range(150)]
    table = spark.createDataFrame([(i, h, t, "drop") for i, (h, t) in enumerate(rows)], "i int, host string, text string, drop string")
    for ratio, least in ((0.2, 3), (0.5, 1), (0.0, 40)):
        got = ld.drop_boilerplate(table, "host", ld.text_lines("text"), ratio, least)
        want = slow(rows, ratio, least)
        for r in got.collect():
            assert r.kept_lines == want[r.i] and r.drop == "drop"
            assert r.n_dropped == (0 if r.text is None else len(r.text.split("\n")) - len(want[r.i]))


def test_pages_that_are_mostly_repeated_can_stay_whole(spark):
    rows = [("h", "same line here\nalso the same line\nx%d" % i) for i in range(5)] + [("h", "same line here\n" + "own words " * 9 + str(i)) for i in range(5)]
    table = spark.createDataFrame(rows, "host string, text string")
    got = ld.drop_boilerplate(table, "host", ld.text_lines("text"), 0.3, 3, whole_above=0.5).orderBy("text")
    assert sorted(r.n_dropped for r in got.collect()) == [0] * 5 + [1] * 5


def test_corner_cases(spark):
    table = spark.createDataFrame([("h", None), (None, "a"), ("h", ""), ("h", "z\n" * 50_000)], "host string, text string")
    got = ld.drop_boilerplate(table, "host", ld.text_lines("text"), 0.0, 1).collect()
    assert sorted((r.n_lines, r.n_dropped) for r in got) == [(0, 0), (0, 0), (1, 0), (50_000, 50_000)]
    assert ld.drop_boilerplate(table.limit(0), "host", ld.text_lines("text")).count() == 0


def test_visible_lines(spark):
    html = "<html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';x</script></head><body><!-- no --><p>one <b>two</b>\t three<br>four<a href='/x'>five</a></p></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(ld.visible_lines("h")).first()
    assert row[0] == ["T & t", "one two three", "fourfive"]
    assert spark.range(1).select(ld.visible_lines(F.lit(None).cast("string"))).first()[0] is None


def test_any_column_names(spark):
    rows = [("h", f"same line\nown {i}", "g", "l", "r", "k") for i in range(6)]
    table = spark.createDataFrame(rows, "host string, text string, gone string, lines string, _row string, kept_lines string")
    got = ld.drop_boilerplate(table, "host", ld.text_lines("text"))
    assert got.columns == [*table.columns, "n_lines", "n_dropped"]
    assert all((r.host, r.gone, r.lines, r._row, r.n_dropped) == ("h", "g", "l", "r", 1) for r in got.collect())
