"""The pipeline's stages against plain Python, each on its own input."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm.decontaminate import WINDOW
from quarry.scratch import materialize
from tests.llm.test_decontaminate import words_of
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_near_copies import slow_components, slow_pairs, slow_set


def test_every_stage_does_its_work_on_all_that_came_before(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {"input": {r.doc_id: r for r in docs.collect()}}
    last = "input"
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        seen[name] = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(seen[name])
        assert out.columns == columns or name == cp.STAGES[-1][0]
        assert set(seen[name]) <= set(seen[last])
        docs, last = out, name

    for i, r in seen["toxicity"].items():
        assert r == seen["input"][i]
    assert len(seen["toxicity"]) < len(seen["input"])

    before = list(seen["toxicity"].values())
    kept = slow_lines([(r.source, r.text) for r in before], cp.LINE_RATIO, cp.LINE_PAGES)
    size = lambda lines: sum(map(len, lines))
    doubtful = [r for r, lines in zip(before, kept) if len(lines) < len(r.text.split("\n")) and size(lines) < (1 - cp.LINE_COPIED) * size(r.text.split("\n"))]
    gone = {r.doc_id: {x for x in set(r.text.split("\n")) - set(lines) if x} for r, lines in zip(before, kept)}
    alike = lambda a, b: sum(map(len, gone[a.doc_id] & gone[b.doc_id])) >= cp.LINE_COPIED * max(size(a.text.split("\n")), size(b.text.split("\n")))
    linked = {a.doc_id for a in doubtful for b in doubtful if a.doc_id != b.doc_id and (a.text == b.text or alike(a, b))}
    for r, lines in zip(before, kept):
        text = r.text if r.doc_id in linked else "\n".join(lines)
        assert seen["line_dedup"][r.doc_id].text == text and seen["line_dedup"][r.doc_id].n_chars == len(text)

    sets = {i: slow_set(r.text) for i, r in seen["line_dedup"].items()}
    assert set(seen["near_duplicates"]) == set(slow_components(sets, slow_pairs(sets)).values())

    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[k : k + WINDOW]) for k in range(max(1, len(w) - WINDOW + 1)) if w}
    for i, r in seen["near_duplicates"].items():
        w = words_of(r.text)
        hit = {p for k in range(len(w)) if tuple(w[k : k + WINDOW]) in windows for p in range(k, k + WINDOW)}
        assert (i in seen["decontamination"]) == (len(hit) <= 0.5 * len(w))
        if i in seen["decontamination"]:
            now = words_of(seen["decontamination"][i].text)
            assert not any(tuple(now[k : k + WINDOW]) in windows for k in range(len(now)))
            assert hit or seen["decontamination"][i] == r

    assert set(seen["mixing"]) == set(seen["decontamination"])
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(seen["mixing"])


def test_stages_take_any_rows_and_columns(spark):
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "word " * 50_000, None, "src0", 1), (None, "no id here at all", "en", None, 2)]
    docs = first.unionByName(spark.createDataFrame(odd, first.schema))
    names = ["drop", "phases", "kept_lines", "_row", "toxicity", "spans", "fp", "slot", "cut"]
    docs = docs.withColumns({c: F.lit(c) for c in names})
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert (out.columns == columns) if name != cp.STAGES[-1][0] else (out.columns[: len(columns)] == columns)
        kept = [c for c in names if name != "mixing" or c != "slot"]
        assert out.select(*kept).distinct().count() == 1
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = materialize(out, name) if name != cp.STAGES[-1][0] else docs
    texts = [r.text for r in docs.collect() if r.doc_id is None]
    assert "no id here at all" in texts and None in texts


def test_lines_go_unless_a_verified_copy_explains_them(spark):
    words = " ".join(f"w{k}" for k in range(60))
    footer = "\n".join(f"all rights of page {k} are reserved by its makers and theirs" for k in range(4))
    rows = [(i, f"{words} copy\n{footer}", "s") for i in range(12)]  # near and exact copies
    rows += [(100 + i, f"page {i}\n{footer}", "s") for i in range(30)]  # mostly footer; no two are alike once it is gone
    rows += [(200, None, "s"), (201, "", "s"), (202, footer, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in cp.drop_lines(spark, docs, "").collect()}
    assert len(got) == len(rows) and got[0] == rows[0][1] and got[200] is None and got[201] == "" and got[202] == footer
    # the pages are near copies of one another by their footers, so the next stage settles them
    assert got[100] == rows[12][1]
    one = [(300, footer, "s")] + [(i, "\n".join([line, *[f"text {i} {k} of its own with many other words" for k in range(9)]]), "s") for i, line in enumerate(footer.split("\n") * 10)]
    docs = spark.createDataFrame(one, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in cp.drop_lines(spark, docs, "").collect()}
    assert got[300] == "" and all(footer.split("\n")[0] not in t for t in got.values())
