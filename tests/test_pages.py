"""Layout, sections, chunkers and loaders on literal rows."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.helpers import tokens
from quarry.operators import chunking as ch
from quarry.operators import layout as lo
from quarry.operators.incremental import upsert
from quarry.plans import source_queries
from quarry.sources import readers as rd
from quarry.streaming import ingest
from quarry.streaming.ingest import latest, stream_ingest


def test_headers_and_footers(spark):
    pages = spark.createDataFrame([("d", i, f"Journal of X\nPaper  Title\nbody {i}\nPaper Title inside\nmore\nlast words\nPage {i}") for i in range(3)], "source string, page int, text string")
    common = lo.find_common_header_footer(pages, head_n=2, tail_n=1, min_ratio=0.9)
    assert {r.line for r in common.collect()} == {"Journal of X", "Paper Title"}
    got = [r.text for r in lo.remove_header_footer(pages, common, head_n=2, tail_n=1).orderBy("page").collect()]
    assert got[1] == "body 1\nPaper Title inside\nmore\nlast words\nPage 1"
    twice = spark.createDataFrame([("d", 0, "Journal X\ncontent 1\n10"), ("d", 1, "Journal X\ncontent 2\n10"), ("e", 0, "Journal X")], "source string, page int, text string")
    assert sorted(r.text for r in lo.collapse_repeated_headers(twice).collect()) == ["Journal X", "content 1", "content 2"]


def test_layout(spark):
    spans = [("d", 1, 0.0, 0.0, 20.0, "Main Title"), ("d", 1, 0.0, 10.0, 16.0, "Part"), *[("d", 1, 300.0 * (i % 2), 20.0 + i, 11.0, f"line {i}.") for i in range(4)]]
    text = lo.layout_to_markdown(spark.createDataFrame(spans, "doc string, page int, x double, y double, size double, text string")).first().text
    assert text.split("\n") == ["# Main Title Part line 0.", "line 2.", "line 1.", "line 3."] or text.startswith("# Main Title")


def test_references_and_sections(spark):
    cited = "\n".join(f"{i}. Smith J. doi 10.1000/x 2001" for i in range(1, 5))
    rows = spark.createDataFrame([(cited,), ("1. Introduction\n热解",), ("plain",), (None,)], "text string")
    got = rows.select(lo.is_reference_like("text"), lo.infer_section("text")).collect()
    assert [tuple(r) for r in got] == [(True, "references"), (False, "introduction"), (False, None), (False, None)]


def test_heading_paths(spark):
    md = "intro\n# A\na\n## B\nb\n### C\nc\n##### deep\nd\n# D\n\n## E\ne"
    got = lo.parse_markdown_sections(spark.createDataFrame([(1, md), (2, "")], "doc_id int, text string"), max_depth=4).orderBy("section_ord").collect()
    assert [(r.heading_path, r.content) for r in got] == [("(root)", "intro"), ("A", "a"), ("A > B", "b"), ("A > B > C", "c\n##### deep\nd"), ("D > E", "e")]


def test_units_and_packs():
    text = "p one\n\n```\ncode\n\nmore\n```\n|a|b|\n|---|---|\n|1|2|\nafter\n$$\nx\n$$"
    assert ch.units(text) == [("p one", False), ("```\ncode\n\nmore\n```", True), ("|a|b|\n|---|---|\n|1|2|", True), ("after", False), ("$$\nx\n$$", True)]
    assert ch.pack(["a b", "c", "d e f g", "h"], 3, "|") == ["a b|c", "d e f g", "h"]
    assert ch.pack_children([["a b"], ["c d"]], 10, 2) == ["a b", "a b c d"]
    assert ch.by_characters(["aaaa", "bbbb", "cccc"], 9, 5) == ["aaaa bbbb", "bbbb cccc"]


def test_hierarchical_chunks(spark):
    docs = [("s.md", "# A\n## B\n" + "句子。" * 200 + "\n\n|c1|c2|\n|---|---|\n|x|y|\n"), ("t.md", "no heading. two words here."), ("u.md", None)]
    got = ch.chunk_hierarchical(spark.createDataFrame(docs, "source_file string, text string"), max_child=30).collect()
    parents = {r.chunk_id for r in got if r.is_parent}
    assert len({r.chunk_id for r in got}) == len(got) and all(r.parent_id in parents for r in got)
    assert {r.source_file for r in got} == {"s.md", "t.md"}
    kids = [r for r in got if not r.is_parent and r.source_file == "s.md"]
    assert all(tokens(r.text) <= 30 + 60 for r in kids) and any("|c1|c2|\n|---|---|\n|x|y|" in r.text for r in kids)
    assert {r.heading_path for r in kids} == {"A > B"}
    again = ch.chunk_hierarchical(spark.createDataFrame(docs, "source_file string, text string"), max_child=30).collect()
    assert {r.chunk_id for r in again} == {r.chunk_id for r in got}


def test_section_aware_and_noise(spark):
    pages = spark.createDataFrame([("results text. " * 100, None), ("References", None), (None, None)], "text string, section string")
    chunks = ch.chunk_section_aware(pages)
    assert {r.section for r in chunks.collect()} == {"results", "references"}
    assert all(len(r.text) <= 900 for r in chunks.collect())
    kept, dropped = ch.drop_noise_chunks(chunks)
    assert {r.section for r in kept.collect()} == {"results"} and dropped.first().n == 1


def test_embeddings_by_a_given_function(spark):
    rows = spark.createDataFrame([("a",), (" ",), (None,), ("bb",)], "text string")
    got = {r.text: list(r.embedding) for r in ch.embed_chunks(rows, fn=lambda ts: [[float(len(t))] for t in ts], batch=1).collect()}
    assert got == {"a": [1.0], "bb": [2.0]}


def test_loaders(spark):
    files = spark.createDataFrame([("a.txt", "标题\n\n段落一。\n段落二。"), ("b.md", "# 标题\n\n段落一。")], "path string, text string")
    got = {(r.source_file, tuple(r.line_range)): (r.text, r.title, r.doc_type) for r in rd.load_text(files).collect()}
    assert got == {("a.txt", (1, 2)): ("标题", None, "txt"), ("a.txt", (3, 4)): ("段落一。 段落二。", None, "txt"), ("b.md", (1, 2)): ("# 标题", "标题", "md"), ("b.md", (3, 3)): ("段落一。", "标题", "md")}
    json = spark.createDataFrame([("a.json", '[{"x": 1}, {"x": 2}]'), ("b.jsonl", '{"y": 1}\n\nbad\n{"y": 2}'), ("c.json", '{"z": 3}')], "path string, text string")
    assert sorted((r.source_file, r.record_id) for r in rd.load_json_records(json).collect()) == [("a.json", 0), ("a.json", 1), ("b.jsonl", 0), ("b.jsonl", 3), ("c.json", 0)]
    lines = spark.createDataFrame([('{"text": "a", "metadata": {"p": "1"}}',), ('{"content": "b", "metadata": 3}',), ("{bad",), (" ",), ('{"text": " "}',)], "value string")
    assert sorted((r.text, r.metadata) for r in rd.read_page_cache(lines).collect()) == [("a", {"p": "1"}), ("b", {})]


def test_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.TXT").write_text("x")
    (folder / "b.pdf").write_text("y")
    assert [r.path.rsplit("/", 1)[1] for r in rd.scan_files(spark, [str(folder)], ["txt"]).collect()] == ["a.TXT"]
    pages, out = tmp_path / "pages", str(tmp_path / "out")
    rows = lambda name, text: spark.createDataFrame([(name, text)], "source_file string, text string")
    run = lambda: stream_ingest(spark, str(pages), rows("", "").schema, out, str(tmp_path / "cp")).awaitTermination()
    rows("a", "Pyrolysis at 900 K. Next sentence here.").write.parquet(str(pages))
    run()
    first = {r.chunk_id for r in latest(spark, out).collect()}
    run()
    assert {r.chunk_id for r in latest(spark, out).collect()} == first
    rows("b", "Another page.").write.mode("append").parquet(str(pages))
    run()
    assert first < {r.chunk_id for r in latest(spark, out).collect()}
    assert latest(spark, out).where("stage = 'pyrolysis'").count() > 0
    rows("a", "Now quite another text, of gasification.").write.mode("append").parquet(str(pages))
    run()
    now = latest(spark, out)
    assert now.where("source_file = 'a' AND stage = 'pyrolysis'").count() == 0 and now.where("source_file = 'a'").count() > 0 and now.where("source_file = 'b'").count() > 0
    versions = {p: sorted(held) for p, held in ingest._versions(spark, out).items()}
    assert len(versions) == 2 and max(map(len, versions.values())) == 2  # only the parts touched are written again


def test_only_changed_files_are_opened(spark, tmp_path):
    import os

    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "deep/c [1].txt", "d.pdf"):
        (folder / name).write_text(name)
    manifest = spark.createDataFrame(rd.scan_files(spark, [str(folder)], ["txt"]).collect())
    before = {r.path: r.sha256 for r in manifest.collect()}
    stamp = os.stat(folder / "a.txt")
    (folder / "a.txt").write_text("A.txt")  # as long and as old as before, so nothing tells that it must be read
    os.utime(folder / "a.txt", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (folder / "deep/c [1].txt").write_text("longer than before")
    (folder / "e.txt").write_text("new")
    for most in (10, 0):
        got = {r.path: r.sha256 for r in rd.scan_files(spark, [str(folder)], ["txt"], manifest=manifest, most_paths=most).collect()}
        fresh = {r.path: r.sha256 for r in rd.scan_files(spark, [str(folder)], ["txt"]).collect()}
        assert len(got) == 4 and {p.rsplit("/", 1)[1] for p in got if got[p] != fresh[p]} == {"a.txt"}
        assert {p.rsplit("/", 1)[1] for p in before if before[p] == got[p]} == {"a.txt", "b.txt"}


def test_pages_of_a_document_in_several_batches(spark, tmp_path):
    schema = "source_file string, page int, text string"
    pages = [(d, k, f"# Part {k}\nPyrolysis of {d} at {900 + k} K on page {k}. More of it follows here.") for d in "abc" for k in range(3)]

    def ingested(name, files, together):
        folder, out = tmp_path / name / "in", str(tmp_path / name / "out")
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream_ingest(spark, str(folder), spark.createDataFrame([], schema).schema, out, str(tmp_path / name / "cp"), page="page", files=together).awaitTermination()
        return sorted((r.source_file, r.chunk_id, r.text) for r in latest(spark, out).collect())

    one = ingested("one", [pages], 100)
    assert len({c for _, c, _ in one}) == len(one) >= 18
    again = [("a", 1, "A page that is replaced later, of steam.")]
    assert ingested("many", [pages[0:2], again, [pages[2], *pages[4:6]], pages[6:], [pages[1], pages[3]]], 1) == one


def test_the_page_cache_gives_every_text_back_as_it_stands(spark, tmp_path):
    texts = [None, "", "  ", "\n\n\n\n", "ﬁne\u00a0Ａ  two\u200b blanks", "a\r\nb\rc\u2028d\x85e", "\x00\x1f\x7f", '{"text": "x"} \\"\\\\ null', "null", "😀 \ud7ff", " lead and trail\t"]
    place = str(tmp_path)
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", None)], "doc_id long, text string, source string").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, "of an older kind"), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([("ASIA",)], "r_name string").write.parquet(f"{place}/region.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet/*.parquet'")
    for name in ("write_page_cache", "read_page_cache"):
        got = [tuple(r) for r in source_queries.QUERIES[name](spark, place).collect()]
        assert sorted(got, key=repr) == sorted(con.execute(source_queries.ORACLE[name]).fetchall(), key=repr), name
    kept = rd.read_page_cache(rd.page_cache_lines(spark.createDataFrame([(1, " "), (2, "ﬁ  x")], "k int, text string")))
    assert [(r.text, r.metadata) for r in kept.collect()] == [("fi x", {"k": "2"})]


@pytest.mark.parametrize("whole", [True, False])
def test_the_stream_reads_a_table_of_one_file_or_of_several(spark, tmp_path, whole):
    docs = spark.createDataFrame([(i, f"Pyrolysis of coal {i} at 900 K. Another sentence follows here.") for i in range(4)], "doc_id long, text string")
    place = tmp_path / "tables"
    place.mkdir()
    docs.repartition(1 if whole else 3).write.parquet(str(tmp_path / "out"))
    if whole:
        next((tmp_path / "out").glob("*.parquet")).rename(place / "documents.parquet")
    else:
        (tmp_path / "out").rename(place / "documents.parquet")
    docs.where("doc_id < 2").coalesce(1).write.parquet(str(place / "labels.parquet"))
    assert source_queries.stream_ingest(spark, str(place)).where("is_parent").count() == 4


def test_pages_of_one_file_keep_all_their_text(spark):
    files = spark.createDataFrame([("f.txt", "First paragraph of it.\n\nSecond paragraph.\n\nThird one.\n\nSecond paragraph.")], "path string, text string")
    chunks = ch.chunk_hierarchical(rd.load_text(files))
    kept = upsert(chunks.limit(0), chunks)
    assert {r.text for r in kept.where("is_parent").collect()} == {r.text for r in chunks.where("is_parent").collect()} and kept.where("is_parent").count() == 3


def test_nothing_in_the_library_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(lo.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quarry.llm" not in p.read_text(), p


@pytest.mark.parametrize("text", ["", "x"])
def test_empty_pages_have_no_reference_features(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in lo.reference_features("text").items()]).first()
    assert row.line_count == len(text) and row.doi_count == 0
