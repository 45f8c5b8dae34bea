"""Phrase collocations against SQL, also where the frontier is cut, and the corner cases of the contract."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest

from quarry.llm import collocations, queries
from quarry.llm.oracle import COLLOCATIONS

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def in_sql(docs, least, wanted):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({COLLOCATIONS.format(least=least, wanted=wanted)})").fetchall()
    return sorted(got)


def in_spark(docs, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, **kw).collect())


@pytest.mark.parametrize("wanted", [15, 2000])
def test_whole_table_equals_sql(spark, sf, wanted):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text")
    want = in_sql(docs, collocations.LEAST_COUNT, wanted)
    assert len(want) > 20
    assert in_spark(docs, wanted=wanted) == want


def test_covered_phrases_lower_the_threshold_and_ties_are_settled(spark):
    # most pairs lie within a longer phrase, so the first threshold leaves too few; many phrases tie in score and count
    lines = [f"a{i} b{i} c{i} d{i}" for i in range(30)] * 30 + [f"x{i} y{i}" for i in range(12)] * 30 + ["x0 b0", "zz x1 y1 zz x1 y1"] * 40
    docs = spark.createDataFrame([("en" if i % 2 else None, line) for i, line in enumerate(lines * 2)], "lang string, text string")
    for wanted in (1, 7, 33, 40):
        want = in_sql(docs, collocations.LEAST_COUNT, wanted)
        assert in_spark(docs, wanted=wanted) == want


def test_pieces_and_odd_rows(spark):
    rows = [("en", "Up and, down.\tUP AND\x0bdown " * 15, 1), ("en", None, 2), ("en", "", 3), (None, "no no no " * 40, 4), ("de", "\xa0 \t.", 5)]
    docs = spark.createDataFrame(rows, "lang string, text string, phrase int")
    assert in_spark(docs) == in_sql(docs, collocations.LEAST_COUNT, 2000)
    got = {(r.lang, r.phrase): (r.a, r.n) for r in collocations.collocations(docs).collect()}
    assert got == {("en", "up and"): (30, 90), ("und", "no no no no"): (117, 120)}
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_a_long_text_counts_as_many_short_ones(spark):
    line = "to be or not to be that is it. "
    many = in_spark(spark.createDataFrame([("en", line)] * 4000, "lang string, text string"))
    one = in_spark(spark.createDataFrame([("en", line * 4000)], "lang string, text string"))
    assert many == one and len(one) > 0


def test_query_has_the_columns_of_the_contract(spark, sf):
    assert dict(queries.op11_collocations(spark, sf).dtypes) == {c: "string" if c in ("lang", "phrase") else "bigint" for c in COLUMNS}


def test_tasks_pass_counts_on_in_bounded_batches_and_lose_none():
    # 1.5 million distinct pairs of each of two languages; some stand in both halves, so they are passed on more than once
    stretches = [b" ".join(b"%d" % i for i in range(a, a + 3001)) for a in range(0, 1_500_000, 3000)]
    twice = stretches + stretches[:10]
    columns = [pa.array(["de", "en"] * len(twice)), pa.array([s for s in twice for _ in range(2)], pa.binary()), pa.array([2] * 2 * len(twice), pa.int64())]
    batches = list(collocations._phrases(2, None, None)(iter(pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"]).slice(i, 50) for i in range(0, 2 * len(twice), 50))))
    assert max(b.num_rows for b in batches) <= 1 << 16
    for lang in ("de", "en"):
        n = sum(sum(b.column(2).to_pylist()) for b in batches if b.column(0)[0].as_py() == lang)
        assert n == 2 * 3000 * len(twice)
    words = list(collocations._count_words(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * 500), pa.array(stretches, pa.binary())], ["lang", "text"])])))
    assert max(b.num_rows for b in words) <= 1 << 16 and sum(sum(b.column(2).to_pylist()) for b in words) == 3001 * 500
