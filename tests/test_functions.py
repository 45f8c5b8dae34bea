"""Text, metadata and question functions on literal rows, with the traps of each."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions import helpers, metadata, text
from quarry.functions.ontology import tag_gas_agents, tag_stage, tag_targets
from quarry.operators.questions import filters_of, parse_queries, range_overlap, relax_filters, rewrite_queries


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "text string").select(make("text")).first()[0]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (text.detect_language, "热解 tar", "mixed"),
        (text.detect_language, "热解", "zh"),
        (text.detect_language, "", "en"),
        (text.normalize_text, " gasifi-\ncation  of\n\tx ", "gasification of x"),
        (text.basic_clean, "a-\nb\r\n\r\n  c \t d\n", "ab\nc d"),
        (text.fix_hyphenation, "gasifi-\ncation a-\nb", "gasification a-\nb"),
        (text.markdown_whitespace, "\n a\t b\r\n\n\n\nc ", "a b\n\nc"),
        (text.normalize_bullets, "• x\n (2) y\n3) z\n4. w", "- x\n2. y\n3. z\n4. w"),
        (text.count_tokens, "热解 NH3, é_a", 5),
        (text.tokenize, "Hé 热解 A_1", ["h", "热", "解", "a_1"]),
    ],
)
def test_text_columns(spark, make, given, want):
    assert one(spark, given, make) == want


def test_identifiers(spark):
    import hashlib

    row = spark.createDataFrame([("a", None)], "x string, y string").select(text.stable_id("x", "y"), text.cache_key("x", F.lit("m"), F.lit("v"), "y")).first()
    assert row[0] == hashlib.sha256(b"a||").hexdigest()[:24]
    assert row[1] == hashlib.sha1(b"a||m||v||" + hashlib.sha1(b"").hexdigest().encode()).hexdigest()


def test_units(spark):
    row = spark.range(1).select(*[F.round(text.convert_units(F.lit(v), k), 6) for v, k in ((0.0, "c_to_k"), (10.0, "bar_to_mpa"), (1.0, "atm_to_mpa"), (1.0, "mol_percent_to_ppmv"))]).first()
    assert tuple(row) == (273.15, 1.0, 0.101325, 10000.0)


def test_helpers():
    assert helpers.nfkc("ﬁ​ x　y\n\n\n\nz") == "fi x y\n\nz"
    assert helpers.merge_lines("one\ntwo.\nthree\n- item\n(x)\nUp\n热\n解") == "one two.\nthree\n- item (x)\nUp 热解"
    assert helpers.sentences("热解生成酚类。机理复杂！需考虑缩聚。", 6) == ["热解生成酚类。", "机理复杂！ 需考虑缩聚。"]  # a full-width stop is no CJK letter
    assert helpers.sentences("See Fig. 2 here. Then stop.", 4) == ["See Fig. 2 here.", "Then stop."]
    assert helpers.html_text("<title> T </title><p>a&amp;b</p>c") == ("T a&b c", "T")
    assert abs(float((helpers.hashed_bag("a b") ** 2).sum()) - 1) < 1e-9 and not helpers.hashed_bag("").any()


def test_tags_are_plain_substrings_in_ontology_order(spark):
    rows = spark.createDataFrame([("The cost is fair",), ("Combustion after pyrolysis with H2O",), ("nothing",), (None,)], "text string")
    got = rows.select(tag_stage(F.col("text")), tag_gas_agents(F.col("text")), tag_targets(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("unknown", ["air"], ["COS"]), ("pyrolysis", ["steam"], None), ("unknown", None, None), ("unknown", None, None)]


def test_metadata(spark):
    rows = [
        (1, "Run between 1400 and 1000 K and 2 bar, S/C = 1.5 steam-to-carbon 2"),
        (2, "at 800 °C, 0.5~1.5 MPa. ER 0.3 coal: Lignite A"),
        (3, "1200K下"),
        (4, None),
        (5, "煤种：褐煤，温度 T=900K 1 atm"),
    ]
    got = {r.i: r for r in metadata.extract_metadata(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert (got[1].T_min_K, got[1].T_max_K, got[1].T_K, round(got[1].P_MPa, 6)) == (1000, 1400, 1200, 0.2)
    assert got[1].ratios == {"S/C": 2.0}
    assert (got[2].T_K, got[2].T_min_K, got[2].P_min_MPa, got[2].P_MPa, got[2].coal_name) == (1073.15, None, 0.5, 1.0, "Lignite A")
    assert got[2].meta_confidence["P_range_MPa"] == 0.9 and got[2].meta_confidence["T_K"] == 0.9
    assert (got[3].T_K, got[4].T_K, got[4].stage) == (None, None, "unknown")
    assert (got[5].coal_name, got[5].T_K, round(got[5].P_MPa, 6)) == ("褐煤", 900, 0.101325)
    proof = next(e for e in got[2].meta_evidence if e.field == "T_range_K")
    assert rows[1][1][proof.start : proof.end] == "t 800 °C" and "800 °C" in proof.evidence_text


def test_page_metadata_fills_gaps_only(spark):
    kind = "struct<stage:string,gas_agent:array<string>,targets:array<string>,T_K:double,T_min_K:double,T_max_K:double,P_MPa:double,P_min_MPa:double,P_max_MPa:double,coal_name:string,ratios:map<string,double>>"
    page = ("pyrolysis", ["steam"], None, 900.0, None, None, None, None, None, "x", None)
    chunk = ("unknown", ["air"], ["NH3"], 800.0, None, None, None, None, None, None, None)
    rows = spark.createDataFrame([(chunk, page)], f"c {kind}, page_meta {kind}").select("c.*", "page_meta")
    r = metadata.merge_page_chunk_metadata(rows).first()
    assert (r.stage, r.gas_agent, r.targets, r.T_K, r.coal_name) == ("pyrolysis", ["air", "steam"], ["NH3"], 800.0, "x")


def test_questions(spark):
    rows = [("a", "必须 1200K 2MPa steam gasification"), ("b", "NH3 CO2 热解机理"), ("c", "1300-1100 K mechanism"), ("d", None)]
    q = parse_queries(spark.createDataFrame(rows, "qid string, raw string"))
    got = {r.qid: r for r in q.collect()}
    assert (got["a"].q_stage, got["a"].q_T.lo, got["a"].q_T.hi) == ("gasification", 1140.0, 1260.0)
    assert {c.name: c.priority for c in got["a"].constraints} == {"stage": "hard", "gas_agent": "soft", "T_range_K": "hard", "P_range_MPa": "hard"}
    assert round(got["b"].q_T.lo, 4) == round((3 + 273.15) * 0.95, 4)  # no word boundary in questions
    assert (got["c"].q_T.lo, got["c"].q_T.hi) == (1300.0, 1100.0)  # not sorted
    assert got["d"].q_stage == "unknown" and not got["d"].constraints
    said = {r.qid: (r.rewritten, r.rewrite_reason) for r in rewrite_queries(q).collect()}
    assert said["b"] == ("NH3 CO2 热解机理 mechanism pyrolysis reaction pathway", "zh_rules") and said["c"][1] == "mechanism_rules" and said["d"] == ("", "")
    f = {r.qid: r for r in filters_of(q).collect()}
    assert f["a"].f_stage == "gasification" and f["a"].f_gas_agent is None and f["b"].f_T is None
    full = filters_of(q, "full")
    none = spark.createDataFrame([("a",)], "qid string")
    again = {r.qid: r for r in relax_filters(full, none, none).collect()}
    assert set(again) == {"b", "c", "d"} and again["b"].f_T is None and again["b"].f_targets == ["NH3"]


def test_range_overlap(spark):
    rows = spark.createDataFrame([(1000.0, None, None), (None, 900.0, 1100.0), (None, None, None)], "p double, a double, b double")
    make = lambda lo, hi: range_overlap(F.col("p"), F.col("a"), F.col("b"), F.lit(lo).cast("double"), F.lit(hi).cast("double"))
    assert [tuple(r) for r in rows.select(make(1050, 1200), make(None, None), make(950, 1000)).collect()] == [(False, True, True), (True, True, True), (False, True, False)]


def test_aliases_within_others_and_in_other_scripts(spark):
    from quarry.functions.ontology import DOMAIN, _has

    words = [w for kind in DOMAIN.values() for ws in kind.values() for w in ws]
    texts = ["", "plain", *words, *[f"x{w}y" for w in words], "K 气 pyroly", "K CO₂", "éair"]
    rows = spark.createDataFrame([(t.lower(),) for t in texts], "low string")
    for kind in DOMAIN.values():
        for own in kind.values():
            got = [r[0] for r in rows.select(_has(F.col("low"), own)).collect()]
            assert got == [any(w.lower() in t.lower() for w in own) for t in texts], own


def test_numbers_do_not_pay_for_their_proofs(spark):
    from quarry.functions.metadata import extract_metadata

    plan = extract_metadata(spark.range(1).select(F.lit("Pyrolysis at 900 K").alias("text"), F.rand().alias("r"))).select("r", "stage", "T_K", "P_MPa")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_instr" not in plan.lower() and "regexpinstr" not in plan.lower()
