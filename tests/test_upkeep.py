"""Records and incremental upkeep on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import incremental as inc
from quarry.operators import records as rc

SCHEMA = f"record_id string, stage string, coal_name string, reactor_type string, T_K double, P_MPa double, gas_agent array<string>, ratios map<string,double>, pollutants map<string,{rc.POLLUTANT}>, seq int"


def record(i, value=10.0, unit="ppm", stage="pyrolysis", t=1000.0, name="NH3", seq=0, norm=None):
    return (i, stage, None, None, t, 1.0, ["N2", "Steam"], {"S/C": 1.0, "ER": 0.33333}, {name: (value, unit, None, norm, None)}, seq)


def test_units_of_pollutants(spark):
    rows = [record("a"), record("b", 2.0, "Mol%"), record("c", 17.031, "mg/Nm3"), record("d", 5.0, "mg/Nm3", name="phenols"), record("e", 5.0, "g/kg"), record("f", None)]
    got = {r.record_id: next(iter(r.pollutants.values())) for r in rc.normalize_pollutants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (round(v.value_norm, 4) if v.value_norm is not None else None, v.unit_norm, v.basis) for k, v in got.items()} == {
        "a": (10.0, "ppmv", "unknown"), "b": (20000.0, "ppmv", "unknown"), "c": (22.414, "ppmv", "unknown"),
        "d": (5.0, "mg/Nm3", "unknown"), "e": (5.0, "g/kg", "unknown"), "f": (None, None, "unknown"),
    }


def test_validation_keeps_the_run_alive(spark):
    rows = [record("ok"), record("hot", t=5000.0), record("odd", stage="burning", value=None)]
    good, bad = rc.validate_records(spark.createDataFrame(rows, SCHEMA))
    assert [r.record_id for r in good.collect()] == ["ok"]
    assert {r.record_id: list(r.reasons) for r in bad.collect()} == {"hot": ["T_K"], "odd": ["stage", "pollutants"]}


def test_signatures(spark):
    row = spark.createDataFrame([record("a")], SCHEMA)
    other = row.withColumns({"gas_agent": F.array(F.lit("steam"), F.lit("n2")), "coal_name": F.lit(" ")})
    assert row.select(rc.record_signature()).first() == other.select(rc.record_signature()).first()
    values = [1.0, 0.33333, 1234.6, 0.00001234, 1e10, 0.0, 12345.6, 9.9996]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rc._short(F.col("v"))).collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_conflicts(spark):
    rows = [record("a", 10.0, seq=1), record("b", 11.0, seq=2), record("c", 20.0, seq=3), record("d", 20.0, seq=4, name="H2S")]
    signed = rc.normalize_pollutants(spark.createDataFrame(rows, SCHEMA)).withColumn("signature", F.lit("s"))
    flagged, pairs = rc.detect_conflicts(signed)
    assert {r.record_id for r in flagged.where("is_conflict = 1").collect()} == {"c"}
    assert [(r.existing_record_id, r.new_record_id) for r in pairs.collect()] == [("b", "c")]
    stored = signed.where("record_id = 'c'").withColumn("updated_at", F.lit(1))
    assert {r.record_id for r in rc.detect_conflicts(signed, stored)[0].where("is_conflict = 1").collect()} == {"a", "c"}
    bare = signed.select("record_id", F.lit("unknown").alias("stage"), *[F.lit(None).cast(signed.schema[c].dataType).alias(c) for c in ("coal_name", "reactor_type", "T_K", "P_MPa", "gas_agent", "ratios")], "pollutants", "seq", "signature")
    assert {r.record_id for r in rc.detect_conflicts(bare)[0].where("is_conflict = 1").collect()} == {"c"}


def test_conflicts_of_one_common_condition_cross_slices(spark):
    rows = [record(f"r{i}", 10.0 * (2 if i % 5 == 0 else 1), seq=i // 2) for i in range(300)]
    signed = rc.normalize_pollutants(spark.createDataFrame(rows, SCHEMA)).withColumn("signature", F.lit("s"))
    got = {r.record_id for r in rc.detect_conflicts(signed, order=("seq", "record_id"))[0].where("is_conflict = 1").collect()}
    ordered = sorted(rows, key=lambda r: (r[-1], r[0]))
    value = lambda r: r[8]["NH3"][0]
    assert got == {b[0] for a, b in zip(ordered, ordered[1:]) if abs(value(a) - value(b)) / value(a) > 0.2}


def test_outputs_and_quotes(spark):
    rows = [("c1", "results", '[{"stage":"pyrolysis","T_K":900}, 3, {"coal_name":"x"}]'), ("c2", "results", '{"P_MPa":1}'), ("c3", "results", "[{bad"), ("c4", "abstract", "{}"), ("c5", None, "{}"), ("c6", "Table", '"text"')]
    got = rc.parse_record_json(spark.createDataFrame(rows, "chunk_id string, section string, output_json string")).collect()
    assert sorted((r.chunk_id, r.n, r.stage, r.T_K, r.P_MPa) for r in got) == [("c1", 0, "pyrolysis", 900.0, None), ("c1", 2, "unknown", None, None), ("c2", 0, "unknown", None, 1.0)]
    text = "No digit NH3. NH3 was 5 ppm! Next one 7. 热解 nh3 9。 end"
    assert spark.createDataFrame([(text,)], "t string").select(rc.evidence_quote("t", F.array(F.lit("NH3")))).first()[0] == "No digit NH3. NH3 was 5 ppm! 热解 nh3 9。"  # the 3 is a digit


def test_upserts(spark):
    old = spark.createDataFrame([("a", "s0", 1), ("b", "s0", 1)], "record_id string, stage string, created_at int")
    new = spark.createDataFrame([("b", "s1", 9), ("c", "s1", 9)], "record_id string, stage string, created_at int")
    assert sorted(map(tuple, rc.upsert_records(old, new).collect())) == [("a", "s0", 1), ("b", "s1", 1), ("c", "s1", 9)]
    many = new.unionByName(spark.createDataFrame([("c", "s2", 10)], new.schema))
    assert sorted(map(tuple, rc.upsert_records(old, many, order=("created_at",)).collect())) == [("a", "s0", 1), ("b", "s1", 1), ("c", "s2", 10)]
    tied = inc.latest_rows(spark.createDataFrame([("k", "x"), ("k", "y")], "record_id string, stage string").repartition(2), "record_id").collect()
    assert tied == inc.latest_rows(spark.createDataFrame([("k", "y"), ("k", "x")], "record_id string, stage string"), "record_id").collect()
    assert sorted(map(tuple, inc.upsert(old, many, "record_id", ("created_at",)).collect())) == [("a", "s0", 1), ("b", "s1", 9), ("c", "s2", 10)]


def test_manifest(spark):
    schema = "path string, mtime_ns long, size long, sha256 string"
    files = spark.createDataFrame([("new", 1, 1, "x"), ("same", 1, 1, "x"), ("touched", 2, 1, "x"), ("edited", 2, 2, "y")], schema)
    manifest = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 1, 1, "x"), ("edited", 1, 1, "x"), ("gone", 1, 1, "x")], schema)
    got = {r.path: r.status for r in inc.diff_manifest(files, manifest).collect()}
    assert got == {"new": "new", "same": "unchanged", "touched": "metadata_only", "edited": "changed", "gone": "removed"}
    assert [r.path for r in inc.removed_paths(manifest, files).collect()] == ["gone"]
    inc.guard_signatures({"schema": "a"}, {"schema": "a"})
    with pytest.raises(ValueError, match="schema"):
        inc.guard_signatures({"schema": "a"}, {"schema": "b"})


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    inc.publish_version(spark.range(1), root, "one")
    inc.publish_version(spark.range(2), root, "two")
    assert tuple(inc.publish_version(spark.range(3), root, "three", ok=False).first()) == ("two", "one")
    assert tuple(inc.rollback(spark, root).first()) == ("one", "two")
    with pytest.raises(ValueError):
        inc.rollback(spark, str(tmp_path / "none"))


def test_two_publishers_take_turns(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "v")
    inc.publish_version(spark.range(1), root, "one")
    seen = inc._newest(spark, root)
    inc.publish_version(spark.range(2), root, "two")  # comes between the look and the change of the next
    looks = iter([seen])
    look = inc._newest
    monkeypatch.setattr(inc, "_newest", lambda *a: next(looks, None) or look(*a))
    assert tuple(inc.publish_version(spark.range(3), root, "three").first()) == ("three", "two")
    assert sorted((r.seq, r.current, r.previous) for r in inc._changes(spark, root).collect()) == [(0, "one", None), (1, "two", "one"), (2, "three", "two")]
    assert not inc._put(spark, root, 2, "late", None) and tuple(inc.pointer(spark, root).first()) == ("three", "two")


def test_only_placed_chunks_are_tagged(spark, sf, monkeypatch):
    from quarry.plans import upkeep_queries as up

    seen = []
    tag = up.extract_metadata
    monkeypatch.setattr(up, "extract_metadata", lambda df: seen.append(df) or tag(df))
    top = up._top(spark, sf)
    assert len(seen) == 1 and seen[0].where("rank > 10").isEmpty() and 0 < seen[0].count() == top.count() < up.view(spark, sf, up.CHUNKS).count() and {"stage", "T_K", "rank"} <= set(top.columns)
