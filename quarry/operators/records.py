"""Measurement records: parsing, unit normalisation, validation, signatures, conflicts and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import MOLAR_MASS, STP_LITRES, stable_id
from quarry.operators.incremental import latest_rows
from quarry.scratch import materialize

POLLUTANT = "STRUCT<value: DOUBLE, unit: STRING, basis: STRING, value_norm: DOUBLE, unit_norm: STRING>"
RECORD = f"STRUCT<stage: STRING, coal_name: STRING, reactor_type: STRING, T_K: DOUBLE, P_MPa: DOUBLE, gas_agent: ARRAY<STRING>, ratios: MAP<STRING, DOUBLE>, pollutants: MAP<STRING, {POLLUTANT}>>"

#: Fixed values.
SECTIONS = ("methods", "conditions", "results", "discussion", "table")
STAGES = ("pyrolysis", "gasification", "coupled", "unknown")


def parse_record_json(outputs: DataFrame, json_col: str = "output_json", sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """One row for each record object in an extraction output, in allowed sections: the input columns, ``n`` (its place),
    ``record_json`` and the record's fields. A single object counts as a list of one; bad JSON and other values give none."""
    text = F.trim(F.col(json_col))
    allowed = outputs.where(F.lower(F.coalesce("section", F.lit("unknown"))).isin(*sections))
    pieces = F.from_json(F.when(F.startswith(text, F.lit("[")), text).when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))), "ARRAY<STRING>")
    rows = allowed.select("*", F.posexplode(pieces).alias("n", "record_json")).where(F.startswith("record_json", F.lit("{")))
    rows = rows.withColumn("_r", F.from_json("record_json", RECORD)).where("_r IS NOT NULL")
    own = [f"_r.{c}" for c in ("coal_name", "reactor_type", "T_K", "P_MPa", "gas_agent", "ratios", "pollutants")]
    stage = F.coalesce("_r.stage", F.col("stage") if "stage" in outputs.columns else F.lit(None), F.lit("unknown"))
    return rows.select(*[c for c in rows.columns if c not in ("_r", "stage")], stage.alias("stage"), *own)


def normalize_pollutants(records: DataFrame, col: str = "pollutants") -> DataFrame:
    """Every numeric pollutant gets value_norm and unit_norm: ppm and mol% as ppmv, mg/Nm3 as ppmv where the molar mass is
    known, others as they are; a missing basis is ``unknown``."""
    mass = F.create_map(*[F.lit(x) for pair in MOLAR_MASS.items() for x in pair])

    def one(name: Column, p: Column) -> Column:
        unit, v = F.lower(F.trim(F.coalesce(p["unit"], F.lit("")))), p["value"]
        mg = unit.isin("mg/nm3", "mg/nm^3", "mg per nm3")
        heavy = F.try_element_at(mass, name)
        norm = F.when(unit.isin("mol%", "mol %", "mole%", "mole %"), v * 10000.0).when(mg & heavy.isNotNull(), v * (F.lit(STP_LITRES) / heavy)).otherwise(v)
        name_ = F.when(unit.isin("mol%", "mol %", "mole%", "mole %", "ppm", "ppmv") | (mg & heavy.isNotNull()), "ppmv").when(mg, "mg/Nm3").otherwise(p["unit"])
        has = v.isNotNull()
        return F.struct(v.alias("value"), p["unit"].alias("unit"), F.coalesce(p["basis"], F.lit("unknown")).alias("basis"), F.when(has, norm).otherwise(p["value_norm"]).alias("value_norm"), F.when(has, name_).otherwise(p["unit_norm"]).alias("unit_norm"))

    return records.withColumn(col, F.transform_values(col, one))


def validate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): a row with an unreasonable temperature, pressure or stage, or a pollutant without value or unit,
    goes to the quarantine with all its ``reasons``."""
    t, p = F.col("T_K"), F.col("P_MPa")
    bad = F.exists(F.map_values(F.coalesce("pollutants", F.lit(None).cast(records.schema["pollutants"].dataType))), lambda x: x.isNull() | x["value"].isNull() | x["unit"].isNull())
    reasons = [F.when(~t.between(200, 3000), "T_K"), F.when(~((p > 0) & (p <= 50)), "P_MPa"), F.when(~F.coalesce("stage", F.lit("unknown")).isin(*STAGES), "stage"), F.when(bad, "pollutants")]
    judged = records.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def _short(x: Column) -> Column:
    """Four significant digits without trailing zeros, large and small ones with a two-digit exponent."""
    rounded = F.format_string("%.3e", x)
    power = F.regexp_extract(rounded, r"e([+-][0-9]+)$", 1).cast("int")
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*[F.when(power == e, F.format_string(f"%.{3 - e}f", x)) for e in range(-4, 4)])
    sign = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    far = F.concat(bare(F.regexp_extract(rounded, "^(.*)e", 1)), F.lit("e"), sign)
    return F.when(x == 0, "0").when(power.between(-4, 3), bare(plain)).otherwise(far)


def record_signature() -> Column:
    """Id of the operating condition: stage, names, temperature and pressure to three digits, sorted gases and ratios."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).otherwise("")
    gas = F.array_join(F.array_sort(F.transform(F.coalesce("gas_agent", F.array().cast("array<string>")), F.lower)), ",")
    pairs = F.array_sort(F.map_entries(F.coalesce("ratios", F.create_map().cast("map<string,double>"))))
    ratios = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), _short(e["value"]))), ",")
    return stable_id(F.coalesce(F.nullif("stage", F.lit("")), F.lit("unknown")), low("coal_name"), low("reactor_type"), fixed("T_K"), fixed("P_MPa"), gas, ratios)


def evidence_quote(text: str | Column, keys: Column) -> Column:
    """The first three sentences with a digit and one of the keys, at most 800 characters; null without any."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_replace(F.translate(text, "\n", " "), r"(?U)([.!?。！？])\s+", "$1\u0001"), "\u0001")
    hit = lambda s: F.regexp_like(s, F.lit("[0-9]")) & F.exists(keys, lambda k: F.contains(F.lower(s), F.lower(k)))
    found = F.transform(F.filter(parts, hit), lambda s: F.trim(s))
    return F.when(F.size(found) > 0, F.substring(F.array_join(F.slice(found, 1, 3), " "), 1, 800))


def _differs(old: Column, new: Column) -> Column:
    """Whether a shared pollutant's value is more than a fifth off the old one."""

    def off(k: Column) -> Column:
        a = F.coalesce(F.try_element_at(old, k)["value_norm"], F.try_element_at(old, k)["value"])
        b = F.coalesce(F.try_element_at(new, k)["value_norm"], F.try_element_at(new, k)["value"])
        return F.coalesce(F.when(a == 0, F.abs(b) > 1e-9).otherwise(F.abs(a - b) / F.abs(a) > 0.2), F.lit(False))

    return F.coalesce(F.exists(F.map_keys(new), off), F.lit(False))


def _slices(rows: DataFrame, by: str, n: int = 16) -> Column:
    """Number of the slice of ``by`` a row is in: at most ``n`` slices of about equal size, in its order, equal values together;
    one slice where ``by`` is no number or time."""
    kind = rows.schema[by].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "float", "double", "timestamp"):
        return F.lit(0)
    value = F.col(by).cast("double")
    cuts = rows.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] or []
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.coalesce(value, F.lit(float("-inf")))))


def detect_conflicts(records: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """(records + is_conflict, conflicts): each record against the one before it with the same signature, in ``order``; the
    first against the newest stored one.

    One common condition may hold a large part of all records. The window therefore goes by signature and slice of the first
    order column, and the first record of a slice takes the last one of the slice before it from a table of slice ends."""
    records = materialize(records, "records")
    rows = records.withColumn("_slice", _slices(records, order[0]))
    own = F.struct("record_id", "pollutants")
    before = F.lag(own).over(W.partitionBy("signature", "_slice").orderBy(*order))
    ends = rows.groupBy("signature", "_slice").agg(F.max_by(own, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(W.partitionBy("signature").orderBy("_slice"))).drop("_end")
    rows = rows.withColumn("_old", before).join(ends, ["signature", "_slice"]).withColumn("_old", F.coalesce("_old", "_carried")).drop("_carried", "_slice")
    if stored is not None:
        newest = stored.groupBy("signature").agg(F.max_by(own, F.struct("updated_at", "record_id")).alias("_stored"))
        rows = rows.join(newest, "signature", "left").withColumn("_old", F.coalesce("_old", "_stored")).drop("_stored")
    rows = rows.withColumn("is_conflict", F.coalesce(_differs(F.col("_old.pollutants"), F.col("pollutants")), F.lit(False)).cast("int"))
    conflicts = rows.where("is_conflict = 1").select("signature", F.col("_old.record_id").alias("existing_record_id"), F.col("record_id").alias("new_record_id"), F.col("_old.pollutants").alias("existing_pollutants"), F.col("pollutants").alias("new_pollutants"))
    return rows.drop("_old").select(*records.columns, "is_conflict"), conflicts


def upsert_records(stored: DataFrame, new: DataFrame, key: str = "record_id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The records after the run: new rows replace stored ones of the same id but keep their created_at. Of several new rows
    of one id the last in ``order`` counts."""
    last = latest_rows(new, key, tuple(c for c in order if c in new.columns))
    old = stored.select(F.col(key).alias("_key"), F.col("created_at").alias("_created"))
    merged = last.join(old, last[key] == old["_key"], "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_key", "_created")
    return stored.join(last.select(key), key, "left_anti").unionByName(merged.select(*stored.columns))


def evidence_rows(records: DataFrame) -> DataFrame:
    """The evidence of saved records, one row each: record_id, source_file, page, chunk_id and quote."""
    return records.select("record_id", "source_file", "page", "chunk_id", "quote").distinct()


def run_counts(attempted: DataFrame, saved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row with the sizes of a run: attempted, saved, conflicts."""
    parts = [df.agg(F.count("*").alias(n)) for df, n in ((attempted, "attempted"), (saved, "saved"), (conflicts, "conflicts"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])
