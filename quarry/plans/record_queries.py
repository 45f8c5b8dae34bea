"""Measurement records made from all line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import MOLAR_MASS
from quarry.operators import records as rc
from quarry.plans.views import CHUNKS, RECORDS, said, view
from quarry.sources.writers import EXPORT, export_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record view in the record schema, pollutants normalised."""
    flat = view(spark, sf_dir, RECORDS)
    p = F.struct(F.col("value"), F.col("unit"), F.lit(None).cast("string").alias("basis"), F.lit(None).cast("double").alias("value_norm"), F.lit(None).cast("string").alias("unit_norm"))
    nested = flat.withColumns({"gas_agent": F.array("gas"), "ratios": F.create_map(F.lit("S/C"), "ratio"), "pollutants": F.create_map("pollutant", p.cast(rc.POLLUTANT))})
    return rc.normalize_pollutants(nested.drop("gas", "ratio", "value", "unit", "pollutant"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("signature", rc.record_signature())


_MASS = "CASE pollutant " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in MOLAR_MASS.items()) + " END"
SQL_RECORDS = f"""
raw AS ({said(RECORDS)}),
rec AS (SELECT *, CASE WHEN unit = 'mol%' THEN value * 10000 WHEN unit = 'mg/Nm3' AND {_MASS} IS NOT NULL THEN value * (CAST(22.414 AS DOUBLE) / {_MASS}) ELSE value END AS norm,
  CASE WHEN value IS NULL THEN NULL WHEN unit = 'mg/Nm3' AND {_MASS} IS NULL THEN 'mg/Nm3' ELSE 'ppmv' END AS norm_unit,
  substr(sha256(concat_ws('||', stage, lower(trim(coalesce(coal_name, ''))), coalesce(reactor_type, ''), CASE WHEN T_K IS NOT NULL THEN format('{{:.3f}}', T_K) ELSE '' END,
    CASE WHEN P_MPa IS NOT NULL THEN format('{{:.3f}}', P_MPa) ELSE '' END, gas, 'S/C=' || CASE ratio WHEN 0.5 THEN '0.5' WHEN 0.75 THEN '0.75' ELSE '1' END)), 1, 24) AS signature FROM raw)"""


def normalize_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised values of every record."""
    rows = records(spark, sf_dir).select("record_id", F.explode("pollutants").alias("pollutant", "p"))
    return rows.select("record_id", "pollutant", F.round("p.value_norm", 6).alias("value_norm"), "p.unit_norm", "p.basis")


QUERIES["normalize_pollutants"] = normalize_pollutants
ORACLE["normalize_pollutants"] = f"WITH {SQL_RECORDS} SELECT record_id, pollutant, round(norm, 6) AS value_norm, norm_unit AS unit_norm, 'unknown' AS basis FROM rec"


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's reasons for quarantine, empty for valid ones."""
    good, bad = rc.validate_records(records(spark, sf_dir))
    return good.select("record_id", F.lit("").alias("reasons")).unionByName(bad.select("record_id", F.array_join("reasons", ",").alias("reasons")))


QUERIES["validate_records"] = validate_records
ORACLE["validate_records"] = f"WITH {SQL_RECORDS} SELECT record_id, concat_ws(',', CASE WHEN T_K < 200 THEN 'T_K' END, CASE WHEN value IS NULL THEN 'pollutants' END) AS reasons FROM rec"


def record_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of every record."""
    return _signed(spark, sf_dir).select("record_id", "signature")


QUERIES["record_signature"] = record_signature
ORACLE["record_signature"] = f"WITH {SQL_RECORDS} SELECT record_id, signature FROM rec"


def detect_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its conflict flag."""
    return rc.detect_conflicts(_signed(spark, sf_dir), order=("seq", "record_id"))[0].select("record_id", "is_conflict")


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicting pairs by signature."""
    pairs = rc.detect_conflicts(_signed(spark, sf_dir), order=("seq", "record_id"))[1]
    return pairs.select("signature", "existing_record_id", "new_record_id")


QUERIES |= {"detect_conflicts": detect_conflicts, "conflict_pairs": conflict_pairs}
_LAG = f"""{SQL_RECORDS},
o AS (SELECT record_id, signature, pollutant, norm, lag(record_id) OVER w AS old_id, lag(pollutant) OVER w AS old_pollutant, lag(norm) OVER w AS old_norm FROM rec WINDOW w AS (PARTITION BY signature ORDER BY seq, record_id)),
f AS (SELECT *, coalesce(CASE WHEN pollutant = old_pollutant THEN abs(old_norm - norm) / abs(old_norm) > CAST(0.2 AS DOUBLE) END, false) AS hit FROM o)"""
ORACLE["detect_conflicts"] = f"WITH {_LAG} SELECT record_id, CAST(hit AS INT) AS is_conflict FROM f"
ORACLE["conflict_pairs"] = f"WITH {_LAG} SELECT signature, old_id AS existing_record_id, record_id AS new_record_id FROM f WHERE hit"

def parse_record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record objects in extraction outputs: single objects, lists with other values, bad JSON."""
    said_ = F.concat(F.lit('{"stage":"'), "stage", F.lit('"'))
    kind = F.col("seq") % 7
    output = (
        F.when(kind == 0, F.concat(said_, F.lit(',"T_K":'), F.col("value").cast("int").cast("string"), F.lit("}")))
        .when(kind == 1, F.concat(F.lit("["), said_, F.lit('}, {"coal_name":"x"}, 3]')))
        .when(kind == 2, "not json")
        .when(kind == 3, "[1, 2]")
        .otherwise(F.concat(F.lit("["), said_, F.lit(',"P_MPa":1.5}]')))
    )
    rows = view(spark, sf_dir, RECORDS).select(F.col("record_id").alias("chunk_id"), "source_file", F.when(F.col("seq") % 4 == 0, "references").otherwise("results").alias("section"), output.alias("output_json"))
    return rc.parse_record_json(rows).select("chunk_id", "n", "stage", "coal_name", "T_K", "P_MPa")


QUERIES["parse_record_json"] = parse_record_json
ORACLE["parse_record_json"] = f"""WITH r AS ({said(RECORDS)}),
o AS (SELECT record_id AS chunk_id, seq, stage, value FROM r WHERE seq % 4 <> 0),
x AS (
  SELECT chunk_id, 0 AS n, stage, CAST(NULL AS VARCHAR) AS coal_name, CAST(CAST(value AS INT) AS DOUBLE) AS T_K, CAST(NULL AS DOUBLE) AS P_MPa FROM o WHERE seq % 7 = 0 AND value IS NOT NULL
  UNION ALL SELECT chunk_id, 0, stage, NULL, NULL, NULL FROM o WHERE seq % 7 = 1
  UNION ALL SELECT chunk_id, 1, 'unknown', 'x', NULL, NULL FROM o WHERE seq % 7 = 1
  UNION ALL SELECT chunk_id, 0, stage, NULL, NULL, CAST(1.5 AS DOUBLE) FROM o WHERE seq % 7 > 3)
SELECT * FROM x"""


def evidence_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every chunk for three species."""
    keys = F.array(F.lit("NH3"), F.lit("H2S"), F.lit("SO2"))
    text = F.concat(F.col("text"), F.lit(" No number here for NH3! Then H2S rose to 7.5 units. "), F.col("text"))
    return view(spark, sf_dir, CHUNKS).select("chunk_id", rc.evidence_quote(text, keys).alias("quote"))


QUERIES["evidence_quote"] = evidence_quote
ORACLE["evidence_quote"] = rf"""WITH c AS ({said(CHUNKS)}),
t AS (SELECT chunk_id, text || ' No number here for NH3! Then H2S rose to 7.5 units. ' || text AS text FROM c),
s AS (SELECT chunk_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[0-9]') AND (contains(lower(x), 'nh3') OR contains(lower(x), 'h2s') OR contains(lower(x), 'so2'))) AS hits FROM t)
SELECT chunk_id, CASE WHEN len(hits) > 0 THEN substr(array_to_string(list_transform(list_slice(hits, 1, 3), lambda x: trim(x, ' ')), ' '), 1, 800) END AS quote FROM s"""


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signed(spark, sf_dir)
    return rows.withColumns({"created_at": F.timestamp_seconds(F.col("seq") % 100000), "updated_at": F.timestamp_seconds(F.col("seq") % 70001)})


def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records (even seq or a multiple of three) after a run that brings those with a seq divisible by three again."""
    rows = _stamped(spark, sf_dir).select("record_id", "stage", "created_at", "updated_at", "seq")
    stored, new = rows.where("seq % 2 = 0").drop("seq"), rows.where("seq % 3 = 0").withColumns({"stage": F.lit("coupled"), "created_at": F.col("updated_at")}).drop("seq")
    out = rc.upsert_records(stored, new)
    return out.select("record_id", "stage", F.unix_seconds("created_at").alias("created"))


QUERIES["upsert_records"] = upsert_records
ORACLE["upsert_records"] = f"""WITH r AS ({said(RECORDS)})
SELECT record_id, CASE WHEN seq % 3 = 0 THEN 'coupled' ELSE stage END AS stage, CASE WHEN seq % 2 = 0 THEN seq % 100000 ELSE seq % 70001 END AS created FROM r WHERE seq % 2 = 0 OR seq % 3 = 0"""


def record_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of all records, each brought twice."""
    rows = view(spark, sf_dir, RECORDS).select("record_id", "source_file", (F.col("seq") % 40).cast("int").alias("page"), F.concat(F.lit("c"), "record_id").alias("chunk_id"), F.concat(F.col("pollutant"), F.lit(" in "), F.col("unit")).alias("quote"))
    return rc.evidence_rows(rows.unionByName(rows))


def record_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a run over all records: attempted, saved and in conflict."""
    rows = _signed(spark, sf_dir)
    saved, _ = rc.validate_records(rows)
    return rc.run_counts(rows, saved, rc.detect_conflicts(saved, order=("seq", "record_id"))[1])


QUERIES |= {"record_evidence": record_evidence, "record_run_counts": record_run_counts}
ORACLE["record_evidence"] = f"""WITH r AS ({said(RECORDS)})
SELECT record_id, source_file, CAST(seq % 40 AS INT) AS page, 'c' || record_id AS chunk_id, pollutant || ' in ' || unit AS quote FROM r"""

ORACLE["record_run_counts"] = f"""WITH {SQL_RECORDS},
v AS (SELECT * FROM rec WHERE coalesce(T_K, 200) >= 200 AND value IS NOT NULL),
o AS (SELECT norm, pollutant, lag(pollutant) OVER w AS old_pollutant, lag(norm) OVER w AS old_norm FROM v WINDOW w AS (PARTITION BY signature ORDER BY seq, record_id))
SELECT (SELECT count(*) FROM rec) AS attempted, (SELECT count(*) FROM v) AS saved,
  (SELECT count(*) FROM o WHERE pollutant = old_pollutant AND abs(old_norm - norm) / abs(old_norm) > CAST(0.2 AS DOUBLE)) AS conflicts"""


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 2000 records in the export's columns."""
    out = export_rows(_stamped(spark, sf_dir))
    return out.select(*[c for c in EXPORT if c not in ("pollutants_json", "created_at", "updated_at")], F.unix_seconds("updated_at").alias("updated"))


QUERIES["export_records"] = export_records
ORACLE["export_records"] = f"""WITH r AS ({said(RECORDS)})
SELECT record_id, source_file, stage, coal_name, reactor_type, T_K, P_MPa, '["' || gas || '"]' AS gas_agent_json,
  '{{"S/C":' || CASE ratio WHEN 0.5 THEN '0.5' WHEN 0.75 THEN '0.75' ELSE '1.0' END || '}}' AS ratios_json, seq % 70001 AS updated
FROM r ORDER BY seq % 70001 DESC, record_id LIMIT 2000"""
