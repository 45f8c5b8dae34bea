"""Metadata of all chunks of domain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import metadata as md
from quarry.functions.ontology import DOMAIN, flag_columns, lowered, tag_gas_agents, tag_stage, tag_targets
from quarry.plans.views import CHUNKS, said, table, view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


# ------------------------------------------------------------------------------------------------------------ the SQL
def _any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in dict.fromkeys(x.lower() for x in words)) + ")"


def sql_stage(low: str = "low") -> str:
    """First stage that occurs."""
    return "CASE " + " ".join(f"WHEN {_any(low, w)} THEN '{s}'" for s, w in DOMAIN["stage"].items()) + " ELSE 'unknown' END"


def sql_all(kind: str, low: str = "low", own: bool = False) -> str:
    """Sorted names that occur, null if none."""
    cases = ", ".join(f"CASE WHEN {_any(low, [*w, *([n] if own else [])])} THEN '{n}' END" for n, w in sorted(DOMAIN[kind].items()))
    found = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} END"


def _x(name: str, group: int) -> str:
    return f"nullif(regexp_extract(text, '{md.PATTERNS[name][0]}', {group}), '')"


def _d(name: str, group: int = 1) -> str:
    return f"CAST({_x(name, group)} AS DOUBLE)"


_K = {f"{n}{g}": _d(n, g) for n in ("k2", "c2", "mpa2") for g in (1, 2)} | {n: _d(n) for n in ("k1", "c1", "mpa1", "bar", "atm")}
SQL_META = f"""
chunks AS ({said(CHUNKS)}),
raw AS (SELECT *, lower(text) AS low, {", ".join(f"{v} AS _{k}" for k, v in _K.items())} FROM chunks),
meta AS (
  SELECT chunk_id, source_file, page, section, text, {sql_stage()} AS stage, {sql_all("gas_agent")} AS gas_agent, {sql_all("targets", own=True)} AS targets,
    CASE WHEN _k21 IS NOT NULL THEN least(_k21, _k22) WHEN _k1 IS NULL AND _c21 IS NOT NULL THEN least(_c21, _c22) + 273.15 END AS T_min_K,
    CASE WHEN _k21 IS NOT NULL THEN greatest(_k21, _k22) WHEN _k1 IS NULL AND _c21 IS NOT NULL THEN greatest(_c21, _c22) + 273.15 END AS T_max_K,
    CASE WHEN _k21 IS NOT NULL THEN (_k21 + _k22) / 2 WHEN _k1 IS NOT NULL THEN _k1 WHEN _c21 IS NOT NULL THEN (_c21 + _c22) / 2 + 273.15 ELSE _c1 + 273.15 END AS T_K,
    CASE WHEN _mpa21 IS NOT NULL THEN least(_mpa21, _mpa22) END AS P_min_MPa, CASE WHEN _mpa21 IS NOT NULL THEN greatest(_mpa21, _mpa22) END AS P_max_MPa,
    CASE WHEN _mpa21 IS NOT NULL THEN (_mpa21 + _mpa22) / 2 WHEN _mpa1 IS NOT NULL THEN _mpa1 WHEN _bar IS NOT NULL THEN _bar * CAST(0.1 AS DOUBLE) ELSE _atm * CAST(0.101325 AS DOUBLE) END AS P_MPa,
    nullif(trim(substr(trim({_x("coal_en", 1)}, ' '), 1, 60), ' '), '') AS coal_name,
    {_d("sc")} AS sc, {_d("er")} AS er, {_d("oc")} AS oc
  FROM raw)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk view."""
    return view(spark, sf_dir, CHUNKS)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk view with its metadata."""
    return md.extract_metadata(chunks(spark, sf_dir))


def _list(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


def _sql_list(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"


def _tag(name: str, fn, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = fn(F.col("text"), low=F.col("low"))
        return chunks(spark, sf_dir).withColumn("low", lowered(F.col("text"))).select("chunk_id", (found if name == "tag_stage" else F.array_join(found, ",")).alias("value"))

    run.__doc__ = f"{name} of every chunk."
    QUERIES[name] = run
    ORACLE[name] = f"WITH {SQL_META} SELECT chunk_id, {sql} AS value FROM meta"


_tag("tag_stage", tag_stage, "stage")
_tag("tag_gas_agents", tag_gas_agents, "array_to_string(gas_agent, ',')")
_tag("tag_targets", tag_targets, "array_to_string(targets, ',')")


def _condition(name: str, fn, point: str, low: str, high: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(chunks(spark, sf_dir), out="c")
        return out.select("chunk_id", *[F.round(f"c.{k}", 6).alias(k) for k in ("point", "min", "max")], F.col("c.evidence.evidence_text").isNotNull().alias("proved"))

    run.__doc__ = f"{name} of every chunk."
    QUERIES[name] = run
    ORACLE[name] = f"WITH {SQL_META} SELECT chunk_id, round({point}, 6) AS point, round({low}, 6) AS min, round({high}, 6) AS max, {point} IS NOT NULL AS proved FROM meta"


_condition("extract_temperature", md.extract_temperature, "T_K", "T_min_K", "T_max_K")
_condition("extract_pressure", md.extract_pressure, "P_MPa", "P_min_MPa", "P_max_MPa")


def extract_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated ratios of every chunk."""
    r = F.col("ratios")
    return md.extract_ratios(chunks(spark, sf_dir)).select("chunk_id", r["S/C"].alias("sc"), r["ER"].alias("er"), r["O/C"].alias("oc"), F.coalesce(F.size("ratios"), F.lit(0)).alias("n"))


def extract_coal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every chunk."""
    return md.extract_coal_name(chunks(spark, sf_dir)).select("chunk_id", "coal_name")


def extract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metadata of every chunk in one pass."""
    numbers = [F.round(c, 6).alias(c) for c in ("T_K", "T_min_K", "T_max_K", "P_MPa", "P_min_MPa", "P_max_MPa")]
    r, conf = F.col("ratios"), F.col("meta_confidence")
    return tagged(spark, sf_dir).select(
        "chunk_id", "stage", _list("gas_agent"), _list("targets"), *numbers, "coal_name", r["S/C"].alias("sc"), r["ER"].alias("er"), r["O/C"].alias("oc"),
        conf["stage"].alias("conf_stage"), conf["T_K"].alias("conf_t"), conf["P_MPa"].alias("conf_p"), F.size("meta_evidence").alias("n_evidence"),
    )


QUERIES |= {"extract_ratios": extract_ratios, "extract_coal_name": extract_coal_name, "extract_metadata": extract_metadata}
_RATIOS = "CAST((sc IS NOT NULL)::INT + (er IS NOT NULL)::INT + (oc IS NOT NULL)::INT AS INT)"
ORACLE["extract_ratios"] = f"WITH {SQL_META} SELECT chunk_id, sc, er, oc, {_RATIOS} AS n FROM meta"
ORACLE["extract_coal_name"] = f"WITH {SQL_META} SELECT chunk_id, coal_name FROM meta"
_NUMBERS = ", ".join(f"round({c}, 6) AS {c}" for c in ("T_K", "T_min_K", "T_max_K", "P_MPa", "P_min_MPa", "P_max_MPa"))
ORACLE["extract_metadata"] = f"""WITH {SQL_META}
SELECT chunk_id, stage, {_sql_list("gas_agent")}, {_sql_list("targets")}, {_NUMBERS}, coal_name, sc, er, oc,
  CAST(CASE WHEN stage <> 'unknown' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS conf_stage,
  CAST(CASE WHEN T_min_K IS NOT NULL THEN 0.85 WHEN T_K IS NOT NULL THEN 0.9 END AS DOUBLE) AS conf_t,
  CAST(CASE WHEN P_min_MPa IS NOT NULL THEN 0.85 WHEN P_MPa IS NOT NULL THEN 0.88 END AS DOUBLE) AS conf_p,
  CAST((T_K IS NOT NULL)::INT + (P_MPa IS NOT NULL)::INT + (coal_name IS NOT NULL)::INT + {_RATIOS} AS INT) AS n_evidence
FROM meta"""


def merge_page_chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks completed from their page: here the first chunk of the page in key order."""
    rows = tagged(spark, sf_dir)
    fields = ["stage", "gas_agent", "targets", *md.SINGLE]
    page = rows.groupBy("source_file", "page").agg(F.min_by(F.struct(*fields), "chunk_id").alias("page_meta"))
    out = md.merge_page_chunk_metadata(rows.join(page, ["source_file", "page"]))
    return out.select("chunk_id", "stage", _list("gas_agent"), _list("targets"), F.round("T_K", 6).alias("T_K"), F.round("P_MPa", 6).alias("P_MPa"), "coal_name")


QUERIES["merge_page_chunk_metadata"] = merge_page_chunk_metadata
_UNITED = "CASE WHEN m.{c} IS NULL THEN p.{c} WHEN p.{c} IS NULL THEN m.{c} ELSE list_sort(list_distinct(list_concat(m.{c}, p.{c}))) END"
ORACLE["merge_page_chunk_metadata"] = f"""WITH {SQL_META},
p AS (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY source_file, page ORDER BY chunk_id) = 1)
SELECT m.chunk_id, CASE WHEN m.stage = 'unknown' THEN p.stage ELSE m.stage END AS stage,
  array_to_string({_UNITED.format(c="gas_agent")}, ',') AS gas_agent, array_to_string({_UNITED.format(c="targets")}, ',') AS targets,
  round(coalesce(m.T_K, p.T_K), 6) AS T_K, round(coalesce(m.P_MPa, p.P_MPa), 6) AS P_MPa, coalesce(m.coal_name, p.coal_name) AS coal_name
FROM meta m JOIN p ON m.source_file = p.source_file AND m.page = p.page"""


def flatten_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag columns of every chunk."""
    flags = flag_columns()
    return tagged(spark, sf_dir).select("chunk_id", *[c.alias(n) for n, c in flags.items()])


QUERIES["flatten_flags"] = flatten_flags
_FLAGS = [f"coalesce(list_contains(gas_agent, '{g}'), false) AS gas_{g}" for g in DOMAIN["gas_agent"]] + [f"coalesce(list_contains(targets, '{t}'), false) AS has_{t}" for t in DOMAIN["targets"]]
ORACLE["flatten_flags"] = f"WITH {SQL_META} SELECT chunk_id, {', '.join(_FLAGS)} FROM meta"


def fill_missing_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled from an external table: here one made from the records view's keys."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    external = lines.where("l_linenumber > 2").select(key.alias("chunk_id"), F.lit("pyrolysis").alias("stage"), F.lit("bituminous").alias("coal_name"), (F.col("l_partkey") % 100 + 500.0).alias("T_K"), F.lit(1.0).alias("P_MPa"))
    out = md.fill_missing_metadata(tagged(spark, sf_dir), external)
    return out.select("chunk_id", "stage", "coal_name", F.round("T_K", 6).alias("T_K"), F.round("P_MPa", 6).alias("P_MPa"), F.col("meta_confidence")["coal_name"].alias("conf_name"))


QUERIES["fill_missing_metadata"] = fill_missing_metadata
ORACLE["fill_missing_metadata"] = f"""WITH {SQL_META},
x AS (SELECT concat_ws('_', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS chunk_id,
        CAST(l_partkey % 100 + 500 AS DOUBLE) AS t FROM lineitem WHERE l_linenumber > 2)
SELECT m.chunk_id, CASE WHEN stage = 'unknown' AND t IS NOT NULL THEN 'pyrolysis' ELSE stage END AS stage,
  CASE WHEN coal_name IS NULL AND t IS NOT NULL THEN 'bituminous' ELSE coal_name END AS coal_name, round(coalesce(T_K, t), 6) AS T_K,
  round(coalesce(P_MPa, CASE WHEN t IS NOT NULL THEN 1 END), 6) AS P_MPa,
  CAST(CASE WHEN coal_name IS NOT NULL THEN 0.8 WHEN t IS NOT NULL THEN 0.7 END AS DOUBLE) AS conf_name
FROM meta m LEFT JOIN x USING (chunk_id)"""
