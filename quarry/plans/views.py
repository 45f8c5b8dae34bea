"""Derived inputs of the registered queries, the same in Spark and in the SQL: domain text, questions, records and manifests
made from the given tables by integer arithmetic and CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = "concat_ws('_', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))"

#: One chunk of domain text for each line item.
CHUNKS = f"""
SELECT {_KEY} AS chunk_id,
  concat('paper_', CAST(l_suppkey % 50 AS STRING), '.pdf') AS source_file,
  CAST(l_orderkey % 40 AS INT) AS page,
  CASE l_orderkey % 6 WHEN 0 THEN 'methods' WHEN 1 THEN 'results' WHEN 2 THEN 'discussion'
       WHEN 3 THEN 'references' WHEN 4 THEN 'unknown' ELSE 'conditions' END AS section,
  concat(
    CASE l_partkey % 7 WHEN 0 THEN 'Pyrolysis' WHEN 1 THEN 'Gasification' WHEN 2 THEN 'Combined treatment'
         WHEN 3 THEN 'Partial oxidation' WHEN 4 THEN 'Combustion' WHEN 5 THEN 'Ignition' ELSE 'A test' END,
    CASE l_suppkey % 6 WHEN 0 THEN ' with steam' WHEN 1 THEN ' in oxygen' WHEN 2 THEN ' under carbon dioxide'
         WHEN 3 THEN ' in nitrogen' WHEN 4 THEN ' with water vapor and nitrogen' ELSE '' END,
    CASE l_orderkey % 4
         WHEN 0 THEN concat(' at ', CAST(600 + (l_partkey % 90) * 10 AS STRING), ' K')
         WHEN 1 THEN concat(' between ', CAST(700 + l_partkey % 300 AS STRING), ' and ', CAST(1100 + l_partkey % 300 AS STRING), ' K')
         WHEN 2 THEN concat(' at ', CAST(500 + l_partkey % 400 AS STRING), ' C') ELSE '' END,
    CASE l_linenumber % 4
         WHEN 0 THEN concat(' and ', CAST(l_linenumber AS STRING), '.5 MPa')
         WHEN 1 THEN concat(' and ', CAST(10 + l_linenumber AS STRING), ' bar')
         WHEN 2 THEN concat(' and ', CAST(l_linenumber AS STRING), ' atm') ELSE '' END,
    CASE l_partkey % 5 WHEN 0 THEN ', S/C = 1.5' WHEN 1 THEN ', ER 0.3' WHEN 2 THEN ', O/C=0.8' ELSE '' END,
    CASE l_partkey % 11 WHEN 0 THEN ' coal: lignite A' ELSE '' END,
    ' released ',
    CASE l_suppkey % 5 WHEN 0 THEN 'NH3 and HCN' WHEN 1 THEN 'H2S' WHEN 2 THEN 'phenol' WHEN 3 THEN 'SO2 and NOx' ELSE 'tar' END,
    ' of ', CAST(20 + l_partkey % 500 AS STRING), ' ppmv.') AS text
FROM {{lineitem}}"""

#: One question for each nation.
QUESTIONS = """
SELECT CAST(n_nationkey AS STRING) AS qid,
  concat(
    CASE n_nationkey % 4 WHEN 0 THEN '必须 ' WHEN 1 THEN 'only ' ELSE '' END,
    CASE n_nationkey % 5 WHEN 0 THEN 'steam gasification' WHEN 1 THEN 'pyrolysis in nitrogen' WHEN 2 THEN 'combustion and oxidation'
         WHEN 3 THEN '气化 carbon dioxide' ELSE 'formation mechanism' END,
    CASE n_nationkey % 3 WHEN 0 THEN concat(' ', CAST(900 + n_nationkey * 10 AS STRING), 'K') WHEN 1 THEN ' 700-1200 K' ELSE '' END,
    CASE n_regionkey WHEN 0 THEN ' 2MPa' WHEN 1 THEN ' 0.5-1.5 MPa' ELSE '' END,
    CASE n_nationkey % 6 WHEN 0 THEN ' NH3 HCN' WHEN 1 THEN ' H2S released' WHEN 2 THEN ' phenol' ELSE ' tar of ppmv' END) AS raw
FROM {nation}"""

#: One record for each line item; few conditions, so that signatures repeat.
RECORDS = f"""
SELECT {_KEY} AS record_id,
  concat('paper_', CAST(l_suppkey % 50 AS STRING), '.pdf') AS source_file,
  CASE l_partkey % 3 WHEN 0 THEN 'pyrolysis' WHEN 1 THEN 'gasification' ELSE 'unknown' END AS stage,
  CASE l_suppkey % 3 WHEN 0 THEN 'Lignite ' ELSE NULL END AS coal_name,
  CASE l_suppkey % 2 WHEN 0 THEN 'fixed bed' ELSE NULL END AS reactor_type,
  CASE WHEN l_partkey % 9 = 0 THEN CAST(100 AS DOUBLE) WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(900 + (l_partkey % 5) * 100 AS DOUBLE) END AS T_K,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(0.1 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE NULL END AS P_MPa,
  CASE l_suppkey % 4 WHEN 0 THEN 'steam' WHEN 1 THEN 'n2' ELSE 'co2' END AS gas,
  CAST((l_partkey % 3) AS DOUBLE) * 0.25 + 0.5 AS ratio,
  CASE l_suppkey % 5 WHEN 0 THEN 'NH3' WHEN 1 THEN 'H2S' WHEN 2 THEN 'phenols' WHEN 3 THEN 'NOx' ELSE 'benzene' END AS pollutant,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(20 + l_partkey % 60 AS DOUBLE) END AS value,
  CASE l_orderkey % 4 WHEN 0 THEN 'ppm' WHEN 1 THEN 'ppmv' WHEN 2 THEN 'mol%' ELSE 'mg/Nm3' END AS unit,
  l_orderkey * 10 + l_linenumber AS seq
FROM {{lineitem}}"""

_PATH = "concat('/data/', CAST(o_orderkey AS STRING), '.pdf')"

#: Files on disk now: all but every seventh.
FILES = f"""
SELECT {_PATH} AS path, o_orderkey * 1000 + CASE o_orderkey % 5 WHEN 1 THEN 7 ELSE 0 END AS mtime_ns,
  o_custkey + 100 AS size, md5(concat(CAST(o_custkey AS STRING), CASE o_orderkey % 10 WHEN 1 THEN 'x' ELSE '' END)) AS sha256
FROM {{orders}} WHERE o_orderkey % 7 <> 0"""

#: What the last run saw: all but every third.
MANIFEST = f"""
SELECT {_PATH} AS path, o_orderkey * 1000 AS mtime_ns, o_custkey + 100 AS size, md5(CAST(o_custkey AS STRING)) AS sha256
FROM {{orders}} WHERE o_orderkey % 3 <> 0"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view above over the given tables."""
    names = [n for n in ("lineitem", "nation", "orders") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: spread(table(spark, sf_dir, n)) for n in names})


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files are too few to give each a task; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df


def said(sql: str) -> str:
    """The same view for the SQL side."""
    for n in ("lineitem", "nation", "orders"):
        sql = sql.replace("{" + n + "}", n)
    return sql
