"""Keeping tables current: manifest diffs, keyed upserts, deletions, caches and versioned publication."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import cache_key


def latest_rows(rows: DataFrame, key: str | list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the last in ``order``; of equal ones, or without an order, the highest digest of the whole row, so
    that the choice does not depend on how rows arrive."""
    digest = F.md5(F.to_json(F.struct("*")))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order], digest.desc()))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ()) -> DataFrame:
    """``existing`` with the rows of ``new`` inserted or replaced by key; of several new rows ``latest_rows`` chooses.
    Only the new rows are sorted; the old ones are kept by an anti join."""
    last = latest_rows(new, key, order)
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def diff_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status, sha256, old_sha256, mtime_ns, size): new, changed, metadata_only, unchanged or removed."""
    f = files.select("path", F.struct("mtime_ns", "size", "sha256").alias("f"))
    m = manifest.select("path", F.struct("mtime_ns", "size", "sha256").alias("m"))
    same = (F.col("f.mtime_ns") == F.col("m.mtime_ns")) & (F.col("f.size") == F.col("m.size"))
    status = F.when(F.col("f").isNull(), "removed").when(F.col("m").isNull(), "new").when(same, "unchanged").when(F.col("f.sha256") == F.col("m.sha256"), "metadata_only").otherwise("changed")
    return f.join(m, "path", "full_outer").select("path", status.alias("status"), F.col("f.sha256").alias("sha256"), F.col("m.sha256").alias("old_sha256"), F.coalesce("f.mtime_ns", "m.mtime_ns").alias("mtime_ns"), F.coalesce("f.size", "m.size").alias("size"))


def guard_signatures(old: dict[str, str], now: dict[str, str], rebuild: bool = False) -> None:
    """Stop before a run that would mix outputs of different embedding, chunking or schema settings."""
    changed = sorted(k for k, v in old.items() if v and now.get(k) != v)
    if changed and not rebuild:
        raise ValueError(f"changed since the last run, rebuild needed: {', '.join(changed)}")


def removed_paths(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of the manifest that no longer exist."""
    return manifest.select("path").join(files.select("path"), "path", "left_anti").distinct()


def delete_by_document(chunks: DataFrame, documents: DataFrame, gone: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, documents) without the documents in ``gone``; the documents stay as tombstones with status ``removed``."""
    ids = gone.select(key).distinct()
    marked = documents.join(ids.withColumn("_gone", F.lit(True)), key, "left")
    status = F.when(F.col("_gone"), "removed").otherwise(F.col("status"))
    return chunks.join(ids, key, "left_anti"), marked.withColumn("status", status).drop("_gone")


def cache_lookup(chunks: DataFrame, cache: DataFrame, model: str, version: str, schema: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with ``payload``, misses): chunks whose key is cached, payloads parsed; a corrupt payload is a miss."""
    keyed = chunks.withColumn("cache_key", cache_key("chunk_id", F.lit(model), F.lit(version), text_col))
    held = cache.select("cache_key", F.from_json("payload_json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("payload"), F.col("payload_json"))
    good = held.where(F.col("payload").isNotNull() & F.try_parse_json("payload_json").isNotNull()).drop("payload_json")
    joined = keyed.join(good, "cache_key", "left")
    return joined.where("payload IS NOT NULL"), joined.where("payload IS NULL").drop("payload")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with payload_json and created_at of ``new`` by cache_key, the latest of several."""
    return upsert(cache, new, "cache_key", ("created_at", "payload_json"))


def distinct_models(models: DataFrame, new: DataFrame) -> DataFrame:
    """``models`` plus the (embedding_model, embedding_dim, embedding_version) of ``new`` it lacks."""
    key = ["embedding_model", "embedding_dim", "embedding_version"]
    return models.select(*key).unionByName(new.select(*key).distinct().join(models.select(*key), key, "left_anti"))


def version_name(prefix: str, embedding_version: str, schema_hash: str, stamp: str) -> str:
    """Name of one version of a table."""
    return f"{prefix}__emb{embedding_version}__schema{schema_hash}__{stamp}"


def publish_version(df: DataFrame, root: str, name: str, ok: bool = True) -> DataFrame:
    """Write one version below ``root`` and, if ``ok``, make it the current one; the former becomes the previous.
    Returns the pointer table (current, previous).

    The pointer is a file for each change, numbered from 0, of which the highest counts. A file is created only where none of its
    number exists, so of two publishers that saw the same state one takes the next number and the other, finding it taken, looks
    again: no change is lost, and which one is current does not depend on chance."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    if not ok:
        return pointer(df.sparkSession, root)
    return _point(df.sparkSession, root, lambda now: (name, now["current"] if now else None))


def rollback(spark: SparkSession, root: str) -> DataFrame:
    """Make the previous version current again."""

    def back(now):
        if now is None or now["previous"] is None:
            raise ValueError("no previous version")
        return now["previous"], now["current"]

    return _point(spark, root, back)


_POINTER = "seq LONG, current STRING, previous STRING"


def pointer(spark: SparkSession, root: str) -> DataFrame:
    """(current, previous), empty before the first publication."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "current STRING, previous STRING")
    return _changes(spark, root).orderBy(F.desc("seq")).limit(1).select("current", "previous")


def _changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_POINTER).json(f"{root}/_pointer").where("seq IS NOT NULL")


def _newest(spark: SparkSession, root: str):
    return None if pointer(spark, root).isEmpty() else _changes(spark, root).orderBy(F.desc("seq")).first()


def _put(spark: SparkSession, root: str, seq: int, current: str, previous: str | None) -> bool:
    """Create the pointer file of this number; false where it exists."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer/{seq:012d}.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    try:
        out = fs.create(path, False)
    except Exception:  # created by another publisher since
        if fs.exists(path):
            return False
        raise
    out.write(bytearray(json.dumps({"seq": seq, "current": current, "previous": previous}).encode() + b"\n"))
    out.close()
    return True


def _point(spark: SparkSession, root: str, change, tries: int = 20) -> DataFrame:
    """Append what ``change`` makes of the newest pointer, as often as another publisher comes first."""
    for turn in range(tries):
        now = _newest(spark, root)
        if _put(spark, root, now["seq"] + 1 if now else 0, *change(now)):
            return pointer(spark, root)
        time.sleep(0.05 * turn)  # the file of the other may still be empty
    raise RuntimeError(f"{tries} other publications came first")
