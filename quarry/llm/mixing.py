"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of each source are put in a repeatable random order and cut into blocks. Of source i with weight w of a total T,
block j (from 0) is released at slot floor(j T / w) and due at slot ceil((j + 1) T / w). Each slot goes to the released
block that is due first, so at every slot each source has had its share to within less than one block. The schedule
repeats every T slots; when a source has no more blocks, a new phase starts at the next slot with the weights of the others.
Every document gets exactly one place: nothing is dropped or repeated. Whoever wants the target weights alone stops at the
end of phase 0.

The schedule is made from one row that holds the weights and the block counts of the sources, so its cost depends on the
number of sources and the size of the weights and not on the documents. Up to ``max_sources`` sources and a total weight of
``max_total`` it is a fold in SQL. Beyond that the same schedule is made slot by slot with a heap of deadlines in one Python
task; that takes as long as slots differ, at worst (sources x total weight) steps, and memory for one period.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.tokens import packed, unpacked
from quarry.scratch import materialize

#: Rows that one task puts in order.
BUCKET_ROWS = 2_000

_PERIOD = """
aggregate(sequence(0, {total} - 1), struct(transform({active}, x -> 0L) AS done, CAST(array() AS ARRAY<INT>) AS slots), (s, t) ->
  transform(array(array_min(filter(transform({active}, (w, i) ->
      IF(w > 0 AND (s.done[i] * {total}) div w <= t, struct(((s.done[i] + 1) * {total} + w - 1) div w AS due, i AS i), NULL)), x -> x IS NOT NULL)).i),
    pick -> struct(transform(s.done, (d, i) -> IF(i = pick, d + 1, d)) AS done, concat(s.slots, array(pick)) AS slots))[0]).slots"""


def _fold(one: DataFrame) -> DataFrame:
    """``one``: a row with arrays w and n (blocks) over the sources. Returns it with ``phases``: start, total, slots (source of
    each slot of a period), used (blocks of each source before the phase) and took (in it)."""
    step = f"""
aggregate(sequence(1, size(n)), struct(0L AS start, transform(n, x -> 0L) AS used,
    CAST(array() AS ARRAY<STRUCT<start: BIGINT, total: BIGINT, slots: ARRAY<INT>, used: ARRAY<BIGINT>, took: ARRAY<BIGINT>>>) AS phases), (a, p) ->
  transform(array(transform(w, (x, i) -> IF(n[i] > a.used[i], x, 0L))), active ->
  transform(array(aggregate(active, 0L, (u, x) -> u + x)), total ->
  transform(array({_PERIOD.format(total="total", active="active")}), slots ->
  transform(array(array_min(filter(transform(active, (x, i) -> IF(x > 0,
      ((n[i] - a.used[i] - 1) div x) * total + filter(sequence(0, size(slots) - 1), k -> slots[k] = i)[CAST((n[i] - a.used[i] - 1) % x AS INT)] + 1, NULL)), x -> x IS NOT NULL))), len ->
  transform(array(transform(active, (x, i) -> (len div total) * x + size(filter(slice(slots, 1, CAST(len % total AS INT)), k -> k = i)))), took ->
    struct(a.start + len AS start, zip_with(a.used, took, (u, k) -> u + k) AS used,
      concat(a.phases, array(struct(a.start AS start, total AS total, slots AS slots, a.used AS used, took AS took))) AS phases)
  )[0])[0])[0])[0])[0]).phases"""
    return one.withColumn("phases", F.expr(step))


_PIECE = "STRUCT<phase: INT, start: BIGINT, total: BIGINT, first: BIGINT, took: BIGINT, weight: BIGINT, slots: ARRAY<INT>>"


def simulate(names: list[str], weights: list[int], blocks: list[int]) -> Iterator[tuple[str, int, int, int, int, int, int, list[int]]]:
    """(source, phase, start, total, first, took, weight, slots) of the same schedule, phase by phase, slot by slot."""
    used, start, phase = [0] * len(names), 0, 0
    active = [i for i, n in enumerate(blocks) if n]
    while active:
        total = sum(weights[i] for i in active)
        left = {i: blocks[i] - used[i] for i in active}
        done, slots = dict.fromkeys(active, 0), {i: [] for i in active}
        due = [(-(-total // weights[i]), i) for i in active]
        heapify(due)
        later: list[tuple[int, int]] = []  # (release, source)
        # the first source to run out, if the period repeats: whole periods before it are skipped
        periods = min((left[i] - 1) // weights[i] for i in active)
        if periods:
            left = {i: n - periods * weights[i] for i, n in left.items()}
        at, end = 0, None
        while at < total and (end is None or periods):
            while later and later[0][0] <= at:
                i = heappop(later)[1]
                heappush(due, (-(-(done[i] + 1) * total // weights[i]), i))
            i = heappop(due)[1]
            slots[i].append(at)
            done[i] += 1
            at += 1
            if end is None and done[i] == left[i]:
                end = at
            if done[i] < weights[i]:
                heappush(later, (done[i] * total // weights[i], i))
        for i in active:
            took = periods * weights[i] + sum(t < end for t in slots[i])
            if took:
                yield names[i], phase, start, total, used[i], took, weights[i], slots[i]
                used[i] += took
        active = [i for i in active if used[i] < blocks[i]]
        start, phase = start + periods * total + end, phase + 1


def _by_slots(one: DataFrame) -> DataFrame:
    """The schedule beyond the fold's bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["_source", "phase", "start", "total", "first", "took", "weight", "slots"]
        for pdf in batches:
            for s in pdf["s"]:
                rows = []
                for row in simulate([x["_source"] for x in s], [int(x["weight"]) for x in s], [int(x["n"]) for x in s]):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    made = one.mapInPandas(run, "_source string, phase int, start long, total long, first long, took long, weight long, slots array<int>")
    return made.select("_source", F.struct("phase", "start", "total", "first", "took", "weight", "slots").alias("piece"))


def schedule(blocks: DataFrame, fold: bool = True) -> DataFrame:
    """``blocks``: one row a source with _source, weight (positive long) and n (its blocks, at least 1). Returns
    (_source, phases): for each phase in which the source has blocks, its number, start, total, first (first block of the
    source in it), took, weight and slots (where in a period its blocks go)."""
    one = blocks.agg(F.array_sort(F.collect_list(F.struct("_source", "weight", "n"))).alias("s")).where(F.size("s") > 0)
    if fold:
        folded = materialize(_fold(one.select(F.col("s._source").alias("sources"), F.col("s.weight").alias("w"), F.col("s.n").alias("n"))), "schedule")
        each = folded.select("sources", "w", F.posexplode("phases").alias("phase", "p")).select("phase", "p", F.posexplode(F.arrays_zip("sources", "w")).alias("i", "s"))
        own = F.expr("filter(sequence(0, size(p.slots) - 1), k -> p.slots[k] = i)")
        piece = F.struct("phase", "p.start", "p.total", F.expr("p.used[i]").alias("first"), F.expr("p.took[i]").alias("took"), F.col("s.w").alias("weight"), own.alias("slots"))
        held = each.where(F.expr("p.took[i] > 0")).select(F.col("s.sources").alias("_source"), piece.cast(_PIECE).alias("piece"))
    else:
        held = materialize(_by_slots(one), "schedule")
    return held.groupBy("_source").agg(F.sort_array(F.collect_list("piece")).alias("phases"))


def _numbered(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """``rows`` with ``_n``, their number within the source from 0. Rows are dealt by source and a slice of the order key
    ``_key`` (hex), so that a source is as many tasks as its rows need; the slices' sizes are then summed up."""
    slices = max(1, -(-most // BUCKET_ROWS))
    bucket = F.conv(F.substring("_key", 1, 7), 16, 10).cast("long") * F.lit(slices)
    cut = rows.withColumn("_slice", F.shiftright(bucket, 28))
    sizes = cut.groupBy("_source", "_slice").agg(F.count("*").alias("_size"))
    before = W.partitionBy("_source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size"), "slices")
    inside = F.row_number().over(W.partitionBy("_source", "_slice").orderBy("_key", *order))
    return cut.withColumn("_r", inside).join(starts, ["_source", "_slice"]).withColumn("_n", F.col("_before") + F.col("_r") - 1).drop("_slice", "_r", "_before")


def mix(
    docs: DataFrame, weights: Mapping[str, int], default_weight: int = 1, block: int = 16, id_col: str = "doc_id",
    source_col: str = "source", text_col: str | None = "text", max_sources: int = 500, max_total: int = 2000,
) -> DataFrame:
    """``docs`` plus phase, block (of its source), slot and position (slot * block + place in the block; the order to read
    in, with gaps after the short last block of a source).

    ``weights`` are positive whole numbers by source name; other sources, null among them, get ``default_weight``. The order
    within a source is that of the md5 of the id, then the id and the text; rows that repeat all of these are interchangeable.
    A null id sorts as an empty one; texts are only hashed, whatever their length. An empty table gives an empty result.
    Columns of the new names are replaced; others may have any name. Any number of sources and any weights are scheduled;
    beyond ``max_sources`` or ``max_total`` in another way to the same schedule.
    """
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights must be positive whole numbers")
    spark = docs.sparkSession
    name = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    order = {"_id": F.col(id_col).cast("string"), "_text": F.xxhash64(text_col) if text_col else F.lit(0)}
    rows = docs.select(packed(docs), name.alias("_source"), key.alias("_key"), *[x.alias(c) for c, x in order.items()])
    stated = spark.createDataFrame([(str(k), int(v)) for k, v in weights.items()], "_source string, weight long")
    counts = rows.groupBy("_source").agg(F.count("*").alias("rows")).join(stated, "_source", "left").withColumn("weight", F.coalesce("weight", F.lit(default_weight).cast("long")))
    counts = materialize(counts.withColumn("n", F.ceil(F.col("rows") / block)), "sources")
    total = counts.agg(F.count("*").alias("sources"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    fold = total["sources"] <= max_sources and total["weight"] <= max_total
    numbered = _numbered(rows, list(order), total["most"]).withColumn("_block", F.floor(F.col("_n") / block))
    out = numbered.join(schedule(counts, fold), "_source")
    out = out.withColumn("_p", F.expr("filter(phases, p -> _block >= p.first AND _block < p.first + p.took)[0]"))
    slot = F.expr("_p.start + ((_block - _p.first) div _p.weight) * _p.total + _p.slots[CAST((_block - _p.first) % _p.weight AS INT)]")
    new = {"phase": F.col("_p.phase"), "block": F.col("_block"), "slot": slot, "position": slot * block + F.col("_n") % block}
    return unpacked(out, docs.columns, new)
