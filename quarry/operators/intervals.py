"""Joins of overlapping ranges by equality.

A range of length d lies on level ceil(log2(d / width)) and covers at most two cells of that level, and of any higher one. Two
ranges meet on the higher of their levels, so each side names its cells on its own level and on the higher levels that the
other side has, and they are joined by level and cell. Where they share two cells only the later of their first cells counts,
so no pair is listed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(lo: Column, hi: Column, width: float) -> Column:
    """The level of [lo, hi]; null where a bound is null."""
    length = F.greatest((hi - lo) / F.lit(float(width)), F.lit(1.0))
    return F.ceil(F.log2(length)).cast("int")


def levels(df: DataFrame, lo: Column, hi: Column, width: float) -> list[int]:
    """All levels of the ranges of ``df``: a few dozen numbers at most, whatever its size."""
    found = df.select(level(lo, hi, width).alias("level")).where("level IS NOT NULL").distinct()
    return sorted(r["level"] for r in found.collect())


def first_cell(lo: Column, at: Column, width: float) -> Column:
    """The cell of level ``at`` that holds ``lo``."""
    return F.floor(lo / (F.lit(float(width)) * F.pow(F.lit(2.0), at))).cast("long")


def cells(lo: Column, hi: Column, others: list[int], width: float) -> Column:
    """(level, cell) of a range on its own level and on the higher ones of ``others``; empty where a bound is null."""
    own = level(lo, hi, width)
    higher = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own)
    at = F.array_union(F.array(own), higher)
    spread = F.transform(at, lambda x: F.transform(F.sequence(first_cell(lo, x, width), first_cell(hi, x, width)), lambda c: F.struct(x.alias("level"), c.alias("cell"))))
    return F.when(lo.isNotNull() & hi.isNotNull() & (lo <= hi), F.flatten(spread)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))


def first_meeting(at: Column, cell: Column, a: tuple[Column, Column], b: tuple[Column, Column], width: float) -> Column:
    """Whether this level and cell are the ones that count for the ranges a and b."""
    meets = at == F.greatest(level(*a, width), level(*b, width))
    return meets & (cell == F.greatest(first_cell(a[0], at, width), first_cell(b[0], at, width)))
