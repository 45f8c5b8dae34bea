"""Byte-level tokenisers shared by the Arrow helpers. Working on UTF-8 bytes keeps A-Z lower-casing ASCII-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Everything in ASCII that is not a letter or a digit becomes a space.
_ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def utf8(text: str | Column) -> Column:
    """The text as UTF-8 bytes, for the helpers here."""
    return (F.col(text) if isinstance(text, str) else text).cast("string").cast("binary")


def blank_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but space and 0x09-0x0D; null has none."""
    return [] if text is None else text.split()


def lower_blank_words(text: bytes | None) -> list[bytes]:
    """The same with A-Z lower-cased."""
    return [] if text is None else text.lower().split()


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters; null has none."""
    return [] if text is None else text.lower().translate(_ALNUM).split()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small: documents may be very long. The option holds for the session and is read when
    a plan runs, so all operators here set the same number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def packed(df: DataFrame) -> Column:
    """All columns as the struct ``_row``, so that working columns beside it can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unpacked(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns in ``_row`` again, with those of ``new`` in place or added."""
    made = df.select("_row", F.struct(F.lit(0).alias("0"), *[x.alias(c) for c, x in new.items()]).alias("_new"))
    return made.select(*[F.col(f"_new.`{c}`" if c in new else f"_row.`{c}`").alias(c) for c in [*columns, *[c for c in new if c not in columns]]])
