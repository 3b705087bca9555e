"""Row keys, and a bounded pre-filter that keeps a join from shuffling rows that cannot match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter table has at most 2**(FILTER_BITS - 6) rows of 16 bytes: a fixed bound at any input size.
FILTER_BITS = 24


def row_key() -> Column:
    """Key of a document row from its id and text; rows alike in both share it (and any result that depends on them alone)."""
    return F.xxhash64("doc_id", "text")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, key): each input row as a struct, whatever its columns are called, and its row key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key().alias("key"))


def _place(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << bits))


def _bitmap(column: str, keys: DataFrame, bits: int) -> DataFrame:
    """The keys as 2**bits bits: a table of at most 2**(bits - 6) longs, whatever the number of keys."""
    return (
        keys.select(_place(column, bits).alias("_p")).groupBy((F.col("_p") / 64).cast("long").alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_m"))
    )


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose long ``column`` may be among ``keys[column]``: all that are, and a few others.

    The bitmap is broadcast. With ever more keys it fills and lets more rows through; none that matches is lost.
    """
    return (
        df.withColumn("_p", _place(column, bits)).withColumn("_w", (F.col("_p") / 64).cast("long"))
        .join(F.broadcast(_bitmap(column, keys, bits)), "_w")
        .where("shiftright(_m, cast(_p % 64 as int)) & 1L = 1L").drop("_p", "_w", "_m")
    )


def without(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose long ``column`` is null or not among ``keys[column]``.

    Only rows that the bitmap lets through meet the keys in a join; the others are kept where they are, texts unshuffled.
    ``keys`` should be a stored table: it is read more than once.
    """
    marked = (
        df.withColumn("_p", _place(column, bits)).withColumn("_w", (F.col("_p") / 64).cast("long"))
        .join(F.broadcast(_bitmap(column, keys, bits)), "_w", "left")
        .withColumn("_maybe", F.expr("coalesce(shiftright(_m, cast(_p % 64 as int)) & 1L, 0L) = 1L"))
    )
    sure = marked.where("not _maybe").select(df.columns)
    return sure.unionByName(marked.where("_maybe").select(df.columns).join(keys, column, "left_anti").select(df.columns))
