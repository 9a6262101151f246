"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(column: str | Column) -> Column:
    """The trimmed string, null when empty."""
    return F.nullif(F.trim(F.col(column) if isinstance(column, str) else column), F.lit(""))


def money(column: str | Column) -> Column:
    """Amounts as decimals, whose sums don't depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def total(column: str | Column) -> Column:
    return F.sum(money(column)).cast("double")


def r4(column: Column) -> Column:
    """To four decimals, ties up: both engines agree although their last bits differ."""
    return F.floor(column * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def by_card() -> Window:
    """A card's transactions in order of time, of equal times by id."""
    return Window.partitionBy("card_id").orderBy("ts", "txn_id")


def seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two NTZ timestamps, rounded towards zero."""
    return F.timestamp_diff("SECOND", earlier, later)


def joined(column: Column) -> Column:
    """A collected array as a sorted, comma-separated string."""
    return F.array_join(F.array_sort(column), ",")


def ranked(df: DataFrame, bucket: Column, order: list, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``__rank``, its place from 0 in the order of ``bucket`` (a small range of whole numbers that ``order`` rises with) and ``order``, and ``__n``, within ``by``.

    Only a bucket's rows meet in one task; what the buckets before it hold is summed over one row per bucket, of which there are few.
    """
    by = by or []
    marked = df.withColumn("__bucket", bucket)
    sizes = marked.groupBy(*by, "__bucket").agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*by)
    before = sizes.select(*by, "__bucket", F.coalesce(F.sum("__size").over(w.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__size").over(w).alias("__n"))
    place = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order)) - 1
    return marked.join(before, [*by, "__bucket"]).withColumn("__rank", F.col("__before") + place).drop("__bucket", "__before")
