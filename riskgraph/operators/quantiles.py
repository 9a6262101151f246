"""Exact quantiles by counts of value ranges, refined only in the ranges that hold the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of one level within one range of the level before; three levels part values that differ by a ten-billionth.
FINER = 1024
#: Rows of a key beyond which its quantiles are not left to one task's map of its values.
HOT = 1_000_000


def _range(value: Column, level: int) -> Column:
    """A whole number that rises with the value: 64 ranges for each factor of e above 1 (and about 1/64 below), each split by ``FINER`` a level."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(64.0 * FINER**level)).cast("long")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], levels: int = 3) -> DataFrame:
    """Per group of ``by`` (nulls are a group) the ``wanted`` quantiles of its non-null values, linearly interpolated.

    Equal values are counted first, where they lie. Ranges are summed over all their values, and only the ranges that hold
    a wanted rank go on to the next level, so no task gets a group's distinct values, however hot the group: at the end it
    gets those of one range of the last level. Groups without values have no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.struct(*(F.col(c) for c in by), F.lit(0).alias("__")).alias("key"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    n = counted.groupBy("key").agg(F.sum("n").alias("total"))
    places = n.select("key", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(float(p))).alias("place")) for name, p in wanted.items()))).alias("w")).select("key", "w.*")
    ranks = places.select("key", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct().withColumn("before", F.lit(0).cast("long"))
    held, path = counted, ["key"]
    for level in range(levels):
        name = f"r{level}"
        held = held.withColumn(name, _range(F.col("v"), level))
        sizes = held.groupBy(*path, name).agg(F.sum("n").alias("size"))
        within = Window.partitionBy(*path).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        met = ranks.join(sizes, path)
        start = F.col("before") + F.col("inside")
        ranks = met.where((F.col("rank") >= start) & (F.col("rank") < start + F.col("size"))).select(*path, name, "rank", start.alias("before"))
        path = [*path, name]
        if level < levels - 1:
            held = held.join(ranks.select(*path).distinct(), path, "left_semi")
    last = Window.partitionBy(*path).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    held = held.join(ranks.select(*path).distinct(), path, "left_semi").withColumn("inside", F.coalesce(F.sum("n").over(last), F.lit(0)))
    found = ranks.join(held, path).where((F.col("rank") >= F.col("before") + F.col("inside")) & (F.col("rank") < F.col("before") + F.col("inside") + F.col("n"))).select("key", "rank", "v")
    low = found.select("key", F.col("rank").alias("low"), F.col("v").alias("a"))
    high = found.select("key", F.col("rank").alias("high"), F.col("v").alias("b"))
    both = places.withColumns({"low": F.floor("place"), "high": F.ceil("place")}).join(low, ["key", "low"]).join(high, ["key", "high"])
    between = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("low"))
    return both.groupBy("key").agg(*(F.max(F.when(F.col("name") == name, between)).alias(name) for name in wanted)).select(*(F.col(f"key.`{c}`").alias(c) for c in by), *wanted)


def with_quantiles(df: DataFrame, by: str, value: str, wanted: dict[str, float], others: list[Column], hot: int = HOT) -> DataFrame:
    """Per non-null ``by`` the ``others`` and ``wanted``. A group of more than ``hot`` rows is refined by ranges; the map of values that one task keeps for any other is as bounded as ``hot``."""
    large = df.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(by)
    few = large.collect()  # a billion rows have a thousand at most

    def plain(rows: DataFrame) -> DataFrame:
        """All quantiles from one map of the values."""
        found = rows.groupBy(by).agg(*others, F.percentile(value, F.array(*(F.lit(float(p)) for p in wanted.values()))).alias("__q"))
        return found.select(*(c for c in found.columns if c != "__q"), *(F.col("__q")[i].alias(name) for i, name in enumerate(wanted)))

    if not few:
        return plain(df)
    named = F.broadcast(df.sparkSession.createDataFrame(few, large.schema))
    rest, rows = df.join(named, by, "left_anti"), df.join(named, by, "left_semi")
    return plain(rest).unionByName(rows.groupBy(by).agg(*others).join(quantiles(rows, [by], value, wanted), by, "left"))
