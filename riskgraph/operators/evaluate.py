"""Metrics of scores against outcomes, as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import r4


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(scored: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Precision, recall and F1 of ``p`` >= threshold for ``y`` = 1."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    n = scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", r4(safe(tp, tp + fp)).alias("precision"), r4(safe(tp, tp + fn)).alias("recall"), r4(safe(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact AUC by rank sums with average ranks; null without both classes.

    Equal scores are counted first. Distinct scores are dealt to 4096 ranges; only a range's scores meet in
    one task, and what lies below a range is summed over one row per range.
    """
    by_score = scored.groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    by_score = by_score.withColumn("range", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * 4096))
    sizes = by_score.groupBy("range").agg(F.sum("n").alias("size"))
    under = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("under"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_score = by_score.withColumn("inside", inside).join(F.broadcast(under), "range")
    below = F.col("under") + F.col("inside")
    ranked = by_score.select("n", "pos", (F.col("pos") * (below + (F.col("n") + 1) / 2)).alias("ranks"))
    sums = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("ranks").alias("ranks"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return sums.select(r4(F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, (pos * neg).cast("double"))).alias("auc"))


def brier_score(scored: DataFrame) -> DataFrame:
    return scored.agg(r4(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0)))).alias("brier"))


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Non-empty uniform bins: mean score against share of positives."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r4(F.avg("p")).alias("mean_p"), r4(F.avg(F.col("y").cast("double"))).alias("share"))


def pattern_metrics(df: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Per pattern of (pattern, y, p): cases, fraud, mean score, recall and precision."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return df.groupBy("pattern").agg(
        F.count("*").alias("n"), F.count_if(pos).alias("fraud"), F.count_if(~pos).alias("cleared"), r4(F.avg("p")).alias("mean_p"),
        r4(safe(F.count_if(hit & pos), F.count_if(pos))).alias("recall"), r4(safe(F.count_if(hit & pos), F.count_if(hit))).alias("precision"),
    )


def threshold_curve(df: DataFrame, thresholds=(0.50, 0.65, 0.70, 0.80, 0.85)) -> DataFrame:
    """Per detector of (detector, y, confidence) and threshold: hits, rates, precision and F1. The few thresholds are exploded, not joined."""
    rows = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, pos = F.col("confidence") >= F.col("threshold"), F.col("y") == 1
    n = rows.groupBy("detector", "threshold").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    tp, fp = F.col("tp"), F.col("fp")
    return n.select("detector", "threshold", "tp", "fp", r4(safe(tp, F.col("pos"))).alias("hit_rate"), r4(safe(fp, F.col("neg"))).alias("fpr"), r4(safe(tp, tp + fp)).alias("precision"), r4(safe(2 * tp, tp + fp + F.col("pos"))).alias("f1"))


def confusion(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cases per true and predicted pattern, a column per predicted one."""
    return df.groupBy("pattern").pivot("predicted", columns).agg(F.count("case_id")).fillna(0)


def batch_stats(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Mean, extremes, median, p95 and sum of a measure."""
    rows = df.groupBy(by) if by else df.groupBy()
    q = lambda x: r4(F.percentile(column, F.lit(x)))
    return rows.agg(F.count("*").alias("n"), r4(F.avg(column)).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), q(0.5).alias("p50"), q(0.95).alias("p95"), r4(F.sum(column)).alias("sum"))


def classify_pattern(p: Column, scores: dict[str, Column], least: float = 0.65, none_below: float = 0.25, undocumented_from: float = 0.70) -> Column:
    """The pattern of the highest score, of equals the first named; ``none`` for small p, ``undocumented`` for a high p without a clear score."""
    ranked = F.array_max(F.array(*(F.struct(c.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, c) in enumerate(scores.items()))))
    return F.when(p < none_below, "none").when(ranked["s"] >= least, ranked["name"]).when(p >= undocumented_from, "undocumented").otherwise("none")
