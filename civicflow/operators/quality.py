"""Measures of labels, scores and geocoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected, predicted, n)"""
    return pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def label_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label on either side, from counts of the confusion table."""
    cells = confusion(pairs)
    sides = cells.select(F.col("expected").alias("label"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed"))
    sides = sides.unionByName(cells.select(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")))
    g = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    p = F.when(F.col("claimed") > 0, F.col("tp") / F.col("claimed")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("claimed") + F.col("support"))).otherwise(0.0)
    return g.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, samples, accuracy, confidence, squared) from (score, correct) rows, equal widths, 1.0 in the last bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("bigint")
    return rows.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("correct").alias("accuracy"), F.avg("score").alias("confidence"), F.sum(F.pow(F.col("score") - F.col("correct"), 2)).alias("squared")
    )


def ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = calibration_bins(rows, bins)
    n = F.sum("samples")
    return b.agg(F.round(F.sum(F.col("samples") * F.abs(F.col("accuracy") - F.col("confidence"))) / n, 6).alias("ece"), F.round(F.sum("squared") / n, 6).alias("brier"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(column, share) over all rows with a value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("n") / F.col("t")).alias("share"))  # a one-row total


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    x, y = distribution(a, column).withColumnRenamed("share", "p"), distribution(b, column).withColumnRenamed("share", "q")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return x.join(y, column, "full").agg(F.round(F.sum(gap) / 2, 6).alias("drift"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """Nearest-rank percentile of a group, ranks rounded half to even (aggregate)."""
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.bround((F.size(ordered) - 1) * fraction) + 1).cast("int")))


def all_gates_pass(metrics: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, passed) rows of a one-row table of metrics; gate: (">=" or "<=", bound)."""
    rows = [F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), ((F.col(name) >= v) if op == ">=" else (F.col(name) <= v)).alias("passed")) for name, (op, v) in gates.items()]
    return metrics.select(F.inline(F.array(*rows)))
