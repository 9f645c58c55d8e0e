"""Tables with keys: idempotent upserts, retention, backoff, content-addressed artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key of both tables (one aggregation, no join)."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return best.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; the first of equal new keys is not told apart."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def retain(rows: DataFrame, status: str, time: str, before: dict[str, str]) -> DataFrame:
    """Rows that are not older than the limit of their status; rows of other states or without time stay."""
    expired = F.lit(False)
    for name, limit in before.items():
        expired = expired | ((F.col(status) == name) & (F.col(time) < F.lit(limit).cast("timestamp_ntz")))
    return rows.where(~F.coalesce(expired, F.lit(False)))


def backoff_s(attempt: Column, initial: float, multiplier: float, most: float) -> Column:
    return F.least(F.lit(most), initial * F.pow(F.lit(multiplier), attempt - 1))


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; reading them fails if a key is there twice."""
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    checked = counted.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.lit(True)))
    return checked.where("_ok").drop("_n", "_ok")
