"""Relational forms of the older event model: objects, links, risk and population."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from civicflow.functions.geodesy import antimeridian_parts, geodesic


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] over all rows; a constant column becomes 0, nulls stay."""
    bounds = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.crossJoin(F.broadcast(bounds))  # one row of bounds
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.when(span > 0, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(0.0)))
    return out.drop(*(f"_{n}_{c}" for c in columns for n in ("lo", "hi")))


def risk_product(intensity: Column, duration: Column, importance: Column) -> Column:
    """Product of the scaled parts; missing or zero parts count as a small constant."""
    part = lambda c: F.when(c.isNull() | (c == 0), 0.01).otherwise(c)
    return part(intensity) * part(duration) * part(importance)


def without_outliers(events: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose name does not mark noise ("-1..."), and the connections between those."""
    kept = events.where(~F.col("name").rlike("^-1"))
    ids = kept.select("event_id")
    ends = connections.join(ids.withColumnRenamed("event_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("event_id", "b"), "b", "left_semi")
    return kept, ends


def rebalance_population(events: DataFrame, connections: DataFrame, lower: dict[str, str]) -> DataFrame:
    """Population of each event less that of the linked events of the next lower level.

    events: (event_id, level, population); connections: (a, b); lower: level to the level below."""
    both = connections.select("a", "b").unionByName(connections.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    below = F.create_map(*(F.lit(x) for pair in lower.items() for x in pair))
    linked = events.select(F.col("event_id").alias("a"), below[F.col("level")].alias("want")).join(both, "a")
    linked = linked.join(events.select(F.col("event_id").alias("b"), F.col("level").alias("have"), F.col("population").alias("p")), "b").where("want = have")
    taken = linked.groupBy(F.col("a").alias("event_id")).agg(F.sum("p").alias("taken"))
    return events.join(taken, "event_id", "left").withColumn("population", F.greatest(F.lit(0), F.col("population") - F.coalesce("taken", F.lit(0)))).drop("taken")


def population_levels(buildings: DataFrame) -> DataFrame:
    """(level, object_id, population) of buildings, links, roads and all, from one pass of grouping sets."""
    grouped = buildings.groupingSets([["building"], ["link"], ["road"], []], "building", "link", "road").agg(F.sum("population").alias("population"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "building").when(F.col("g") == 5, "link").when(F.col("g") == 6, "road").otherwise("global")
    return grouped.select(level.alias("level"), F.coalesce("building", "link", "road", F.lit("global")).alias("object_id"), "population")


@pandas_udf(StringType())
def connection_line(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """GeoJSON of the line between two points, cut at the 180th meridian; null if a point is missing."""
    out = []
    for a, b, c, d in zip(lon1, lat1, lon2, lat2, strict=True):
        if any(x is None or np.isnan(x) for x in (a, b, c, d)):
            out.append(None)
            continue
        parts = antimeridian_parts(a, b, c, d)
        out.append(json.dumps({"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}))
    return pd.Series(out, dtype=object)


def local_plane(lon: np.ndarray, lat: np.ndarray, centre_lon: float, centre_lat: float) -> tuple[np.ndarray, np.ndarray]:
    """Azimuthal equidistant coordinates in metres around a centre."""
    n = len(lon)
    s, azimuth = geodesic(np.full(n, centre_lon), np.full(n, centre_lat), lon, lat)
    return s * np.sin(np.radians(azimuth)), s * np.cos(np.radians(azimuth))
