"""Queries of problem 6: address cases in territories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.operators.spatial import points_in_regions
from civicflow.plans.registry import query
from civicflow.sources.tables import table


#: Spherical trigonometry and the even-odd rule over all pairs of a territory and a case.
IN_TERRITORIES = """
WITH t AS (SELECT territory_id, point.longitude AS lon, point.latitude AS lat, radius_meters AS r, geometry AS g FROM territories),
     c AS (SELECT case_id, selected.coordinates[1] AS x, selected.coordinates[2] AS y FROM flexible_address_izhevsk_v1),
     rings AS (
       SELECT territory_id, unnest(CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][])) AS ring FROM t WHERE json_extract_string(g, '$.type') = 'Polygon'
       UNION ALL
       SELECT territory_id, unnest(flatten(CAST(json_extract(g, '$.coordinates') AS DOUBLE[][][][]))) FROM t WHERE json_extract_string(g, '$.type') = 'MultiPolygon'),
     places AS (SELECT territory_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM rings),
     edges AS (SELECT territory_id, ring[i][1] AS x1, ring[i][2] AS y1, ring[i % len(ring) + 1][1] AS x2, ring[i % len(ring) + 1][2] AS y2 FROM places),
     inside AS (
       SELECT territory_id, case_id FROM c JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
       GROUP BY territory_id, case_id HAVING count(*) % 2 = 1),
     pairs AS (
       SELECT territory_id, case_id, g, r, lon IS NOT NULL AND lat IS NOT NULL AND r IS NOT NULL AS disc,
              2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2)))) AS m
       FROM t CROSS JOIN c WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT territory_id, case_id FROM pairs
WHERE (disc OR g IS NOT NULL) AND (NOT disc OR m <= r) AND (g IS NULL OR (territory_id, case_id) IN (SELECT (territory_id, case_id) FROM inside))
"""


@query(IN_TERRITORIES)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "flexible_address_izhevsk_v1")
    points = cases.select(F.col("case_id").alias("point_id"), F.expr("try_element_at(selected.coordinates, 1)").alias("lon"), F.expr("try_element_at(selected.coordinates, 2)").alias("lat"))
    regions = table(spark, d, "territories").select(
        F.col("territory_id").alias("region_id"), F.col("point.longitude").alias("lon"), F.col("point.latitude").alias("lat"), F.col("radius_meters").alias("radius"), "geometry"
    )
    return points_in_regions(points, regions).select(F.col("region_id").alias("territory_id"), F.col("point_id").alias("case_id"))

