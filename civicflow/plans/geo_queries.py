"""Queries over addresses, distances and territories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.functions import geodesy
from civicflow.operators import addressing as A
from civicflow.operators.spatial import haversine_m, points_near_points
from civicflow.plans.registry import query
from civicflow.sources.tables import table

_POINTS = "SELECT case_id, city, selected.coordinates[1] AS lon, selected.coordinates[2] AS lat FROM flexible_address_izhevsk_v1 WHERE selected.coordinates IS NOT NULL AND len(selected.coordinates) = 2"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_GAZETTEER = "SELECT DISTINCT selected.candidate_id AS candidate_id, selected.label AS label, selected.kind AS kind, selected.confidence AS confidence FROM flexible_address_izhevsk_v1 WHERE selected.candidate_id IS NOT NULL"


def _cases(spark, d) -> DataFrame:
    return table(spark, d, "flexible_address_izhevsk_v1")


def _points(spark, d) -> DataFrame:
    c = F.col("selected.coordinates")
    return _cases(spark, d).where(c.isNotNull() & (F.size(c) == 2)).select("case_id", "city", c[0].alias("lon"), c[1].alias("lat"))


@query()
def g01_mentions(spark, d):
    return _cases(spark, d).select("case_id", A.extract_mention("input").alias("m")).select("case_id", "m.*")


@query()
def g02_short_addresses(spark, d):
    rows = _cases(spark, d).select("case_id", A.extract_mention("input").alias("m")).select("case_id", "m.*")
    return rows.where(F.col("confidence") == A.SHORT_CONFIDENCE)


@query("SELECT case_id, CASE WHEN mention.kind = 'house' AND mention.house_number IS NOT NULL THEN 'house' ELSE coalesce(mention.kind, 'none') END AS chosen FROM flexible_address_izhevsk_v1")
def g04_first_precise(spark, d):
    m = A.first_precise(F.array_compact(F.array("mention")))
    kind = F.when((m["kind"] == "house") & m["house_number"].isNotNull(), "house").otherwise(F.coalesce(m["kind"], F.lit("none")))
    return _cases(spark, d).select("case_id", kind.alias("chosen"))


@query(
    rf"""SELECT case_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(mention.street), 'ё', 'е'), '(^|[\s.,])({A.STREET_WORDS}|ал)\.?([\s.,]|$)', '\1\3'), '[.,]', ' ', 'g'), '\s+', ' ', 'g')) AS street
    FROM flexible_address_izhevsk_v1 WHERE mention.street IS NOT NULL AND len(regexp_extract_all(replace(lower(mention.street), 'ё', 'е'), '(^|[\s.,])({A.STREET_WORDS}|ал)\.?([\s.,]|$)')) <= 1"""
)
def g05_clean_streets(spark, d):
    low = F.translate(F.lower("mention.street"), "ё", "е")
    rows = _cases(spark, d).where(F.col("mention.street").isNotNull() & (F.regexp_count(low, F.lit(rf"(^|[\s.,])({A.STREET_WORDS}|ал)\.?(?=[\s.,]|$)")) <= 1))
    return rows.select("case_id", A.clean_street(F.col("mention.street")).alias("street"))


@query(
    """SELECT case_id, trim(CASE WHEN starts_with(lower(trim(input)), lower(city) || ',') THEN substring(input, length(city) + 2) WHEN ends_with(lower(trim(input)), ', ' || lower(city)) THEN left(input, length(input) - length(city) - 2) ELSE input END) AS street
    FROM flexible_address_izhevsk_v1 WHERE city IS NOT NULL AND input IS NOT NULL"""
)
def g07_without_city(spark, d):
    rows = _cases(spark, d).where("city IS NOT NULL AND input IS NOT NULL")
    return rows.select("case_id", A.strip_city(F.col("input"), F.col("city")).alias("street"))


@query("SELECT case_id, concat_ws(', ', mention.street, mention.house_number, CASE WHEN NOT coalesce(contains(lower(mention.street), lower(city)), false) THEN city END) AS q FROM flexible_address_izhevsk_v1")
def g08_geocode_queries(spark, d):
    return _cases(spark, d).select("case_id", A.geocode_query(F.col("mention.street"), F.col("mention.house_number"), F.col("city")).alias("q"))


@query("SELECT case_id, round(greatest(0.05, least(0.99, 0.55 * result_confidence + 0.45 * (1 - (case_id % 5) / 5.0))), 6) AS confidence FROM flexible_address_izhevsk_v1 WHERE result_confidence IS NOT NULL")
def g09_rank_confidence(spark, d):
    rows = _cases(spark, d).where("result_confidence IS NOT NULL")
    return rows.select("case_id", F.round(A.rank_confidence(F.col("result_confidence"), F.col("case_id") % 5, F.lit(5.0)), 6).alias("confidence"))


@query()
def g10_semantic_confidence(spark, d):
    street = A.clean_street(F.col("mention.street"))
    label = A.clean_street(F.regexp_extract("selected.label", r"([А-ЯЁ][а-яё]+(?:ая|ья|яя))", 1))
    number = A.house_matches(F.col("mention.house_number"), F.lit(""), F.col("selected.label"))
    rows = _cases(spark, d).where("mention.street IS NOT NULL AND selected.label IS NOT NULL")
    score = A.semantic_confidence(F.coalesce("selected.confidence", F.lit(0.0)), F.lit(1.0), A.name_similarity(street, label), F.col("mention.kind") == "house", number)
    return rows.select("case_id", score.alias("confidence"))


@query(
    """SELECT case_id, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS f1 FROM (SELECT case_id, list_distinct(string_split(lower(input), ' ')) AS a, list_distinct(string_split(lower(selected.label), ' ')) AS b
    FROM flexible_address_izhevsk_v1 WHERE input IS NOT NULL AND selected.label IS NOT NULL)"""
)
def g11_token_f1(spark, d):
    rows = _cases(spark, d).where("input IS NOT NULL AND selected.label IS NOT NULL")
    return rows.select("case_id", F.round(A.token_f1(F.lower("input"), F.lower("selected.label")), 6).alias("f1"))


@query(
    r"""SELECT case_id, coalesce(list_contains(regexp_extract_all(lower(selected.label), '\d+[а-яa-z]*(?:к\d+)?'), replace(lower(mention.house_number), ' ', '')), false) AS matches FROM flexible_address_izhevsk_v1"""
)
def g12_house_match(spark, d):
    return _cases(spark, d).select("case_id", A.house_matches(F.col("mention.house_number"), F.lit(""), F.col("selected.label")).alias("matches"))


@query("SELECT selected.osm_type AS osm_type, CASE WHEN selected.kind IN ('house', 'building') THEN 'house' WHEN selected.kind IN ('road', 'street') THEN 'street' ELSE 'other' END AS kind, count(*) AS n FROM flexible_address_izhevsk_v1 WHERE selected IS NOT NULL GROUP BY ALL")
def g13_location_kinds(spark, d):
    kind = F.when(F.col("selected.kind").isin("house", "building"), "house").when(F.col("selected.kind").isin("road", "street"), "street").otherwise("other")
    return _cases(spark, d).where("selected IS NOT NULL").groupBy(F.col("selected.osm_type").alias("osm_type"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS (SELECT * FROM ({_POINTS}) WHERE city IS NOT NULL), t AS (SELECT territory_id, city, point.longitude AS lon, point.latitude AS lat FROM territories WHERE point.longitude IS NOT NULL),
    x AS (SELECT t.territory_id AS id, p.case_id AS place_id, {_HAVERSINE.format(a="t.", b="p.")} AS m FROM t JOIN p ON lower(t.city) = lower(p.city))
    SELECT id, place_id, round(m, 3) AS distance_m, round(greatest(0.2, least(0.62, 0.27 + 0.35 * (1 - m / 1500.0))), 6) AS confidence FROM x WHERE m <= 1500.0"""
)
def g14_nearby_candidates(spark, d):
    t = table(spark, d, "territories").where("point.longitude IS NOT NULL").select(F.col("territory_id").alias("id"), F.col("city").alias("name"), F.col("point.longitude").alias("lon"), F.col("point.latitude").alias("lat"))
    p = _points(spark, d).where("city IS NOT NULL").select(F.col("case_id").alias("place_id"), F.col("city").alias("name"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))
    return A.nearby_candidates(t, p, 1500.0).withColumn("distance_m", F.round("distance_m", 3))


@query(
    "SELECT city, case_id, CAST(row_number() OVER (PARTITION BY city ORDER BY result_confidence DESC, case_id) AS INT) AS rank FROM flexible_address_izhevsk_v1 WHERE city IS NOT NULL AND result_confidence IS NOT NULL QUALIFY rank <= 5"
)
def g15_top_candidates(spark, d):
    rows = _cases(spark, d).where("city IS NOT NULL AND result_confidence IS NOT NULL").select("city", F.col("result_confidence").alias("confidence"), F.col("case_id").alias("candidate_id"))
    return A.top_candidates(rows, ["city"], 5).select("city", F.col("candidate_id").alias("case_id"), "rank")


@query(
    """SELECT city, case_id FROM flexible_address_izhevsk_v1 WHERE city IS NOT NULL AND selected.confidence IS NOT NULL AND mention.kind IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY city ORDER BY CASE WHEN mention.kind = 'house' AND selected.kind = 'house' THEN 0 ELSE 1 END, selected.confidence DESC, case_id) = 1"""
)
def g16_selected_candidate(spark, d):
    rows = _cases(spark, d).where("city IS NOT NULL AND selected.confidence IS NOT NULL AND mention.kind IS NOT NULL")
    rows = rows.select("city", F.col("mention.kind").alias("mention_kind"), "selected.kind", "selected.confidence", F.col("case_id").alias("candidate_id"))
    return A.select_candidate(rows, ["city"]).select("city", F.col("candidate_id").alias("case_id"))


@query(
    """SELECT case_id, round(mention.confidence * selected.confidence, 6) AS combined, coalesce(mention.confidence * selected.confidence >= 0.25, false) AS included,
    concat_ws(',', CASE WHEN mention.kind = 'house' AND coalesce(selected.kind, '') <> 'house' THEN 'house_candidate_not_resolved' END, CASE WHEN selected IS NULL THEN 'no_candidate' END) AS why FROM flexible_address_izhevsk_v1"""
)
def g17_combined_confidence(spark, d):
    c = F.col("mention.confidence") * F.col("selected.confidence")
    unresolved = F.when((F.col("mention.kind") == "house") & (F.coalesce("selected.kind", F.lit("")) != "house"), "house_candidate_not_resolved")
    return _cases(spark, d).select("case_id", F.round(c, 6).alias("combined"), F.coalesce(c >= 0.25, F.lit(False)).alias("included"), F.concat_ws(",", unresolved, F.when(F.col("selected").isNull(), "no_candidate")).alias("why"))


@query("SELECT coalesce(selected.kind, 'none') AS kind, count(*) AS n, CAST(count_if(selected.kind IN ('house', 'street') AND included_for_analysis) AS BIGINT) AS qualified FROM flexible_address_izhevsk_v1 GROUP BY 1")
def g18_qualified_levels(spark, d):
    return _cases(spark, d).groupBy(F.coalesce("selected.kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("selected.kind").isin("house", "street") & F.col("included_for_analysis")).alias("qualified"))


@query(f"SELECT case_id, CAST(CASE WHEN lat < -80 OR lat > 84 THEN 3857 WHEN lat >= 0 THEN 32600 + least(floor((lon + 180) / 6) + 1, 60) ELSE 32700 + least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER) AS epsg FROM ({_POINTS})")
def g19_utm_zones(spark, d):
    return _points(spark, d).select("case_id", geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(f"SELECT case_id, round({_HAVERSINE.format(a='', b='c.')}, 3) AS metres FROM ({_POINTS}) p JOIN (SELECT city AS ccity, avg(lon) AS clon, avg(lat) AS clat FROM ({_POINTS}) GROUP BY 1) ON city = ccity".replace("c.lat", "clat").replace("c.lon", "clon"))
def g20_distance_to_city_mean(spark, d):
    p = _points(spark, d)
    mean = p.groupBy("city").agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    return p.join(mean, "city").select("case_id", F.round(haversine_m(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat")), 3).alias("metres"))


@query()
def g21_utm_points(spark, d):
    return _points(spark, d).select("case_id", geodesy.utm_point("lon", "lat").alias("u")).select("case_id", "u.east", "u.north")


@query("SELECT message_id, CASE WHEN regexp_matches(lower(text), '(^|[^а-яё])дом[^а-яё]') THEN 'house' WHEN regexp_matches(lower(text), '(^|[^а-яё])(ул|улиц[аеы])[^а-яё]') THEN 'street' WHEN contains(lower(text), 'район') THEN 'district' ELSE 'city' END AS hint FROM messages WHERE text IS NOT NULL")
def g23_relevance_hints(spark, d):
    low = F.lower("text")
    hint = F.when(low.rlike("(^|[^а-яё])дом[^а-яё]"), "house").when(low.rlike("(^|[^а-яё])(ул|улиц[аеы])[^а-яё]"), "street").when(F.contains(low, F.lit("район")), "district").otherwise("city")
    return table(spark, d, "messages").where("text IS NOT NULL").select("message_id", hint.alias("hint"))


@query("SELECT case_id, concat_ws(',', CASE WHEN contains(lower(input), lower(city)) THEN 'city' END, CASE WHEN regexp_matches(lower(input), 'област|край') THEN 'region' END) AS evidence FROM flexible_address_izhevsk_v1 WHERE input IS NOT NULL")
def g24_geo_evidence(spark, d):
    low = F.lower("input")
    return _cases(spark, d).where("input IS NOT NULL").select("case_id", F.concat_ws(",", F.when(F.contains(low, F.lower("city")), "city"), F.when(low.rlike("област|край"), "region")).alias("evidence"))


@query("SELECT DISTINCT lower(t || ' ' || city) AS q FROM (SELECT DISTINCT city FROM territories), (SELECT unnest(['жалобы', 'новости', 'форум', 'чат']) AS t)")
def g25_query_templates(spark, d):
    cities = table(spark, d, "territories").select("city").distinct()
    words = cities.select("city", F.explode(F.array(*map(F.lit, ("жалобы", "новости", "форум", "чат")))).alias("t"))
    return words.select(F.lower(F.concat_ws(" ", "t", "city")).alias("q")).distinct()


@query("SELECT city, min(ref) AS ref_id FROM (SELECT a.city, r.ref_id AS ref FROM flexible_address_izhevsk_v1 a JOIN reference_names r ON r.kind = 'street' AND lower(a.mention.street) IN (lower(split_part(r.name, ' ', 1)), regexp_replace(lower(split_part(r.name, ' ', 1)), 'ая$', 'ой'))) GROUP BY 1")
def g27_word_forms(spark, d):
    base = F.lower(F.split_part("name", F.lit(" "), F.lit(1)))
    forms = table(spark, d, "reference_names").where("kind = 'street'").select("ref_id", F.explode(F.array_distinct(F.array(base, F.regexp_replace(base, "ая$", "ой")))).alias("form"))
    rows = _cases(spark, d).select("city", F.lower("mention.street").alias("form"))
    return rows.join(forms, "form").groupBy("city").agg(F.min("ref_id").alias("ref_id"))


@query(f"WITH g AS (SELECT avg(lon) AS mlon, avg(lat) AS mlat FROM ({_POINTS})) SELECT case_id, CASE WHEN selected.kind IS NULL THEN 'global' ELSE selected.kind END AS level, round(coalesce(selected.coordinates[1], mlon), 4) AS lon FROM flexible_address_izhevsk_v1, g")
def g28_global_fill(spark, d):
    mean = _points(spark, d).agg(F.avg("lon").alias("mlon"))
    rows = _cases(spark, d).crossJoin(F.broadcast(mean))  # the right side is one row
    return rows.select("case_id", F.coalesce("selected.kind", F.lit("global")).alias("level"), F.round(F.coalesce(F.expr("try_element_at(selected.coordinates, 1)"), F.col("mlon")), 4).alias("lon"))


@query()
def f02_geodesic_radius(spark, d):
    p = _points(spark, d)
    t = table(spark, d, "territories").where("point.longitude IS NOT NULL AND radius_meters IS NOT NULL").select("territory_id", "city", F.col("point.longitude").alias("tlon"), F.col("point.latitude").alias("tlat"), "radius_meters")
    m = geodesy.geodesic_m("lon", "lat", "tlon", "tlat")
    rows = p.join(t, "city").select("territory_id", "case_id", m.alias("metres"), "radius_meters")
    relation = F.when(F.abs(F.col("metres") - F.col("radius_meters")) <= 0.5, "boundary").when(F.col("metres") < F.col("radius_meters"), "inside").otherwise("outside")
    return rows.select("territory_id", "case_id", F.round("metres", 3).alias("metres"), relation.alias("relation"))


@query(
    """SELECT case_id, CASE WHEN NOT coalesce(included_for_analysis, false) THEN 'skipped' WHEN selected.coordinates IS NULL THEN 'indeterminate' WHEN selected.kind NOT IN ('house', 'poi') THEN 'inexact' ELSE 'evaluated' END AS decision FROM flexible_address_izhevsk_v1"""
)
def f05_precondition_ladder(spark, d):
    ladder = F.when(~F.coalesce("included_for_analysis", F.lit(False)), "skipped").when(F.col("selected.coordinates").isNull(), "indeterminate")
    return _cases(spark, d).select("case_id", ladder.when(~F.col("selected.kind").isin("house", "poi"), "inexact").otherwise("evaluated").alias("decision"))


@query(f"WITH p AS ({_POINTS}) SELECT a.case_id AS a, b.case_id AS b FROM p a JOIN p b ON a.case_id <> b.case_id AND abs(a.lat - b.lat) < 0.01 WHERE {_HAVERSINE.format(a='a.', b='b.')} <= 60")
def f08_cases_near_cases(spark, d):
    p = _points(spark, d).select(F.col("case_id").alias("point_id"), "lon", "lat")
    return points_near_points(p, p, 60.0).where("point_id <> other_id").select(F.col("point_id").alias("a"), F.col("other_id").alias("b"))


@query("SELECT territory_id, geometry IS NOT NULL AS has_area, point IS NOT NULL AND radius_meters IS NOT NULL AS has_disc, CASE WHEN geometry IS NOT NULL AND radius_meters IS NOT NULL AND point IS NOT NULL THEN 'intersection' WHEN geometry IS NOT NULL THEN 'polygon' WHEN point IS NOT NULL AND radius_meters IS NOT NULL THEN 'radius' ELSE 'undefined' END AS mode FROM territories")
def f01_target_modes(spark, d):
    area, disc = F.col("geometry").isNotNull(), F.col("point").isNotNull() & F.col("radius_meters").isNotNull()
    mode = F.when(area & disc, "intersection").when(area, "polygon").when(disc, "radius").otherwise("undefined")
    return table(spark, d, "territories").select("territory_id", area.alias("has_area"), disc.alias("has_disc"), mode.alias("mode"))
