"""Queries over sources, policies and the older event model."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicflow.functions.geodesy import geodesic_m
from civicflow.operators import legacy, storage
from civicflow.plans.registry import query
from civicflow.sources import connectors as C
from civicflow.sources.pages import page_fields
from civicflow.sources.tables import table


@query("SELECT source, count(*) AS n, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM (SELECT source, row_number() OVER (PARTITION BY source, external_id ORDER BY message_id) AS rn FROM messages) GROUP BY 1")
def s02_scan_coverage(spark, d):
    m = table(spark, d, "messages")
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("external_id").alias("kept"))


@query("SELECT CAST(event_id AS VARCHAR) AS external_id, concat('wall', user_id, '_', event_id) AS link, CASE WHEN event_id % 2 = 0 THEN 'post' ELSE 'comment' END AS kind FROM events WHERE event_id % 2 = 0 UNION ALL SELECT concat(event_id - 1, '_', event_id), concat('wall', user_id, '_', event_id - 1), 'comment' FROM events WHERE event_id % 2 = 1 AND event_id - 1 IN (SELECT event_id FROM events)")
def s03_posts_and_comments(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    posts = e.where("event_id % 2 = 0")
    comments = e.where("event_id % 2 = 1").join(posts.select((F.col("event_id") + 1).alias("event_id")), "event_id", "left_semi")
    top = posts.select(F.col("event_id").cast("string").alias("external_id"), F.concat(F.lit("wall"), "user_id", F.lit("_"), "event_id").alias("link"), F.lit("post").alias("kind"))
    before = F.col("event_id") - 1
    return top.unionByName(comments.select(F.concat_ws("_", before, "event_id").alias("external_id"), F.concat(F.lit("wall"), "user_id", F.lit("_"), before).alias("link"), F.lit("comment").alias("kind")))


@query("SELECT * FROM (VALUES ('api', 3), ('html', 4), ('rss', 1)) t(access, n)".replace("3", "CAST(3 AS BIGINT)").replace("4", "CAST(4 AS BIGINT)").replace("1)", "CAST(1 AS BIGINT))"))
def s08_connector_catalog(spark, d):
    return C.connector_catalog(spark).groupBy("access").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT split_part(source, ':', 1) AS source, CASE split_part(source, ':', 1) WHEN 'vk' THEN 'allowed' WHEN 'ok' THEN 'disabled' WHEN 'dzen' THEN 'not_approved' WHEN 'web' THEN 'robots_denied' ELSE 'no_policy' END AS outcome FROM messages")
def s09_authorization(spark, d):
    policies = spark.createDataFrame([("vk", True, True, True), ("ok", False, True, True), ("dzen", True, False, True), ("web", True, True, False)], "source string, enabled boolean, approved boolean, robots_allowed boolean")
    return C.authorize(table(spark, d, "messages").select(F.split_part("source", F.lit(":"), F.lit(1)).alias("source")).distinct(), policies)


@query()
def s10_page_fields(spark, d):
    body = F.concat(F.lit("<html><head><title>"), "source", F.lit("</title></head><body><article>"), F.coalesce("text", F.lit("")), F.lit("</article></body></html>"))

    def run(frames):
        import pandas as pd

        for f in frames:
            fields = [page_fields(x) for x in f["page"]]
            yield pd.DataFrame({"message_id": f["message_id"], "title": [x["title"] for x in fields], "body": [x["body"] for x in fields]})

    return table(spark, d, "messages").select("message_id", body.alias("page")).mapInPandas(run, "message_id bigint, title string, body string")


@query(
    """SELECT place_id, name, src FROM (SELECT s_suppkey AS place_id, s_name AS name, s_nationkey AS a, 0 AS src FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey, 1 FROM customer)
    QUALIFY row_number() OVER (PARTITION BY lower(name), a ORDER BY src, place_id) = 1 ORDER BY src, place_id LIMIT 300"""
)
def s15_merged_places(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("address"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("address"))
    return C.merge_places([a, b], 300).select("place_id", "name", F.col("priority").alias("src"))


@query("SELECT message_id, source, text FROM messages WHERE text IS NOT NULL")
def s17_json_round_trip(spark, d):
    rows = table(spark, d, "messages").where("text IS NOT NULL").select("message_id", "source", "text")
    return C.from_json(C.to_json(rows), "message_id bigint, source string, text string")


@query("SELECT k AS key, v AS value FROM (SELECT event_id % 500 AS k, arg_max(value, event_id) AS v, max(ts) AS t FROM events GROUP BY 1) WHERE t + INTERVAL 20 DAY > (SELECT max(ts) FROM events)")
def s19_response_cache(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("key"), "value", "event_id", "ts")
    latest = e.groupBy("key").agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("t"))
    now = e.agg(F.max("ts").alias("now"))
    return latest.join(F.broadcast(now), F.expr("t + INTERVAL 20 DAY > now")).select("key", "value")  # one row is broadcast


@query("SELECT source, external_id, message_id FROM messages WHERE message_id % 3 = 0 UNION ALL SELECT source, external_id, min(message_id) FROM messages WHERE message_id % 3 = 1 AND (source, external_id) NOT IN (SELECT (source, external_id) FROM messages WHERE message_id % 3 = 0) GROUP BY ALL")
def s20_insert_if_absent(spark, d):
    m = table(spark, d, "messages").select("source", "external_id", "message_id")
    new = m.where("message_id % 3 = 1").groupBy("source", "external_id").agg(F.min("message_id").alias("message_id"))
    return storage.insert_if_absent(m.where("message_id % 3 = 0"), new, ["source", "external_id"])


@query("SELECT message_id, CASE WHEN regexp_matches(url, '^[Hh][Tt][Tt][Pp][Ss]?://[^/]') THEN lower(regexp_extract(split_part(url, '#', 1), '^[A-Za-z]+://[^/?]*')) || CASE WHEN length(split_part(url, '#', 1)) = length(regexp_extract(split_part(url, '#', 1), '^[A-Za-z]+://[^/?]*')) THEN '/' ELSE substring(split_part(url, '#', 1), length(regexp_extract(split_part(url, '#', 1), '^[A-Za-z]+://[^/?]*')) + 1) END END AS url FROM messages")
def t10_web_urls(spark, d):
    return table(spark, d, "messages").select("message_id", C.canonical_web_url(F.col("url")).alias("url"))


@query("SELECT event_id, json_keys(props) = ['k'] AS ok FROM events")
def pred11_contract_keys(spark, d):
    return table(spark, d, "events").select("event_id", C.conforms(F.col("props"), ["k"]).alias("ok"))


@query("SELECT DISTINCT lower(url) AS url FROM messages WHERE FALSE")
def s06_frontier(spark, d):
    m = table(spark, d, "messages").where("url IS NOT NULL")
    seen = m.select(C.canonical_web_url(F.col("url")).alias("url"))
    return C.frontier(seen, m.select("url"))


@query(
    """WITH g AS (SELECT o_custkey AS k, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS p FROM orders GROUP BY 1), b AS (SELECT min(n) AS n0, max(n) AS n1, min(p) AS p0, max(p) AS p1 FROM g)
    SELECT k, round((CASE WHEN n = n0 THEN 0.01 ELSE (n - n0) / (n1 - n0)::DOUBLE END) * (CASE WHEN p = p0 THEN 0.01 ELSE (p - p0) / (p1 - p0) END) * 0.5, 6) AS risk FROM g, b"""
)
def e16_object_risk(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("p"))
    scaled = legacy.min_max(g, ["n", "p"])
    return scaled.select("k", F.round(legacy.risk_product(F.col("n"), F.col("p"), F.lit(0.5)), 6).alias("risk"))


@query(
    """SELECT level, object_id, CAST(p AS BIGINT) AS population FROM (SELECT 'building' AS level, 'c' || c_custkey AS object_id, c_custkey AS p FROM customer UNION ALL SELECT 'link', 'n' || c_nationkey, sum(c_custkey) FROM customer GROUP BY ALL
    UNION ALL SELECT 'road', 's' || c_mktsegment, sum(c_custkey) FROM customer GROUP BY ALL UNION ALL SELECT 'global', 'global', sum(c_custkey) FROM customer)"""
)
def e17_population_levels(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("building"), F.concat(F.lit("n"), "c_nationkey").alias("link"), F.concat(F.lit("s"), "c_mktsegment").alias("road"), F.col("c_custkey").alias("population"))
    return legacy.population_levels(c)


@query(
    """WITH e AS (SELECT 'r' || r_regionkey AS id, 'road' AS lv, 1000 AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'link', n_nationkey * 10 FROM nation),
    t AS (SELECT 'r' || n_regionkey AS id, sum(n_nationkey * 10) AS taken FROM nation GROUP BY 1) SELECT e.id AS event_id, CAST(greatest(0, p - coalesce(taken, 0)) AS BIGINT) AS population FROM e LEFT JOIN t ON e.id = t.id"""
)
def e20_rebalanced_population(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    roads = r.select(F.concat(F.lit("r"), "r_regionkey").alias("event_id"), F.lit("road").alias("level"), F.lit(1000).cast("bigint").alias("population"))
    links = n.select(F.concat(F.lit("n"), "n_nationkey").alias("event_id"), F.lit("link").alias("level"), (F.col("n_nationkey") * 10).cast("bigint").alias("population"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return legacy.rebalance_population(roads.unionByName(links), edges, {"road": "link"}).select("event_id", "population")


@query("SELECT a.user_id AS a, b.user_id AS b FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 1) a JOIN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 1) b ON b.user_id = a.user_id + 1")
def e21_without_outliers(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    named = u.select(F.col("user_id").alias("event_id"), F.when(F.col("user_id") % 10 == 1, F.concat(F.lit("-1_"), "user_id")).otherwise(F.concat(F.lit("0_"), "user_id")).alias("name"))
    return legacy.without_outliers(named, u.select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b")))[1].select("a", "b")


@query()
def r08_connection_lines(spark, d):
    t = table(spark, d, "territories").where("point.longitude IS NOT NULL").select("territory_id", "city", F.col("point.longitude").alias("lon"), F.col("point.latitude").alias("lat"))
    p = t.alias("a").join(t.alias("b"), F.expr("a.city = b.city AND a.territory_id < b.territory_id"))
    p = p.select(F.col("a.territory_id").alias("a"), F.col("b.territory_id").alias("b"), F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))
    return p.select("a", "b", legacy.connection_line("x1", "y1", "x2", "y2").alias("geometry"), F.round(geodesic_m("x1", "y1", "x2", "y2"), 3).alias("distance_m"))


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderkey) = 1")
def k06_idempotent_lookup(spark, d):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct(rank, "o_orderkey")).alias("o_orderkey"))


@query("SELECT event_id, CAST(least(1 * 2 ** (event_id % 12), 600) AS DOUBLE) AS delay FROM events")
def pred16_backoff(spark, d):
    return table(spark, d, "events").select("event_id", storage.backoff_s(F.col("event_id") % 12 + 1, 1.0, 2.0, 600.0).alias("delay"))


@query("SELECT message_id, CASE WHEN source LIKE 'telegram:%' THEN 'unconfigured' WHEN url IS NULL THEN 'failed' ELSE 'collected' END AS outcome FROM messages")
def pred06_collector_dispatch(spark, d):
    ready = spark.createDataFrame([(p,) for p in ("vk", "ok", "web", "dzen", "pikabu", "rutube")], "platform string").withColumn("ready", F.lit(True))
    rows = table(spark, d, "messages").withColumn("platform", F.split_part("source", F.lit(":"), F.lit(1))).join(F.broadcast(ready), "platform", "left")
    return rows.select("message_id", F.when(F.col("ready").isNull(), "unconfigured").when(F.col("url").isNull(), "failed").otherwise("collected").alias("outcome"))


@query("SELECT source, max(d) AS longest FROM (SELECT source, floor(epoch(published_at)) - lag(floor(epoch(published_at))) OVER (PARTITION BY source ORDER BY published_at, external_id, message_id) AS d FROM messages WHERE published_at IS NOT NULL) GROUP BY 1".replace("max(d)", "CAST(max(d) AS BIGINT)"))
def pred05_longest_silence(spark, d):
    rows = table(spark, d, "messages").where("published_at IS NOT NULL")
    return C.fetch_delay(rows).groupBy("source").agg(F.max("delay_s").alias("longest"))
