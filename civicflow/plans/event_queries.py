"""Queries over events, their connections and risk, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.functions import geodesy
from civicflow.functions.text import safe_url
from civicflow.operators import dedup, events, scoring
from civicflow.plans.label_queries import _LATEST, _latest
from civicflow.plans.registry import query
from civicflow.plans.text_queries import prepared_messages
from civicflow.session import materialize, release
from civicflow.sources.pages import access_wall
from civicflow.sources.tables import table

LOCAL_RADIUS_M = 1_500_000.0  # fixed value: beyond it a plane around the centroid is not used
_STOPS = ", ".join(f"'{w}'" for w in events.STOP_WORDS)
_MEMBERS = "SELECT 'd' || event_type || strftime(ts, '%Y-%m-%d-%H') AS event_id, event_id AS message_id, ts FROM events UNION ALL SELECT 'u' || user_id || strftime(ts, '-%Y-%m-%d'), event_id, ts FROM events"
_EDGES = f"WITH m AS ({_MEMBERS}), s AS (SELECT event_id, count(*) AS n FROM m GROUP BY 1), e AS (SELECT a.event_id AS source_event_id, b.event_id AS target_event_id, count(*) AS shared FROM m a JOIN m b ON a.message_id = b.message_id AND a.event_id < b.event_id GROUP BY ALL)"
_REACHED = "r AS (SELECT source_event_id AS event_id, target_event_id AS n FROM e UNION ALL SELECT target_event_id, source_event_id FROM e), x AS (SELECT DISTINCT r.event_id, m.message_id FROM r JOIN m ON m.event_id = r.n), c AS (SELECT x.event_id, count(*) AS connectivity FROM x ANTI JOIN m ON x.event_id = m.event_id AND x.message_id = m.message_id GROUP BY 1)"


#: As SURVEY asks: an event is a type on a day, or a user.
_WIDE_MEMBERS = "SELECT 'd' || event_type || CAST(CAST(ts AS DATE) AS VARCHAR) AS event_id, event_id AS message_id, ts FROM events UNION ALL SELECT 'u' || user_id, event_id, ts FROM events"
_WIDE_EDGES = _EDGES.replace(_MEMBERS, _WIDE_MEMBERS)


def _wide_members(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    day = e.select(F.concat(F.lit("d"), "event_type", F.to_date("ts").cast("string")).alias("event_id"), F.col("event_id").alias("message_id"), "ts")
    return day.unionByName(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("event_id"), F.col("event_id").alias("message_id"), "ts"))


def _members(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    day = e.select(F.concat(F.lit("d"), "event_type", F.date_format("ts", "yyyy-MM-dd-HH")).alias("event_id"), F.col("event_id").alias("message_id"), "ts")
    return day.unionByName(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.date_format("ts", "-yyyy-MM-dd")).alias("event_id"), F.col("event_id").alias("message_id"), "ts"))


_SCOPED = """SELECT c.case_id, s.level, s.object_id FROM flexible_address_izhevsk_v1 c, (VALUES ('global'), ('road'), ('building')) l(level),
LATERAL (SELECT l.level AS level, CASE l.level WHEN 'global' THEN 'global' WHEN 'road' THEN 'road:' || lower(c.city) || ':' || lower(c.mention.street) ELSE c.selected.candidate_id END AS object_id) s WHERE s.object_id IS NOT NULL"""


def _scoped(spark, d) -> DataFrame:
    c = table(spark, d, "flexible_address_izhevsk_v1")
    return c.select("case_id", F.explode(events.scopes(F.col("city"), F.col("mention.street"), F.col("selected.candidate_id"))).alias("s")).select("case_id", "s.level", "s.object_id")


@query(f"SELECT level, object_id, count(*) AS n FROM ({_SCOPED}) GROUP BY ALL")
def e02_multi_level_scopes(spark, d):
    return _scoped(spark, d).groupBy("level", "object_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT case_id, level, object_id FROM ({_SCOPED}) QUALIFY count(*) OVER (PARTITION BY level, object_id) >= 5")
def e03_scope_having(spark, d):
    return events.with_enough_messages(_scoped(spark, d)).select("case_id", "level", "object_id")


_WORDS = f"SELECT message_id, unnest(regexp_extract_all(lower(text), '{events.WORD}')) AS word FROM messages WHERE text IS NOT NULL"


@query(
    f"""WITH c AS (SELECT message_id, (('0x' || substring(sha256(word), 1, 8))::BIGINT) % 64 AS i, CASE WHEN ('0x' || substring(sha256(word), 10, 1))::BIGINT % 2 = 1 THEN 1.0 ELSE -1.0 END AS x FROM ({_WORDS})),
    g AS (SELECT message_id, i, sum(x) AS x FROM c GROUP BY ALL), n AS (SELECT message_id, sqrt(sum(x * x)) AS norm FROM g GROUP BY 1)
    SELECT message_id, CAST(i AS INTEGER) AS i, round(CAST(x AS DOUBLE) / norm, 6) AS x FROM g JOIN n USING (message_id) WHERE x <> 0"""
)
def e04_hashing_embedding(spark, d):
    words = table(spark, d, "messages").where("text IS NOT NULL").select("message_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(events.WORD), F.lit(0))).alias("word"))
    cells = events.hashing_embedding(words, "message_id").select("message_id", F.posexplode("vector").alias("i", "x"))
    return cells.where("x <> 0").select("message_id", "i", F.round("x", 6).alias("x"))


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query("SELECT a.label AS scope, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def e07_cosine_edges(spark, d):
    return events.cosine_edges(_vectors(spark, d), 0.3)


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
    r AS (SELECT vec_id AS k, vec_id AS m FROM embeddings UNION SELECT e.b, r.m FROM r JOIN e ON r.k = e.a), c AS (SELECT k, min(m) AS m FROM r GROUP BY 1)
    SELECT label AS scope, vec_id AS key, m AS cluster FROM embeddings JOIN c ON vec_id = k QUALIFY count(*) OVER (PARTITION BY m) >= 2"""
)
def e07_cosine_clusters(spark, d):
    v = _vectors(spark, d)
    return events.clusters(v, events.cosine_edges(v, 0.3))


@query("SELECT count(*) AS noise FROM embeddings a WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)")
def e09_noise_count(spark, d):
    v = _vectors(spark, d)
    inside = events.cosine_edges(v, 0.3).select(F.explode(F.array("a", "b")).alias("key")).distinct()
    return v.join(inside, "key", "left_anti").agg(F.count(F.lit(1)).alias("noise"))


@query(f"SELECT message_id % 50 AS g, category.label AS category FROM ({_LATEST}) WHERE category.label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY message_id % 50 ORDER BY count(*) DESC, lower(category.label), category.label) = 1")
def e11_dominant_label(spark, d):
    rows = _latest(spark, d).select((F.col("message_id") % 50).alias("g"), F.col("category.label").alias("category"))
    return events.dominant(rows, ["g"], "category")


@query(
    f"""WITH w AS (SELECT DISTINCT source, message_id, unnest(regexp_extract_all(lower(text), '{events.WORD}')) AS w FROM messages), c AS (SELECT source, w, count(*) AS n FROM w WHERE length(w) >= 3 AND w NOT IN ({_STOPS}) GROUP BY ALL),
    r AS (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS r FROM c) SELECT source, string_agg(w, ',' ORDER BY r) AS keywords FROM r WHERE r <= 6 GROUP BY 1"""
)
def e12_top_keywords(spark, d):
    return events.keywords(table(spark, d, "messages"), ["source"], "text")


@query(
    """WITH m AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1)
    SELECT e.label AS label, vec_id AS key, CAST(row_number() OVER (PARTITION BY e.label ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], mean), 9) DESC, vec_id) AS INTEGER) AS rank FROM embeddings e JOIN m ON e.label = m.label QUALIFY rank <= 3"""
)
def e13_representatives(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return events.representatives(rows, ["label"]).select("label", "key", "rank")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e14_neighbour_cosine(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    return pairs.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(events.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


@query("SELECT coalesce(n_regionkey, -1) AS region, coalesce(n_name, 'all') AS nation, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey, n_name), (n_regionkey), ())")
def e17_population_rollup(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).agg(F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.count(F.lit(1)).alias("n")).withColumns(
        {"region": F.coalesce("region", F.lit(-1)), "nation": F.coalesce("nation", F.lit("all"))}
    )


@query(
    """WITH g AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS p FROM orders GROUP BY 1), b AS (SELECT min(n) AS n0, max(n) AS n1, min(p) AS p0, max(p) AS p1 FROM g)
    SELECT o_custkey, round(((n - n0) / CAST(n1 - n0 AS DOUBLE)) * ((p - p0) / (p1 - p0)), 6) AS risk FROM g, b"""
)
def e18_minmax_risk(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("p"))
    b = g.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    risk = ((F.col("n") - F.col("n0")) / (F.col("n1") - F.col("n0"))) * ((F.col("p") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    return g.crossJoin(F.broadcast(b)).select("o_custkey", F.round(risk, 6).alias("risk"))  # one row of bounds


@query("SELECT message_id, coalesce(CASE category.label WHEN 'ЖКХ' THEN 0.5 WHEN 'Дороги' THEN 0.4 END, 0.16) AS weight FROM classifications")
def e19_category_weights(spark, d):
    weights = spark.createDataFrame([("ЖКХ", 0.5), ("Дороги", 0.4)], "label string, weight double")
    rows = table(spark, d, "classifications").select("message_id", F.col("category.label").alias("label"))
    return rows.join(F.broadcast(weights), "label", "left").select("message_id", F.coalesce("weight", F.lit(0.16)).alias("weight"))


@query(f"{_EDGES} SELECT source_event_id, target_event_id, shared, round(shared / CAST(sa.n + sb.n - shared AS DOUBLE), 6) AS jaccard FROM e JOIN s sa ON sa.event_id = source_event_id JOIN s sb ON sb.event_id = target_event_id")
def r01_event_connections(spark, d):
    return scoring.connections(_members(spark, d))


@query(f"{_WIDE_EDGES} SELECT source_event_id, target_event_id, shared, round(shared / CAST(sa.n + sb.n - shared AS DOUBLE), 6) AS jaccard FROM e JOIN s sa ON sa.event_id = source_event_id JOIN s sb ON sb.event_id = target_event_id")
def r01_event_connections_wide(spark, d):
    return scoring.connections(_wide_members(spark, d))


@query(
    """WITH i AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'click' GROUP BY 1), j AS (SELECT user_id, min(ts) AS c, max(ts) AS d FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT user_id, round(greatest(0.0, (floor(epoch(c)) - floor(epoch(b))) / 3600.0, (floor(epoch(a)) - floor(epoch(d))) / 3600.0), 6) AS gap, round((floor(epoch(b)) - floor(epoch(a))) / 3600.0, 6) AS duration FROM i JOIN j USING (user_id)"""
)
def r02_temporal_gap(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda kind, x, y: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.min("ts").alias(x), F.max("ts").alias(y))
    rows = side("click", "a", "b").join(side("error", "c", "d"), "user_id")
    gap = scoring.temporal_gap_hours(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return rows.select("user_id", F.round(gap, 6).alias("gap"), F.round(scoring.duration_hours(F.col("a"), F.col("b")), 6).alias("duration"))


_UNIT = "avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z"


@query(f"SELECT city, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat FROM (SELECT city, {_UNIT} FROM (SELECT city, selected.coordinates[1] AS lon, selected.coordinates[2] AS lat FROM flexible_address_izhevsk_v1 WHERE selected.coordinates IS NOT NULL) GROUP BY 1)")
def r04_spherical_centroids(spark, d):
    c = F.col("selected.coordinates")
    rows = table(spark, d, "flexible_address_izhevsk_v1").where(c.isNotNull()).select("city", c[0].alias("lon"), c[1].alias("lat"))
    lon, lat = geodesy.spherical_centroid(F.col("lon"), F.col("lat"))
    return rows.groupBy("city").agg(F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


def _spread(spark, d) -> DataFrame:
    """(city, spread_m): greatest geodesic distance of a member from the spherical centroid."""
    c = F.col("selected.coordinates")
    rows = table(spark, d, "flexible_address_izhevsk_v1").where(c.isNotNull()).select("city", c[0].alias("lon"), c[1].alias("lat"))
    lon, lat = geodesy.spherical_centroid(F.col("lon"), F.col("lat"))
    centre = rows.groupBy(F.col("city").alias("ccity")).agg(lon.alias("clon"), lat.alias("clat"))
    return rows.join(centre, F.col("city").eqNullSafe(F.col("ccity"))).select("city", geodesy.geodesic_m("lon", "lat", "clon", "clat").alias("m")).groupBy("city").agg(F.round(F.max("m"), 3).alias("spread_m"))


@query()
def r05_spread(spark, d):
    return _spread(spark, d)


def _reach(members: DataFrame) -> DataFrame:
    return scoring.connectivity(members).where("connectivity > 0").select("event_id", "connectivity")


@query(f"{_EDGES}, {_REACHED} SELECT event_id, connectivity FROM c")
def r10_external_connectivity(spark, d):
    return _reach(_members(spark, d))


@query(f"{_WIDE_EDGES}, {_REACHED} SELECT event_id, connectivity FROM c")
def r10_external_connectivity_wide(spark, d):
    return _reach(_wide_members(spark, d))


def _risks(members: DataFrame) -> DataFrame:
    times = members.groupBy("event_id").agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b"))
    linked = times.join(scoring.connectivity(members), "event_id", "left").fillna(0, ["size", "connectivity"])
    linked = linked.withColumn("spread", F.when(F.col("event_id").startswith("d"), F.col("size") * 10.0))
    value = scoring.score({"intensity": F.col("size"), "persistence": scoring.duration_hours(F.col("a"), F.col("b")), "connectivity": F.col("connectivity"), "spatial_spread": F.col("spread")})
    return linked.select("event_id", F.round(value + 1e-9, 6).alias("score")).select("event_id", "score", scoring.band(F.col("score")).alias("band"))


_RISK = f"""{_EDGES}, {_REACHED}, b AS (SELECT event_id, count(DISTINCT message_id) AS size, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS dur FROM m GROUP BY 1),
k AS (SELECT event_id, round(1e-9 + 0.25 * least(1.0, size / 20.0) + 0.25 * least(1.0, dur / 3600.0 / 168.0) + 0.25 * least(1.0, coalesce(connectivity, 0) / 20.0) + 0.25 * least(1.0, CASE WHEN starts_with(event_id, 'd') THEN size * 10.0 END / 2000.0), 6) AS score, CASE WHEN starts_with(event_id, 'd') THEN 1 END AS known FROM b LEFT JOIN c USING (event_id)),
z AS (SELECT event_id, CASE WHEN known = 1 THEN score END AS score FROM k)"""
_BAND = "CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.25 THEN 'medium' ELSE 'low' END"


@query(f"{_RISK} SELECT event_id, score, {_BAND} AS band FROM z")
def r13_risk_scores(spark, d):
    return _risks(_members(spark, d))


@query(f"{_RISK} SELECT {_BAND} AS band, count(*) AS n FROM z GROUP BY 1")
def r15_risk_stats(spark, d):
    return _risks(_members(spark, d)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


_WIDE_RISK = _RISK.replace(_EDGES, _WIDE_EDGES)


@query(f"{_WIDE_RISK} SELECT event_id, score, {_BAND} AS band FROM z")
def r13_risk_scores_wide(spark, d):
    return _risks(_wide_members(spark, d))


@query(f"{_WIDE_RISK} SELECT {_BAND} AS band, count(*) AS n FROM z GROUP BY 1")
def r15_risk_stats_wide(spark, d):
    return _risks(_wide_members(spark, d)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query()
def e10_events(spark, d):
    return pipeline_events(spark, d)


def _pipeline_places(spark, d) -> DataFrame:
    """(message_id, level, object_id, lon, lat) of every place of a message, on each level it names; global has all."""
    cases = table(spark, d, "flexible_address_izhevsk_v1").where("included_for_analysis AND message_id IS NOT NULL")
    c = F.col("selected.coordinates")
    found = cases.select("message_id", F.explode(events.scopes(F.col("city"), F.col("mention.street"), F.col("selected.candidate_id"))).alias("s"), c[0].alias("lon"), c[1].alias("lat"))
    return found.select("message_id", "s.level", "s.object_id", "lon", "lat").distinct()


def pipeline_events(spark, d) -> DataFrame:
    """Prepared messages without duplicates, with a class, clustered in all their scopes by the cosine of hashed words."""
    prepared = prepared_messages(spark, d)
    verdicts = dedup.ladder_verdicts(prepared).where("included").select("message_id")
    messages = prepared.join(verdicts, "message_id", "left_semi").select("message_id", F.col("model_text").alias("text"), "published_at")
    classes = _latest(spark, d).where("included_for_analysis").select("message_id", F.col("category.label").alias("category"), F.col("topic.label").alias("topic"))
    rows = materialize(messages.join(classes, "message_id"), "classified")
    release(prepared)
    scopes = _pipeline_places(spark, d).where("level <> 'global'").select("message_id", "level", "object_id").distinct()
    scopes = scopes.unionByName(rows.select("message_id", F.lit("global").alias("level"), F.lit("global").alias("object_id")))
    key = F.concat_ws("|", "level", "object_id", F.col("message_id").cast("string")).alias("key")
    scoped = rows.select("message_id", "published_at", "category", "topic").join(scopes, "message_id").select("*", key)
    scoped = materialize(events.with_enough_messages(scoped), "scoped")
    words = rows.select("message_id", F.regexp_extract_all(F.lower("text"), F.lit(events.WORD), F.lit(0)).alias("words"))
    vectors = events.hashing_counts(words, "message_id", "words")
    inputs = materialize(scoped.join(vectors, "message_id").select(F.concat_ws("|", "level", "object_id").alias("scope"), "key", "vector"), "event-vectors")
    edges = materialize(events.cosine_edges(inputs, forest=True), "event-edges")
    found = events.clusters(inputs, edges)
    members = materialize(scoped.join(found.select("key", "cluster"), "key"), "event-members")
    return events.aggregate_events(members).select("event_id", "level", "object_id", "size", "category", "topic", "started_at", "ended_at", "message_ids")


def event_spread(members: DataFrame, points: DataFrame) -> DataFrame:
    """(event_id, spread): metres from the centre of an event's points to the farthest of them; no row for an
    event with a message without a point. members: (event_id, level, object_id, message_id); points: (message_id, level, object_id, lon, lat).

    The centre is the mean on the plane around the spherical centroid, or that itself if a point is beyond LOCAL_RADIUS_M."""
    by = ["message_id", "level", "object_id"]
    at = members.join(points.where("lon IS NOT NULL AND lat IS NOT NULL").distinct(), by, "left")
    at = at.withColumn("whole", F.min(F.col("lon").isNotNull()).over(Window.partitionBy("event_id"))).where("whole")
    at = materialize(at.select("event_id", "lon", "lat"), "event-points")
    lon, lat = geodesy.spherical_centroid(F.col("lon"), F.col("lat"))
    placed = at.join(at.groupBy("event_id").agg(lon.alias("clon"), lat.alias("clat")), "event_id")
    placed = materialize(placed.select("event_id", geodesy.local_point("clon", "clat", "lon", "lat").alias("xy")).select("event_id", "xy.*"), "event-plane")
    centre = placed.groupBy("event_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max(F.hypot("x", "y")).alias("far"))
    wide = F.first("far")
    return placed.join(centre, "event_id").groupBy("event_id").agg(F.when(wide > LOCAL_RADIUS_M, wide).otherwise(F.max(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))).alias("spread"))


@query()
def pipeline_risk_report(spark, d) -> DataFrame:
    """The whole pipeline: prepare, drop duplicates by the ladder, join classes and places, cluster, connect, score."""
    found = materialize(pipeline_events(spark, d), "pipeline-events")
    placed = materialize(found.select("event_id", "level", "object_id", F.explode("message_ids").alias("message_id")), "placed-members")
    members = placed.select("event_id", "message_id")
    reach = scoring.external_connectivity(members, scoring.connections(members))
    rows = found.join(reach, "event_id", "left").withColumn("connectivity", F.coalesce("connectivity", F.lit(0)))
    rows = rows.join(event_spread(placed, _pipeline_places(spark, d)), "event_id", "left")
    value = scoring.score({"intensity": F.col("size"), "persistence": scoring.duration_hours(F.col("started_at"), F.col("ended_at")), "connectivity": F.col("connectivity"), "spatial_spread": F.col("spread")})
    return rows.select("event_id", "level", "object_id", "size", "category", "topic", F.round(value, 6).alias("score")).withColumn("band", scoring.band(F.col("score")))


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def q_lineitem_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@query("SELECT message_id, reason FROM (SELECT message_id, unnest(reasons) AS reason FROM classifications)")
def s18_exploded_reasons(spark, d):
    return table(spark, d, "classifications").select("message_id", F.explode("reasons").alias("reason"))


@query("SELECT message_id, CASE WHEN contains(url, 't.me/') THEN regexp_extract(url, 't\\.me/(?:s/)?([A-Za-z0-9_]+)', 1) END AS channel FROM messages WHERE url IS NOT NULL")
def pred02_telegram_channels(spark, d):
    return table(spark, d, "messages").where("url IS NOT NULL").select("message_id", F.when(F.contains("url", F.lit("t.me/")), F.regexp_extract("url", r"t\.me/(?:s/)?([A-Za-z0-9_]+)", 1)).alias("channel"))


@query("SELECT message_id, regexp_matches(url, '^https?://[^/@:]+(:(80|443))?(/|$|\\?)') AND NOT regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.)') AS safe FROM messages WHERE url IS NOT NULL")
def pred03_url_safety(spark, d):
    return table(spark, d, "messages").where("url IS NOT NULL").select("message_id", safe_url(F.col("url")).alias("safe"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'forbidden' WHEN event_id % 7 = 1 THEN 'rate_limited' WHEN contains(lower(event_type), 'error') THEN 'captcha' ELSE 'open' END AS wall FROM events")
def pred01_access_walls(spark, d):
    status = F.when(F.col("event_id") % 7 == 0, 403).when(F.col("event_id") % 7 == 1, 429).otherwise(200)
    text = F.when(F.contains(F.lower("event_type"), F.lit("error")), "Please solve the CAPTCHA").otherwise("ok")
    return table(spark, d, "events").select("event_id", access_wall(status, text).alias("wall"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1")
def s23_report_section(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, count(*) AS messages, CAST(count_if(contains(lower(text), 'двор')) AS BIGINT) AS yards, round(avg(length(text)), 4) AS mean_chars FROM messages GROUP BY 1")
def source_profile(spark, d):
    return table(spark, d, "messages").groupBy("source").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.contains(F.lower("text"), F.lit("двор"))).alias("yards"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


