"""Queries over labels, their quality, storage tables and joins between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.operators import labeling, quality
from civicflow.operators.dedup import first_wins
from civicflow.operators.storage import backoff_s, retain, upsert
from civicflow.plans.registry import query
from civicflow.sources.tables import table

RULES = {"roads": ("маршрут", "асфальт", "тротуар"), "yards": ("двор", "лавочка", "забор"), "networks": ("труба", "теплотрасса", "кабель")}
CURVE = [(0.0, 0.0), (0.5, 0.4), (0.8, 0.75), (1.0, 1.0)]
_LONG = " UNION ALL ".join(f"SELECT message_id, '{k}' AS label, ({' + '.join(f'CAST(contains(lower(text), {chr(39)}{w}{chr(39)}) AS INT)' for w in ws)}) / 3.0 AS score FROM messages WHERE text IS NOT NULL" for k, ws in RULES.items())
_TOP = f"WITH s AS ({_LONG}), f AS (SELECT * FROM s WHERE score > 0) SELECT message_id, label, score FROM f QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY score DESC, label) = 1"


def _scored(spark, d) -> DataFrame:
    rows = table(spark, d, "messages").where("text IS NOT NULL").select("message_id", F.explode(labeling.keyword_scores(F.col("text"), RULES)).alias("s"))
    return rows.select("message_id", "s.label", F.col("s.score").alias("score"))


def _latest(spark, d) -> DataFrame:
    """One classification per message: the latest."""
    rows = table(spark, d, "classifications")
    order = Window.partitionBy("message_id").orderBy(F.desc("classified_at"), "model_revision")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


_LATEST = "SELECT * FROM classifications QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY classified_at DESC NULLS LAST, model_revision) = 1"


@query("SELECT m.message_id FROM messages m WHERE length(trim(m.text)) > 0 AND m.published_at IS NOT NULL")
def c01_eligible(spark, d):
    return table(spark, d, "messages").where((F.length(F.trim("text")) > 0) & F.col("published_at").isNotNull()).select("message_id")


@query()
def c02_batched_predictions(spark, d):
    def load():
        def model(texts: list[str]) -> list[list[tuple[str, float]]]:
            return [[(k, sum(w in t.lower() for w in ws) / len(ws)) for k, ws in RULES.items()] for t in texts]

        return model

    return labeling.predict(table(spark, d, "messages"), "text", load)


@query(f"WITH t AS ({_TOP}) SELECT message_id, label, round(score, 6) AS score FROM t")
def c03_top_label(spark, d):
    return labeling.top_label(_scored(spark, d)).select("message_id", "label", F.round("score", 6).alias("score"))


@query(f"WITH l AS ({_LATEST}), h AS (SELECT category.label AS c, topic.label AS t, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 3) SELECT message_id FROM l JOIN h ON category.label = c AND topic.label = t")
def c04_within_hierarchy(spark, d):
    rows = _latest(spark, d).select("message_id", F.col("category.label").alias("category"), F.col("topic.label").alias("topic"))
    hierarchy = rows.groupBy("category", "topic").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return labeling.within_hierarchy(rows, hierarchy).select("message_id")


@query(
    f"""SELECT message_id, CAST(floor(round(CASE WHEN s <= 0.5 THEN s * 0.8 WHEN s <= 0.8 THEN 0.4 + (s - 0.5) * (0.35 / 0.3) WHEN s <= 1.0 THEN 0.75 + (s - 0.8) * (0.25 / 0.2) END, 6) * 10000 + 0.001) AS BIGINT) AS calibrated
    FROM (SELECT message_id, category.score AS s FROM ({_LATEST}))"""
)
def c05_calibrated(spark, d):
    return _latest(spark, d).select("message_id", F.floor(labeling.calibrate(F.col("category.score"), CURVE) * 10000 + 0.001).cast("bigint").alias("calibrated"))


@query(
    f"""SELECT message_id, CASE WHEN c < 0.65 OR coalesce(t, 0) < 0.60 THEN 'low' WHEN c >= 0.85 AND t >= 0.85 THEN 'high' ELSE 'medium' END AS band,
    concat_ws(',', CASE WHEN c < 0.65 THEN 'category_below_threshold' END, CASE WHEN t < 0.60 THEN 'topic_below_threshold' END, CASE WHEN t IS NULL THEN 'topic_missing' END) AS reasons
    FROM (SELECT message_id, category.score AS c, topic.score AS t FROM ({_LATEST})) WHERE c IS NOT NULL"""
)
def c06_confidence_bands(spark, d):
    c, t = F.col("category.score"), F.col("topic.score")
    rows = _latest(spark, d).where(c.isNotNull())
    return rows.select("message_id", labeling.confidence_band(c, t).alias("band"), F.array_join(labeling.low_confidence_reasons(c, t), ",").alias("reasons"))


@query(f"SELECT confidence_band, count(*) AS n, CAST(count_if(low_confidence) AS BIGINT) AS low, CAST(count_if(included_for_analysis) AS BIGINT) AS included, round(avg(category.score), 6) AS mean FROM ({_LATEST}) GROUP BY ALL")
def c07_batch_stats(spark, d):
    return _latest(spark, d).groupBy("confidence_band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("low_confidence").alias("low"), F.count_if("included_for_analysis").alias("included"), F.round(F.avg("category.score"), 6).alias("mean")
    )


@query(f"WITH s AS ({_LONG}), f AS (SELECT * FROM s WHERE score > 0) SELECT message_id, string_agg(label || ':' || CAST(CAST(round(score * 3) AS INT) AS VARCHAR), '; ' ORDER BY score DESC, label) AS pair FROM f GROUP BY 1")
def c08_joined_labels(spark, d):
    ranked = labeling.top_k(_scored(spark, d), 3)
    text = F.concat("label", F.lit(":"), F.round(F.col("score") * 3).cast("int").cast("string"))
    rows = ranked.select("message_id", "rank", text.alias("x")).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("xs"))
    return rows.select("message_id", F.array_join(F.transform("xs", lambda x: x["x"]), "; ").alias("pair"))


@query(f"WITH s AS ({_LONG}), f AS (SELECT * FROM s WHERE score > 0) SELECT message_id, label, CAST(row_number() OVER (PARTITION BY message_id ORDER BY score DESC, label) AS INT) AS rank FROM f QUALIFY rank <= 2")
def c09_top_k_labels(spark, d):
    return labeling.top_k(_scored(spark, d), 2).select("message_id", "label", F.col("rank").cast("int").alias("rank"))


@query(f"WITH l AS ({_LATEST}) SELECT count(*) AS missing FROM (SELECT DISTINCT category.label AS x FROM l EXCEPT SELECT DISTINCT category.label FROM classifications)")
def c11_label_space_differs(spark, d):
    a = _latest(spark, d).select("category.label").distinct()
    return a.exceptAll(table(spark, d, "classifications").select("category.label").distinct()).agg(F.count(F.lit(1)).alias("missing"))


_HOSTS = "CASE " + " ".join(f"WHEN host = '{h}' OR ends_with(host, '.{h}') THEN '{k}'" for h, k in labeling.HOSTS.items())


@query(
    rf"""SELECT message_id, {_HOSTS} WHEN regexp_matches(host, '(\.|^)(gov|gosuslugi)\.ru$') OR regexp_matches(host, 'администрац|муниципал|мэрия') THEN 'municipal'
    WHEN starts_with(host, 'forum.') OR contains(path, '/forum') OR regexp_matches(host, 'форум') THEN 'local_forum' WHEN regexp_matches(host, 'новост|news|газета|media') THEN 'local_media' ELSE 'other_web' END AS kind
    FROM (SELECT message_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/]+([^?#]*)', 1)) AS path FROM messages WHERE url IS NOT NULL)"""
)
def c12_source_kinds(spark, d):
    return table(spark, d, "messages").where("url IS NOT NULL").select("message_id", labeling.source_kind(F.col("url")).alias("kind"))


_SELF = f"""SELECT a.category.label AS expected, b.category.label AS predicted, b.category.score AS score FROM ({_LATEST}) a JOIN classifications b ON a.message_id = b.message_id WHERE a.category.label IS NOT NULL AND b.category.label IS NOT NULL"""


def _self_pairs(spark, d) -> DataFrame:
    a = _latest(spark, d).where("category.label IS NOT NULL").select("message_id", F.col("category.label").alias("expected"))
    b = table(spark, d, "classifications").where("category.label IS NOT NULL").select("message_id", F.col("category.label").alias("predicted"), F.col("category.score").alias("score"))
    return a.join(b, "message_id")


@query(f"SELECT expected, predicted, count(*) AS n FROM ({_SELF}) GROUP BY ALL")
def q01_confusion(spark, d):
    return quality.confusion(_self_pairs(spark, d))


@query(
    f"""WITH p AS ({_SELF}), l AS (SELECT DISTINCT expected AS label FROM p UNION SELECT DISTINCT predicted FROM p),
    c AS (SELECT label, (SELECT count(*) FROM p WHERE expected = label AND predicted = label) AS tp, (SELECT count(*) FROM p WHERE expected = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS claimed FROM l)
    SELECT label, round(CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (claimed + support) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM c"""
)
def q01_label_metrics(spark, d):
    return quality.label_metrics(_self_pairs(spark, d))


@query(
    f"""WITH b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(CAST(expected = predicted AS INT)) AS acc, avg(score) AS conf, sum((score - CAST(expected = predicted AS INT)) ** 2) AS sq FROM ({_SELF}) WHERE score IS NOT NULL GROUP BY 1)
    SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b"""
)
def q02_ece_brier(spark, d):
    rows = _self_pairs(spark, d).where("score IS NOT NULL").select("score", (F.col("expected") == F.col("predicted")).cast("int").alias("correct"))
    return quality.ece_brier(rows)


@query(f"SELECT round(avg(CAST(expected = predicted AS INT)), 6) AS accuracy, round(avg(CAST(score < 0.65 AS INT)), 6) AS low_rate, count(*) AS n FROM ({_SELF}) WHERE score IS NOT NULL")
def q03_evaluation_report(spark, d):
    rows = _self_pairs(spark, d).where("score IS NOT NULL")
    return rows.agg(F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("score") < 0.65).cast("int")), 6).alias("low_rate"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT category.label AS label, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_LATEST}) WHERE category.label IS NOT NULL GROUP BY 1")
def q04_label_distribution(spark, d):
    rows = _latest(spark, d).select(F.col("category.label").alias("label"))
    return quality.distribution(rows, "label").select("label", F.round("share", 6).alias("share"))


@query(
    """WITH a AS (SELECT category.label AS l, count(*) / sum(count(*)) OVER () AS p FROM classifications WHERE category.label IS NOT NULL AND message_id % 2 = 0 GROUP BY 1),
    b AS (SELECT category.label AS l, count(*) / sum(count(*)) OVER () AS p FROM classifications WHERE category.label IS NOT NULL AND message_id % 2 = 1 GROUP BY 1)
    SELECT round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2, 6) AS drift FROM a FULL JOIN b ON a.l = b.l"""
)
def q05_label_drift(spark, d):
    rows = table(spark, d, "classifications").select("message_id", F.col("category.label").alias("label"))
    return quality.total_variation(rows.where("message_id % 2 = 0"), rows.where("message_id % 2 = 1"), "label")


@query(
    """WITH o AS (SELECT city, list_sort(list(selected.confidence)) AS v, median(selected.confidence) AS med, count(*) AS n, CAST(count_if(selected.kind = mention.kind) AS BIGINT) AS same_kind
    FROM flexible_address_izhevsk_v1 WHERE city IS NOT NULL AND selected.confidence IS NOT NULL GROUP BY 1)
    SELECT city, round(med, 6) AS median, round(v[CAST(round_even((n - 1) * 0.95, 0) AS INT) + 1], 6) AS p95, n, same_kind FROM o"""
)
def q06_geocoding_by_city(spark, d):
    rows = table(spark, d, "flexible_address_izhevsk_v1").where("city IS NOT NULL AND selected.confidence IS NOT NULL").select("city", "selected.confidence", F.col("selected.kind").alias("sk"), F.col("mention.kind").alias("mk"))
    return rows.groupBy("city").agg(
        F.round(F.percentile("confidence", 0.5), 6).alias("median"), F.round(quality.nearest_rank(F.col("confidence"), 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("sk") == F.col("mk")).alias("same_kind")
    )


@query("SELECT round(avg(CAST(mention.text IS NOT NULL AND trim(input) = mention.text AS INT)), 6) AS exact_rate, coalesce(round(avg(CAST(selected.confidence < 0.25 AS INT)), 6), 1.0) AS low_rate FROM flexible_address_izhevsk_v1")
def q07_extraction_rates(spark, d):
    rows = table(spark, d, "flexible_address_izhevsk_v1")
    exact = F.col("mention.text").isNotNull() & (F.trim("input") == F.col("mention.text"))
    return rows.agg(F.round(F.avg(exact.cast("int")), 6).alias("exact_rate"), F.coalesce(F.round(F.avg((F.col("selected.confidence") < 0.25).cast("int")), 6), F.lit(1.0)).alias("low_rate"))


@query(
    f"""WITH m AS (SELECT avg(CAST(expected = predicted AS INT)) AS accuracy, avg(CAST(score < 0.65 AS INT)) AS low_rate FROM ({_SELF}) WHERE score IS NOT NULL)
    SELECT 'accuracy' AS gate, accuracy >= 0.75 AS passed FROM m UNION ALL SELECT 'low_rate', low_rate <= 0.2 FROM m"""
)
def q08_release_gates(spark, d):
    rows = _self_pairs(spark, d).where("score IS NOT NULL")
    metrics = rows.agg(F.avg((F.col("expected") == F.col("predicted")).cast("int")).alias("accuracy"), F.avg((F.col("score") < 0.65).cast("int")).alias("low_rate"))
    return quality.all_gates_pass(metrics, {"accuracy": (">=", 0.75), "low_rate": ("<=", 0.2)}).select("gate", "passed")


@query(
    """SELECT source, concat_ws(',', CASE WHEN share_url < 0.5 THEN 'urls_missing' END, CASE WHEN share_author < 0.5 THEN 'authors_missing' END) AS reasons FROM
    (SELECT source, avg(CAST(url IS NOT NULL AS INT)) AS share_url, avg(CAST(author_id IS NOT NULL AS INT)) AS share_author FROM messages GROUP BY 1)"""
)
def q09_source_gate(spark, d):
    g = table(spark, d, "messages").groupBy("source").agg(F.avg(F.col("url").isNotNull().cast("int")).alias("u"), F.avg(F.col("author_id").isNotNull().cast("int")).alias("a"))
    return g.select("source", F.concat_ws(",", F.when(F.col("u") < 0.5, "urls_missing"), F.when(F.col("a") < 0.5, "authors_missing")).alias("reasons"))


@query("SELECT source, count(*) AS n, count(DISTINCT external_id) AS items, CAST(count_if(text IS NULL) AS BIGINT) AS empty, min(published_at) AS first_at, max(published_at) AS last_at FROM messages GROUP BY 1")
def q10_source_coverage(spark, d):
    return table(spark, d, "messages").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("external_id").alias("items"), F.count_if(F.col("text").isNull()).alias("empty"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")
    )


@query(f"SELECT m.message_id, coalesce(c.included_for_analysis, false) AS included, c.category.label AS category FROM messages m LEFT JOIN ({_LATEST}) c USING (message_id)")
def j01_left_join_default_false(spark, d):
    c = _latest(spark, d).select("message_id", "included_for_analysis", F.col("category.label").alias("category"))
    return table(spark, d, "messages").select("message_id").join(c, "message_id", "left").select("message_id", F.coalesce("included_for_analysis", F.lit(False)).alias("included"), "category")


@query(f"SELECT a.case_id, m.message_id, c.category.label AS category FROM flexible_address_izhevsk_v1 a JOIN messages m ON a.message_id = m.message_id JOIN ({_LATEST}) c ON c.message_id = m.message_id WHERE a.included_for_analysis AND c.included_for_analysis")
def j02_stage_join(spark, d):
    a = table(spark, d, "flexible_address_izhevsk_v1").where("included_for_analysis").select("case_id", "message_id")
    c = _latest(spark, d).where("included_for_analysis").select("message_id", F.col("category.label").alias("category"))
    return a.join(table(spark, d, "messages").select("message_id"), "message_id").join(c, "message_id").select("case_id", "message_id", "category")


@query("SELECT coalesce(a.message_id, b.message_id) AS message_id, a.message_id IS NOT NULL AS in_classes, b.message_id IS NOT NULL AS in_labels FROM (SELECT DISTINCT message_id FROM classifications) a FULL JOIN (SELECT DISTINCT message_id FROM message_labels) b USING (message_id)")
def j05_full_outer_keys(spark, d):
    a = table(spark, d, "classifications").select("message_id").distinct().withColumn("x", F.lit(True))
    b = table(spark, d, "message_labels").select("message_id").distinct().withColumn("y", F.lit(True))
    return a.join(b, "message_id", "full").select("message_id", F.col("x").isNotNull().alias("in_classes"), F.col("y").isNotNull().alias("in_labels"))


@query("SELECT message_id, split_part(source, ':', 1) AS platform, CASE WHEN ends_with(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.example') THEN 'example' ELSE 'other' END AS zone FROM messages WHERE url IS NOT NULL")
def j09_host_suffix(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, d, "messages").where("url IS NOT NULL").select("message_id", F.split_part("source", F.lit(":"), F.lit(1)).alias("platform"), F.when(F.endswith(host, F.lit(".example")), "example").otherwise("other").alias("zone"))


@query("SELECT message_id FROM messages WHERE message_id NOT IN (SELECT message_id FROM classifications)")
def j08_anti_join(spark, d):
    return table(spark, d, "messages").select("message_id").join(table(spark, d, "classifications").select("message_id"), "message_id", "left_anti")


@query("SELECT event_type, count(*) AS total, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high, min(value) FILTER (WHERE value > 50) AS least_high, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span_s FROM events GROUP BY 1")
def k01_filtered_aggregates(spark, d):
    span = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("high"), F.min(F.when(F.col("value") > 50, F.col("value"))).alias("least_high"), span.alias("span_s"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) = 1")
def k02_next_in_queue(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return first_wins(rows, ["o_custkey"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT event_type, user_id, max_by(value, event_id) AS value FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY ALL")
def k03_upsert_latest(spark, d):
    e = table(spark, d, "events")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["event_type", "user_id"], "event_id").select("event_type", "user_id", "value")


@query("SELECT event_id, least(1 * 2 ** (event_id % 10), 300.0) AS delay, CASE WHEN event_id % 10 >= 8 THEN 'failed' ELSE 'queued' END AS status FROM events")
def k04_release_with_backoff(spark, d):
    n = F.col("event_id") % 10
    return table(spark, d, "events").select("event_id", backoff_s(n + 1, 1.0, 2.0, 300.0).alias("delay"), F.when(n >= 8, "failed").otherwise("queued").alias("status"))


@query("SELECT o_orderkey FROM orders o WHERE NOT ((o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01') OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1993-01-01'))")
def k07_retention(spark, d):
    return retain(table(spark, d, "orders"), "o_orderstatus", "o_orderdate", {"F": "1995-01-01", "O": "1993-01-01"}).select("o_orderkey")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > (SELECT max(ts) FROM events)")
def k08_ttl_cache_read(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.expr("ts + INTERVAL 7 DAY > now")).select("event_id")  # one row is broadcast


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def s20_latest_artifact(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j11_dimension_join(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def period_filter(spark, d):
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS n FROM e GROUP BY 1")
def session_events(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTE"), 0).otherwise(1))
    return rows.groupBy("user_id").agg(F.sum("new").cast("bigint").alias("sessions"), F.count(F.lit(1)).alias("n"))
