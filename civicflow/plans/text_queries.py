"""Queries over texts: normalization, fingerprints, duplicates, urls, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.functions import text as T
from civicflow.operators import dedup, normalize
from civicflow.plans.registry import query
from civicflow.session import materialize
from civicflow.sources.tables import table

_LINES = ", ".join(f"'{x}'" for x in T.TECHNICAL_LINES)
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B\x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*')"
_LANGUAGE = """CASE WHEN coalesce(cyr + lat, 0) < 3 THEN 'unknown' WHEN cyr >= 0.8 * (cyr + lat) THEN 'ru' WHEN lat >= 0.8 * (cyr + lat) THEN 'en' ELSE 'mixed' END"""
_SCRIPTS = "SELECT *, length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) AS cyr, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS lat FROM messages"
_MARKERS = " OR ".join(f"contains(lower(text), '{m}')" for m in T.RECURRENCE_MARKERS)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


@query(r"SELECT message_id, regexp_replace(text, '[\p{Cf}\p{Co}\x00-\x08\x0B-\x1F\x7F-\x9F]', '', 'g') AS text FROM messages")
def t03_remove_controls(spark, d):
    return _messages(spark, d).select("message_id", T.remove_controls(F.col("text")).alias("text"))


@query(f"SELECT message_id, {_CLEAN} AS text FROM messages")
def t04_normalize_whitespace(spark, d):
    return _messages(spark, d).select("message_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(f"SELECT message_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: lower(trim(x)) NOT IN ({_LINES})), chr(10)) AS text FROM messages")
def t05_drop_technical_lines(spark, d):
    return _messages(spark, d).select("message_id", T.drop_technical_lines(F.col("text")).alias("text"))


@query(
    r"""SELECT message_id, array_to_string(list_filter(string_split(regexp_replace(text, '\[quote\].*?(\[/quote\]|$)', '', 'gs'), chr(10)), lambda x: NOT starts_with(ltrim(x), '>')), chr(10)) AS text,
    array_to_string(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '>')), chr(10)) AS quotes FROM messages"""
)
def t06_split_quotes(spark, d):
    c = F.col("text")
    return _messages(spark, d).select("message_id", T.without_quotes(c).alias("text"), F.array_join(T.quoted_lines(c), "\n").alias("quotes"))


@query()
def t01_html_text(spark, d):
    return _messages(spark, d).select("message_id", normalize.html_text("text").alias("h")).select("message_id", "h.text", "h.quote")


@query("SELECT message_id, nfc_normalize(text) AS text FROM messages WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x20-\\x7Eа-яА-ЯёЁ«»—]*')")
def t02_compatibility_form(spark, d):
    rows = _messages(spark, d).where(F.col("text").rlike("^[\\x20-\\x7Eа-яА-ЯёЁ«»—]*\\z"))
    return rows.select("message_id", normalize.compatibility_form("text").alias("text"))


@query()
def t02_compatibility_form_all(spark, d):
    rows = _messages(spark, d).where("text IS NOT NULL")
    return rows.select("message_id", normalize.compatibility_form("text").alias("text"))


@query()
def t07_preprocessed(spark, d):
    return normalize.preprocess(_messages(spark, d))


@query(f"SELECT message_id, {_LANGUAGE} AS language FROM ({_SCRIPTS})")
def t08_script_language(spark, d):
    return _messages(spark, d).select("message_id", T.script_language(F.col("text")).alias("language"))


@query(
    rf"""WITH p AS (SELECT message_id, split_part(split_part(url, '#', 1), '?', 1) AS base, split_part(split_part(url, '#', 1), '?', 2) AS q, url FROM messages),
    o AS (SELECT *, regexp_extract(base, '^[^:/]+://[^/]*') AS origin FROM p),
    r AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{T.TRACKING}'))), '&') AS kept FROM o)
    SELECT message_id, lower(origin) || regexp_replace(substring(base, length(origin) + 1), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM r"""
)
def t09_canonical_url(spark, d):
    return _messages(spark, d).select("message_id", T.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT message_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, array_to_string({_TOKENS}, ' ') AS tokens FROM messages WHERE text IS NOT NULL")
def t11_tokens(spark, d):
    rows = _messages(spark, d).where("text IS NOT NULL").select("message_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("message_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("SELECT message_id, sha256(lower(source) || chr(0) || external_id) AS identity_sha256, sha256(lower(text)) AS text_sha256 FROM messages")
def t12_fingerprints(spark, d):
    return _messages(spark, d).select("message_id", T.identity_digest(F.col("source"), F.col("external_id")).alias("identity_sha256"), F.sha2(F.lower("text"), 256).alias("text_sha256"))


@query()
def t13_simhash(spark, d):
    return _messages(spark, d).where("text IS NOT NULL").select("message_id", normalize.simhash64("text").alias("simhash"))


@query(
    "SELECT event_id, CAST(b AS INT) AS band, (h >> (b * 16)) & 65535 AS bits FROM (SELECT event_id, event_id * 2654435761 AS h FROM events), (SELECT unnest([0, 1, 2, 3]) AS b)"
)
def t14_bands(spark, d):
    h = F.col("event_id") * F.lit(2654435761)
    rows = table(spark, d, "events").select("event_id", F.explode(T.bands(h)).alias("k"))
    return rows.select("event_id", F.col("k.band").alias("band"), F.col("k.bits").alias("bits"))


@query("SELECT event_id, CAST(bit_count(xor(event_id * 2654435761, (event_id + 1) * 2654435761)) AS INTEGER) AS distance FROM events")
def t15_hamming(spark, d):
    k = F.lit(2654435761)
    return table(spark, d, "events").select("event_id", T.hamming(F.col("event_id") * k, (F.col("event_id") + 1) * k).alias("distance"))


@query(
    f"""WITH t AS (SELECT message_id, source, external_id, list_distinct({_TOKENS}) AS w FROM messages WHERE text IS NOT NULL)
    SELECT a.message_id AS a, b.message_id AS b, round(len(list_intersect(a.w, b.w)) / CAST(nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0) AS DOUBLE), 6) AS jaccard
    FROM t a JOIN t b ON a.source = b.source AND a.external_id = b.external_id AND a.message_id < b.message_id WHERE len(a.w) + len(b.w) > 0"""
)
def t16_redelivered_jaccard(spark, d):
    t = _messages(spark, d).where("text IS NOT NULL").select("message_id", "source", "external_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    pairs = t.alias("a").join(t.alias("b"), F.expr("a.source = b.source AND a.external_id = b.external_id AND a.message_id < b.message_id"))
    pairs = pairs.where("size(a.w) + size(b.w) > 0")
    return pairs.select(F.col("a.message_id").alias("a"), F.col("b.message_id").alias("b"), F.round(T.token_jaccard(F.col("a.w"), F.col("b.w")), 6).alias("jaccard"))


@query(
    """SELECT decision, reasons, count(*) AS n FROM (SELECT CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS decision, reasons FROM (
    SELECT concat_ws(',', CASE WHEN length(text) > 200000 THEN 'TEXT_TOO_LONG' END, CASE WHEN coalesce(length(text), 0) < 2 THEN 'MODEL_TEXT_TOO_SHORT' END,
    CASE WHEN NOT coalesce(regexp_matches(published_at_raw, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$'), false) THEN 'PUBLISHED_AT_MISSING_TIMEZONE' END) AS reasons FROM messages)) GROUP BY ALL"""
)
def t17_decisions(spark, d):
    reasons = F.array_join(T.rejections(F.col("text"), T.has_offset(F.col("published_at_raw"))), ",")
    rows = _messages(spark, d).select(reasons.alias("reasons"))
    return rows.groupBy(F.when(F.col("reasons") == "", "accepted").otherwise("rejected").alias("decision"), "reasons").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT case_id, trim(regexp_replace(regexp_replace(input, '\[[^\]]*\]', '', 'g'), '(\d+)', ' \1 ', 'g')) AS text, array_to_string(regexp_extract_all(input, '\d+'), ',') AS numbers FROM flexible_address_izhevsk_v1")
def t18_street_text(spark, d):
    rows = table(spark, d, "flexible_address_izhevsk_v1")
    text = F.trim(F.regexp_replace(F.regexp_replace("input", r"\[[^\]]*\]", ""), r"(\d+)", " $1 "))
    return rows.select("case_id", text.alias("text"), F.array_join(F.regexp_extract_all("input", F.lit(r"\d+"), F.lit(0)), ",").alias("numbers"))


@query(r"SELECT ref_id, trim(lower(string_split_regex(name, '(улица|набережная|аллея)')[1])) AS stem FROM reference_names WHERE kind = 'street'")
def t19_street_stems(spark, d):
    return table(spark, d, "reference_names").where("kind = 'street'").select("ref_id", F.trim(F.lower(F.element_at(F.split("name", "(улица|набережная|аллея)"), 1))).alias("stem"))


@query("SELECT message_id, array_to_string(list_sort(list_filter(map_keys(metadata), lambda k: k IN ('kind', 'lang', 'reply_to', 'likes'))), ',') AS kept FROM messages WHERE metadata IS NOT NULL")
def t20_metadata_whitelist(spark, d):
    kept = F.map_filter("metadata", lambda k, v: k.isin("kind", "lang", "reply_to", "likes"))
    return _messages(spark, d).where("metadata IS NOT NULL").select("message_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"))


@query()
def t21_author_pseudonyms(spark, d):
    return _messages(spark, d).select("message_id", normalize.pseudonym("test-secret", F.col("source"), F.col("author_id")).alias("author"))


@query(
    """SELECT message_id, CASE WHEN split_part(source, ':', 1) IN ('vk', 'ok', 'web', 'dzen') THEN url END AS url, CASE WHEN split_part(source, ':', 1) IN ('vk', 'ok') THEN author_id END AS author_id,
    CASE WHEN split_part(source, ':', 1) = 'vk' THEN latitude END AS latitude FROM messages"""
)
def t22_masked_fields(spark, d):
    rules = spark.createDataFrame([("vk", ["url", "author_id", "coordinates"]), ("ok", ["url", "author_id"]), ("web", ["url"]), ("dzen", ["url"])], "platform string, allowed array<string>")
    rows = _messages(spark, d).withColumn("platform", F.split_part("source", F.lit(":"), F.lit(1))).join(F.broadcast(rules), "platform", "left")
    keep = lambda field, c: F.when(F.array_contains("allowed", field), F.col(c)).alias(c)
    return rows.select("message_id", keep("url", "url"), keep("author_id", "author_id"), keep("coordinates", "latitude"))


@query("SELECT case_id AS id, epoch_ms(1700000000000 + case_id * 1000) AS seconds_time, epoch_ms(1700000000123 + case_id) AS millis_time FROM flexible_address_izhevsk_v1")
def t23_epoch_times(spark, d):
    rows = table(spark, d, "flexible_address_izhevsk_v1").select("case_id", (F.lit(1700000000) + F.col("case_id")).cast("string").alias("s"), (F.lit(1700000000123) + F.col("case_id")).cast("string").alias("ms"))
    return rows.select(F.col("case_id").alias("id"), T.epoch_or_iso(F.col("s")).cast("timestamp_ntz").alias("seconds_time"), T.epoch_or_iso(F.col("ms")).cast("timestamp_ntz").alias("millis_time"))


@query("SELECT coalesce(regexp_matches(published_at_raw, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$'), false) AS has_zone, published_at IS NULL AS unknown, count(*) AS n FROM messages GROUP BY ALL")
def t24_strict_times(spark, d):
    rows = _messages(spark, d).select(T.has_offset(F.col("published_at_raw")).alias("has_zone"), F.isnull("published_at").alias("unknown"))
    return rows.groupBy("has_zone", "unknown").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT message_id, substring(sha256(source || '|' || external_id), 1, 24) AS id24, substring(sha256(source || '|' || external_id), 1, 32) AS id32 FROM messages")
def t25_stable_ids(spark, d):
    s, e = F.col("source"), F.col("external_id")
    return _messages(spark, d).select("message_id", T.stable_id(s, e).alias("id24"), T.stable_id(s, e, length=32).alias("id32"))


_EXACT = f"""WITH k AS (SELECT *, CASE WHEN length(trim(text)) > 0 THEN sha256(lower(text)) ELSE '#' || message_id END AS key FROM messages),
w AS (SELECT *, row_number() OVER g AS n, first_value(message_id) OVER g AS first_id, first_value(source) OVER g AS fs, first_value(external_id) OVER g AS fe, first_value(published_at) OVER g AS ft
FROM k WINDOW g AS (PARTITION BY key ORDER BY published_at ASC NULLS LAST, lower(source), external_id, message_id)),
v AS (SELECT message_id, source, first_id, CASE WHEN n = 1 THEN 'unique' WHEN lower(source) = lower(fs) AND external_id <> fe AND (({_MARKERS}) OR coalesce(floor(epoch(published_at)) - floor(epoch(ft)), 0) >= 86400) THEN 'repeated_appeal'
WHEN lower(source) <> lower(fs) THEN 'cross_source_repost' ELSE 'technical_duplicate' END AS kind FROM w)"""


def _verdicts(spark, d):
    return dedup.exact_verdicts(_messages(spark, d))


@query(f"{_EXACT} SELECT *, kind IN ('unique', 'repeated_appeal') AS included FROM v")
def d02_exact_verdicts(spark, d):
    return _verdicts(spark, d)


@query()
def d03_near_duplicate_edges(spark, d):
    return dedup.near_duplicate_edges(_messages(spark, d))


def prepared_messages(spark, d) -> DataFrame:
    """Messages with their model text, as the ladder reads them."""
    rows = normalize.preprocess(_messages(spark, d).where("message_id IS NOT NULL"), "url", "published_at")
    return materialize(rows.select("message_id", "source", "external_id", "url", "published_at", "model_text", (F.size("rejection_reasons") > 0).alias("rejected")), "prepared")


@query()
def d02_greedy_verdicts(spark, d):
    return dedup.ladder_verdicts(prepared_messages(spark, d))


@query(f"{_EXACT} SELECT source, kind, count(*) AS n FROM v GROUP BY ALL")
def d04_verdicts_by_source(spark, d):
    return _verdicts(spark, d).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT message_id, coalesce({_MARKERS}, false) AS recurring FROM messages")
def d05_recurrence_markers(spark, d):
    return _messages(spark, d).select("message_id", T.has_recurrence_marker(F.col("text")).alias("recurring"))


@query(
    f"""{_EXACT} SELECT count(*) AS total, CAST(count_if(kind = 'unique') AS BIGINT) AS "unique", CAST(count_if(kind = 'repeated_appeal') AS BIGINT) AS repeated_appeal, CAST(count_if(kind = 'cross_source_repost') AS BIGINT) AS cross_source_repost,
    CAST(count_if(kind = 'technical_duplicate') AS BIGINT) AS technical_duplicate, CAST(count_if(kind IN ('unique', 'repeated_appeal')) AS BIGINT) AS included FROM v"""
)
def d06_batch_stats(spark, d):
    return dedup.verdict_counts(_verdicts(spark, d))


@query("SELECT message_id, source, external_id FROM messages QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY ingested_at, message_id) = 1")
def d07_ingest_dedup(spark, d):
    rows = _messages(spark, d).select("message_id", "source", "external_id", "ingested_at")
    return dedup.first_wins(rows, ["source", "external_id"], ["ingested_at", "message_id"]).select("message_id", "source", "external_id")


@query("SELECT lower(text) AS key, min(message_id) AS message_id FROM messages WHERE length(text) BETWEEN 1 AND 30 GROUP BY 1 ORDER BY 2 LIMIT 250")
def d08_first_wins_cap(spark, d):
    rows = _messages(spark, d).where(F.length("text").between(1, 30)).select(F.lower("text").alias("key"), "message_id")
    return dedup.first_wins(rows, ["key"], ["message_id"]).orderBy("message_id").limit(250)


@query("SELECT lower(text) AS key, min(message_id) AS message_id FROM messages WHERE text IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 250")
def d08_first_wins_cap_all(spark, d):
    rows = _messages(spark, d).where("text IS NOT NULL").select(F.lower("text").alias("key"), "message_id")
    return dedup.first_wins(rows, ["key"], ["message_id"]).orderBy("message_id").limit(250)


@query("SELECT selected.candidate_id AS candidate_id, max(selected.confidence) AS confidence FROM flexible_address_izhevsk_v1 WHERE selected.candidate_id IS NOT NULL GROUP BY 1")
def d09_best_candidate(spark, d):
    rows = table(spark, d, "flexible_address_izhevsk_v1").where("selected.candidate_id IS NOT NULL")
    return rows.groupBy(F.col("selected.candidate_id").alias("candidate_id")).agg(F.max("selected.confidence").alias("confidence"))


@query(f"SELECT source, {_LANGUAGE} AS language, count(*) AS n FROM ({_SCRIPTS}) GROUP BY ALL")
def usable_messages_by_language(spark, d):
    return _messages(spark, d).groupBy("source", T.script_language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
