"""The pN_ queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicflow.llm import address, canonical, garble, leakage, lookalike, neardup, pii, tokenize, toxicity
from civicflow.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    values = canonical.address_and_country_values(table(spark, d, "flexible_address_izhevsk_v1"), table(spark, d, "exceptions_countries"))
    return canonical.map_to_reference(values, table(spark, d, "reference_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return address.linked_addresses(table(spark, d, "flexible_address_izhevsk_v1"))


def p3_components(spark: SparkSession, d: str) -> DataFrame:
    return address.address_components(table(spark, d, "flexible_address_izhevsk_v1"))


def _scored(spark: SparkSession, d: str, only_found: bool) -> DataFrame:
    messages = table(spark, d, "messages")
    model = toxicity.fit_from_labels(messages, table(spark, d, "message_labels"))
    return toxicity.score_messages(messages, model, only_found)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, True).select("message_id")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, False)


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates_by_source(table(spark, d, "messages"), _scored(spark, d, False))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(table(spark, d, "messages")).select("message_id", F.col("kind").alias("pii_kind")).distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    return pii.masked_texts(messages, pii.personal_spans(messages))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "messages"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.all_forms(table(spark, d, "messages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.decode_ids(p8_ids(spark, d), tokenize.pieces(spark))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_coverage(spark, d).select("doc_id", "item_id").distinct()


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored_documents(table(spark, d, "documents"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_degrees(table(spark, d, "messages"))


def p10_mappings(spark: SparkSession, d: str) -> DataFrame:
    return garble.learned_mappings(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


#: Texts encoded and decoded again are as they were.
DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
#: All runs of twelve words of both sides.
LEAKED = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
     dr AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
     er AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (run)
"""


def oracle_sql() -> dict[str, str]:
    return {"p8_decoded": DECODED, "p9_found": LEAKED}
