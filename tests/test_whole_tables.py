from __future__ import annotations

import unicodedata

import test_catalog
from pyspark.sql import functions as F

from civicflow.plans import text_queries


def test_compatibility_form_of_all_texts_equals_unicodedata(spark, monkeypatch):
    texts = ["ＡＢ　７", "и\u0306", "a\xa0b", "№ 5", "ﬁ\nx", "plain", "²", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "message_id bigint, text string")
    monkeypatch.setattr(text_queries, "_messages", lambda spark, d: rows)
    got = {r.message_id: r.text for r in text_queries.t02_compatibility_form_all(spark, "").collect()}
    assert got == {k: unicodedata.normalize("NFKC", t) for k, t in enumerate(texts) if t is not None}
    assert any(got[k] != texts[k] for k in got)


def test_first_wins_reads_texts_of_every_length(spark, monkeypatch):
    rows = spark.createDataFrame([(3, "А" * 90), (2, "а" * 90), (1, ""), (4, None)], "message_id bigint, text string")
    monkeypatch.setattr(text_queries, "_messages", lambda spark, d: rows)
    got = text_queries.d08_first_wins_cap_all(spark, "").select("key", F.col("message_id")).collect()
    assert {tuple(r) for r in got} == {("", 1), ("а" * 90, 2)}


def test_first_wins_equals_its_oracle(spark):
    test_catalog.test_queries_equal_their_oracles(spark, "d08_first_wins_cap_all")
