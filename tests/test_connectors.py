from __future__ import annotations

import json

from pyspark.sql import functions as F

from civicflow.sources import connectors as C


def test_wall_and_discussion_payloads(spark):
    page = {"response": {"count": 1, "items": [{"id": 5, "owner_id": -1, "from_id": 7, "date": 0, "text": "post", "comments": [{"id": 9, "from_id": 8, "date": 60, "text": "reply"}]}]}}
    rows = C.wall_messages(C.from_json(spark.createDataFrame([(json.dumps(page),)], "json string"), C.WALL)).collect()
    assert {(r.external_id, r.text, r.kind, r.author_id) for r in rows} == {("-1_5", "post", "post", "7"), ("-1_5_9", "reply", "comment", "8")}
    talk = {"id": "d", "comments": [{"id": "1", "author_id": "a", "date_ms": 1000, "text": "t"}]}
    rows = C.discussion_messages(C.from_json(spark.createDataFrame([(json.dumps(talk),)], "json string"), C.DISCUSSION)).collect()
    assert [(r.external_id, r.text, r.url) for r in rows] == [("d:1", "t", None)]


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x/1</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0300</pubDate></item></channel></rss>")
    rows = C.feed_items(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.title, r.link, r.description, r.published.hour) for r in rows] == [("A", "http://x/1", "d", 7)]


def test_lists_keep_their_order(spark):
    hits = spark.createDataFrame([("q", [("u1", "t1"), ("u2", "t2")])], "query string, hits array<struct<url:string,title:string>>")
    assert [(r.rank, r.url) for r in C.search_hits(hits).orderBy("rank").collect()] == [(0, "u1"), (1, "u2")]
    jobs = spark.createDataFrame([(1, {"s": [("a",), ("b",)]})], "job int, messages map<string,array<struct<text:string>>>")
    assert [(r.place, r.text) for r in C.flatten_collections(jobs).orderBy("place").collect()] == [(0, "a"), (1, "b")]


def test_policies_and_coverage(spark):
    m = spark.createDataFrame([("s", "1", "t", None, "u", "a"), ("x", "2", "t", None, "u", "a")], "source string, external_id string, text string, published_at timestamp, url string, author_id string")
    p = spark.createDataFrame([("s", ["url"])], "source string, allowed array<string>")
    assert {(r.source, r.url, r.author_id) for r in C.masked_by_policy(m, p).collect()} == {("s", "u", None), ("x", None, None)}
    planned = spark.createDataFrame([("s", "collected"), ("z", "failed")], "source string, state string")
    assert {(r.source, r.n) for r in C.coverage(m, planned).collect()} == {("s", 1), ("z", 0)}
    urls = spark.createDataFrame([("HTTP://A.ru:80",), ("ftp://x",), (None,)], "url string")
    assert [r[0] for r in urls.select(C.canonical_web_url(F.col("url"))).collect()] == ["http://a.ru/", None, None]
