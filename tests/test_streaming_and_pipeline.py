from __future__ import annotations

import json

from pyspark.sql import functions as F

from civicflow.plans import pipeline
from civicflow.streaming import ingest


def test_stream_keeps_first_deliveries(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    row = lambda i, t: json.dumps({"source": "s", "external_id": i, "text": "x", "published_at": t})
    (folder / "a.json").write_text(row("1", "2024-01-01T00:00:00Z") + "\n" + row("1", "2024-01-01T01:00:00Z") + "\n" + row("2", "2024-01-01T02:00:00Z"))
    stream = ingest.first_deliveries(ingest.read_messages(spark, str(folder)))
    ingest.append_to(stream, str(out), str(tmp_path / "cp")).awaitTermination()
    (folder / "b.json").write_text(row("2", "2024-01-01T03:00:00Z") + "\n" + row("3", "2024-01-01T03:00:00Z"))
    ingest.append_to(stream, str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.external_id for r in spark.read.parquet(str(out)).collect()) == ["1", "2", "3"]


def test_window_counts(spark):
    rows = spark.createDataFrame([("s", "2024-01-01 00:10:00"), ("s", "2024-01-01 00:50:00"), ("t", "2024-01-01 01:10:00")], "source string, t string").withColumn("published_at", F.col("t").cast("timestamp"))
    assert sorted((r.source, r.n) for r in ingest.counts_per_window(rows).collect()) == [("s", 2), ("t", 1)]


def test_pipeline_resumes_and_reruns_on_other_settings(spark, tmp_path):
    runs = []

    def stage(name):
        def run(session, tables):
            runs.append(name)
            return session.range(len(tables) + 1)

        return run

    def build(config):
        p = pipeline.Pipeline(spark, str(tmp_path / "job"), config)
        return p.add("COLLECTION", stage("c")).add("EVENTS", stage("e"))

    build({"a": 1}).run(until="COLLECTION")
    tables = build({"a": 1}).run()
    assert runs == ["c", "e"] and tables["EVENTS"].count() == 2
    build({"a": 2}).run()
    assert runs == ["c", "e", "c", "e"]


def test_canonical_json_and_redaction():
    assert pipeline.canonical_json({"b": 1, "a": "я"}) == '{"a":"я","b":1}'
    assert pipeline.digest([1]) != pipeline.digest(["1"])
    assert pipeline.redact({"x": [{"api_token": "t", "y": 1}]}) == {"x": [{"api_token": "***", "y": 1}]}
