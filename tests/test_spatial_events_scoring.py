from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicflow.functions import geodesy
from civicflow.operators import addressing, events, labeling, quality, scoring, storage
from civicflow.operators.spatial import LEVEL, _distance, cell_code, cover, disc_boxes, points_in_regions, points_near_points
from civicflow.plans import event_queries
from civicflow.sources import pages

REGIONS = "region_id bigint, lon double, lat double, radius double, geometry string"
SQUARE = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]})


def test_points_in_discs_equal_brute_force_also_over_the_antimeridian_and_poles(spark):
    rng = random.Random(1)
    points = [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(300)] + [(1000 + k, 179.9 + k / 50 - (360 if k > 4 else 0), 66.1) for k in range(10)] + [(2000, None, 1.0), (2001, 1.0, None)]
    regions = [(1, 179.95, 66.1, 9000.0, None), (2, 10.0, 89.5, 2e6, None), (3, 0.0, 0.0, 5e6, None), (4, 30.0, 50.0, 0.0, None), (5, 0.0, 0.0, 2.1e7, None), (6, None, None, 5.0, None)]
    want = {(r[0], p[0]) for r in regions if r[1] is not None for p in points if None not in p and _distance(r[1], r[2], p[1], p[2]) <= r[3]}
    got = points_in_regions(spark.createDataFrame(points, "point_id bigint, lon double, lat double"), spark.createDataFrame(regions, REGIONS)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_area_has_holes_and_joins_with_the_disc(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 3.5), (4, 5.0, 5.0), (1, 0.5, 0.5)], "point_id bigint, lon double, lat double").withColumn("geometry", F.lit("x"))
    regions = spark.createDataFrame([(1, None, None, None, SQUARE), (2, 0.0, 0.0, 150_000.0, SQUARE), (3, None, None, None, None), (4, None, None, None, "broken")], REGIONS)
    got = sorted(tuple(r) for r in points_in_regions(points, regions).collect())
    assert got == [(1, 1), (1, 1), (1, 3), (2, 1), (2, 1)]
    assert points_in_regions(points.limit(0), regions).count() == 0 and points_in_regions(points, regions.limit(0)).count() == 0


def test_near_points_and_codes(spark):
    p = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.001, 50.0), (3, 11.0, 50.0)], "point_id bigint, lon double, lat double")
    pairs = {(r.point_id, r.other_id) for r in points_near_points(p, p, 100.0).collect()}
    assert pairs == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}
    codes = [r[0] for r in p.select(cell_code(F.col("lon"), F.col("lat"))).collect()]
    cells = cover(disc_boxes(10.0, 50.0, 100_000))
    assert len(cells) < 400 and all(sum((level, c >> 2 * (LEVEL - level)) in cells for level in range(0, LEVEL + 1, 2)) == 1 for c in codes)
    for boxes in ([(-180.0, -90.0, 180.0, 90.0)], [(0.0, 0.0, 0.0, 0.0)], [(5.0, 5.0, 5.00001, 5.00001)], [(-180.0, 10.0, 180.0, 10.1)]):
        assert 1 <= len(cover(boxes)) < 4000


def test_many_points_of_one_cell_meet_only_the_regions_over_it(spark):
    points = spark.range(100_000).select(F.col("id").alias("point_id"), (10.0 + F.col("id") * 1e-10).alias("lon"), F.lit(50.0).alias("lat"))
    regions = spark.createDataFrame([(1, 10.0, 50.0, 50.0, None), (2, 10.1, 50.0, 50.0, None)] + [(3 + k, 10.003 + k, 50.0, 50.0, None) for k in range(40)], REGIONS)
    assert points_in_regions(points, regions).groupBy("region_id").count().collect() == [(1, 100_000)]


def test_geodesic_known_line_and_symmetry():
    d, _ = geodesy.geodesic([144.42486789], [-37.95103342], [143.92649553], [-37.65282114])
    assert abs(d[0] - 54972.271) < 0.001
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-179, 179, 50), rng.uniform(-80, 80, 50)
    there, back = geodesy.geodesic(a, b, a[::-1], b[::-1])[0], geodesy.geodesic(a[::-1], b[::-1], a, b)[0]
    assert np.allclose(there, back, atol=1e-3) and geodesy.geodesic([5], [5], [5], [5])[0][0] == 0
    assert np.isfinite(geodesy.geodesic([0.0], [0.0], [179.9], [0.1])[0]).all()
    east, north = geodesy.transverse_mercator(np.array([9.0]), np.array([48.0]), 9.0)
    assert abs(east[0]) < 1e-6 and abs(north[0] - 5316300.2) < 500
    assert len(geodesy.antimeridian_parts(179, 10, -179, 20)) == 2 and len(geodesy.antimeridian_parts(1, 1, 2, 2)) == 1


def test_mentions_and_candidates(spark):
    assert addressing.mention_of("на ул. Садовая, дом 5к2 темно")[1:4] == ("house", "ул. Садовая", "5к2")
    assert addressing.mention_of("Садовая 5")[1] == "house" and addressing.mention_of("ничего") is None
    rows = spark.createDataFrame([("m", "house", "street", 0.9, "a"), ("m", "house", "house", 0.4, "b"), ("n", "street", "house", 0.4, "c"), ("n", "street", "street", 0.4, "a")], "m string, mention_kind string, kind string, confidence double, candidate_id string")
    assert {r.m: r.candidate_id for r in addressing.select_candidate(rows, ["m"]).collect()} == {"m": "b", "n": "a"}


def test_cosine_edges_in_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    frame = spark.createDataFrame([("s" if k % 2 else "t", k, [float(x) for x in v[k]]) for k in range(60)], "scope string, key bigint, vector array<double>")
    got = {(r.a, r.b) for r in events.cosine_edges(frame, 0.5, block=7).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and unit[a] @ unit[b] >= 0.5}
    assert got == want
    found = events.clusters(frame, events.cosine_edges(frame, 2.0))
    assert found.count() == 0


def test_cosines_near_the_least_are_decided_in_double_precision():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(300, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    exact = np.einsum("ik,jk->ij", u, u[:200])
    for least in np.sort(exact.ravel())[[50_000, 55_000, 59_000]]:
        cut = least + 1e-12
        got = {(i, j) for part in events._alike(u, u[:200], cut) for i, j in zip(*part, strict=True)}
        assert got == {(i, j) for i, j in zip(*np.nonzero(exact >= cut), strict=True)}
    assert sum(len(i) for i, _ in events._alike(np.zeros((3, 4)), np.zeros((2, 4)), 0.5)) == 0


def test_scores_stay_null_when_an_indicator_is_missing(spark):
    rows = spark.createDataFrame([(10, 84.0, 10, 1000.0), (10, None, 10, 1000.0), (100, 500.0, 99, 9e9)], "s int, p double, c int, d double")
    value = scoring.score({"intensity": F.col("s"), "persistence": F.col("p"), "connectivity": F.col("c"), "spatial_spread": F.col("d")})
    out = rows.select(F.round(value, 6).alias("v")).select("v", scoring.band(F.col("v"))).collect()
    assert [tuple(r) for r in out] == [(0.5, "high"), (None, "unavailable"), (1.0, "critical")]


def test_connections_use_whole_ids(spark):
    m = spark.createDataFrame([("a", "12"), ("a", "3"), ("b", "1"), ("b", "23"), ("c", "3"), ("c", "12"), ("c", "9")], "event_id string, message_id string")
    edges = scoring.connections(m)
    assert [tuple(r) for r in edges.collect()] == [("a", "c", 2, 0.666667)]
    assert {r.event_id: r.connectivity for r in scoring.external_connectivity(m, edges).collect()} == {"a": 1}


def test_calibration_labels_and_quality(spark):
    curve = [(0.0, 0.0), (0.5, 0.2), (1.0, 1.0)]
    rows = spark.createDataFrame([(0.0,), (0.25,), (0.75,), (1.0,), (None,)], "s double")
    assert [r[0] for r in rows.select(labeling.calibrate(F.col("s"), curve)).collect()] == [0.0, 0.1, 0.6, 1.0, None]
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "expected string, predicted string")
    got = {r.label: (r.precision, r.recall, r.support) for r in quality.label_metrics(pairs).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 0), "c": (1.0, 1.0, 1)}
    assert math.isclose(quality.total_variation(pairs, pairs, "expected").first()[0], 0.0)


def test_storage(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, v int, x string")
    assert {r.k: r.x for r in storage.upsert(old, new, ["k"], "v").collect()} == {1: "c", 2: "b", 3: "d"}
    assert {r.k: r.x for r in storage.insert_if_absent(old, new, ["k"]).collect()} == {1: "a", 2: "b", 3: "d"}
    assert storage.assert_unique(old, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        storage.assert_unique(old.unionByName(old), ["k"]).count()


def test_pages_and_paged_reads(spark, tmp_path):
    page = "<html><head><title>T</title><meta property='og:title' content='O'></head><body><div id='c'><p class='x'>one</p><p>two</p></div><p class='x'>three</p></body></html>"
    assert pages.page_fields(page)["title"] == "O" and pages.select(page, "#c p.x") == ["one"] and pages.select(page, "p.x") == ["one", "three"]
    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"source": "s", "external_id": "1", "text": "t"}]}) + "\n")
    spark.dataSource.register(pages.PagedJson)
    rows = spark.read.format("paged_json").option("path", str(tmp_path)).load().collect()
    assert [(r.source, r.external_id, r.url) for r in rows] == [("s", "1", None)]


@pytest.mark.parametrize("per_bitmap", [1, 64, 10**9])
def test_connectivity_of_large_events_equals_brute_force(spark, monkeypatch, per_bitmap):
    monkeypatch.setattr(scoring, "LARGE_PER_BITMAP", per_bitmap)
    rng = random.Random(4)
    held = {"wide": {f"m{k}" for k in range(400)}, "alone": {"z"}} | {f"e{n}": {f"m{rng.randrange(600)}" for _ in range(rng.randrange(1, 9))} for n in range(80)}
    m = spark.createDataFrame([(e, i) for e, ids in held.items() for i in ids], "event_id string, message_id string")
    want = {}
    for e, ids in held.items():
        reached = set().union(*(other for o, other in held.items() if o != e and other & ids)) - ids
        if reached:
            want[e] = len(reached)
    assert {r.event_id: r.connectivity for r in scoring.external_connectivity(m, scoring.connections(m)).collect()} == want


@pytest.mark.parametrize(("events_", "messages", "each"), [(12, 60, 9), (40, 30, 3), (80, 600, 9)])
def test_connectivity_by_triangles_equals_brute_force(spark, monkeypatch, events_, messages, each):
    monkeypatch.setattr(scoring, "FEW", 20)
    rng = random.Random(7)
    held = {"wide": {f"m{k}" for k in range(messages * 2 // 3)}, "alone": {"z"}} | {f"e{n}": {f"m{rng.randrange(messages)}" for _ in range(rng.randrange(1, each))} for n in range(events_)}
    m = spark.createDataFrame([(e, i) for e, ids in held.items() for i in [*ids, min(ids)]] + [(None, "m1"), ("e1", None), ("none", None)], "event_id string, message_id string")
    want = {e: (len(ids), len(set().union(*(other for other in held.values() if other & ids)) - ids)) for e, ids in held.items()}
    assert {r.event_id: (r.size, r.connectivity) for r in scoring.connectivity(m).collect()} == want
    assert scoring.connectivity(m.limit(0)).count() == 0


def test_forest_edges_have_the_components_of_all_edges(spark):
    rng = np.random.default_rng(6)
    near = [(k, (rng.normal(size=64) * 0.06 + np.eye(64)[k % 9]).tolist()) for k in range(150)]
    v = spark.createDataFrame([("s", f"k{k:03}", x) for k, x in near], "scope string, key string, vector array<double>")
    whole, forest = events.cosine_edges(v, block=40), events.cosine_edges(v, block=40, forest=True)
    groups = lambda e: sorted((r.key, r.cluster) for r in events.clusters(v, e).collect())
    assert forest.count() < whole.count() and groups(forest) == groups(whole) != []


def test_pipeline_keeps_the_global_scope_every_place_and_the_least_size(spark, monkeypatch):
    rows = [(i, "s", str(i), None, f"{word} во дворе не горит фонарь и нет воды", i, False) for i, word in enumerate(("один", "два", "три", "четыре", "пять", "шесть"))]
    prepared = spark.createDataFrame(rows, "message_id bigint, source string, external_id string, url string, model_text string, s bigint, rejected boolean").withColumn("published_at", F.timestamp_seconds(F.col("s") * 200_000))
    classes = spark.createDataFrame([(i, ("ЖКХ",), ("свет",), True) for i in range(6)], "message_id bigint, category struct<label:string>, topic struct<label:string>, included_for_analysis boolean")
    kind = "case_id bigint, message_id bigint, city string, mention struct<street:string>, selected struct<candidate_id:string,coordinates:array<double>>, included_for_analysis boolean"
    cases = [(i, i, "Ижевск", ("Ленина",), ("b1", [53.0, 56.0]), True) for i in range(6)] + [(10 + i, i, "Ижевск", ("Мира",), (f"c{i}", [53.0 + i / 100, 56.0]), True) for i in range(6)]
    monkeypatch.setattr(event_queries, "prepared_messages", lambda spark, d: prepared)
    monkeypatch.setattr(event_queries, "_latest", lambda spark, d: classes)
    monkeypatch.setattr(event_queries, "table", lambda spark, d, name: spark.createDataFrame(cases, kind))
    got = {(r.level, r.object_id): (r.size, r.score) for r in event_queries.pipeline_risk_report(spark, "").collect()}
    assert {k: v[0] for k, v in got.items()} == {("global", "global"): 6, ("road", "road:ижевск:ленина"): 6, ("road", "road:ижевск:мира"): 6, ("building", "b1"): 6}
    assert all(v[1] is not None for v in got.values()) and got["road", "road:ижевск:мира"][1] > got["building", "b1"][1]


def test_counts_of_hashed_words_have_the_direction_of_the_embedding(spark):
    texts = spark.createDataFrame([(1, ["нет", "воды", "нет", "света"]), (2, []), (3, None), (4, ["вода"] * 300)], "message_id bigint, words array<string>")
    want = {r.message_id: r.vector for r in events.hashing_embedding(texts.select("message_id", F.explode("words").alias("word")), "message_id").collect()}
    got = {r.message_id: np.array(r.vector) for r in events.hashing_counts(texts, "message_id", "words").collect()}
    assert got.keys() == want.keys() == {1, 4} and all((got[m] / np.linalg.norm(got[m]) == want[m]).all() for m in want)
    assert abs(got[4]).max() == 300


def test_products_of_several_tiles_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(events, "TILE", (7, 11))
    rng = np.random.default_rng(8)
    u = rng.normal(size=(50, 6))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    exact = np.einsum("ik,jk->ij", u, u)
    for v, one in ((u, True), (u[:33], False)):
        want = {(i, j) for i, j in zip(*np.nonzero(exact[:, : len(v)] >= 0.4), strict=True) if i < j or not one}
        assert {(i, j) for part in events._alike(u, v, 0.4, one) for i, j in zip(*part, strict=True)} == want


def test_blocks_of_one_scope_spread_over_tasks(spark):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([("s", k, rng.normal(size=3).tolist()) for k in range(60)], "scope string, key bigint, vector array<double>")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    tasks = events.cosine_edges(v, 0.9, block=5).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 20
