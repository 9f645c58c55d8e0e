from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicflow.functions import text as T
from civicflow.operators import dedup, normalize
from civicflow.operators.graph import connected_components

MESSAGES = "message_id bigint, source string, external_id string, text string, published_at timestamp, published_at_raw string"


def column(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("expression", "value", "expected"),
    [
        (T.remove_controls, "a​b\x07c\n\td", "abc\n\td"),
        (T.normalize_whitespace, " a   b\r\n\r\n\r\n\r\nc ", "a b\n\nc"),
        (T.drop_technical_lines, "текст\n Читать далее \nещё", "текст\nещё"),
        (T.without_quotes, "> старое\nновое [quote]x\ny[/quote]!\n[quote]z", "новое !\n"),
        (T.script_language, "двор", "ru"),
        (T.script_language, "yard двор", "mixed"),
        (T.script_language, "12", "unknown"),
        (T.script_language, None, "unknown"),
        (T.canonical_url, "HTTPS://Ex.RU/Path/?utm_source=x&b=2&a=1#top", "https://ex.ru/Path?a=1&b=2"),
        (T.has_recurrence_marker, "Опять нет света", True),
        (T.has_offset, "2024-01-01T10:00:00", False),
        (T.has_offset, "2024-01-01T10:00:00+03:00", True),
    ],
)
def test_text_columns(spark, expression, value, expected):
    assert column(spark, expression, [value]) == [expected]


def test_rejections_name_every_reason(spark):
    rows = spark.createDataFrame([("x" * 3, True), (None, False)], "t string, ok boolean")
    assert [r[0] for r in rows.select(T.rejections(F.col("t"), F.col("ok"))).collect()] == [[], ["MODEL_TEXT_TOO_SHORT", "PUBLISHED_AT_MISSING_TIMEZONE"]]


def test_markup_drops_scripts_and_keeps_quotes():
    assert normalize.markup_to_text("a &amp; b") == ("a & b", "")
    text, quote = normalize.markup_to_text("<p>one</p><script>x</script><blockquote>old</blockquote><p>two</p>")
    assert text.split() == ["one", "two"] and quote == "old"


def test_trace_links_each_step_to_the_last(spark):
    rows = spark.createDataFrame([(1, "s", "1", "<b>Ａ​</b>  b", None, "2024-01-01T00:00:00Z"), (2, "s", "2", None, None, None)], MESSAGES)
    out = {r.message_id: r for r in normalize.preprocess(rows).collect()}
    assert out[1].model_text == "A b" and out[1].rejection_reasons == []
    steps = out[1].transformations
    assert all(a.output_sha256 == b.input_sha256 for a, b in zip(steps, steps[1:], strict=False))
    assert "MODEL_TEXT_TOO_SHORT" in out[2].rejection_reasons


def test_simhash_of_small_edits_is_near():
    text = "во дворе дома не горит фонарь уже третью неделю и жители просят его починить"
    a, b = normalize.simhash(text), normalize.simhash(text + "!")
    assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3 and normalize.simhash("") == normalize.simhash("")


def test_exact_verdicts(spark):
    rows = [
        (1, "a", "1", "нет света", "2024-01-01 00:00:00", None), (2, "a", "1", "нет света", "2024-01-01 01:00:00", None), (3, "a", "2", "Нет света", "2024-01-03 00:00:00", None),
        (4, "b", "9", "нет света", "2024-01-01 02:00:00", None), (5, "b", "8", None, None, None), (6, "b", "7", "  ", None, None), (7, "b", "6", "  ", None, None),
    ]
    frame = spark.createDataFrame(rows, MESSAGES.replace("published_at timestamp", "published_at string")).withColumn("published_at", F.col("published_at").cast("timestamp"))
    kinds = {r.message_id: r.kind for r in dedup.exact_verdicts(frame).collect()}
    assert kinds == {1: "unique", 2: "technical_duplicate", 3: "repeated_appeal", 4: "cross_source_repost", 5: "unique", 6: "unique", 7: "unique"}
    assert dedup.exact_verdicts(frame.limit(0)).count() == 0


def brute_greedy(order, edges):
    near = {}
    for a, b, s in edges:
        near.setdefault(a, []).append((s, b))
        near.setdefault(b, []).append((s, a))
    place = {n: k for k, n in enumerate(order)}
    kept, out = set(), {}
    for n in order:
        best = min(((-s, place[o], o) for s, o in near.get(n, ()) if o in kept), default=None)
        out[n] = n if best is None else best[2]
        if best is None:
            kept.add(n)
    return out


def test_greedy_rounds_equal_the_sequential_ladder(spark):
    rng = random.Random(3)
    ids = list(range(40))
    edges = sorted({(a, b) for a, b in (sorted(rng.sample(ids, 2)) for _ in range(60))})
    scored = [(a, b, round(rng.choice([0.88, 0.9, 0.95]), 2)) for a, b in edges]
    rows = spark.createDataFrame([(i, "s", str(i), "t", None, None) for i in ids], MESSAGES)
    got = {r.message_id: r.first_id for r in dedup.greedy_verdicts(rows, spark.createDataFrame(scored, "a bigint, b bigint, similarity double")).collect()}
    want = brute_greedy(ids, scored)
    assert got == {n: want[n] for n in got} and len(got) == len({x for e in edges for x in e})


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [tuple(rng.sample(range(60), 2)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_ladder(rows, near):
    """The sequential ladder; rows: (id, source, external_id, url, text, seconds, again)."""
    order = sorted(rows, key=lambda r: (2**62 if r[5] is None else r[5], r[1], r[2], r[0]))
    kept, out = [], {}
    for r in order:
        best, step = None, None
        for name, k in (("identity", lambda x: (x[1], x[2])), ("url", lambda x: x[3]), ("text", lambda x: x[4])):
            best = next((x for x in kept if k(x) is not None and k(x) == k(r)), None)
            if best:
                step = name
                break
        if not best:
            found = [(-near[r[4], x[4]], n, x) for n, x in enumerate(kept) if (r[4], x[4]) in near]
            best, step = (min(found)[2], "near") if found else (None, None)
        repeated = best and best[1] == r[1] and best[2] != r[2] and (r[6] or r[5] is not None and best[5] is not None and r[5] - best[5] >= 86400)
        kind = "unique" if not best else "repeated_appeal" if repeated else "cross_source_repost" if best[1] != r[1] else "technical_duplicate"
        if kind in ("unique", "repeated_appeal"):
            kept.append(r)
        out[r[0]] = (best[0] if best else r[0], step, kind)
    return out


def test_ladder_equals_the_sequential_one_and_has_every_message(spark):
    rng = random.Random(11)
    base = [" ".join(rng.sample([f"слово{k}" for k in range(300)], 40)) for _ in range(6)]
    texts = [b + tail for b in base for tail in ("", "!", " ещё")]
    texts += [f"снова {base[0]}", f"{base[1]}?"]
    rows = []
    for n in range(160):
        text = rng.choice(texts)
        rows.append((n, rng.choice("ab"), str(rng.randrange(90)), rng.choice([None, None, None, f"https://x.ru/{rng.randrange(40)}"]), text, rng.choice([None, rng.randrange(0, 400_000, 1000)]), text.startswith("снова")))
    frame = spark.createDataFrame([(*r[:6], False) for r in rows] + [(999, "a", "z", None, "", None, True)], "message_id bigint, source string, external_id string, url string, model_text string, s bigint, rejected boolean")
    frame = frame.withColumn("published_at", F.timestamp_seconds("s"))
    ids = {t: min(r[0] for r in rows if r[4] == t) for t in {r[4] for r in rows}}
    by_id = {v: k for k, v in ids.items()}
    near = {}
    for e in dedup.near_duplicate_edges(frame.where("NOT rejected").select("message_id", F.col("model_text").alias("text"))).collect():
        near[by_id[e.a], by_id[e.b]] = near[by_id[e.b], by_id[e.a]] = e.similarity
    got = {r.message_id: (r.first_id, r.step, r.kind) for r in dedup.ladder_verdicts(frame).collect()}
    want = brute_ladder(rows, near) | {999: (999, None, "rejected")}
    assert near and {k for _, _, k in want.values()} >= {"repeated_appeal", "cross_source_repost", "technical_duplicate"} and {s for _, s, _ in want.values()} >= {"identity", "url", "text", "near"}
    assert got == want


def test_greedy_rounds_that_do_not_settle_raise(spark):
    rows = spark.createDataFrame([(i, "s", str(i), "t", None, None) for i in range(6)], MESSAGES)
    chain = spark.createDataFrame([(i, i + 1, 0.9) for i in range(5)], "a bigint, b bigint, similarity double")
    with pytest.raises(RuntimeError, match="not settled"):
        dedup.greedy_verdicts(rows, chain, max_rounds=1)


def test_addresses_of_private_networks_are_not_safe(spark):
    from civicflow.functions.text import safe_url

    bad = ["http://172.16.0.1/", "http://172.31.9.9", "http://169.254.169.254/x", "http://0.0.0.0/", "http://[::1]/", "http://[fc00::1]/", "http://[fe80::1]:80/", "http://10.1.1.1", "http://localhost:80/", "ftp://a.test/", "http://u:p@a.test/", "http://a.test:8080/", "", "x"]
    good = ["http://172.32.0.1/", "https://a.test", "https://a.test:443/x?y=1", "http://[2001:4860::1]/", "https://10.test/"[:8] + "b.test/a@b"]
    rows = spark.createDataFrame([(u, u in good) for u in bad + good] + [(None, None)], "url string, want boolean")
    assert [tuple(r) for r in rows.select("url", "want", safe_url(rows.url).alias("safe")).collect() if r[1] != r[2]] == []


def test_similarity_hashes_of_many_texts_equal_single_ones():
    texts = ["нет воды во дворе", "", "!!", "а", "а б", "Straße weiß ŉ k", "\u0345x y z"] + [f"слово{k} и {k % 7} раз в доме" for k in range(200)]
    assert normalize.simhashes(texts, least=50).tolist() == [normalize.simhash(t) for t in texts]
    assert normalize.simhash("один два три четыре") == normalize.simhash("Один ДВА три - четыре!")


def test_bounded_similarity_equals_the_ratio_from_its_least_on(spark):
    rng = random.Random(2)
    words = [f"слово{k}" for k in range(30)]
    pairs = []
    for _ in range(300):
        a = rng.sample(words, 12)
        b = [w if rng.random() < 0.8 else rng.choice(words) for w in a]
        pairs.append((" ".join(a), " ".join(b), round(rng.random(), 3)))
    rows = spark.createDataFrame([*pairs, ("a", None, 0.5), ("", "", 0.0), ("аааа бббб", "вввв гггг", 0.1)], "a string, b string, o double")
    got = rows.select(F.greatest(normalize.sequence_ratio("a", "b"), "o").alias("whole"), normalize.similarity_from(0.8)("a", "b", F.col("o")).alias("bounded")).collect()
    assert all(r.whole == r.bounded or max(r.whole, r.bounded) < 0.8 for r in got) and any(r.whole != r.bounded for r in got)


def test_rows_that_meet_no_other_take_no_part_in_the_rounds(spark, monkeypatch):
    rows = [(i, "s", str(i), None, f"совсем другой текст номер {i} про дом {i * i}", i) for i in range(40)] + [(50, "s", "50", None, "снова нет света", 1), (51, "t", "51", None, "снова нет света", 2)]
    frame = spark.createDataFrame(rows, "message_id bigint, source string, external_id string, url string, model_text string, s bigint").withColumns({"rejected": F.lit(False), "published_at": F.timestamp_seconds("s")})
    seen, inner = [], dedup.materialize
    monkeypatch.setattr(dedup, "_near_edges", lambda texts: (spark.createDataFrame([], "a bigint, b bigint, similarity double"), spark.createDataFrame([], "a int")))
    monkeypatch.setattr(dedup, "materialize", lambda df, label: seen.append((label, inner(df, label))) or seen[-1][1])
    got = {r.message_id: r for r in dedup.ladder_verdicts(frame).collect()}
    assert len(got) == 42 and not got[51].included and got[51].first_id == 50 and all(r.included and r.first_id == i and r.kind == "unique" for i, r in got.items() if i != 51)
    assert [t for label, t in seen if label == "ladder-state"][-1].count() == 2
