from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from civicflow.llm import lookalike, neardup
from civicflow.llm.lookalike import Lookalikes, is_final, visible

BASE = "Во дворе дома третью неделю не горит фонарь возле детской площадки жители просят починить его поскорее пока никто не упал вечером"


@pytest.mark.parametrize(
    "seen",
    [
        "дoм 5, кв. ７", "ｄvor", "до​м", "до\xadм", "при\xa0вет", "мой", "ё", "a‑b", "Ho", "👩‍👩‍👧", "", " ", "\r\n", "ﬁ", "№ 5", "ΜΟСΚВА",
    ],
)
def test_forms_are_stable(seen):
    form = Lookalikes().text(seen)
    assert Lookalikes().text(form) == form


def test_same_looks_same_form_and_other_looks_other_form():
    m = Lookalikes({"^с": -1.0, "со": -1.0, "ор": -1.0})
    twins = [("мoсква", "москва"), ("TBEРЬ", "ТВЕРЬ"), ("рeка​", "река"), ("Bus", "Вus"), ("й", "й"), ("ок", "oк")]
    assert all(m.text(a + " дом") == m.text(b + " дом") for a, b in twins)
    others = [("дом", "Дом"), ("ее", "её"), ("a  b", "a b"), ("№", "No"), ("1", "l"), ("0", "О")]
    assert all(m.text(a + " дом") != m.text(b + " дом") for a, b in others)
    assert m.text("Η ΟΜΟΝΟΙΑ ΣΤΗΝ ΠΛΑΤΕΙΑ ΩΣ") == "Η ΟΜΟΝΟΙΑ ΣΤΗΝ ΠΛΑΤΕΙΑ ΩΣ" and m.text("ﬁnance 𝐇𝐞𝐥𝐥𝐨") == "finance Hello"
    assert visible("👩‍👧") == "👩‍👧" and visible("да‍") == "да"
    assert m.text("cop in the building") == "cop in the building" and m.text("сор в избе") == "сор в избе"


def test_a_final_text_is_its_own_form_and_java_agrees(spark):
    texts = [BASE, "The yard is dark and wet", "cop", "сор", "Дом с lift", "x​y", "№ 5 «да» — нет…", "", "12", BASE.replace("о", "o")]
    m = Lookalikes()
    for t in texts:
        if is_final(t):
            assert "".join(m.word(w, lookalike.prevailing(t)) if w.isalpha() else w for w in re.split(r"([^\W\d_]+)", t)) == t
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[1] for r in sorted(rows.select("k", lookalike.final_form("t")).collect())] == [is_final(t) for t in texts]


def test_lookalike_pairs(spark):
    swapped = BASE.replace("о", "o")
    rows = [(1, BASE), (2, swapped), (3, BASE), (4, BASE.upper()), (5, None), (6, ""), (7, "дoм"), (8, "дом"), (9, BASE + "​"), (10, swapped)]
    frame = spark.createDataFrame(rows, "message_id bigint, text string").withColumn("form", F.lit("clash")).withColumn("k1", F.lit(1))
    got = {tuple(r) for r in lookalike.lookalike_pairs(frame).collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9), (9, 10), (1, 10), (3, 10)}
    assert lookalike.lookalike_pairs(frame.limit(0)).count() == 0
    forms = {r.message_id: r.form for r in lookalike.all_forms(frame).collect()}
    assert len(forms) == 10 and forms[2] == forms[1] == BASE and forms[5] is None and forms[6] == "" and forms[7] == "дом"


def edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"слово{rng.randrange(10**6)}"
    return out


def pairs_by_force(rows, similarity=0.7, least=12):
    words = {i: re.findall(r"[^\W_]+", Lookalikes().text(t).lower()) for i, t in rows if t}
    sets = {i: set(w) for i, w in words.items() if len(w) >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows: list[tuple[int, str | None]] = []
    for _ in range(60):
        words = rng.sample(vocabulary, rng.randrange(12, 45))
        for n in (0, 0, 1, 2, len(words) // 6):
            rows.append((len(rows), " ".join(edited(rng, words, n))))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "too short"), (len(rows) + 3, " ".join(vocabulary[:300])), (len(rows) + 4, " ".join(vocabulary[10:305]))]
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 25, 30, 1000])
def test_near_duplicates_equal_brute_force(spark, boundary):
    rows = corpus(7)
    frame = spark.createDataFrame(rows, "message_id bigint, text string").withColumn("words", F.lit("clash"))
    got = [tuple(r) for r in neardup.near_duplicate_pairs(frame, boundary=boundary).collect()]
    want = pairs_by_force(rows)
    assert len(got) == len(set(got)) and set(got) == want


def test_classes_give_one_row_a_text(spark):
    frame = spark.createDataFrame([(1, BASE), (2, BASE), (3, BASE + " ещё"), (4, "коротко"), (5, None)], "message_id bigint, text string")
    got = {r.message_id: (r.class_id, r.copies, r.links) for r in neardup.near_duplicate_degrees(frame).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1)}
    assert neardup.near_duplicate_pairs(frame.limit(0)).count() == 0


def test_split_keys_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    frame = [" ".join(f"общее{k}" for k in range(14))]
    rows = [(k, f"{frame[0]} " + " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(5)))) for k in range(120)]
    monkeypatch.setattr(neardup, "HOT_ROWS", 10)
    for boundary in (None, 0, 15):
        got = {tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "message_id bigint, text string"), boundary=boundary).collect()}
        assert got == pairs_by_force(rows)


@pytest.mark.parametrize("leaf, boundary", [(2, None), (2, 25), (5, 1000), (40, None)])
def test_long_lists_told_apart_by_further_words_lose_no_pair(spark, monkeypatch, leaf, boundary):
    rng = random.Random(10)
    few = [f"v{k}" for k in range(9)]
    rows = [(k, text) for k, text in corpus(11)]
    rows += [(1_000 + k, " ".join(rng.choices(rng.sample(few, rng.randrange(1, 9)), k=14))) for k in range(60)]
    rows += [(2_000 + k, " ".join(edited(rng, [f"w{k}" for k in range(30)], rng.randrange(9)))) for k in range(60)]
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "CHUNK", 500)
    monkeypatch.setattr(neardup._Meeting, "GROW", 2_000)
    got = [tuple(r) for r in neardup.near_duplicate_pairs(spark.createDataFrame(rows, "message_id bigint, text string"), boundary=boundary).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_by_force(rows)


def test_compared_pairs_do_not_grow_with_the_square_of_the_sets(spark):
    compared = {}
    for total in (1_500, 6_000):
        rng = random.Random(12)
        rows = [(k, sorted(rng.sample(range(300), 30))) for k in range(total)]
        sets = spark.createDataFrame([(k, [hash((w, 5)) for w in words]) for k, words in rows], "set_id bigint, words array<bigint>")
        uses = spark.sparkContext.broadcast(neardup._uses(sets))
        lists = neardup._lists(sets, uses, 0.7, 1_000, 20, {}, 0, 1)
        compared[total] = neardup._Meeting(lists.toArrow(), 0.7, 1_000, 20).compared / total
    assert compared[6_000] < 2 * compared[1_500]


def test_beginnings_hold_the_shared_words():
    rng = random.Random(9)
    for _ in range(300):
        words = rng.sample(range(1000), 60)
        shared, rest = words[: rng.randrange(20, 40)], words[40:]
        x, y = sorted(shared + rest[: rng.randrange(5)]), sorted(shared + rest[5 : 5 + rng.randrange(5, 9)])
        if len(shared) >= 0.7 * len(set(x) | set(y)):
            x, y = sorted((x, y), key=len)
            for k in (1, 2):
                assert len(set(x[: neardup.beginnings(len(x), 0.7, k)[0]]) & set(y[: neardup.beginnings(len(y), 0.7, k)[1]])) >= k


def test_boundary_follows_cost():
    assert [neardup.plan_join({20: 1000, 400: 2}, v, 0.7) for v in (10**6, 500, 50)] == [0, 20, 400]
    assert neardup.plan_join({}, 0, 0.7) == 0


def test_long_texts_whose_words_share_sixteen_bits_are_linked(spark):
    words = [f"w{k}" for k in range(22_000)]
    rows = [(1, " ".join(words[:20_000])), (2, " ".join(words[2_000:])), (3, " ".join(words[:1_700])), (4, " ".join(words[250:1_950]))]
    frame = spark.createDataFrame(rows, "message_id bigint, text string")
    assert {tuple(r) for r in neardup.near_duplicate_pairs(frame, boundary=0).collect()} == {(1, 2), (3, 4)}
