from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicflow.llm import address, canonical
from civicflow.llm.lookalike import Lookalikes

REFERENCE = [(1, "street", "Нижнеканатная улица"), (2, "street", "Озёрная улица"), (3, "street", "Западноозёрная набережная"), (4, "country", "РЕСПУБЛИКА ГАРАДОКАСИЯ"), (5, "country", "КЕЛЬНЕВИЙСКИЕ О-ВА"), (6, "street", None)]


def distance(a: str, b: str) -> int:
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_and_neighbourhoods_are_complete():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("аб") for _ in range(rng.randrange(1, 7))) for _ in range(2))
        assert canonical.edits(a, b, 2) == min(3, distance(a, b))
        if distance(a, b) <= 1:
            assert canonical.neighbours(a) & canonical.neighbours(b)
        if distance(a, b) <= 2:
            assert canonical.neighbours(a, 2) & canonical.neighbours(b, 2)


CASES = [
    ("street", "нижнеканаттная", 1), ("street", "ул. Нижнеканатной", 1), ("street", "Nizhnekanatnaya", 1), ("street", "yb;ytrfyfnyfz", 1), ("street", "Нижне канатная", 1), ("street", "Н-Канатная", 1),
    ("street", "Нижнeкaнатная", 1), ("street", "озерная", 2), ("street", "З. Озёрная", 3), ("street", "Старо-озёрная", -1), ("street", "центр", -1), ("street", "?", -1), ("street", "", -1), ("street", "Дальнеканатная", -1),
    ("country", "Гарадокасия (спорн.)", 4), ("country", "гарадоксия", 4), ("country", "ГАРАДОКАСИЯ, РЕСПУБЛИКА", 4), ("country", "Кельневийские Острова*", 5), ("country", "Республика", -1), ("country", "Garadokasiya", 4), ("street", "Гарадокасия", -1),
]


def test_values_find_their_entry(spark):
    rows = [(k, i, v) for i, (k, v, _) in enumerate(CASES)] + [("street", 900, None), ("street", 901, "озерная"), ("street", 901, "озерная")]
    values = spark.createDataFrame(rows, "kind string, record_id bigint, value string").withColumn("word", F.lit("clash"))
    reference = spark.createDataFrame(REFERENCE, "ref_id bigint, kind string, name string")
    got = [(r.record_id, r.ref_id) for r in canonical.map_to_reference(values, reference).collect()]
    assert len(got) == len(CASES) + 2
    wrong = [(CASES[i], r) for i, r in got if i < 900 and r != CASES[i][2]]
    assert not wrong
    assert canonical.map_to_reference(values.limit(0), reference).count() == 0
    assert {r.ref_id for r in canonical.map_to_reference(values, reference.limit(0)).collect()} == {-1}


NAMES = [
    "Малая Садовая улица", "Новая Зеландия", "Шри Ланка", "Южная Африка", "Пушкинская улица", "Первая Садовая улица", "Папуа Новая Гвинея", "улица 8 Марта", "Коста-Рика", "Большой Каменный мост",
    "Улица", "Садовая набережная", "Буркина Фасо", "Сан Томе и Принсипи",
]
SURPLUS = [
    ("Пушкинская Ленинградская Комсомольская Первомайская", -1), ("Садовая", 12), ("Пушкинская ул., д. 5", 5), ("Новаязеландия", 2), ("Зеландия Новая", 2), ("Шри-Ланка", 3), ("Верхнесвятотроицкобогословскоя", 15),
    ("Папуа", -1), ("Малая Садовя", 1), ("Новая", -1), ("улица", 11),
]


def test_names_of_several_words_map_to_themselves_and_surplus_words_lower_the_score(spark):
    names = [*NAMES, "Верхнесвятотроицкобогословская улица"]
    rows = [("x", k, n) for k, n in enumerate(names, 1)] + [("x", 100 + k, v) for k, (v, _) in enumerate(SURPLUS)]
    values = spark.createDataFrame(rows, "kind string, record_id bigint, value string")
    reference = spark.createDataFrame([(k, "x", n) for k, n in enumerate(names, 1)], "ref_id bigint, kind string, name string")
    got = {r.record_id: r.ref_id for r in canonical.map_to_reference(values, reference).collect()}
    assert {k: got[k] for k in range(1, len(names) + 1)} == {k: k for k in range(1, len(names) + 1)}
    assert [(v, got[100 + k]) for k, (v, _) in enumerate(SURPLUS)] == SURPLUS


@pytest.mark.parametrize(
    ("text", "number", "letter", "building", "code"),
    [
        ("ул Левосмолокурной, 244", "244", "", "", None), ("Дальняя, д 127-А", "127", "а", "", None), ("697590, 224к 3 западная ул.", "224", "", "3", "697590"), ("дом 228 в ул.нижняя", "228", "в", "", None),
        ("Заводская 185 Б кв 67", "185", "б", "", None), ("Заводская, 13, подъезд 28", "13", "", "", None), ("Zavodskaya d. 59 k.1", "59", "", "1", None), ("д 13 В. Паромная", "13", "", "", None), ("Заводская", None, "", "", None), ("", None, "", "", None),
    ],
)
def test_houses(text, number, letter, building, code):
    assert address.parse(text, Lookalikes())[:4] == (code, number, letter, building)


def test_em_separates_patterns():
    patterns = [((2, 2, 2, 2, 1, 2), 500), ((0, 0, 0, 0, 0, 0), 400), ((2, 0, 0, 2, 1, 0), 300), ((2, 2, 2, 2, 1, 1), 50)]
    post = address.estimate(patterns)
    assert post[2, 2, 2, 2, 1, 2] > 0.9 and post[0, 0, 0, 0, 0, 0] < 0.1 and post[2, 2, 2, 2, 1, 1] > 0.5 and address.estimate([]) == {}


def test_linked_addresses(spark):
    label = "Ломбинск, улица Левосмолокурная, 244"
    rows = [
        (1, "Ломбинск", "ул Левосмолокурной, 244", label), (2, None, "г. Ломбинск, левосмолокурная д 244 кв 5", None), (3, "Ломбинск", "244 Levosmolokurnaya", None), (4, "Ломбинск", "Левосмолокурная 244а", None),
        (5, "Зарянка", "Левосмолокурная 244", None), (6, "Ломбинск", None, label), (7, "Ломбинск", "", label), (8, "Ломбинск", "Левосмолокурная 244", "Ломбинск, улица Левосмолокурная, 250"), (9, None, "Левосмолокурная 244", label), (10, "Ломбинск", "Л-Смолокурная, дом 244", None),
    ]
    frame = spark.createDataFrame(rows, "case_id bigint, city string, input string, label string").select("case_id", "city", "input", F.struct("label").alias("selected"), F.lit("x").alias("street"))
    got = {tuple(r) for r in address.linked_addresses(frame).collect()}
    same = [1, 2, 3, 8, 9, 10]
    assert got == {(a, b) for a in same for b in same if a < b}
    assert address.linked_addresses(frame.limit(0)).count() == 0
