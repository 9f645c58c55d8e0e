from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civicflow.llm import garble, leakage, pii, tokenize, toxicity
from civicflow.llm.lookalike import Lookalikes

RU = "Уже 24 дней дачники решили обрезать забор у магазина, где треснувшая дорожка насквозь стоит."


def test_tokens_equal_the_public_encoder_with_and_without_a_tail(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(1)
    texts = [RU, "", None, "a  b\n\n c", "<|endoftext|>", "don't I'll", "👩‍👧 ½ x²", " ", "\t\n", "слово " * 3000, RU]
    texts += ["".join(rng.choice("ab я1.\n'é👍") for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("ids", F.lit(1))
    want = {k: reference.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    for head in (400_000, 5):
        encoded = tokenize.encode_texts(frame, head_words=head)
        assert {r.doc_id: list(r.ids) for r in encoded.collect()} == want
    back = {r.doc_id: r.text for r in tokenize.decode_ids(encoded, tokenize.pieces(spark)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert tokenize.encode_texts(frame.limit(0)).count() == 0


def runs(a, b, n):
    grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
    return any(tuple(a[k : k + n]) in grams for k in range(len(a) - n + 1))


def test_coverage_decides_where_asked(spark):
    item = [f"w{k}" for k in range(40)]
    d = spark.createDataFrame([(1, " ".join(item[:12])), (2, " ".join(item[20:] + ["x"] + item[:20]))], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    assert {(r.doc_id, r.coverage) for r in leakage.leaks(d, e).collect()} == {(1, 0.3), (2, 1.0)}
    assert [r.doc_id for r in leakage.leaks(d, e, coverage=0.5).collect()] == [2]


def test_tiles_cover_reordered_passages_and_never_overlap():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(30)]
        b = a[15:] + ["x"] + a[:14] + [rng.choice("abc") for _ in range(5)]
        found = leakage.tiles(a, b, 5)
        used_a = [k for i, _, n in found for k in range(i, i + n)]
        used_b = [k for _, j, n in found for k in range(j, j + n)]
        assert len(used_a) == len(set(used_a)) and len(used_b) == len(set(used_b))
        assert all(a[i : i + n] == b[j : j + n] and n >= 5 for i, j, n in found) and found
    assert leakage.tiles([], ["a"], 3) == [] and leakage.tiles(list("abc"), list("abd"), 3) == []


@pytest.mark.parametrize("limit", [leakage.BROADCAST_WORDS, 0])
def test_leaks_equal_brute_force(spark, limit):
    rng = random.Random(3)
    item = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join(item[5:17]) + "!"), (2, " ".join(item[5:16])), (3, None), (4, ""), (5, "X " + ", ".join(item[20:33]).upper() + "\n" + " ".join(item[:13])), (6, " ".join(rng.sample(item, 40))), (6, "y " * 5000 + " ".join(item))]
    items = [(1, "t", " ".join(item), None), (2, "t", None, None), (3, "t", "", None), (4, "t", " ".join(item), None), (5, "t", "one two three", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id bigint, task string, text string, question string")
    got = sorted((r.doc_id, r.item_id, r.tiles) for r in leakage.leaks(d, e, broadcast_words=limit).collect())
    assert got == [(1, 1, 1), (1, 4, 1), (5, 1, 2), (5, 4, 2), (6, 1, 1), (6, 4, 1)]
    assert leakage.leaks(d.limit(0), e, broadcast_words=limit).count() == 0 and leakage.leaks(d, e.limit(0), broadcast_words=limit).count() == 0


COMMON = frozenset("ст но то на ен ов ни ра во ко ро ос по ка ли ет та ре ть не го ер ал пр ор ан ол ит ла ва де ом ел ск ма ло ти ат ие тр ес од об ль ны ви ам ин им ем да за ар ак ой ый ая ую".split())


def misread(text: str, written: str, read: str) -> str:
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(written))


@pytest.mark.parametrize("pair", [("utf-8", "cp1251"), ("utf-8", "latin-1"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "mac-roman")])
def test_garbled_text_comes_back_by_a_learned_table_only(pair):
    clean = RU.replace("—", "-")
    broken = misread(clean, *pair)
    votes = [(k, c, g, 1) for k, c, g in garble.align(broken, clean)]
    learned = garble.taught(votes, COMMON)
    assert pair in learned.pairs
    text, kinds, lost, _ = garble.restore(f"{clean}\n{broken}", garble.Learned((pair,), {}, COMMON).tables(), COMMON)
    assert text == f"{clean}\n{clean}" and kinds == [f"{pair[0]}>{pair[1]}"] and lost == 0
    assert garble.restore(f"{clean}\n{broken}", [], COMMON)[:2] == (f"{clean}\n{broken}", [])


def corpus_with(broken: str, twins: int) -> list[tuple[int, str]]:
    rng = random.Random(6)
    words = "маршрут опаздывает жители починить фонарь забор площадке вечером покосилась скамейка просят двора администрация ответила заявку кровля протекает магазин дорожка провалилась".split()
    rows = [(k, " ".join(rng.choices(words, k=9)).capitalize() + ".") for k in range(60)]
    return rows + [(100 + k, misread(t, *broken.split(">"))) for k, (_, t) in enumerate(rows[:twins])]


def test_without_twins_nothing_is_restored(spark):
    alone = corpus_with("koi8-r>cp1251", 0) + [(200, misread("Старая скамейка у магазина опять покосилась, жители просят починить.", "koi8-r", "cp1251"))]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    assert garble.restored_documents(frame(alone)).count() == 0
    taught = corpus_with("koi8-r>cp1251", 3) + alone[-1:]
    got = {r.doc_id: (r.restored, r.kinds) for r in garble.restored_documents(frame(taught)).collect()}
    assert got[200] == ("Старая скамейка у магазина опять покосилась, жители просят починить.", ["koi8-r>cp1251"]) and set(got) == {100, 101, 102, 200}
    assert {r.kind for r in garble.learned_mappings(frame(taught)).collect()} == {"koi8-r>cp1251"}


def test_a_mapping_that_no_pair_of_encodings_explains_is_learned_by_characters(spark):
    shift = {ord(c): chr(0xC0 + k) for k, c in enumerate("абвгдежзийклмнопрстуфхцчшщъыьэюя")}
    rows = corpus_with("koi8-r>cp1251", 0)
    taught = rows + [(100 + k, t.lower().translate(shift)) for k, (_, t) in enumerate(rows[:30])] + [(k + 300, t.lower()) for k, t in rows[:30]]
    got = {r.doc_id: r.restored for r in garble.restored_documents(spark.createDataFrame(taught, "doc_id bigint, text string")).collect()}
    assert all(got[100 + k] == rows[k][1].lower() for k in range(30)) and set(got) == set(range(100, 130))


def test_clean_texts_are_not_found(spark):
    clean = [RU, "СРОЧНО: РСО и СРО не отвечают, ГКУ и РЭС молчат.", "Кафе «Crème brûlée» закрыто.", "Цена — 15 €, т. е. ≈ 1 500 ₽.", "The café costs €5. It doesn’t help. “Soon” — they said.", "УПРАВА ЗАКРЫЛА записку № 7319 ПРО каменный домофон, ХОТЯ шаткая РОЗЕТКА потрескалась.", "+5 °C, ±2", "", None, "Почему??? Кто ответит???", "Что ?"]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100, RU.encode().decode("latin-1")), (101, "забо� у дома"), (100, RU.encode().decode("latin-1")), (103, "???????? ?????? № 4034 ??? ????, ???"), (104, "x" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kinds", F.lit("clash"))
    got = {r.doc_id: (r.restored, r.lost > 0) for r in garble.restored_documents(frame).collect()}
    assert got == {100: (RU, False), 101: ("забо� у дома", True), 103: (rows[-2][1], True)}
    assert garble.restored_documents(frame.limit(0)).count() == 0


def test_the_pattern_of_repeats_survives_a_mapping():
    assert garble.repeats("тоток") == garble.repeats("xyxyz") != garble.repeats("тотко") and garble.units_of("ab Ð¸Ð·", 2) == ["Ð¸", "Ð·"] and garble.units_of("№—»", 2) is None


def test_passages_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 2.5]) for _ in range(14)]
        found = toxicity.passages(scores)
        best = max((sum(scores[i:j]) for i in range(14) for j in range(i + 1, 15)), default=0.0)
        if best > 0:
            assert abs(max(s for _, _, s in found) - best) < 1e-9
        assert all(abs(sum(scores[a:b]) - s) < 1e-9 and s > 0 for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_disguised_words_read_alike():
    read = toxicity.Reader()
    for seen in ("ТВАРЬ", "тв4рь", "т в а р ь", "т.в.а.р.ь", "твaрь", "тваааарь", "тв­арь"):
        assert read(seen) == read("тварь"), seen
    assert read("") == [] and read("12 34") == ["#", "#"]


def test_toxic_model_on_held_out_rows(spark):
    rng = random.Random(5)
    filler = ["двор", "лавочка", "фонарь", "забор", "маршрут", "опаздывает", "утром", "жители", "просят", "починить", "крыса", "грызёт", "кабель"]
    bad = ["ты просто сволочь", "таких надо вешать", "ищу пару для секса", "встречу и убью"]
    make = lambda y: " ".join([*rng.choices(filler, k=12), *(rng.choice(bad).split() if y else []), *rng.choices(filler, k=8)])
    labelled = [(make(y), y) for y in [0, 1] * 200]
    model = toxicity.fit(labelled)
    read = toxicity.Reader()
    held = [(make(y), y) for y in [0, 1] * 100]
    assert sum(model.found(model.best(read(t)), len(read(t))) == bool(y) for t, y in held) >= 198
    frame = spark.createDataFrame([(1, make(1)), (2, make(0)), (3, None), (4, ""), (5, "сволочь " * 4000)], "message_id bigint, text string").withColumn("score", F.lit("clash"))
    got = {r.message_id: r.found for r in toxicity.score_messages(frame, model).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert toxicity.fit([]).best(read("сволочь")) > 0 and toxicity.score_messages(frame.limit(0), model).count() == 0
    assert 0 < model.level < 0.2 and model.chance(50.0, 30) < 1e-6 and model.chance(3.0, 30) < model.chance(3.0, 300)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Пишите на ivan-5 (собака) post.test.", {"email"}), ("почта: a_b[at]mail[dot]x[dot]test", {"email"}), ("т. 8(978)453-73-06", {"phone"}), ("+7.970.485.73.14!", {"phone"}),
        ("СНИЛС 131-078-715 50", {"id_number"}), ("инн физлица: 006595651367", {"id_number"}), ("паспорт 00 56 730659", {"id_number"}), ("Живу ул нижнеовражная д 148 кв 77", {"address"}),
        ("в доме 99 по Верхнешорной", {"address"}), ("I live at 12 Nizhneambarnaya street, flat 5", {"address"}), ("К. К. Колтупин", {"name"}), ("ДУНДУКОВ ПРОХОР КЛИМОВИЧ", {"name"}),
        ("Подписывайтесь на @dvor_9_live.", set()), ("Кадастровый участок 18:26:50123.", set()), ("Обращение № 1234-55 от 01.02.2024.", set()), ("Маршрут № 5 у дома на Сосновой", set()),
        ("Сайт dvor-otvet.example/news/4825", set()), ("Версия 1.2.3.4 падает", set()), ("", set()),
    ],
)
def test_certain_spans(text, kinds):
    assert {s[2] for s in pii.spans_of(Lookalikes().text(text)) if s[3]} == kinds


def test_bootstrapping_finds_unseen_names_and_masks_the_rest_alone(spark):
    seeds = [(k, f"Заявитель {s} {g} Петрович. Фонарь не горит.") for k, (s, g) in enumerate([("Колтупин", "Клим"), ("Ежкунов", "Назар"), ("Колтупин", "Назар"), ("Ежкунов", "Клим")])]
    rows = [*seeds, (10, "Заявитель Колтупин Назар. Всё."), (11, "Заявитель Зыряхан Клим. Всё."), (12, "Видел Большой Театр вчера"), (13, None), (14, ""), (15, "Тел. 8(978)4537306, двор"), (15, "Тел. 8(978)4537306, двор")]
    frame = spark.createDataFrame(rows, "message_id bigint, text string").withColumn("kind", F.lit("clash"))
    spans = pii.personal_spans(frame)
    assert {r.message_id for r in spans.where("kind = 'name'").collect()} == {0, 1, 2, 3, 10, 11}
    masked = {r.message_id: r.masked for r in pii.masked_texts(frame, spans).collect()}
    assert masked[10] == "Заявитель <NAME>. Всё." and masked[15] == "Тел. <PHONE>, двор" and masked[12] == "Видел Большой Театр вчера" and masked[13] is None
    assert pii.personal_spans(frame.limit(0)).count() == 0
