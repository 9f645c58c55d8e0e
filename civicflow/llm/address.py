"""Problem 3: records of one postal address written differently, by probabilistic linkage.

Each input is cut into components: postcode, house number, letter and building number, and words. The
words are repaired against the streets and towns that occur in the data itself (labels of selected
candidates, cities) with the token repair of problem 2. Records with the same components form a class.
Classes meet in blocks of one street sound and house number, or of one of their postcodes and the house
number; each pair is compared by component with a level for missing values, and expectation-maximization
over the counts of comparison patterns, those inside classes among them, estimates the linkage weights.
Pairs of classes with a high posterior that pass the exact check (no component of the building differs; a
street that could not be repaired may sound different only where postcode and label agree) are linked;
class members are paired last.

Defined results: null, empty and houseless inputs pair with nothing; a town missing in the input is taken
from the city, then from the label; classes are told apart by all their components, so ties link alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.llm.canonical import _ADJECTIVE, edits, latin, neighbours, readings, stem
from civicflow.llm.lookalike import Lookalikes
from civicflow.session import materialize

_FLAT = re.compile(r"(?:^|[\s,.])(?:кв|квартира|подъезд|под|п-д|офис|оф|этаж|эт|помещение|пом|комната|ком|kv|kvartira|podezd|of)\b\.?\s*№?\s*\d+\w?")
_POSTCODE = re.compile(r"(?<!\d)\d{6}(?!\d)")
_REGION = re.compile(r"[^\s,]+\s+(?:область|обл\b\.?|край|oblast|kray)|(?:область|край)\s+[^\s,]+|городской округ|gorodskoy okrug|россия\b|рф\b")
_HOUSE = re.compile(
    r"(?:(?<![^\W\d_])(?:дом[уе]?|д|dom|d)\.?\s*)?№?\s*(?<!\d)(?P<n>\d{1,4})(?!\d)"
    r"(?:\s*[-/ ]?\s*(?P<l>[абвгдabvgd])(?![^\W\d_])(?!\.?\s*\d)(?!\s?[.-]\s?[^\W\d_]{4}))?"
    r"(?:\s*,?\s*(?:корпус|корп|кор|к|стр|korpus|korp|k)\.?\s*(?P<k>\d{1,2})(?!\d)|/(?P<k2>\d{1,2})(?!\d))?"
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: Words that mark a kind of component and name none.
MARKERS = frozenset(
    "г город гор г-д ул улица улице наб набережная набережной ал аллея аллее пер переулок пр проспект пл площадь д дом корп корпус к "
    "g gorod ul ulitsa nab naberezhnaya al alleya d dom k korp korpus п пос поселок с село".split()
)
_STREET_MARK = re.compile(r"(?:^|\s)(?:улица|ул\.|набережная|наб\.|аллея|ал\.|переулок|пер\.|проспект|пр\.)(?:\s|$)")
_LETTERS = {"a": "а", "b": "б", "v": "в", "g": "г", "d": "д"}
_SOUNDS = ("бвгдзжэыёщтйо", "пфктсшеиешдиа")


def sound(word: Column) -> Column:
    """A sound key: stem, paired consonants and unstressed vowels merged, repeats and signs dropped."""
    s = F.regexp_replace(F.regexp_replace(word, _ADJECTIVE.pattern, ""), "[ьъ]", "")
    return F.regexp_replace(F.translate(s, *_SOUNDS), r"(.)\1+", "$1")


def parse(text: str, forms: Lookalikes, city: str = "") -> tuple[str | None, str | None, str, str, list[str]]:
    """(postcode, house number, letter, building, words) of one input; all readings give words."""
    ways = readings(text, forms)
    first = _FLAT.sub(" ", _REGION.sub(" ", ways[0]))
    code = _POSTCODE.search(first)
    first = _POSTCODE.sub(" ", first)
    house = None
    for m in _HOUSE.finditer(first):
        house = m
        if re.match(r"\s*(?:дом|д|dom|d)", m[0]):
            break
    words: list[str] = []
    for way in ways:
        rest = _POSTCODE.sub(" ", _FLAT.sub(" ", _REGION.sub(" ", way)))
        if house:
            rest = rest.replace(house[0], " , ", 1)
        found = [w for w in _WORD.findall(rest)]
        words += [w for w in found if w not in MARKERS]
        words += [w.replace("-", "") for w in found if "-" in w]
        for part in re.split(r"[,.]", rest):
            parts = [w for w in _WORD.findall(part) if w not in MARKERS]
            words += [u + w for u, w in zip(parts, parts[1:], strict=False) if len(u) <= 8]
        words += [f"{m[1]}~{m[2]}" for m in re.finditer(r"(?:^|[\s,.])([а-яё]{1,5})(?:\.\s?|-\s?)([а-яё]{4,})", rest) if len(m[1]) == 1 or m[1] not in MARKERS]
        words += [w[len(city) :] for w in found if city and len(w) > len(city) + 3 and w.startswith(city)]
    if house is None:
        return (code[0] if code else None), None, "", "", list(dict.fromkeys(words))
    letter = _LETTERS.get(house["l"] or "", house["l"] or "")
    return (code[0] if code else None), house["n"], letter, house["k"] or house["k2"] or "", list(dict.fromkeys(words))


def parse_label(label: str) -> tuple[str | None, str | None, list[str]]:
    """(street, house, other parts) of a geocoder's label."""
    street = house = None
    rest = []
    for part in label.lower().replace("ё", "е").split(","):
        part = part.strip()
        if street is None and _STREET_MARK.search(part):
            street = _STREET_MARK.sub(" ", f" {part} ").strip()
        elif house is None and re.fullmatch(r"\d{1,4}[а-д]?(?:к\d+)?", part):
            house = part
        else:
            rest.append(re.sub(r"^городской округ ", "", part))
    return street, house, rest


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms = Lookalikes()
    for batch in batches:
        rows = []
        for case_id, city, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            code, number, letter, building, words = parse(text, forms, (city or "").lower().replace("ё", "е")) if text else (None, None, "", "", [])
            street, house, parts = parse_label(label) if label else (None, None, [])
            rows.append((case_id, city.lower().replace("ё", "е").strip() if city else None, code, number, letter, building, words, street, house, parts))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()))
        columns = list(zip(*rows, strict=True)) or [()] * 10
        names = ["case_id", "city", "postcode", "number", "letter", "building", "words", "label_street", "label_house", "label_parts"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _vocabulary_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            whole = word.replace("-", "").replace(" ", "")
            full = {whole, stem(whole)} if kind == "street" else {whole}
            for form in full | {latin(f) for f in full}:
                rows += [(kind, word, form, k, "") for k in neighbours(form)]
            if kind == "street":
                s = stem(whole)
                for at in range(2, len(s) - 3):
                    rows += [(kind, word, s[at:], k, s[:at]) for k in neighbours(s[at:])]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "word", "form", "key", "begin"])


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for token in batch.column(0).to_pylist():
            begin, _, rest = token.rpartition("~")
            rest = rest.replace("-", "")
            for form in {rest, stem(rest)}:
                rows += [(token, form, k, begin) for k in neighbours(form)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["token", "typed", "key", "abbreviation"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for token, typed, kind, word, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d = edits(typed, form, 1)
            if d <= (0 if len(form) < 5 else 1):
                rows.append((token, kind, word, d, len(token)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["token", "kind", "word", "d", "n"])


def address_components(cases: DataFrame) -> DataFrame:
    """(case_id, town, street, sound, number, letter, building, postcode, label_house): one row a case with an input."""
    rows = cases.select("case_id", "city", F.col("input").alias("text"), F.col("selected.label").alias("label")).where(F.length(F.trim("text")) > 0)
    parsed = materialize(
        rows.mapInArrow(
            _components,
            "case_id bigint, city string, postcode string, number string, letter string, building string, words array<string>, label_street string, label_house string, label_parts array<string>",
        ),
        "addresses",
    )
    cities = parsed.where(F.length("city") > 2).select(F.lit("town").alias("kind"), F.col("city").alias("word"))
    streets = parsed.where(F.length("label_street") > 3).groupBy("label_street").count().select(F.lit("street").alias("kind"), F.col("label_street").alias("word"))
    vocabulary = materialize(cities.distinct().unionByName(streets), "address-words")
    left = parsed.select(F.explode("words").alias("token")).distinct().mapInArrow(_word_keys, "token string, typed string, key string, abbreviation string")
    right = vocabulary.mapInArrow(_vocabulary_keys, "kind string, word string, form string, key string, begin string")
    meets = (F.col("abbreviation") == "") & (F.col("begin") == "") | (F.col("abbreviation") != "") & (F.col("begin") != "") & F.expr("startswith(begin, abbreviation)")
    met = left.join(right, "key").where(meets).select("token", "typed", "kind", "word", "form").distinct()
    repaired = met.mapInArrow(_measure, "token string, kind string, word string, d int, n int").groupBy("token", "kind", "word").agg(F.min("d").alias("d"), F.max("n").alias("n"))
    placed = parsed.select("case_id", "label_street", F.explode("words").alias("token")).join(repaired, "token")
    # The longest token explains a street best ("north lake" before "lake"), then the fewest edits, then the label.
    rank: Column = F.struct(-F.col("n"), F.col("d"), F.when(F.col("word") == F.col("label_street"), 0).otherwise(1), F.col("word"))
    best = placed.groupBy("case_id").agg(
        F.min_by("word", F.when(F.col("kind") == "street", rank)).alias("street"), F.min_by("word", F.when(F.col("kind") == "town", F.struct("d", -F.col("n"), "word"))).alias("town")
    )
    label_towns = (
        parsed.select("case_id", F.explode("label_parts").alias("word")).join(vocabulary.where("kind = 'town'"), "word").groupBy("case_id").agg(F.min("word").alias("label_town"))
    )
    merged = parsed.join(best, "case_id", "left").join(label_towns, "case_id", "left")
    longest = F.expr("array_max(transform(filter(words, w -> NOT contains(w, '~')), w -> struct(length(w) as n, w)))")
    spoken = F.coalesce(sound(longest["w"]), F.lit(""))
    return merged.select(
        "case_id", F.coalesce("town", "city", "label_town").alias("town"), F.coalesce("street", F.concat(F.lit("~"), spoken)).alias("street"),
        "number", "letter", "building", "postcode", "label_street", "label_house",
    )


LEVELS = ("town", "street", "letter", "building", "postcode", "label")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[int, ...], float]:
    """Posterior of a match for each comparison pattern (2 agrees, 1 missing, 0 differs) by expectation-maximization."""
    if not patterns:
        return {}
    width = len(patterns[0][0])
    m = [[0.05, 0.15, 0.8] for _ in range(width)]
    u = [[0.6, 0.2, 0.2] for _ in range(width)]
    p = 0.3
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        for pattern, _ in patterns:
            a = math.log(p) + sum(math.log(m[k][v]) for k, v in enumerate(pattern))
            b = math.log(1 - p) + sum(math.log(u[k][v]) for k, v in enumerate(pattern))
            post[pattern] = 1 / (1 + math.exp(min(700, b - a)))
        matched = sum(post[x] * n for x, n in patterns)
        p = min(max(matched / total, 1e-4), 1 - 1e-4)
        for k in range(width):
            for v in range(3):
                hit = [(post[x], n) for x, n in patterns if x[k] == v]
                m[k][v] = (sum(q * n for q, n in hit) + 0.5) / (matched + 1.5)
                u[k][v] = (sum((1 - q) * n for q, n in hit) + 0.5) / (total - matched + 1.5)
    return post


def _inside(records: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The comparison patterns of all pairs inside classes, counted from the sizes of groups of records."""
    both = F.col("postcode").isNotNull() & F.col("label").isNotNull()
    two = lambda n: F.coalesce(F.sum(F.expr(f"{n} * ({n} - 1) / 2")), F.lit(0.0)).cast("bigint")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    groups = materialize(records.groupBy("code", "postcode", "label").agg(F.count(F.lit(1)).alias("c")), "address-groups")
    sizes = [F.sum("c").alias("n"), some(F.col("postcode").isNotNull()).alias("p"), some(F.col("label").isNotNull()).alias("l"), some(both).alias("pl")]
    n, p, lab, pl = groups.groupBy("code").agg(*sizes).agg(two("n"), two("p"), two("l"), two("pl")).first()
    p2, p2l = groups.where("postcode IS NOT NULL").groupBy("code", "postcode").agg(*sizes).agg(two("n"), two("l")).first()
    l2, l2p = groups.where("label IS NOT NULL").groupBy("code", "label").agg(*sizes).agg(two("n"), two("p")).first()
    a = groups.where(both).agg(two("c")).first()[0]
    table = {(2, 2): a, (2, 1): p2 - p2l, (2, 0): p2l - a, (1, 2): l2 - l2p, (1, 1): n - p - lab + pl, (1, 0): lab - pl - (l2 - l2p), (0, 2): l2p - a, (0, 1): p - pl - (p2 - p2l), (0, 0): pl - p2l - l2p + a}
    return [((2, 2, 2, 2, *k), c) for k, c in sorted(table.items()) if c > 0]


def linked_addresses(cases: DataFrame, posterior: float = 0.5) -> DataFrame:
    """(case_id_a, case_id_b): pairs of cases of one building."""
    parts = ["town", "street", "number", "letter", "building"]
    records = address_components(cases).where(F.col("number").isNotNull() & (F.length("street") > 1))
    label = F.when(F.col("label_street").isNotNull() & F.col("label_house").isNotNull(), F.concat_ws(" ", "label_street", "label_house"))
    code = F.xxhash64(*[F.coalesce(c, F.lit("\x00")) for c in parts])
    records = materialize(records.select("case_id", *parts, "postcode", label.alias("label"), code.alias("code")), "address-records")
    classes = records.groupBy("code", *parts).agg(F.max("postcode").alias("postcode"), F.max("label").alias("label"))
    said = F.when(F.col("street").startswith("~"), F.expr("substring(street, 2)")).otherwise(sound(F.col("street")))
    classes = materialize(classes.withColumn("sound", said), "address-classes")
    by_sound = classes.select("*", F.xxhash64(F.lit("s"), "sound", "number").alias("block"))
    codes = records.where(F.col("postcode").isNotNull()).select("code", "postcode").distinct()
    by_code = classes.drop("postcode").join(codes, "code").select(*classes.columns, F.xxhash64(F.lit("p"), "postcode", "number").alias("block"))
    blocks = by_sound.unionByName(by_code)
    a, b = blocks.alias("a"), blocks.alias("b")
    compare = lambda c: F.when((F.coalesce(f"a.{c}", F.lit("")) == "") | (F.coalesce(f"b.{c}", F.lit("")) == ""), 1).when(F.col(f"a.{c}") == F.col(f"b.{c}"), 2).otherwise(0).alias(f"v_{c}")
    # Two numbers without a letter agree; a letter on one side only is missing on the other.
    part = lambda c: F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), 2).when((F.col(f"a.{c}") == "") | (F.col(f"b.{c}") == ""), 1).otherwise(0).alias(f"v_{c}")
    # An unrepaired street ("~") is known by its sound only; two repaired ones are one only if they are equal.
    loose = F.col("a.street").startswith("~") | F.col("b.street").startswith("~")
    alike = F.when(F.col("a.street") == F.col("b.street"), 2).when(loose & (F.col("a.sound") == F.col("b.sound")), 1).otherwise(0).alias("v_street")
    pairs = a.join(b, F.expr("a.block = b.block AND a.code < b.code")).select(
        F.col("a.code").alias("x"), F.col("b.code").alias("y"), compare("town"), alike, part("letter"), part("building"), compare("postcode"), compare("label"), loose.alias("loose")
    )
    columns = [f"v_{c}" for c in LEVELS]
    # A pair may meet in several blocks, by the sound and by postcodes: it counts once, with what agrees in any.
    pairs = materialize(pairs.groupBy("x", "y").agg(*(F.max(c).alias(c) for c in [*columns, "loose"])), "address-pairs")
    # At most 3^6 patterns.
    counts = [(tuple(r[c] for c in columns), r.n) for r in pairs.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()] + _inside(records)
    weights = estimate(sorted(counts))
    spark = cases.sparkSession
    good = [(*k, w) for k, w in weights.items() if w >= posterior]
    table = spark.createDataFrame(good or [(9,) * len(columns) + (0.0,)], ", ".join(f"{c} int" for c in columns) + ", weight double")
    # The exact check: no component of the building differs.
    same_street = "(v_street > 0 OR loose AND v_postcode = 2 AND v_label = 2)"
    exact = f"(v_town = 2 OR v_town = 1 AND v_label = 2) AND {same_street} AND v_letter = 2 AND v_building = 2"
    links = pairs.join(F.broadcast(table), columns, "left_semi").where(exact).select("x", "y")
    members = records.select("code", "case_id")
    u, v = members.alias("u"), members.alias("v")
    same = u.join(v, F.expr("u.code = v.code AND u.case_id < v.case_id")).select(F.col("u.case_id").alias("i"), F.col("v.case_id").alias("j"))
    other = links.join(members.select(F.col("code").alias("x"), F.col("case_id").alias("i")), "x").join(members.select(F.col("code").alias("y"), F.col("case_id").alias("j")), "y")
    out = same.unionByName(other.select("i", "j"))
    return out.select(F.least("i", "j").alias("case_id_a"), F.greatest("i", "j").alias("case_id_b")).distinct()
