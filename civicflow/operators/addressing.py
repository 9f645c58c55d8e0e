"""Address mentions: extraction, typing, queries to a gazetteer, ranking of its candidates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from civicflow.operators.normalize import sequence_ratio
from civicflow.operators.spatial import haversine_m

# Words that mark kinds of places, and the confidences of the rules.
STREET_WORDS = "ул|улица|пр|проспект|пер|переулок|наб|набережная|бул|бульвар|ш|шоссе|проезд|пл|площадь|аллея|дорога"
RULE_CONFIDENCE, SHORT_CONFIDENCE = 0.58, 0.56
_NAME = r"[А-ЯЁA-Z][А-Яа-яЁёA-Za-z0-9.\-]*"
_STREET = rf"(?<!\w)(?i:{STREET_WORDS})\.?\s+{_NAME}(?:\s+{_NAME}){{0,4}}"
_NUMBER = r"\d+(?:[А-Яа-яA-Za-z](?![А-Яа-яA-Za-z]|\s*\d))?(?:\s*(?i:к|корп\.?|корпус)\s*\d+)?"
_RULES = [
    ("intersection", re.compile(rf"{_STREET}\s+(?i:и|/|угол)\s+{_STREET}")),
    ("street", re.compile(rf"{_STREET}(?:\s*,?\s*(?:(?i:дом|д\.?)\s*)?{_NUMBER})?")),
    ("district", re.compile(rf"(?<!\w)(?i:район|микрорайон|округ|квартал)\s+(?:{_NAME}|\d+)")),
    ("poi", re.compile(rf"(?<!\w)(?i:школа|поликлиника|больница|парк|сквер|мост|вокзал|детский сад)\s+(?:№\s*)?(?:{_NAME}|\d+)")),
]
_TAIL = re.compile(rf"(?:(?i:дом|д)\.?\s*)?(?P<n>{_NUMBER})\s*$")
_MENTION = StructType([*(StructField(n, StringType()) for n in ("text", "kind", "street", "house_number")), StructField("confidence", DoubleType())])


def mention_of(text: str) -> tuple | None:
    """(text, kind, street, house number, confidence): the earliest, longest rule match, else a short address."""
    found = [(m.start(), -len(m[0]), kind, m[0]) for kind, rule in _RULES for m in [rule.search(text)] if m]
    if found:
        _, _, kind, span = min(found)
        number = _TAIL.search(span)
        if kind == "street" and number:
            street = span[: number.start()].rstrip(" ,")
            return span, "house", street, house_number(number["n"]), RULE_CONFIDENCE
        return span, kind, span if kind == "street" else None, None, RULE_CONFIDENCE
    flat = text.strip()
    tail = _TAIL.search(flat)
    words = re.findall(r"[^\W\d_]+", flat)
    if len(flat) <= 96 and tail and tail.start() and 1 <= len(words) <= 6 and re.search(r"(?:ая|ий|ый|ой|ова|ева|ина|улица)\b", flat[: tail.start()].lower()):
        return flat, "house", flat[: tail.start()].rstrip(" ,"), house_number(tail["n"]), SHORT_CONFIDENCE
    return None


def house_number(value: str) -> str:
    return re.sub(r"корпус|корп\.?", "к", re.sub(r"\s+", "", value.lower()).replace("ё", "е"))


@pandas_udf(_MENTION)
def extract_mention(texts: pd.Series) -> pd.DataFrame:
    rows = [(None if t is None else mention_of(t)) or (None,) * 5 for t in texts]
    return pd.DataFrame(rows, columns=["text", "kind", "street", "house_number", "confidence"])


def first_precise(mentions: Column) -> Column:
    """The first house with a number of an array of mentions, else the first mention."""
    houses = F.filter(mentions, lambda m: (m["kind"] == "house") & m["house_number"].isNotNull())
    return F.coalesce(F.get(houses, 0), F.get(mentions, 0))


def clean_street(street: Column) -> Column:
    """Lower case, е for ё, no street words, single blanks."""
    low = F.translate(F.lower(street), "ё", "е")
    bare = F.regexp_replace(low, rf"(^|[\s.,])({STREET_WORDS}|ал)\.?(?=[\s.,]|$)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[.,]", " "), r"\s+", " "))


def strip_city(street: Column, city: Column) -> Column:
    """A street without the city's name in front of it or behind it."""
    low, name = F.lower(F.trim(street)), F.lower(city)
    front = F.when(F.startswith(low, F.concat(name, F.lit(","))), F.substring(street, F.length(city) + 2, F.length(street)))
    back = F.when(F.endswith(low, F.concat(F.lit(", "), name)), F.left(street, F.length(street) - F.length(city) - 2))
    return F.trim(F.coalesce(front, back, street))


def geocode_query(street: Column, number: Column, city: Column) -> Column:
    """Street, number and, if the street does not name it, the city."""
    named = F.contains(F.lower(street), F.lower(city))
    return F.concat_ws(", ", street, number, F.when(~F.coalesce(named, F.lit(False)), city))


def rank_confidence(importance: Column, rank: Column, limit: int) -> Column:
    """Confidence from a service's importance and order, within [0.05, 0.99]."""
    value = 0.55 * importance + 0.45 * (1 - rank / limit)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(0.99), value)))


def token_f1(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of token F1 and the ratio of matching blocks; 0 if a side is missing."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != "") & (b != ""), F.greatest(token_f1(a, b), sequence_ratio(a, b))).otherwise(0.0)


def house_matches(expected: Column, actual: Column, label: Column) -> Column:
    want, have = F.regexp_replace(F.lower(expected), " ", ""), F.regexp_replace(F.lower(actual), " ", "")
    direct = (have != "") & F.startswith(have, want)
    return F.coalesce(direct | F.array_contains(F.regexp_extract_all(F.lower(label), F.lit(r"\d+[а-яa-z]*(?:к\d+)?"), F.lit(0)), want), F.lit(False))


def semantic_confidence(importance: Column, order: Column, name: Column, house: Column, number_match: Column) -> Column:
    """House mentions need their number (else at most 0.44); other mentions lean on the name."""
    base = 0.15 * importance + 0.10 * order
    exact = base + 0.35 * name
    return F.round(F.when(house & number_match, exact + 0.40).when(house, F.least(exact, F.lit(0.44))).otherwise(base + 0.60 * name), 6)


def select_candidate(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Best candidate per mention: an exact house first where a house was meant, then confidence, then id."""
    order = Window.partitionBy(*by).orderBy(F.when((F.col("mention_kind") == "house") & (F.col("kind") == "house"), 0).otherwise(1), F.desc("confidence"), "candidate_id")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def top_candidates(candidates: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("confidence"), "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearby_candidates(mentions: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """Places of the mention's name within a radius, with a confidence that falls with the distance.

    mentions: (id, name, lon, lat); places: (place_id, name, plon, plat)."""
    pairs = mentions.withColumn("key", F.lower("name")).join(places.select("place_id", F.lower("name").alias("key"), "plon", "plat"), "key")
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    near = pairs.withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    confidence = F.greatest(F.lit(0.2), F.least(F.lit(0.62), 0.27 + 0.35 * (1 - F.col("distance_m") / radius_m)))
    return near.select("id", "place_id", "distance_m", F.round(confidence, 6).alias("confidence"))
