"""Problem 2: free-entered names mapped to a reference list by token-level repair and soft TF-IDF.

Every distinct typed value is read in its visible form and, where it is Latin, also as typed on the
wrong keyboard layout. Its tokens are its words, its neighbouring words as one, and an abbreviated first
part with the word after it ("Z-", "Zap."). Each distinct token meets the words of the reference list,
and its neighbouring words as one, in a join on deletion neighbourhoods, which is complete for one edit
(insertion, deletion, substitution or swap), and for two where a token of ``TWO_EDITS`` letters has no word
within one, on the word's stem, so inflected forms meet too; transliterated tokens meet transliterated ones.

An entry is a candidate if one of its telling words is met: the weightiest ones, without which the others
cannot reach the threshold, so no entry above it is missed and common words bring none. Candidates are
ranked by soft TF-IDF, the cosine of both sides: words of the entry that were not typed and typed words
that the entry lacks both lower it. Typed words that no entry knows weigh as the rarest words do, numbers
no entry knows (houses) nothing. A value without an entry above the threshold is reported with -1.

Defined results: null values have no row, empty ones get -1; equal values get equal results; of entries
with the same score the one with the least edits, then the lowest id, is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.lookalike import Lookalikes
from civicflow.session import materialize

#: Keys of the Latin and the Russian keyboard layout, and letters in transliteration.
KEYS_LATIN = "qwertyuiop[]asdfghjkl;'zxcvbnm,.`"
KEYS_RUSSIAN = "йцукенгшщзхъфывапролджэячсмитьбюё"
TRANSLITERATION = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "),
        strict=True,
    )
)
#: Short forms of the words for kinds of streets and states; "" for words that tell nothing.
SHORT_FORMS = {
    "ул": "улица", "наб": "набережная", "ал": "аллея", "пер": "переулок", "пр-т": "проспект", "пл": "площадь", "ш": "шоссе",
    "респ": "республика", "кор-во": "королевство", "острова": "о-ва", "г-во": "", "государство": "",
}
KINDS = frozenset(w for w in SHORT_FORMS.values() if w)
KIND_WEIGHT = 0.2  # of the words for kinds, which tell little even where a short list makes them rare
TWO_EDITS = 16  # letters of a word that may have two edits; one of five letters may have one
THRESHOLD = 0.75
_LAYOUT = str.maketrans(KEYS_LATIN, KEYS_RUSSIAN)
_NOTE = re.compile(r"[(/\[][^)/\]]*[а-яё][^)/\]]*[)/\]]")
_GLUED = re.compile(r"(?<=[а-яё])(?=[А-ЯЁ][А-ЯЁа-яё]{3})")
_CHANGED = re.compile(r"(?<=[а-яё])([,.])(?=[a-z\[\];'`])")
_KEYED = re.compile(r"[a-z\[\];',.`]*[a-z][a-z\[\];',.`]*$")
_WORD = re.compile(r"[^\W\d_]+(?:-(?:во|ва|т|vo|va)\b)?|\d+")
_ADJECTIVE = re.compile(r"(?<=....)(?:ая|яя|ья|ой|ей|ую|aya|ya|oy|ey)$")
_KINDS = frozenset(SHORT_FORMS.values())
_CUT = re.compile(r"(?:\.\s?|-\s?)")  # between an abbreviated first part and its word


def latin(word: str) -> str:
    return "".join(TRANSLITERATION.get(ch, ch) for ch in word)


def stem(word: str) -> str:
    return _ADJECTIVE.sub("", word)


def readings(value: str, forms: Lookalikes) -> list[str]:
    """The ways to read a value: as it is, and as typed on the other layout."""
    # Words run together are cut where the case or the keyboard changes.
    text = _GLUED.sub(" ", forms.text(value)).lower()
    text = " ".join(_CHANGED.sub(r"\1 ", text).split())
    out = [_NOTE.sub(" ", text).replace("ё", "е")]
    parts = text.split(" ")
    keyed = []
    for p in parts:
        core = p.rstrip(",.")
        keyed.append(core.translate(_LAYOUT) + p[len(core) :] if _KEYED.match(core) and len(core) >= 4 else p)
    if keyed != parts:
        out.append(" ".join(keyed).replace("ё", "е"))
    return out


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in its full form, start, end) of a lower-case text; words that tell nothing are left out."""
    found = [(SHORT_FORMS.get(m[0], m[0]), m.start(), m.end()) for m in _WORD.finditer(text)]
    # "д" before a number is a house; before a word it is a first part.
    house = lambda k: found[k][0] in ("д", "дом") and k + 1 < len(found) and found[k + 1][0][0:1].isdigit()
    return [f for k, f in enumerate(found) if f[0] and not house(k)]


def tokens(reading: str) -> list[tuple[int, int, str]]:
    """(place, words, token): each different word, each two neighbours as one, and "z~rest" for a short
    first part that stands apart from its word."""
    out: dict[str, tuple[int, int, str]] = {}
    found = words_of(reading)
    for k, (w, _, _) in enumerate(found):
        out.setdefault(w, (k, 1, w))
    for k, ((u, a, b), (w, c, d)) in enumerate(zip(found, found[1:], strict=False)):
        if u[0].isdigit() or w[0].isdigit() or u in KINDS or w in KINDS:
            continue
        out.setdefault(u + w, (k, 2, u + w))
        if b - a <= 5 and len(w) >= 4 and u == reading[a:b] and _CUT.fullmatch(reading[b:c]):
            out.setdefault(f"{u}~{w}", (k, 2, f"{u}~{w}"))
    return list(out.values())


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with swaps of neighbours, ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def neighbours(word: str, depth: int = 1) -> set[str]:
    """The word and all it becomes without one letter, or without up to ``depth``."""
    out = last = {word}
    for _ in range(depth):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out = out | last
    return out


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_TEXT, _INT, _REAL = pa.string(), pa.int32(), pa.float64()


def _entry_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref_id, kind, place, words, word): the different words of an entry and its neighbouring words as one."""
    for batch in batches:
        rows = []
        for ref_id, kind, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(ref_id, kind, *t) for t in tokens(name.lower().replace("ё", "е")) if "~" not in t[2]]
        yield _batch(rows, ref_id=pa.int64(), kind=_TEXT, at=_INT, width=_INT, word=_TEXT)


def _reference_keys(depth: int):
    """(kind, entry word, form, key, begin): deletion neighbours of stems, their Latin forms and their endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = stem(word)
                forms = {(f, "") for f in (s, word, latin(s), latin(word))} | {(s[at:], s[:at]) for at in range(2, len(s) - 3)}
                rows += [(kind, word, f, k, begin) for f, begin in forms if depth == 1 or len(f) >= TWO_EDITS for k in neighbours(f, depth)]
            yield _batch(rows, kind=_TEXT, word=_TEXT, form=_TEXT, key=_TEXT, begin=_TEXT)

    return run


def _typed_keys(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin, _, rest = token.rpartition("~")
                rows += [(kind, token, f, k, begin) for f in {rest, stem(rest)} if depth == 1 or len(f) >= TWO_EDITS - 2 for k in neighbours(f, depth)]
            yield _batch(rows, kind=_TEXT, token=_TEXT, typed=_TEXT, key=_TEXT, abbreviation=_TEXT)

    return run


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, token, typed, word, form in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                allowed = 0 if len(form) < 5 or form.isdigit() else most
                d = edits(typed, form, allowed)
                if d <= allowed:
                    rows.append((kind, token, word, d, 1.0 - d / max(len(form), 1)))
            yield _batch(rows, kind=_TEXT, token=_TEXT, word=_TEXT, d=_INT, sim=_REAL)

    return run


def repair(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, token, word, d, sim): the (kind, word) rows within one edit of each (kind, token) row; for long
    tokens that have none, those within two."""

    def meet(left: DataFrame, depth: int) -> DataFrame:
        left = left.mapInArrow(_typed_keys(depth), "kind string, token string, typed string, key string, abbreviation string")
        right = words.mapInArrow(_reference_keys(depth), "kind string, word string, form string, key string, begin string")
        parts = (F.col("abbreviation") == "") & (F.col("begin") == "") | (F.col("abbreviation") != "") & (F.col("begin") != "") & F.expr("startswith(begin, abbreviation)")
        met = left.join(right, ["kind", "key"]).where(parts).select("kind", "token", "typed", "word", "form").distinct()
        found = met.mapInArrow(_compare(depth), "kind string, token string, word string, d int, sim double")
        return found.groupBy("kind", "token", "word").agg(F.min("d").alias("d"), F.max("sim").alias("sim"))

    near = materialize(meet(tokens, 1), "repaired")
    left_over = tokens.where(F.length("token") >= TWO_EDITS - 2).join(near, ["kind", "token"], "left_anti")
    return near.unionByName(meet(left_over, 2))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, ref_id, score, d) from the token matches of one reading with one entry: the weightiest
    match comes first, and no word of either side counts twice."""
    for batch in batches:
        rows = []
        for kind, value, ref_id, norm, total, matches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            typed, entry = set(), set()
            dot, d = 0.0, 0
            for m in sorted(matches, key=lambda m: (-m["sim"] * m["weight"], m["d"], m["width"], m["pos"], m["at"])):
                here, there = range(m["pos"], m["pos"] + m["width"]), range(m["at"], m["at"] + m["words"])
                if typed.isdisjoint(here) and entry.isdisjoint(there):
                    typed.update(here)
                    entry.update(there)
                    dot += m["weight"] * m["sim"]
                    total += m["weight"] - m["cover"]
                    d += m["d"]
            rows.append((kind, value, ref_id, dot / (norm * max(total, 1e-12)) ** 0.5, d))
        yield _batch(rows, kind=_TEXT, value=_TEXT, ref_id=pa.int64(), score=_REAL, d=_INT)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms = Lookalikes()
    for batch in batches:
        rows = []
        for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows += [(kind, value, n, *t) for n, reading in enumerate(readings(value, forms)) for t in tokens(reading)]
        yield _batch(rows, kind=_TEXT, value=_TEXT, reading=_INT, pos=_INT, width=_INT, token=_TEXT)


def map_to_reference(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, record_id, ref_id) for (kind, record_id, value) rows; reference has (ref_id, kind, name)."""
    values = values.where(F.col("value").isNotNull())
    typed = values.select("kind", "value").distinct().mapInArrow(_read, "kind string, value string, reading int, pos int, width int, token string")
    typed = materialize(typed, "typed-tokens")
    names = reference.where(F.col("name").isNotNull()).select(F.col("ref_id").cast("bigint"), "kind", "name")
    entries = names.mapInArrow(_entry_words, "ref_id bigint, kind string, at int, width int, word string")
    sizes = names.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))
    single = entries.where("width = 1")
    kinds = F.when(F.col("word").isin(sorted(KINDS)), KIND_WEIGHT).otherwise(1.0)
    known = single.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "kind")
    known = known.select("kind", "word", (kinds * F.log(1 + F.col("entries") / F.col("df"))).alias("idf"))
    weighed = single.join(known, ["kind", "word"]).select("ref_id", "kind", "at", "width", "word", (F.col("idf") * F.col("idf")).alias("weight"))
    ends = weighed.select("ref_id", "at", "weight")
    pairs = (
        entries.where("width = 2").join(ends.withColumnRenamed("weight", "w1"), ["ref_id", "at"])
        .join(ends.select("ref_id", (F.col("at") - 1).alias("at"), F.col("weight").alias("w2")), ["ref_id", "at"])
        .select("ref_id", "kind", "at", "width", "word", (F.col("w1") + F.col("w2")).alias("weight"))
    )
    # The words before which the lighter ones sum up to less than the threshold asks for.
    rest = Window.partitionBy("ref_id").orderBy("weight", "at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ref_id")
    marked = weighed.withColumn("norm", F.sum("weight").over(whole)).withColumn("telling", F.sum("weight").over(rest) >= threshold * threshold * F.col("norm") - 1e-9)
    norms = marked.select("ref_id", "norm").distinct()
    entry_words = materialize(
        marked.select("ref_id", "kind", "at", "width", "word", "weight", "telling").unionByName(pairs.withColumn("telling", F.lit(True))).join(norms, "ref_id"), "entry-words"
    )
    repaired = materialize(repair(typed.select("kind", "token").distinct(), entry_words.select("kind", "word").distinct()), "repaired-tokens")
    # The weight of a typed word: that of the word it most likely stands for, else that of the rarest words.
    meant = repaired.join(known, ["kind", "word"]).groupBy("kind", "token").agg(F.min_by("idf", F.struct("d", "idf")).alias("idf"))
    unknown = F.when(F.col("token").rlike("^[0-9]"), 0.0).otherwise(F.log(1.0 + F.coalesce("entries", F.lit(1))))
    weight = F.pow(F.coalesce("idf", unknown), 2)
    singles = typed.where("width = 1").join(meant, ["kind", "token"], "left").join(F.broadcast(sizes), "kind", "left").select("kind", "value", "reading", "pos", weight.alias("u"))
    reading = Window.partitionBy("kind", "value", "reading")
    singles = singles.withColumn("next", F.lead("u", 1, 0.0).over(reading.orderBy("pos"))).withColumn("total", F.sum("u").over(reading))
    met_tokens = typed.join(repaired, ["kind", "token"]).join(singles, ["kind", "value", "reading", "pos"], "left")
    cover = F.coalesce("u", F.lit(0.0)) + F.when(F.col("width") == 2, F.coalesce("next", F.lit(0.0))).otherwise(0.0)
    met_tokens = materialize(met_tokens.select("kind", "value", "reading", "pos", "width", "word", "d", "sim", cover.alias("cover"), "total"), "met-tokens")
    telling = entry_words.where("telling").select("kind", "word", "ref_id").distinct()
    candidates = met_tokens.join(telling, ["kind", "word"]).select("kind", "value", "ref_id").distinct()
    terms = entry_words.select("ref_id", "at", F.col("width").alias("words"), "word", "weight", "norm")
    matches = F.collect_list(F.struct("pos", "width", "at", "words", "d", "sim", "weight", "cover")).alias("matches")
    matched = candidates.join(terms, "ref_id").join(met_tokens, ["kind", "value", "word"])
    # A list holds the tokens of one value that are within two edits of the words of one entry.
    grouped = matched.groupBy("kind", "value", "reading", "ref_id").agg(F.first("norm").alias("norm"), F.max("total").alias("total"), matches)
    scored = grouped.select("kind", "value", "ref_id", "norm", F.coalesce("total", F.lit(0.0)).alias("total"), "matches").mapInArrow(_score, "kind string, value string, ref_id bigint, score double, d int")
    best = scored.where(F.col("score") >= threshold).groupBy("kind", "value").agg(F.min_by("ref_id", F.struct(-F.round("score", 6), "d", "ref_id")).alias("ref_id"))
    return values.join(best, ["kind", "value"], "left").select("kind", "record_id", F.coalesce("ref_id", F.lit(-1)).cast("bigint").alias("ref_id"))


def address_and_country_values(cases: DataFrame, countries: DataFrame) -> DataFrame:
    streets = cases.select(F.lit("street").alias("kind"), F.col("case_id").alias("record_id"), F.col("mention.street").alias("value"))
    return streets.unionByName(countries.select(F.lit("country").alias("kind"), F.col("entry_id").alias("record_id"), F.col("short_name").alias("value")))
