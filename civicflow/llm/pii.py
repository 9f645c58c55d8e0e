"""Problem 5: personal information in free text, by bootstrapped contextual extraction.

One pass over the messages that may hold any reads each in its visible form and marks spans. Spans whose
form is enough (mail addresses, phone numbers, numbers of passport, insurance or tax, names with
patronymic or initials, streets with a marker and a house) are certain and give the seeds: words of
names and stems of streets. Every span also gives the lexical patterns around it. Spark then scores the
graph of patterns and instances in rounds: a pattern is as good as the share of its uses with good
instances, an instance as good as the patterns it is used in. Uncertain spans (two capitalised words,
a street-like word with a number) are taken if their words and patterns score high, so names and streets
that no seed has are found, and capitalised words that are none are not.

Defined results: null and empty texts have no spans; overlapping spans keep the first, the longest;
repeated rows are treated each; the text with placeholders is in its visible form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.lookalike import Lookalikes, final_form
from civicflow.session import materialize

_AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:собака|at)\s?[)\]}]\s?|\s(?:собака|at)\s(?=[\w-]+(?:\.|\s?[(\[]?(?:dot|точка))))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|точка)\s?[)\]}]\s?|\s(?:точка|dot)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9_+-]|{_DOT}(?=[A-Za-z0-9]))*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)+", re.I)
ID_NUMBER = re.compile(
    r"(?:снилс|страховой номер|snils)\W{0,3}\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}(?!\d)"
    r"|(?<![\d-])\d{3}-\d{3}-\d{3}[ -]\d{2}(?![\d-])"
    r"|(?:инн|inn)(?:\s+физ\w*)?\W{0,3}\d{12}(?!\d)"
    r"|(?:паспорт\w*|passport)(?:\s+сери\w+)?\W{0,3}\d{2}\s?\d{2}(?:\s|,|\s?№\s?|\s?номер\s?)?\d{6}(?!\d)",
    re.I,
)
PHONE = re.compile(
    r"(?<![\d.:/№-])(?<!№ )(?:\+\s?7|8|7)[ .-]{0,2}\(?\d{3}\)?[ .-]{0,2}\d{3}[ .-]?\d{2}[ .-]?\d{2}(?![\d:/]|\.\d|-\d)"
    r"|(?<![\d№.])\(\d{3}\)\s?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?![\d:/])"
)
_NUM = r"(?P<h{0}>\d{{1,4}}(?:\s?[-/]?\s?[а-г](?![а-яё])|\s?к\.?\s?\d+|/\d+)?)"
_ADJ = r"(?P<s{0}>[а-яё]+(?:-[а-яё]+)?(?:ая|яя|ья|ой|ей|ую))"
_MARK = r"(?:ул\.?|улиц[аеуы]|наб\.?|набережн(?:ая|ой)|алл?\.|алле[яеи]|пер\.?|переул\w+|пр-т|проспект\w*|просп\.)"
_HOUSE = r"(?:д\.?|дом[уе]?|№)"
STREETS = [  # (pattern name, certain, expression)
    ("mark _ #", True, re.compile(rf"(?<!\w){_MARK}\s*{_ADJ.format(1)}\s*,?\s*{_HOUSE}?\s*{_NUM.format(1)}", re.I)),
    ("_ mark #", True, re.compile(rf"(?<!\w){_ADJ.format(2)}\s+{_MARK}\s*,?\s*{_HOUSE}?\s*{_NUM.format(2)}", re.I)),
    ("_ house #", True, re.compile(rf"(?<!\w){_ADJ.format(3)}\s*,?\s*(?:д\.|д(?=[\s\d])|дом[уе]?)\s*{_NUM.format(3)}", re.I)),
    ("house # on _", True, re.compile(rf"(?<!\w)дом[уе]?\s*№?\s*{_NUM.format(4)}\s+(?:по|на)\s+(?:{_MARK}\s*)?{_ADJ.format(4)}", re.I)),
    ("# house on _", True, re.compile(rf"(?<![\d№])(?<!№ ){_NUM.format(5)}\s+дом\s+(?:по|на)\s+(?:{_MARK}\s*)?{_ADJ.format(5)}", re.I)),
    ("_ #", False, re.compile(rf"(?<!\w)(?P<s6>[А-ЯЁ][а-яё]+(?:-[А-ЯЁа-яё]+)?(?:ая|яя|ья|ой|ей)|[А-ЯЁ]{{4,}}(?:АЯ|ЬЯ|ОЙ|ЕЙ)),?\s*{_NUM.format(6)}(?:-\d+)?(?!\d|[:.]\d|\s*(?:январ|феврал|март|апрел|ма[яй]\b|июн|июл|август|сентябр|октябр|ноябр|декабр|дн|дней|минут|час|тысяч|руб|человек|раз|лет|год|мес|недел|шт|мет|км|%))")),
    ("# _ street", True, re.compile(r"(?<![\d№])(?<!№ )(?P<h7>\d{1,4}[A-Za-z]?)\s+(?P<s7>[A-Z][a-z]+)\s+(?:street|st\.|avenue|lane|embankment|alley)(?!\w)")),
    ("street _ #", True, re.compile(r"(?<!\w)(?:ulitsa|ul\.)\s*(?P<s8>[A-Za-z]+(?:aya|oy|ey)),?\s*(?:d\.|dom)?\s*(?P<h8>\d{1,4})", re.I)),
]
_CAP = r"(?:[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?|[А-ЯЁ]{3,}|[A-Z][a-z]+|[A-Z]{3,})"
SEQUENCE = re.compile(rf"(?<![\w.«-]){_CAP}(?:[ \u00a0]{_CAP})+(?![\w»])")
_ONE = re.compile(_CAP)
INITIALS = re.compile(
    r"(?<![\w.«])(?:[А-ЯЁ]\.\s?[А-ЯЁ]\.\s?(?P<a>[А-ЯЁ][а-яё]{2,}|[А-ЯЁ]{3,})(?!\w)|(?P<b>[А-ЯЁ][а-яё]{2,}|[А-ЯЁ]{3,}) [А-ЯЁ]\.\s?[А-ЯЁ]\.)"
    r"|(?<![\w.«])(?:[A-Z][a-z]?\.\s?[A-Z][a-z]?\.\s?(?P<c>[A-Z][a-z]{2,}|[A-Z]{3,})(?!\w)|(?P<d>[A-Z][a-z]{2,}|[A-Z]{3,}) [A-Z][a-z]?\.\s?[A-Z][a-z]?\.)"
)
_AFTER = re.compile(r"\s?(?:[А-ЯЁ][а-яё]{2,}|[A-Z][a-z]{2,})")
_EMAIL_GATE = re.compile(r"@|собака|[\[({]\s?at", re.I)
_DIGITS_GATE = re.compile(r"\d[\d ().\-]{7}|\d{6}")
_STREET_GATE = re.compile(r"(?:ая|яя|ья|ой|ей|ую)[ ,.]{1,3}(?:[а-яё№.]{1,11}[ ,.]{0,2}){0,2}\d|дом[уе]? .{0,9}(?:по|на) |\d [A-Z][a-z]+ (?:street|st\.|avenue|lane|embankment|alley)|ulitsa|ul\.", re.I)
_INITIAL_GATE = re.compile(r"[А-ЯЁA-Z][a-z]?\.\s?[А-ЯЁA-Z][a-z]?\.")
PATRONYMIC = re.compile(r".{2,}(?:ович|евич|ьич|овна|евна|ична|ovich|evich|ovna|evna|ichna)$", re.I)
_WORDS = re.compile(r"[^\W_]+")
#: Java expression of the texts that may hold a span; every other text has none.
MAY_HOLD = (
    r"\d[\d ().\-]{8}|@|собака|\[at\]|\(at\)|(?i:снилс|инн|паспорт|passport)"
    r"|\p{Lu}\p{Ll}?\. ?\p{Lu}\p{Ll}?\.|\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+|\p{Lu}{3} \p{Lu}{3}"
    r"|(?:ая|яя|ья|ой|ей|ую)(?: \p{L}{2,10}\.?)?,? ?(?:д|дом|дому|доме)?\.? ?\d|(?i:дом)[уе]? .{0,8}(?:по|на) |\d [A-Z][a-z]+ (?:street|st\.|avenue|lane|embankment|alley)"
)
SPAN = "a int, b int, kind string, certain boolean, words array<string>, patterns array<string>"


def _context(text: str, a: int, b: int) -> list[str]:
    left, right = _WORDS.findall(text[max(0, a - 30) : a].lower()), _WORDS.findall(text[b : b + 25].lower())
    start = text[:a].rstrip(" (—-:,")
    l1 = "^" if not start or start[-1] in ".!?\n" and text[a - 2 : a - 1] in ".!?\n" else left[-1] if left else "^"
    return [f"{l1} _", f"_ {right[0] if right else '$'}"]


def spans_of(text: str) -> list[tuple[int, int, str, bool, list[str], list[str]]]:
    """Certain and uncertain spans of one text: (start, end, kind, certain, instance words, patterns)."""
    out: list[tuple[int, int, str, bool, list[str], list[str]]] = []
    taken = bytearray(len(text))

    def add(a: int, b: int, kind: str, certain: bool, words: list[str], patterns: list[str]) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, kind, certain, words, patterns))

    if _EMAIL_GATE.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email", True, [], [])
    if _DIGITS_GATE.search(text):
        for m in ID_NUMBER.finditer(text):
            add(m.start(), m.end(), "id_number", True, [], [])
        for m in PHONE.finditer(text):
            add(m.start(), m.end(), "phone", True, [], [])
    for name, certain, expression in STREETS if _STREET_GATE.search(text) else ():
        for m in expression.finditer(text):
            word = next(v for k, v in m.groupdict().items() if k[0] == "s" and v)
            add(m.start(), m.end(), "address", certain, [street_stem(word)], [name, *_context(text, m.start(), m.end())[:1]])
    for m in INITIALS.finditer(text) if _INITIAL_GATE.search(text) else ():
        surname = next(v for v in m.groupdict().values() if v)
        if (m["b"] or m["d"]) and (m.start() == 0 or text[m.start() - 2 : m.start()] in (". ", "! ", "? ")):
            # A word that starts a sentence, then initials and a capitalised word: the surname follows.
            if (after := _AFTER.match(text, m.end())) is not None:
                first = re.search(r"\S+\s", m[0]).end() + m.start()
                add(first, after.end(), "name", True, [after[0].strip().title()], _context(text, first, after.end()))
                continue
        add(m.start(), m.end(), "name", True, [surname.title()], _context(text, m.start(), m.end()))
    for m in SEQUENCE.finditer(text):
        parts = [(x.start() + m.start(), x.end() + m.start(), x[0]) for x in _ONE.finditer(m[0])]
        k = 0
        while k < len(parts):
            if k >= 1 and PATRONYMIC.match(parts[k][2]):
                first, last = k - 1, k
                if k + 1 < len(parts):
                    last = k + 1
                elif k >= 2:
                    first = k - 2
                if last - first == 2:
                    words = [w.title() for n, (_, _, w) in enumerate(parts[first : last + 1], first) if n != k]
                    a, b = parts[first][0], parts[last][1]
                    add(a, b, "name", True, words, _context(text, a, b))
                    k = last
            k += 1
        if len(parts) > 5 and m[0].isupper():
            continue  # a sentence in capitals
        for (a, _, u), (_, b, w) in zip(parts, parts[1:], strict=False):
            if not PATRONYMIC.match(u) and not PATRONYMIC.match(w) and u.isupper() == w.isupper():
                out.append((a, b, "name", False, [u.title(), w.title()], _context(text, a, b)))
    return [x for x in out if x[3] or not any(y[3] and y[0] < x[1] and x[0] < y[1] for y in out)]


def street_stem(word: str) -> str:
    return re.sub(r"(?:ая|яя|ья|ой|ей|ую|aya|oy|ey)$", "", word.lower().replace("ё", "е"))


def find_spans(messages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, digest, a, b, kind, certain, words, patterns) of every span: places in the visible form of the
    text with this digest, so that no span carries its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lookalikes()
        for batch in batches:
            rows, keep = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = spans_of(model.text(text))
                rows += found
                keep += [k] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 2)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=[key, "digest", "a", "b", "kind", "certain", "words", "patterns"],
            )

    kind = dict(messages.dtypes)[key]
    rows = messages.select(key, F.col(column).alias("t")).where(F.col("t").rlike(MAY_HOLD) | ~final_form("t"))
    rows = rows.where(F.length("t") > 3).withColumn("digest", F.xxhash64("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, digest bigint, {SPAN}")


def bootstrap(uses: DataFrame, seeds: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Scores of (kind, word) instances and (kind, pattern) patterns from (kind, word, pattern, n) uses.

    Each round scores patterns by the share of their uses with good instances, then instances by the
    mean of their patterns; seeds stay at 1. The tables have one row a distinct word or pattern."""
    scored = seeds.select("kind", "word", F.lit(1.0).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns = (
            uses.join(scored, ["kind", "word"], "left")
            .groupBy("kind", "pattern")
            .agg((F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))) / (F.sum("n") + 1)).alias("p"))
        )
        patterns = materialize(patterns, "pii-patterns")
        fresh = uses.join(patterns, ["kind", "pattern"]).groupBy("kind", "word").agg((F.sum(F.col("n") * F.col("p")) / (F.sum("n") + 0.5)).alias("score"))
        scored = materialize(
            fresh.join(seeds.withColumn("seed", F.lit(1.0)), ["kind", "word"], "full").select("kind", "word", F.coalesce("seed", "score").alias("score")), "pii-instances"
        )
    return scored, patterns


def personal_spans(messages: DataFrame, key: str = "message_id", column: str = "text", word_score: float = 0.5, pattern_score: float = 0.6) -> DataFrame:
    """(key, digest, a, b, kind): the accepted spans."""
    spans = materialize(find_spans(messages, key, column), "pii-spans")
    contextual = spans.where(F.size("words") > 0).select("kind", "certain", "words", F.explode("patterns").alias("pattern"))
    uses = contextual.select("kind", F.explode("words").alias("word"), "pattern").groupBy("kind", "word", "pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = spans.where("certain").select("kind", F.explode("words").alias("word")).groupBy("kind", "word").count().where("count >= 2").select("kind", "word")
    instances, patterns = bootstrap(materialize(uses, "pii-uses"), seeds)
    unsure = spans.where("NOT certain").select(key, "digest", "a", "b", "kind", "words", "patterns").withColumn("code", F.xxhash64(key, "digest", "a", "b"))
    by_word = (
        unsure.select("code", "kind", F.explode("words").alias("word")).distinct().join(instances, ["kind", "word"], "left")
        .groupBy("code").agg(F.first("kind").alias("kind"), F.min(F.coalesce("score", F.lit(0.0))).alias("least"), F.max(F.coalesce("score", F.lit(0.0))).alias("most"))
    )
    by_pattern = unsure.select("code", "kind", F.explode("patterns").alias("pattern")).distinct().join(patterns, ["kind", "pattern"], "left").groupBy("code").agg(F.max("p").alias("p"))
    likely = F.coalesce("p", F.lit(0.0)) >= pattern_score
    # An unseen street is known by its pattern alone, as its form is already telling; a name needs one good word.
    good = by_word.join(by_pattern, "code").where((F.col("least") >= word_score) | (likely & ((F.col("most") >= 0.9) | (F.col("kind") == "address"))))
    taken = unsure.join(good.select("code"), "code", "left_semi")
    return spans.where("certain").select(key, "digest", "a", "b", "kind").unionByName(taken.select(key, "digest", "a", "b", "kind"))


def masked_texts(messages: DataFrame, spans: DataFrame, key: str = "message_id", column: str = "text") -> DataFrame:
    """(key, masked, n): every text with its spans replaced by <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS>, <NAME>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lookalikes()
        for batch in batches:
            out, counts = [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                form = model.text(text) if marks else text
                end, n = len(form or "") + 1, 0
                for m in sorted(marks or (), key=lambda m: (-m["a"], -m["b"])):
                    if m["b"] <= end:
                        form = f"{form[: m['a']]}<{m['kind'].upper()}>{form[m['b'] :]}"
                        end, n = m["a"], n + 1
                out.append(form)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[key, "masked", "n"])

    kind = dict(messages.dtypes)[key]
    # The marks of one text, as many as it has spans, are joined to it once.
    per = spans.distinct().groupBy(key, "digest").agg(F.collect_list(F.struct("a", "b", "kind")).alias("marks"))
    rows = messages.select(key, F.col(column).alias("t")).withColumn("digest", F.xxhash64("t"))
    return rows.join(per, [key, "digest"], "left").select(key, "t", "marks").mapInArrow(run, f"`{key}` {kind}, masked string, n int")
