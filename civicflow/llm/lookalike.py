"""Problem 7: one form for texts that look alike but are stored in different characters.

A text is first freed of what a reader cannot see (ignorable characters, the width of a form, the
kind of a space, the order of combining marks). Then every word spans a lattice: each position holds
all letters that share one shape. Viterbi search picks the path with the best score under a
character bigram model of script-pure words and a penalty for changing the script inside a word. As
the lattice depends on the shapes only, texts that look the same always get the same path.

Defined results: null stays null, an empty text stays empty, letters outside the shape table stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicflow.session import materialize

# Letters of one shape, in the order Cyrillic, Latin, Greek ("-" where a script has none).
SHAPES = (
    "аa- еe- оoο рp- сcϲ уy- хx- іi- ѕs- јj- һh- ԁd- ԛq- ԝw- "
    "АAΑ ВBΒ ЕEΕ КKΚ МMΜ НHΗ ОOΟ РPΡ СCϹ ТTΤ УYΥ ХXΧ ІIΙ ЅSЅ ЈJͿ ԚQ- ԜW- -NΝ -ZΖ "
).split()
CYR, LAT, GRE = 0, 1, 2
SWITCH = -14.0  # log score for a change of script inside a word
CONTEXT = 3.0  # log score for starting a word in the script that prevails in the text

_CLASS: dict[str, tuple[tuple[str, int], ...]] = {}
for _shape in SHAPES:
    _members = tuple((ch, k) for k, ch in enumerate(_shape) if ch != "-")
    for _ch, _ in _members:
        _CLASS[_ch] = _members

# A text in its final form has one script, visible characters only and a letter that fixes the script.
_FIX_CYR = "[бвгджзийклмнптфцчшщъыьэюяёБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁ]"
_FIX_LAT = "[bfgklmnrtuvzDFGLRUV]"
_OUT_CYR = r"[^ -@\[-`{-~\n«»№—–…А-яЁё]"
_OUT_LAT = r"[^ -~\n]"
_PY = [re.compile(x) for x in (_FIX_CYR, _OUT_CYR, _FIX_LAT, _OUT_LAT)]


def is_final(text: str) -> bool:
    fix_cyr, out_cyr, fix_lat, out_lat = _PY
    return bool(fix_cyr.search(text) and not out_cyr.search(text) or fix_lat.search(text) and not out_lat.search(text))


def final_form(column: str) -> Column:
    """As ``is_final``, in the JVM."""
    c = F.col(column)
    return (c.rlike(_FIX_CYR) & ~c.rlike(_OUT_CYR)) | (c.rlike(_FIX_LAT) & ~c.rlike(_OUT_LAT))


_LETTERS = re.compile(r"[^\W\d_]+")
_JOINED_SYMBOL = re.compile(r"(?<=[☀-➿️\U0001F000-\U0001FAFF])‍(?=[☀-➿\U0001F000-\U0001FAFF])")
_MARK = ""  # private: stands for a joiner that holds a symbol together


def visible(text: str) -> str:
    """Drop what cannot be seen; keep everything that can."""
    text = _JOINED_SYMBOL.sub(_MARK, text.replace("\r\n", "\n").replace("\r", "\n"))
    out = []
    for ch in text:
        if ch < "\x7f":
            if ch >= " " or ch in "\n\t":
                out.append(ch)
            continue
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out.append(" ")
        elif kind in ("Cf", "Cc") or ch in "͏ᅟᅠ឴឵ㅤﾠ":
            continue
        elif ch in "‐‑":
            out.append("-")
        elif "ﬀ" <= ch <= "ﬆ" or unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")):
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out)).replace(_MARK, "‍")


def prevailing(text: str) -> int:
    """The script of most letters that no other script shares a shape with; Cyrillic on a tie."""
    cyr = lat = gre = 0
    for ch in text:
        if ch not in _CLASS:
            if "Ѐ" <= ch <= "ԯ":
                cyr += 1
            elif "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῾":
                gre += 1
            elif ch < "ɐ" and ch.isalpha():
                lat += 1
    return GRE if gre > max(lat, cyr) else LAT if lat > cyr else CYR


def _script(ch: str) -> int:
    return CYR if "Ѐ" <= ch <= "ԯ" else GRE if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῾" else LAT


class Lookalikes:
    """Viterbi decoder; ``bigrams`` maps two characters ("^" before the first) to a log probability."""

    FLOOR = -9.0

    def __init__(self, bigrams: dict[str, float] | None = None):
        self.bigrams = bigrams or {}
        self.cache: dict[tuple[str, int], str] = {}

    def word(self, word: str, context: int) -> str:
        if (done := self.cache.get((word, context))) is not None:
            return done
        if len(self.cache) > 500_000:
            self.cache.clear()
        get, floor = self.bigrams.get, self.FLOOR
        # A Greek letter of no shared shape, or a Greek text, makes the word Greek; else Greek letters cost.
        greek = context == GRE or any(ch not in _CLASS and _script(ch) == GRE for ch in word)
        start, fine = (GRE, 0.0) if greek else (context, 20.0)
        paths: list[tuple[float, str, str, int]] = []  # score, form, last letter, script
        for k, ch in enumerate(word):
            states = _CLASS.get(ch) or ((ch, _script(ch)),)
            step = []
            for letter, script in states:
                if k == 0:
                    step.append((get("^" + letter, floor) + CONTEXT * (script == start) - fine * (script == GRE), letter, letter, script))
                else:
                    best = max(
                        ((s + get(last + letter, floor) + (SWITCH if sc != script else 0.0), f, sc) for s, f, last, sc in paths),
                        key=lambda x: (x[0], x[1]),
                    )
                    step.append((best[0] - fine * (script == GRE), best[1] + letter, letter, script))
            paths = step
        form = max(paths, key=lambda x: (x[0], x[3] == start, x[1]))[1]
        self.cache[(word, context)] = form
        return form

    def text(self, text: str) -> str:
        if is_final(text):
            return text
        text = visible(text)
        context = prevailing(text)
        return _LETTERS.sub(lambda m: self.word(m[0], context), text)


def bigram_counts(texts: DataFrame, column: str = "text") -> dict[str, int]:
    """Letter bigrams ("^" before a first letter) over the script-pure words of all texts, with their uses.

    Words are counted first, so each distinct word is cut into bigrams once; the collected table is
    bounded by the squares of the two alphabets."""
    words = texts.select(F.explode(F.split(F.col(column), r"[^\p{L}]+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pure = words.where(F.length("w").between(2, 40) & F.col("w").rlike(r"^(?:[А-яЁё]+|[A-Za-z]+)$"))
    pairs = pure.select("n", F.concat(F.lit("^"), F.col("w")).alias("w")).select(
        "n", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("g")
    )
    return {r.g: r.n for r in pairs.groupBy("g").agg(F.sum("n").alias("n")).collect()}


def bigram_model(texts: DataFrame, column: str = "text") -> dict[str, float]:
    """Log probabilities of the letter bigrams of all texts."""
    counts = bigram_counts(texts, column)
    total: dict[str, int] = {}
    for g, n in counts.items():
        total[g[0]] = total.get(g[0], 0) + n
    return {g: math.log((n + 0.5) / (total[g[0]] + 40.0)) for g, n in counts.items()}


def normalize_texts(texts: DataFrame, key: str, column: str, bigrams: dict[str, float]) -> DataFrame:
    """(key, text, form) of all rows that are not in their final form yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lookalikes(bigrams)
        for batch in batches:
            forms = [None if t is None else model.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], names=[key, column, "form"])

    kind = dict(texts.dtypes)[key]
    rows = texts.select(key, column).where(F.col(column).isNotNull() & ~final_form(column))
    return rows.mapInArrow(run, f"`{key}` {kind}, `{column}` string, form string")


def all_forms(texts: DataFrame, key: str = "message_id", column: str = "text") -> DataFrame:
    """(key, form): every row with its text in the one form; null texts keep null."""
    rows = texts.select(key, column)
    final = rows.where(F.col(column).isNull() | final_form(column)).select(key, F.col(column).alias("form"))
    return final.unionByName(normalize_texts(rows, key, column, bigram_model(rows, column)).select(key, "form"))


def lookalike_pairs(texts: DataFrame, key: str = "message_id", column: str = "text", min_words: int = 12) -> DataFrame:
    """Pairs of rows whose texts look the same and differ in their characters.

    A text in its final form is its own form, so two such texts never make a pair: only forms with at
    least one row that is not final take part, and of these only forms with two different texts. Groups
    of exact copies never meet themselves. Null and empty texts and texts of fewer than ``min_words``
    words make no pair."""
    rows = texts.select(F.col(key).alias("id"), F.col(column).alias("t")).where(F.col("t").isNotNull())
    model = bigram_model(rows, "t")
    changed = normalize_texts(rows, "id", "t", model)
    digest = lambda c: [F.xxhash64(c).alias("k1"), F.xxhash64(F.concat(F.lit("#"), c)).alias("k2")]
    dirty = changed.where(F.regexp_count("form", F.lit(r"[\p{L}\p{N}]+")) >= min_words).select("id", *digest(F.col("form")), F.xxhash64("t").alias("th"))
    clean = rows.where(final_form("t")).select("id", *digest(F.col("t")), F.xxhash64("t").alias("th"))
    dirty = materialize(dirty, "lookalikes")
    forms = dirty.select("k1", "k2").distinct()
    members = dirty.unionByName(clean.join(forms, ["k1", "k2"], "left_semi"))
    varied = members.groupBy("k1", "k2").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").select("k1", "k2")
    members = materialize(members.join(varied, ["k1", "k2"], "left_semi"), "lookalike-members")
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, F.expr("a.k1 = b.k1 AND a.k2 = b.k2 AND a.id < b.id AND a.th <> b.th")).select(
        F.col("a.id").alias(f"{key}_a"), F.col("b.id").alias(f"{key}_b")
    )
