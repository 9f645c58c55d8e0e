"""Problem 4: abusive, hateful or sexual passages by maximum-scoring segment search.

Words are read as a person reads them: look-alike letters, digits and signs standing for letters,
letters set apart by spaces or dots and drawn-out letters are undone first. Each word scores its
log-odds between abusive and other labelled messages under an informative Dirichlet prior (pooled counts
of the sample, and pseudo-counts for stems that are abusive in general language). One scan in linear
time finds all maximal-scoring segments of a text, the passages; the best scores of clean texts follow
an extreme-value distribution whose fit, with a location that grows with the logarithm of the text's length,
turns a passage's score into the chance that a clean text of that length holds one as good. A text is reported
if that chance is at most a level, which is set on labelled rows that the scores were not fitted on.

Defined results: null, empty and blank texts score 0 and are not found; without usable labels the prior
alone decides; contradictory labels of a message count as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicflow.llm.lookalike import Lookalikes

#: At most so many labelled messages are used to fit the word scores.
MAX_LABELLED = 20_000
#: Stems that are abusive, hateful, threatening or sexual in general language.
ABUSIVE_STEMS = (
    "сволоч твар мраз гнид урод ублюд дебил идиот кретин придур подонк скотин недочеловек дегенерат тупиц шлюх проститут "
    "порно секс интим эротич трахат сиськ bastard moron idiot scum nudes whore slut porn fuck"
).split()
PRIOR = 100.0  # weight of the pooled counts
SEED_WEIGHT = 8.0  # pseudo-count of a stem that is abusive in general language
#: Signs that stand for letters, in Cyrillic and in Latin words.
SIGNS_CYR = {"0": "о", "1": "и", "3": "е", "4": "а", "6": "б", "@": "а", "!": "и", "$": "с", "u": "и", "#": "*"}
SIGNS_LAT = {"0": "o", "1": "i", "3": "e", "4": "a", "@": "a", "!": "i", "$": "s", "#": "*"}
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@!$*#](?=[^\W_]))*")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_ENDING = re.compile(r"(?<=...)(?:[аеёиоуыэюяьй]+|s|es)$")
_CYR = re.compile("[а-яё]")
_MIXED = re.compile(r"[\d@!$*#]|[a-z](?=.*[а-яё])|[а-яё](?=.*[a-z])")


def spell(word: str) -> str:
    """A lower-case token with signs turned into the letters they stand for."""
    if _MIXED.search(word) and not word.isdigit():
        letters = sum(ch.isalpha() for ch in word)
        if letters >= 2 and letters * 2 >= len(word):
            signs = SIGNS_CYR if _CYR.search(word) else SIGNS_LAT
            word = "".join(signs.get(ch, ch) for ch in word)
    return _DRAWN.sub(r"\1", word)


def stem(word: str) -> str:
    return _ENDING.sub("", word)


class Reader:
    """Texts to lists of stems, with caches."""

    def __init__(self) -> None:
        self.forms, self.stems = Lookalikes(), {}

    def __call__(self, text: str) -> list[str]:
        low = self.forms.text(text).lower()
        low = _SPACED.sub(lambda m: re.sub(r"[ .\-*_]", "", m[0]), low)
        stems = self.stems
        out = []
        for token in _TOKEN.findall(low):
            s = stems.get(token)
            if s is None:
                if len(stems) > 500_000:
                    stems.clear()
                s = stems[token] = stem(spell(token)) if not token.isdigit() else "#"
            out.append(s)
        return out


@dataclass
class ToxicModel:
    weights: dict[str, float]  # words that score above ``other``
    pairs: dict[str, float] = field(default_factory=dict)  # pairs of words whose second one is in weights
    other: float = -0.7
    location: float = 0.0  # Gumbel fit of the best score of a clean text
    scale: float = 1.0
    words: float = 40.0  # mean length of a clean text
    level: float = 0.02  # chance from which on a text is reported
    report: dict = field(default_factory=dict)

    def chance(self, score: float, words: int) -> float:
        """Chance that a clean text of so many words has a passage with at least this score."""
        location = self.location + self.scale * math.log(max(words, 1) / self.words)
        return -math.expm1(-math.exp(-max(-700.0, (score - location) / self.scale)))

    def found(self, score: float, words: int) -> bool:
        return score > 0 and self.chance(score, words) <= self.level

    def scores(self, stems: list[str]) -> list[float]:
        """Score of each word: of the pair with the word before it where that is known, else its own."""
        get, pair, other = self.weights.get, self.pairs.get, self.other
        out, last = [], "^"
        for s in stems:
            x = get(s)
            if x is None:
                out.append(other)
            else:
                out.append(pair(f"{last} {s}", x))
            last = s
        return out

    def best(self, stems: list[str]) -> float:
        weights = self.weights
        if not any(s in weights for s in stems):
            return 0.0
        top = total = 0.0
        for x in self.scores(stems):
            total += x
            if total <= 0.0:
                total = 0.0
            elif total > top:
                top = total
        return top


def passages(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time (Ruzzo and Tompa)."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for k, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        part = (k, k + 1, before, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= part[2]:
                j -= 1
            if j < 0 or stack[j][3] >= part[3]:
                stack.append(part)
                break
            part = (stack[j][0], part[1], stack[j][2], part[3])
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after in stack]


def _seeded(word: str) -> bool:
    return word.startswith(tuple(ABUSIVE_STEMS))


def _log_odds(bad: Counter, good: Counter, prior: Counter) -> dict[str, float]:
    """Log-odds less one and a half standard deviations, so rare words need more than chance."""
    n, bad_n, good_n = sum(prior.values()) or 1, sum(bad.values()), sum(good.values())
    out = {}
    for w in set(prior) | set(ABUSIVE_STEMS):
        a = 0.5 + PRIOR * prior[w] / n
        x, y = bad[w] + a + (SEED_WEIGHT if _seeded(w) else 0.0), good[w] + a
        odds = math.log(x / (bad_n + PRIOR)) - math.log(y / (good_n + PRIOR))
        out[w] = odds - 1.5 * math.sqrt(1 / x + 1 / y)
    return out


def _with_gaps(weights: dict[str, float]) -> dict[str, float]:
    """Adds strong words with one letter starred out."""
    gaps = {w[:k] + "*" + w[k + 1 :]: x for w, x in weights.items() if x >= 2 and len(w) >= 4 for k in range(1, len(w))}
    return gaps | weights


def fit(labelled: list[tuple[str, int]], rounds: int = 3) -> ToxicModel:
    """The model of all (text, label) rows, with the level that separates best where every half of the rows
    is judged by the model of the other half."""
    model = _fit(labelled, rounds)
    if sum(y for t, y in labelled if t) >= 20:
        reader, judged = Reader(), []
        for part in (0, 1):
            half = _fit(labelled[part::2], rounds)
            for t, y in labelled[1 - part :: 2]:
                if t:
                    stems = reader(t)
                    best = half.best(stems)
                    judged.append((half.chance(best, len(stems)) if best > 0 else 1.0, y))
        judged.sort()
        total, hits, top = sum(y for _, y in judged), 0, (0.0, model.level)
        for k, (chance, y) in enumerate(judged):
            hits += y
            following = judged[k + 1][0] if k + 1 < len(judged) else 1.0
            f1 = 2 * hits / (k + 1 + total)
            if chance < following and f1 > top[0] and chance < 0.5:
                top = (f1, math.sqrt(max(chance, 1e-300) * max(following, 1e-300)))
        model.level = top[1]
        model.report |= {"f1": top[0], "level": model.level}
    return model


def _fit(labelled: list[tuple[str, int]], rounds: int) -> ToxicModel:
    """Word scores and extreme-value fit from (text, label) rows.

    A label holds for a whole message, so after each round only the best passage of an abusive message
    counts as abusive; its other words count with the clean ones."""
    reader = Reader()
    rows = [(reader(t), y) for t, y in labelled if t]
    prior: Counter = Counter()
    both: Counter = Counter()
    good, bad, good2, bad2 = Counter(), Counter(), Counter(), Counter()
    for stems, y in rows:
        prior.update(stems)
        both.update(set(zip(["^", *stems], stems, strict=False)))
        (bad if y else good).update(set(stems))
    model = ToxicModel({})
    for _ in range(rounds):
        odds = _log_odds(bad, good, prior)
        model.weights = _with_gaps({w: min(x, 6.0) for w, x in odds.items() if x > 0.3})
        if bad2 or good2:
            shift = math.log((sum(good.values()) + PRIOR) / (sum(bad.values()) + PRIOR))
            model.pairs = {
                f"{u} {w}": max(-3.0, min(x, 6.0))
                for (u, w), n in both.items()
                if n >= 3 and w in model.weights
                for x in [math.log((bad2[u, w] + 0.5) / (good2[u, w] + 0.5)) + shift - 1.5 * math.sqrt(1 / (bad2[u, w] + 0.5) + 1 / (good2[u, w] + 0.5))]
                if good2[u, w] >= 3 or x > model.weights[w]
            }
        bad, good, bad2, good2 = Counter(), Counter(), Counter(), Counter()
        for stems, y in rows:
            pairs = list(zip(["^", *stems], stems, strict=False))
            if not y:
                good.update(set(stems))
                good2.update(set(pairs))
                continue
            found = passages(model.scores(stems))
            a, b, s = max(found, key=lambda p: p[2], default=(0, 0, 0.0))
            inside = set(stems[a:b]) if s > 1.5 else set()
            bad.update(inside)
            good.update(set(stems) - inside)
            bad2.update(set(pairs[a:b]) if inside else ())
            good2.update(set(pairs) - set(pairs[a:b]) if inside else pairs)
    clean = [(model.best(stems), len(stems)) for stems, y in rows if not y and stems] or [(0.0, 40)]
    model.words = math.exp(sum(math.log(n) for _, n in clean) / len(clean))
    mean = sum(x for x, _ in clean) / len(clean)
    spread = math.sqrt(sum((x - mean) ** 2 for x, _ in clean) / len(clean))
    model.scale = max(spread * math.sqrt(6) / math.pi, 0.2)
    model.location = mean - 0.5772 * model.scale
    model.report = {"rows": len(rows), "abusive": sum(y for _, y in rows)}
    return model


def fit_from_labels(messages: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicModel:
    votes = labels.where(F.col("abusive").isNotNull()).select("message_id", "abusive")
    sample = votes.orderBy(F.xxhash64("message_id"), "message_id", "abusive").limit(max_labelled)
    rows = messages.select("message_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "message_id")
    return fit([(r.text, r.abusive) for r in sorted(rows.collect(), key=lambda r: (r.message_id, r.abusive))])


def score_messages(messages: DataFrame, model: ToxicModel, only_found: bool = False, key: str = "message_id", column: str = "text") -> DataFrame:
    """(key, score, chance, passages, found): every text, or only those found."""
    kind = dict(messages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            keep, score, chance, spans, found = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                stems = reader(text) if text else []
                best = model.best(stems)
                hit = model.found(best, len(stems))
                if only_found and not hit:
                    continue
                keep.append(k)
                found.append(hit)
                score.append(round(best, 6))
                chance.append(model.chance(best, len(stems)) if best > 0 else 1.0)
                spans.append([" ".join(stems[a:b]) for a, b, s in passages(model.scores(stems)) if model.found(s, len(stems))] if hit else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep, pa.int64())), pa.array(score, pa.float64()), pa.array(chance, pa.float64()),
                    pa.array(spans, pa.list_(pa.string())), pa.array(found, pa.bool_()),
                ],
                names=[key, "score", "chance", "passages", "found"],
            )

    return messages.select(key, column).mapInArrow(run, f"`{key}` {kind}, score double, chance double, passages array<string>, found boolean")


def rates_by_source(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """(source, messages, found, rate): the share of offending messages of each source."""
    per = messages.select("message_id", "source").join(scored.select("message_id", "found"), "message_id")
    return per.groupBy("source").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if("found").alias("found"), F.round(F.count_if("found") / F.count(F.lit(1)), 6).alias("rate")
    )
